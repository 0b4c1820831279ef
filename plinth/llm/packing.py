"""Packing of documents into fixed-length training sequences: shortest-pack-first over a length histogram.

Documents become token ids and are cut into pieces of at most ``max_tokens``.  Only the
histogram of piece lengths (at most ``max_tokens`` numbers) reaches the driver, where
lengths are placed longest first into the shortest pack with room; packs are kept as
patterns with a count, so the cost does not depend on the number of documents.  Each piece
then finds its place by its rank among the pieces of equal length.  Ranks are a running
count inside each task plus the counts of the tasks before it, so a length that a third of
all pieces share is never gathered anywhere.

Defined results: null text is an empty document and has the end id only; rows with equal id
are packed each on its own; an empty table gives an empty table; very long texts are cut.
A sequence whose length is a power of two needs no padding; others are padded to
``max_tokens`` (``padded_length``).
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.shared import bounded_batches, texts_of
from plinth.llm.tokenizing import CACHE_PIECES, encoder
from plinth.staging import stage

Pattern = tuple[int, tuple[int, ...]]  # how many packs, lengths in each


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[Pattern]:
    """Patterns that place ``histogram[length]`` pieces of each length, longest lengths first."""
    by_room: list[list[Pattern]] = [[] for _ in range(max_tokens + 1)]
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], max_tokens  # the shortest pack with room has the most room: look from above
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room >= length:
                packs, lengths = by_room[room].pop()
                used = min(packs, left)
                if packs > used:
                    by_room[room].append((packs - used, lengths))
                by_room[room - length].append((used, (*lengths, length)))
                left -= used
            else:  # no open pack has room: new ones, as full of this length as can be
                copies = min(max_tokens // length, left)
                used = left // copies
                by_room[max_tokens - copies * length].append((used, (length,) * copies))
                left -= used * copies
    return [pattern for patterns in by_room for pattern in patterns]


def placements(patterns: list[Pattern]) -> dict[int, tuple[list[int], list[tuple[int, int, int]]]]:
    """For each length: first ranks, and for each the first sequence, copies a pack and first offset."""
    table: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for packs, lengths in patterns:
        offset = i = 0
        while i < len(lengths):
            length, copies = lengths[i], 1
            while i + copies < len(lengths) and lengths[i + copies] == length:
                copies += 1
            first, places = table.setdefault(length, ([], []))
            first.append(ranks.get(length, 0))
            places.append((sequence, copies, offset))
            ranks[length] = first[-1] + packs * copies
            offset += copies * length
            i += copies
        sequence += packs
    return table


def token_pieces(
    docs: DataFrame, tokenizer: str, max_tokens: int, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 1, with_ids: bool = False, cache_pieces: int = CACHE_PIECES,
) -> DataFrame:
    """One row for each piece, staged: its place in its document, the task that cut it and its rank there."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cache_pieces)
        end = np.array([end_id], encode.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (max_tokens + 1)
        for batch in batches:
            rows, rank, crc, blobs = [], [], [], []
            for i, text in enumerate(texts_of(batch, "text")):
                ids = np.frombuffer(encode.encode(text) + end, encode.dtype).astype("<u4")
                for start in range(0, len(ids), max_tokens):
                    piece = ids[start : start + max_tokens]
                    rows.append((i, start, len(piece), len(ids)))
                    rank.append(seen[len(piece)])
                    seen[len(piece)] += 1
                    crc.append(zlib.crc32(piece.tobytes()))
                    if with_ids:
                        blobs.append(piece)
            doc, start, length, total = (np.array(x, np.int64) for x in zip(*rows))
            yield pa.record_batch({
                "_id": batch.column("id").take(pa.array(doc)),
                "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(total), "_part": pa.array(np.full(len(doc), part, np.int32)),
                "_rank": pa.array(rank, pa.int64()),
                **({"ids": pa.array(blobs, pa.list_(pa.int32()))} if with_ids else {}),
            })

    schema = (
        f"_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, _part int, _rank long"
        + ", ids array<int>" * with_ids
    )
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stage(source.mapInArrow(run, schema), "pieces")


def pack(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", max_tokens: int = 2048, id_col: str = "doc_id",
    text_col: str = "text", end_id: int = 1, with_ids: bool = False, cache_pieces: int = CACHE_PIECES,
) -> DataFrame:
    """The place of every piece: sequence and offset, gapless from 0; ``ids`` on demand."""
    pieces = token_pieces(docs, tokenizer, max_tokens, id_col, text_col, end_id, with_ids, cache_pieces)
    counts = pieces.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = placements(shortest_pack_first(histogram, max_tokens))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # its size follows max_tokens, not the documents
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    ranked = pieces.join(before, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.drop("_part", "_before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("_rank").to_pylist()):
                first, places = shared.value[length]
                k = bisect.bisect_right(first, rank) - 1
                base, copies, at = places[k]
                pack_no, slot = divmod(rank - first[k], copies)
                sequence.append(base + pack_no)
                offset.append(at + slot * length)
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.record_batch({
                **{id_col if n == "_id" else n: batch.column(n) for n in names},
                "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()),
            })

    fields = [(id_col if f.name == "_id" else f.name, f.dataType.simpleString()) for f in ranked.schema if f.name != "_rank"]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*fields, ("sequence_id", "long"), ("offset", "long")])
    return ranked.mapInArrow(run, schema)


def assemble(pieces: DataFrame, max_tokens: int = 2048, pad_id: int = 0) -> DataFrame:
    """Whole sequences from pieces with ``ids``: at most ``max_tokens`` ids meet in a group."""
    whole = pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"),
    )
    length = F.size("ids")
    padded = F.when(F.bit_count(length) == 1, length).otherwise(F.lit(max_tokens))
    return whole.select(
        "sequence_id", length.alias("length"), padded.alias("padded_length"),
        F.concat("ids", F.array_repeat(F.lit(pad_id), padded - length)).alias("ids"),
    )
