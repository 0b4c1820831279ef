"""Token ids in binary blocks, compressed by a static range asymmetric numeral system (rANS).

Layout of a store, a folder that Spark writes and reads:

* ``frequencies/``: (token, frequency), the shared table, scaled to ``1 << SCALE_BITS``;
* ``blocks/``: one row a block, in ascending order of document id from file to file:
  ``part``, ``block``, ``local_start`` (ids of the part before the block), ``doc_ids``,
  ``doc_tokens``, ``checksum`` (crc32 of the ids) and ``payload``.

A payload is little-endian: magic ``RANS``, lanes (u4), ids (u4), steps between checkpoints
(u4), number of checkpoints (u4), then for each checkpoint the word it starts at (u4) and
the state of each lane (u8), then the words (u4).  Id ``i`` belongs to lane ``i % lanes``;
all lanes of a step are coded at once.  Blocks, and the runs between checkpoints, decode on
their own and so in parallel; a block whose ids do not match the checksum fails the job.

Defined results: null text is an empty document (end id only); NULL ids sort first; rows
with equal id follow each other, each with its own place; an empty table gives an empty
store; a text longer than a block makes a longer block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.shared import bounded_batches
from plinth.llm.tokenizing import encoder
from plinth.staging import stage

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
STORE_PIECES = 1_200_000  # of the piece table: nothing else fills the worker's memory here
ENCODE_ROWS, ENCODE_BYTES = 5000, 16 << 20
LANES, CHECKPOINT_STEPS, BLOCK_IDS = 1024, 256, 1 << 19
_MASK, _WORD, _SCALE = np.uint64((1 << SCALE_BITS) - 1), np.uint64(32), np.uint64(SCALE_BITS)


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to the scale; every id that occurs keeps at least 1."""
    total, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    if not total:
        return out
    present = np.flatnonzero(counts)
    spare = (1 << SCALE_BITS) - len(present)
    if spare < 0:
        raise ValueError(f"more than {1 << SCALE_BITS} distinct ids")
    out[present] = 1 + (counts[present].astype(object) * spare // total).astype(np.int64)
    out[present[np.argmax(counts[present])]] += (1 << SCALE_BITS) - out.sum()
    return out


class Model:
    """The tables of the coder."""

    def __init__(self, frequencies: np.ndarray) -> None:
        self.frequency = frequencies.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> bytes:
        state = np.full(lanes, LOW, np.uint64)
        steps = -(-len(ids) // lanes)
        words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
        states: list[np.ndarray] = []
        for step in range(steps - 1, -1, -1):
            symbols = ids[step * lanes : (step + 1) * lanes]
            f, x = self.frequency[symbols], state[: len(symbols)]
            full = x >= f << np.uint64(43)  # (LOW >> SCALE_BITS) << 32 per unit of frequency
            words[step] = x[full].astype(np.uint32)
            x = np.where(full, x >> _WORD, x)
            quotient = x // f
            state[: len(symbols)] = (quotient << _SCALE) + (x - quotient * f) + self.start[symbols]
            if step % every == 0:
                states.append(state.copy())
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        head = [struct.pack("<4s4I", b"RANS", lanes, len(ids), every, len(states))]
        for k, saved in enumerate(reversed(states)):
            head += [struct.pack("<I", at[k * every]), saved.astype("<u8").tobytes()]
        return b"".join(head + [w.astype("<u4").tobytes() for w in words])

    def decode(self, payload: bytes, segments: range | None = None) -> np.ndarray:
        """The ids, of all runs between checkpoints or of some."""
        magic, lanes, n, every, checkpoints = struct.unpack_from("<4s4I", payload)
        if magic != b"RANS":
            raise ValueError("not a block of token ids")
        words = np.frombuffer(payload, "<u4", offset=20 + checkpoints * (4 + 8 * lanes))
        out = []
        for k in range(checkpoints) if segments is None else segments:
            at = 20 + k * (4 + 8 * lanes)
            word = struct.unpack_from("<I", payload, at)[0]
            state = np.frombuffer(payload, "<u8", lanes, at + 4).astype(np.uint64)
            for step in range(k * every, min((k + 1) * every, -(-n // lanes))):
                x = state[: min(lanes, n - step * lanes)]
                slot = x & _MASK
                symbols = self.symbol[slot]
                x = self.frequency[symbols] * (x >> _SCALE) + slot - self.start[symbols]
                low = np.flatnonzero(x < LOW)
                x[low] = (x[low] << _WORD) | words[word : word + len(low)]
                word += len(low)
                state[: len(x)] = x
                out.append(symbols)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some ``ENCODE_ROWS`` rows or ``ENCODE_BYTES``, in which pieces repeat more often."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ENCODE_ROWS or sum(b.nbytes for b in held) >= ENCODE_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _token_ids(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, STORE_PIECES)
        for batch in _gathered(batches):
            ids = encode.encode_all(batch.column("text"), end_id)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "ids": ids,
                "width": pa.array([encode.dtype.itemsize] * len(ids), pa.int32()),
            })

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, ids binary, width int")


def _counts(ids: DataFrame) -> DataFrame:
    """(token, n) over all documents: counted in each task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                width = batch.column("width")[0].as_py()
                flat = np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{width}")
                one = np.bincount(flat, minlength=len(total))
                one[: len(total)] += total
                total = one
        token = np.flatnonzero(total)
        yield pa.record_batch({"token": pa.array(token.astype(np.int32)), "n": pa.array(total[token].astype(np.int64))})

    return ids.select("ids", "width").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text",
    end_id: int = 1, block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every text and write the store to ``path``, a folder all executors share."""
    spark = docs.sparkSession
    ids = stage(_token_ids(docs, tokenizer, id_col, text_col, end_id), "token-ids")
    rows = _counts(ids).collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max((r["token"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    frequencies = scaled_frequencies(counts)
    spark.createDataFrame(
        [(int(t), int(frequencies[t])) for t in np.flatnonzero(frequencies)], "token int, frequency long"
    ).coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(frequencies)
    id_type = ids.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, docs_in, held, block, start = Model(shared.value), [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal docs_in, held, block, start
            flat = np.concatenate([i for _, i, _ in docs_in]).astype(np.uint32)
            out = pa.record_batch({
                "part": pa.array([docs_in[0][2]], pa.int32()), "block": pa.array([block], pa.int32()),
                "local_start": pa.array([start], pa.int64()),
                "doc_ids": pa.array([[d for d, _, _ in docs_in]], pa.list_(kind)),
                "doc_tokens": pa.array([[len(i) for _, i, _ in docs_in]], pa.list_(pa.int64())),
                "checksum": pa.array([zlib.crc32(flat.astype("<u4").tobytes())], pa.int64()),
                "payload": pa.array([model.encode(flat)], pa.binary()),
            })
            start, block, docs_in, held = start + len(flat), block + 1, [], 0
            return out

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            names = ("doc_id", "ids", "width", "part")
            for doc, blob, width, part in zip(*(batch.column(c).to_pylist() for c in names)):
                docs_in.append((doc, np.frombuffer(blob, f"<u{width}"), part))
                held += len(docs_in[-1][1])
                if held >= block_ids:
                    yield close()
        if docs_in:
            yield close()

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(
        run,
        f"part int, block int, local_start long, doc_ids array<{id_type}>, doc_tokens array<long>, checksum long, payload binary",
    ).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row a document from the files: place among all ids, number of ids, their crc32, and the ids if asked for."""
    rows = spark.read.parquet(f"{path}/frequencies").collect()
    frequencies = np.zeros(max((r["token"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        frequencies[r["token"]] = r["frequency"]
    shared = spark.sparkContext.broadcast(frequencies)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum(F.expr("aggregate(doc_tokens, 0L, (n, x) -> n + x)")).alias("n")).collect()
    starts, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):  # one row for each written file
        starts[r["part"]], at = at, at + r["n"]
    offsets = spark.sparkContext.broadcast(starts)
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for batch in batches:
            names = ("part", "block", "local_start", "doc_ids", "doc_tokens", "checksum", "payload")
            for part, block, start, docs, lengths, checksum, payload in zip(*(batch.column(c).to_pylist() for c in names)):
                ids = model.decode(payload).astype("<u4")
                if zlib.crc32(ids.tobytes()) != checksum:
                    raise ValueError(f"block {block} of part {part} is damaged")
                ends = np.cumsum(lengths)
                pieces = np.split(ids, ends[:-1])
                yield pa.record_batch({
                    "doc_id": pa.array(docs, batch.schema.field("doc_ids").type.value_type),
                    "start": pa.array(offsets.value[part] + start + ends - np.array(lengths)),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
                    **({"ids": pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32()))} if with_ids else {}),
                })

    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.mapInArrow(run, schema)
