"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Every window of ``width`` consecutive item words (the whole item if it has fewer) is one
pattern.  Texts are normalised to lower-case words between single spaces, so one scan of
the automaton finds every window at word limits; matches are mapped back to character
spans of the original text.

The automaton is broadcast.  Its patterns are counted first: beyond ``MAX_PATTERN_BYTES``
they are dealt to several automata by hash and the documents are scanned once with each,
so what one worker holds never grows with the benchmark.

Defined results: null or wordless texts and items have no words and match nothing; items
with equal id are one item; items with a NULL id still hit words but are not listed; an
empty benchmark hits nothing; very long texts are scanned whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import bounded_batches, texts_of
from plinth.staging import stage

MAX_PATTERN_BYTES = 8 << 20
CARRIED = "_dc_hit array<int>, _dc_items array<string>"
RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int>>"

# Bytes that separate words become a space, A-Z become a-z, all others stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(pattern, n, item): one row for each distinct window of an item; item ids as strings."""
    bounded_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), texts_of(batch, "text")):
                words = words_of(text)
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    part = words[i : i + width]
                    rows.append((b" " + b" ".join(part) + b" ", len(part), item))
            if rows:
                patterns, n, ids = zip(*rows)
                yield pa.record_batch(
                    {"pattern": pa.array(patterns, pa.binary()), "n": pa.array(n, pa.int32()),
                     "item": pa.array(ids, pa.string())}
                )

    source = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "pattern binary, n int, item string").distinct()


def _pattern_lists(windows: DataFrame) -> Iterator[tuple[bool, list[tuple[str, int, list[str]]]]]:
    """The patterns with their items, dealt into lists of bounded size; one list for all but huge benchmarks."""
    windows = stage(windows, "item-windows")
    size = windows.agg(F.sum(F.octet_length("pattern") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    parts = -(-size // MAX_PATTERN_BYTES) or 1
    dealt = windows.groupBy("pattern", "n").agg(F.collect_set("item").alias("items")).withColumn(
        "part", F.pmod(F.xxhash64("pattern"), F.lit(parts))
    )
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).collect()
        yield part == parts - 1, [
            (bytes(r["pattern"]).decode("utf-8", "surrogatepass"), r["n"], list(r["items"])) for r in rows
        ]


_BUILT: dict[str, object] = {}


def _named(patterns: list) -> tuple[str, list]:
    """A list of patterns with a name of its own, made on the driver; an address may return in a worker."""
    return uuid.uuid4().hex, patterns


def _built(broadcast) -> object | None:
    """The automaton of a broadcast list with its name, built once in each Python worker."""
    key, patterns = broadcast.value
    if key not in _BUILT:
        _BUILT.clear()
        automaton = ahocorasick.Automaton()
        for pattern, n, items in patterns:
            automaton.add_word(pattern, (n, items))
        if len(automaton):
            automaton.make_automaton()
        _BUILT[key] = automaton if len(automaton) else None
    return _BUILT[key]


def scan_text(text: str, automaton) -> tuple[int, set[int], set[str]]:
    """Number of words, positions of hit words, items with an occurring window."""
    words = words_of(text)
    hit: set[int] = set()
    items: set[str] = set()
    if words and automaton is not None:
        normal = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
        found = list(automaton.iter(normal))
        if found:
            # The space at an end offset closes a word: its rank among the spaces is the word's number.
            spaces = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            last = np.searchsorted(spaces, [end for end, _ in found])
            for k, (_, (n, ids)) in zip(last.tolist(), found):
                hit.update(range(k - n, k))
                items.update(ids)
    return len(words), hit, items


def spans_of(text: str, hit: set[int]) -> list[dict[str, int]]:
    """Character spans of the original text that runs of hit words cover."""
    spans: list[dict[str, int]] = []
    before = None
    for k, m in enumerate(_WORD.finditer(text)) if hit else ():
        if k in hit:
            if before == k - 1:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
            before = k
    return spans


def _scan(source: DataFrame, patterns: list, names: list[str], text_col: str, last: bool) -> DataFrame:
    """One pass over the documents; all but the last carry text, hits and items on to the next."""
    shared = source.sparkSession.sparkContext.broadcast(_named(patterns))
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            automaton = _built(shared)
            texts = texts_of(batch, text_col)
            hits, items, n_words = batch.column("_dc_hit").to_pylist(), batch.column("_dc_items").to_pylist(), []
            for i, text in enumerate(texts):
                n, hit, ids = scan_text(text, automaton)
                n_words.append(n)
                hits[i] = sorted(hit.union(hits[i]))
                items[i] = sorted({x for x in ids if x is not None}.union(items[i]))
            columns = {c: batch.column(c) for c in names}
            if last:
                spans = [spans_of(t, set(h)) for t, h in zip(texts, hits)]
                columns |= {
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_hit": pa.array([len(h) for h in hits], pa.int64()),
                    "item_ids": pa.array(items, pa.list_(pa.string())),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                }
            else:
                columns |= {
                    **({} if text_col in names else {text_col: batch.column(text_col)}), "_dc_hit": pa.array(hits, pa.list_(pa.int32())),
                    "_dc_items": pa.array(items, pa.list_(pa.string())),
                }
            yield pa.record_batch(columns)

    on = CARRIED if text_col in names else f"{text_col} string, {CARRIED}"
    return source.mapInArrow(run, ", ".join(filter(None, [carried, RESULT if last else on])))


def contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 10, keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of every row (all by default) with ``n_words``, ``n_hit``, ``item_ids`` and ``spans``.

    Columns of ``docs`` with one of those four names are replaced.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "item_ids", "spans")]
    own = [] if text_col in names else [F.col(text_col).alias("_dc_text")]  # a kept text need not travel twice
    text = text_col if text_col in names else "_dc_text"
    out = docs.select(
        *names, *own, F.expr("cast(array() as array<int>)").alias("_dc_hit"),
        F.expr("cast(array() as array<string>)").alias("_dc_items"),
    )
    for last, patterns in _pattern_lists(item_windows(items, item_id, item_text, width)):
        out = _scan(out, patterns, names, text, last)
        if not last:
            out = stage(out, "scanned")
    return out
