"""Exact Jaccard self-join on word shingles with token-combination prefixes.

1. A document becomes the set of its shingle hashes; equal sets are one class.
2. Shingles are counted.  Each task counts a chunk of documents on its own, each class
   once, and ships one compressed run for each hash range; a shingle that many classes of a
   chunk hold travels as a mark only, so no range gathers a frequent shingle's documents.
   Shingles of a single class can match nothing and go no further.
3. Shingles are ordered by (count, hash), rarest first.  If two sets are similar, at
   most ``e`` members of one are missing in the other.  The prefix of a set is extended
   until it holds ``e + 1`` units: a rare shingle is a unit and is indexed alone; frequent
   shingles fall into sub-classes by hash, of which each member but the first is a unit,
   and are indexed by pairs within a sub-class.  Similar sets then share an index entry.
4. Under each entry all sets are verified against the most typical one, the set with the
   fewest shingles of its own.  Sets of one component need no further check.  What is left
   are pairs across components.  Shingles of its own count against a set with every partner, so
   one of two similar sets is light, with at most half the share of own ones that a pair may have;
   light sets alone look for partners. What both have in common with the typical set and with any
   set at all bounds what they share, and the pairs within the bounds are all verified.  So a
   group of n near copies costs about n checks, pages that share a template and no more cost none,
   and no link between components is lost.

Verification counts common members exactly (of 56-bit hashes, for a pair of texts).

Defined results: null, empty and wordless texts have no set and link with nothing; a text
with fewer words than a shingle has one member, the whole sequence; rows with equal text
are one class; the component is the smallest id in reach, NULL ids never; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.components import components
from plinth.llm.shared import bounded_batches, texts_of
from plinth.operators.attach import attach
from plinth.staging import stage_alone

CHUNK_MEMBERS, CHUNK_DOCS = 1_500_000, 50_000  # of one task's counting chunk
RANGE_MEMBERS = 4_000_000  # of one hash range
HOT_IN_CHUNK = 16  # classes of a chunk from which a shingle travels as a mark
FREQUENT = 64  # occurrences from which a shingle is indexed by pairs
HOT = 0xFFFFFFFF

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPARE = np.uint64(8)  # hashes have 56 bits, so that differences of sorted ones fit in 5 bytes
_GOLDEN, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    ends = np.cumsum([len(w) for w in words])
    flat = np.empty(int(ends[-1]) if len(ends) else 0, object)
    flat[:] = [x for w in words for x in w]
    hashes = pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)
    weights = _mixed(np.arange(1, width + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
    count = max(0, len(hashes) - width + 1)
    rolled = np.zeros(count, np.uint64)
    for j in range(width):
        rolled += hashes[j : j + count] * weights[j]
    rolled = _mixed(rolled) >> _SPARE
    sets = []
    for w, end in zip(words, ends):
        start = end - len(w)
        if len(w) >= width:
            sets.append(np.unique(rolled[start : end - width + 1]))
        elif w:
            whole = (hashes[start:end] * weights[: len(w)]).sum(keepdims=True) + np.uint64(len(w))
            sets.append(_mixed(_mixed(whole)) >> _SPARE)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _class_of(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


class _Chunk:
    """Documents of one task, counted together."""

    def __init__(self) -> None:
        self.docs: list = []
        self.doc_class: list[bytes | None] = []
        self.doc_n: list[int] = []
        self.number: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.members = 0

    def add(self, doc, members: np.ndarray) -> None:
        cls = _class_of(members) if len(members) else None
        self.docs.append(doc)
        self.doc_class.append(cls)
        self.doc_n.append(len(members))
        if cls is not None and cls not in self.number:
            self.number[cls] = len(self.sets)
            self.sets.append(members)
            self.members += len(members)

    def rows(self, ranges: int, home: int, chunk: int, id_type: pa.DataType) -> pa.RecordBatch:
        """One row for each hash range; documents, classes and frequent members go to range ``home``."""
        sizes = np.array([len(x) for x in self.sets], np.int64)
        member = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.sets), dtype=np.uint16), sizes)
        order = np.argsort(member, kind="stable")
        member, owner = member[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]])) if len(member) else np.zeros(0, int)
        run = np.diff(np.append(first, len(member)))
        hot = np.repeat(run >= HOT_IN_CHUNK, run)
        marks = member[first[run >= HOT_IN_CHUNK]]
        whole = {
            "docs": self.docs, "doc_class": b"".join(c or bytes(16) for c in self.doc_class),
            "doc_n": np.array(self.doc_n, "<u4").tobytes(), "class": b"".join(self.number),
            "size": sizes.astype("<u4").tobytes(), "hot": member[hot].tobytes(), "hot_owner": owner[hot].tobytes(),
        }
        member, owner = member[~hot], owner[~hot]
        limits, mark_range = _range_of(member, ranges), _range_of(marks, ranges)
        out = [{"range": home, "chunk": chunk, **whole}]
        for r in np.unique(np.concatenate([limits, mark_range])):
            a, b = np.searchsorted(limits, [r, r + 1])
            out.append({
                "range": int(r), "chunk": chunk, "member": _short(member[a:b]), "owner": owner[a:b].tobytes(),
                "mark": marks[mark_range == r].tobytes(),
            })
        kinds = {"range": pa.int32(), "chunk": pa.int64(), "docs": pa.list_(id_type)}
        return pa.record_batch({c: pa.array([x.get(c) for x in out], kinds.get(c, pa.binary())) for c in CHUNK_COLUMNS})


CHUNK_COLUMNS = (
    "range", "chunk", "member", "owner", "mark", "docs", "doc_class", "doc_n", "class", "size", "hot", "hot_owner",
)


def _short(members: np.ndarray) -> bytes:
    """Sorted hashes as differences of 5 bytes, or of 8 where one is larger; the first byte tells."""
    steps = np.diff(members, prepend=np.uint64(0)).astype("<u8")
    width = 5 if not len(steps) or steps[1:].max(initial=0) < 1 << 40 else 8
    start = members[:1].astype("<u8").tobytes()
    return bytes([width]) + start + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _long(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.zeros(0, np.uint64)
    width = data[0]
    steps = np.zeros(((len(data) - 9) // width + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64)


def _range_of(members: np.ndarray, ranges: int) -> np.ndarray:
    return ((members >> np.uint64(24)) * np.uint64(ranges)) >> np.uint64(32)


def _shared_members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, member, count) of the members of a hash range that occur twice or more, and of the frequent ones."""
    members, owners, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    passed = []
    names = ("chunk", "member", "owner", "mark", "hot", "hot_owner")
    for chunk, member, owner, mark, hot, hot_owner in zip(*(table.column(c).to_pylist() for c in names)):
        if hot is not None:
            passed.append((chunk << 16 | np.frombuffer(hot_owner, "<u2").astype(np.int64), np.frombuffer(hot, "<u8")))
        if member is not None:
            members.append(_long(member))
            owners.append(chunk << 16 | np.frombuffer(owner, "<u2").astype(np.int64))
            marks.append(np.frombuffer(mark, "<u8"))
    member, owner = np.concatenate(members), np.concatenate(owners)
    mark = np.unique(np.concatenate(marks))
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]])) if len(member) else np.zeros(0, int)
    run = np.diff(np.append(first, len(member)))
    count = np.where(np.isin(member[first], mark), HOT, run)
    keep = np.repeat(count >= 2, run)
    member, owner, count = member[keep], owner[keep], np.repeat(count, run)[keep]
    return (
        np.concatenate([owner, *(o for o, _ in passed)]), np.concatenate([member, *(m for _, m in passed)]).astype(np.int64),
        np.concatenate([count, *(np.full(len(o), HOT) for o, _ in passed)]).astype(np.int64),
    )


def missing_allowed(n: int, percent: int) -> int:
    """Members of a set of ``n`` that a similar set may lack."""
    return n - -(-n * percent // 100)


def _sub_classes(n: int, percent: int) -> int:
    return 1 << max(0, (missing_allowed(n, percent) // 4).bit_length() - 1)


def signatures(members: np.ndarray, counts: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Index entries of a set of ``n``, of whose members ``members`` are in other classes too (``counts``)."""
    units = missing_allowed(n, percent) + 1 - (n - len(members))  # members of its own come first and match nothing
    if units <= 0 or not len(members):
        return np.zeros(0, np.uint64)
    frequent = counts >= FREQUENT
    order = np.lexsort((members, np.where(frequent, HOT, counts)))  # all frequent ones count alike: the last class
    members, frequent = members[order], frequent[order]
    rare = members[~frequent]
    out = [rare[:units]]
    units -= len(rare)
    if units > 0:
        common = members[frequent]
        for groups in {_sub_classes(k, percent) for k in range(-(-n * percent // 100), n + 1)}:
            group = (_mixed(common + _GOLDEN) % np.uint64(groups)).astype(np.int64)
            seen_before = pd.Series(group).duplicated().to_numpy()
            enough = np.searchsorted(np.cumsum(seen_before), units)
            prefix, group = common[: enough + 1], group[: enough + 1]
            by_group = np.argsort(group, kind="stable")
            prefix, group = prefix[by_group], group[by_group]
            for block in np.split(prefix, np.flatnonzero(np.diff(group)) + 1):
                i, j = np.triu_indices(len(block), 1)
                low, high = np.minimum(block[i], block[j]), np.maximum(block[i], block[j])
                out.append(_mixed(_mixed(low + np.uint64(groups)) ^ (high * _GOLDEN)))
    return np.unique(np.concatenate(out))


def _counted(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Staged rows of three kinds: (doc_id, class, n) of a document, (owner, class, n) of a class in a chunk,
    (owner, member, count) of a shared member."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * RANGE_MEMBERS)))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, closed, part = _Chunk(), 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            nonlocal chunk, closed
            out = chunk.rows(ranges, (part * 7919 + closed) % ranges, part << 16 | closed, kind)
            chunk, closed = _Chunk(), closed + 1
            return out

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch, "text")
            for doc, members in zip(ids, shingle_sets(texts, width)):
                chunk.add(doc, members)
                if chunk.members >= CHUNK_MEMBERS or len(chunk.docs) >= CHUNK_DOCS:
                    yield close()
        if chunk.docs:
            yield close()

    def add_up(table: pa.Table) -> pa.Table:
        kind = table.schema.field("docs").type.value_type
        docs_in, classes, sizes, owners = [], [], [], []
        names = ("chunk", "docs", "doc_class", "doc_n", "class", "size")
        for chunk, ids, doc_class, doc_n, cls, size in zip(*(table.column(c).to_pylist() for c in names)):
            if ids is not None:
                n = np.frombuffer(doc_n, "<u4").tolist()
                docs_in += ids
                classes += [doc_class[16 * i : 16 * i + 16] if k else None for i, k in enumerate(n)]
                owners += [None] * len(ids)
                m = np.frombuffer(size, "<u4").tolist()
                docs_in += [None] * len(m)
                classes += [cls[16 * i : 16 * i + 16] for i in range(len(m))]
                owners += [chunk << 16 | i for i in range(len(m))]
                sizes += n + m
        owner, member, times = _shared_members(table)
        rest, more = len(docs_in), len(owner)
        return pa.table({
            "doc_id": pa.concat_arrays([pa.array(docs_in, kind), pa.nulls(more, kind)]),
            "class": pa.concat_arrays([pa.array(classes, pa.binary()), pa.nulls(more, pa.binary())]),
            "n": pa.concat_arrays([pa.array(sizes, pa.int32()), pa.nulls(more, pa.int32())]),
            "owner": pa.concat_arrays([pa.array(owners, pa.int64()), pa.array(owner)]),
            "member": pa.concat_arrays([pa.nulls(rest, pa.int64()), pa.array(member)]),
            "count": pa.concat_arrays([pa.nulls(rest, pa.int64()), pa.array(times)]),
        })

    types = {"range": "int", "chunk": "long", "docs": f"array<{id_type}>"}
    runs = source.mapInArrow(count, ", ".join(f"{c} {types.get(c, 'binary')}" for c in CHUNK_COLUMNS))
    # As many partitions as ranges, so that a task's share does not grow with the input.
    rows = runs.repartition(ranges, "range").groupBy("range").applyInArrow(
        add_up, f"doc_id {id_type}, class binary, n int, owner long, member long, count long"
    )
    return stage_alone(rows, "shingles")


def _indexed(counted: DataFrame, percent: int) -> DataFrame:
    """Staged (class, n, own, members, entries) of the sets that can be similar to another."""
    sets = counted.where("owner IS NOT NULL").groupBy("owner").agg(
        F.max("class").alias("class"), F.max("n").alias("n"), F.count("member").alias("shared"),
        F.collect_list(F.when(F.col("member").isNotNull(), F.struct("member", "count"))).alias("members"),
    ).where(f"100L * shared >= {percent}L * n")
    # The chunks that hold a class hold the same members with the same counts: one of them stands for all.
    sets = sets.groupBy("class").agg(
        F.count("*").alias("copies"), F.max("n").alias("n"), F.min_by("members", "owner").alias("members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cls, copies, n, pairs in zip(*(batch.column(c).to_pylist() for c in ("class", "copies", "n", "members"))):
                members = np.array([x["member"] for x in pairs], np.uint64)
                counts = np.array([x["count"] for x in pairs], np.int64)
                members, first = np.unique(members, return_index=True)
                counts = counts[first]
                members, counts = members[counts > copies], counts[counts > copies]  # others are this class's alone
                entries = signatures(members, counts, n, percent)
                if len(entries):
                    rows.append((cls, n, n - len(members), members.tobytes(), entries.astype(np.int64)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            names = ["class", "n", "own", "members", "entries"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "class binary, n int, own int, members binary, entries array<long>"
    return stage_alone(sets.mapInArrow(run, schema), "sets")


def _may_link(common: str, percent: int) -> str:
    """With at most ``common`` members in common, sets of x.n and y.n may reach ``percent``."""
    return f"100L * {common} >= {percent}L * (x.n + y.n - {common})"


# Members of its own are in no other set.
_SHARED_AT_MOST = "least(x.n - x.own, y.n - y.own)"
# Of the typical set both hold at most the smaller part, and of the rest at most the smaller rest.
_BESIDE_TYPICAL = (
    f"coalesce(least(x.common, y.common) + least(x.n - x.own - x.common, y.n - y.own - y.common), {_SHARED_AT_MOST})"
)


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, n_a, n_b): the number of common members of the pairs (a, b) of classes."""
    a = sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("m_a"))
    b = sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("m_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [
                len(np.intersect1d(np.frombuffer(m_a, "<u8"), np.frombuffer(m_b, "<u8"), assume_unique=True))
                for m_a, m_b in zip(batch.column("m_a").to_pylist(), batch.column("m_b").to_pylist())
            ]
            columns = {c: batch.column(c) for c in ("a", "b", "n_a", "n_b")}
            yield pa.record_batch(columns | {"common": pa.array(common, pa.int32())})

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a binary, b binary, n_a int, n_b int, common int")


def similar_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) for all classes linked with another one."""
    similar = f"100L * common >= {percent}L * (n_a + n_b - common)"
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).cast("int")  # similar sizes: same or next band
    # Two sets often meet under many entries: the least that is among the first few of both speaks for all.
    few = F.slice(F.array_sort("entries"), 1, 12).alias("few")
    # If x and y link, own_x / (n_x - own_x) + own_y / (n_y - own_y) <= 100 / percent - 1: own members are
    # in the union but not common, and common members are at most the others of each. One of the two is light.
    light = 2 * percent * F.col("own").cast("double") <= (100 - percent) * (F.col("n") - F.col("own"))
    entries = sets.select("class", "n", "own", light.alias("light"), band.alias("band"), few, F.explode("entries").alias("entry"))
    entries = entries.withColumn("key", F.explode(F.array("band", F.col("band") + 1)))
    typical = stage_alone(
        entries.groupBy("entry", "key").agg(F.min(F.struct("own", "class", "n")).alias("t"), F.count("*").alias("size"))
        .where("size > 1")
        .select("entry", "key", F.col("t.class").alias("class"), F.col("t.n").alias("n"), F.col("t.own").alias("own")),
        "typical",
    )
    ends = [F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")]
    star = entries.alias("x").join(typical.alias("y"), ["entry", "key"]).where(
        f"x.class != y.class AND {_may_link(_SHARED_AT_MOST, percent)}"
    ).select(*ends).distinct()
    star = stage_alone(_common(star, sets), "star-pairs")
    links = star.where(similar).select("a", "b")
    roots = components(links)

    known = roots.select(F.col("node").alias("class"), "root")
    placed = entries.join(known, "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = placed.groupBy("entry", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    centre = typical.select("entry", "key", F.col("class").alias("centre"))
    checked = star.select("a", "b", "common")
    # The typical set itself is settled with all others of its entry.
    open_entries = placed.join(mixed.select("entry", "key"), ["entry", "key"]).join(centre, ["entry", "key"]).where(
        "class != centre"
    ).withColumns({"a": F.least("class", "centre"), "b": F.greatest("class", "centre")})
    open_entries = open_entries.join(checked, ["a", "b"], "left").select(
        "entry", "key", "class", "n", "own", "light", "band", "root", "common", "few"
    )
    open_entries = stage_alone(open_entries, "open-entries")
    across = open_entries.where("light").alias("x").join(open_entries.alias("y"), ["entry", "key"]).where(
        f"(NOT y.light OR x.class < y.class) AND x.root != y.root AND key = greatest(x.band, y.band)"
        f" AND {_may_link(_SHARED_AT_MOST, percent)} AND {_may_link(_BESIDE_TYPICAL, percent)}"
        f" AND entry = coalesce(array_min(array_intersect(x.few, y.few)), entry)"
    ).select(*ends).distinct()
    across = across.join(checked, ["a", "b"], "left_anti")
    late = stage_alone(_common(across, sets).where(similar).select("a", "b"), "late-links")
    if late.limit(1).count() == 0:
        return roots
    return components(links.unionAll(late))


def _known(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("class"), "root")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id) of every row: links hold where 100 * common >= percent * union."""
    counted = _counted(docs, id_col, text_col, width)
    members = counted.where("owner IS NULL").select("doc_id", "class", "n")
    sets = _indexed(counted, percent)
    roots = similar_classes(sets, percent)
    # One text, or one component, may hold a third of all rows: ``attach`` does not deal rows by such a key.
    copies = members.where("class IS NOT NULL").groupBy("class").agg(F.count("n").alias("rows"), F.min("doc_id").alias("least"))
    classes = copies.join(_known(roots), "class", "left").withColumn("root", F.coalesce("root", "class"))
    components_of = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("class").alias("classes"))
    classes = attach(stage_alone(classes, "classes"), stage_alone(components_of, "components"), ["root"], "classes")
    placed = attach(members, stage_alone(classes.select("class", "rows", "component_id"), "placed"), ["class"], "rows", how="left")
    return placed.select(
        F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
