"""Exact dedup by owners in Patricia tries.

Texts are normalised to bytes and meet by the partition of their length and content hash.
There each is inserted, whole, into a compressed radix trie; equality is decided by the
trie alone, byte by byte, never by the hash.  The terminal of a text holds its owner (the
row with the smallest identifier, or the largest with ``keep="last"``) and its row count.

1. Each map task runs its rows through a trie of its own, so that a text however frequent
   leaves a task once, with its local owner and count.  Copies are left as (row, first row).
2. Distinct texts of the tasks are dealt by (length, hash) and streamed into the trie of
   their partition.  The trie never outgrows ``memory_bytes``: beyond, its largest subtree is
   spilled; its strings, and those that lead there later, come out as they were and go, dealt
   anew by that subtree, through the next round.  A round settles at least one text a task.
3. Copies look up the settled row of their task's first.

Defined results: null text is the empty text; NULL identifiers give way to all others; rows
that tie for the owner (equal text and identifier) keep one, the first read; an empty table
gives none.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import bounded_batches
from plinth.staging import stage

MEMORY_BYTES = 128 << 20  # of strings in a trie
PARTITION_BYTES = 32 << 20  # of strings dealt to a task
_NODE_BYTES = 400  # of a node beside its label

_TEXTS = (
    "row long, first long, doc_id long, length long, hash long, text binary, digest binary, "
    "owner_id long, owner_row long, size long, subtree long"
)
_TEXT_SCHEMA = pa.schema([
    (n, pa.binary() if n in ("text", "digest") else pa.int64())
    for n in ("row", "first", "doc_id", "length", "hash", "text", "digest", "owner_id", "owner_row", "size", "subtree")
])
_SETTLED = "kind string, " + _TEXTS
_SETTLED_SCHEMA = pa.schema([("kind", pa.string()), *_TEXT_SCHEMA])


class _Node:
    __slots__ = ("label", "children", "terminal", "spilled")

    def __init__(self, label: bytes, terminal=None) -> None:
        self.label, self.terminal = label, terminal
        self.children: dict[int, _Node] = {}
        self.spilled = None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    most = min(len(a), len(b) - at)
    if a[:most] == b[at:at + most]:
        return most
    low, high = 0, most  # the first difference lies in between
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[at + low:at + middle]:
            low = middle
        else:
            high = middle
    return low


class PatriciaTrie:
    """Byte strings with what the terminal of each holds; edges carry all bytes without a branch."""

    def __init__(self) -> None:
        self.root = _Node(b"")
        self.bytes = 0
        self.strings = 0

    def slot(self, key: bytes, new: Callable[[], object]):
        """(terminal of ``key``, None), made by ``new`` if there is none, or (None, subtree) where that is spilled."""
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                return None, node.spilled
            if at == len(key):
                if node.terminal is None:
                    node.terminal = new()
                    self.strings += 1
                return node.terminal, None
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:], new())
                self.bytes += len(child.label) + _NODE_BYTES
                self.strings += 1
                return child.terminal, None
            shared = _common(child.label, key, at)
            if shared < len(child.label):
                upper = _Node(child.label[:shared])
                child.label = child.label[shared:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = child = upper
                self.bytes += _NODE_BYTES
            node, at = child, at + shared

    def _below(self, top: _Node, path: bytes) -> Iterator[tuple[bytes, _Node]]:
        pending = [(path, top)]
        while pending:
            path, node = pending.pop()
            path += node.label
            yield path, node
            pending.extend((path, c) for c in node.children.values())

    def terminals(self) -> Iterator[tuple[bytes, object]]:
        for path, node in self._below(self.root, b""):
            if node.terminal is not None:
                yield path, node.terminal

    def spill(self) -> tuple[int, list[tuple[bytes, object]]]:
        """Cut off the largest subtree below the first branch; (its number, its strings and terminals).

        Of two strings or more one stays.
        """
        path, node = b"", self.root
        while True:
            path += node.label
            held = [c for c in node.children.values() if c.spilled is None]
            if len(held) != 1 or node.terminal is not None:
                break
            node = held[0]

        def weight(child: _Node) -> int:
            return sum(len(n.label) + _NODE_BYTES for _, n in self._below(child, b""))

        top = max(held, key=weight)
        self.bytes -= weight(top)
        cut = [(p, n.terminal) for p, n in self._below(top, path) if n.terminal is not None]
        prefix = path + top.label
        top.spilled = int.from_bytes(hashlib.sha256(prefix).digest()[:8], "little", signed=True)
        top.children, top.terminal = {}, None
        self.strings -= len(cut)
        self.bytes += len(top.label) + _NODE_BYTES
        return top.spilled, cut


def _better(a: tuple, b: tuple, last: bool) -> tuple:
    """The owner of two (identifier, row): NULL gives way, ties go to the first row."""
    if a[0] is None or b[0] is None:
        return b if a[0] is None and b[0] is not None else a if b[0] is None and a[0] is not None else min(a, b, key=lambda o: o[1])
    if a[0] == b[0]:
        return min(a, b)
    return max(a, b) if last else min(a, b)


def _local(last: bool, memory_bytes: int):
    """Rows of a task to distinct texts with local owners, and copies that point at them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        trie, out = PatriciaTrie(), []

        def flush() -> pa.RecordBatch:
            rows = []
            for text, found in trie.terminals():
                digest = hashlib.sha256(text).digest()
                owner, size, row, doc_id = found
                rows.append((row, None, doc_id, len(text), int.from_bytes(digest[:8], "little", signed=True), text,
                             digest, *owner, size, 0))
            rows += [(row, first, doc_id) + (None,) * 8 for row, first, doc_id in out]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _TEXT_SCHEMA.types)], schema=_TEXT_SCHEMA
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = number
                number += 1
                found, _ = trie.slot((text or b"").lower(), lambda: [None, 0, row, doc_id])
                found[1] += 1
                found[0] = (doc_id, row) if found[0] is None else _better(found[0], (doc_id, row), last)
                if found[2] != row:
                    out.append((row, found[2], doc_id))
                if trie.bytes > memory_bytes // 4 or len(out) >= 200_000:
                    yield flush()
                    trie, out = PatriciaTrie(), []
        if trie.strings:
            yield flush()

    return run


def _owners(last: bool, memory_bytes: int):
    """Distinct texts of the tasks to owners; what a spilled subtree takes comes out as it went in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _SETTLED_SCHEMA.types)], schema=_SETTLED_SCHEMA
            )

        def spilled(subtree: int, text: bytes, members: list) -> list[tuple]:
            digest, length, code = members[0]
            return [
                ("spilled", row, None, doc_id, length, code, text, digest, owner_id, owner_row, size, subtree)
                for row, doc_id, owner_id, owner_row, size in members[1:]
            ]

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (
                "row", "doc_id", "length", "hash", "text", "digest", "owner_id", "owner_row", "size")]
            out = []
            for row, doc_id, length, code, text, digest, owner_id, owner_row, size in zip(*columns):
                found, subtree = trie.slot(text, lambda: [(digest, length, code)])
                member = (row, doc_id, owner_id, owner_row, size)
                if found is None:
                    out += spilled(subtree, text, [(digest, length, code), member])
                else:
                    found.append(member)
                while trie.bytes > memory_bytes and trie.strings > 1:
                    subtree, cut = trie.spill()
                    for string, members in cut:
                        out += spilled(subtree, string, members)
                        if sum(len(o[6]) for o in out[-64:]) + len(out) > 1 << 20 or len(out) >= 2000:
                            yield table(out)
                            out = []
            if out:
                yield table(out)
        rows = []
        for _, members in trie.terminals():
            digest = members[0][0]
            owner = members[1][2:4]
            for m in members[2:]:
                owner = _better(owner, m[2:4], last)
            size = sum(m[4] for m in members[1:])
            for row, doc_id, *_ in members[1:]:
                rows.append(("settled", row, None, doc_id, None, None, None, digest, *owner, size, None))
            if len(rows) >= 10_000:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    return run


def dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "first",
    memory_bytes: int = MEMORY_BYTES, partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row: the owner of its text, and whether it is that.

    Texts are equal if they are after lower-casing A-Z. ``keep`` is ``first`` (smallest
    identifier) or ``last``; ``digest`` is the SHA-256 of the normalised text.
    """
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first or last, not {keep}")
    spark, last = docs.sparkSession, keep == "last"
    bounded_batches(spark)
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    local = stage(narrow.mapInArrow(_local(last, memory_bytes), _TEXTS), "local-owners")
    texts, settled = local.where("text IS NOT NULL"), None
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        held = texts.agg(F.sum(F.col("length")), F.count("row")).first()
        if not held[1] and settled is not None:
            break
        tasks = max(width, -(-(held[0] or 0) // partition_bytes))
        dealt = texts.repartition(tasks, "subtree", "length", "hash")
        done = stage(dealt.mapInArrow(_owners(last, memory_bytes), _SETTLED), "owners")
        part = done.where("kind = 'settled'").select("row", "doc_id", "digest", "owner_id", "owner_row", "size")
        settled = part if settled is None else settled.unionAll(part)
        texts = done.where("kind = 'spilled'").drop("kind")
        if not held[1]:
            break
    copies = local.where("text IS NULL").select("row", F.col("first").alias("of"), "doc_id")
    owners = settled.select(F.col("row").alias("of"), "digest", "owner_id", "owner_row", "size")
    looked_up = copies.join(owners, "of").select("row", "doc_id", "digest", "owner_id", "owner_row", "size")
    return settled.unionAll(looked_up).select(
        "doc_id", F.col("owner_id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("owner_row")).alias("kept"), "digest",
    )
