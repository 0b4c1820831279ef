"""Line deduplication across documents, in built-in expressions only.

Lines become 128-bit hashes, range-partitioned with a secondary sort by document and
position, so the first document that holds a line streams past first.  The outcome is a
compressed bitmap of the lines to drop per document, never the text.

A line that a third of all documents repeat must not meet in one task, so the range key
carries a salt drawn from the document: each (hash, salt) group finds its own first
document, which settles every later document of that group, and only the first documents,
at most ``salts`` per line, are compared in a second, small shuffle.

Defined results: null or empty text is one empty line; NULL ids count as one document that
sorts last; rows with equal id are one document and keep the line in each of them; equal
rows give equal results; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.shared import ASCII_SPACE, ascii_lower

WORD = 63  # lines per bitmap word; a signed long without its sign


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(id_col: str, text_col: str) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def drop_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, salts: int = 256
) -> DataFrame:
    """(id, row, drops) for documents that lose a line; ``drops`` maps a word number to the lines it drops."""
    key = ascii_lower(F.btrim(F.col("_line"), F.lit(ASCII_SPACE)))
    lines = (
        docs.select(
            F.col(id_col).alias("_doc"), _row(id_col, text_col).alias("_row"),
            F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"),
        )
        .select("_doc", "_row", "_pos", key.alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select(
            F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(41), "_key").alias("_h2"),
            F.pmod(F.xxhash64("_doc"), F.lit(salts)).cast("int").alias("_salt"), "_doc", "_row", "_pos",
        )
    )
    # The window needs the groups together, which the range partitioning already gives: no further shuffle.
    streamed = Window.partitionBy("_h1", "_h2", "_salt").orderBy(F.col("_doc").asc_nulls_last(), "_pos")
    local = lines.repartitionByRange("_h1", "_salt").withColumn("_first", F.first("_doc").over(streamed))
    later = local.where(~F.col("_doc").eqNullSafe(F.col("_first")))
    firsts = (
        local.where(F.col("_doc").eqNullSafe(F.col("_first")))
        .withColumn("_first", F.min("_doc").over(Window.partitionBy("_h1", "_h2")))
        .where(~F.col("_doc").eqNullSafe(F.col("_first")))
    )
    dropped = later.select("_doc", "_row", "_pos").unionAll(firsts.select("_doc", "_row", "_pos"))
    words = dropped.groupBy("_doc", "_row", (F.col("_pos") / WORD).cast("int").alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, _pos % {WORD})")).alias("_bits")
    )
    return words.groupBy("_doc", "_row").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("drops")
    ).select(F.col("_doc").alias(id_col), F.col("_row").alias("row"), "drops")


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the dropped lines cut from the text, plus ``n_lines`` (before) and ``n_dropped``."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    marks = bitmaps.select(
        F.col(id_col).alias("_ld_doc"), F.col("row").alias("_ld_row"), F.col("drops").alias("_ld_drops")
    )
    joined = docs.select(*own, _row(id_col, text_col).alias("_ld_own")).join(
        marks, (F.col("_ld_own") == F.col("_ld_row")) & F.col(id_col).eqNullSafe(F.col("_ld_doc")), "left"
    )
    lines = _lines(F.col(text_col))
    kept = F.expr(f"""
        flatten(transform(sequence(0, (size(_ld_lines) - 1) div {WORD}), w -> if(_ld_drops[w] is null,
            slice(_ld_lines, w * {WORD} + 1, {WORD}),
            filter(slice(_ld_lines, w * {WORD} + 1, {WORD}), (x, i) -> (shiftright(_ld_drops[w], i) & 1L) = 0L))))
    """)
    text = F.when(F.col("_ld_drops").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n_dropped = F.expr("coalesce(aggregate(map_values(_ld_drops), 0L, (n, b) -> n + bit_count(b)), 0L)")
    return joined.withColumn("_ld_lines", lines).select(
        *[text.alias(c) if c == text_col else F.col(c) for c in own],
        F.size("_ld_lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"),
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, salts: int = 256
) -> DataFrame:
    return apply_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, min_chars, salts), id_col, text_col)
