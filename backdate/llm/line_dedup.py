"""Dropping lines that many documents share, by keep bitmaps. Column expressions only.

Line keys become 128-bit hashes, range-partitioned by hash and sorted by
descending document and position within it, so that a window reads each key's
occurrences as a stream: the first document in it keeps the line, and when the
key turns out to stand in enough documents all later ones lose it. What leaves
this is no text but a bitmap per document, in words of 64 lines, without the words
in which every line stays.

A key that very many lines have would fill one task. Such keys are at most
``heavy.MOST``, so their totals (documents, largest id), aggregated before the
shuffle, are broadcast and their occurrences decided where they are; only the
other keys, of bounded size, are range-partitioned.

Defined results: documents are told apart by id; rows that share one are one
document when holders are counted and each lose or keep its lines; NULL is an id
of its own, smaller than all others. A NULL or empty text is one empty line.
White space is space and 9 to 13; only A-Z are lower-cased. A text that loses all
its lines is empty. Key hashes have 128 bits, taken as free of collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backdate.llm.common import stored
from backdate.llm.heavy import heavy_keys, text_key

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h1", "h2"]
ROW = ["doc_id", "t1", "t2"]
WORD = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() of a line of ASCII only changes A-Z and is much faster.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def line_occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``h1, h2, doc_id, t1, t2, pos`` of every line whose key is long enough; t1 and t2 tell texts of one id apart."""
    t1, t2 = text_key(F.col("text"))
    lines = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    long = lines.where(F.octet_length("line") >= least_chars).select(*ROW, "pos", line_key(F.col("line")).alias("key"))
    h1, h2 = text_key(F.col("key"))
    return long.where(F.length("key") >= least_chars).select(h1.alias("h1"), h2.alias("h2"), *ROW, "pos")


def _streamed(occurrences: DataFrame, least_documents: int) -> DataFrame:
    """Lines to drop, by the stream of each key's occurrences in one range-partitioned sort."""
    dealt = occurrences.repartitionByRange(*KEY)
    stream = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("doc_id"), "t1", "t2", "pos")
    marked = dealt.select(
        "*",
        F.row_number().over(stream).alias("nth"),
        F.lag("doc_id").over(stream).alias("before"),
        F.first("doc_id").over(stream).alias("keeper"),
    )
    fresh = F.when((F.col("nth") == 1) | ~F.col("doc_id").eqNullSafe(F.col("before")), 1).otherwise(0)
    counted = marked.withColumn("documents", F.sum(fresh).over(Window.partitionBy(*KEY)))
    gone = (F.col("documents") >= least_documents) & ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    return counted.where(gone).select(*ROW, "pos")


def _decided_in_place(occurrences: DataFrame, heavy: DataFrame, least_documents: int) -> DataFrame:
    """Lines to drop of the heavy keys, which need no sort: their totals meet the occurrences by broadcast."""
    own = occurrences.join(F.broadcast(heavy), KEY)
    holders = own.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
    totals = holders.groupBy(*KEY).agg(F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper"))
    frequent = totals.where(F.col("documents") >= least_documents).select(*KEY, "keeper")
    met = occurrences.join(F.broadcast(frequent), KEY)
    return met.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select(*ROW, "pos")


def keep_bitmaps(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """``doc_id, t1, t2, n_dropped, keep`` of each document that loses lines.

    ``keep`` is an ascending array of (word, bits): bit j of a word is 1 if line
    64 * word + j stays. Words that are absent, and lines past the last, stay.
    """
    found = stored(line_occurrences(docs.select("doc_id", "text"), least_chars))
    heavy, _ = heavy_keys(found, KEY)
    heavy = stored(heavy)
    light = found.join(F.broadcast(heavy), KEY, "left_anti")
    drops = _streamed(light, least_documents).unionByName(_decided_in_place(found, heavy, least_documents))
    by_row = drops.repartition(*ROW)  # both groupings below read this one exchange
    # Lines of repeated rows come once each; the same bit twice is one bit.
    bit = F.expr(f"shiftleft(1L, CAST(pos % {WORD} AS INT))")
    words = by_row.groupBy(*ROW, F.expr(f"CAST(pos DIV {WORD} AS INT)").alias("word")).agg(F.bit_or(bit).alias("gone"))
    return words.groupBy(*ROW).agg(
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
    )


def _dense(keep: str) -> Column:
    """The bitmap as plain words up to its last one, absent ones filled with ones."""
    filled = F.expr(f"""transform({keep}, (w, i) -> concat(
        array_repeat(-1L, CASE WHEN i = 0 THEN w.word ELSE w.word - {keep}[i - 1].word - 1 END), array(w.bits)))""")
    return F.flatten(filled)


def kept_lines(lines: str, words: str) -> Column:
    """The lines whose bit is 1 in the dense words; without words all of them."""
    return F.expr(f"""CASE WHEN {words} IS NULL THEN {lines} ELSE filter({lines}, (line, i) ->
        (shiftright(coalesce(get({words}, CAST(i DIV {WORD} AS INT)), -1L), i % {WORD}) & 1L) = 1L) END""")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All rows of ``docs`` (as struct ``row``) with ``lines``, ``kept`` (arrays of lines) and ``n_dropped``."""
    t1, t2 = text_key(F.col("text"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("l_id"), t1.alias("l1"), t2.alias("l2"),
    )
    same = F.col("l_id").eqNullSafe(F.col("doc_id")) & (F.col("l1") == F.col("t1")) & (F.col("l2") == F.col("t2"))
    met = rows.join(bitmaps, same, "left_outer").select(
        "row", lines_of(F.col("row.text")).alias("lines"), _dense("keep").alias("words"), "n_dropped"
    )
    return met.select(
        "row", "lines", kept_lines("lines", "words").alias("kept"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped")
    )


def without_shared_lines(docs: DataFrame, **options: int) -> DataFrame:
    """The documents with their columns; the text is the lines that stay (a NULL text that loses nothing stays NULL)."""
    applied = apply_bitmaps(docs, keep_bitmaps(docs, **options))
    text = F.when(F.col("n_dropped") == 0, F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    return applied.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, **options: int) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row."""
    rows = docs.select("doc_id", "text")
    applied = apply_bitmaps(rows, keep_bitmaps(rows, **options))
    return applied.select(
        "row.doc_id", F.size("lines").cast("long").alias("n_lines"), "n_dropped",
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )
