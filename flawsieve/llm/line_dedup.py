"""Line dedup: which lines of which documents to keep, as bitmaps instead of text.

Lines are hashed. A first aggregation, spread over salts, leaves at most
``SALTS`` rows for a hash however many documents hold it. Those rows are
range-partitioned by hash and sorted by hash, document and place, so that the
first occurrence of each line and its number of documents come from one pass
over sorted rows. The lines that go are then found by a join on the hash
(a hot hash splits under adaptive execution) and gathered as sparse bitmaps:
words of 64 lines, of which only those with a dropped line are there.

A null or empty text is one empty line. Keys shorter than ``min_chars`` are
never dropped. Rows of one id are one document when documents are counted, and
rows without id are none; all lose their lines alike. Columns of the input that have
one of the names in ``OWN_NAMES`` are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flawsieve.llm.shared import ascii_lower, let, staged, without

SALTS = 32
OWN_NAMES = ("n_lines", "n_dropped", "kept_text", "_mark", "_id", "_to", "_dropped", "_lines")
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _hashes(text: Column, min_chars: int) -> Column:
    """A hash for each line, null where the key is too short to be dropped."""

    def of(line):
        key = key_of(line)
        return F.when(F.char_length(key) >= min_chars, F.xxhash64(key))

    return F.transform(lines_of(text), of)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, mark, hash, line)`` of every line with a hash; ``mark`` tells texts of one id apart."""
    own = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(_hashes(F.col("text"), min_chars)).alias("line", "hash"))
    return own.filter("hash IS NOT NULL")


def _first_in_document(text: Column, min_chars: int) -> Column:
    """``(hash, line)`` of each distinct line of a text, where it comes first."""
    places = F.transform(_hashes(text, min_chars), lambda x, i: F.struct(x.alias("hash"), i.alias("line")))
    ordered = F.array_sort(F.filter(places, lambda p: p["hash"].isNotNull()))
    return let(ordered, lambda p: F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["hash"] != x["hash"], F.lit(True))))


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """``(hash, first, n_rows)``: each line once, ``first (doc_id, line)`` where it comes first, and the rows that have it."""
    rows = docs.select("doc_id", F.explode(_first_in_document(F.col("text"), min_chars)).alias("p"))
    rows = rows.select("p.hash", F.struct("doc_id", "p.line").alias("first"))
    salted = rows.groupBy("hash", F.pmod(F.xxhash64("first.doc_id"), F.lit(SALTS)).alias("salt"))
    few = salted.agg(F.count("*").alias("n"), F.min("first").alias("first")).drop("salt")
    spread = few.repartitionByRange("hash").sortWithinPartitions("hash", "first")
    own = Window.partitionBy("hash").orderBy("first")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = spread.withColumns({"n_rows": F.sum("n").over(every), "nth": F.row_number().over(own)})
    return seen.filter("nth = 1").select("hash", "first", "n_rows")


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``(doc_id, mark, dropped)`` of documents with a line found in ``min_docs`` documents or more.

    ``dropped`` is an array of ``(word, bits)``: bit ``b`` of word ``w`` stands for line ``64 w + b``.
    """
    frequent = line_counts(docs, min_chars).filter(F.col("n_rows") >= min_docs).select("hash")
    found = staged(_occurrences(docs, min_chars).join(frequent, "hash", "left_semi"), "frequent-lines")
    # A line of so many rows may be one of fewer documents: rows can share an id.
    holders = found.filter("doc_id IS NOT NULL").groupBy("hash", "doc_id").agg(F.lit(1).alias("one"))
    often = holders.groupBy("hash").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    gone = found.join(often.select("hash"), "hash", "left_semi")
    bit = F.expr("shiftleft(1L, line % 64)")
    words = gone.groupBy("doc_id", "mark", F.expr("CAST(line div 64 AS INT)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("word", "bits")).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``."""
    docs = without(docs, *OWN_NAMES)
    own = docs.withColumn("_mark", F.xxhash64("text"))
    to = bitmaps.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_to"), F.col("dropped").alias("_dropped"))
    joined = own.join(to, (F.col("_mark") == F.col("_to")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    lines = lines_of(F.col("text"))

    def kept(x):
        bits = F.map_from_entries("_dropped")
        dense = F.transform(F.sequence(F.lit(0), F.expr("CAST((size(_lines) - 1) div 64 AS INT)")), lambda w: F.coalesce(F.try_element_at(bits, w), F.lit(0).cast("long")))
        bit = lambda d, i: F.call_function("getbit", F.get(d, (i / 64).cast("int")), F.pmod(i, F.lit(64)))
        return let(dense, lambda d: F.array_join(F.filter(x, lambda line, i: bit(d, i) == 0), "\n"))

    n_dropped = F.aggregate(F.coalesce("_dropped", F.array().cast("array<struct<word:int,bits:bigint>>")), F.lit(0), lambda a, d: a + F.bit_count(d["bits"]))
    lined = joined.withColumn("_lines", lines)
    text = F.when(F.col("_dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept(F.col("_lines")))
    return lined.select(
        *docs.columns, F.size("_lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), text.alias("kept_text")
    )


def op10_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = apply_bitmaps(docs, drop_bitmaps(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
