"""Source files from a file tree."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from flawsieve.functions.paths import in_scope, plain_path
from flawsieve.operators.lines import with_language
from flawsieve.operators.match import FILE_MARKER, match_rules
from flawsieve.plans.scan import scan_log
from flawsieve.rules import EXTENSION_LANGUAGE, Rule, load_rules
from flawsieve.sources.tree import list_tree, plain_root, qualified, read_listed, read_listed_lines

# Fixed value: the exclusions a workspace starts with.
DEFAULT_EXCLUDES = ("**/test/**", "**/tests/**", "**/__pycache__/**")

# Files above this size are read line by line, in splits, rather than whole.
WHOLE_FILE_BYTES = 64 * 1024 * 1024


def _any_case(ch: str) -> str:
    return f"[{ch}{ch.upper()}]" if ch.isalpha() else ch


# Unlike a filter on the path, a glob keeps files of other kinds from being read.
SUPPORTED_GLOB = "*{" + ",".join("".join(map(_any_case, e)) for e in EXTENSION_LANGUAGE) + "}"


def supported_files(files: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """The distinct paths in scope of any table with a ``path``."""
    return files.select("path").filter(in_scope("path", exclude)).distinct()


def _reader(spark: SparkSession):
    """Files that cannot be read are left out, or end early; nothing fails for them."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", SUPPORTED_GLOB)
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
    )


def _passed_over(spark: SparkSession, root: str, exclude: Iterable[str]) -> DataFrame:
    """The listing of the files in scope that Spark's readers leave out: those that its own listing lacks."""
    listed = list_tree(spark, root, exclude).filter(in_scope("relative", exclude))
    spark_lists = _reader(spark).format("binaryFile").load(root).selectExpr(f"{plain_path('_metadata.file_path')} AS path")
    return listed.join(spark_lists, "path", "left_anti")


def list_files(spark: SparkSession, root: str, exclude: Iterable[str] = DEFAULT_EXCLUDES) -> DataFrame:
    """``path, length`` of the files in scope below ``root``; contents stay unread."""
    return list_tree(spark, root, exclude).filter(in_scope("relative", exclude)).drop("relative")


def read_files(
    spark: SparkSession,
    root: str,
    exclude: Iterable[str] = DEFAULT_EXCLUDES,
    up_to_bytes: int = WHOLE_FILE_BYTES,
    passed_over: DataFrame | None = None,
) -> DataFrame:
    """``path, content`` of the files in scope that are not above ``up_to_bytes``."""
    root = qualified(spark, root)
    if passed_over is None:
        passed_over = _passed_over(spark, root, exclude)
    ordinary = (
        _reader(spark)
        .format("binaryFile")
        .load(root)
        .filter(F.col("length") <= up_to_bytes)
        .selectExpr(f"{plain_path('_metadata.file_path')} AS path", "content")
        .filter(in_scope("path", exclude, plain_root(root)))
    )
    others = passed_over.filter(F.col("length") <= up_to_bytes)
    return ordinary.unionByName(read_listed(others, root))


def _large_file_lines(
    spark: SparkSession, root: str, exclude: Iterable[str], above_bytes: int, passed_over: DataFrame | None = None
) -> DataFrame:
    """Every line of the large files, as ``match_rules`` takes them.

    ``_block`` is the byte of the file at which the line's split starts.  Within
    a split ``_id`` rises by one from line to line.  The number of the line is
    not known yet.
    """
    lines = (
        _reader(spark)
        .option("lineSep", "\n")
        .format("text")
        .load(root)
        .filter(f"_metadata.file_size > {above_bytes}")
        .selectExpr(
            "value AS raw",
            "_metadata.file_path AS _file",
            "_metadata.file_size AS _size",
            "_metadata.file_block_start AS _block",
        )
        .filter(in_scope(plain_path("_file"), exclude, plain_root(root)))
    )
    if passed_over is None:
        passed_over = _passed_over(spark, root, exclude)
    others = read_listed_lines(passed_over.filter(F.col("length") > above_bytes), root)
    # Escaping leaves the supported extensions as they are, so the language can
    # be told from the URI, and the URI be resolved for findings only. Nothing is
    # pushed below the running number, so a filter sees columns, not what makes them.
    ready = [
        with_language(part, "_file").selectExpr("*", "monotonically_increasing_id() AS _id", "0 AS line", "false AS latin1")
        for part in (lines, others)
    ]
    return ready[0].unionByName(ready[1])


def _split_offsets(lines: DataFrame) -> DataFrame:
    """One row per split: the lines before it, its first ``_id``, facts of its file.

    The reader hides a byte order mark, and the empty line after a final line
    feed.  Both show in how the file's size compares with that of its lines,
    counting a line feed for each: 3 more with a mark, 1 less without the feed.
    Any other difference means that the file was not read to its end.  Such a
    file has no rows here, so neither findings nor a marker come of it.
    """
    splits = lines.groupBy("_file", "_block", "_size").agg(
        F.count("*").alias("_n"),
        F.min("_id").alias("_first"),
        F.sum(F.octet_length("raw") + 1).alias("_bytes"),
    )
    file = "OVER (PARTITION BY _file)"
    in_order = "OVER (PARTITION BY _file ORDER BY _block"
    unseen = f"_size - sum(_bytes) {file}"
    numbered = splits.selectExpr(
        "_file",
        "_block",
        "_first",
        f"coalesce(sum(_n) {in_order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before",
        f"sum(_n) {file} + if({unseen} IN (0, 3), 1, 0) AS n_lines",
        f"{unseen} >= 2 AS _has_mark",
        f"row_number() {in_order}) = 1 AS _opens",
        f"{unseen} IN (-1, 0, 2, 3) AS _whole",
    )
    return numbered.filter("_whole").drop("_whole")


def _scan_large_files(
    spark: SparkSession,
    root: str,
    exclude: Iterable[str],
    above_bytes: int,
    rules: Sequence[Rule],
    passed_over: DataFrame | None = None,
) -> DataFrame:
    """The log of files too large to be a row, read as splits of lines.

    A line's number is the number of lines in earlier splits of its file plus
    its place in its own.  Only the few lines that may match are shuffled to
    meet that table of splits, and matched where they arrive.
    """
    lines = _large_file_lines(spark, root, exclude, above_bytes, passed_over)
    offsets = _split_offsets(lines)
    split = ("_file", "_block")
    found = match_rules(lines, rules, (*split, "_id"), flag_comments=True, spread_by=split).drop("line")
    path = f"{plain_path('_file')} AS path"
    # A first line behind a byte order mark does not start with its "#".
    numbered = (
        found.join(offsets.hint("merge"), list(split))
        .selectExpr("* EXCEPT (n_lines)", "int(_before + _id - _first + 1) AS line")
        .filter("NOT in_comment OR line = 1 AND _has_mark")
        .selectExpr(
            path, "language", "line", "rule_ord", "issue", "severity", "confidence", "CAST(NULL AS BIGINT) AS n_lines"
        )
    )
    markers = with_language(offsets.filter("_opens"), "_file").selectExpr(
        path,
        "language",
        "0 AS line",
        f"{FILE_MARKER} AS rule_ord",
        "CAST(NULL AS STRING) AS issue",
        "CAST(NULL AS STRING) AS severity",
        "CAST(NULL AS STRING) AS confidence",
        "n_lines",
    )
    return numbered.unionByName(markers)


def scan_path(
    spark: SparkSession,
    root: str,
    exclude: Iterable[str] = DEFAULT_EXCLUDES,
    rules: DataFrame | Iterable[Rule] | None = None,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """The scan log of all files in scope below ``root``, whatever their size."""
    rules = load_rules(rules)
    exclude = tuple(exclude)
    root = qualified(spark, root)
    passed_over = _passed_over(spark, root, exclude)
    small = scan_log(read_files(spark, root, exclude, whole_file_bytes, passed_over), rules=rules)
    return small.unionByName(_scan_large_files(spark, root, exclude, whole_file_bytes, rules, passed_over))


def unread_files(listing: DataFrame, log: DataFrame) -> DataFrame:
    """``path, reason``: files of a listing that left no marker in the log."""
    scanned = log.filter(F.col("rule_ord") == FILE_MARKER).select("path")
    return listing.select("path").join(scanned, "path", "left_anti").withColumn("reason", F.lit("unreadable"))
