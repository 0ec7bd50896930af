"""Tables that a job writes and reads again, and columns that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from flawsieve.sources.folders import delete_folders, shared_folder

# Java's and Python's patterns alike: the white space that ends a word.
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read again: lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Deletes the staged table that ``df`` reads, which nothing reads any more."""
    spark = df.sparkSession
    names = {path.rsplit("/", 2)[1] for path in df.inputFiles()}
    delete_folders(spark, [f"{shared_folder(spark)}/{name}" for name in names])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without the columns that clash, in any case, with ``names`` that an operator adds or works with."""
    taken = {name.lower() for name in names}
    return docs.select(*(docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken))
