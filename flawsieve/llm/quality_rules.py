"""Quality rules: a ratio of two hashed n-gram models, after counts that any text must pass.

Words and pairs of words are hashed into a fixed number of buckets. Two
multinomials over the buckets are counted, one over all documents and one over
trusted documents, whose prior is the former. A document's score is the mean
logarithm of their ratio over its n-grams, with its own n-grams taken out of both
models, so that a document that was learned from has no advantage. The threshold
is the score below which a small share of the trusted documents fall. Everything is
a count, so the verdict depends on nothing but the tables.

Null and empty texts have no words and fail the base rules. Repeated rows are
judged alike, each counts in the models, and one is taken out. Without another
trusted document a score is 0, and without trusted documents that pass the base
rules there is no threshold: whatever passes them is kept. Columns of the input that
have one of the names in ``OWN_NAMES`` are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from flawsieve.llm.shared import let, staged, without, words_of

BUCKETS = 1 << 17
# Added to each bucket of the raw model.
SMOOTHING = 0.5
# Weight of the raw model as the prior of the trusted one, of the trusted n-grams' number.
PRIOR = 0.1
# Of the trusted documents, what the threshold may turn down; it is told in steps of 1 / STEPS.
SHARE = 0.01
STEPS = 1000
WINDOW = 8
OWN_NAMES = ("_good", "_model", "_of_words", "_limit", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
SYMBOLS = "[#*$%&|<>]"
NO_BLANK = r"[^\x20\x09-\x0D]"


def _hashes(text: Column) -> Column:
    return _hashed(words_of(text))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _joined(width: int):
    """Makes of hashes of ``width`` neighbours those of twice as many, one for each place where these end in the text."""

    def of(h):
        n = F.greatest(F.size(h) - width, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(h, width + 1, n), lambda a, b: F.xxhash64(a, b))

    return of


def _buckets(h: Column, buckets: int) -> Column:
    """Of the words, then of the pairs of neighbours, of the words' hashes."""
    words = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    after = F.slice(h, 2, F.greatest(F.size(h), F.lit(1)))
    pairs = F.zip_with(h, after, lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(words, F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0))))


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``docs (doc_id, ...)`` with ``_good``: 1 for the documents in ``trusted (doc_id)``, else 0."""
    marks = trusted.select("doc_id").distinct().withColumn("_good", F.lit(1))
    # Always by a shuffle: neither side has a bound.
    return docs.join(marks.hint("merge"), "doc_id", "left").select(
        *(docs[f"`{c}`"] for c in docs.columns), F.coalesce("_good", F.lit(0)).alias("_good")
    )


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row ``(model)`` of ``docs (text, _good)``: the n-grams of each bucket and in all, ``n`` and
    ``total`` of all documents, ``good`` and ``good_total`` of the trusted ones; and the trusted share of each
    bucket without one n-gram of a trusted document, ``less_good``, or of another one, ``less``."""
    grams = docs.select(F.explode(let(_hashes(F.col("text")), lambda h: _buckets(h, buckets))).alias("bucket"), "_good")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("_good").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    every = every.join(counts, "bucket", "left").na.fill(0, ["n", "good"])
    rows = F.array_sort(F.collect_list(F.struct("bucket", "n", "good")))
    summed = every.agg(rows.alias("rows"), F.sum("n").alias("total"), F.sum("good").alias("good_total"))
    rest = lambda r: r["n"] - 1 + SMOOTHING
    return summed.select(F.struct(
        F.transform("rows", lambda r: r["n"]).alias("n"), F.transform("rows", lambda r: r["good"]).alias("good"), "total", "good_total",
        F.transform("rows", lambda r: r["good"] / rest(r)).alias("less"), F.transform("rows", lambda r: (r["good"] - 1) / rest(r)).alias("less_good"),
    ).alias("model"))


def left_out_ratio(grams: Column, model: Column, good: Column, buckets: int) -> Column:
    """Mean log ratio of a document's ``grams`` under ``model`` without them; 0 where nothing trusted is left.

    Each n-gram counts as its bucket's only one first; then buckets that the document has more often are
    counted anew, so that the rest of them, most, take one look-up each.
    """

    def anew(x):
        """What the buckets in ``x["again"]``, once less than the document has them, differ by from the first count."""
        again, m = x["again"], F.size(x["again"])
        first = F.filter(F.sequence(F.lit(0), m - 1), lambda i: (i == 0) | (F.get(again, i) != F.get(again, i - 1)))

        def of_run(y):
            c, b = y["c"], y["b"]
            share = (F.get(x["of_good"], b) - x["good"] * c) / (F.get(x["of_all"], b) - c + SMOOTHING)
            return c * (F.log(share * x["scale"] + PRIOR) - F.log(F.get(x["less"], b) * x["scale"] + PRIOR))

        runs = let(first, lambda f: F.transform(f, lambda i, j: let(
            F.struct(F.get(again, i).alias("b"), (F.coalesce(F.get(f, j + 1), m) - i + 1).alias("c")), of_run
        )))
        return F.when(m > 0, F.aggregate(runs, F.lit(0.0), lambda a, v: a + v)).otherwise(F.lit(0.0))

    def summed(x):
        each = F.aggregate(x["rows"], F.lit(0.0), lambda a, b: a + F.log(F.get(x["less"], b) * x["scale"] + PRIOR))
        return each + let(F.struct(
            F.filter(x["rows"], lambda b, i: b == F.get(x["rows"], i - 1)).alias("again"),
            *(x[name].alias(name) for name in ("less", "of_all", "of_good", "scale", "good")),
        ), anew)

    def of(x):
        """``x``: the document's buckets in order, the model, and whether to trust the document."""
        n, model = F.size(x["rows"]), x["model"]
        left = model["good_total"] - x["good"] * n
        scale = (model["total"] - n + SMOOTHING * buckets) / left
        total = let(F.struct(
            x["rows"].alias("rows"), F.when(x["good"] == 1, model["less_good"]).otherwise(model["less"]).alias("less"),
            model["n"].alias("of_all"), model["good"].alias("of_good"), scale.alias("scale"), x["good"].alias("good"),
        ), summed)
        return F.when((n > 0) & (left > 0), total / n - F.lit(math.log(1 + PRIOR))).otherwise(F.lit(0.0))

    return let(F.struct(F.sort_array(grams).alias("rows"), model.alias("model"), good.alias("good")), of)


def repeated_words(h: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that the text has twice or more; ``h`` are the words' hashes, ``window`` is a power of two."""

    def covered(rows):
        """Words covered by the windows of a hash that a neighbour in ``rows (hash, place)`` shares."""
        n = F.size(rows)

        def shared(r, i):
            return (F.get(rows, i - 1)["hash"] == r["hash"]) | ((i < n - 1) & (F.get(rows, i + 1)["hash"] == r["hash"]))

        twice = F.filter(rows, lambda r, i: F.coalesce(shared(r, i), F.lit(False)))
        places = F.array_sort(F.transform(twice, lambda r: r["place"]))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
            F.lit(0), lambda a, x: a + x,
        ))

    def of_windows(w):
        rows = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("hash"), i.alias("place"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(rows, covered))

    windows = h
    for doubling in range(window.bit_length() - 1):
        windows = let(windows, _joined(1 << doubling))
    return F.when(F.size(h) > window, let(windows, of_windows)).otherwise(F.lit(0))


def score_quality(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score)``, whether the
    document is trusted as ``_good``, and every column of ``docs (doc_id, text, ...)`` as it is."""
    docs = without(docs, *OWN_NAMES)
    every = marked(docs, trusted)
    # The model is a scalar subquery, worked out once; lambdas may not hold it as such. It and the mark are used
    # once below, so that Spark puts them there: as a column the model would be copied, megabytes, for each row.
    every = every.withColumn("_model", gram_counts(every, buckets).scalar())
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NO_BLANK))

    def of_words(x):
        h = x["h"]
        ratio = left_out_ratio(_buckets(h, buckets), x["model"], x["good"], buckets)
        repeat = let(repeated_words(h), lambda r: F.struct(
            r.cast("long").alias("n_repeat_words"), ((F.size(h) < 20) | (100 * r > 30 * F.size(h))).alias("base_failed")
        ))
        return F.struct(
            F.size(h).cast("long").alias("n_words"), x["word_chars"].alias("word_chars"), repeat.alias("repeat"), ratio.alias("score"), x["good"].alias("_good")
        )

    def hashed(x):
        chars = F.char_length(F.concat_ws("", x["words"])).cast("long")
        return let(F.struct(_hashed(x["words"]).alias("h"), chars.alias("word_chars"), x["model"].alias("model"), x["good"].alias("good")), of_words)

    found = every.select(
        *docs.columns,
        let(F.struct(words_of(F.col("text")).alias("words"), F.col("_model").alias("model"), F.col("_good").alias("good")), hashed).alias("_of_words"),
        (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return found.select(
        *docs.columns, "_of_words._good", "_of_words.n_words", "_of_words.word_chars", "n_symbols", "n_dup_lines", "_of_words.repeat.*", "_of_words.score"
    )


def judge_quality(
    docs: DataFrame, trusted: DataFrame, share: float = SHARE, buckets: int = BUCKETS, columns: list[str] | None = None
) -> DataFrame:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)`` of
    ``docs (doc_id, text, ...)``, with all its other columns or those in ``columns``.

    The scores are staged with those columns, as the threshold follows from them.
    """
    scored = score_quality(docs, trusted, buckets)
    if columns is not None:
        added = scored.columns[len(without(docs, *OWN_NAMES).columns) :]
        scored = scored.select(*columns, *added)
    scored = staged(scored, "quality")
    step = F.floor(F.col("score") * STEPS)
    # As many rows as there are steps between the lowest and the highest score.
    steps = scored.filter("_good = 1 AND NOT base_failed").groupBy(step.alias("step")).agg(F.count("*").alias("n"))
    limit = steps.agg(F.percentile("step", share, F.col("n"))).scalar()
    kept = ~F.col("base_failed") & F.coalesce(step >= F.col("_limit"), F.lit(True))
    return scored.withColumn("_limit", limit).withColumn("kept", kept).drop("_good", "_limit")


def trusted_documents(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def op3_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trusted = trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_quality(docs, trusted, columns=["doc_id"])
