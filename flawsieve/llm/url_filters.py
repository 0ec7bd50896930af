"""URL filters: rules by host and path, and the reputation of hosts where no rule speaks.

A host's share of bad pages is a beta-binomial posterior. Its prior comes from
the registered domain, that one's from the suffix, and that one's from all
pages; the strength of each level's prior is the moment estimate of how much
the level's members differ. A host is blocked where the lower bound of its
posterior lies above the share that is put up with.

Null urls and urls without ``://`` have an empty host and path, match no rule
and have the reputation of all pages. Repeated rows give repeated results.
Pages without outcome count for nothing but are judged like all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flawsieve.llm.shared import ascii_lower, staged

MAX_RULES = 500
# Second-level names that belong to the suffix below a two-letter country code.
SHARED_SECOND_LEVELS = ("ac", "co", "com", "edu", "gov", "net", "org")

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    text = F.coalesce(F.col(url), F.lit(""))
    pattern = r"://([^/?#]*)([^?#]*)"
    return pages.withColumns({
        "host": ascii_lower(F.regexp_extract(text, pattern, 1)),
        "path": F.regexp_extract(text, pattern, 2),
    })


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    last, second = F.try_element_at(labels, F.lit(-1)), F.try_element_at(labels, F.lit(-2))
    shared = (F.length(last) == 2) & second.isin(*SHARED_SECOND_LEVELS)
    return F.when(shared, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The suffix and the label before it; a host that is a suffix is its own domain."""
    return F.coalesce(
        F.when(F.contains(suffix_of(host), F.lit(".")), F.nullif(F.substring_index(host, ".", -3), F.lit("")))
        .otherwise(F.nullif(F.substring_index(host, ".", -2), F.lit(""))),
        host,
    )


def by_rules(rules, what: str) -> Column:
    """``rule`` or ``verdict`` of the longest rule for the host and path; null where none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    chosen = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        own = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits = own & F.startswith("path", F.lit(slash + path))
        value = F.lit(rule if what == "rule" else verdict)
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return F.lit(None).cast("string") if chosen is None else chosen


def _strength(members: DataFrame, least: float, most: float) -> float:
    """Of a level's members ``(n, bad, mean)``: the prior's weight, in pages; a single number."""
    seen = members.filter("n > 0")
    binomial = F.sum(F.col("mean") * (1 - F.col("mean"))) / F.sum("n")
    within = F.sum(F.col("n") * F.col("mean") * (1 - F.col("mean"))) / F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2)) / F.sum("n")
    rho = seen.agg(((spread - binomial) / F.nullif(within, F.lit(0.0))).alias("rho")).first().rho
    return min(max(1 / rho - 1, least), most) if rho is not None and rho > 0 else most


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """``(host, n_labelled, mean, low, high)`` of every host of ``hosts (host)``.

    ``outcomes (host, bad)`` holds a row for each labelled page, ``bad`` 0 or 1.
    The share of bad pages has mean ``mean`` and lies, by ``z`` deviations,
    between ``low`` and ``high``. Without any outcome all means are a half.
    """
    unknown = hosts.select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    known = outcomes.select("host", F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("bad"))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    every = unknown.unionByName(known).groupBy("host").agg(*sums)
    every = every.withColumns({"domain": domain_of(F.col("host")), "suffix": F.coalesce(suffix_of(F.col("host")), F.lit(""))})
    every = staged(every, "hosts")  # one row a host; each level below reads it
    domains = every.groupBy("domain", "suffix").agg(*sums)
    suffixes = every.groupBy("suffix").agg(*sums)
    mean = every.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).first()[0]

    def level(members):
        s = _strength(members, least, most)
        a, b = s * F.col("mean") + F.col("bad"), s * (1 - F.col("mean")) + F.col("n") - F.col("bad")
        return members.withColumns({"posterior": a / (a + b), "weight": a + b})

    def below(members, parents, key):
        return level(members.join(parents.select(key, F.col("posterior").alias("mean")), key))

    top = level(suffixes.withColumn("mean", F.lit(mean)))
    found = below(every, below(domains, top, "suffix"), "domain")
    half = z * F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (F.col("weight") + 1))
    return found.select(
        "host", F.col("n").alias("n_labelled"), F.col("posterior").alias("mean"),
        F.greatest(F.lit(0.0), F.col("posterior") - half).alias("low"),
        F.least(F.lit(1.0), F.col("posterior") + half).alias("high"),
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_low)`` for every row of ``pages (page_id, url)``.

    ``outcomes (page_id, bad)`` holds what is known of labelled pages.
    """
    split = with_host_and_path(pages.select("page_id", "url"))
    known = split.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id").select("host", "bad")
    reputation = host_reputation(split, known, z).select("host", "low")
    by_method = F.when(F.col("low") > max_bad, "block").otherwise("allow")
    return split.join(reputation, "host", "left").select(
        "page_id", "host", "path", by_rules(rules, "rule").alias("rule"),
        F.coalesce(by_rules(rules, "verdict"), by_method).alias("verdict"), F.round("low", 6).alias("bad_low"),
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(page_id, bad)`` of pages whose path names a labelled document by number."""
    doc = F.regexp_extract("path", r"/(\d{1,18})(?:[/.]|$)", 1)
    numbered = with_host_and_path(pages.select("page_id", "url")).select("page_id", doc.try_cast("long").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    return numbered.join(known, "doc_id").groupBy("page_id").agg(F.max("bad").alias("bad"))


def op2_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_urls(pages, labelled_pages(pages, labels)).select("page_id", "host", "path", "rule", "verdict")
