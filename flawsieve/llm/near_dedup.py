"""MinHash near-dedup with sequential Bayesian verification.

1. Texts with the same words form a class, named by a digest of 128 bits of its
   words; only classes go on.
2. Each class gets a signature of ``HASHES`` minimum hashes; a band of it is a
   bucket key, and classes that share a bucket are candidates. The bands'
   length follows from the threshold.
3. Star round: in each bucket every class meets the bucket's hub, the class with
   the most neighbours over all its buckets. A bucket of g classes makes g pairs.
4. Rest round: only buckets whose classes still lie in several components go on.
   They are cut into parts of bounded size, and signatures of pairs of parts are
   compared in the task that holds them, so that pairs never become rows; parts of
   a bucket's largest component do not meet each other. A pair counts in the first
   band it shares, and only across components. Classes without a pair left drop
   out; to the others their texts are brought.

In both rounds a pair's signatures are compared batch by batch; it is dropped
once the posterior probability (uniform prior) of a similarity of at least
``threshold`` falls below ``miss``. What is left is verified on the full sets of
shingles. Components are found by hooking and pointer jumping over the links.

A text with fewer words than a shingle is one shingle; a text without words
has none and is linked with nothing. Null ids are taken for texts of no id and
give a row each, alone. Repeated rows fall together. Different texts under one id
are documents of their own, each with the links of its text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flawsieve.llm.shared import staged

SHINGLE = 5
HASHES = 100
BATCH = 20
MISS = 1e-6
# The share of pairs at the threshold that may share no band.
UNSEEN = 1e-5
PART = 256
# Rows of texts that nobody wants are told by a bitmap of so many longs (2 MB) before they are shuffled. Beyond some
# million wanted texts it fills up: more are shuffled then, and the results stay.
BITMAP = 1 << 18

_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 62, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(21).integers(0, 1 << 62, HASHES, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_list(text: str | None) -> list[bytes]:
    """A-Z lower-cased; both steps look at ASCII only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(h) - SHINGLE + 1, 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        mixed = (mixed ^ h[j : j + n]) * _BASE
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed ^ np.uint64(min(len(h), SHINGLE)))


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        out = np.minimum(out, (shingles[a : a + 4096, None] * _MULTIPLIERS + _SHIFTS).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def band_rows(threshold: float, unseen: float = UNSEEN) -> int:
    """The most hashes a band can have for all bands but ``unseen`` of the pairs to share one: 5 at 0.85, 4 at 0.8."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** (HASHES // (rows + 1)) <= unseen:
        rows += 1
    return rows


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` hashes of each signature."""
    bands = HASHES // rows
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _BASE, parts.shape[:2]).copy()
    for r in range(rows):
        key = (key ^ parts[:, :, r]) * _BASE
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """By the end of each batch: the fewest equal hashes with which a pair goes on.

    With m of h hashes equal the similarity is Beta(m + 1, h - m + 1); that it is
    at least t has the probability of at most m successes of h + 1 at t.
    """
    from math import comb

    least = []
    for h in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
        least.append(m)
    return np.array(least)


def _alive(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of two aligned arrays of signatures pass every batch."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int32)
    for i, need in enumerate(least):
        s = slice(i * BATCH, (i + 1) * BATCH)
        equal[alive] += (left[alive, s] == right[alive, s]).sum(1, dtype=np.int32)
        alive = alive[equal[alive] >= need]
    return alive


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def _classes(docs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, mark, class, n_shingles, sig, keys)`` of every row, and ``(id, first)`` of every
    class with words and an id; ``first (doc_id, mark)`` tells its first text."""

    def sign(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                part = whole.slice(a, 512)
                classes, n, sigs, keys = [], [], [], []
                for text in part.column(2):
                    words = word_list(text.as_py())
                    classes.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                    shingles = shingle_set(words)
                    n.append(len(shingles))
                    s = signature(shingles)
                    sigs.append(s.tobytes() if words else None)
                    keys.append(band_keys(s[None], rows)[0] if words else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(classes, pa.binary()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "mark", "class", "n_shingles", "sig", "keys"],
                )

    schema = "doc_id long, mark long, class binary, n_shingles long, sig binary, keys array<long>"
    signed = staged(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(sign, schema), "signatures")
    named = signed.filter("class IS NOT NULL AND doc_id IS NOT NULL")
    first = named.groupBy(F.col("class").alias("id")).agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    return signed, staged(first, "classes")


def _bitmap(wanted: DataFrame) -> DataFrame:
    """One row ``(bits)`` of ``BITMAP`` longs, in which the bit of each ``(doc_id, mark)`` is set."""
    h = F.xxhash64("doc_id", "mark")
    word = F.pmod(F.shiftrightunsigned(h, 6), F.lit(BITMAP)).cast("int")
    set_bits = wanted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")).alias("bit"))
    set_bits = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = wanted.sparkSession.range(BITMAP).select(F.col("id").cast("int").alias("word")).join(set_bits, "word", "left").na.fill(0, ["bits"])
    return every.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("rows")).select(F.transform("rows", lambda r: r["bits"]).alias("bits"))


def _told(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked (id, ...)``, each with the class's ``text``."""
    first = classes.select("id", "first.doc_id", "first.mark")
    asked = staged(asked.join(first.hint("merge"), "id"), "asked")
    h = F.xxhash64("doc_id", "mark")
    known = F.get(F.col("_bits"), F.pmod(F.shiftrightunsigned(h, 6), F.lit(BITMAP)).cast("int"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").withColumn("_bits", _bitmap(asked.select("doc_id", "mark")).scalar())
    texts = texts.filter(F.call_function("getbit", known, F.pmod(h, F.lit(64)).cast("int")) == 1).select("doc_id", "mark", "text")
    # Repeated rows give their text once.
    texts = texts.groupBy("doc_id", "mark").agg(F.max("text").alias("text"))
    return asked.join(texts.hint("merge"), ["doc_id", "mark"]).drop("doc_id", "mark")


def _star_links(pairs: DataFrame, sigs: DataFrame, told, percent: int, least: np.ndarray) -> DataFrame:
    """``(a, b)``: the linked ones of ``pairs (hub, id)``."""

    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (
                    np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3)
                )
                keep = pa.array(_alive(left, right, least))
                yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in (0, 1)], names=["hub", "id"])

    hubs = sigs.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig"))
    signed = pairs.join(sigs.hint("merge"), "id").join(hubs.hint("merge"), "hub").select("hub", "id", "hub_sig", "sig")
    passed = staged(signed.mapInArrow(prune, "hub binary, id binary"), "star-pairs")
    # Members of a hub are dealt into groups of about PART; each gets the hub's text once.
    sizes = staged(passed.groupBy("hub").agg(F.count("*").alias("size")), "star-sizes")
    salted = passed.join(sizes, "hub").select(
        "hub", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / PART)).alias("salt"), F.lit(False).alias("lead")
    )
    leads = salted.select("hub", F.col("hub").alias("id"), "salt", F.lit(True).alias("lead")).distinct()
    rows = told(salted.unionByName(leads)).select("hub", "salt", "id", "text", "lead")

    def verify(batches):
        hub, own = None, None
        for batch in batches:
            found = []
            for h, i, text, lead in zip(*(batch.column(k).to_pylist() for k in (0, 2)), batch.column(3), batch.column(4).to_pylist()):
                shingles = shingle_set(word_list(text.as_py()))
                if lead:
                    hub, own = h, shingles
                elif h == hub and _linked(own, shingles, percent):
                    found.append((h, i))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[j] for f in found], pa.binary()) for j in (0, 1)], names=["a", "b"]
            )

    sorted_rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("lead").desc())
    return staged(sorted_rows.mapInArrow(verify, "a binary, b binary"), "star-links")


def _rest_links(buckets: DataFrame, sigs: DataFrame, told, percent: int, least: np.ndarray, rows: int) -> DataFrame:
    """Links across components within ``buckets (key, id, component)``.

    The largest component of a bucket has parts of its own, which meet all parts of
    the others but not each other: a bucket of g classes with k of them outside its
    largest component makes about 2 g k / PART + g rows.
    """
    counts = buckets.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("size"))
    parts = largest.select(
        "key", F.col("most.component").alias("most"), F.ceil((F.col("size") - F.col("most.n")) / PART).cast("int").alias("others"),
        F.ceil(F.col("most.n") / PART).cast("int").alias("own"),
    )
    parts = staged(parts.filter("others > 0"), "parts")
    # Parts from 0 are the others', those from ``others`` the largest component's.
    of_most = F.col("component") == F.col("most")
    h = F.xxhash64("id")
    part = F.when(of_most, F.col("others") + F.pmod(h, F.col("own"))).otherwise(F.pmod(h, F.greatest("others", F.lit(1))))
    last = F.when(of_most, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1
    # Part p meets every part q: its rows go to each pair (p, q) with p <= q and each (q, p) with q < p.
    dealt = buckets.join(parts, "key").select(
        "key", "id", "component", part.cast("int").alias("part"), F.sequence(F.lit(0), last).alias("meets")
    )
    full = dealt.join(sigs.hint("merge"), "id")
    spread = full.select("key", "id", "component", "sig", "part", F.explode("meets").alias("q")).select(
        "key", F.least("part", "q").alias("low"), F.greatest("part", "q").alias("high"), "part", "id", "component", "sig"
    )

    def survivors(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, _ = _block_pairs(pdf, least, rows)
        return pdf.iloc[np.union1d(i, j)]

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        i, j, equal = _block_pairs(pdf, least, rows)
        root = {c: c for c in pdf["component"]}
        component = pdf["component"].to_numpy()

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        order = np.argsort(-equal, kind="stable")
        sets, found = {}, []
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            x, y = find(component[a]), find(component[b])
            if x == y:
                continue
            for m in (a, b):
                if m not in sets:
                    sets[m] = shingle_set(word_list(pdf["text"].iat[m]))
            if _linked(sets[a], sets[b], percent):
                root[x] = y
                found.append((pdf["id"].iat[a], pdf["id"].iat[b]))
        return pd.DataFrame(found, columns=["a", "b"])

    block = ("key", "low", "high")
    alive = staged(spread.groupBy(*block).applyInPandas(survivors, spread.schema), "rest-pairs")
    return staged(told(alive).groupBy(*block).applyInPandas(verify, "a binary, b binary"), "rest-links")


def _block_pairs(pdf: pd.DataFrame, least: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of a block that pass every batch, and their equal hashes.

    Pairs lie across components and, where two parts meet, across parts; of the bands a
    pair shares only the first one counts.
    """
    key, low, high = (int(pdf[c].iloc[0]) for c in ("key", "low", "high"))
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, HASHES)
    keys = band_keys(sig, rows)
    band = int(np.argmax((keys == key).all(0)))
    component = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1]
    part = pdf["part"].to_numpy()
    i, j = np.triu_indices(len(pdf), 1)
    use = component[i] != component[j]
    if low != high:
        use &= part[i] != part[j]
    i, j = i[use], j[use]
    if band:
        first = ~(keys[i, :band] == keys[j, :band]).any(1)
        i, j = i[first], j[first]
    on = _alive(sig[i], sig[j], least)
    i, j = i[on], j[on]
    return i, j, (sig[i] == sig[j]).sum(1)


def components(links: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id reachable, for every id of ``links (a, b)``.

    Each round hooks every root to the smallest root beside it and then jumps
    pointers; rounds grow with the logarithm of the longest chain.
    """
    edges = links.filter("a <> b").select("a", "b")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    labels = staged(nodes.select("id", F.col("id").alias("component")), "labels")
    edges = staged(edges.union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    while True:
        # Edges between the roots of what is joined so far.
        own = labels.withColumnsRenamed({"id": "a", "component": "ra"})
        far = labels.withColumnsRenamed({"id": "b", "component": "rb"})
        edges = edges.join(own, "a").join(far, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = staged(edges, "edges")
        if edges.isEmpty():
            return labels
        hook = edges.groupBy("a").agg(F.min("b").alias("to")).filter("to < a").select(F.col("a").alias("root"), "to")
        parents = staged(hook, "hooks")
        while True:  # a chain of hooks falls to its end
            up = parents.select(F.col("root").alias("to"), F.col("to").alias("top"))
            jumped = staged(parents.join(up, "to", "left").select("root", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")), "hooks")
            parents = jumped.select("root", "to")
            if jumped.filter("moved").isEmpty():
                break
        to = parents.select(F.col("root").alias("component"), "to")
        labels = staged(labels.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = MISS) -> DataFrame:
    """``(doc_id, mark, n_shingles, component_id, kept, first)`` for every row of ``docs (doc_id, text)``.

    Texts are linked whose sets of shingles have a similarity of ``percent`` / 100 or more.
    ``mark`` is the text's ``xxhash64``; ``first`` tells the one text of each group that is
    first by ``(doc_id, mark)``, on each row that has it.
    """
    least, rows_a_band = least_matches(percent / 100, miss), band_rows(percent / 100)
    signed, classes = _classes(docs, rows_a_band)
    own = classes.select("id", "first.doc_id", "first.mark")
    named = signed.select("doc_id", "mark", F.col("class").alias("id"), "sig", "keys").join(own.hint("merge"), ["id", "doc_id", "mark"])
    reps = staged(named.select("id", "sig", "keys").dropDuplicates(["id"]), "class-signatures")
    sigs = reps.select("id", "sig")

    def told(asked):
        return _told(docs, classes, asked)

    # Tables that grow with the corpus meet by shuffles, at every size.
    # What is gathered by key is written before it meets a bucket's rows: a hot bucket's rows can be split then.
    rows = reps.select("id", F.explode("keys").alias("key"))
    sizes = staged(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    shared = staged(rows.join(sizes.hint("merge"), "key"), "buckets")
    degrees = shared.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = shared.join(degrees.hint("merge"), "id")
    hubs = staged(ranked.groupBy("key").agg(F.max(F.struct("degree", "id")).alias("hub")).select("key", "hub.id"), "hubs")
    hubs = hubs.withColumnRenamed("id", "hub")
    pairs = shared.join(hubs.hint("merge"), "key").filter("hub <> id").select("hub", "id").distinct()
    links = _star_links(pairs, sigs, told, percent, least)
    labels = components(links)
    placed = staged(shared.join(labels.hint("merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    # A pair of classes without a common component is tested here, but for those with the hub.
    apart = staged(several.select("key").join(hubs.hint("merge"), "key"), "apart")
    rest = placed.join(apart.hint("merge"), "key").filter("id <> hub OR component <> hub")
    rest = staged(rest.select("key", "id", "component"), "rest-buckets")
    more = _rest_links(rest, sigs, told, percent, least, rows_a_band)
    labels = components(links.unionByName(more))
    grouped = classes.join(labels.hint("merge"), "id", "left").select("id", "first", F.coalesce("component", "id").alias("component"))
    leads = staged(grouped.groupBy("component").agg(F.min("first").alias("lead")), "leads")
    by_class = staged(grouped.join(leads.hint("merge"), "component").select(F.col("id").alias("class"), "lead"), "class-leads")
    out = signed.select("doc_id", "mark", "n_shingles", "class").join(by_class.hint("merge"), "class", "left")
    alone = F.col("doc_id").isNull() | F.col("lead").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("lead.doc_id"))
    return out.select(
        "doc_id", "mark", "n_shingles", component.alias("component_id"),
        (alone | (F.col("doc_id") == F.col("lead.doc_id"))).alias("kept"),
        (alone | (F.struct("doc_id", "mark") == F.col("lead"))).alias("first"),
    )


def op4_minhash_near_dedup(spark, sf_dir):
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
