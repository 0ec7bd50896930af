"""Substring dedup against a brute force over all windows, and against its SQL."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import oracle
from flawsieve.llm import oracles, substring_dedup as sd


def brute(rows, window):
    split = [[w.decode() for w in (t or "").encode().split()] for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        spans = [(i, next(j for j in range(i, len(w) + 1) if j not in gone)) for i in sorted(gone) if i - 1 not in gone]
        out.append((doc, len(w), len(gone), spans, " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def rows(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(150)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [text(n) for n in (35, 36, 50, 90, 34, 300)]
    out = []
    for i in range(120):
        words = text(rng.randint(0, 80))
        for _ in range(rng.choice((0, 1, 2))):
            part = list(rng.choice(passages))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "odd"
            words[rng.randint(0, len(words)) : 0] = part
        out.append((i if i % 11 else None, rng.choice((" ", "\n", "\t \x0b")).join(words)))
    out += [(200, None), (201, ""), (202, " \n "), (203, " ".join(passages[0])), (203, " ".join(passages[0])), (None, None)]
    out += [(204, "a " * 900), (205, "a b " * 300), (206, "b a " * 40 + "c"), (207, "x y z " * 12), (208, " ".join(text(3000)))]
    return out


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, n_words long, block string, key long").repartition(4)


def found(df):
    return sorted(
        ((r.doc_id, r.n_words, r.n_removed, [tuple(s) for s in r.removed], r.kept_text) for r in df.collect()), key=str
    )


SIZES = {"whole": {}, "tiny": {"block_bytes": 1, "chunk_bytes": 1}, "crowded": {"block_bytes": 2000, "chunk_bytes": 1, "crowded_bytes": 1}}


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("window", [35, 12])
def test_against_brute_force(spark, sizes, window):
    wanted = sorted(brute(rows(), window), key=str)
    assert sum(w[2] > 0 for w in wanted) > 50
    assert found(sd.drop_repeats(table(spark, rows()), window, **SIZES[sizes])) == wanted


def test_frequent_sequences_and_short_runs(spark, monkeypatch):
    monkeypatch.setattr(sd, "FREQUENT", 2)
    monkeypatch.setattr(sd, "LONGEST", 3)
    monkeypatch.setattr(sd, "SPAN_BYTES", 5)
    assert found(sd.drop_repeats(table(spark, rows(2)), 20, 5)) == sorted(brute(rows(2), 20), key=str)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    strings = pa.array([b"a b c d ", b"b c d e ", b"x y z ", b"a b c "])
    wanted = [True, True, True, False, False, True]
    assert sd._repeated(strings, np.ones(4), 3)[1].tolist() == wanted
    monkeypatch.setattr(sd, "_rolled", lambda values, starts, ends, base=0: np.zeros(len(starts), np.uint64))
    assert sd._repeated(strings, np.ones(4), 3)[1].tolist() == wanted


def test_a_common_passage_reaches_its_bucket_once_a_block(spark):
    """However many documents hold it, with whatever around it."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"w{rng.random()}" for _ in range(40)) + " " + passage + " " + " ".join(f"w{rng.random()}" for _ in range(40))) for i in range(600)]
    blocks = sd.text_blocks(table(spark, docs).coalesce(1))
    levels = spark.sparkContext.broadcast(sd.frequency_levels(blocks))
    sent = sd.super_kmers(blocks, sd.shared_minimisers(blocks, levels), levels).groupBy("key").count()
    assert sent.agg({"count": "max"}).first()[0] < 30
    assert all(r.n_removed == 60 for r in sd.drop_repeats(table(spark, docs)).collect())


def test_sql_agrees(spark, sf_small):
    ours = oracle.rows_of_spark(sd.op12_substring_dedup(spark, sf_small))
    assert ours == oracle.rows_of(oracle.connect(sf_small), oracles.OP12)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sd.drop_repeats(none).count() == 0
    assert found(sd.drop_repeats(table(spark, [(1, None), (None, "")]))) == [(1, 0, 0, [], ""), (None, 0, 0, [], "")]


def test_digest_of_what_is_kept(spark, sf_small):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    wanted = {(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, _, t in brute(docs, 35)}
    assert set(map(tuple, sd.op12_substring_dedup(spark, sf_small).collect())) == wanted
