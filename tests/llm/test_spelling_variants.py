"""Spelling variants against a brute force over all pairs of words that share a deletion."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flawsieve.llm import spelling_variants as sv


def vocabulary_of(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words):
    shared = defaultdict(set)
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shared[v].add(w)
    near = defaultdict(set)
    for group in shared.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéÿ÷") for _ in range(rng.randint(6, 12))) for _ in range(60)] + ["a" * 9, "a" * 8 + "b", "A" * 9]
    out = []
    for doc in range(400):
        found = []
        for _ in range(rng.randint(0, 60)):
            word = words[int(rng.random() ** 3 * len(words))]
            for _ in range(rng.choice((0, 0, 0, 0, 1, 2))):
                at = rng.randrange(len(word) + 1)
                word = rng.choice((word[:at] + word[at + 1 :], word[:at] + rng.choice("abé") + word[at:], word[:at] + "c" + word[at + 1 :]))
            found.append(word.upper() if rng.random() < 0.1 else word)
        out.append((doc if doc % 9 else None, rng.choice((" ", "1", "\n", "-")).join(found)))
    long = " ".join("z" * n for n in (7, 8, 40, 41, 300, 301)) * 3
    return out + out[:20] + [(7, None), (8, ""), (None, None), (9, long), (10, "short words only"), (11, "Ömitted Ābcdefgh ×÷×÷×÷×÷ ×÷×÷×÷×÷ ×÷×÷×÷×x ×÷×÷×÷×x")]


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, word string, n long, key long").repartition(4)


@pytest.fixture(scope="module")
def wanted():
    return brute(vocabulary_of(rows()))


def check(found, wanted):
    found = [tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(wanted) and {r[0]: r for r in found} == wanted


def test_against_brute_force(spark, wanted):
    assert sum(w[1] is not None for w in wanted.values()) > 50
    assert any(w[1] not in (None, w[2]) for w in wanted.values())
    check(sv.spelling_variants(table(spark, rows())), wanted)


@pytest.mark.parametrize("bits", [8, 1 << 12])
def test_a_full_bitmap_changes_nothing(spark, wanted, monkeypatch, bits):
    small = sv.key_bitmap
    monkeypatch.setattr(sv, "key_bitmap", lambda keys: small(keys, bits))
    monkeypatch.setattr(sv, "HELD_WORDS", 10)
    check(sv.spelling_variants(table(spark, rows())), wanted)


def test_on_the_given_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    check(sv.op11_spelling_variants(spark, sf_small), brute(vocabulary_of([tuple(r) for r in docs.collect()])))


def test_long_chains(spark):
    words = {"a" * 7 + "b" * i: 2 * 10**i for i in range(9)} | {"unrelated": 5}
    vocabulary = spark.createDataFrame(list(words.items()), "word string, n long")
    found = sv.with_roots(sv.spelling_forms(vocabulary))
    check(found, brute(words))
    assert {r.root for r in found.filter("word <> 'unrelated'").collect()} == {"a" * 7 + "b" * 8}


def test_neighbourhoods_are_whole():
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("abcdefghé") for _ in range(rng.randint(7, 12)))
        at = rng.randrange(len(word) + 1)
        other = rng.choice((word[:at] + word[at + 1 :], word[:at] + rng.choice("abz") + word[at:], word[:at] + "q" + word[at + 1 :]))
        if len(other) >= 7:
            keys = {int(k[0]) for k in sv._Reduced([word]).neighbours()}
            assert keys & {int(k[0]) for k in sv._Reduced([other]).own()}
    r = sv._Reduced(["abcdefghij"])
    assert len([*r.neighbours()]) == 2 + 10 + 10 * (sv.SYMBOLS - 1) + 11 * sv.SYMBOLS
    assert all(k.dtype == np.uint64 for k in r.neighbours())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sv.spelling_variants(none).count() == 0
    assert sv.spelling_variants(table(spark, [(1, None), (None, ""), (2, "few words")])).count() == 0
