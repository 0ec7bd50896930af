"""Token alignment against a brute force that walks both tokenizers' whole texts."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flawsieve.llm import token_alignment as ta

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DIGEST = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared_links")
TEXTS = [
    None, "", " ", "a", "word", "a▁b", "▁", "<|endoftext|> <s> <unk> <0x41> </s>\n\n", " \t\r\n x  \x00\x1c\x85 end   ",
    "日本語のテキスト ﬁne é naïve  1234567 \U0001f600\U0001f600", "aaaa" * 500, "a b " * 900, " " * 777, "no　gap here",
]


def brute(texts):
    a_model, b_model = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_model.encode_special_tokens = True
    a_bytes, b_bytes = (ta._coder(p).bytes for p in PATHS)
    found, corpus = [], Counter()
    for text in texts:
        spaced = " " + (text or "")
        a = a_model.encode(spaced, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_parts, b_parts = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
        if not text or b"".join(a_parts) != spaced.encode() or b"".join(b_parts) != spaced.encode():
            found.append(None)
            continue
        a_ends, b_ends = (list(accumulate(map(len, p))) for p in (a_parts, b_parts))
        a_at = [i for i, p in enumerate(a_parts) for _ in p]
        b_at = [i for i, p in enumerate(b_parts) for _ in p]
        links = Counter(zip(a_at, b_at))
        groups, m, n = [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            to = bisect_right(a_ends, cut), bisect_right(b_ends, cut)
            groups.append((a[m : to[0]], b[n : to[1]]))
            m, n = to
        found.append((a, b, links, groups))
        corpus.update((a[i], b[j]) for i, j in links)
    most = Counter()
    for (_, y), n in corpus.items():
        most[y] = max(most[y], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        a, b, links, groups = f
        pairs = [(a[i], b[j]) for i, j in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            len(a), len(b), len(groups), len(links), sum(corpus[p] == most[p[1]] for p in pairs), sum(corpus[p] for p in pairs),
            hashlib.sha256(text.encode()).hexdigest(), sum(len(x) * len(y) for x, y in groups),
        ))
    return out, found


def table(spark, texts):
    rows = [(i if i % 7 else None, t, 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a long, block string, key long").repartition(3)


@pytest.fixture(scope="module")
def texts(spark, sf_small):
    given = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    rng = random.Random(5)
    odd = ["".join(rng.choice("ab  é日1.\n\t'") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return TEXTS + TEXTS[3:6] + given[:80] + odd


@pytest.mark.parametrize("block_bytes", [1, 1 << 14, ta.BLOCK_BYTES])
def test_against_brute_force(spark, texts, block_bytes):
    got = ta.align(table(spark, texts), *PATHS, block_bytes).select("doc_id", *DIGEST).collect()
    assert len(got) == len(texts)
    wanted, _ = brute(texts)
    assert Counter(tuple(r) for r in got) == Counter((i if i % 7 else None, *w) for i, w in enumerate(wanted))


def test_links(spark, texts):
    docs = table(spark, texts).filter("doc_id IS NOT NULL")
    _, found = brute(texts)
    overlap = {(r.doc_id, r.a_at, r.b_at): r.n_bytes for r in ta.document_links(docs, *PATHS).collect()}
    assert overlap == {(d, *k): n for d, f in enumerate(found) if f and d % 7 for k, n in f[2].items()}
    shared = ta.document_links(docs, *PATHS, by_group=True).groupBy("doc_id").count().collect()
    assert dict(map(tuple, shared)) == {d: sum(len(x) * len(y) for x, y in f[3]) for d, f in enumerate(found) if f and d % 7}


def test_units_kept_or_not_give_the_same(spark, texts, monkeypatch):
    whole = [ta._coder(p).ids([" " + t for t in texts if t]) for p in PATHS]
    monkeypatch.setattr(ta, "MEMO", 3)
    for path, wanted in zip(PATHS, whole):
        fresh = ta._pieces(path) if path.endswith(".model") else ta._byte_level(path)
        assert [fresh.ids([" " + t])[0] for t in texts if t] == wanted
        assert len(fresh.known) <= 3


def test_products():
    rng = np.random.default_rng(6)
    for _ in range(30):
        dense = [rng.random((m, n)) < 0.3 for m, n in ((7, 11), (11, 5))]
        a, b = (ta.Csr(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1], d.shape[1]) for d in dense)
        wanted = dense[0].astype(int) @ dense[1].astype(int)
        for entries in (1, 5, 1000):
            got = np.zeros_like(wanted)
            for first, part in ta.row_blocks(a, b, entries):
                for i in range(part.height):
                    s = slice(part.indptr[i], part.indptr[i + 1])
                    got[first + i, part.indices[s]] = part.data[s]
            assert (got == wanted).all()
        t = ta.transposed(b)
        back = np.zeros(dense[1].T.shape, bool)
        back[np.repeat(np.arange(t.height), np.diff(t.indptr)), t.indices] = True
        assert (back == dense[1].T).all()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ta.align(none, *PATHS).count() == 0
    assert ta.document_links(none, *PATHS).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert sorted(map(str, ta.align(nulls, *PATHS).select(F.hash("n_links", "groups_sha256")).collect())) != []

