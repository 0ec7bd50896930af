"""Operators on documents against brute force, on a table with awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import oracle
from flawsieve.llm import lm_scoring, near_dedup, oracles, packing
from flawsieve.llm.decontamination import RECALL, find_leaks, plain_words
from flawsieve.llm.language_id import identify
from flawsieve.llm.line_dedup import apply_bitmaps, drop_bitmaps, line_counts, op10_line_dedup
from flawsieve.llm.lm_scoring import score
from flawsieve.llm.near_dedup import near_duplicates
from flawsieve.llm.packing import pack, packed
from flawsieve.llm.quality_rules import PRIOR, judge_quality, score_quality
from flawsieve.llm.token_counts import count_tokens, unit_splitter
from flawsieve.llm.url_filters import judge_urls, op2_url_filters

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, piece string, hash long, block long, key long"


def words(text):
    return (text or "").encode().lower().split()


def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(25, 90))) for _ in range(60)]
    out = list(enumerate(texts))
    for i in range(12):  # copies, near copies, and a line that all of them have
        copy = texts[i].split(" ")
        copy[rng.randrange(len(copy))] = "changed"
        out += [(100 + i, texts[i]), (200 + i, " ".join(copy)), (300 + i, texts[i] + "\n  Shared LINE \n" + texts[i + 20])]
    long = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(200))
    out += [(400, None), (401, ""), (402, " \n\t"), (403, "one"), (404, long), (405, "<|endoftext|> a  b\n\n c\x1c\x85"), (405, "<|endoftext|> a  b\n\n c\x1c\x85")]
    out += [(None, "no id here"), (None, None)]
    return [(i, t, "x", 1, 2, 3) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1]) for r in rows()]


def test_token_counts(docs, none):
    model = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for i, t in texts():
        n = len(model.encode(t or "", add_special_tokens=False))
        want[i, len((t or "").encode()), n, n > 50] += 1
    assert Counter(map(tuple, count_tokens(docs, BYTE_BPE, 50).collect())) == want
    assert count_tokens(none, BYTE_BPE, 50).collect() == []


def test_units_are_whole_pretokens():
    model, split, rng = Tokenizer.from_file(BYTE_BPE), unit_splitter(["<|endoftext|>"]), random.Random(3)
    parts = ["a", "b'", " ", "  ", "\n", "\t", "'s", "é", "1", "!", "\x1c", "\x85", " ", "<|endoftext|>", "\r\n", "　", "'ll"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        units = [u.decode() for u in split(text)]
        assert "".join(units) == text
        assert sum(len(model.encode(u, add_special_tokens=False)) for u in units) == len(model.encode(text, add_special_tokens=False))


def test_packed_words_are_looked_up_once(monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, word, *default):
            self.asked += 1
            return super().get(word, *default)

        def __contains__(self, word):
            self.asked += 1
            return super().__contains__(word)

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    known = Counted({"": b""})
    monkeypatch.setitem(packing._memo, WORD_BPE, known)
    monkeypatch.setattr(packing, "MEMO", 3)
    many = ["one two one", "", " two\x1cthree \u00a0 four five", "five"]
    model = Tokenizer.from_file(WORD_BPE)
    for _ in range(2):
        known.asked = 0
        ids = [np.frombuffer(found, "<u4").tolist() for found in packing.token_bytes(many, WORD_BPE)]
        assert ids == [model.encode(t, add_special_tokens=False).ids for t in many]
        assert known.asked <= sum(len(packing.GAP(t)) for t in many) and len(known) <= 3


def test_packed_words_are_tokenized_together(monkeypatch):
    """Far fewer texts than new words go to the tokenizer, and each word keeps the ids it has alone."""
    given, model = [], Tokenizer.from_file(WORD_BPE)

    class Counted:
        def encode_batch(self, texts, **options):
            given.extend(texts)
            return model.encode_batch(texts, **options)

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return model.encode_batch_fast(texts, **options)

    monkeypatch.setitem(packing._memo, WORD_BPE, {"": b""})
    monkeypatch.setattr(packing, "tokenizer", lambda path: Counted())
    odd = ["a\0b", "\0", "x\0", "<|endoftext|>", "don't", "don't,", "'s", "'", "\u0301", "e\u0301", "\u0301a", "\u00a8", "\x1b", "\ufeff", "%%%", "\u1e9e"]
    odd += ["\u4e2d\u6587", "1234", "\u0130,", "\u0958.", "\u0130", "\u0958", "\u039f\u03a3!", "\u212b-", "A)", "a'", "a,b", "\u00aa.", "\u01c5)"]
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    plain = [word("abcdE\u00e9\u0442") + rng.choice(["", ",", "...", ")!"]) for _ in range(4000)]
    odd += [word("abc'\u00e9\u0301.,0\u0130 ") for _ in range(300)]
    many = [" ".join(plain[:900]), " ".join(odd), " ".join(rng.sample(odd + plain, 4000))]
    for _ in range(2):
        ids = [np.frombuffer(found, "<u4").tolist() for found in packing.token_bytes(many, WORD_BPE)]
        assert ids == [model.encode(t, add_special_tokens=False).ids for t in many]
    assert len(given) < 1000


def test_packing(docs, none):
    model, size = Tokenizer.from_file(WORD_BPE), 64
    found = pack(docs, WORD_BPE, 2, size, keep_ids=True).collect()
    want, got, loads = Counter(), defaultdict(list), defaultdict(list)
    for i, t in texts():
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, len(ids)] += len(ids)
    for p in found:
        ids = [int.from_bytes(p.ids[j : j + 4], "little") for j in range(0, len(p.ids), 4)]
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        got[p.doc_id, p.doc_tokens].append((p.start, ids))
        loads[p.sequence_id].append((p.offset, p.length))
    assert {k: sum(len(x) for _, x in v) for k, v in got.items()} == dict(want)
    for i, t in texts():
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        assert all(ids[start : start + len(x)] == x for start, x in got[i, len(ids)] if i is not None)
    for pieces in loads.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    total = sum(p.length for p in found)
    assert len(loads) <= total / size * 1.02 + 1
    assert pack(none, WORD_BPE, 2).collect() == []
    windows = packed([5, 5, 5, 5], 8)
    assert len(windows) == 3 and sum(n for w in windows for _, _, n in w) == 20


def components_brute(texts, percent):
    """``{id: (n_shingles, component)}`` by comparing all pairs."""
    sets, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in texts:
        w = words(t)
        if i is not None:
            parent[i] = i
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(docs, none):
    want = components_brute(texts(), 85)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
        else:
            assert r.kept
    assert near_duplicates(none).collect() == []


def test_near_duplicates_of_two_texts_under_one_id(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    found = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, one), (None, one), (5, None), (5, "")]
    got = near_duplicates(spark.createDataFrame(found, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (5, 5)]
    assert sorted(r.doc_id or 0 for r in got if r.first) == [0, 1, 1, 5, 5]
    assert all(r.kept == (r.doc_id in (1, 5, None)) for r in got)


@pytest.mark.parametrize("percent", [80, 85])
def test_chains_of_near_duplicates(spark, monkeypatch, percent):
    """Neighbours are linked, ends are not, some steps are too wide, and buckets have many parts."""
    monkeypatch.setattr(near_dedup, "PART", 4)
    rng, base = random.Random(8), [f"w{j}" for j in range(200)]
    found = []
    for i in range(60):
        for _ in range(6 if i % 9 == 0 else rng.choice([1, 1, 2, 3, 4])):
            base[rng.randrange(len(base))] = f"x{rng.random()}"
        found.append((i * 7 % 60, " ".join(base)))
    want = components_brute(found, percent)
    got = near_duplicates(spark.createDataFrame(found, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 2 < len({c for _, c in want.values()}) < 50


def lines_brute(min_docs):
    blanks = " \t\n\x0b\x0c\r"
    split = [(i, t, (t or "").split("\n")) for i, t in texts()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blanks).translate(lower)
    # Documents are told by their ids, as in the SQL.
    seen = Counter(k for k, _ in {(key(y), i) for i, _, x in split if i is not None for y in x} if k)
    out = Counter()
    for i, _, x in split:
        kept = [y for y in x if seen[key(y)] < min_docs]
        out[i, len(x), len(x) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_line_dedup(docs, none, spark, sf_small):
    for min_docs in (2, 10):
        found = apply_bitmaps(docs, drop_bitmaps(docs, min_docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
        assert Counter(map(tuple, found.collect())) == lines_brute(min_docs)
    assert drop_bitmaps(none).collect() == []
    first = {r.n_rows: r.first for r in line_counts(docs).filter("n_rows = 12").collect()}
    assert (first[12].doc_id, first[12].line) == (300, 1)
    ours = oracle.rows_of_spark(op10_line_dedup(spark, sf_small))
    assert ours == oracle.rows_of(oracle.connect(sf_small), oracles.OP10)


def test_line_dedup_of_repeated_rows(spark):
    """Ten rows of one document are one document; rows without id are none."""
    same = [(1, "Once\nmore", 7, 8)] * 10
    ten = [(i, f"  TEN \nown{i}", 7, 8) for i in range(10, 20)]
    lacking = [(i, "nine", 7, 8) for i in range(30, 39)] + [(None, "nine", 7, 8), (1, "ten", 7, 8)]
    table = spark.createDataFrame(same + ten + lacking, "doc_id long, text string, n_lines long, _mark long")
    got = apply_bitmaps(table, drop_bitmaps(table))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_text"]
    rows = sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect())
    wanted = [(1, 2, 0, "Once\nmore")] * 10 + [(i, 2, 1, f"own{i}") for i in range(10, 20)]
    wanted += [(i, 1, 0, "nine") for i in range(30, 39)] + [(0, 1, 0, "nine"), (1, 1, 1, "")]
    assert rows == sorted(wanted)


def test_quality_of_clashing_columns(spark):
    table = spark.createDataFrame([(1, "a b", 1, 2, 3)], "doc_id long, text string, score long, _model long, KEPT long")
    row = judge_quality(table, table.select("doc_id")).first()
    assert (row.doc_id, row.kept, row.base_failed, row.n_words) == (1, False, True, 2)


def test_quality(docs, none, spark):
    trusted = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    got = judge_quality(docs, trusted).collect()
    assert len(got) == len(rows())
    by = {(r.doc_id, r.text): r for r in got}
    for i, t in texts():
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
        windows = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        n, hit = Counter(windows), set()
        for j, x in enumerate(windows):
            if n[x] > 1:
                hit.update(range(j, j + 8))
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = by[i, t]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and (r.kept is False or not r.base_failed)
    assert judge_quality(none, trusted).collect() == []


def test_quality_scores_leave_the_document_out(docs, spark):
    buckets, ids = 512, set(range(40))
    long = lambda x: (x & (1 << 64) - 1).to_bytes(8, "little")
    bags = []
    for i, t in texts():
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]
        pairs = [xxhash.xxh64_intdigest(long(b), xxhash.xxh64_intdigest(long(a), 42)) for a, b in zip(h, h[1:])]
        bags.append((i, t, Counter((x - (x >> 63 << 64)) % buckets for x in [*h, *pairs])))
    raw, good = Counter(), Counter()
    for i, _, bag in bags:
        raw.update(bag)
        good.update(bag if i in ids else ())
    got = judge_quality(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long"), 0.1, buckets).collect()
    found = {(r.doc_id, r.text): r for r in got}
    learned = []
    for i, t, bag in bags:
        own = i in ids
        left, size = good.total() - own * bag.total(), bag.total()
        score = 0.0
        for b, c in bag.items():
            ratio = (good[b] - own * c) / left / ((raw[b] - c + 0.5) / (raw.total() - size + 0.5 * buckets))
            score += c * math.log((ratio + PRIOR) / (1 + PRIOR)) / size
        assert math.isclose(found[i, t].score, score, abs_tol=1e-9)
        if own and not found[i, t].base_failed:
            learned.append(math.floor(score * 1000))
    limit = np.percentile(learned, 10)
    assert 0 < sum(x < limit for x in learned) <= 0.1 * len(learned)
    assert all(r.kept == (not r.base_failed and math.floor(r.score * 1000) >= limit) for r in got)


def test_quality_model_is_no_column(docs, spark, capsys):
    """As a column the model, megabytes, would be copied for each row."""
    score_quality(docs, spark.createDataFrame([(3,)], "doc_id long")).explain()
    assert " AS _model" not in capsys.readouterr().out


def test_quality_counts_take_no_look_up_a_character(spark, capsys):
    """Characters are not looked up one after the other; the counts are those of the words and lines."""
    texts = ["a#b\u00e9 *\x0b$|\n \x0c\n\na#b\u00e9 *\x0b$|\r\n\u00a0\n", "#", "##", " ", "x\n\x1c\n\x1c", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = score_quality(docs, spark.createDataFrame([], "doc_id long"))
    found.explain()
    assert "translate(" not in capsys.readouterr().out
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) for r in found.collect()}
    want = {}
    for i, text in enumerate(t or "" for t in texts):
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i] = len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    assert got == want


def test_quality_without_trusted_documents(docs, spark):
    got = judge_quality(docs, spark.createDataFrame([], "doc_id long")).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in got)
    one = judge_quality(docs, spark.createDataFrame([(3,)], "doc_id long")).filter("doc_id = 3").first()
    assert one.score == 0


def test_repeated_words(docs, spark):
    text = "a b c d e f g h i a b c d e f g h i j"
    one = judge_quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long"))
    assert one.first().n_repeat_words == 18


def test_language(spark):
    rng = random.Random(7)
    speak = lambda s: " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(30))
    rows = [(i, speak(("the", "ing", "wh") if i % 2 else ("éau", "oir", "que")), "en" if i % 2 else "fr", i % 5 == 0) for i in range(100)]
    rows += [(200, None, "en", True), (201, "123 !!", None, True), (202, "a", "fr", False), (203, "", None, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    got = {r.doc_id: r for r in identify(docs, docs.filter("NOT held_out")).collect()}
    assert len(got) == 104 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == lang for i, _, lang, held in rows[:100] if held)
    assert [got[i].lang_pred for i in (200, 201, 203)] == ["und"] * 3
    assert {r.lang_pred for r in identify(docs, docs.filter("false")).collect()} == {"und"}


def test_language_of_rows_without_id(spark):
    """One text copied often, and rows without an id, do not swell the sample."""
    rows = [(None, f"the thing number {chr(97 + i % 26)}{chr(97 + i // 26)}", "en", False) for i in range(300)]
    rows += [(1, "le loir et la foire", "fr", False)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    got = identify(docs, docs.filter("NOT held_out"), 100000).collect()
    assert len(got) == 600 and all(r.lang_pred == ("fr" if r.doc_id else "en") for r in got)


def test_lm_scores(docs, none):
    held = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)))
    counts = Counter()
    for i, t in texts():
        if i is None or i % 7 != 2:
            counts.update([*words(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    got = score(held).collect()
    assert len(got) == len(rows())
    by = {(r.doc_id, r.n_tokens): r for r in got}
    for i, t in texts():
        w = [*words(t), b"\n"]
        r = by[i, len(w)]
        assert r.n_known == sum(counts[x] > 0 for x in w) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0 and r.spelled_score <= r.score + 1e-9
    assert score(none.withColumn("held_out", F.lit(False))).collect() == []


def test_lm_scores_do_not_depend_on_the_layout(docs, monkeypatch):
    """Rows dealt otherwise, in small blocks, and merged in small steps, score the same."""
    held = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)))
    one = {(r.doc_id, r.n_tokens): r for r in score(held.coalesce(1)).collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm_scoring, "FLUSH", 50)
    for r in score(held.repartition(5)).collect():
        assert math.isclose(r.score, one[r.doc_id, r.n_tokens].score, rel_tol=1e-9)
        assert math.isclose(r.spelled_score, one[r.doc_id, r.n_tokens].spelled_score, rel_tol=1e-9)


def test_lm_scores_hear_the_order_of_words(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    after = {w: rng.sample(vocabulary, 2) for w in vocabulary}  # each word has two that follow it
    texts = []
    for _ in range(80):
        text = [rng.choice(vocabulary)]
        while len(text) < 50:
            text.append(rng.choice(after[text[-1]]))
        texts.append(text)
    mixed = [rng.sample(t, len(t)) for t in texts[60:]]
    table = [(i, i >= 60, " ".join(t)) for i, t in enumerate([*texts, *mixed])]
    got = {r.doc_id: r for r in score(spark.createDataFrame(table, "doc_id long, held_out boolean, text string")).collect()}
    for i in range(60, 80):
        ordered, other = got[i], got[i + 20]
        assert math.isclose(ordered.base_score, other.base_score) and ordered.n_known == other.n_known
        assert ordered.score > other.score + 5 and ordered.score > ordered.base_score + 5


def test_lm_contexts_are_words(spark):
    """Each word is a context of its own, also where a short hash of words would take two for one."""
    by = defaultdict(list)
    for i in range(2000):
        by[zlib.crc32(b"u%d" % i) % 255].append(f"u{i}")
    one, other = next(words for words in by.values() if len(words) > 1)[:2]
    table = [(i, False, f"{one} left" if i % 2 else f"{other} right") for i in range(60)]
    asked = [f"{one} left", f"{one} right", f"{other} right", f"{other} left"]
    table += [(100 + i, True, text) for i, text in enumerate(asked)]
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(table, "doc_id long, held_out boolean, text string")).collect()}
    assert got[100] > got[101] + 1 and got[102] > got[103] + 1


def test_lm_probabilities_sum_to_one(spark):
    """Over all known words and the event that a word is unknown, after any context."""
    rng = random.Random(5)
    vocabulary = [b"w%d" % i for i in range(30)]
    n = {(u, w): rng.choice([0, 0, 1, 1, 2, 5, 70]) for u in [b"", *vocabulary] for w in vocabulary}
    n |= {(u, b"never"): 0 for u in [b"", *vocabulary, b"new"]} | {(b"new", w): 0 for w in vocabulary}
    pairs = spark.createDataFrame([(bytearray(u), bytearray(w), c) for (u, w), c in n.items()], "prev binary, piece binary, n long")
    sums = Counter()
    for r in lm_scoring.sampled_words(pairs).collect():
        assert r.p > 0 and (r.weight > 0) == (bytes(r.piece) != b"never")
        sums[bytes(r.prev)] += r.own
    assert len(sums) == 32 and all(math.isclose(x, 1, rel_tol=1e-6) for x in sums.values())


def test_lm_pairs_are_no_rows(spark, monkeypatch):
    """What is staged has rows for words and blocks, and none for each pair of words; tables that are done with go."""
    rng, seen, gone = random.Random(8), {}, []
    table = [(i, i % 7 == 2, " ".join(f"w{rng.randrange(500)}" for _ in range(200))) for i in range(150)]
    docs = spark.createDataFrame(table, "doc_id long, held_out boolean, text string").coalesce(2)
    staged, unstaged = lm_scoring.staged, lm_scoring.unstaged

    def counted(df, name, **options):
        found = staged(df, name, **options)
        seen[name] = max(seen.get(name, 0), found.count())
        return found

    def dropped(df):
        files = df.inputFiles()
        unstaged(df)
        gone.extend(f for f in files if os.path.exists(f.removeprefix("file://")))

    monkeypatch.setattr(lm_scoring, "staged", counted)
    monkeypatch.setattr(lm_scoring, "unstaged", dropped)
    assert len(score(docs).collect()) == 150
    assert 500 < max(seen.values()) < 10_000 and not gone


def test_differencing_looks_at_loads_only_where_windows_meet():
    """Items that do not meet yet are put side by side, whatever their number."""
    seen = 0

    class Load(int):
        def __lt__(self, other):
            nonlocal seen
            seen += 1
            return int(self) < int(other)

        def __gt__(self, other):
            nonlocal seen
            seen += 1
            return int(self) > int(other)

    sizes = [Load(1 + i % 7) for i in range(400)]
    windows = packing.differenced(sizes, 400)
    assert sorted(i for w in windows for i in w) == list(range(400)) and seen < 10 * 400


def test_leaks(docs, none, spark):
    own = {i: t for i, t in texts() if i is not None}
    passage = " ".join(own[0].split()[2:22])
    edited = passage.split()
    edited[9] = "otherword"
    items = [(1, passage.upper() if passage.isascii() else passage), (2, " ".join(edited)), (3, "nowhere at all " * 6), (4, None), (5, "")]
    got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    holders = {i for i, t in own.items() if b" ".join(plain_words(passage)) in b" ".join(plain_words(t))}
    assert {i for i, item in got if item == 1} >= holders and all(got[i, 1] == 0 for i in holders)
    assert all(got.get((i, 2)) == 1 for i in holders)
    assert not [k for k in got if k[1] > 2]
    assert find_leaks(none, spark.createDataFrame(items, "item_id long, text string")).collect() == []


@pytest.mark.parametrize("kind", ["substitutions", "insertions", "deletions", "mixed"])
def test_leaks_with_unknown_words(spark, kind):
    """All edits the distance allows, with words the benchmark does not have."""
    rng = random.Random(kind)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(15, 59))]) for i in range(60)]
    held = []
    for d in range(120):
        passage = list(items[d % 60][1])
        for k in range(len(passage) // 5):
            edit = kind if kind != "mixed" else rng.choice(["substitutions", "insertions", "deletions"])
            at = rng.randrange(len(passage))
            passage[at : at + (edit != "insertions")] = [] if edit == "deletions" else [f"unknown{d}x{k}"]
        around = [[f"around{d}x{i}" for i in range(a, a + rng.randint(0, 20))] for a in (0, 50)]
        held.append((d, around[0] + passage + around[1]))

    def distance(item, words):  # of the item to the nearest run of the words
        row = [0] * (len(words) + 1)
        for i, w in enumerate(item):
            new = [i + 1]
            for j, v in enumerate(words):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (v != w)))
            row = new
        return min(row)

    near = {}
    for d, own in held:
        for i, item in items:
            if sum((Counter(item) & Counter(own)).values()) < len(item) - len(item) // 5:
                continue  # too few words in common
            least = distance(item, own)
            if least <= len(item) // 5:
                near[d, i] = least
    assert len(near) >= 120
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in held], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in find_leaks(table, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    assert set(got) <= set(near)
    assert len(got) >= RECALL * len(near)
    assert sum(got[k] == near[k] for k in got) >= RECALL * len(got)


def test_urls(spark, sf_small):
    urls = [(1, "http://A.example.com/en/1"), (2, "https://www.example.com/en/2?x#y"), (3, "http://b.net/es/"), (4, "ftp://x.org"), (5, None), (6, "nothing"), (6, "nothing"), (7, "http://q.com"), (None, "http://z.org/a")]
    pages = spark.createDataFrame([(*u, 1, "z") for u in urls], "page_id long, url string, n long, host string")
    bad = spark.createDataFrame([(4, 1)], "page_id long, bad int")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages.drop("host"), bad).collect()), key=str)
    assert got == sorted([
        (1, "a.example.com", "/en/1", "example.com/en/", "block"), (2, "www.example.com", "/en/2", "www.example.com/en/", "allow"),
        (3, "b.net", "/es/", "net/es/", "block"), (4, "x.org", "", None, got[4][4]), (5, "", "", None, got[5][4]),
        (6, "", "", None, got[5][4]), (6, "", "", None, got[5][4]), (7, "q.com", "", None, got[-1][4]), (0, "z.org", "/a", None, got[0][4]),
    ], key=str)
    ours = oracle.rows_of_spark(op2_url_filters(spark, sf_small))
    assert ours == oracle.rows_of(oracle.connect(sf_small), oracles.OP2)


def test_a_task_has_any_number_of_blocks(spark):
    """One document a block: more blocks in a task than fit in ten bits."""
    from flawsieve.llm import pieces

    many = spark.createDataFrame([(i, f"a b{i} " * (1 + i % 400)) for i in range(1500)], "doc_id long, text string")
    rows = many.coalesce(1).select("doc_id", F.lit(True).alias("flag"), "text")
    blocks = pieces.staged_blocks(rows, lambda t: t.encode().split(), lambda t, p: len(p), "many-blocks", 1)
    assert blocks.select("block").distinct().count() == 1500
    found = pieces.sums_by_value(blocks, lambda names: [len(n) for n in names]).collect()
    wanted = {i: (1 + i % 400) * (2 + len(str(i))) for i in range(1500)}
    assert {r.doc_id: r.sums[0] for r in found} == wanted and len(found) == 1500
    whole = pieces.staged_blocks(rows, lambda t: t.encode().split(), lambda t, p: len(p), "one-block")
    assert {r.doc_id: r.sums[0] for r in pieces.sums_by_value(whole, lambda names: [len(n) for n in names]).collect()} == wanted


def test_documents_and_counts_of_any_width():
    import numpy as np

    from flawsieve.llm import pieces

    for n, count in ((3, 5), (3, 70_000), (70_000, 5), (70_000, 300)):
        codes = [np.zeros(1, np.int32)] * (n - 1) + [np.zeros(count, np.int32)]
        batches = list(pieces._block(7, {b"x": 0}, codes, list(range(n)), [True] * n, [1] * n))
        docs, counts = pieces._unpacked(batches[0].column(4)[0].as_py())
        assert docs.tolist() == list(range(n)) and counts.tolist() == [1] * (n - 1) + [count]
        assert batches[0].column(5)[0].as_py() == n - 1 + count
