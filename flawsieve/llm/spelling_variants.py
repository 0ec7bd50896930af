"""Spelling variants: rare words brought to the frequent word one edit away.

Letters are hashed to ``SYMBOLS`` symbols, which turns words into reduced words
over a tiny alphabet. The whole neighbourhood of one inserted, deleted or
replaced symbol of a reduced word is then small whatever the writing system; it
is generated for every word and joined with the reduced vocabulary, and
what meets there is verified on the words themselves.

One edit leaves the first ``GUARD`` letters of a word as they are, or the last:
the reduced words that are joined carry those letters too, which keeps words of one
reduced form from meeting all words of another. A bitmap of fixed size tells
which reduced words exist at all, so that most neighbours are not even
shuffled; where it fills up, it only lets more of them through.

A null or empty text has no words. A null ``doc_id`` is written as nothing when
words are chosen for a lost letter. Repeated rows count each for itself. Extra
columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flawsieve.llm.shared import staged

SYMBOLS = 4
GUARD = 3
BITMAP_BITS = 1 << 26
HELD_WORDS = 400_000

# What a word is made of, how many lose a letter.
LETTERS = "a-zÀ-ÿ"
ONE_IN = 31

_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEYS = "key long, word string, n long"

# Odd, so that it can be divided by modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PER_BASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """``(word, n)``: the words of ``docs (doc_id, text)``, after one in 31 (document, word) lost a letter.

    Counts are added up in each task before they are shuffled.
    """
    # A run of fewer letters cannot give a word, with or without a lost one.
    find = re.compile(f"[{LETTERS}]{{{min_length},}}").findall

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(find(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % ONE_IN == 0:
                        lost = h % len(word)
                        word = word[:lost] + word[lost + 1 :]
                        if len(word) < min_length:
                            continue
                    total[word] += n
                if len(total) > HELD_WORDS:
                    yield from _counted(total)
                    total = Counter()
        yield from _counted(total)

    words = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _counted(total: Counter):
    words, counts = list(total), list(total.values())
    for a in range(0, len(words), 50_000):
        s = slice(a, a + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(words[s], pa.string()), pa.array(counts[s], pa.int64())], schema=_WORDS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """All bits of ``x`` stirred."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Reduced:
    """Words of one length with their reduced forms, as numbers modulo 2^64: a form's
    number is the sum of its symbols, each times a power of the base. Unequal
    forms of one number would only meet in vain."""

    def __init__(self, words: list[str], symbols: int = SYMBOLS):
        length = len(words[0])
        letters = np.array(words, f"U{length}").view(np.uint32).reshape(len(words), length).astype(np.uint64)
        self.symbols, self.length = symbols, length
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length + 1, _BASE)]).astype(np.uint64))
        self.digit = _mixed(letters + np.uint64(1)) % np.uint64(symbols) + np.uint64(1)
        self.terms = self.digit * self.powers[:length]
        self.whole = self.terms.sum(axis=1, dtype=np.uint64)
        guard = min(GUARD, length)
        self.first = self._guard(letters[:, :guard], 1)
        self.last = self._guard(letters[:, length - guard :], 2)

    def _guard(self, letters: np.ndarray, side: int) -> np.ndarray:
        out = np.full(len(letters), side, np.uint64)
        for i in range(letters.shape[1]):
            out = _mixed(out * _BASE + letters[:, i])
        return out

    def own(self) -> list[np.ndarray]:
        """The keys under which a word is found: its form with its first letters, and with its last."""
        return [_mixed(self.whole + self.first), _mixed(self.whole + self.last)]

    def neighbours(self):
        """The keys of all forms one edit away, and of the form itself, with the letters the edit leaves."""
        yield from self.own()  # a letter replaced by one of its own symbol
        before = np.zeros(len(self.whole), np.uint64)
        after = self.whole.copy()
        for p in range(self.length + 1):
            guard = self.first if p >= GUARD else self.last
            for symbol in range(1, self.symbols + 1):  # inserted before place p
                yield _mixed(before + np.uint64(symbol) * self.powers[p] + after * _BASE + guard)
            if p == self.length:
                return
            term = self.terms[:, p]
            after = after - term
            yield _mixed(before + after * _PER_BASE + guard)  # deleted
            for shift in range(1, self.symbols):  # replaced by each of the other symbols
                other = (self.digit[:, p] - np.uint64(1) + np.uint64(shift)) % np.uint64(self.symbols) + np.uint64(1)
                yield _mixed(before + other * self.powers[p] + after + guard)
            before = before + term


def _by_length(batches):
    """``(words, counts)`` of one length each."""
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            step = max(1, (1 << 22) // (length * length))
            for a in range(0, len(at), step):
                rows = at[a : a + step]
                yield [words[i] for i in rows.tolist()], counts[rows]


def _key_rows(keys: np.ndarray, row: np.ndarray, words: list[str], counts: np.ndarray):
    taken = pa.array(words, pa.string()).take(pa.array(row))
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), taken, pa.array(counts[row])], names=["key", "word", "n"])


def vocabulary_keys(vocabulary: DataFrame) -> DataFrame:
    """Two rows ``(key, word, n)`` a word: its reduced form with its first and with its last letters."""

    def keys(batches):
        for words, counts in _by_length(batches):
            each = np.arange(len(words))
            for key in _Reduced(words).own():
                yield _key_rows(key, each, words, counts)

    return vocabulary.select("word", "n").mapInArrow(keys, _KEYS)


def key_bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """One bit for each value of a key modulo ``bits``, set where there is such a key.

    Tasks set slices of the bitmap, which has the same size whatever the vocabulary.
    """
    width = min(bits, 1 << 20)

    def slices(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            part = (bit // np.uint64(width)).astype(np.int64)
            for i in np.unique(part).tolist():
                held.setdefault(i, np.zeros(width, bool))[(bit[part == i] % np.uint64(width)).astype(np.int64)] = True
        for i, found in held.items():
            yield pa.RecordBatch.from_pydict({"slice": [i], "bits": [np.packbits(found).tobytes()]})

    def joined(table: pa.Table) -> pa.Table:
        either = np.frombuffer(table["bits"][0].as_py(), np.uint8)
        for other in table["bits"][1:]:
            either = either | np.frombuffer(other.as_py(), np.uint8)
        return pa.table({"slice": table["slice"][:1], "bits": [either.tobytes()]})

    schema = "slice long, bits binary"
    found = keys.select("key").mapInArrow(slices, schema).groupBy("slice").applyInArrow(joined, schema)
    bitmap = np.zeros((bits // width, width // 8), np.uint8)
    for row in found.collect():  # as many bytes as the bitmap has
        bitmap[row.slice] = np.frombuffer(row.bits, np.uint8)
    return bitmap.ravel()


def neighbour_keys(vocabulary: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``(key, word, n)`` of the whole reduced neighbourhood of each word, as far as the bitmap knows it."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(bitmap)
    bits = np.uint64(len(bitmap) * 8)

    def keys(batches):
        known = shared.value
        for words, counts in _by_length(batches):
            rows, found = [], []
            for key in _Reduced(words).neighbours():
                bit = key % bits
                hit = np.flatnonzero(known[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8)) & 1)
                rows.append(hit)
                found.append(key[hit])
            row, key = np.concatenate(rows), np.concatenate(found)
            order = np.lexsort((key, row))  # a run of equal symbols gives one neighbour several times
            row, key = row[order], key[order]
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else slice(0)
            row, key = row[first], key[first]
            for a in range(0, len(row), 50_000):
                yield _key_rows(key[a : a + 50_000], row[a : a + 50_000], words, counts)

    return vocabulary.select("word", "n").mapInArrow(keys, _KEYS)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: both directions of every two words exactly one edit apart."""
    found = vocabulary_keys(vocabulary)
    neighbours = neighbour_keys(vocabulary, key_bitmap(found))
    met = neighbours.join(found.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key")
    pairs = met.filter("levenshtein(word, near, 1) = 1").select("word", "n", "near", "near_n")
    # Some pairs meet under several forms. By word already, so that grouping by it shuffles no more.
    return pairs.repartition("word").distinct()


def spelling_forms(vocabulary: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, form, n, n_near, form_n)`` of every word of ``vocabulary (word, n)``.

    The form is the near word of largest ``n`` (ties: the smallest), where that
    is at least ``ratio`` times the word's own.
    """
    best = (
        near_words(vocabulary)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.expr("min(struct(-near_n AS less, near))").alias("best"), F.max("near_n").alias("most"))
    )
    is_form = f"best IS NOT NULL AND most >= {ratio} * n"
    return vocabulary.join(best, "word", "left").selectExpr(
        "word", f"if({is_form}, best.near, NULL) AS form", "n", "coalesce(n_near, 0L) AS n_near", f"if({is_form}, most, NULL) AS form_n"
    )


def with_roots(forms: DataFrame, ratio: int = 10) -> DataFrame:
    """``forms`` and ``root``: the last word reached from form to form.

    Counts rise ``ratio`` times from word to form, which bounds the length of a
    chain; each round doubles the part of it that is known.
    """
    links = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most, least = forms.filter("form IS NOT NULL").agg(F.max("form_n"), F.min("n")).first()
    longest = 0
    while most is not None and least * ratio ** (longest + 1) <= most:
        longest += 1
    known = 1
    while known < longest:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = staged(links.join(further, "root", "left").selectExpr("word", "coalesce(further, root) AS root"), "roots")
        known *= 2
    return forms.join(links, "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs (doc_id, text)``."""
    vocabulary = staged(word_counts(docs, min_length, min_count), "vocabulary")
    return with_roots(staged(spelling_forms(vocabulary, ratio), "forms"), ratio)


def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
