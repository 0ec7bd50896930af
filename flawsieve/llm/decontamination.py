"""Benchmark decontamination: passages of documents within a small edit distance of an item.

Texts are words: ASCII lower-cased, ASCII punctuation taken for blanks. A passage
leaks an item of n words if some run of the document's words is within
``percent`` / 100 * n word edits of it (rounded down).

Item-sized windows start at every word. An edit spoils one word and two pairs of
neighbours at most, so a window with too few of the benchmark's words or pairs
is near to no item and is passed over, which loses none. The others are embedded by CGK random walks, which turn edit distance into
Hamming distance: step j writes the word under the pointer, and moves the
pointer by a random bit of (j, word); words the benchmark does not have move it too. Half of the walks go backwards from the
window's end, and tables sample the first third, the first two thirds or all of
a walk, so that edits near one end leave some tables untouched. Tables of
sampled coordinates, over several walks, find windows that agree with an item;
their number follows from the target recall. Candidates are verified by the
exact edit distance.

The benchmark is taken in blocks of ``BLOCK_BYTES``, one scan of the documents
for each, so what is sent to the workers is bounded. Null and empty texts and
items match nothing. A repeated row gives repeated results; of repeated items
each has its own.
"""

from __future__ import annotations

import math
import string
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK_BYTES = 8 << 20
DOCUMENTS = 2048
BITS = 4
TABLES_PER_WALK = 6
RECALL = 0.99
# The share of differing coordinates at which RECALL is to be reached.
DESIGN_SHARE = 0.5
SPREAD = 1.1

_PLAIN = bytes(
    32 if chr(c) in string.punctuation else c + 32 if 65 <= c <= 90 else c for c in range(128)
) + bytes(range(128, 256))


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


def tables_for(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - DESIGN_SHARE) ** BITS))


def infix_distance(item: np.ndarray, run: np.ndarray) -> tuple[int, int]:
    """The least edit distance of ``item`` to any part of ``run``, and where that part ends."""
    m = len(run)
    row, steps = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, word in enumerate(item):
        new = np.empty(m + 1, np.int64)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (run != word), out=new[1:])
        row = np.minimum.accumulate(new - steps) + steps  # words of the run left out
    end = int(row.argmin())
    return int(row[end]), end


class LengthClass:
    """Items of nearly one length, their tables, and the search for them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int, tables: int):
        self.items, self.percent = items, percent
        lengths = [len(w) for _, w in items]
        self.low, self.high = min(lengths), max(lengths)
        self.slack = self.high * percent // 100
        edits = [n * percent // 100 for n in lengths]
        self.words = min(n - e for n, e in zip(lengths, edits))  # fewest of the benchmark's in a near window
        self.pairs = max(0, min(n - 1 - 2 * e for n, e in zip(lengths, edits)))
        self.steps = 2 * self.low
        rng = np.random.default_rng(self.low)
        self.walks = []
        for walk in range(-(-tables // TABLES_PER_WALK)):
            salts = rng.integers(0, 1 << 64, (2, self.steps), np.uint64) | np.uint64(1)  # all 64 bits: the top one decides a step
            spans = [max(self.steps * (1 + i % 3) // 3, min(self.steps, BITS)) for i in range(TABLES_PER_WALK)]
            picks = [np.sort(rng.choice(n, min(BITS, n), replace=False)) for n in spans]
            self.walks.append((1 - 2 * (walk % 2), salts, picks))
        joined = np.concatenate([np.append(w, 0) for _, w in items])
        starts = np.cumsum([0] + [n + 1 for n in lengths[:-1]])
        ends = starts + lengths
        self.tables = []
        for keys in self.keys(self.walks, joined, starts, ends):
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    @staticmethod
    def keys(walks, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Of each table of the walks: the key of each window; outside of it a window has the word 0."""
        for way, salts, picks in walks:
            at, seen, wanted = (starts if way > 0 else ends - 1).astype(np.int64), {}, {int(j) for p in picks for j in p}
            for j in range(max(wanted) + 1):
                inside = (at >= starts) & (at < ends)
                word = np.where(inside, words[np.clip(at, 0, len(words) - 1)], 0).astype(np.uint64)
                if j in wanted:
                    seen[j] = word
                at = at + way * ((word * salts[0, j] + salts[1, j]) >> np.uint64(63)).astype(np.int64)
            for pick in picks:
                key = np.zeros(len(starts), np.uint64)
                for j in pick:
                    key = (key ^ seen[int(j)]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield key

    def candidates(self, words, known, pairs, begins, ends):
        """``(first word, item)`` pairs that share a table's key; ``known`` sums words of
        the vocabulary, ``pairs`` its pairs of neighbours.

        A window starts at each word and, for the walks backwards, ends at each word.
        """
        places = np.arange(len(words))
        last = np.minimum(places + self.high + self.slack, ends)
        near = known[last] - known[:-1] >= self.words
        ahead = places[near & (pairs[np.maximum(last - 1, places)] - pairs[:-1] >= self.pairs)]
        first = np.maximum(places + 1 - self.high - self.slack, begins)
        near = known[1:] - known[first] >= self.words
        behind = places[near & (pairs[:-1] - pairs[first] >= self.pairs)]
        if not len(ahead) and not len(behind):
            return
        windows = {
            1: (ahead, np.minimum(ahead + self.high, ends[ahead])),
            -1: (np.maximum(behind + 1 - self.high, begins[behind]), behind + 1),
        }
        tables = iter(self.tables)
        for walk in self.walks:
            starts, stops = windows[walk[0]]
            for own in self.keys([walk], words, starts, stops):
                keys, order = next(tables)
                low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                for h in np.flatnonzero(high > low):
                    for o in order[low[h] : high[h]]:
                        n = len(self.items[o][1])
                        yield int(places[starts[h]]) if walk[0] > 0 else max(int(stops[h]) - n, int(begins[stops[h] - 1])), int(o)


def length_classes(items: list[tuple[int, list[bytes]]], percent: int, recall: float):
    """The vocabulary of the items, codes of their pairs of neighbours, and their length classes."""
    vocabulary: dict[bytes, int] = {}
    coded = []
    for item, words in items:
        if words:
            coded.append((item, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32)))
    coded.sort(key=lambda x: (len(x[1]), x[0]))
    groups: list[list] = []
    for item in coded:
        if groups and len(item[1]) <= SPREAD * len(groups[-1][0][1]):
            groups[-1].append(item)
        else:
            groups.append([item])
    size = len(vocabulary) + 1
    neighbours = np.unique(np.concatenate([np.zeros(0, np.int64)] + [w[:-1].astype(np.int64) * size + w[1:] for _, w in coded]))
    return vocabulary, neighbours, [LengthClass(g, percent, tables_for(recall)) for g in groups]


def _leaks(ids, texts, vocabulary, neighbours, classes, percent):
    """``(doc_id, item_id, end_word, distance)`` of the best passage for each document and item."""
    get = vocabulary.get
    coded = [np.array([get(w) or -1 - crc32(w) for w in plain_words(t)], np.int64) for t in texts]
    words = np.concatenate(coded)
    if not len(words):
        return
    ends = np.cumsum([len(c) for c in coded])
    owner = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
    end_of = ends[owner]
    begin = np.concatenate([[0], ends[:-1]])
    begin_of = begin[owner]
    known = np.concatenate([[0], np.cumsum(words > 0)])
    code = words[:-1].astype(np.int64) * (len(vocabulary) + 1) + words[1:]
    both = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0) & (owner[:-1] == owner[1:]))
    at = np.minimum(np.searchsorted(neighbours, code[both]), max(len(neighbours) - 1, 0))
    is_pair = np.zeros(len(words), np.int64)
    if len(neighbours):
        is_pair[both[neighbours[at] == code[both]]] = 1
    pairs = np.concatenate([[0], np.cumsum(is_pair)])
    for group in classes:
        best: dict[tuple[int, int], tuple[int, int]] = {}
        looked: dict[tuple[int, int], int] = {}
        for at, o in sorted(set(group.candidates(words, known, pairs, begin_of, end_of))):
            item_id, item = group.items[o]
            d = int(owner[at])
            slack = len(item) * percent // 100
            if at <= looked.get((d, o), -1) or best.get((d, o), (1,))[0] == 0:
                continue
            looked[d, o] = at + slack  # the run below holds the passages of these starts too
            a, b = max(int(begin[d]), at - slack), min(int(ends[d]), at + len(item) + 2 * slack)
            distance, end = infix_distance(item, words[a:b])
            if distance <= slack and distance < best.get((d, o), (slack + 1,))[0]:
                best[d, o] = (distance, a + end - int(begin[d]))
        for (d, o), (distance, end) in sorted(best.items()):
            yield ids[d], group.items[o][0], end, distance


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 20, recall: float = RECALL) -> DataFrame:
    """``(doc_id, item_id, end_word, distance)``: for each document and item the nearest passage,
    where it is near enough; ``docs (doc_id, text)``, ``benchmark (item_id, text)``."""
    spark = docs.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    schema = "doc_id long, item_id long, end_word long, distance long"
    found = None
    for block in range(blocks):
        own = benchmark.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = sorted((r.item_id, r.text) for r in own.filter("text IS NOT NULL AND item_id IS NOT NULL").toLocalIterator())
        sent = spark.sparkContext.broadcast([(i, plain_words(t)) for i, t in items])

        def scan(batches, sent=sent):
            vocabulary, neighbours, classes = length_classes(sent.value, percent, recall)
            for whole in batches:
                for a in range(0, whole.num_rows, DOCUMENTS):
                    part = whole.slice(a, DOCUMENTS)
                    rows = list(_leaks(part.column(0).to_pylist(), part.column(1).to_pylist(), vocabulary, neighbours, classes, percent))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[j] for r in rows], pa.int64()) for j in range(4)],
                        names=["doc_id", "item_id", "end_word", "distance"],
                    )

        one = docs.select("doc_id", "text").mapInArrow(scan, schema)
        found = one if found is None else found.unionByName(one)
    return found


def op9_benchmark_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
