"""Packing of token sequences into windows by multiway differencing.

Documents are tokenized where they lie and cut there: every full window's worth
of tokens is a piece, and so is the rest. Rests are dealt into groups of
bounded size by a hash. Within a group each rest starts as a partition of its
own over all windows; the two partitions of the largest imbalance are merged
again and again, the fullest windows of the one onto the emptiest of the other
(Karmarkar and Karp). The windows end up nearly equal. Whenever one exceeds the
capacity, the window count rises and the group is dealt anew. Some rests are cut into
parts of all sizes first, so that this happens seldom.

A null or empty text is the end token alone. Repeated rows are packed each for
itself. Extra columns are not carried.
"""

from __future__ import annotations

import heapq
import itertools
import operator
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flawsieve.llm.token_counts import SPACE, tokenizer

CAPACITY = 4096
GROUP = 1024
HALVED = 4
MEMO = 600_000
# New words that the tokenizer is given as one text.
TOGETHER = 128

# Fixed value: the white space that the tokenizer's normalizer turns into one space.
GAP = re.compile(rf"[{SPACE}]+").split
SEPARATORS = re.compile(r"[\x1c-\x1f]").search
# Signs that a word may end in; after an apostrophe the tokenizer looks for what is short for a word.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_memo: dict[str, dict[str, bytes]] = {}


def stem(word: str) -> str:
    """The letters that ``word`` begins with if nothing but signs follows them, else all of it.

    The tokenizer parts letters from signs, so that the ids of both are those of ``word``. This is left to alphabets whose
    letters stay letters in every version of Unicode, in small and composed.
    """
    letters = word.rstrip(SIGNS)
    if letters.isalpha() and (letters.isascii() or max(letters) < "\u0530" and "\u0130" not in letters):
        return letters
    return word


def _coded(words: list[str], path: str) -> Iterator[tuple[str, bytes]]:
    """Each of ``words`` with its ids. Letters alone are one piece before the tokenizer looks for more, so that many
    are given to it as one text, which takes less time; they are given one by one if it finds other pieces."""
    model = tokenizer(path)
    plain, others = [], []
    for w in words:
        (plain if w.isalpha() and "\u0130" not in w else others).append(w)
    parts = [plain[a : a + TOGETHER] for a in range(0, len(plain), TOGETHER)]
    for part, e in zip(parts, model.encode_batch([" ".join(part) for part in parts], add_special_tokens=False)):
        data, pieces = array("I", e.ids).tobytes(), np.array(e.word_ids, np.int64)
        cuts = [0, *(4 * (np.flatnonzero(np.diff(pieces)) + 1)).tolist(), len(data)]
        if len(cuts) == len(part) + 1:
            for word, start, end in zip(part, cuts, cuts[1:]):
                yield word, data[start:end]
        else:
            others += part
    for word, e in zip(others, model.encode_batch_fast(others, add_special_tokens=False)):
        yield word, array("I", e.ids).tobytes()


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space before it looks for pieces, so a text's ids
    are those of its words one after the other; the ids of the first ``MEMO`` words
    and stems that a worker meets are kept for its next texts. A new word is often
    a known stem, with signs after it.
    """
    known = _memo.setdefault(path, {"": b""})
    # str.split knows the same white space but for four separators more.
    split = [GAP(text) if SEPARATORS(text) else text.split() for text in texts]
    found = [list(map(known.get, words)) for words in split]
    missing = [() if all(row) else [i for i, ids in enumerate(row) if ids is None] for row in found]
    new = list({words[i] for words, places in zip(split, missing) for i in places})
    coded, cut = {}, {}
    for word in new:
        letters = stem(word)
        if len(letters) < len(word):
            cut[word] = (letters, word[len(letters) :])
    if new:
        halves = {half for both in cut.values() for half in both}
        coded = {half: ids for half in halves if (ids := known.get(half)) is not None}
        coded |= _coded([w for w in {*new, *halves} if w not in cut and w not in coded], path)
        for word, (letters, signs) in cut.items():
            coded[word] = coded[letters] + coded[signs]
    for words, row, places in zip(split, found, missing):
        for i in places:
            row[i] = coded[words[i]]
    known.update(itertools.islice(coded.items(), max(MEMO - len(known), 0)))
    return [b"".join(row) for row in found]


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Deals items into ``k`` windows of nearly equal load: each window's items."""
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, [i])]))  # windows not named are empty
    heapq.heapify(heap)
    n = len(sizes)
    load = operator.itemgetter(0)
    while len(heap) > 1:
        spread, _, a = heapq.heappop(heap)  # the largest
        _, _, b = heap[0]
        both = len(a) + len(b) - k
        if both > 0:  # a falls, b falls: a's smallest meet b's largest
            a.sort(key=load, reverse=True)
            b.sort(key=load, reverse=True)
            met = [(x + y, p + q) for (x, p), (y, q) in zip(a[len(a) - both :], b[both - 1 :: -1])]
            a[len(a) - both :] = met
        a += b[max(both, 0) :]
        if both >= 0:
            loads = list(map(load, a))
            spread = min(loads) - max(loads) if len(a) == k else -max(loads)
        n += 1
        heapq.heapreplace(heap, (spread, n, a))
    return [w[1] for w in heap[0][2]] if heap else []


def cuts(sizes: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """``(item, start, length)`` of parts whose sizes suit differencing.

    Parts of a quarter of ``capacity`` are cut off larger items, and every ``HALVED``-th item is halved until
    what is left is small: parts of all sizes let the windows end up nearly equal.
    """
    grain, low = max(capacity // 4, 1), max(capacity // 512, 1)
    parts = []
    for i, size in enumerate(sizes):
        start = 0
        while size - start > grain:
            parts.append((i, start, grain))
            start += grain
        while i % HALVED == 0 and size - start >= 2 * low:
            length = (size - start + 1) // 2
            parts.append((i, start, length))
            start += length
        if start < size:
            parts.append((i, start, size - start))
    return parts


def packed(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of at most ``capacity``, each a list of ``(item, start, length)``.

    The parts are dealt into as many windows as could hold them, and anew into one more for as long as a window
    exceeds ``capacity``. No part is larger than a window, so a window for each part ends the search.
    """
    parts = cuts(sizes, capacity)
    lengths = [length for _, _, length in parts]
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = differenced(lengths, k)
        if all(sum(lengths[p] for p in window) <= capacity for window in windows):
            return [[parts[p] for p in sorted(window)] for window in windows if window]
        k += 1


_CUT = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("doc_tokens", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()),
])
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, and with
    ``keep_ids`` the piece's ``ids``, of every piece of ``docs (doc_id, text)``.

    ``end_id`` ends each document. No sequence holds more than ``capacity`` tokens.
    """
    groups = max(1, -(-docs.count() // GROUP))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def cut(batches):
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                texts = [t or "" for t in batch.column(2).to_pylist()]
                out = []
                for row, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), token_bytes(texts, path)):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        full = len(piece) == 4 * capacity
                        out.append((row, doc, start, len(piece) // 4, n, zlib.crc32(piece), piece if keep_ids or not full else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CUT)], schema=_CUT)

    def deal(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["row", "start"], kind="stable")
        found, sequence = [], int(pieces["group"].iloc[0]) << 32
        for p in pieces[pieces.length == capacity].itertuples():
            found.append((p.doc_id, p.start, p.length, p.crc, p.doc_tokens, sequence, 0, p.ids if keep_ids else None))
            sequence += 1
        rests = list(pieces[pieces.length < capacity].itertuples())
        for window in packed([p.length for p in rests], capacity):
            offset = 0
            for i, start, length in window:
                p = rests[i]
                ids = p.ids[4 * start : 4 * (start + length)]
                found.append((p.doc_id, p.start + start, length, zlib.crc32(ids), p.doc_tokens, sequence, offset, ids if keep_ids else None))
                offset += length
            sequence += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        out = pd.DataFrame(found, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out if keep_ids else out.drop(columns="ids")

    schema = "row long, doc_id long, start long, length long, doc_tokens long, crc long, ids binary"
    dealt = rows.mapInArrow(cut, schema).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(deal, _PIECE + (", ids binary" if keep_ids else ""))


def op6_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
