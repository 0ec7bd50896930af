"""Removal of passages that repeat, by windows of words counted in super-k-mers.

Consecutive windows of a document whose smallest short word sequence, their
minimiser, is the same are sent to its bucket as one packed string, so each
word travels about three times instead of once for every window. Equal
windows have equal minimisers and meet in one bucket, where they are sorted and
counted exactly. Before that the minimisers alone are counted: a window whose
minimiser occurs once in all documents has no equal, and stays.

Which sequences are smallest is a matter of choice, so frequent ones come last:
a sketch of fixed size counts the short sequences of all documents first.
A window with anything of its own is then sent by that, and one that is frequent
through and through lies in super-k-mers that are equal wherever it occurs; these
are counted in each block of documents before they are sent, and again as
they arrive, so that no bucket holds a common passage more than once. What of a
bucket is too large for a task all the same leaves it as digests of windows,
which are counted by a grouping.

Null and empty texts, and those of fewer words than a window, lose nothing. Each row
is a document, repeated ones and those without ``doc_id`` too. Extra columns are
not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flawsieve.llm.shared import staged

WINDOW = 35
MINIMISER = 8
# Windows of one super-k-mer; longer runs are sent as several.
LONGEST = 256
BLOCK_BYTES = 4 << 20
BINS = 1 << 18
SLICE = 1 << 14
# A short sequence is frequent from this often on, and from so many times the mean of a bin.
FREQUENT, FREQUENT_TIMES = 32, 4
# Strings that a task looks at together, and of one bucket that it holds.
CHUNK_BYTES = 8 << 20
CROWDED_BYTES = 64 << 20
# Bytes of text that are hashed together.
SPAN_BYTES = 1 << 21

# The white space that ends a word.
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True

# Odd, so that they can be divided by modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """The powers of a base from 0 to ``n``, or of its inverse."""
    held = _powers.get((base, inverse))
    if held is None or len(held) <= n:
        step = np.uint64(pow(base, -1, 1 << 64) if inverse else base)
        held = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, SPAN_BYTES), step)]))
        if n <= SPAN_BYTES:
            _powers[base, inverse] = held
    return held


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    """A hash of each ``values[start:end]``, in order, by one sum over all of them."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(base, len(values))[: len(values)], dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * _power(base, len(values), True)[starts]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
    """A hash of each word of ``data``; spans of whole words are hashed together."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN_BYTES)))
        first = starts[at]
        values = data[first : ends[to - 1]].astype(np.uint64) + np.uint64(1)
        out[at:to] = _rolled(values, starts[at:to] - first, ends[at:to] - first, base)
        at = to
    return _mixed(out)


class _Words:
    """The words of a block of texts: ``data`` has them one after the other, each with one space behind it."""

    def __init__(self, texts: list[str | None]):
        parts = [(text or "").encode() for text in texts]
        raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
        gap = GAPS[raw] if len(raw) else np.zeros(0, bool)
        before = np.concatenate([[True], gap[:-1]])[: len(raw)]
        opens, closes = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.doc_starts = np.searchsorted(opens, bounds)  # first word of each text, and the end
        kept = ~(gap & before)
        self.data = raw[kept]
        self.data[gap[kept]] = 0x20
        self.ends = np.cumsum(closes - opens + 1) - 1
        self.starts = self.ends - (closes - opens)
        self.hashes = _word_hashes(self.data, self.starts, self.ends)
        n = np.diff(self.doc_starts)
        self.to_end = np.repeat(self.doc_starts[1:], n) - np.arange(len(self.starts))  # words from here on

    def short_sequences(self, length: int) -> np.ndarray:
        """A hash of the ``length`` words from each place on; those past a document's end mean nothing."""
        n = max(0, len(self.starts) - length + 1)
        out = np.zeros(n, np.uint64)
        for j in range(length):
            out = out * np.uint64(_BASES[0]) + self.hashes[j : j + n]
        return _mixed(out)


class _SuperKmers(_Words):
    """Runs of windows of one minimiser: ``first`` words, numbers of ``windows``, minimisers as ``key``."""

    def __init__(self, texts: list[str | None], levels: np.ndarray, window: int, length: int):
        super().__init__(texts)
        self.first = self.windows = np.zeros(0, np.int64)
        self.key = self.sequences = np.zeros(0, np.int64)
        self.window = window
        n = len(self.starts) - window + 1
        if n <= 0:
            return
        sequences = self.short_sequences(length)
        rank = levels[(sequences % np.uint64(len(levels))).astype(np.int64)].astype(np.uint64) << np.uint64(56)
        rank |= sequences >> np.uint64(8)
        self.sequences = rank[self.to_end[: len(rank)] >= length].view(np.int64)
        least, wide, reach = rank, 1, window - length + 1
        while 2 * wide <= reach:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < reach:
            least = np.minimum(least[: -(reach - wide)], least[reach - wide :])
        whole = self.to_end[:n] >= window
        # A run opens at a document's first window too, as the window before does not lie in one document.
        opens = whole & np.concatenate([[True], (least[1:] != least[:-1]) | ~whole[:-1]])
        run = np.cumsum(opens) - 1
        at = np.flatnonzero(whole)
        opens[at] |= (at - np.flatnonzero(opens)[run[at]]) % LONGEST == 0
        self.first = np.flatnonzero(opens)
        self.windows = np.bincount(np.cumsum(opens)[at] - 1, minlength=len(self.first))
        self.key = least[self.first].view(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The minimisers of this block, and how often each occurs in it, as one or not."""
        found, n = np.unique(self.sequences, return_counts=True)
        mine = np.unique(self.key)
        return mine, n[np.searchsorted(found, mine)]

    def strings(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[bytes, int]]:
        """The runs of these minimisers, for each the first run that is equal, and the distinct packed strings of those."""
        runs = np.flatnonzero(np.isin(self.key, keys))
        data, found = self.data.tobytes(), {}
        last = self.first[runs] + self.windows[runs] + self.window - 2
        spans = zip(runs.tolist(), self.starts[self.first[runs]].tolist(), (self.ends[last] + 1).tolist())
        place = np.fromiter((found.setdefault(data[s:e], run) for run, s, e in spans), np.int64, len(runs))
        return runs, place, found


_DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _packed(ids: list, texts: list) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], schema=_DOCS))
    return sink.getvalue().to_pybytes()


def _unpacked(docs: bytes) -> tuple[list, list]:
    table = pa.ipc.open_stream(docs).read_all()
    return table["doc_id"].to_pylist(), table["text"].to_pylist()


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, docs)``: documents in compressed blocks of bounded text, staged, so that a block stays what it is."""

    def build(batches):
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc)
                texts.append(text.as_py())
                held += len(texts[-1] or "") + 64
                if held > block_bytes:
                    yield pa.RecordBatch.from_pydict({"block": [number], "docs": [_packed(ids, texts)]})
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pydict({"block": [number], "docs": [_packed(ids, texts)]})

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, "block long, docs binary")
    return staged(rows, "texts", **{"parquet.block.size": 4 * block_bytes})


def frequency_levels(blocks: DataFrame, length: int = MINIMISER, bins: int = BINS) -> np.ndarray:
    """How frequent the short sequences of each bin are, as a small number: 0 for most, one more for each doubling.

    Counts all sequences of all documents in ``bins`` bins, whatever their number.
    """
    width = min(SLICE, bins)

    def count(batches):
        total = np.zeros(bins, np.int64)
        for batch in batches:
            for docs in batch.column(0):
                words = _Words(_unpacked(docs.as_py())[1])
                sequences = words.short_sequences(length)
                sequences = sequences[words.to_end[: len(sequences)] >= length]
                total += np.bincount((sequences % np.uint64(bins)).astype(np.int64), minlength=bins)
        if total.any():
            for i, part in enumerate(total.reshape(-1, width)):
                yield pa.RecordBatch.from_pydict({"slice": [i], "counts": [part.astype(np.int64).tobytes()]})

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for part in table["counts"]:
            total = total + np.frombuffer(part.as_py(), np.int64)
        return pa.table({"slice": table["slice"][:1], "counts": [total.tobytes()]})

    schema = "slice long, counts binary"
    counts = np.zeros((bins // width, width), np.int64)
    for row in blocks.select("docs").mapInArrow(count, schema).groupBy("slice").applyInArrow(summed, schema).collect():
        counts[row.slice] = np.frombuffer(row.counts, np.int64)  # as many numbers as there are bins
    usual = max(FREQUENT, FREQUENT_TIMES * counts.mean())
    return np.maximum(0, np.floor(np.log2(np.maximum(counts.ravel(), 1) / usual)) + 1).astype(np.uint8)


def shared_minimisers(blocks: DataFrame, levels, window: int = WINDOW, length: int = MINIMISER) -> DataFrame:
    """``(key, block)``: the minimisers of each block that occur more than once in all documents.

    A block names each of its minimisers once, so a key has at most as many rows as there are blocks.
    """

    def keys(batches):
        for batch in batches:
            for block, docs in zip(batch.column(0).to_pylist(), batch.column(1)):
                key, n = _SuperKmers(_unpacked(docs.as_py())[1], levels.value, window, length).keys()
                yield pa.RecordBatch.from_pydict({"key": key, "block": np.full(len(key), block), "n": n})

    named = blocks.select("block", "docs").mapInArrow(keys, "key long, block long, n long")
    return named.selectExpr("key", "block", "sum(n) OVER (PARTITION BY key) AS times").filter("times >= 2").drop("times")


_SUPER = pa.schema([("key", pa.int64()), ("words", pa.binary()), ("block", pa.int64()), ("place", pa.int32()), ("n", pa.int32())])


def super_kmers(blocks: DataFrame, keys: DataFrame, levels, window: int = WINDOW, length: int = MINIMISER) -> DataFrame:
    """``(key, words, block, place, n)``: each distinct super-k-mer of a block once, with its times there.

    Those of the minimisers ``keys (key, block)`` only; ``place`` is the first run of the block that has it.
    """

    def cut(blocks: pa.Table, keys: pa.Table) -> pa.Table:
        if not blocks.num_rows or not keys.num_rows:
            return _SUPER.empty_table()
        found = _SuperKmers(_unpacked(blocks["docs"][0].as_py())[1], levels.value, window, length)
        _, place, strings = found.strings(keys["key"].to_numpy())
        places, n = np.unique(place, return_counts=True)  # runs are named as they are met, so in the order of the strings
        return pa.table({
            "key": found.key[places], "words": pa.array(list(strings), pa.binary()),
            "block": np.full(len(places), blocks["block"][0].as_py()), "place": places.astype(np.int32), "n": n.astype(np.int32),
        }, schema=_SUPER)

    return blocks.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(
        cut, "key long, words binary, block long, place int, n int"
    )


# A mark of a super-k-mer: its repeated windows as bits (null: all), or one window of it that is yet to be counted.
_MARK = pa.schema([
    ("block", pa.int64()), ("place", pa.int32()), ("bits", pa.binary()),
    ("at", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("n", pa.int32()),
])
_MARKS = "block long, place int, bits binary, at int, high long, low long, n int"
_COUNTED = -1  # the block of a string all of whose windows are known to repeat


def _marks(block, place, bits=None, **window) -> pa.RecordBatch:
    n = len(block)
    columns = {"block": block, "place": place, "bits": pa.array(bits, pa.binary()) if bits is not None else None, **window}
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, f.type) if columns.get(f.name) is None else pa.array(columns[f.name]).cast(f.type) for f in _MARK], schema=_MARK
    )


class _Windows:
    """All windows of packed strings, which lie one after the other in ``data``."""

    def __init__(self, strings: pa.BinaryArray, window: int):
        offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
        self.data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        self.ends = np.flatnonzero(self.data == 0x20)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        words = np.searchsorted(self.ends, offsets - offsets[0])
        each = np.diff(words) - window + 1
        self.string = np.repeat(np.arange(len(strings)), each)
        self.at = np.arange(len(self.string)) - np.repeat(np.cumsum(each) - each, each)
        self.first = np.repeat(words[:-1], each) + self.at
        self.window = window

    def hashes(self, base: int = _BASES[0]) -> np.ndarray:
        words = _word_hashes(self.data, self.starts, self.ends, base)
        return _mixed(_rolled(words, self.first, self.first + self.window, base))

    def bytes(self, windows: np.ndarray) -> list[bytes]:
        data, first = self.data.tobytes(), self.first[windows]
        spans = zip(self.starts[first].tolist(), self.ends[first + self.window - 1].tolist())
        return [data[s:e] for s, e in spans]


def _repeated(strings: pa.BinaryArray, times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(string, repeated)`` of every window: whether it occurs again in any of the strings."""
    w = _Windows(strings, window)
    key = w.hashes()
    order = np.argsort(key, kind="stable")
    alike = key[order[1:]] == key[order[:-1]]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.concatenate([[0], ~alike])) if len(order) else 0
    shared = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else order
    # Windows of one hash are told apart by their words.
    class_of: dict[tuple[int, bytes], int] = {}
    again = [class_of.setdefault(x, len(class_of)) for x in zip(group[shared].tolist(), w.bytes(shared))]
    total = np.bincount(np.array(again, np.int64), times[w.string[shared]], len(class_of))
    repeated = np.asarray(times)[w.string] >= 2
    repeated[shared] = total[again] >= 2 if again else False
    return w.string, repeated


def _one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _count_buckets(window: int, chunk_bytes: int, crowded_bytes: int):
    def once(rows: pa.Table) -> tuple[list[pa.RecordBatch], pa.Table]:
        """Equal strings become one. Where one occurs again, all its windows do, and its rows are marked so at once."""
        key, words = rows["key"].to_numpy(), _one_array(rows["words"])
        new = np.concatenate([[True], (key[1:] != key[:-1]) | ~pc.equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)])
        string, firsts = np.cumsum(new) - 1, np.flatnonzero(new)
        times = np.add.reduceat(rows["n"].to_numpy().astype(np.int64), firsts)
        block, place = rows["block"].to_numpy(), rows["place"].to_numpy()
        again = (times[string] >= 2) & (block != _COUNTED)
        marks = [_marks(block[again], place[again])] if again.any() else []
        held = pa.table({
            "key": key[firsts], "words": words.take(pa.array(firsts)), "block": np.where(times >= 2, _COUNTED, block[firsts]),
            "place": place[firsts], "n": np.minimum(times, 2).astype(np.int32),
        }, schema=_SUPER)
        return marks, held

    def settled(held: pa.Table) -> Iterator[pa.RecordBatch]:
        """Windows of whole buckets."""
        string, again = _repeated(_one_array(held["words"]), held["n"].to_numpy(), window)
        block, place = held["block"].to_numpy(), held["place"].to_numpy()
        told = (np.bincount(string, again, held.num_rows) > 0) & (block != _COUNTED)
        bounds = np.searchsorted(string, np.arange(held.num_rows + 1))
        rows = np.flatnonzero(told)
        bits = [np.packbits(again[bounds[i] : bounds[i + 1]]).tobytes() for i in rows.tolist()]
        for a in range(0, len(rows), 10_000):
            yield _marks(block[rows[a : a + 10_000]], place[rows[a : a + 10_000]], bits[a : a + 10_000])

    def loose(held: pa.Table) -> Iterator[pa.RecordBatch]:
        """Windows of a part of a bucket, as digests of 128 bits."""
        block, place, n = held["block"].to_numpy(), held["place"].to_numpy(), held["n"].to_numpy()
        for a in range(0, held.num_rows, 1000):
            w = _Windows(_one_array(held["words"][a : a + 1000]), window)
            high, low = (w.hashes(base).view(np.int64) for base in _BASES)
            row = w.string + a
            yield _marks(block[row], place[row], at=w.at, high=high, low=low, n=n[row])

    def count(batches):
        parts, size, crowded = [], 0, None
        for batch in chain(batches, [None]):
            if batch is not None:
                parts.append(pa.Table.from_batches([batch]).cast(_SUPER))
                size += batch.nbytes
            if not parts or (batch is not None and size < chunk_bytes):
                continue
            marks, held = once(pa.concat_tables(parts))
            yield from marks
            key = held["key"].to_numpy()
            if crowded is not None:
                loose_until = int(np.searchsorted(key != crowded, True))
                if loose_until == len(key) and batch is not None:
                    loose_until -= 1  # its last string may go on
                if loose_until:
                    yield from loose(held[:loose_until])
                    held, key = held[loose_until:], key[loose_until:]
                if len(key) and key[0] != crowded:
                    crowded = None
            if batch is None:
                if held.num_rows:
                    yield from settled(held)
                return
            whole = int(np.searchsorted(key == key[-1], True)) if crowded is None else 0
            if whole:
                yield from settled(held[:whole])
                held = held[whole:]
            if held.nbytes > crowded_bytes:
                crowded = int(key[-1])
                yield from loose(held[:-1])
                held = held[-1:]
            parts, size = [pa.concat_tables([held]).combine_chunks()], 0

    return count


def repeated_windows(
    sent: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, crowded_bytes: int = CROWDED_BYTES
) -> DataFrame:
    """``(block, place, bits, at)``: the windows of super-k-mers that occur again.

    ``bits`` has one bit a window, null for all; where ``at`` is given, it is that window alone.
    """
    dealt = sent.repartition("key").sortWithinPartitions("key", "words")
    marks = staged(dealt.mapInArrow(_count_buckets(window, chunk_bytes, crowded_bytes), _MARKS), "windows")
    loose = marks.filter("at IS NOT NULL")
    again = loose.groupBy("high", "low").agg(F.sum("n").alias("times")).filter("times >= 2").drop("times")
    found = loose.filter(F.col("block") != _COUNTED).join(again, ["high", "low"], "left_semi")
    columns = ("block", "place", "bits", "at")
    return marks.filter("at IS NULL").select(*columns).unionByName(found.select(*columns))


_KEPT = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string"


def _without(levels, window: int, length: int):
    def kept(blocks: pa.Table, marks: pa.Table) -> pa.Table:
        ids, texts = _unpacked(blocks["docs"][0].as_py())
        found = _SuperKmers(texts, levels.value, window, length)
        bits_of: dict[int, np.ndarray] = {}
        most = found.windows.max(initial=0)
        for place, bits, at in zip(*(marks[name].to_pylist() for name in ("place", "bits", "at"))):
            known = bits_of.setdefault(place, np.zeros(most + 8, bool))
            if at is not None:
                known[at] = True
            elif bits is None:
                known[:] = True
            else:
                given = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
                known[: len(given)] |= given
        runs, place, _ = found.strings(found.key[np.fromiter(bits_of, np.int64, len(bits_of))])
        edges = np.zeros(len(found.starts) + 1, np.int64)
        opens = []
        for first, n, at in zip(found.first[runs].tolist(), found.windows[runs].tolist(), place.tolist()):
            if at in bits_of:
                opens.append(first + np.flatnonzero(bits_of[at][:n]))
        if opens:
            at = np.concatenate(opens)
            edges += np.bincount(at, minlength=len(edges)) - np.bincount(at + window, minlength=len(edges))
        gone = np.cumsum(edges)[:-1] > 0
        # Words with the spaces behind them; the last space of a text goes.
        stays = np.repeat(~gone, found.ends - found.starts + 1)
        left, bytes_before = found.data[stays].tobytes(), np.concatenate([[0], np.cumsum(stays)])
        word_at = np.concatenate([found.starts, [len(found.data)]])
        bounds, before = found.doc_starts, np.concatenate([[0], np.cumsum(gone)])
        out = []
        for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            n, spans = int(before[b] - before[a]), []
            if n:
                shift = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
                spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(shift == 1).tolist(), np.flatnonzero(shift == -1).tolist())]
            text = left[bytes_before[word_at[a]] : bytes_before[word_at[b]]][:-1]
            out.append((ids[i], b - a, n, spans, text.decode()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = list(zip(*out)) or [[]] * 5
        return pa.table({
            "doc_id": pa.array(columns[0], pa.int64()), "n_words": pa.array(columns[1], pa.int64()),
            "n_removed": pa.array(columns[2], pa.int64()), "removed": pa.array(columns[3], span),
            "kept_text": pa.array(columns[4], pa.string()),
        })

    return kept


def drop_repeats(
    docs: DataFrame, window: int = WINDOW, length: int = MINIMISER, block_bytes: int = BLOCK_BYTES,
    chunk_bytes: int = CHUNK_BYTES, crowded_bytes: int = CROWDED_BYTES,
) -> DataFrame:
    """``(doc_id, n_words, n_removed, removed, kept_text)`` of each of ``docs (doc_id, text)``.

    Removed are the words of every run of ``window`` words that also starts
    anywhere else; ``removed`` has them as spans of words, ``kept_text`` is the rest,
    joined by one space.
    """
    blocks = text_blocks(docs, block_bytes)
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(blocks, length))
    keys = shared_minimisers(blocks, levels, window, length)
    marks = repeated_windows(super_kmers(blocks, keys, levels, window, length), window, chunk_bytes, crowded_bytes)
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_without(levels, window, length), _KEPT)


def op12_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
