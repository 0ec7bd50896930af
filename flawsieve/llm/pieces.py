"""Sums over the pieces of each document, where a piece's value is worked out once for the corpus.

Documents are taken in blocks of bounded text. A block has one row for each of
its distinct pieces, with the documents that hold it and how often, and one
header row (piece null) with the documents themselves. The rows meet the values
by piece, and products are summed by document; no document's own sequence of
pieces is moved, and a piece met in a million documents costs one row a block.

A row of one document holds it as ``doc`` and ``n``; others hold both as packed
numbers in ``more``, in as few bytes as hold them. Rows of pieces that many
documents of a block share are salted by block, so that a piece that all
blocks have does not end in one task. A block's number is the task's, in its
upper half, and the block's within the task in its lower.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flawsieve.llm.shared import staged

BLOCK_BYTES = 32 << 20
FLUSH = 2_000_000
FREQUENT = 64
SALTS = 1024

_PIECES = pa.schema([
    ("piece", pa.binary()), ("block", pa.int64()), ("doc", pa.int32()), ("n", pa.int32()), ("more", pa.binary()),
    ("weight", pa.int64()),
])
_BLOCKS = "piece binary, block long, doc int, n int, more binary, weight long"
# Documents of a block and their counts, by the first byte of ``more``.
_WIDTHS = (("<u2", "<u1"), ("<u2", "<u4"), ("<u4", "<u1"), ("<u4", "<u4"))
# Bytes of ``more`` of a piece that FREQUENT documents of a block have.
_MANY = f"octet_length(more) >= {FREQUENT * 3}"


def _block(number, known, codes, ids, flags, sizes) -> Iterator[pa.RecordBatch]:
    n = len(ids)
    lengths = np.fromiter(map(len, codes), np.int64, n)
    key = np.concatenate(codes).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
    key, counts = np.unique(key, return_counts=True)
    code, doc = key // n, (key % n).astype(np.int32)
    starts = np.searchsorted(code, np.arange(len(known) + 1))
    counts = counts.astype(np.int32)
    learned = np.concatenate([[0], np.cumsum(counts * np.asarray(flags, bool)[doc])])
    weight = learned[starts[1:]] - learned[starts[:-1]]
    names, held = list(known), np.diff(starts)
    largest = np.maximum.reduceat(counts, starts[:-1]) if len(names) else counts
    wide = 2 * (n > 1 << 16)
    kind = wide + (largest >= 1 << 8)
    docs = doc.astype(_WIDTHS[wide][0])
    narrow, full = counts.astype("<u1"), counts.astype("<u4")
    for a in range(0, len(names), 50_000):
        s = slice(a, a + 50_000)
        first = starts[:-1][s]
        single = held[s] == 1
        more = [
            None if one else bytes((k,)) + docs[i : i + h].tobytes() + (full if k & 1 else narrow)[i : i + h].tobytes()
            for one, k, i, h in zip(single.tolist(), kind[s].tolist(), first.tolist(), held[s].tolist())
        ]
        yield pa.RecordBatch.from_arrays([
            pa.array(names[s], pa.binary()), pa.array(np.full(len(first), number)),
            pa.array(np.where(single, doc[first], 0).astype(np.int32)),
            pa.array(np.where(single, counts[first], 0).astype(np.int32)), pa.array(more, pa.binary()), pa.array(weight[s]),
        ], schema=_PIECES)
    missing = np.array([i is None for i in ids], np.int64)
    header = np.stack([[i or 0 for i in ids], missing, np.asarray(flags, np.int64), sizes]).astype(np.int64)
    yield pa.RecordBatch.from_arrays([
        pa.nulls(1, pa.binary()), pa.array([number]), pa.array([0], pa.int32()), pa.array([n], pa.int32()),
        pa.array([header.tobytes()], pa.binary()), pa.array([0]),
    ], schema=_PIECES)


def piece_blocks(docs: DataFrame, split: Callable, size: Callable, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``docs (doc_id, flag, text)``: ``split(text)`` gives a text's pieces as a list
    of bytes, ``size(text, pieces)`` a number kept for the document.

    ``weight`` of a piece row counts its occurrences in documents whose flag is true.
    """

    def build(batches):
        number = TaskContext.get().partitionId() << 32
        known, codes, ids, flags, sizes, held = {}, [], [], [], [], 0
        for batch in batches:
            for doc_id, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                found = split(text)
                codes.append(np.array([known.setdefault(p, len(known)) for p in found], np.int32))
                ids.append(doc_id)
                flags.append(bool(flag))
                sizes.append(size(text, found))
                held += len(text) + 64
                if held > block_bytes:
                    yield from _block(number, known, codes, ids, flags, sizes)
                    number += 1
                    known, codes, ids, flags, sizes, held = {}, [], [], [], [], 0
        if ids:
            yield from _block(number, known, codes, ids, flags, sizes)

    return docs.select("doc_id", "flag", "text").mapInArrow(build, _BLOCKS)


def staged_blocks(docs: DataFrame, split: Callable, size: Callable, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return staged(piece_blocks(docs, split, size, block_bytes), name)


def piece_weights(blocks: DataFrame) -> DataFrame:
    """``(piece, weight)``: every distinct piece once, with its occurrences in flagged documents."""
    return blocks.filter("piece IS NOT NULL").groupBy("piece").agg(F.sum("weight").alias("weight"))


_SUMS = "block long, docs binary, sums binary"
_WIDTH = "doc_id long, flag boolean, size long, sums array<double>"


def sums_by_value(blocks: DataFrame, value: Callable) -> DataFrame:
    """``(doc_id, flag, size, sums array<double>)`` where ``value(pieces)`` gives each piece's value.

    Rows meet by piece in one shuffle, sorted, so that a task works out each of its pieces once.
    """
    salt = F.expr(f"if(piece IS NULL OR {_MANY}, pmod(xxhash64(block), {SALTS}), 0)")
    dealt = blocks.select("piece", "block", "doc", "n", "more").repartition("piece", salt).sortWithinPartitions("piece")

    def sums(batches):
        held = _Held()
        last, last_value = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            pieces = column.dictionary_encode()
            names = pieces.dictionary.to_pylist()
            new = names[1:] if names and names[0] == last else names
            found = value(new) if new else np.zeros((0, 1))
            table = np.asarray(found, np.float64).reshape(len(new), -1)
            if len(new) < len(names):
                table = np.concatenate([last_value[None], table]) if len(new) else last_value[None]
            if names:
                last, last_value = names[-1], table[-1]
            codes = pieces.indices.fill_null(-1).to_numpy()
            rows = np.flatnonzero(codes >= 0)
            for i in np.flatnonzero(codes < 0).tolist():
                yield _batch(batch.column(1)[i].as_py(), None, batch.column(4)[i].as_py())
            yield from held.add(batch.take(pa.array(rows)), table[codes[rows]] if len(rows) else None)
        yield from held.flush()

    return _whole(dealt.mapInArrow(sums, _SUMS))


def sums_by_document(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """``(doc_id, flag, size, sums array<double>)`` from ``values (piece, value array<double>)``.

    The join is skewed by frequent pieces on one side only; adaptive execution splits it.
    """
    rows = blocks.filter("piece IS NOT NULL").select("piece", "block", "doc", "n", "more")
    joined = rows.join(values.hint("merge"), "piece").select("piece", "block", "doc", "n", "more", "value")

    def sums(batches):
        held = _Held()
        for batch in batches:
            if batch.num_rows:
                value = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield from held.add(batch, value)
        yield from held.flush()

    def headers(batches):
        for batch in batches:
            for block, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _batch(block, None, more)

    header = blocks.filter("piece IS NULL").select("block", "more").mapInArrow(headers, _SUMS)
    return _whole(joined.mapInArrow(sums, _SUMS).unionByName(header))


def _batch(block, docs, sums):
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([docs], pa.binary()), pa.array([sums], pa.binary())],
        names=["block", "docs", "sums"],
    )


def _unpacked(more: bytes):
    """Documents of a block and their counts."""
    docs, counts = _WIDTHS[more[0]]
    n = (len(more) - 1) // (int(docs[-1]) + int(counts[-1]))
    return np.frombuffer(more, docs, n, 1), np.frombuffer(more, counts, n, 1 + n * int(docs[-1]))


class _Held:
    """Products of values and counts, folded by document and handed on before they grow large."""

    def __init__(self):
        self.parts, self.size = [], 0
        self.blocks: dict[int, int] = {}  # numbered as they are met

    def add(self, batch: pa.RecordBatch, value):
        if not batch.num_rows:
            return
        blocks, place = np.unique(batch.column(1).to_numpy(), return_inverse=True)
        known = np.array([self.blocks.setdefault(b, len(self.blocks)) for b in blocks.tolist()], np.int64)
        at = (known[place] << 32) + batch.column(2).to_numpy()
        n, more = batch.column(3).to_numpy(), batch.column(4)
        single = more.is_null().to_numpy(zero_copy_only=False)
        self.parts.append((at[single], value[single] * n[single, None]))
        rows = np.flatnonzero(~single)
        if len(rows):
            packed = [_unpacked(m) for m in more.take(pa.array(rows)).to_pylist()]
            lengths = np.array([len(p[0]) for p in packed])
            doc = np.concatenate([p[0] for p in packed]).astype(np.int64)
            count = np.concatenate([p[1] for p in packed])
            self.parts.append((np.repeat(at[rows], lengths) + doc, np.repeat(value[rows], lengths, axis=0) * count[:, None]))
        self.size += sum(len(p[0]) for p in self.parts[-2:])
        if self.size > FLUSH:
            self._fold()
            if self.size > FLUSH // 2:
                yield from self.flush()

    def _fold(self):
        at = np.concatenate([p[0] for p in self.parts])
        each = np.concatenate([p[1] for p in self.parts])
        found, place = np.unique(at, return_inverse=True)
        sums = np.stack([np.bincount(place, each[:, j], len(found)) for j in range(each.shape[1])], axis=1)
        self.parts, self.size = [(found, sums)], len(found)

    def flush(self):
        if self.parts:
            self._fold()
            at, sums = self.parts[0]
            block, doc = at >> 32, (at & 0xFFFFFFFF).astype(np.int32)
            numbers = list(self.blocks)
            cuts = np.flatnonzero(np.diff(block)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                if b > a:
                    yield _batch(numbers[int(block[a])], doc[a:b].tobytes(), sums[a:b].tobytes())
        self.parts, self.size, self.blocks = [], 0, {}


def _whole(parts: DataFrame) -> DataFrame:
    return parts.groupBy("block").applyInArrow(_whole_sums, _WIDTH)


def _whole_sums(table: pa.Table) -> pa.Table:
    header, parts, k = None, [], 1
    for docs, sums in zip(table["docs"].to_pylist(), table["sums"].to_pylist()):
        if docs is None:
            header = np.frombuffer(sums, np.int64).reshape(4, -1)
        else:
            doc = np.frombuffer(docs, np.int32)
            parts.append((doc, np.frombuffer(sums, np.float64).reshape(len(doc), -1)))
            k = parts[-1][1].shape[1]
    ids, missing, flags, sizes = header
    total = np.zeros((len(ids), k))
    for doc, sums in parts:
        total[doc] += sums  # a part has each document once
    offsets = pa.array(np.arange(len(ids) + 1) * k, pa.int32())
    return pa.table({
        "doc_id": pa.array(ids, pa.int64(), mask=missing.astype(bool)), "flag": pa.array(flags.astype(bool)),
        "size": pa.array(sizes), "sums": pa.ListArray.from_arrays(offsets, pa.array(total.ravel())),
    })
