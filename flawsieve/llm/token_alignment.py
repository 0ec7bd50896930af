"""Alignment of two tokenizers' tokens over the bytes of the same texts.

A text's tokens by either tokenizer are the rows of a token-byte incidence
matrix, held as compressed sparse rows. Gustavson's row products A Bᵀ give the
overlap links: row i gathers, for each byte of token i of A, the tokens of B at
that byte, and adds up equal ones, so that an entry is the number of bytes two
tokens share. Bytes at which tokens of both end cut the text into groups; the
product of the two token-group incidence matrices gives the links of tokens
that share a group, which is their number of partners by a vector product
and the links themselves block by block of rows, as groups may be long.

How often two ids are linked is counted over the corpus. Documents are taken in
blocks of bounded text; a block's distinct pairs of ids are summed by pair,
and the sums come back to the block, not to each document.

Documents without tokens (null or empty text, or bytes that do not come back
from the tokens) have zeros and an empty digest. A repeated row, and a null
doc_id, gives a row like any other. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flawsieve.llm.shared import staged
from flawsieve.llm.token_counts import UNITS

BLOCK_BYTES = 8 << 20
BATCH_BYTES = 1 << 20
MEMO = 250_000
# Entries of a block of rows of a product.
PRODUCT_ENTRIES = 1 << 22

# No piece goes on over a space after other characters, so texts fall apart there.
PIECE_UNITS = re.compile(" +[^ ]*").findall


class Csr(NamedTuple):
    """A sparse matrix of ``len(indptr) - 1`` rows and ``width`` columns; ``data`` null stands for ones."""

    indptr: np.ndarray
    indices: np.ndarray
    width: int
    data: np.ndarray | None = None

    @property
    def height(self) -> int:
        return len(self.indptr) - 1


def token_bytes_matrix(ends: np.ndarray) -> Csr:
    """Tokens by bytes, for tokens that lie one after the other and end at ``ends``."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(n), n)


def token_groups_matrix(ends: np.ndarray, cuts: np.ndarray) -> Csr:
    """Tokens by groups: token i lies in the group that ends at the first cut not before its end."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), len(cuts))


def transposed(m: Csr) -> Csr:
    """Columns as rows, by a counting sort; of ones only."""
    row = np.repeat(np.arange(m.height), np.diff(m.indptr))
    in_order = len(m.indices) < 2 or bool((m.indices[1:] >= m.indices[:-1]).all())
    counts = np.bincount(m.indices, minlength=m.width)
    return Csr(np.concatenate([[0], np.cumsum(counts)]), row if in_order else row[np.argsort(m.indices, kind="stable")], m.height)


def product(a: Csr, b: Csr) -> Csr:
    """``a b``, both of ones: each row of ``a`` gathers the rows of ``b`` that its columns name."""
    brought = np.diff(b.indptr)[a.indices]
    total = int(brought.sum())
    row = np.repeat(np.repeat(np.arange(a.height), np.diff(a.indptr)), brought)
    if total == len(brought) and (brought == 1).all():
        column = b.indices[b.indptr[a.indices]]
    else:
        place = np.arange(total) - np.repeat(np.cumsum(brought) - brought, brought)
        column = b.indices[np.repeat(b.indptr[a.indices], brought) + place]
    key = row * max(b.width, 1) + column
    if total > 1 and not (key[1:] >= key[:-1]).all():
        key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
    found = key[first]
    indptr = np.searchsorted(found, np.arange(a.height + 1) * max(b.width, 1))
    return Csr(indptr, found % max(b.width, 1), b.width, np.diff(np.append(first, total)))


def row_blocks(a: Csr, b: Csr, entries: int = PRODUCT_ENTRIES) -> Iterator[tuple[int, Csr]]:
    """``a b`` as ``(first row, rows)``, cut so that no block gathers more than ``entries`` beyond one row's."""
    brought = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])[a.indptr]
    at = 0
    while at < a.height:
        to = max(at + 1, int(np.searchsorted(brought, brought[at] + entries, side="right")) - 1)
        part = Csr(a.indptr[at : to + 1] - a.indptr[at], a.indices[a.indptr[at] : a.indptr[to]], a.width)
        yield at, product(part, b)
        at = to


def common_cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    return np.intersect1d(a_ends, b_ends, assume_unique=True)


class _Coder:
    """Ids of whole texts, unit by unit; those of the first ``MEMO`` units met are kept."""

    def __init__(self, units, encode, token_bytes: list[bytes]):
        self.units, self.encode, self.bytes = units, encode, token_bytes
        self.lengths = np.array([len(t) for t in token_bytes], np.int64)
        digits = np.zeros((2, len(token_bytes), 1 + len(str(max(len(token_bytes) - 1, 1)))), np.uint8)
        for i in range(len(token_bytes)):
            text = str(i).encode()
            digits[:, i, : len(text)] = np.frombuffer(text, np.uint8)
            digits[:, i, len(text)] = ord(",")
        self.digits = digits
        self.known: dict[str, bytes | None] = {}

    def ids(self, texts: list[str]) -> list[bytes | None]:
        """Unsigned 32-bit ids of each text; null where its bytes do not come back."""
        known = self.known
        split = [self.units(text) for text in texts]
        new = list({u for units in split for u in units if u not in known})
        for unit, ids in zip(new, self.encode(new) if new else ()):
            back = b"".join([self.bytes[i] for i in ids])
            known[unit] = np.array(ids, "<u4").tobytes() if back == unit.encode() else None
        found = []
        for units in split:
            parts = list(map(known.__getitem__, units))
            found.append(None if None in parts else b"".join(parts))
        if len(known) > MEMO:
            for unit in new[MEMO - len(known) :]:
                del known[unit]
        return found


def _byte_level(path: str) -> _Coder:
    """A byte-level tokenizer's JSON. A unit is a word with the space before it, or white space."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    tokens = [b""] * model.get_vocab_size()
    for token, i in model.get_vocab().items():
        tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return _Coder(UNITS, lambda units: [e.ids for e in model.encode_batch_fast(units, add_special_tokens=False)], tokens)


def _pieces(path: str) -> _Coder:
    """A model of pieces, which puts the space before a text itself. A unit is spaces and what follows up to the next."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search("[^▁]▁", name) for name in names):
        raise ValueError("a piece goes on over a space, so texts cannot be cut there")
    tokens = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    space = [model.piece_to_id("▁")]  # a text of nothing has no piece, not even for the space put before it

    def encode(units: list[str]) -> list[list[int]]:
        return [ids or space for ids in model.encode([u[1:] for u in units], num_threads=1)]

    return _Coder(PIECE_UNITS, encode, tokens)


_loaded: dict[str, _Coder] = {}


def _coder(path: str) -> _Coder:
    if path not in _loaded:
        _loaded[path] = _pieces(path) if path.endswith(".model") else _byte_level(path)
    return _loaded[path]


class _Aligned(NamedTuple):
    """Texts aligned together, one after the other; only those with tokens."""

    text: np.ndarray  # places of the texts that have tokens
    a_ids: np.ndarray
    b_ids: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_from: np.ndarray  # first token of each text, and the end
    b_from: np.ndarray


def _aligned(texts: list[str | None], a: _Coder, b: _Coder) -> _Aligned:
    spaced = [" " + text if text else "" for text in texts]
    both = [(i, x, y) for i, (x, y) in enumerate(zip(a.ids(spaced), b.ids(spaced))) if x and y]
    a_ids = np.frombuffer(b"".join([x for _, x, _ in both]), "<u4")
    b_ids = np.frombuffer(b"".join([y for _, _, y in both]), "<u4")
    a_from, b_from = (np.concatenate([[0], np.cumsum([len(e[k]) // 4 for e in both], dtype=np.int64)]) for k in (1, 2))
    return _Aligned(
        np.array([i for i, _, _ in both], np.int64), a_ids, b_ids,
        np.cumsum(a.lengths[a_ids]), np.cumsum(b.lengths[b_ids]), a_from, b_from,
    )


def overlap_links(x: _Aligned) -> Csr:
    return product(token_bytes_matrix(x.a_ends), transposed(token_bytes_matrix(x.b_ends)))


def _written(x: _Aligned, a: _Coder, b: _Coder, cuts: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> list[str]:
    """The digest of each text's groups, written ``a1,a2|b1;a3|b2,b3``."""
    width = max(a.digits.shape[2], b.digits.shape[2]) + 1
    rows = np.zeros((len(x.a_ids) + len(x.b_ids), width), np.uint8)
    # In order of groups, and of A's tokens before B's within a group.
    per_a, per_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
    a_row = np.arange(len(x.a_ids)) + (np.cumsum(per_b) - per_b)[a_group]
    b_row = np.arange(len(x.b_ids)) + np.cumsum(per_a)[b_group]
    for coder, ids, row, group, mark in ((a, x.a_ids, a_row, a_group, "|"), (b, x.b_ids, b_row, b_group, ";")):
        digits = coder.digits[0][ids]
        last = np.concatenate([group[1:] != group[:-1], [True]])
        digits[last] = np.where(digits[last] == ord(","), ord(mark), digits[last])
        rows[row, : digits.shape[1]] = digits
    flat = rows.ravel()
    held = flat != 0
    length = held.reshape(rows.shape).sum(axis=1)
    bytes_, ends = flat[held].tobytes(), np.concatenate([[0], np.cumsum(length)])
    bounds = ends[x.a_from + x.b_from].tolist()
    return [hashlib.sha256(bytes_[s : e - 1]).hexdigest() for s, e in zip(bounds, bounds[1:])]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_shared_links")
_PART = pa.schema([
    ("block", pa.int64()), ("docs", pa.binary()), ("missing", pa.binary()), ("counts", pa.binary()), ("digests", pa.binary()),
    ("keys", pa.binary()), ("weights", pa.binary()), ("starts", pa.binary()), ("places", pa.binary()), ("times", pa.binary()),
])
_PARTS = ", ".join(f"{f.name} {'long' if f.name == 'block' else 'binary'}" for f in _PART)


class _Block:
    """Documents and their distinct pairs of ids, of about ``BLOCK_BYTES`` of text."""

    def __init__(self, n_b: int):
        self.n_b, self.ids, self.digests = n_b, [], []
        self.counts, self.pairs = [], []

    def add(self, ids: list, texts: list, a: _Coder, b: _Coder) -> None:
        first, n = len(self.ids), len(texts)
        self.ids += ids
        counts, digests = np.zeros((len(_COUNTS), n), np.int64), [""] * n
        x = _aligned(texts, a, b)
        if len(x.text):
            links = overlap_links(x)
            cuts = common_cuts(x.a_ends, x.b_ends)
            a_groups, b_groups = token_groups_matrix(x.a_ends, cuts), token_groups_matrix(x.b_ends, cuts)
            group_ends = np.searchsorted(cuts, x.a_ends[x.a_from[1:] - 1], side="right")
            # Partners of each token of A in its group: the product of the group matrices, times ones.
            partners = np.bincount(b_groups.indices, minlength=len(cuts))[a_groups.indices]
            at = x.a_from[:-1]
            counts[:, x.text] = [
                np.diff(x.a_from), np.diff(x.b_from), np.diff(group_ends, prepend=0),
                np.diff(links.indptr[x.a_from]), np.add.reduceat(partners, at),
            ]
            for i, digest in zip(x.text.tolist(), _written(x, a, b, cuts, a_groups.indices, b_groups.indices)):
                digests[i] = digest
            key = np.repeat(x.a_ids.astype(np.int64), np.diff(links.indptr)) * self.n_b + x.b_ids[links.indices]
            text = np.repeat(x.text, counts[3, x.text])
            space = len(a.bytes) * self.n_b
            both, times = np.unique(text * space + key, return_counts=True)
            self.pairs.append((both // space + first, both % space, times.astype(np.int32)))
        self.counts.append(counts)
        self.digests += digests

    def row(self, number: int) -> pa.RecordBatch:
        empty = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        doc, key, times = (np.concatenate(c) for c in zip(*(self.pairs or empty)))
        keys, places = np.unique(key, return_inverse=True)
        weights = np.zeros(len(keys), np.int64)
        np.add.at(weights, places, times)
        starts = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        cells = [
            np.array([i or 0 for i in self.ids], np.int64), np.array([i is None for i in self.ids], np.uint8),
            np.concatenate(self.counts, axis=1), np.array(self.digests, "S64"),
            keys, weights, starts.astype(np.int64), places.astype(np.int32), times,
        ]
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], schema=_PART)


def _batches(texts: list[str | None]) -> Iterator[slice]:
    held, start = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "") + 64
        if held > BATCH_BYTES:
            yield slice(start, i + 1)
            held, start = 0, i + 1
    if start < len(texts):
        yield slice(start, len(texts))


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of documents, with all that takes the texts."""

    def build(batches):
        a, b = _coder(path_a), _coder(path_b)
        number, block, held = TaskContext.get().partitionId() << 32, _Block(len(b.bytes)), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _batches(texts):
                block.add(ids[part], texts[part], a, b)
                held += sum(len(t or "") + 64 for t in texts[part])
                if held > block_bytes:
                    yield block.row(number)
                    number, block, held = number + 1, _Block(len(b.bytes)), 0
        if block.ids:
            yield block.row(number)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, _PARTS)


_PAIR = pa.schema([("block", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])


def _block_pairs(batches):
    for batch in batches:
        for block, keys, weights in zip(*(batch.column(i).to_pylist() for i in range(3))):
            keys, weights = np.frombuffer(keys, np.int64), np.frombuffer(weights, np.int64)
            for a in range(0, len(keys), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys[s]), block)), pa.array(keys[s]), pa.array(weights[s])], schema=_PAIR
                )


def id_pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """``(key, n, best)`` of every pair of ids that is linked anywhere: its links, and
    whether they are the most of all pairs of its B id. ``key`` is ``a * n_b + b``."""
    pairs = blocks.select("block", "keys", "weights").mapInArrow(_block_pairs, "block long, key long, n long")
    counts = pairs.groupBy("key").agg(F.sum("n").alias("n"))
    return counts.selectExpr("key", "n", f"n = max(n) OVER (PARTITION BY key % {n_b}) AS best")


_ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
    " groups_sha256 string, n_shared_links long"
)


def _summed(blocks: pa.Table, values: pa.Table) -> pa.Table:
    block = {name: blocks[name][0].as_py() for name in blocks.column_names}
    ids, counts = np.frombuffer(block["docs"], np.int64), np.frombuffer(block["counts"], np.int64)
    missing = np.frombuffer(block["missing"], np.uint8).astype(bool)
    counts = dict(zip(_COUNTS, counts.reshape(len(_COUNTS), len(ids))))
    starts = np.frombuffer(block["starts"], np.int64)
    places, times = np.frombuffer(block["places"], np.int32), np.frombuffer(block["times"], np.int32).astype(np.int64)
    order = np.argsort(values["key"].to_numpy())  # the block's keys, in the order of its places
    n, best = values["n"].to_numpy()[order], values["best"].to_numpy()[order].astype(np.int64)

    def by_document(each: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(each)])
        return sums[starts[1:]] - sums[starts[:-1]]

    digests = [d.decode() for d in np.frombuffer(block["digests"], "S64").tolist()]
    return pa.table({
        "doc_id": pa.array(ids, mask=missing), **{name: counts[name] for name in _COUNTS[:4]},
        "n_best": by_document(times * best[places]) if len(n) else np.zeros(len(ids), np.int64),
        "count_sum": by_document(times * n[places]) if len(n) else np.zeros(len(ids), np.int64),
        "groups_sha256": pa.array(digests, pa.string()), "n_shared_links": counts["n_shared_links"],
    })


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each of ``docs (doc_id, text)``: its tokens, groups, links, and their counts in the corpus.

    ``path_a`` names a byte-level tokenizer's JSON or a model of pieces
    (``.model``), and so does ``path_b``; both see the text after a space.
    """
    blocks = staged(aligned_blocks(docs, path_a, path_b, block_bytes), "aligned")
    n_b = len(_coder(path_b).bytes)
    pairs = blocks.select("block", "keys", "weights").mapInArrow(_block_pairs, "block long, key long, n long")
    values = pairs.select("block", "key").join(id_pair_counts(blocks, n_b).hint("merge"), "key")
    parts = blocks.drop("keys", "weights")
    return parts.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_summed, _ALIGNED)


_LINKS = "doc_id long, a_at long, b_at long, a_id int, b_id int, n_bytes long"


def document_links(docs: DataFrame, path_a: str, path_b: str, by_group: bool = False) -> DataFrame:
    """Every link of two tokens of ``docs``: their places, ids and the bytes they share.

    With ``by_group`` the links of tokens of one group instead; ``n_bytes`` is
    then null. Rows come in blocks of bounded size, however long a group is.
    """

    def links(batches):
        a, b = _coder(path_a), _coder(path_b)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _aligned([text], a, b)
                if not len(x.text):
                    continue
                if by_group:
                    cuts = common_cuts(x.a_ends, x.b_ends)
                    left, right = token_groups_matrix(x.a_ends, cuts), transposed(token_groups_matrix(x.b_ends, cuts))
                else:
                    left, right = token_bytes_matrix(x.a_ends), transposed(token_bytes_matrix(x.b_ends))
                for first, found in row_blocks(left, right):
                    row = first + np.repeat(np.arange(found.height), np.diff(found.indptr))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([doc] * len(row), pa.int64()), "a_at": row, "b_at": found.indices,
                        "a_id": x.a_ids[row].astype(np.int32), "b_id": x.b_ids[found.indices].astype(np.int32),
                        "n_bytes": pa.nulls(len(row), pa.int64()) if by_group else found.data,
                    })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(links, _LINKS)


def op13_token_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
