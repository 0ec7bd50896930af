"""Scores by a hierarchical Pitman-Yor model, with seats sampled by Gibbs.

The word before is a word's context, and the beginning of a text is one. Each context has a restaurant of
the words that follow it. The base of all these is
the restaurant of words without context. Its base spells words, symbol after symbol, by restaurants for
the contexts of the last three, two, one and no symbols. A restaurant's tables are the customers of its
parent: tables of the contexts are the customers of the words' restaurant, whose tables are the words that
the spelling learns from, and contexts with one ending share their parent.

A sweep re-seats all customers of a dish in a restaurant given all other seats, at every level, and predictive
probabilities are averaged over the sweeps after the first. A pair of neighbours met once has one table in any sweep,
so that only the others are sampled. Draws follow from the dish and the sweep alone, so scores do not depend on how
rows are laid out.

Documents are taken in blocks of bounded text, and pairs are no rows: a block holds its pairs packed, in the order that follows from
its words. Packed pairs of all blocks meet by a hash of 64 bits, a part
for every ``PART_TOKENS`` of the corpus, and each block gets the sums back in its own order. Of the blocks that have a pair one owns it, samples it
and counts it. What belongs to a word or a context is a row of the words and goes to the blocks that have the word, by joins. Two pairs
whose 64 bits agree (one chance in three that there are any in 30 GB) are sampled as one; words are told apart by their bytes.

The alphabet has ``SYMBOLS`` symbols, the most frequent
bytes and one for all others (whose bytes are told apart by their frequency), so the spelling model has a
fixed size (``SYMBOLS`` to the fourth numbers), whatever the corpus. Contexts of the spelling are sampled in one
task for each last symbol.

Null and empty texts are the end alone. Nothing learned leaves the uniform
model. Null ids are held out of nothing: they are learned from. Columns other than those named are not carried.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flawsieve.llm.shared import staged, unstaged

SYMBOLS = 48
OTHER = SYMBOLS - 1
SWEEPS = 3
INNER_SWEEPS = 4
STRENGTH, DISCOUNT = 1.0, 0.5
WORD_STRENGTH = 10.0
CONTEXT_STRENGTH = 1.0
BLOCK_BYTES = 12 << 20
# Tokens of the corpus for each part that pairs of words are dealt to.
PART_TOKENS = 2_000_000
# Words that a task hands on at once.
FLUSH = 50_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ONE_BY_ONE = 32
GROWTH = 1.25

END = b"\n"  # no word: words have no white space
START = b""  # the context of a text's first word


def words_and_end(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "replace").lower().split(), END]


_BLOCK_ROWS = "block long, header binary, words binary, codes binary, tokens long"
_PAIR_ROWS = "part int, block long, keys binary, counts binary"
_SUM_ROWS = "part int, block long, totals binary, own binary, ids binary"
_SAT_ROWS = "part int, block long, sat binary"
_EDGES = "block long, n binary, prev binary, next binary, draws binary"
_COUNTED = (
    "piece binary, block long, place int, slot int, weight long, guests long, met long, single long, held long, lone long, "
    "twos long, n binary, prev array<int>, next array<int>, names array<binary>"
)
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` staged; its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return staged(df, name, compression="zstd")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    """A batch whose columns that are not named are null."""
    arrays, names = [], []
    for name, kind in (column.split() for column in schema.split(", ")):
        value = columns.get(name)
        arrays.append(pa.nulls(rows, _TYPES[kind]) if value is None else value if isinstance(value, pa.Array) else pa.array(value, _TYPES[kind]))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


_TYPES = {
    "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()), "array<double>": pa.list_(pa.float64()),
}


def _packed(counts: np.ndarray) -> bytes:
    """Counts in a byte each, large ones after them."""
    small = np.minimum(counts, 255).astype("u1")
    return np.int64(len(counts)).tobytes() + small.tobytes() + counts[small == 255].astype("<i8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    counts = np.frombuffer(data, "u1", n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", -1, 8 + n)
    return counts


def word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs (doc_id, flag, text)``, a row each: a header of the documents, the distinct words, and each
    document's words by their numbers."""

    def block(number, known, codes, ids, flags):
        lengths = list(map(len, codes))
        header = np.stack([[i or 0 for i in ids], [i is None for i in ids], flags, lengths]).astype(np.int64)
        return _batch(
            _BLOCK_ROWS, 1, block=[number], header=[header.tobytes()], words=[b" ".join(known)], codes=[np.concatenate(codes).tobytes()], tokens=[sum(lengths)]
        )

    def numbers():
        known = defaultdict()
        known.default_factory = known.__len__
        return known

    def build(batches):
        number = TaskContext.get().partitionId() << 32
        known, codes, ids, flags, held = numbers(), [], [], [], 0
        for batch in batches:
            for doc_id, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                words = words_and_end(text)
                codes.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                flags.append(bool(flag))
                held += len(text) + 64
                if held > BLOCK_BYTES:
                    yield block(number, known, codes, ids, flags)
                    number += 1
                    known, codes, ids, flags, held = numbers(), [], [], [], 0
        if ids:
            yield block(number, known, codes, ids, flags)

    return docs.select("doc_id", "flag", "text").mapInArrow(build, _BLOCK_ROWS)


class _Block:
    """A block's distinct pairs: the places of both words among ``names``, and the occurrences of each that are learned; or,
    with ``tokens``, the pair, word and document of each token."""

    def __init__(self, header: bytes, words: bytes, codes: bytes, tokens: bool = False):
        self.ids, self.missing, self.flags, self.lengths = np.frombuffer(header, np.int64).reshape(4, -1)
        self.names = [START, *words.split(b" ")]
        code = np.frombuffer(codes, np.int32).astype(np.int64) + 1
        before = np.append(0, code[:-1])
        before[np.cumsum(self.lengths) - self.lengths] = 0
        before *= len(self.names)
        before += code
        if tokens:
            self.code, self.doc = code, np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)
            pairs, self.at = np.unique(before, return_inverse=True)
        else:
            # By sorting, which takes less time here than the hash table of np.unique.
            learned = np.sort(before[np.repeat(self.flags > 0, self.lengths)])
            before.sort()
            pairs = before[np.append(True, before[1:] != before[:-1])]
            starts = np.flatnonzero(np.append(True, learned[1:] != learned[:-1])[: len(learned)])
            self.n = np.zeros(len(pairs), np.int64)
            self.n[np.searchsorted(pairs, learned[starts])] = np.diff(np.append(starts, len(learned)))
        self.prev, self.next = (pairs // len(self.names)).astype(np.int32), (pairs % len(self.names)).astype(np.int32)

    def keys(self) -> np.ndarray:
        words = pd.util.hash_array(np.array(self.names, object), categorize=False)
        keys = words[self.prev] * _ODD[0] + words[self.next]
        keys = (keys ^ (keys >> np.uint64(31))) * _ODD[1]
        return keys ^ (keys >> np.uint64(29))


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _summed(pairs: DataFrame) -> DataFrame:
    """Each block's pairs with the sums of their counts over all blocks, in the order that they came in; one of the blocks
    that have a pair owns it. Pairs with a sum above 1 have numbers in their part."""

    def add(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        cuts = np.cumsum(list(map(len, keys)))[:-1]
        keys, counts = np.concatenate(keys), np.concatenate([_unpacked(c) for c in table["counts"].to_pylist()])
        order = np.argsort(keys)
        new = np.append(True, np.diff(keys[order]) > 0)
        starts, at = np.flatnonzero(new), np.cumsum(new) - 1
        sums = np.add.reduceat(counts[order], starts)
        total, own, ids = np.empty_like(counts), np.zeros(len(keys), bool), np.empty(len(keys), np.int32)
        total[order] = sums[at]
        own[order[starts]] = True
        ids[order] = np.where(sums > 1, np.cumsum(sums > 1) - 1, -1)[at]
        return pa.table({
            "part": table["part"], "block": table["block"],
            "totals": pa.array([_packed(x) for x in np.split(total, cuts)], pa.binary()),
            "own": pa.array([np.packbits(x).tobytes() for x in np.split(own, cuts)], pa.binary()),
            "ids": pa.array([x[x >= 0].tobytes() for x in np.split(ids, cuts)], pa.binary()),
        })

    return pairs.groupBy("part").applyInArrow(add, _SUM_ROWS)


def _by_block(*tables: DataFrame):
    """Rows of several tables that belong to one block."""
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table, allowMissingColumns=True)
    return every.groupBy("block")


def _only(table: pa.Table, name: str) -> list:
    """The values of a column that has some in rows of one kind, and may be missing."""
    return table[name].drop_null().to_pylist() if name in table.column_names else []


def _in_parts(table: pa.Table, name: str) -> list[bytes]:
    """The values of a column, in the order of parts."""
    return table.select(["part", name]).filter(pc.is_valid(table[name])).sort_by("part")[name].to_pylist()


def _bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, "u1"), count=count).astype(bool)


def _counted(number, names, prev, following, total, own, weight, guests):
    """Rows of a block's words, with what it adds to them, and a row of its pairs that are met more than once.

    A pair is counted by the block that owns it. Pairs met once have one table whatever is drawn."""
    size = len(names)
    edge = own & (total > 1)
    used = np.zeros(size, bool)
    used[prev[edge]] = used[following[edge]] = True
    slot = np.cumsum(used) - 1
    sums = lambda at, which: np.bincount(at[which], minlength=size)
    met, once = own & (total > 0), own & (total == 1)
    columns = {
        "weight": weight, "guests": guests, "met": sums(following, met), "single": sums(following, once),
        "held": sums(prev, met), "lone": sums(prev, once),
    }
    for a in range(0, size, FLUSH):
        some = slice(a, a + FLUSH)
        n = len(names[some])
        yield _batch(
            _COUNTED, n, piece=names[some], block=np.full(n, number), place=np.arange(a, a + n, dtype=np.int32),
            slot=pa.array(slot[some].astype(np.int32), mask=~used[some]), **{k: v[some].astype(np.int64) for k, v in columns.items()},
        )
    if edge.any():
        named = [name for name, is_used in zip(names, used.tolist()) if is_used]
        yield _batch(
            _COUNTED, 1, block=[number], twos=[int((own & (total == 2)).sum())], n=[_packed(total[edge])], prev=_list(slot[prev[edge]].astype(np.int32)),
            next=_list(slot[following[edge]].astype(np.int32)), names=_list(pa.array(named, pa.binary())),
        )


def _list(values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _drawn(counted: DataFrame) -> DataFrame:
    """Pairs met more than once, in a row for each block, with the keys that draws follow from, those of the words of each."""

    def flat(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lists = {name: [batch[name][i].values.to_numpy().tobytes()] for name in ("prev", "next", "draws")}
                yield _batch(_EDGES, 1, block=[batch["block"][i].as_py()], n=[batch["n"][i].as_py()], **lists)

    keys = F.zip_with("prev", "next", lambda a, b: F.xxhash64(F.get("names", a), F.get("names", b))).alias("draws")
    return counted.filter("piece IS NULL").select("block", "n", "prev", "next", keys).mapInArrow(flat, _EDGES)


def _block_pairs(blocks: DataFrame, parts: int) -> DataFrame:
    """``(part, block, keys, counts)``: the distinct pairs of each block, dealt by their keys."""

    def pairs(batches):
        for batch in batches:
            for number, *data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                block = _Block(*data)
                keys = block.keys()
                part = _parts(keys, parts)
                order = np.argsort(part, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    yield _batch(_PAIR_ROWS, 1, part=[part[at[0]]], block=[number], keys=[keys[at].tobytes()], counts=[_packed(block.n[at])])

    return blocks.select("block", "header", "words", "codes").mapInArrow(pairs, _PAIR_ROWS)


def _counted_blocks(blocks: DataFrame, totals: DataFrame, parts: int) -> DataFrame:
    def count(table: pa.Table) -> pa.Table:
        block = _Block(*(_only(table, name)[0] for name in ("header", "words", "codes")))
        found = [_unpacked(t) for t in _in_parts(table, "totals")]
        total, own = np.concatenate(found), np.concatenate([_bits(o, len(t)) for o, t in zip(_in_parts(table, "own"), found)])
        order = np.argsort(_parts(block.keys(), parts), kind="stable")
        prev, following, n = (x[order] for x in (block.prev, block.next, block.n))
        size = len(block.names)
        weight, guests = (np.bincount(at, n, size).astype(np.int64) for at in (following, prev))
        number = table["block"][0].as_py()
        return pa.Table.from_batches(_counted(number, block.names, prev, following, total, own, weight, guests))

    return _written(_by_block(blocks, totals.drop("ids")).applyInArrow(count, _COUNTED), "counted")


def _words(counted: DataFrame) -> DataFrame:
    """Every word once, with what it has as a word and as a context."""
    words = counted.filter("piece IS NOT NULL").groupBy("piece").agg(*(F.sum(c).alias(c) for c in ("weight", "guests", "met", "single", "held", "lone")))
    double = lambda name, c: F.col(c).cast("double").alias(name)
    none = F.array().cast("array<double>")
    return _written(words.select(
        "piece", "weight", "guests", "met", double("single", "single"), double("lone", "lone"), double("customers", "met"), double("held", "held"),
        F.least("weight", F.lit(1)).cast("double").alias("tables"), none.alias("p"), none.alias("holds"),
    ), "words")


def uniform(keys: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers within 0 and 1 that follow from ``keys`` and ``salts``."""
    x = np.asarray(keys).astype(np.uint64)
    for salt in salts:  # a round of splitmix64 for each
        x = (x ^ np.uint64(salt)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def poisson(mean: np.ndarray, keys: np.ndarray, *salts: int) -> np.ndarray:
    """A Poisson number for each mean; large ones by the normal distribution."""
    u = uniform(keys, *salts, 1)
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniform(keys, *salts, 2))
    found = np.maximum(np.rint(mean + np.sqrt(mean) * z), 0)
    on = np.flatnonzero(mean < 32)
    share = np.exp(-mean[on])
    below, k = share.copy(), 0
    found[on] = 0
    while len(on) and k < 200:
        more = u[on] > below
        on, share, below = on[more], share[more], below[more]
        k += 1
        found[on] = k
        share = share * mean[on] / k
        below = below + share
    return found


def seated(customers: np.ndarray, fresh: np.ndarray, discount: float, keys: np.ndarray, *salts: int) -> np.ndarray:
    """Tables of each dish when its customers sit down anew.

    ``fresh`` is the weight of a new table, ``keys`` tell dishes apart. After ``ONE_BY_ONE`` customers they
    come in blocks that grow by ``GROWTH``, with a Poisson number of new tables.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    for n in range(1, ONE_BY_ONE):
        on = np.flatnonzero(customers > n)
        if not len(on):
            return tables
        p = fresh[on] / (n - discount * tables[on] + fresh[on])
        tables[on] += uniform(keys[on], *salts, n) < p
    n = float(ONE_BY_ONE)
    most = customers.max(initial=0)
    while n < most:
        on = np.flatnonzero(customers > n)
        upto = np.minimum(customers[on], np.ceil(n * GROWTH))
        held = fresh[on] - discount * tables[on]
        mean = np.maximum(fresh[on] * np.log((upto + held) / (n + held)), 0)
        tables[on] += np.minimum(poisson(np.minimum(mean, 1e9), keys[on], *salts, int(n)), upto - n)
        n = float(np.ceil(n * GROWTH))
    return np.minimum(tables, customers)


def predictive(customers, tables, parent, discount, strength):
    """Probabilities over the last axis, of restaurants whose base is ``parent``."""
    c, t = customers.sum(-1, keepdims=True), tables.sum(-1, keepdims=True)
    return (customers - discount * tables + (strength + discount * t) * parent) / (strength + c)


def sampled_spelling(counts: np.ndarray, root: np.ndarray, *salts: int) -> tuple[np.ndarray, np.ndarray]:
    """``(probabilities, tables of the last context's restaurant)`` of the contexts that end in one symbol.

    ``counts[x, y, z]``: how often z follows x, y and that symbol; ``root``: the base of all.
    """
    d, s = DISCOUNT, STRENGTH
    t3 = np.minimum(counts, 1.0)
    t2 = np.minimum(t3.sum(0), 1.0)
    t1 = np.minimum(t2.sum(0), 1.0)
    total = np.zeros_like(counts)
    k3, k2, k1 = np.arange(counts.size), np.arange(t2.size), np.arange(t1.size)
    for sweep in range(INNER_SWEEPS + 1):
        c2, c1 = t3.sum(0), t2.sum(0)
        p1 = predictive(c1, t1, root, d, s)
        p2 = predictive(c2, t2, p1, d, s)
        p3 = predictive(counts, t3, p2, d, s)
        if sweep:
            total += p3
        fresh = (s + d * t3.sum(-1, keepdims=True)) * p2
        t3 = seated(counts.ravel(), fresh.ravel(), d, k3, *salts, sweep, 3).reshape(counts.shape)
        c2 = t3.sum(0)
        t2 = np.minimum(t2, c2)
        fresh = (s + d * t2.sum(-1, keepdims=True)) * p1
        t2 = seated(c2.ravel(), fresh.ravel(), d, k2, *salts, sweep, 2).reshape(c2.shape)
        c1 = t2.sum(0)
        t1 = np.minimum(t1, c1)
        t1 = seated(c1, (s + d * t1.sum()) * root, d, k1, *salts, sweep, 1)
    return total / INNER_SWEEPS, t1


def spelled(words: list[bytes], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of (three symbols before, symbol) of all words with their ends, the bytes, and each word's start."""
    data = np.frombuffer(b" ".join([*words, b""]), np.uint8)  # a blank ends each word
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    s = symbol[data].astype(np.int64)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    blank = int(symbol[32])
    code = s.copy()
    for back, weight in ((1, SYMBOLS), (2, SYMBOLS**2), (3, SYMBOLS**3)):
        before = np.concatenate([np.full(back, blank), s[:-back]])[: len(s)]
        code += weight * np.where(place >= back, before, blank)
    return code, data, starts


def _alphabet(types: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``(symbol of each byte, probability of each byte within its symbol)``."""

    def count(batches):
        seen = np.zeros(256, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            seen += np.bincount(np.frombuffer(b" ".join([*words, b""]), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(seen)], names=["byte", "n"])

    counts = types.filter("weight > 0").select("piece").mapInArrow(count, "byte int, n long")
    rows = counts.groupBy("byte").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(256)
    n[rows["byte"].to_numpy(int)] = rows["n"].to_numpy(float)
    n[32] += 1e18  # the end of a word always has a symbol of its own
    order = np.argsort(-n, kind="stable")
    symbol, share = np.full(256, OTHER, np.int16), np.ones(256)
    symbol[order[:OTHER]] = np.arange(OTHER)
    rest = order[OTHER:]
    share[rest] = (n[rest] + 1) / (n[rest] + 1).sum()
    return symbol, share


def _spelling_model(types: DataFrame, symbol: np.ndarray, seed: int) -> np.ndarray:
    """Logarithms of the probabilities for each code of ``spelled``, sampled from ``types (piece, tables)``."""

    def count(batches):
        total = np.zeros(SYMBOLS**4)
        for batch in batches:
            words, tables = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if not words:
                continue
            code, _, starts = spelled(words, symbol)
            np.add.at(total, code, np.repeat(tables, np.diff(np.append(starts, len(code)))))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["code", "n"])

    grams = types.filter("tables > 0").select("piece", "tables").mapInArrow(count, "code int, n double")
    grams = grams.groupBy("code").agg(F.sum("n").alias("n"))
    last = F.expr(f"CAST(code div {SYMBOLS} % {SYMBOLS} AS INT)")
    grams = staged(grams.withColumn("last", last), "grams")
    root_counts = np.zeros(SYMBOLS)
    for row in grams.groupBy(F.expr(f"code % {SYMBOLS}").alias("z")).agg(F.count("*").alias("n")).collect():
        root_counts[row.z] = row.n  # as many customers as there are contexts with the symbol
    root = (root_counts + 1 / SYMBOLS) / (root_counts.sum() + 1)

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        last = int(pdf["last"].iloc[0])
        code = pdf["code"].to_numpy()
        counts = np.zeros((SYMBOLS,) * 3)
        counts[code // SYMBOLS**3, code // SYMBOLS**2 % SYMBOLS, code % SYMBOLS] = pdf["n"].to_numpy()
        p, _ = sampled_spelling(counts, root, seed, last)
        return pd.DataFrame({"last": [last], "p": [p.astype(np.float32).tobytes()]})

    model = np.broadcast_to(root.astype(np.float32), (SYMBOLS,) * 4).copy()
    for row in grams.groupBy("last").applyInPandas(sample, "last int, p binary").toLocalIterator():
        model[:, :, row.last, :] = np.frombuffer(row.p, np.float32).reshape((SYMBOLS,) * 3)
    return np.log(np.maximum(model.ravel(), 1e-30)).astype(np.float16)


def _good_turing(n1: int, n2: int) -> float:
    return min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 + n2 else 0.5


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _word_bases(words: list[bytes], model: np.ndarray, symbol: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Each word's probability by its spelling."""
    code, data, starts = spelled(words, symbol)
    return np.exp(np.add.reduceat(model[code].astype(np.float64) + np.log(share)[data], starts))


_WORDS = (
    "piece binary, weight long, guests long, single double, lone double, customers double, held double, tables double, "
    "p array<double>, holds array<double>"
)


def _based(words: DataFrame, sent, base: float, all_seats: float) -> DataFrame:
    """``words`` with ``fresh``, the weight of a new table by the word's spelling, and ``p_word``, its probability
    without context."""
    far = sent.value[-1]

    def step(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.maximum(base * _word_bases(batch["piece"].to_pylist(), *sent.value[:-1]), 1e-300)
            p = (batch["customers"].to_numpy() - far * batch["tables"].to_numpy() + fresh) / (WORD_STRENGTH + all_seats)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fresh), pa.array(p)], names=[*batch.schema.names, "fresh", "p_word"])

    return words.select(*_names(_WORDS)).mapInArrow(step, _WORDS + ", fresh double, p_word double")


def _reseated(words: DataFrame, discount: float, *salts: int) -> DataFrame:
    """``words`` with a new number of ``tables``; draws follow from the word."""

    def step(batches):
        for batch in batches:
            if batch.num_rows:
                found = seated(*(batch[name].to_numpy() for name in ("customers", "fresh")), discount, batch["key"].to_numpy(), *salts)
                yield pa.RecordBatch.from_arrays([pa.array(found) if n == "tables" else batch[n] for n in _names(_WORDS)], names=_names(_WORDS))

    return words.withColumn("key", F.xxhash64("piece")).mapInArrow(step, _WORDS)


def _seats(counted: DataFrame, sent: DataFrame, near: float, *salts: int) -> DataFrame:
    """Tables of the pairs met more than once, by block, and their sums by the words and contexts of the block.

    ``sent (piece, block, slot, p_word, room)`` is what belongs to words and contexts."""
    schema = "piece binary, seats double, seats_after double, block long, state binary"

    def seat(table: pa.Table) -> pa.Table:
        rows = table.filter(pc.is_valid(table["piece"]))
        slot = rows["slot"].to_numpy()
        p, room = np.zeros(len(slot)), np.zeros(len(slot))
        p[slot], room[slot] = rows["p_word"].to_numpy(), rows["room"].to_numpy()
        edges = table.filter(pc.is_null(table["piece"]))
        prev, following = (np.frombuffer(edges[name][0].as_py(), np.int32) for name in ("prev", "next"))
        n, draws = _unpacked(edges["n"][0].as_py()), np.frombuffer(edges["draws"][0].as_py(), np.int64)
        found = seated(n.astype(np.float64), np.maximum(room[prev] * p[following], 1e-300), near, draws, *salts)
        held = [np.bincount(at, found, len(slot))[slot] for at in (following, prev)]
        number, k = table["block"][0].as_py(), len(slot)
        return pa.Table.from_batches([
            _batch(schema, k, piece=rows["piece"].combine_chunks(), seats=held[0], seats_after=held[1], block=np.full(k, number)),
            _batch(schema, 1, block=[number], state=[_packed(found.astype(np.int64))]),
        ])

    return _written(_by_block(sent, _drawn(counted)).applyInArrow(seat, schema), "seats")


def _sampled(counted: DataFrame, sweeps: int):
    """``(words, states, left, near)`` of counted blocks: words with their ``p`` and ``holds`` of each counted sweep; tables of pairs in
    these sweeps, by block; what known words leave to unknown ones; and the discount of pairs."""
    spark = counted.sparkSession
    words = _words(counted)
    facts = counted.agg(F.coalesce(F.sum("single"), F.lit(0)).alias("n1"), F.coalesce(F.sum("twos"), F.lit(0)).alias("n2")).first()
    of_words = words.agg(F.count_if(F.col("met") == 1).alias("w1"), F.count_if(F.col("met") == 2).alias("w2")).first()
    near, far = _good_turing(facts.n1, facts.n2), _good_turing(of_words.w1, of_words.w2)
    symbol, share = _alphabet(words)
    states, left = [], []
    for sweep in range(sweeps):
        sums = words.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("tables", "customers"))).first()
        sent = spark.sparkContext.broadcast((_spelling_model(words, symbol, sweep), symbol, share, far))
        words = _instead(words, _based(words, sent, WORD_STRENGTH + far * sums[0], sums[1]))
        if sweep > 0 or sweeps == 1:
            known = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("p_word"))), F.lit(0.0))
            left.append(max(1 - words.agg(known).first()[0], 1e-12))
        if sweep < sweeps - 1:
            room = (CONTEXT_STRENGTH + near * F.col("held")).alias("room")
            asked = counted.filter("slot IS NOT NULL").select("piece", "block", "slot")
            told = _written(asked.join(words.select("piece", "p_word", room).hint("merge"), "piece"), "told")
            seats = _seats(counted, told, near, sweep, 1)
            unstaged(told)
            states.append(seats.filter("piece IS NULL").select("block", "state"))
            own = seats.filter("piece IS NOT NULL").groupBy("piece").agg(F.sum("seats").alias("seats"), F.sum("seats_after").alias("seats_after"))
            words = _instead(words, _reseated(_with_pasts(words, sweep, sweeps).join(own, "piece", "left").withColumns({
                "customers": F.col("single") + F.coalesce("seats", F.lit(0.0)), "held": F.col("lone") + F.coalesce("seats_after", F.lit(0.0)),
            }), far, sweep, 0))
    return _with_pasts(words, sweeps - 1, sweeps), states, left, near


def _with_pasts(words: DataFrame, sweep: int, sweeps: int) -> DataFrame:
    """``words`` with the figures of a counted sweep kept."""
    if sweep == 0 and sweeps > 1:
        return words
    return words.withColumns({"p": F.array_append("p", F.col("p_word")), "holds": F.array_append("holds", F.col("held"))})


def _instead(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` staged, and ``old``, which it was made from, no more."""
    new = _written(new, "words")
    unstaged(old)
    return new


def _own_seats(table: pa.Table, n: int) -> np.ndarray:
    """Tables of a block's ``n`` own pairs that are met more than once, summed over counted sweeps."""
    states = [_unpacked(s) for s in _only(table, "state")]
    return sum(states) if states else np.ones(n, np.int64)


def sampled_words(pairs: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """``pairs (prev, piece, n)``, each once, with the word's ``weight``; the averaged probability ``p`` of the word after ``prev``; and
    ``own``, which is ``p`` or, for an unknown word, the averaged probability of the event that a word is unknown."""

    def count(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                both = pa.concat_arrays([batch["prev"], batch["piece"]]).dictionary_encode()
                prev, following = np.split(both.indices.to_numpy(), 2)
                names, n = both.dictionary.to_pylist(), batch["n"].to_numpy()
                weight, guests = (np.bincount(at, n, len(names)) for at in (following, prev))
                yield from _counted(number, names, prev, following, n, np.ones(len(n), bool), weight, guests)
                number += 1

    counted = _written(pairs.select("prev", "piece", "n").mapInArrow(count, _COUNTED), "named")
    names = counted.filter("piece IS NULL").select("block", "prev", "next", "names")
    words, states, left, near = _sampled(counted, sweeps)

    def tell(table: pa.Table) -> pa.Table:
        name = pa.array(_only(table, "names")[0], pa.binary())
        prev, following = (np.array(_only(table, c)[0], np.int64) for c in ("prev", "next"))
        return pa.table({"prev": name.take(pa.array(prev)), "piece": name.take(pa.array(following)), "sat": _own_seats(table, len(prev)).astype(np.float64)})

    own = _by_block(names, *states).applyInArrow(tell, "prev binary, piece binary, sat double")
    every = pairs.join(own.hint("merge"), ["prev", "piece"], "left").join(words.select("piece", "weight", F.col("p").alias("p_words")).hint("merge"), "piece")
    every = every.join(words.select(F.col("piece").alias("prev"), "guests", "holds").hint("merge"), "prev")
    times, room = len(left), CONTEXT_STRENGTH + F.col("guests")
    sat = F.coalesce("sat", F.col("n") * F.lit(float(times)))
    of = lambda values: F.aggregate(
        F.zip_with("holds", values, lambda a, b: (CONTEXT_STRENGTH + near * a) / room * b), F.lit(0.0), lambda a, x: a + x
    )
    p, unknown = ((F.col("n") * times - near * sat) / room + of("p_words")) / times, of(F.array(*map(F.lit, left))) / times
    return every.select("prev", "piece", "weight", F.when(F.col("weight") > 0, p).otherwise(unknown).alias("own"), p.alias("p"))


def _shared_seats(totals: DataFrame, states: list[DataFrame]) -> DataFrame:
    """Tables of all pairs of each block that are met more than once: those that own them tell the others."""

    def deal(table: pa.Table) -> pa.Table:
        rows = table.filter(pc.is_valid(table["totals"])).sort_by("part")
        mine = []
        for total, own in zip(map(_unpacked, rows["totals"].to_pylist()), rows["own"].to_pylist()):
            mine.append(int((_bits(own, len(total)) & (total > 1)).sum()))
        found = np.split(_own_seats(table, sum(mine)), np.cumsum(mine)[:-1])
        return pa.table({"part": rows["part"], "block": rows["block"], "sat": pa.array(list(map(_packed, found)), pa.binary())})

    def tell(table: pa.Table) -> pa.Table:
        rows, told = (table.filter(pc.is_valid(table[c])).sort_by("block") for c in ("totals", "sat"))
        ids = [np.frombuffer(x, np.int32) for x in rows["ids"].to_pylist()]
        seats = np.zeros(max((x.max(initial=-1) for x in ids)) + 1, np.int64)
        for x, total, own, sat in zip(ids, map(_unpacked, rows["totals"].to_pylist()), rows["own"].to_pylist(), told["sat"].to_pylist()):
            seats[x[_bits(own, len(total))[total > 1]]] = _unpacked(sat)
        return pa.table({"part": rows["part"], "block": rows["block"], "sat": pa.array([_packed(seats[x]) for x in ids], pa.binary())})

    dealt = _by_block(totals.drop("ids"), *states).applyInArrow(deal, _SAT_ROWS)
    found = totals.unionByName(dealt, allowMissingColumns=True).groupBy("part").applyInArrow(tell, _SAT_ROWS)
    return _written(found, "shared-seats")


def _document_sums(blocks: DataFrame, totals: DataFrame, sats: DataFrame, told: DataFrame, left: list[float], near: float, tokens: int, parts: int) -> DataFrame:
    """``(doc_id, flag, size, own, base, known, p)``: sums over each document's words of the logarithms of ``own``, of the base, of
    known words, of the logarithms of ``p`` (see ``sampled_words``)."""
    schema = "doc_id long, flag boolean, size long, own double, base double, known long, p double"
    times = len(left)

    def score(table: pa.Table) -> pa.Table:
        block = _Block(*(_only(table, name)[0] for name in ("header", "words", "codes")), tokens=True)
        order = np.argsort(_parts(block.keys(), parts), kind="stable")
        total = np.concatenate([_unpacked(t) for t in _in_parts(table, "totals")])
        sat = total * times
        sat[total > 1] = np.concatenate([_unpacked(s) for s in _in_parts(table, "sat")] or [np.zeros(0, np.int64)])
        seen = np.empty(len(order))
        seen[order] = total * times - near * sat
        rows = table.filter(pc.is_valid(table["place"]))
        by_word = np.zeros((len(block.names), 2 + 2 * times))
        by_word[rows["place"].to_numpy()] = np.stack([rows[c].to_numpy() for c in _told_columns(times)], axis=1)
        weight, guests, words, holds = by_word[:, 0], by_word[:, 1], by_word[:, 2 : 2 + times], by_word[:, 2 + times :]
        room = CONTEXT_STRENGTH + guests
        opened = (CONTEXT_STRENGTH + near * holds) / room[:, None]
        p, unknown = seen / room[block.prev], (opened @ np.array(left) / times)[block.prev]
        for i in range(times):
            p += opened[block.prev, i] * words[block.next, i]
        p /= times
        own = np.log10(np.maximum(np.where(weight[block.next] > 0, p, unknown), 1e-300))
        n = len(block.ids)
        of = lambda values: np.bincount(block.doc, values, n)
        sums = [of(own[block.at]), of(np.log10((weight + 1) / tokens)[block.code]), of((weight > 0)[block.code]).astype(np.int64)]
        return pa.Table.from_batches([_batch(
            schema, n, doc_id=pa.array(block.ids, mask=block.missing.astype(bool)), flag=block.flags.astype(bool), size=block.lengths,
            own=sums[0], base=sums[1], known=sums[2], p=of(np.log10(np.maximum(p, 1e-300))[block.at]),
        )])

    return _by_block(blocks, totals.drop("own", "ids"), sats, told).applyInArrow(score, schema)


def _told_columns(times: int) -> list[str]:
    return ["weight", "guests", *(f"p{i}" for i in range(times)), *(f"hold{i}" for i in range(times))]


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score,
    perplexity)`` of ``docs (doc_id, held_out, text)``; the model learns from those not held out.

    ``score`` takes all unknown words for one event, ``spelled_score`` tells them apart by spelling."""
    rows = docs.select("doc_id", (~F.col("held_out")).alias("flag"), "text")
    blocks = _written(word_blocks(rows), "word-blocks")
    parts = max(1, -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // PART_TOKENS))
    totals = _written(_summed(_block_pairs(blocks, parts)), "pair-totals")
    counted = _counted_blocks(blocks, totals, parts)
    words, states, left, near = _sampled(counted, SWEEPS)
    facts = words.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n"), F.count_if(F.col("weight") > 0).alias("v")).first()
    sats = _shared_seats(totals, states)
    for state in states:
        unstaged(state)
    times = range(len(left))
    kept = words.select("piece", "weight", "guests", *(F.get("p", i).alias(f"p{i}") for i in times), *(F.get("holds", i).alias(f"hold{i}") for i in times))
    told = counted.filter("piece IS NOT NULL").select("piece", "block", "place").join(kept.hint("merge"), "piece").drop("piece")
    told = _written(told, "told")
    unstaged(counted)
    unstaged(words)
    own = F.col("own")
    return _document_sums(blocks, totals, sats, told, left, near, facts.n + facts.v + 1, parts).select(
        "doc_id", (~F.col("flag")).alias("held_out"), F.col("size").alias("n_tokens"),
        F.col("known").alias("n_known"), F.lit(facts.n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), own.alias("score"), F.col("p").alias("spelled_score"),
        F.pow(F.lit(10.0), -own / F.col("size")).alias("perplexity"),
    )


def op7_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(docs.withColumn("held_out", held_out))
