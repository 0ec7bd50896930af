"""The whole pipeline on the smallest tables."""

import corpus_pipeline
from flawsieve.llm.decontamination import plain_words


def test_pipeline(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    items = [b" ".join(plain_words(r.text)) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_small).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert 0 < docs.count() <= before.count()
    for row in docs.collect():
        text = b" " + b" ".join(plain_words(row.text)) + b" "
        assert not any(b" " + i + b" " in text for i in items)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_near_dedup_keeps_what_brute_force_keeps(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    sets = {}
    for r in docs.collect():
        words = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    kept = corpus_pipeline.near_dedup(spark, docs, sf_small)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if root[i] == i)
    assert len({find(i) for i in root}) < len(root)


def test_line_dedup_keeps_what_brute_force_keeps(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    holders = {}
    for i, text in texts:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    often = {k for k, ids in holders.items() if k and len(ids) >= 10}
    wanted = {}
    for i, text in texts:
        lines = (text or "").split("\n")
        left = [line for line in lines if key(line) not in often]
        if len(left) == len(lines):
            wanted[i] = text
        elif "\n".join(left).strip(" "):
            wanted[i] = "\n".join(left)
    kept = corpus_pipeline.line_dedup(spark, docs, sf_small)
    assert {r.doc_id: r.text for r in kept.collect()} == wanted
