"""Language identification by the nearest of several centroids for each language.

A text is a vector of hashed byte trigrams of its lower-cased letters, weighted
by term and inverse document frequency and scaled to length one. Document
frequencies are counted over all learned documents. Centroids are fitted, by
spherical k-means within each language, on a sample of about ``FIT_DOCUMENTS``
documents a language, chosen by a hash of id and text. Every document then gets the
language of the centroid of the largest cosine; a text farther from it than
nearly all of that centroid's own sample is not ``accepted``.

Null texts and texts without a letter are ``und`` with score 0, as are all
texts if nothing could be learned. Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

DIMENSIONS = 4096
CENTROIDS = 4
FIT_DOCUMENTS = 2000
ROUNDS = 10
MAX_LANGUAGES = 1000
REJECTED_SHARE = 0.01

_LETTER = regex.compile(r"\p{L}").search
# ASCII other than letters becomes a blank; bytes of longer characters stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """How often each hashed trigram comes in a text."""
    words = b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())
    data = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(DIMENSIONS, np.float32)
    code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
    return np.bincount(code >> 20, minlength=DIMENSIONS).astype(np.float32)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.stack([trigram_counts(t) for t in texts])
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def document_frequencies(learned: DataFrame) -> tuple[np.ndarray, int]:
    """Over all of ``learned (text)``; the driver gets one number for each dimension."""

    def count(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += trigram_counts(text.as_py() or "") > 0
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)), pa.array(np.append(seen, n))], names=["dim", "n"]
        )

    found = learned.select("text").mapInArrow(count, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(DIMENSIONS + 1, np.int64)
    total[found["dim"]] = found["n"]
    return total[:-1], int(total[-1])


def _fitted(sample: pd.DataFrame, idf: np.ndarray) -> pd.DataFrame:
    """Centroids of one language, and the cosine that nearly all of their sample reaches."""
    sample = sample.sort_values(["h", "text"], kind="stable")
    x = np.concatenate([vectors(list(sample.text[a : a + 256]), idf) for a in range(0, len(sample), 256)])
    centres = [x.sum(0)]
    for _ in range(min(CENTROIDS, len(x)) - 1):  # each new one starts from the text farthest from the others
        now = np.stack(centres)
        now /= np.maximum(np.linalg.norm(now, axis=1, keepdims=True), 1e-9)
        centres.append(x[np.argmin((x @ now.T).max(1))])
    centres = np.stack(centres)
    for _ in range(ROUNDS):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        nearest = (x @ centres.T).argmax(1)
        centres = np.stack([x[nearest == j].sum(0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    near = x @ centres.T
    nearest = near.argmax(1)
    reach = [float(np.quantile(near[nearest == j, j], REJECTED_SHARE)) if (nearest == j).any() else 0.0 for j in range(len(centres))]
    return pd.DataFrame({"lang": sample.lang.iloc[0], "centre": list(centres.astype(np.float32)), "reach": reach})


def fit(learned: DataFrame, fit_documents: int = FIT_DOCUMENTS):
    """``(idf, languages, centroids, reaches)`` of ``learned (doc_id, text, lang)``."""
    learned = learned.filter("lang IS NOT NULL")
    df, n = document_frequencies(learned)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    counts = learned.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # A number for each language, so that no text moves to meet it.
    rates = F.create_map(*(x for r in counts for x in (F.lit(r.lang), F.lit(fit_documents / r.n)))) if counts else None
    sample = learned.filter(share < F.try_element_at(rates, F.col("lang"))) if counts else learned.filter("false")
    # Rows without an id are drawn by their text, and copies of a text fall together, so one id or text swells no sample.
    sample = sample.select("lang", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text"))
    rows = sample.groupBy("lang").applyInPandas(
        lambda pdf: _fitted(pdf, idf), "lang string, centre array<float>, reach double"
    ).toPandas().sort_values(["lang", "reach"], kind="stable")
    centres = np.stack(rows.centre) if len(rows) else np.zeros((0, DIMENSIONS), np.float32)
    return idf, list(rows.lang), centres.astype(np.float32), rows.reach.to_numpy(float)


def identify(docs: DataFrame, learned: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """``docs (doc_id, held_out, text)`` with ``lang_pred``, ``score`` and ``accepted`` in place of the text."""
    model = docs.sparkSession.sparkContext.broadcast(fit(learned, fit_documents))

    def predict(batches):
        idf, languages, centres, reach = model.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                texts = [t or "" for t in batch.column(2).to_pylist()]
                known = np.array([bool(languages) and _LETTER(t) is not None for t in texts])
                near = vectors(texts, idf) @ centres.T if languages else np.zeros((len(texts), 1), np.float32)
                best = near.argmax(1)
                score = np.where(known, np.clip(near[np.arange(len(texts)), best], 0, 1), 0.0).astype(float)
                names = [languages[b] if k else "und" for b, k in zip(best, known)]
                accepted = known & (score >= (reach[best] if languages else 1.0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(names), pa.array(score), pa.array(accepted)],
                    names=["doc_id", "held_out", "lang_pred", "score", "accepted"],
                )

    schema = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"
    return docs.select("doc_id", "held_out", "text").mapInArrow(predict, schema)


def op5_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    return identify(docs, docs.filter("NOT held_out"))
