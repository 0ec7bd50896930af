"""Token counts of documents without their token ids.

Byte-level pre-tokens never cross the start of a run of white space, so a text
falls into units (a word with the space before it, or white space on its own)
that are made of whole pre-tokens. The units' frequencies by document are dealt
out by unit; the task that has a unit gives it to the tokenizer once, joins the
count to all its frequencies, and sums by document.

Null and empty texts count zero tokens. A repeated row gives a repeated result.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from flawsieve.llm.pieces import piece_blocks, sums_by_value

# Fixed value: the white space of the tokenizer's own pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall

_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, loaded once for each worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def unit_splitter(special: list[str]):
    """Splits a text into units; a special string in it is a unit of its own."""
    apart = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split

    def split(text: str) -> list[bytes]:
        if not any(s in text for s in special):
            return [u.encode() for u in UNITS(text)]
        found = []
        for i, part in enumerate(apart(text)):
            found += [part.encode()] if i % 2 else [u.encode() for u in UNITS(part)]
        return found

    return split


def count_tokens(docs: DataFrame, path: str, max_tokens: int) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of ``docs (doc_id, text)``.

    ``path`` names the JSON of a byte-level tokenizer without normalizer and
    without a space put before the text.
    """
    model = tokenizer(path)
    special = [t.content for t in model.get_added_tokens_decoder().values()]
    split = unit_splitter(special)
    rows = docs.select("doc_id", F.lit(False).alias("flag"), "text")
    blocks = piece_blocks(rows, split, lambda text, _: len(text.encode()))

    def lengths(units: list[bytes]):
        found = tokenizer(path).encode_batch([u.decode() for u in units], add_special_tokens=False)
        return [len(e) for e in found]

    n_tokens = F.coalesce(F.element_at("sums", 1), F.lit(0.0)).cast("long")
    return sums_by_value(blocks, lengths).select(
        "doc_id", F.col("size").alias("n_bytes"), n_tokens.alias("n_tokens"), (n_tokens > max_tokens).alias("over_limit")
    )


def op1_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)
