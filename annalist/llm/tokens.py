"""Sizes of texts in tokens of a public tokenizer.

The vocabulary is read from ``vocab`` on the executors; it is never copied into the library.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.session import ship

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE vocabularies of this family cut a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@functools.lru_cache(maxsize=2)
def encoder(vocab: str):
    import tiktoken

    with open(os.path.realpath(vocab), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(vocab), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_count(df: DataFrame, text: str, out: str = "n_tokens", vocab: str = VOCAB) -> DataFrame:
    """Adds ``out``: tokens of the whole text; 0 for null and empty texts."""

    ship(df.sparkSession)

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocab)
        for s in parts:
            yield pd.Series([len(enc.encode_ordinary(x)) if x else 0 for x in s], dtype="int64")

    return df.withColumn(out, count(F.col(text)))
