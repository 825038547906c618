"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

VOCABULARY = "byte_bpe_50k.tiktoken"


@functools.lru_cache(4)
def encoder(vocabulary: str | None = None):
    """The tokenizer of a rank file; without a path, the one of the installed vocabulary files. One per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, text: str = "text", name: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """Adds the number of tokens of each whole text; null and empty texts have 0."""

    ship(df.sparkSession)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(name, count(F.col(text)))
