"""Token counts of texts under a byte-level vocabulary of ranks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How texts are cut before pairs are merged: contractions, words, numbers, other signs, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str, pattern: str = PATTERN) -> Column:
    """The number of tokens of a text; null for null. ``path``: a file of tokens in base 64 and their ranks, readable on every executor."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path, pattern)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(encoding.encode_ordinary(t))).astype("Int64")

    return count(text)
