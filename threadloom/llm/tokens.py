"""Sizes of texts in tokens of a public tokenizer whose vocabulary file lies outside the repository."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies on every executor; a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of the vocabulary's tokenizer. A fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in pieces. They are cut before a single space, where a token always begins, so counts don't change.
PIECE = 200_000
CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str) -> int:
    if not text:
        return 0
    n, at = 0, 0
    while len(text) - at > PIECE and (m := CUT.search(text, at + PIECE)):
        n += len(encoder(path).encode_ordinary(text[at : m.start()]))
        at = m.start()
    return n + len(encoder(path).encode_ordinary(text[at:]))


def with_tokens(df: DataFrame, text: str, columns: list[str], path: str = VOCABULARY) -> DataFrame:
    """columns and tokens: the number of tokens of the text, 0 for null and empty ones. Strings that look like special tokens are ordinary text."""
    at = df.select(*columns, df[text].alias("__text"))
    kinds = ", ".join(f"`{c}` {at.schema[c].dataType.simpleString()}" for c in columns)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = pa.array([count(t, path) for t in batch.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], n], names=[*columns, "tokens"])

    return at.mapInArrow(run, f"{kinds}, tokens long")
