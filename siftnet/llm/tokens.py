"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern by which byte-level tokenizers of this family divide texts before they merge bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts, by the vocabulary file at ``path``: ranks (``.tiktoken``) or a serialised tokenizer (``.json``). Special tokens in a text are ordinary text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(x)) for x in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def _sizes(path: str, kept: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            out, held, size = [], [], 0
            for x in b.column("__text").to_pylist():
                held.append(x or "")
                size += len(held[-1])
                if size > 500_000:  # encodings are far larger than their texts
                    out += count(held)
                    held, size = [], 0
            out += count(held)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(out, pa.int64())], names=[*kept, "n_tokens"])

    return work


def token_sizes(df: DataFrame, text: str, kept: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns ``kept`` and ``n_tokens`` of every row; a null text has none. Texts of any length are read whole."""
    slim = df.select(*(F.col(f"`{k}`") for k in kept), F.col(f"`{text}`").alias("__text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in slim.dtypes if k != "__text") + ", n_tokens bigint"
    return slim.mapInArrow(_sizes(path, kept), schema)
