"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A file of byte-level BPE ranks (base64 bytes and rank, one a line); the folder must be the same on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The public split pattern that belongs to these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict = {}


def tokenizer_of(spark: SparkSession) -> str:
    """The file of ranks that the session names in ``ferrule.tokenizer.path``, else ``TOKENIZER``; every executor reads it under this path."""
    return spark.conf.get("ferrule.tokenizer.path", TOKENIZER)


def encoding(path: str):
    """The tokenizer of ``path``, loaded once per process."""
    import base64

    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_sizes(documents: DataFrame, keep: list[str], text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and n_tokens, the token count of the whole text; null and empty texts have 0."""
    schema = documents.select(*keep).schema.simpleString()[7:-1]
    fields = documents.select(*keep).schema.names

    def count(batches):
        import tiktoken  # noqa: F401

        tokenizer = encoding(path)
        for batch in batches:
            sizes = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch["__text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in fields], pa.array(sizes, pa.int64())], names=[*fields, "n_tokens"])

    return documents.select(*keep, documents[text].alias("__text")).mapInArrow(count, f"{schema}, n_tokens long")
