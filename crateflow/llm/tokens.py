"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file (base64 token, rank per line); another path can be passed everywhere.
RANKS = os.environ.get("CRATEFLOW_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(ranks: str = RANKS):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("crateflow", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def sized(documents: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", ranks: str = RANKS) -> DataFrame:
    """(id, source, h, tokens): every document's size, and a hash of its id that orders its source's queue.

    Null and empty texts have size 0. A null source is a source of its own, named ''.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for b in batches:
            n = [len(enc.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64())], names=["id", "source", "h", "tokens"])

    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.xxhash64(F.col(id_col).cast("bigint")).alias("h"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(count, "id bigint, source string, h bigint, tokens bigint")
