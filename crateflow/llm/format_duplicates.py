"""Duplicates hidden by formatting differences.

Two records are copies when their canonical keys are equal: letters and digits only, lower case,
composed form, the two names in either order, the duration in hundredths. Hashes of the keys go into
Bloom filters of keys seen once and keys seen repeatedly, one pair per ``CHUNK`` hashes of a partition.
A filter has as many bits as the table needs, in blocks that a key's bits never leave; a chunk sends the
bits it sets, block by block, and the blocks are merged where they meet (a bit set by two chunks counts
as repeated). The merged filter of possible repeats is broadcast in slices of at most ``SLICE`` bytes, each
of which judges the rows of its blocks, so memory stays the same at any size. Only rows that it lets
through are shuffled, and are then grouped exactly. All others are singletons where they stand.

Defined cases: a record without a letter or digit in both names, or whose duration is null, NaN,
infinite or not above zero, has no key: it is a singleton. Exact copies and repeated rows are copies.
Very long names are canonicalised whole. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateflow.session import durable

#: Bits of a block of the filter, and of the filter for each row.
BLOCK_BITS = 1 << 21
BITS_PER_ROW = 32
PROBES = 3
#: Hashes that fill a pair of filters before they are sent, and bytes of the merged filter broadcast at a time.
CHUNK, SLICE = 1 << 20, 32 << 20


def canonical_text(text: str | None) -> str:
    """Letters and digits of the composed, lower-cased text."""
    if not text:
        return ""
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower())
    return text if text.isascii() and text.isalnum() else "".join(c for c in text if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd")


def canonical_key(title: str | None, artist: str | None, duration: float | None) -> str | None:
    if duration is None or not 0 < duration < float("inf"):
        return None
    a, b = canonical_text(title), canonical_text(artist)
    if not a or not b:
        return None
    if b < a:
        a, b = b, a
    return f"{a}\x1f{b}\x1f{int(np.floor(duration * 100 + 0.5))}"


def _blocks(rows: int) -> int:
    """Blocks of the filter for so many rows, without an upper bound."""
    return max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))


def _positions(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, PROBES bits of the block) of each 64-bit hash."""
    block = (hashes >> np.uint64(16)) % np.uint64(blocks)
    h = hashes * np.uint64(0x9E3779B97F4A7C15)
    h1, h2 = h >> np.uint64(40), (h >> np.uint64(8)) & np.uint64(0xFFFFFF) | np.uint64(1)
    bits = np.stack([(h1 + np.uint64(k) * h2) % np.uint64(BLOCK_BITS) for k in range(PROBES)], axis=1)
    return block.astype(np.int64), bits.astype(np.int64)


def keyed(records: DataFrame, id_col: str = "id", title: str = "title", artist: str = "artist", duration: str = "duration_sec") -> DataFrame:
    """(id, key, h): each record's canonical key and its 64-bit hash, null where it has none."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = [canonical_key(t, a, d) for t, a, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            h = [None if k is None else xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) - (1 << 63) for k in key]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.string()), pa.array(h, pa.int64())], names=["id", "key", "h"])

    cols = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(title).cast("string").alias("t"), F.col(artist).cast("string").alias("a"), F.col(duration).cast("double").alias("d"))
    return cols.mapInArrow(keys, "id bigint, key string, h bigint")


def repeat_filter(keys: DataFrame, blocks: int, chunk: int = CHUNK) -> DataFrame:
    """(block, twice): packed bits of the keys that may occur more than once; no false negatives."""

    def sent(h: np.ndarray) -> pa.RecordBatch:
        """A chunk's two filters, as the bits set in each block."""
        h, n = np.unique(h, return_counts=True)
        block, bits = _positions(h, blocks)
        order = np.argsort(block, kind="stable")
        block, bits, n = block[order], bits[order].astype("<u4"), n[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.append(first[1:], len(block))
        once = [bits[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
        twice = [bits[a:b][n[a:b] > 1].tobytes() for a, b in zip(first, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            h = b.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            held.append(h)
            n += len(h)
            if n >= chunk:
                yield sent(np.concatenate(held))
                held, n = [], 0
        if n:
            yield sent(np.concatenate(held))

    def merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
        for pdf in batches:
            for a, b in zip(pdf["once"], pdf["twice"], strict=True):
                a = np.unique(np.frombuffer(a, "<u4"))
                twice[a[once[a]]] = True
                twice[np.frombuffer(b, "<u4")] = True
                once[a] = True
        if twice.any():
            yield pd.DataFrame({"block": [key[0]], "twice": [zlib.compress(np.packbits(twice).tobytes(), 1)]})

    return keys.select("h").mapInArrow(local, "block bigint, once binary, twice binary").groupBy("block").applyInPandas(merge, "block bigint, twice binary")


def slices(sizes: list[tuple[int, int]], blocks: int, most: int) -> list[tuple[int, int]]:
    """Ranges of blocks, together all, whose filters are at most ``most`` bytes (or one block); ``sizes``: (block, bytes)."""
    out, start, held = [], 0, 0
    for block, size in sorted(sizes):
        if held and held + size > most:
            out.append((start, block))
            start, held = block, 0
        held += size
    return [*out, (start, blocks)]


def possible_repeats(keys: DataFrame, rows: int, most: int = SLICE, chunk: int = CHUNK) -> DataFrame:
    """The keyed rows marked ``maybe``: false only where the key surely occurs once. ``keys`` should be cheap to read again."""
    blocks = _blocks(rows)
    merged = durable(repeat_filter(keys, blocks, chunk))
    out = None
    for low, high in slices([(r.block, r.n) for r in merged.select("block", F.octet_length("twice").alias("n")).collect()], blocks, most):
        part = {r.block: bytes(r.twice) for r in merged.where((F.col("block") >= low) & (F.col("block") < high)).collect()}
        one = keys.mapInArrow(_probe(keys.sparkSession.sparkContext.broadcast(part), blocks, low, high), "id bigint, key string, h bigint, maybe boolean")
        out = one if out is None else out.unionByName(one)
    return out


def _probe(shared, blocks: int, low: int, high: int):
    """Judges the rows whose block lies in [low, high); rows without a key go with the first block."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, np.ndarray] = {}
        for b in batches:
            h = b.column(2)
            there = ~np.asarray(h.is_null())
            block, bits = _positions(h.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), blocks)
            block = np.where(there, block, 0)
            maybe = np.zeros(len(block), bool)
            mine = (block >= low) & (block < high)
            for k in np.unique(block[mine & there]).tolist():
                if k in shared.value:
                    if k not in open_:
                        if len(open_) > 256:
                            open_.clear()
                        open_[k] = np.frombuffer(zlib.decompress(shared.value[k]), np.uint8)
                    rows = np.flatnonzero(there & (block == k))
                    at = bits[rows]
                    maybe[rows] = ((open_[k][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)
            keep = pa.array(mine)
            yield pa.RecordBatch.from_arrays([*[c.filter(keep) for c in b.columns], pa.array(maybe[mine])], names=["id", "key", "h", "maybe"])

    return probe


def marked(records: DataFrame, **columns: str) -> DataFrame:
    # records are canonicalised once
    keys = durable(keyed(records, **columns))
    return possible_repeats(keys, keys.count())


def groups(records: DataFrame, **columns: str) -> DataFrame:
    """(id, copies): one record each, the lowest id of its group, and how many copies it had."""
    rows = marked(records, **columns)
    exact = rows.where("maybe").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return rows.where("not maybe").select("id", F.lit(1).cast("bigint").alias("copies")).unionByName(exact.select("id", "copies"))


def pairs(records: DataFrame, **columns: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of copies.

    Rows are shuffled by key, the join is split where a key is hot (adaptive skew join).
    """
    rows = marked(records, **columns).where("maybe").select("id", "key").distinct()
    size = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    both = rows.join(size, "key")
    a, b = both.select("key", F.col("id").alias("id_a")), both.select("key", F.col("id").alias("id_b"))
    return a.join(b, "key").where("id_a < id_b").select("id_a", "id_b")
