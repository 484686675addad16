"""Helpers shared by the training-data operators: staging, sizing and byte hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import staging
from ..operators.staging import scratch, small, small_batches, stage_dir, staged, table_bytes, unstage  # noqa: F401

#: Texts become Python objects and arrays in slices of about so many bytes.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, made from names."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        c = next(x for x in itertools.chain([n], (f"{n}_{i}" for i in itertools.count(1))) if x.lower() not in have)
        have.add(c.lower())
        out.append(c)
    return out


# ---------------------------------------------------------------- vectorised hashing of UTF-8 text

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed * 1_000_003)) * U(0x9E3779B97F4A7C15)) | U(1)


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = seeds(7, 256)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hash(data: np.ndarray, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Sums of table[byte] * base**-position, modulo 2**64, and the powers of base: data[s:e] hashes to (P[e]-P[s]) * base**s."""
    inv = pow(base, -1, 1 << 64)
    down = powers(inv, len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * down, out=out[1:])
    return out, powers(base, len(data) + 1)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space."""
    ink = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of data, and the words' starts. Works through long data piece by piece, cut at white space."""
    parts, lo = [], 0
    while True:
        hi = min(lo + SLICE_BYTES, len(data))
        while hi < len(data) and not _SPACE[data[hi]]:  # to the end of the word
            gap = np.flatnonzero(_SPACE[data[hi : hi + SLICE_BYTES]])
            hi = hi + int(gap[0]) if len(gap) else min(hi + SLICE_BYTES, len(data))
        piece = data[lo:hi]
        s, e = words(piece)
        if len(s):
            p, up = prefix_hash(piece)
            parts.append((mix((p[e] - p[s]) * up[s]), s + lo))
        if hi >= len(data):
            break
        lo = hi
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def concat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts joined by line ends, and where each begins (and, last, the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return data, at


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words of each text (of all its words, if it has fewer), and where each text's begin (last: the end).

    A text without words has none. Words are separated by ASCII white space; their order and repeats count.
    """
    data, at = concat(texts)
    h, s = word_hashes(data)
    first = np.searchsorted(s, at)
    n = np.diff(first)
    m = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(m, out=begin[1:])
    doc = np.repeat(np.arange(len(texts)), m)
    word = first[:-1][doc] + (np.arange(begin[-1]) - begin[:-1][doc])
    out = np.zeros(begin[-1], dtype=np.uint64)
    left = first[1:][doc] - word
    for k, c in enumerate(seeds(11, width)):
        inside = left > k
        out += np.where(inside, h[np.minimum(word + k, max(len(h) - 1, 0))] * c if len(h) else U(0), U(0))
    return mix(out), begin


def chunks(sizes: np.ndarray, limit: int):
    """Ranges (i, j) of consecutive items whose sizes add to about limit, one item at least."""
    i = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def slices(values: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges (i, j) of an array of binary values of about ``limit`` bytes together, one value at least, with the values (null: empty): only
    they become Python objects."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    for i, j in chunks(sizes, SLICE_BYTES if limit is None else limit):
        yield i, j, [b"" if x is None else x for x in values.slice(i, j - i).to_pylist()]


#: Groups with more than 1/HOT_SHARE of all rows are looked up by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 256


def lookup(rows: DataFrame, groups: DataFrame, on: list[str], count: str) -> DataFrame:
    """rows, left joined to groups on the columns ``on``; groups has each key once and says in ``count`` how many rows have it.

    A table of groups whose measured bytes fit is broadcast. Beyond that the join shuffles, but for hot keys: those are
    broadcast (fewer than HOT_SHARE, by their counts), and their rows, as well as rows with a null key, are dealt out
    evenly. Null keys match nothing. No column of rows may have the name of a column of groups outside ``on``.
    """
    values = [c for c in groups.columns if c not in on]
    if table_bytes(groups) <= staging.BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), on, "left")
    least = groups.agg(F.sum(count)).first()[0] / HOT_SHARE
    salt, hot, rest = fresh(rows.join(groups.limit(0), on, "left"), "salt", "hot", "rest")
    packed = lambda name: groups.select(*on, F.struct(*values).alias(name))
    out = rows.join(F.broadcast(packed(hot).where(F.col(f"{hot}.{count}") > least)), on, "left")
    done = F.col(hot).isNotNull()
    for c in on:
        done |= F.col(c).isNull()
    out = out.withColumn(salt, F.when(done, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) + 1).otherwise(0))
    others = packed(rest).where(F.col(f"{rest}.{count}") <= least).withColumn(salt, F.lit(0).cast("long"))
    out = out.join(others, [*on, salt], "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(hot)[v], F.col(rest)[v]).alias(v) for v in values))
