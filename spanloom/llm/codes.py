"""Vectors compressed to codes: parts of integer vectors stand for the nearest entries of trained codebooks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, staged, unstage

#: Components beyond this are not coded: sums of squared distances of any vector of up to 500 such components fit 64 bits.
LARGEST = 1 << 26
#: Vectors that are compared at a time.
ROWS = 4096
RESULTS = ("code", "error", "label_error", "codebooks_sha256")


def integer_vectors(df: DataFrame, vector: str = "embedding", scale: int = 4096) -> DataFrame:
    """df with column v_ (ints) in place of the vector: each component's floor(scale * x).

    Left out are rows whose vector is null or holds a null or non-finite component, and, as they have no code, those with a component over LARGEST
    after scaling or another number of components than most vectors have.
    """
    v = F.col(f"`{vector}`")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) > LARGEST)  # noqa: E731  infinity is larger, too
    fine = df.where(v.isNotNull()).withColumn(vector, v.cast("array<double>")).where(~F.exists(v, bad))
    ints = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    return fine.select(*(F.col(f"`{c}`") for c in df.columns if c != vector), ints.alias("v_"))


# ---------------------------------------------------------------- nearest entries behind lower bounds


def _blocks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and residual norms of n blocks of each row, and the blocks' sizes."""
    cuts = np.arange(n + 1) * x.shape[1] // n
    size = np.diff(cuts).astype(float)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    squares = np.add.reduceat(x.astype(float) ** 2, cuts[:-1], axis=1)
    return mean, np.sqrt(np.maximum(squares - size * mean**2, 0)), size


def candidates(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, entry of book) that may be nearest: no others can.

    Within a block, a distance is that of the means plus that of the residuals, and the latter is at least the difference of the residuals'
    norms. The whole part as one block filters all pairs, halves and quarters the survivors. Bounds are rounded
    down by more than the arithmetic can err, and compared with an exact distance.
    """
    norms = (x.astype(float) ** 2).sum(1), (book.astype(float) ** 2).sum(1)
    mx, rx, size = _blocks(x, 1)
    mc, rc, _ = _blocks(book, 1)
    bound = size[0] * (mx - mc[:, 0]) ** 2 + (rx - rc[:, 0]) ** 2
    upper = ((x - book[bound.argmin(1)]) ** 2).sum(1).astype(float)
    slack = 1e-6 * np.sqrt(x.shape[1]) * (norms[0][:, None] + norms[1]) + 1
    row, entry = np.nonzero(bound <= upper[:, None] + slack)
    for n in (2, 4):
        if n >= x.shape[1]:
            break
        (mx, rx, size), (mc, rc, _) = _blocks(x, n), _blocks(book, n)
        bound = (size * (mx[row] - mc[entry]) ** 2 + (rx[row] - rc[entry]) ** 2).sum(1)
        keep = bound <= upper[row] + slack[row, entry]
        row, entry = row[keep], entry[keep]
    return row, entry


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties to the lower index) and the squared distance, exact."""
    row, entry = candidates(x, book)
    far = np.full((len(x), len(book)), np.iinfo(np.int64).max)
    far[row, entry] = ((x[row] - book[entry]) ** 2).sum(1)
    best = far.argmin(1)
    return best, far[np.arange(len(x)), best]


def _matrices(b: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The last column's vectors as matrices of at most ROWS rows."""
    for lo in range(0, b.num_rows, ROWS):
        part = b.column(b.num_columns - 1).slice(lo, ROWS)
        yield part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), width)


def _next_books(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floored mean of the parts that are nearest to it; books is parts by entries by positions.

    A task returns a sum for each component of the codebooks and a count for each entry, whatever its number of vectors.
    """
    parts, k, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, w), dtype=np.int64), np.zeros((parts, k), dtype=np.int64)
        for b in batches:
            for x in _matrices(b, parts * w):
                for p in range(parts):
                    own = x[:, p * w : (p + 1) * w]
                    code, _ = nearest(own, books[p])
                    counts[p] += np.bincount(code, minlength=k)
                    np.add.at(sums[p], code, own)
        flat = np.concatenate([sums.ravel(), counts.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["slot", "total"])

    got = vectors.select("v_").mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(parts * k * (w + 1), dtype=np.int64)
    for r in got:
        flat[r.slot] = r.total
    sums, counts = flat[: parts * k * w].reshape(books.shape), flat[parts * k * w :].reshape(parts, k, 1)
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def _coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vectors with code and error in place of v_."""
    parts, _, w = books.shape
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, errors = [], []
            for x in _matrices(b, parts * w):
                found = [nearest(x[:, p * w : (p + 1) * w], books[p]) for p in range(parts)]
                names += ["".join(t) for t in zip(*(digits[c] for c, _ in found), strict=True)]
                errors.append(np.sum([e for _, e in found], axis=0))
            errors = np.concatenate(errors) if errors else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(errors, pa.int64())], names=["row_", "code_", "error_"])

    return vectors.mapInArrow(run, f"row_ {vectors.schema['row_'].dataType.simpleString()}, code_ string, error_ long")


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row per coded vector: its other columns, code (two hex digits a part), error (squared distances to the entries, summed), label_error (that
    summed over equal labels, nulls together) and codebooks_sha256 (of all components of the final entries, joined by commas).

    Codebooks start as the parts of the vectors with the ``entries`` smallest keys (fewer, where there are fewer vectors; nulls last, ties
    by the vector) and move to floored means ``rounds`` times. Codebooks are ``entries`` vectors whatever the table's size, so they go to
    every task; each round returns as many sums. Sums and distances are whole numbers, so neither the order of rows nor the partitions
    matter.

    See ``integer_vectors`` for rows without a code. An empty table gives no rows. Columns of df that have a result's name are replaced, unless
    they are the key or the label. The number of components must be a multiple of ``parts``; else a ValueError says so.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    others = [c for c in df.columns if c != vector and (c in (key, label) or c.lower() not in RESULTS)]
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row_"), F.col(f"`{vector}`").alias("vector_"))
    vectors = staged(integer_vectors(packed, "vector_", scale), "vectors")
    sizes = vectors.groupBy(F.size("v_").alias("width")).count().where("width > 0").orderBy(F.desc("count"), F.desc("width")).first()
    width = sizes.width if sizes else parts
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    own = vectors.where(F.size("v_") == width)
    first = np.array([r.v_ for r in own.orderBy(F.col("row_")[key].asc_nulls_last(), "v_").select("v_").limit(entries).collect()], dtype=np.int64).reshape(-1, parts, width // parts)
    books = first.transpose(1, 0, 2) if len(first) else np.zeros((parts, 1, width // parts), dtype=np.int64)
    for _ in range(rounds):
        books = _next_books(own, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    coded = _coded(own, books)
    told = [F.col("row_")[c].alias(c) for c in others] + [F.col("code_").alias("code"), F.col("error_").alias("error")]
    if label is None:
        return coded.select(*told, F.lit(digest).alias("codebooks_sha256"))
    coded = staged(coded.withColumn("label_", F.struct(F.col("row_")[label].alias("label"))), "codes")  # a struct of a null equals another
    unstage(vectors)
    totals = staged(coded.groupBy("label_").agg(F.sum("error_").alias("label_error_"), F.count("*").alias("n_")), "label_errors")
    return lookup(coded, totals, ["label_"], "n_").select(*told, F.col("label_error_").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
