"""Removal of long strings that occur twice: suffixes sorted by external induction, in shards that share no such string."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U, chunks, fresh, mix, prefix_hash, slices, small, staged, unstage
from .suffixes import repeated_windows

#: A window's shard is that of the least of its substrings of so many bytes.
MER = 128
SHARD_BYTES = 3 << 19
#: A least substring whose different runs have more bytes is split into bands of so many windows.
HOT_BYTES, BAND = 2 << 20, 16
_AT = 24


def window_minima(value: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(value)
    if n < width:
        return value[:0]
    fill = np.full((-n) % width, np.iinfo(np.uint64).max, dtype=np.uint64)
    rows = np.concatenate([value, fill]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def least_places(value: np.ndarray, width: int) -> np.ndarray:
    """Where the least (by its upper bits) of each ``width`` values in a row is, the first of equals.

    Values carry their place in their lower bits, counted from the start of a block that these bits can number; blocks overlap, so that each
    run of values lies within one, whatever the text's length.
    """
    low = U((1 << _AT) - 1)
    step = (1 << _AT) - width + 1
    parts = []
    for lo in range(0, max(len(value) - width + 1, 0), step):
        block = value[lo : lo + step + width - 1]
        packed = (block & ~low) | np.arange(len(block), dtype=np.uint64)
        parts.append((window_minima(packed, width) & low).astype(np.int64) + lo)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Cuts each text's windows of ``length`` bytes into runs of neighbours that share their least substring of MER bytes.

    Returns for each run: the text's number, the first window's start, the number of windows, a hash of the least
    substring, a hash of all the bytes that the windows cover, and how far behind the start the least substring is.
    Equal windows have equal least substrings, at the same place.
    """
    mer = min(MER, length)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if len(data) < length:
        return tuple(np.zeros(0, dtype=x) for x in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    p, up = prefix_hash(data)
    value = mix((p[mer:] - p[:-mer]) * up[: len(p) - mer])
    place = least_places(value, length - mer + 1)
    start = np.arange(len(place))
    doc = np.searchsorted(at, start, side="right") - 1
    inside = start + length <= at[doc + 1]
    start, doc, place = start[inside], doc[inside], place[inside]
    if not len(start):
        return tuple(np.zeros(0, dtype=x) for x in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.append(head, len(start)))
    s, where = start[head], place[head]
    e = s + count - 1 + length
    return doc[head], s - at[doc[head]], count, value[where], mix((p[e] - p[s]) * up[s] + (e - s).astype(np.uint64) * U(0x9E3779B97F4A7C15)), where - s


def _run_rows(length: int):
    kind = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("at", pa.int64()), ("windows", pa.int32()), ("mer", pa.int64()), ("print", pa.int64()), ("lead", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch["key"].to_pylist(), dtype=object)
            if not len(keys):
                continue
            keys, first, n = np.unique(keys, return_index=True, return_counts=True)
            size = batch["size"].take(pa.array(first)).to_numpy(zero_copy_only=False)
            for i, j in chunks(size, SLICE_BYTES):
                doc, at, count, mer, print_, lead = runs(batch["text"].take(pa.array(first[i:j])).to_pylist(), length)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][doc].tolist(), pa.binary()), pa.array(n[i:j][doc], pa.int64()), pa.array(at, pa.int64()), pa.array(count, pa.int32()), pa.array(mer.view(np.int64)), pa.array(print_.view(np.int64)), pa.array(lead, pa.int32())], schema=kind)

    return cut, "key binary, n long, at long, windows int, mer long, print long, lead int"


def _shard(length: int):
    """Sorts the suffixes of a shard's segments; returns for each segment that occurs once which of its windows start elsewhere, too, as ranges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["mer", "print"]).reset_index(drop=True)
        flags = repeated_windows(pdf["segment"].to_list(), length)
        ranges = []
        for x in flags:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]])))
            ranges.append([{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        out = pdf[["mer", "print"]].assign(ranges=ranges)
        return out[(pdf["n"] == 1) & (out["ranges"].str.len() > 0)]

    return run, "mer long, print long, ranges array<struct<a: long, b: long>>"


def _bands(length: int):
    """Cuts each run (mer, print, n, lead, segment) into bands of BAND windows, counted from its least substring, so that equal windows are
    in bands of one number: band, core (a hash of the bytes that all windows of such a band have), whole (of all bytes of the band's windows
    here), and the windows a to b."""
    kind = pa.schema([("mer", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("band", pa.int32()), ("core", pa.int64()), ("whole", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch["segment"]):
                lead = batch["lead"].slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)
                size = np.array([len(t) for t in texts], dtype=np.int64)
                at = np.cumsum(size) - size
                p, up = prefix_hash(np.frombuffer(b"".join(texts), dtype=np.uint8))
                first, last = np.maximum(lead - (size - length), 0) // BAND, lead // BAND
                own = np.repeat(np.arange(len(texts)), last - first + 1)
                band = np.arange(len(own)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[own]
                # Window k of a run is lead - k bytes before its least substring.
                a = np.maximum(lead[own] - (band * BAND + BAND - 1), 0)
                b = np.minimum(lead[own] - band * BAND, size[own] - length) + 1
                begin = at[own] + lead[own] - band * BAND
                h = lambda x, y: mix((p[y] - p[x]) * up[x] + (y - x).astype(np.uint64) * U(0x9E3779B97F4A7C15))
                take = pa.array(own + i)
                yield pa.RecordBatch.from_arrays([
                    batch["mer"].take(take), batch["print"].take(take), batch["n"].take(take), pa.array(band, pa.int32()),
                    pa.array(h(begin, begin + length - BAND + 1).view(np.int64)), pa.array(h(at[own] + a, at[own] + b - 1 + length).view(np.int64)), pa.array(a), pa.array(b),
                ], schema=kind)

    return cut, "mer long, print long, n long, band int, core long, whole long, a long, b long"


def _windows(length: int):
    """For runs (mer, print, n, lead, segment) and bands of them (spans: a, b): each window's place before the least substring, hash and number."""
    kind = pa.schema([("mer", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("window", pa.int64()), ("a", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in slices(batch["segment"]):
                p, up = prefix_hash(np.frombuffer(b"".join(texts), dtype=np.uint8))
                at = np.cumsum([0] + [len(t) for t in texts])
                spans = batch["spans"].slice(i, j - i).to_pylist()
                own = np.concatenate([np.full(sum(x["b"] - x["a"] for x in r), k) for k, r in enumerate(spans)]).astype(np.int64)
                a = np.concatenate([np.arange(x["a"], x["b"]) for r in spans for x in r]).astype(np.int64)
                x = at[own] + a
                take = pa.array(own + i)
                lead = batch["lead"].take(take).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch["mer"].take(take), batch["print"].take(take), batch["n"].take(take), pa.array(lead - a), pa.array(mix((p[x + length] - p[x]) * up[x]).view(np.int64)), pa.array(a)], schema=kind)

    return cut, "mer long, print long, n long, place long, window long, a long"


def _repeated_in_bands(segments: DataFrame, length: int) -> DataFrame:
    """The repeated windows, as ranges a to b, of runs (mer, print, n, lead, segment) of hot least substrings, without any task that has all
    runs of one.

    A band whose core no other run has is done with, and one that is the same in all runs that have its core is
    repeated as a whole. Only the windows of the others, where what is shared begins or ends, are counted one by one.
    """
    cut, kind = _bands(length)
    bands = staged(segments.mapInArrow(cut, kind), "bands")
    cores = bands.groupBy("mer", "band", "core").agg(F.sum("n").alias("times"), (F.min("whole") == F.max("whole")).alias("same")).where("times > 1")
    cores = staged(cores.select("mer", "band", "core", "same"), "cores")
    met = staged(bands.join(small(cores), ["mer", "band", "core"]).select("mer", "print", "same", "a", "b"), "met")
    open_ = met.where("not same").groupBy("mer", "print").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cut, kind = _windows(length)
    each = staged(segments.join(staged(open_, "open"), ["mer", "print"]).mapInArrow(cut, kind), "windows")
    twice = staged(each.groupBy("mer", "place", "window").agg(F.sum("n").alias("times")).where("times > 1").drop("times"), "twice")
    one = each.join(small(twice), ["mer", "place", "window"]).select("mer", "print", "a", (F.col("a") + 1).alias("b"))
    out = staged(met.where("same").select("mer", "print", "a", "b").unionByName(one).groupBy("mer", "print").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "hot")
    unstage(bands, cores, met, each, twice)
    return out


def _spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_CUT = "struct<kept: binary, removed: long, spans: array<struct<begin: long, end: long>>>"


def _cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    kept, removed, spans = [], [], []
    every = ((text, found) for i, j, part in slices(texts) for text, found in zip(part, ranges.slice(i, j - i).to_pylist(), strict=True))
    for text, found in every:
        cut = _spans([(r["begin"], r["end"]) for r in found or ()])
        parts, at = [], 0
        for a, b in cut:
            parts.append(text[at:a])
            at = b
        kept.append(b"".join([*parts, text[at:]]))
        removed.append(sum(b - a for a, b in cut))
        spans.append([{"begin": a, "end": b} for a, b in cut])
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], names=["kept", "removed", "spans"])


def repeated_ranges(docs: DataFrame, length: int = 400, text: str = "text") -> DataFrame:
    """For each different text with a string of ``length`` bytes that starts anywhere else in the table, too: its MD5 (key, binary) and
    ranges, an array of (begin, end), not merged.

    Windows are dealt to shards by their least substring of MER bytes, so that equal windows meet. A run of windows
    that is found twice as a whole is repeated; where different runs share their least substring, the suffixes of the
    runs, each once, are sorted, and windows with a common prefix of ``length`` with a neighbour are repeated.
    """
    body = F.coalesce(text, F.lit(""))
    src = docs.select(F.unhex(F.md5(body)).alias("key"), F.octet_length(body).cast("long").alias("size"), body.cast("binary").alias("text")).where(F.col("size") >= length)
    cut, kind = _run_rows(length)
    rows = staged(src.mapInArrow(cut, kind), "runs")
    per = rows.groupBy("mer", "print").agg(F.sum("n").alias("n"), F.min(F.struct("key", "at", "windows", "lead")).alias("first"))
    per = staged(per, "segments")
    span = F.col("first.windows") + length - 1
    mixed = staged(per.groupBy("mer").agg(F.count("*").alias("kinds"), F.sum(span).alias("weight")).where("kinds > 1").select("mer", (F.col("weight") > HOT_BYTES).alias("hot")), "mixed")
    marks = [staged(per.where("n > 1").select("mer", "print", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("first.windows").cast("long").alias("b"))).alias("ranges")), "marks")]
    wanted = per.join(small(mixed), "mer").select(F.col("first.key").alias("key"), F.struct("mer", "print", "n", "hot", "first.lead", F.col("first.at").alias("at"), span.alias("bytes")).alias("s"))
    wanted = staged(wanted.groupBy("key").agg(F.collect_list("s").alias("s"), F.sum(F.when(~F.col("s.hot"), F.col("s.bytes"))).alias("total"), F.max("s.hot").alias("hot")), "wanted")
    total, any_, hot = wanted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("*"), F.coalesce(F.max("hot"), F.lit(False))).first()
    unstage(per, mixed)
    if any_:
        # Tables that grow with the input are not broadcast.
        one = src.select("key", "text").join(wanted.select("key", "s"), "key").select("text", F.explode("s").alias("s"))
        one = one.select("s.*", F.expr("substring(text, int(s.at) + 1, int(s.bytes))").alias("segment"))
        shards = max(12, int(total / SHARD_BYTES))
        sort, kind = _shard(length)
        some = one.where("not hot").select(F.pmod(F.xxhash64("mer"), F.lit(shards)).alias("shard"), "mer", "print", "n", "segment")
        marks.append(staged(some.groupBy("shard").applyInPandas(sort, kind), "marks"))
        if hot:  # equal texts of a document give a run several times
            runs_ = one.where("hot").groupBy("mer", "print").agg(F.min("n").alias("n"), F.min("lead").alias("lead"), F.min("segment").alias("segment"))
            marks.append(_repeated_in_bands(staged(runs_, "hot"), length))
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more.select("mer", "print", "ranges"))
    every = staged(every, "marks")
    found = rows.join(every, ["mer", "print"]).select("key", F.expr(f"transform(ranges, r -> named_struct('begin', at + r.a, 'end', at + r.b - 1 + {length}))").alias("ranges"))
    out = staged(found.groupBy("key").agg(F.flatten(F.collect_set("ranges")).alias("ranges")), "ranges")
    unstage(rows, wanted, every, *marks)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text") -> DataFrame:
    """Removes every byte covered by a string of ``length`` bytes of UTF-8 that also starts anywhere else in the table.

    Adds to every row n_bytes, n_removed, n_spans (maximal runs of removed bytes), spans (their bounds) and kept (the
    other bytes, binary: a cut may part a character). Strings never cross rows; they are judged on the input, overlapping
    or not. Null texts count as empty ones; texts shorter than ``length`` stay whole; of repeated rows all lose
    what they share. Columns of the added names are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "spans", "kept")
    key, ranges, done = fresh(docs, "key", "ranges", "done")
    found = repeated_ranges(docs, length, text).select(F.col("key").alias(key), F.col("ranges").alias(ranges))
    body = F.coalesce(text, F.lit(""))
    out = docs.withColumn(key, F.unhex(F.md5(body))).join(found, key, "left")
    out = out.withColumn(done, F.when(F.col(ranges).isNotNull(), F.arrow_udf(_cut, _CUT)(body.cast("binary"), F.col(ranges))))
    return out.select(
        *docs.columns, F.octet_length(body).cast("long").alias("n_bytes"), F.coalesce(F.col(f"{done}.removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.size(f"{done}.spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.col(f"{done}.spans").alias("spans"), F.coalesce(F.col(f"{done}.kept"), body.cast("binary")).alias("kept"))
