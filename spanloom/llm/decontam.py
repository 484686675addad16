"""Benchmark decontamination: SimHash windows of item size, found by multi-index Hamming blocks, verified by weighted shingles."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, fresh, shingles, slices, small, small_batches, staged, unstage

#: 64-bit fingerprints are found within this distance: of four blocks of 16 bits one then differs in at most 3 bits.
RADIUS, BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 15, 4, 16, 3
#: Items whose sizes differ by at most this ratio share a window size.
RATIO = 1.15
#: Items go to the executors in passes of at most about so many bytes of text; their block tables take at most about so many bytes.
PASS_BYTES, INDEX_BYTES = 16 << 20, 64 << 20
#: Windows are fingerprinted so many starts at a time, and looked up so many at a time.
STARTS, LOOKUPS = 1 << 14, 1 << 12
MATCHES = "array<struct<item_id: long, similarity: double, start: int, words: int>>"
#: By radius: all differences of a block of at most so many bits.
_MASKS = [np.array([sum(1 << b for b in c) for n in range(r + 1) for c in itertools.combinations(range(BLOCK_BITS), n)], dtype=np.int64) for r in range(BLOCK_RADIUS + 1)]
#: Weights in fingerprints are whole multiples of this, so that sums do not depend on where they begin.
_UNIT = 1 / 1024
_BITS = np.arange(64, dtype=np.uint64)
_FILTER = 1 << 20


def size_classes(sizes: np.ndarray) -> list[list[int]]:
    """The least and greatest size of each class of items that share a window size."""
    out: list[list[int]] = []
    for n in np.unique(sizes).tolist():
        if not out or n > out[-1][0] * RATIO:
            out.append([n, n])
        out[-1][1] = n
    return out


def whole_statistics(src: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray, list[list[int]]]:
    """Over all items (column t): their number, the shingles of several items in order and in how many they are, and the classes of sizes.

    A shingle of one item weighs as much as an unknown one, so those need not be kept.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, begin = shingles(batch.column(0).to_pylist(), width)
            sets = [np.unique(s[a:b]).view(np.int64) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(begin)), pa.array(sets, pa.list_(pa.int64()))], ["size", "s"])

    seen = staged(src.select("t").mapInArrow(read, "size long, s array<long>").where("size > 0"), "shingles")
    size = seen.groupBy("size").count().toPandas()
    common = seen.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 1").toPandas()
    key = common["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return max(int(size["count"].sum()), 1), key[order], common["df"].to_numpy(np.int64)[order], size_classes(size["size"].to_numpy(np.int64))


class Items:
    """Benchmark items ready for search: shingle sets, weights, fingerprints and the block tables over them."""

    def __init__(self, ids: list[int], texts: list[bytes], width: int, whole: tuple[int, np.ndarray, np.ndarray, list[list[int]]] | None = None) -> None:
        """whole: statistics of the benchmark that these items are a part of, from whole_statistics()."""
        s, begin = shingles(texts, width)
        every = [(i, s[a:b]) for i, a, b in zip(ids, begin[:-1], begin[1:], strict=True) if b > a]
        self.width, self.ids = width, [i for i, _ in every]
        self.lists = [x for _, x in every]
        self.sets = [np.unique(x) for x in self.lists]
        self.known, df = np.unique(np.concatenate(self.sets) if self.sets else np.zeros(0, dtype=np.uint64), return_counts=True)
        n, self.common, common_df = max(len(every), 1), np.zeros(0, dtype=np.uint64), np.zeros(0)
        if whole:
            n, self.common, common_df, _ = whole
            _, i, j = np.intersect1d(self.known, self.common, assume_unique=True, return_indices=True)
            df[i] = common_df[j]
        self.common_weight = 1 + np.log(n / common_df)
        self.rare = 1 + np.log(n)  # the weight of a shingle of one item or none
        self.weight = 1 + np.log(n / df)
        self.filter = np.zeros(_FILTER, dtype=bool)
        self.filter[(self.known & U(_FILTER - 1)).astype(np.int64)] = True
        size = np.array([len(x) for x in self.lists], dtype=np.int64)
        self.sizes = whole[3] if whole else size_classes(size)
        self.class_of = np.searchsorted([lo for lo, _ in self.sizes], size, side="right") - 1
        self.prints = np.array([self.fingerprints(x, np.ones(len(x), bool), len(x))[0][0] for x in self.lists], dtype=np.uint64)

    def weights(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each shingle, and whether an item has it."""
        hit = self.filter[(s & U(_FILTER - 1)).astype(np.int64)]
        at = np.searchsorted(self.known, s[hit])
        at[at == len(self.known)] = 0
        real = self.known[at] == s[hit] if len(self.known) else np.zeros(0, bool)
        hit[np.flatnonzero(hit)[~real]] = False
        out = np.full(len(s), self.rare)
        if len(self.common):  # items of other passes may have it
            other = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
            out = np.where(self.common[other] == s, self.common_weight[other], out)
        out[hit] = self.weight[at[real]]
        return out, hit

    def fingerprints(self, s: np.ndarray, hit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """SimHash of each window of ``size`` shingles that has a shingle of an item, and where it starts."""
        return next(iter(self.all_fingerprints(s, hit, [size])))[1:]

    def all_fingerprints(self, s: np.ndarray, hit: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        weight = np.rint(self.weights(s)[0] / _UNIT).astype(np.int64 if len(s) > 1 << 16 else np.int32)
        total = np.zeros((len(s) + 1, 64), dtype=weight.dtype)
        for b in range(64):
            np.cumsum(np.where((s >> U(b)) & U(1), weight, -weight), out=total[1:, b])
        seen = np.concatenate([[0], np.cumsum(hit)])
        for size in sizes:
            m = min(size, len(s))
            start = np.flatnonzero(seen[m:] > seen[:-m])
            bits = total[start + m] > total[start]
            yield size, np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel(), start

    def tables(self) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        """A table per block, of items by every value within some bits of theirs, as many bits as INDEX_BYTES allow: these, and the tables.
        Lookups cover the other bits of BLOCK_RADIUS."""
        if not hasattr(self, "_tables"):
            near = max(r for r in range(BLOCK_RADIUS + 1) if not r or len(self.prints) * len(_MASKS[r]) * BLOCKS * 4 <= INDEX_BYTES)
            per = []
            for b in range(BLOCKS):
                value = ((self.prints >> U(b * BLOCK_BITS)) & U((1 << BLOCK_BITS) - 1)).astype(np.uint16)
                every = (value[:, None] ^ _MASKS[near].astype(np.uint16)).ravel()
                order = np.argsort(every, kind="stable").astype(np.int32 if len(every) < 1 << 31 else np.int64)
                begin = np.concatenate([[0], np.cumsum(np.bincount(every, minlength=1 << BLOCK_BITS))])
                order //= len(_MASKS[near])
                per.append((begin, order))
            self._tables = (near, per)
        return self._tables

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint number, item number) within RADIUS."""
        if not self.ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near, per = self.tables()
        masks = _MASKS[BLOCK_RADIUS - near]
        pairs = [np.zeros(0, np.int64)]
        step = max(1, LOOKUPS * len(_MASKS[0]) // len(masks))
        for lo in range(0, len(prints), step):
            part = prints[lo : lo + step]
            for b, (begin, item) in enumerate(per):
                value = (((part >> U(b * BLOCK_BITS)) & U((1 << BLOCK_BITS) - 1)).astype(np.int64)[:, None] ^ masks).ravel()
                n = begin[value + 1] - begin[value]
                who = np.repeat(np.arange(len(value)), n)
                at = item[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[value][who]].astype(np.int64)
                who //= len(masks)
                close = np.bitwise_count(part[who] ^ self.prints[at]) <= RADIUS
                pairs.append(np.unique((who[close] + lo) * len(self.ids) + at[close]))
        pair = np.unique(np.concatenate(pairs))
        return pair // len(self.ids), pair % len(self.ids)

    def similarity(self, s: np.ndarray, item: int) -> float:
        """Weight of the common shingles over that of all, as sets."""
        a = np.unique(s)
        common = self.weights(np.intersect1d(a, self.sets[item], assume_unique=True))[0].sum()
        return common / (self.weights(a)[0].sum() + self.weights(self.sets[item])[0].sum() - common)

    def matches(self, s: np.ndarray, hit: np.ndarray, least: float) -> list[dict]:
        """Items that some window of their own size in s is similar to; of several windows the most similar, then the first."""
        longest = self.sizes[-1][1]
        present = np.unique(self.class_of)
        where = np.flatnonzero(hit)
        breaks = np.flatnonzero(np.diff(where) > 2 * longest) + 1
        best: dict[int, tuple[float, int, int]] = {}
        runs = [(max(0, int(run[0]) - longest), min(len(s), int(run[-1]) + longest + 1)) for run in np.split(where, breaks)]
        # Long stretches are taken so many starts at a time, each with a window's length behind it.
        pieces = [(max(begin, min(lo, end - longest)), min(end, lo + STARTS + longest)) for begin, end in runs for lo in range(begin, max(begin + 1, end - longest + 1), STARTS)]
        for lo, hi in pieces:
            part, part_hit = s[lo:hi], hit[lo:hi]
            weight, _ = self.weights(part)
            total = np.concatenate([[0], np.cumsum(np.where(part_hit, weight, 0))])
            wanted: dict[int, list[int]] = {}
            for k, (_, prints, start) in zip(present, self.all_fingerprints(part, part_hit, [self.sizes[k][1] for k in present]), strict=True):
                q, item = self.search(prints)
                own = self.class_of[item] == k
                for i, at in zip(item[own].tolist(), start[q[own]].tolist(), strict=True):
                    wanted.setdefault(i, []).append(at)
            for i, starts in wanted.items():
                m = min(len(self.lists[i]), len(part))
                slack = self.sizes[self.class_of[i]][1] - len(self.lists[i]) + 2
                near = np.unique(np.clip(np.add.outer(np.array(starts), np.arange(-2, slack + 1)).ravel(), 0, len(part) - m))
                # What the window shares with any item bounds what it shares with this one.
                need = least * self.weights(self.sets[i])[0].sum()
                for at in near[total[near + m] - total[near] >= need - 1e-9].tolist():
                    v = self.similarity(part[at : at + m], i)
                    if v >= least - 1e-12 and (i not in best or v > best[i][0]):
                        best[i] = (v, lo + at, m)
        return [{"item_id": self.ids[i], "similarity": float(v), "start": at, "words": m + self.width - 1} for i, (v, at, m) in sorted(best.items())]


def _searcher(items, similarity: float):
    """The search as a function of a column of texts in UTF-8; items is a broadcast."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("words", pa.int32())]))

    @F.arrow_udf(MATCHES)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = items.value
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(len(batch))]
            for i, _, texts in slices(batch) if known.ids else ():
                s, begin = shingles(texts, known.width)
                _, hit = known.weights(s)
                for d in np.unique(np.searchsorted(begin, np.flatnonzero(hit), side="right") - 1):
                    a, b = begin[d], begin[d + 1]
                    out[i + d] = known.matches(s[a:b], hit[a:b], similarity)
            yield pa.array(out, kind)

    return search


def with_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, width: int = 5, text: str = "text", item: str = "item_id", column: str = "matches") -> DataFrame:
    """Adds to every row an array of (item_id, similarity, start, words): the items that a window of the whole text is similar to.

    A window has as many words as the item and starts at any word of the text (0-based ``start``); a text shorter
    than the item is one window. Windows that share a shingle with some item are fingerprinted, the fingerprints
    within RADIUS of an item's are found through blocks without exception, and the weighted similarity of the two
    shingle sets decides: the weight of a shingle is 1 + ln(items / items that have it), an unknown one counting
    as one item's. Items without words, and null ones, match nothing; an item of fewer than ``width`` words is one
    shingle, which only a text of the same words has. Null and empty texts match nothing. Items with the same id
    and repeated rows count each. A column of that name is replaced. A benchmark of more than PASS_BYTES is taken in
    passes one after another, each of which reads the texts again; statistics are those of the whole.
    """
    src = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).cast("binary").alias("t")).where("i is not null and t is not null")
    size = src.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-size // PASS_BYTES))
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    whole = whole_statistics(src, width) if passes > 1 else None
    parts, own = [], fresh(docs.drop(column), "own")[0]
    for p in range(passes):
        rows = sorted((r["i"], bytes(r["t"])) for r in src.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == p).collect())  # about PASS_BYTES at most
        items = sc.broadcast(Items([i for i, _ in rows], [t for _, t in rows], width, whole))
        found = _searcher(items, similarity)(F.col(text).cast("binary"))
        if passes == 1:
            return docs.drop(column).withColumn(column, found)
        texts = docs.where(F.col(text).isNotNull()).select(F.md5(text).alias(own), found.alias("m")).where(F.size("m") > 0)
        parts.append(staged(texts.groupBy(own).agg(F.first("m").alias("m")), "matches"))  # equal texts have equal matches
        items.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = staged(every.groupBy(own).agg(F.array_sort(F.flatten(F.collect_list("m"))).alias(column)), "matches")
    unstage(*parts)
    out = docs.drop(column).withColumn(own, F.md5(text)).join(small(every), own, "left")
    return out.withColumn(column, F.coalesce(column, F.array().cast(MATCHES))).drop(own)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The matches as rows: key, item_id, similarity, start, words."""
    return with_matches(docs.select(key, text), benchmark, text=text, column="matches", **how).select(key, F.inline("matches"))
