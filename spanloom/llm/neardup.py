"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact shingle sets verify them."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, fresh, mix, seeds, shingles, slices, small, small_batches, staged, unstage
from .graph import components

#: Tries of the forest, the minima in a label (a text's path in a trie, from the root), and the bytes of each.
TREES, DEPTH, MINIMUM_BYTES = 24, 8, 2
#: Texts of more shingles than this are just as hard to find as long ones.
FINE_SIZES = 64
#: Candidate components of more members or bytes are verified in pairs of blocks of about half as many.
BLOCK, BLOCK_BYTES = 512, 2 << 20
GROUP_BYTES = 1 << 20
#: Labels are sorted in ranges of about so many rows.
RANGE_ROWS = 400_000


def forest_depth(similarity: float, target: float, trees: int = TREES, deepest: int = DEPTH) -> int:
    """The longest prefix, from the deepest, under which a pair of that similarity meets in some tree with the target probability."""
    depth = deepest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < target:
        depth -= 1
    return depth


def least_attainable(size: int, similarity: float) -> float:
    """The least Jaccard similarity, of those not under ``similarity``, that a set of ``size`` elements can have with any set.

    A set shares i of its elements and their union has u: i <= size <= u. Small sets cannot be just similar enough.
    """
    least = Fraction(similarity).limit_denominator(10**6)
    best = Fraction(1)
    for i in range(1, size + 1):
        u = max(size, int(i / least))  # the largest union with which i common elements are enough
        while u > size and Fraction(i, u) < least:
            u -= 1
        if Fraction(i, u) >= least:
            best = min(best, Fraction(i, u))
    return float(best)


def prefix_lengths(similarity: float, target: float) -> np.ndarray:
    """For sets of 0, 1, 2 ... FINE_SIZES elements and more: how far their prefixes are shortened so that the least similar partner they can
    have is met with the target probability."""
    return np.array([DEPTH] + [forest_depth(least_attainable(n, similarity), target) for n in range(1, FINE_SIZES + 1)] + [forest_depth(similarity, target)], dtype=np.int8)


def labels(texts: list[bytes], width: int, trees: int = TREES) -> tuple[np.ndarray, np.ndarray]:
    """For each text and tree its path: the tree's number and DEPTH minima of hashed shingles, as bytes that sort as the path does; and each
    text's number of different shingles. A text without shingles has path 0."""
    s, begin = shingles(texts, width)
    out = np.zeros((len(texts), trees, 1 + DEPTH * MINIMUM_BYTES), dtype=np.uint8)
    sizes = np.zeros(len(texts), dtype=np.int64)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out, sizes
    for k in full:
        sizes[k] = len(np.unique(s[begin[k] : begin[k + 1]]))
    a = seeds(23, trees * DEPTH).reshape(trees, DEPTH)
    buf = np.empty_like(s)
    for t in range(trees):
        out[full, t, 0] = t + 1
        for k in range(DEPTH):
            np.multiply(s, a[t, k], out=buf)
            least = mix(np.minimum.reduceat(buf, begin[full]))
            out[full, t, 1 + k * MINIMUM_BYTES : 1 + (k + 1) * MINIMUM_BYTES] = least.view(np.uint8).reshape(-1, 8)[:, :MINIMUM_BYTES]
    return out, sizes


def _signatures(width: int, depths: np.ndarray):
    kind = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("bytes", pa.int64()), ("size", pa.int64()), ("depth", pa.int8()), ("labels", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies: dict[bytes, list] = {}  # of equal texts of a batch one row: the first's place, how many, the least id
            for at, (k, i) in enumerate(zip(batch["key"].to_pylist(), batch["id"].to_pylist(), strict=True)):
                seen = copies.setdefault(k, [at, 0, i])
                seen[1] += 1
                seen[2] = i if seen[2] is None else seen[2] if i is None else min(i, seen[2])
            keys = list(copies)
            first, n, least = (list(x) for x in zip(*copies.values(), strict=True)) if copies else ([], [], [])
            for i, j, texts in slices(batch["text"].take(pa.array(first, pa.int64()))):
                paths, sizes = labels(texts, width)
                flat = [p.tobytes() if z else None for p, z in zip(paths, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[i:j], pa.binary()), pa.array(n[i:j], pa.int64()), pa.array(least[i:j], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(sizes), pa.array(depths[np.minimum(sizes, len(depths) - 1)]), pa.array(flat, pa.binary()),
                ], schema=kind)

    return run, "key binary, n long, least long, bytes long, size long, depth byte, labels binary"


class _Walk:
    """Goes through a trie's labels in order and links texts that share a prefix long enough for both.

    In sorted order the texts under a node are neighbours. Of every level it remembers the last text whose prefixes
    are shortened as far: a later one under the same node of that level is linked to it.
    """

    def __init__(self, levels: list[int]) -> None:
        """levels: all lengths that a text's prefixes may be shortened to."""
        self.levels = levels
        self.last: dict[int, tuple[bytes, bytes]] = {}  # by level: label and key
        self.first: dict[int, tuple[bytes, bytes]] = {}

    def step(self, label: np.ndarray, depth: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """label: rows of bytes in order. Returns the keys of linked pairs, at most one pair for a row and level."""
        a, b = [], []
        for level in self.levels:
            here = np.flatnonzero(depth <= level)
            if not len(here):
                continue
            wide = 1 + level * MINIMUM_BYTES
            part, who = label[here, :wide], keys[here]
            if level in self.last:
                old, k = self.last[level]
                part, who = np.vstack([np.frombuffer(old, np.uint8)[None, :wide], part]), np.concatenate([np.array([k], dtype=object), who])
            else:
                self.first[level] = (label[here[0]].tobytes(), keys[here[0]])
            same = (part[1:] == part[:-1]).all(axis=1)
            a.append(who[1:][same])
            b.append(who[:-1][same])
            self.last[level] = (label[here[-1]].tobytes(), keys[here[-1]])
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, object), np.zeros(0, object))


_LINKS = "a binary, b binary, label binary, depth byte"


def _climb(edges: bool, levels: list[int]):
    """Walks sorted rows (label, depth, key): yields links (a, b) and, where ``edges``, the range's outermost texts of each level (a, label,
    depth), which meet those of other ranges later."""
    kind = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("label", pa.binary()), ("depth", pa.int8())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, outer = _Walk(levels), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.frombuffer(b"".join(batch["label"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            a, b = walk.step(label, batch["depth"].to_numpy(zero_copy_only=False), np.array(batch["key"].to_pylist(), dtype=object))
            keep = a != b
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.binary()), pa.array(b[keep], pa.binary()), pa.nulls(int(keep.sum()), pa.binary()), pa.nulls(int(keep.sum()), pa.int8())], schema=kind)
        if edges:
            for ends in (walk.first, walk.last):
                for level, (label, key) in ends.items():
                    outer[label, key, level] = None
            rows = list(outer)
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k, _ in rows], pa.binary()), pa.nulls(len(rows), pa.binary()), pa.array([x for x, _, _ in rows], pa.binary()), pa.array([d for _, _, d in rows], pa.int8())], schema=kind)

    return run


def forest_links(seen: DataFrame, levels: list[int]) -> DataFrame:
    """Links (a, b) between the texts of _signatures() under a common node of the forest; texts under one node are linked in a chain.
    levels: the prefix lengths there are.

    All labels are sorted as a whole, in ranges by their values, so that however many texts are under a node, it is
    spread over tasks; what the ranges' ends have in common is linked in a second walk over the ends alone.
    """
    n = seen.where("labels is not null").count()
    step = 1 + DEPTH * MINIMUM_BYTES
    rows = seen.where("labels is not null").select("key", "depth", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"), "labels")
    rows = rows.select(F.expr(f"substring(labels, t * {step} + 1, {step})").alias("label"), "depth", "key")
    ranges = max(12, n * TREES // RANGE_ROWS)
    walked = staged(rows.repartitionByRange(ranges, "label", "key").sortWithinPartitions("label", "key").mapInArrow(_climb(True, levels), _LINKS), "walked")
    ends = staged(walked.where("label is not null").select("label", "depth", F.col("a").alias("key")), "ends")  # a few rows for each range
    across = ends.coalesce(1).sortWithinPartitions("label", "key", "depth").mapInArrow(_climb(False, levels), _LINKS)
    return walked.where("b is not null").select("a", "b").unionByName(across.select("a", "b"))


def linked(sets: list[np.ndarray], similarity: float, split: int | None = None) -> np.ndarray:
    """Which pairs of sorted sets have at least that Jaccard similarity. split: only pairs of one of the first ``split`` and one of the others."""
    n = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.float64)
    every = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size.astype(np.int64))
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    kept, column = np.unique(column, return_inverse=True)
    common = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(256, (1 << 22) // max(n, 1))
    for lo in range(0, len(kept), step):
        i, j = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((n, min(step, len(kept) - lo)), dtype=np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        common += m @ m.T
    union = size[:, None] + size[None, :] - common
    out = (common >= similarity * union - 1e-9) & (union > 0)
    np.fill_diagonal(out, False)
    if split is not None:
        out[:split, :split] = out[split:, split:] = False
    return out


def _roots(near: np.ndarray) -> np.ndarray:
    """For each node the least node of its component."""
    label = np.arange(len(near))
    while len(near):
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _verify(width: int, similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["comp", "key"]).sort_values(["comp", "block", "key"]).reset_index(drop=True)
        out = []
        for _, g in pdf.groupby("comp", sort=False):
            sets = []
            for i, j in chunks(g["text"].str.len().to_numpy(np.int64) + 1, GROUP_BYTES):
                s, begin = shingles(g["text"].iloc[i:j].to_list(), width)
                sets += [np.unique(s[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            blocks = g["block"].to_numpy()
            pair = g["pair"].to_numpy()[0]
            near = linked(sets, similarity, int((blocks == blocks[0]).sum()) if pair else None)
            n = g["n"].to_numpy()
            # The least key leads, so that labels agree between groups.
            order = np.argsort(np.array(g["key"].to_list(), dtype=object), kind="stable")
            root = np.empty(len(g), dtype=np.int64)
            root[order] = order[_roots(near[np.ix_(order, order)])]
            keys = g["key"].to_numpy()
            out.append(pd.DataFrame({"key": keys, "root": keys[root], "links": (near * n[None, :]).sum(axis=1).astype(np.int64), "big": g["big"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "root": [], "links": [], "big": []})

    return run, "key binary, root binary, links long, big boolean"


def _placed(comps: DataFrame, similarity: float) -> DataFrame:
    """Deals the members of candidate components (root, key, n, least, bytes, size) into blocks, and names for each the blocks it meets:
    columns comp, key, n, least, block, blocks, others.

    A large component's blocks hold texts of like numbers of shingles. Sets of which one has less than ``similarity``
    times the other's elements cannot be similar, so blocks farther apart do not meet.
    """
    sizes = staged(comps.groupBy("root").agg(F.count("*").alias("members"), F.sum("bytes").alias("weight")), "sizes")
    blocks = F.when((F.col("members") > BLOCK) | (F.col("weight") > BLOCK_BYTES), F.greatest(F.ceil(F.col("members") / (BLOCK // 2)), F.ceil(F.col("weight") / (BLOCK_BYTES // 2)))).otherwise(1).cast("int")
    sized = comps.join(small(sizes.select("root", blocks.alias("blocks"))), "root").withColumnRenamed("root", "comp")
    one = sized.where("blocks = 1").withColumns({"block": F.lit(0), "others": F.array(F.lit(0))})
    large = sized.where("blocks > 1")
    # Bounds of blocks by size: counts of each size, added up; texts of one size are spread by hash over their blocks.
    per = staged(large.groupBy("comp", "blocks", "size").agg(F.count("*").alias("m")), "per_size")
    up = Window.partitionBy("comp").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("comp")
    at = per.withColumns({"upto": F.sum("m").over(up), "all": F.sum("m").over(every)})
    at = at.withColumns({"lo": F.least(F.floor((F.col("upto") - F.col("m")) * F.col("blocks") / F.col("all")), F.col("blocks") - 1).cast("int"), "hi": F.least(F.floor((F.col("upto") - 1) * F.col("blocks") / F.col("all")), F.col("blocks") - 1).cast("int")})
    at = staged(at.select("comp", "size", "lo", "hi"), "bounds")
    span = staged(at.select("comp", "size", F.explode(F.sequence("lo", "hi")).alias("block")).groupBy("comp", "block").agg(F.min("size").alias("low"), F.max("size").alias("high")), "spans")
    x, y = span.alias("x"), span.alias("y")
    floor = F.lit(similarity - 1e-9)
    meets = x.join(y, F.col("x.comp") == F.col("y.comp")).where((F.col("x.high") >= floor * F.col("y.low")) & (F.col("y.high") >= floor * F.col("x.low")))
    meets = staged(meets.groupBy(F.col("x.comp").alias("comp"), F.col("x.block").alias("block")).agg(F.collect_list("y.block").alias("others")), "meets")
    dealt = large.join(small(at), ["comp", "size"]).withColumn("block", (F.col("lo") + F.pmod(F.xxhash64("key"), F.col("hi") - F.col("lo") + 1)).cast("int"))
    dealt = dealt.join(small(meets), ["comp", "block"])
    cols = ["comp", "key", "n", "least", "bytes", "blocks", "block", "others"]
    out = staged(one.select(*cols).unionByName(dealt.select(*cols)), "placed")
    unstage(sizes, per, at, span, meets)
    return out


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Classes of documents whose texts are linked by Jaccard similarities of at least ``similarity`` between their sets of ``width`` words in a row.

    A text shorter than that has one shingle, all its words; a text without words has none, and only texts equal to
    it are linked to it (a null text counts as an empty one). Equal texts are one class beforehand. Candidates are
    texts under a common node in one of TREES tries of sorted minima. Every text's prefixes are shortened, from the
    deepest, until the least similar partner that a set of its size can have is met with probability ``recall``; two
    texts meet under a node that is deep enough for both. All pairs of each component of candidates are then
    compared exactly, but for those whose sizes alone rule out the similarity. Small components are verified
    several in a task, GROUP_BYTES together; large ones in pairs of blocks of like sizes.

    Returns one row per different text that has a copy or a link: text_key (MD5, binary), copies (its documents),
    links (documents linked to each of them, copies included), class_key (the least key of the class), class_id
    (the least id in the class; null if all are), keep_key and keep_id (text and id of the one that stays: the least id, nulls last).
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("key"), F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    depths = prefix_lengths(similarity, recall)
    run, kind = _signatures(width, depths)
    seen = staged(src.mapInArrow(run, kind), "signatures")
    comps = components(forest_links(seen, np.unique(depths).tolist()))
    texts = staged(seen.groupBy("key").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("bytes").alias("bytes"), F.max("size").alias("size")), "texts")
    comps = staged(comps.withColumnRenamed("node", "key").join(texts, "key"), "comps")
    unstage(seen)
    total = comps.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    found = None
    if total[0]:
        groups = max(12, int(total[1] / GROUP_BYTES))
        placed = _placed(comps, similarity)
        rows = src.join(small(placed), "key").where(F.col("id").eqNullSafe(F.col("least")))
        rows = rows.withColumn("other", F.explode("others"))
        lo, hi = F.least("block", "other"), F.greatest("block", "other")
        rows = rows.withColumns({"big": F.col("blocks") > 1, "pair": lo != hi, "group": F.when(F.col("blocks") > 1, F.concat_ws(":", F.hex("comp"), lo, hi)).otherwise(F.pmod(F.xxhash64("comp"), F.lit(groups)).cast("string"))})
        verify, kind = _verify(width, similarity)
        found = staged(rows.select("group", "comp", "key", "n", "block", "pair", "big", "text").groupBy("group").applyInPandas(verify, kind), "verified")
        summed = found.groupBy("key").agg(F.sum("links").alias("links"), F.min("root").alias("root"), F.max("big").alias("big"))
        if not found.where("big").isEmpty():
            whole = components(found.where("big").select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("key"), F.col("root").alias("whole"))
            summed = summed.join(whole, "key", "left").withColumn("root", F.coalesce("whole", "root")).drop("whole")
        verified, found = found, staged(summed.where("links > 0").select("key", "links", "root"), "found")
        unstage(verified, placed)
    every = texts.where("n > 1") if found is None else texts.join(found, "key", "left").where("n > 1 or links is not null")
    every = every if found is not None else every.withColumns({"links": F.lit(None).cast("long"), "root": F.lit(None).cast("binary")})
    every = staged(every.withColumn("root", F.coalesce("root", "key")), "texts")
    heads = staged(every.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("no"), F.col("least").alias("id"), F.col("key").alias("key"))).alias("head")), "heads")
    out = every.join(heads, "root")
    classes = staged(out.select(F.col("key").alias("text_key"), F.col("n").alias("copies"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.col("root").alias("class_key"), F.col("head.id").alias("class_id"), F.col("head.key").alias("keep_key"), F.col("head.id").alias("keep_id")), "classes")
    unstage(comps, texts, found, every, heads)
    return classes


def label_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """One row per row of docs: key, class_id (the least id of its class; its own id without links) and n_links (documents linked to it,
    equal ones included)."""
    classes = near_duplicates(docs, text=text, key=key, **how)
    src = docs.select(key, F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_key"))
    out = src.join(small(classes), "text_key", "left")
    return out.select(key, F.when(F.col("links").isNull(), F.col(key).cast("long")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """Keeps one document of each class, the one with the least id (null ids last), and everything that is not linked; of equal rows of that
    id one stays."""
    classes = near_duplicates(docs, text=text, key=key, **how)
    own, k, i = fresh(docs, "own", "keep_k", "keep_i")
    classes = classes.select(F.col("text_key").alias(own), F.col("keep_key").alias(k), F.col("keep_id").alias(i))
    out = docs.withColumn(own, F.unhex(F.md5(F.coalesce(text, F.lit("")))))
    joined = out.join(small(classes), own, "left")
    kept = joined.where(F.col(k).isNull() | ((F.col(own) == F.col(k)) & F.col(key).cast("long").eqNullSafe(F.col(i))))
    (n,) = fresh(joined, "n")
    head = kept.where(F.col(k).isNotNull())
    again = staged(head.groupBy(own).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(own), "again")
    if not again.isEmpty():
        more = small(again)
        kept = kept.join(more, own, "left_anti").unionByName(head.join(more, own, "left_semi").dropDuplicates([own]).select(*kept.columns))
    return kept.select(*docs.columns)
