"""Local image descriptors: cropped and edited copies found by oriented binary tests, Hamming tables and geometric consensus."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fresh, small, staged
from .graph import components

#: Levels of a picture, corners of each, and the smoothing of a level in its pixels.
SCALES, CORNERS, SIGMA = (1.0, 0.84, 0.71, 0.59, 0.5), 16, 1.0
#: Tests of a descriptor, the radius of the patch they are in, and how far corners keep from the edge.
BITS, PATCH = 128, 12
MARGIN = PATCH + 2
#: Tables, and the bits of a descriptor that one compares.
TABLES, KEY_BITS = 12, 26
VOTES = 5
#: Matched descriptors differ in at most so many bits.
DISTANCE = 28
#: Pictures are compared in pairs of blocks of about so many; in a task SLICE of them at a time, and so many pairs of features.
BLOCK, LEAST_BLOCKS, SLICE, PAIRS = 8_000, 3, 500, 1 << 20
#: Pictures of more pixels, or longer sides, are folded to this size as they are read, a strip of rows at a time.
LARGEST, SIDE, STRIP_BYTES = 1 << 22, 1 << 12, 1 << 24
#: Pictures of one size are measured so many pixels at a time.
STACK_PIXELS = 1 << 18


def _tests() -> np.ndarray:
    """Pairs of points within a disc, drawn evenly, which a turn leaves in it."""
    rng = np.random.default_rng(1234)
    points = rng.uniform(-PATCH, PATCH, (BITS * 8, 2))
    points = points[np.hypot(points[:, 0], points[:, 1]) <= PATCH][: 2 * BITS]
    return points.reshape(BITS, 4)


_TESTS = _tests()
_TABLE_BITS = [np.random.default_rng(100 + t).permutation(BITS)[:KEY_BITS] for t in range(TABLES)]
#: A corner: place in quarters of a pixel, level, and angle in 256ths of a turn.
_CORNER = np.dtype([("x", "<u2"), ("y", "<u2"), ("level", "u1"), ("angle", "u1")])
_FEATURE_BYTES = _CORNER.itemsize + BITS // 8


# ---------------------------------------------------------------- pictures


def encode_png(gray: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = gray.shape
    rows = np.hstack([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 1)) + part(b"IEND", b"")


def _unfilter(raw: np.ndarray, h: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((h, stride), dtype=np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(stride, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        elif kind == 1:
            out[y] = (line.reshape(-1, step).cumsum(axis=0) & 255).reshape(-1)
        else:
            row = np.zeros(stride + step, np.int64)
            for i in range(stride):
                a, b, c = row[i], up[i], up[i - step] if i >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[i + step] = (line[i] + guess) & 255
            out[y] = row[step:]
    return out


def _fold(w: int, h: int) -> int:
    """How many pixels a side become one, so that a picture has at most LARGEST pixels and SIDE a side."""
    return max(1, int(np.ceil(np.sqrt(w * h / LARGEST))), -(-max(w, h) // SIDE))


_GREY = np.array([0.299, 0.587, 0.114], np.float32)


def _means(px: np.ndarray, k: int) -> np.ndarray:
    """Grey levels of rows of pixels, k by k of them as one; what is left over at the edges goes."""
    px = px.astype(np.float32)
    grey = px[:, :, 0] if px.shape[2] < 3 else px[:, :, :3] @ _GREY
    if k == 1:
        return grey
    h, w = grey.shape[0] // k * k, grey.shape[1] // k * k
    return grey[:h, :w].reshape(h // k, k, w // k, k).mean(axis=(1, 3))


def _png(body: bytes, w: int, h: int, step: int) -> np.ndarray:
    """Grey levels of a PNG's compressed rows, inflated and folded strip by strip: a picture of any size takes a strip's memory and that of
    its folded pixels."""
    k, row = _fold(w, h), w * step + 1
    rows = k * max(1, STRIP_BYTES // (row * k))
    inflate, held, last, out = zlib.decompressobj(), bytearray(), None, []
    for lo in range(0, h, rows):
        n = min(rows, h - lo)
        while len(held) < n * row:
            more = inflate.decompress(body, n * row - len(held))
            body = inflate.unconsumed_tail
            if not more:
                raise ValueError("too few rows")
            held += more
        raw = np.frombuffer(bytes(held[: n * row]), np.uint8).reshape(n, row)
        del held[: n * row]
        if last is not None:  # a row may refer to the one above
            raw = np.vstack([np.concatenate([[np.uint8(0)], last])[None], raw])
        px = _unfilter(raw, len(raw), row - 1, step)[len(raw) - n :]
        last = px[-1]
        out.append(_means(px.reshape(n, w, step), k))
    return np.concatenate(out)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a PNG (8 bits, not interlaced, no palette), or of a binary PGM or PPM; None for anything else. Large pictures are
    folded: see ``_fold``."""
    try:
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            at, body, head = 8, [], None
            while at < len(data):
                n, kind = struct.unpack(">I4s", data[at : at + 8])
                if kind == b"IHDR":
                    head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + n])
                if kind == b"IDAT":
                    body.append(data[at + 8 : at + 8 + n])
                at += n + 12
            w, h, depth, colour, _, _, laced = head
            step = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
            if depth != 8 or laced or not w or not h:
                return None
            return _png(b"".join(body), w, h, step)
        if data and data[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while data[at : at + 1].isspace():
                    at += 1
                end = at
                while not data[end : end + 1].isspace():
                    end += 1
                fields.append(int(data[at:end]))
                at = end
            (w, h, most), step = fields, 1 if data[:2] == b"P5" else 3
            px, k = np.frombuffer(data, np.uint8, w * h * step, at + 1).reshape(h, w, step), _fold(w, h)
            rows = k * max(1, STRIP_BYTES // (w * step * k))
            return np.concatenate([_means(px[lo : lo + rows], k) for lo in range(0, h, rows)]) * np.float32(255 / most)
    except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
        return None
    return None


@functools.lru_cache(maxsize=256)
def _sampler(n: int, scale: float) -> np.ndarray:
    """A matrix that takes n values to those of a level: Gaussian means about its pixels' centres."""
    m = max(1, int(n * scale))
    centre = (np.arange(m) + 0.5) / scale - 0.5
    w = np.exp(-((np.arange(n)[None] - centre[:, None]) ** 2) / (2 * (SIGMA / scale) ** 2))
    return (w / w.sum(axis=1, keepdims=True)).astype(np.float32)


def _blur(px: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2r+1 pixels of a stack of pictures, the edge repeated."""
    h, w = px.shape[1:]
    p = np.pad(px, ((0, 0), (r, r), (r, r)), mode="edge")
    p = sum((p[:, k : k + h] for k in range(1, 2 * r + 1)), p[:, :h])
    return sum((p[:, :, k : k + w] for k in range(1, 2 * r + 1)), p[:, :, :w]) / (2 * r + 1) ** 2


_DY, _DX = (a.ravel() for a in np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1])
_DISC = _DX**2 + _DY**2 <= PATCH**2
_DY, _DX = _DY[_DISC], _DX[_DISC]


def features(stack: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of a stack of pictures of one size up to CORNERS corners of every level: records of _CORNER, and their BITS tests.

    A corner's angle is the direction of the brightness about it; tests are turned by it, and compare smoothed pixels.
    """
    n, height, width = stack.shape
    own, at, bits = [], [], []
    for level, scale in enumerate(SCALES):
        img = _sampler(height, scale) @ stack.astype(np.float32) @ _sampler(width, scale).T
        h, w = img.shape[1:]
        if min(h, w) <= 2 * MARGIN + 2:
            continue
        gy, gx = np.zeros_like(img), np.zeros_like(img)
        gy[:, 1:-1] = (img[:, 2:] - img[:, :-2]) / 2
        gx[:, :, 1:-1] = (img[:, :, 2:] - img[:, :, :-2]) / 2
        xx, yy, xy = (_blur(g, 2) for g in (gx * gx, gy * gy, gx * gy))
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = r[:, MARGIN : h - MARGIN, MARGIN : w - MARGIN]
        near = r[:, MARGIN - 1 : h - MARGIN + 1, MARGIN - 1 : w - MARGIN + 1]
        near = np.maximum(np.maximum(near[:, :-2], near[:, 1:-1]), near[:, 2:])
        near = np.maximum(np.maximum(near[:, :, :-2], near[:, :, 1:-1]), near[:, :, 2:])
        peak = np.where((inner >= near) & (inner > 1.0), inner, 0).reshape(n, -1)
        k = min(CORNERS, peak.shape[1])
        best = np.argsort(-peak, axis=1, kind="stable")[:, :k] if peak.shape[1] <= 64 else _greatest(peak, k)
        who, nth = np.nonzero(np.take_along_axis(peak, best, axis=1) > 0)
        if not len(who):
            continue
        place = best[who, nth]
        y, x = place // inner.shape[2] + MARGIN, place % inner.shape[2] + MARGIN
        soft = _blur(img, 2)
        patch = soft[who[:, None], y[:, None] + _DY, x[:, None] + _DX]
        angle = np.arctan2((patch * _DY).sum(axis=1), (patch * _DX).sum(axis=1))
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
        turn = lambda u, v: (who[:, None], np.rint(y[:, None] + s * u + c * v).astype(np.int64), np.rint(x[:, None] + c * u - s * v).astype(np.int64))
        bits.append(soft[turn(_TESTS[:, 0], _TESTS[:, 1])] < soft[turn(_TESTS[:, 2], _TESTS[:, 3])])
        corner = np.zeros(len(who), dtype=_CORNER)
        corner["x"], corner["y"] = (np.minimum(np.rint(((v + 0.5) / scale - 0.5) * 4), 65535) for v in (x, y))
        corner["level"], corner["angle"] = level, np.rint(angle / (2 * np.pi) * 256).astype(np.int64) % 256
        at.append(corner)
        own.append(who)
    if not own:
        return [(np.zeros(0, _CORNER), np.zeros((0, BITS), bool))] * n
    own, at, bits = np.concatenate(own), np.concatenate(at), np.concatenate(bits)
    order = np.argsort(own, kind="stable")
    cut = np.searchsorted(own[order], np.arange(n + 1))
    return [(at[order[i:j]], bits[order[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _greatest(v: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k greatest values, of equals the first, in no order."""
    return np.argpartition(-v + np.arange(v.shape[1], dtype=np.float64) * 1e-9, k - 1, axis=1)[:, :k]


def _unpacked(at: np.ndarray) -> np.ndarray:
    """Rows of x, y, scale and angle."""
    return np.column_stack([at["x"] / 4, at["y"] / 4, np.array(SCALES)[at["level"]], at["angle"] / 256 * 2 * np.pi])


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of 128 bits as two longs."""
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.int64)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, id, own, image) with the features of the picture in place of it; null for none. Equal pictures of a batch are read once."""
    for pdf in batches:
        groups: dict[tuple, list] = {}
        data: dict[bytes, bytes] = {}
        first = pdf.drop_duplicates("own")
        for own, image in zip(first["own"], first["image"], strict=True):
            px = decode(image)
            if px is None:
                continue
            held = groups.setdefault(px.shape, [])
            held.append((own, px))
            if len(held) * px.size >= STACK_PIXELS:
                data |= _measured(groups.pop(px.shape))
        for held in groups.values():
            data |= _measured(held)
        yield pd.DataFrame({"id": pdf["id"], "own": pdf["own"], "data": [data.get(k) for k in pdf["own"]]})


def _measured(held: list[tuple[bytes, np.ndarray]]) -> dict[bytes, bytes]:
    found = features(np.stack([px for _, px in held]))
    return {own: at.tobytes() + _words(bits).tobytes() for (own, _), (at, bits) in zip(held, found, strict=True) if len(at)}


# ---------------------------------------------------------------- matching


def consensus(a: np.ndarray, b: np.ndarray, slack: float = 3.0) -> int:
    """How many matches (rows of x, y, scale, angle) agree on one similarity: the best of those that single matches propose. Corners count once."""
    ratio = a[:, 2] / b[:, 2]
    turn = b[:, 3] - a[:, 3]
    c, s = np.cos(turn) * ratio, np.sin(turn) * ratio
    dx, dy = a[None, :, 0] - a[:, None, 0], a[None, :, 1] - a[:, None, 1]
    px = b[:, None, 0] + c[:, None] * dx - s[:, None] * dy
    py = b[:, None, 1] + s[:, None] * dx + c[:, None] * dy
    near = np.hypot(px - b[None, :, 0], py - b[None, :, 1]) <= slack * np.maximum(1, 1 / b[None, :, 2])
    spun = np.abs((turn[None, :] - turn[:, None] + np.pi) % (2 * np.pi) - np.pi) < 0.5
    fits = near & spun
    best = int(fits.sum(axis=1).argmax())
    return len({(round(x / 3), round(y / 3)) for x, y in a[fits[best], :2]})


class _Block:
    """The features of some pictures, one after another, and for each table their compared bits, in order."""

    def __init__(self, data: list[bytes]) -> None:
        n = np.array([len(d) // _FEATURE_BYTES for d in data], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.own = np.repeat(np.arange(len(data), dtype=np.int32), n)
        split = [k * _CORNER.itemsize for k in n]
        self.at = np.frombuffer(b"".join(d[:k] for d, k in zip(data, split, strict=True)), _CORNER)
        self.words = np.frombuffer(b"".join(d[k:] for d, k in zip(data, split, strict=True)), np.uint64).reshape(-1, 2)
        raw = self.words.view(np.uint8).reshape(-1, BITS // 8)
        self.keys = [np.zeros(len(raw), dtype=np.uint32) for _ in range(TABLES)]
        for key, bits in zip(self.keys, _TABLE_BITS, strict=True):
            for b in bits.tolist():
                key <<= 1
                key |= (raw[:, b // 8] >> (7 - b % 8)) & 1

    @functools.cached_property
    def order(self) -> list[np.ndarray]:
        return [np.argsort(k, kind="stable").astype(np.int32) for k in self.keys]

    @functools.cached_property
    def sorted(self) -> list[np.ndarray]:
        return [k[o] for k, o in zip(self.keys, self.order, strict=True)]


def _matches(left: _Block, right: _Block, lo: int, hi: int, twins: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of left's pictures lo to hi and of right within DISTANCE that agree in a table, each pair once. twins: left is right; pairs
    of a picture and a later one, or itself where twins."""
    every = np.arange(left.first[lo], left.first[hi])
    for t in range(TABLES):
        rows = every[np.argsort(left.keys[t][every], kind="stable")]  # searched in order
        begin = np.searchsorted(right.sorted[t], left.keys[t][rows], side="left")
        n = np.searchsorted(right.sorted[t], left.keys[t][rows], side="right") - begin
        some = np.flatnonzero(n)
        rows, begin, n = rows[some], begin[some], n[some]
        for i, j in chunks(n, PAIRS):
            m = n[i:j]
            a = np.repeat(rows[i:j], m)
            b = right.order[t][np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[i:j], m)].astype(np.int64)
            if twins is not None:
                keep = (right.own[b] > left.own[a]) | ((right.own[b] == left.own[a]) & twins[left.own[a]])
                a, b = a[keep], b[keep]
            keep = np.flatnonzero(np.bitwise_count(left.words[a] ^ right.words[b]).sum(axis=1, dtype=np.int64) <= DISTANCE)
            a, b = a[keep], b[keep]
            for u in range(t):
                new = left.keys[u][a] != right.keys[u][b]
                a, b = a[new], b[new]
            yield a, b


def _linked(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "key"], kind="stable")
        low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
        sides = [pdf[pdf["block"] == b] for b in ((low,) if low == high else (low, high))]
        if any(side.empty for side in sides):
            return pd.DataFrame({"node": [], "root": [], "others": [], "alike": []})
        keys = [side["key"].to_list() for side in sides]
        left, right = (blocks := [_Block(side["data"].to_list()) for side in sides])[0], blocks[-1]
        twins = sides[0]["twins"].to_numpy(bool) if low == high else None
        weight = {k: n for side in sides for k, n in zip(side["key"], side["rows"], strict=True)}
        others, root, alike = dict.fromkeys(weight, 0), {k: k for k in weight}, set()

        def top(k: bytes) -> bytes:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for lo in range(0, len(keys[0]), SLICE):
            a, b = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *_matches(left, right, lo, min(lo + SLICE, len(keys[0])), twins), strict=True))
            pair = left.own[a].astype(np.int64) * len(keys[-1]) + right.own[b]
            _, where, votes = np.unique(pair, return_inverse=True, return_counts=True)
            a, b, pair = (x[votes[where] >= least] for x in (a, b, pair))
            order = np.lexsort((b, a, pair))
            a, b, pair = a[order], b[order], pair[order]
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else []
            for i, j in zip(starts, [*starts[1:], len(pair)], strict=False):
                p, q = keys[0][left.own[a[i]]], keys[-1][right.own[b[i]]]
                x, y = _unpacked(left.at[a[i:j]]), _unpacked(right.at[b[i:j]])
                if (consensus(x, y) if p <= q else consensus(y, x)) < least:
                    continue
                if p == q:
                    alike.add(p)
                    continue
                others[p] += weight[q]
                others[q] += weight[p]
                p, q = top(p), top(q)
                root[max(p, q)] = min(p, q)
        return pd.DataFrame([(k, top(k), n, k in alike) for k, n in others.items() if n or k in alike], columns=["node", "root", "others", "alike"])

    return run


def picture_links(found: DataFrame, least: int = VOTES) -> DataFrame:
    """Of pictures (key, data, rows, twins) those whose matched corners agree with another's on a similarity transform: node, root (the
    least it is linked to here), others (rows of those linked to it), alike (has twins and agrees with itself).

    Features match if they agree on the bits of one of TABLES tables and differ in at most DISTANCE bits: all that do,
    however many share the bits. Pictures meet in pairs of blocks, so that there are no rows for pairs; a picture has a row for each.
    """
    blocks = max(LEAST_BLOCKS, -(-found.count() // BLOCK))
    own = found.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = own.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "data", "rows", "twins")
    return staged(met.groupBy("low", "high").applyInPandas(_linked(least), "node binary, root binary, others long, alike boolean"), "links")


def picture_copies(media: DataFrame, image: str = "image", key: str = "media_id", least: int = VOTES) -> DataFrame:
    """One row per row of media: key, class_id (least key of its class, its own without links) and n_links.

    Pictures of equal bytes are one beforehand (each linked to the others); others are linked if at least ``least``
    corners agree on one shift, turn and scale, which crops and changes of brightness keep. n_links counts rows
    linked to the picture directly. Null and undecodable pictures are linked only to equal bytes, null to none;
    a picture without corners likewise. Pictures of equal features are compared once. Keys are integers, null ones
    too; repeated rows count each.
    """
    clash = fresh(media, "own")[0]
    # One pass over the pictures: what follows needs their keys, digests and features only.
    rows = media.select(F.col(key).cast("long").alias("id"), F.unhex(F.md5(image)).alias("own"), F.col(image).alias("image"))
    rows = staged(rows.mapInPandas(_extract, "id long, own binary, data binary"), "features")
    classes = staged(rows.where("own is not null").groupBy(F.col("own").alias("key")).agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("data", ignorenulls=True).alias("data")), "pictures")
    found = classes.where("data is not null").select("key", "data")
    # Pictures of equal features are compared as one, the node, which counts for all their rows.
    nodes = staged(found.withColumn("equal", F.sha2("data", 256)).groupBy("equal").agg(F.min("key").alias("node")), "nodes")
    placed = staged(found.select("key", F.sha2("data", 256).alias("equal")).join(nodes, "equal").select("key", "node").join(classes.select("key", "n"), "key"), "placed")
    weight = staged(placed.groupBy("node").agg(F.sum("n").alias("rows"), (F.count("*") > 1).alias("twins")), "weights")
    links = picture_links(found.join(weight.withColumnRenamed("node", "key"), "key"), least)
    apart = links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    direct = links.groupBy("node").agg(F.sum("others").alias("others"), F.max("alike").alias("alike"))
    if not apart.isEmpty():
        roots = components(apart)
    else:
        roots = links.select("node", "root").where("false")
    linked = placed.join(weight, "node").join(direct, "node", "left").join(roots, "node", "left")
    linked = linked.select("key", F.coalesce("root", F.when(F.col("alike"), F.col("node"))).alias("root"), (F.coalesce("others", F.lit(0)) + F.when(F.col("alike"), F.col("rows") - F.col("n")).otherwise(0)).alias("links"))
    out = classes.join(linked, "key", "left")
    out = staged(out.withColumns({"root": F.coalesce("root", "key"), "links": F.coalesce("links", F.lit(0)) + F.col("n") - 1}), "linked")
    least_id = staged(out.groupBy("root").agg(F.min("least").alias("class_id")), "class_ids")
    labels = staged(out.join(least_id, "root").select("key", "class_id", "links"), "labels")
    got = rows.select(F.col("id").alias(key), F.col("own").alias(clash)).join(labels.withColumnRenamed("key", clash), clash, "left")
    return got.select(F.col(key).cast(dict(media.dtypes)[key]).alias(key), F.coalesce("class_id", F.col(key).cast("long")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


# ---------------------------------------------------------------- a media column for tables that have vectors only


_WAVES, _LOWEST, _STEP = 22, 3.0, 1.5


@functools.cache
def _mixture(n: int) -> np.ndarray:
    """Weights of the waves by a vector's n components: random, and less for high waves, as in photographs."""
    f = _LOWEST + _STEP * np.arange(_WAVES)
    return np.random.default_rng(77).normal(size=(_WAVES, _WAVES, n)) / (np.hypot(f[:, None], f[None]) ** 0.75)[:, :, None]


@functools.cache
def _basis(side: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(_LOWEST + _STEP * np.arange(_WAVES), np.arange(side) + 0.5) / side)


def waves(vector: list[float], side: int = 96) -> np.ndarray:
    """Grey levels of a sum of waves of many lengths along both axes, weighed by the vector's direction: near vectors give near pictures."""
    x = np.nan_to_num(np.array([0.0 if e is None else e for e in vector], dtype=float))
    out = _basis(side).T @ (_mixture(len(x)) @ (x / max(np.linalg.norm(x), 1e-9))) @ _basis(side)
    return 127 + 110 * np.tanh(0.7 * out / max(out.std(), 1e-9))


def render_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds image: the vector's waves() in a PNG (null for a null or empty vector). A column image is replaced."""

    def draw(values: pa.Array) -> pa.Array:
        return pa.array([encode_png(waves(v)) if v else None for v in values.to_pylist()], pa.binary())

    return vectors.drop("image").withColumn("image", F.arrow_udf(draw, "binary")(F.col(vector)))
