"""Copies of images by local descriptors: cropped, brightened, scaled or noisy copies find their originals.

Images of equal pixels are one class from the start. Of each class, corners are sought at several scales (largest responses
of the smaller eigenvalue of the gradient matrix, not next to a larger one); each gets the orientation of its patch's
intensity centroid and a descriptor of BITS intensity comparisons on the patch turned by it. The number of corners of a scale
is CORNERS, and as many for each AREA pixels of larger images. The comparisons are chosen once, on drawn pictures: of many
random ones those that vary most and say little that others say already, each held against its own median, so that a bit is
as often set as not and few descriptors agree by chance. Descriptors are cut into PARTS parts; those that agree in any
whole part and are at most NEAR bits apart are matches: any two that differ in up to PARTS - 1 bits meet, and others
whose differences leave a part alone. Matches vote for the scale, turn and shift between two images. Where VOTES features agree,
all descriptors of the two images are compared, and CONFIRM agreeing ones make a link; linked images are a group.

Images are dealt into blocks of bounded bytes, and every two blocks are compared in one task, which so has all matches of two
images together: lists are expanded in slices of about LIST matches, and only links leave it, as the number of an image's links and
the least image that it reaches. No list is cut, however long; work grows with the matches, by chance or not, and so with the square
of the number of images.

Pixels: PGM, PPM (binary), PNG (8 bit, grey or colour, not interlaced). Null, empty or other bytes: no features, linked with
nothing, not even with each other. Images without corners: linked with equal ones. Very large ones (over LARGEST pixels wide or
high): thinned before corners are sought. Null id: comes out alone. Repeated ids: one node. Ties: corners of equal response by
place; a group is named by its least id. Empty table: empty result. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import lean, lean_group, stage
from sluice.llm.components import components

SCALES, CORNERS, AREA, BITS, RADIUS, TURNS, LIST, VOTES, CONFIRM, BLOCK, BLOCKS = (1.0, 0.84, 0.7), 32, 72 * 72, 128, 7, 24, 1 << 21, 4, 8, 24_000_000, 4
PARTS, NEAR, GRAIN, LARGEST = 4, 24, 4, 16_000
#: Comparisons from which the descriptor's are chosen, drawn pictures on which, and the correlation from which on two say the same.
TRIED, PICTURES, ALIKE = 1024, 100, 0.2
_DISK = np.stack(np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]).reshape(2, -1)
_DISK = _DISK[:, (_DISK**2).sum(0) <= RADIUS**2]


@dataclass(frozen=True)
class Tests:
    """Pairs of points (turn, test, point, x and y) and the value of each above which its bit is set."""

    points: np.ndarray
    middle: np.ndarray


@functools.cache
def tests(seed: int = 11) -> Tests:
    """The comparisons of descriptors. Made by whoever starts a search and sent to all workers, as another machine's rounding might choose others."""
    rng = np.random.default_rng(seed)
    pairs = np.clip(rng.normal(0, RADIUS / 2, (TRIED, 2, 2)), -RADIUS + 2, RADIUS - 2)
    pairs = pairs[np.abs(pairs[:, 0] - pairs[:, 1]).max(1) > 2]
    angles = np.arange(TURNS) * 2 * np.pi / TURNS
    points = np.stack([np.rint(pairs @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])).astype(np.int8) for a in angles])
    values = np.concatenate([_values(*c, points) for _ in range(PICTURES) for c in corners_of(drawn(rng.normal(size=8)), CORNERS)])
    middle = np.median(values, 0)
    bits = (values > middle).astype(np.float64)
    bits = (bits - bits.mean(0)) / (bits.std(0) + 1e-9)
    alike, order = np.abs(bits.T @ bits / len(bits)), np.argsort(-values.std(0), kind="stable")
    limit = ALIKE
    while True:
        chosen: list[int] = []
        for k in order.tolist():
            if len(chosen) < BITS and (not chosen or alike[k, chosen].max() < limit):
                chosen.append(k)
        if len(chosen) == BITS:
            break
        limit += 0.02
    chosen = [k for p in range(PARTS) for k in chosen[p::PARTS]]  # parts of equal worth
    return Tests(points[:, chosen], middle[chosen])


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels (height x width, uint8), or None if the bytes are no image that is read here."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            head = re.match(rb"P[56]\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
            width, height, top = map(int, head.groups())
            depth = 1 if data[:2] == b"P5" else 3
            pixels = np.frombuffer(data, np.uint8, width * height * depth, head.end()).reshape(height, width, depth)
            return _grey(pixels) if top < 256 and width and height else None
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (AttributeError, ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    return pixels[..., 0] if pixels.shape[2] < 3 else np.rint(pixels[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _png(data: bytes) -> np.ndarray | None:
    at, packed, head, palette = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None:
        return None
    width, height, bits, colour, _, _, interlaced = head
    if bits != 8 or interlaced:
        return None
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * depth)
    out, above = np.zeros((height, width * depth), np.int64), np.zeros(width * depth, np.int64)
    for y in range(height):
        how, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if how == 2:
            line = line + above
        elif how == 1:
            line = np.cumsum(line.reshape(width, depth), 0).reshape(-1)
        elif how:
            for x in range(len(line)):
                a, b, c = (int(line[x - depth]) if x >= depth else 0), int(above[x]), (int(above[x - depth]) if x >= depth else 0)
                if how == 3:
                    p = (a + b) // 2
                else:
                    near = a + b - c
                    p = min((abs(near - a), 0, a), (abs(near - b), 1, b), (abs(near - c), 2, c))[2]
                line[x] = (line[x] + p) & 255
        out[y] = above = line & 255
    pixels = out.astype(np.uint8).reshape(height, width, depth)
    return _grey(palette[pixels[..., 0]]) if colour == 3 else _grey(pixels)


def _blur(x: np.ndarray) -> np.ndarray:
    """A 3 x 3 binomial blur; edges repeat."""
    p = np.pad(x, 1, mode="edge")
    p = p[:-2] + 2 * p[1:-1] + p[2:]
    return (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 16


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return x
    h, w = int(x.shape[0] * scale), int(x.shape[1] * scale)
    if min(h, w) < 1:
        return x[:0]
    v, u = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, x.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, x.shape[1] - 1)
    i, j = np.minimum(v.astype(int), max(0, x.shape[0] - 2)), np.minimum(u.astype(int), max(0, x.shape[1] - 2))
    a, b = (v - i)[:, None], (u - j)[None, :]
    i2, j2 = np.minimum(i + 1, x.shape[0] - 1), np.minimum(j + 1, x.shape[1] - 1)
    return (1 - a) * ((1 - b) * x[np.ix_(i, j)] + b * x[np.ix_(i, j2)]) + a * ((1 - b) * x[np.ix_(i2, j)] + b * x[np.ix_(i2, j2)])


def corners_of(image: np.ndarray, corners: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
    """(smoothed pixels, ys, xs, turns, contrasts, scale) of the corners at each scale."""
    for scale in SCALES:
        if int(min(image.shape) * scale) <= 2 * RADIUS + 3:
            continue
        x = _blur(_resized(_blur(image.astype(np.float64)), scale))
        gy, gx = np.gradient(x)
        a, b, c = _blur(_blur(gx * gx)), _blur(_blur(gx * gy)), _blur(_blur(gy * gy))
        response = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
        inner = response[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1]
        h, w = inner.shape
        around = np.max([response[RADIUS + 1 + dy : RADIUS + 1 + dy + h, RADIUS + 1 + dx : RADIUS + 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx], 0)
        ys, xs = np.nonzero((inner > around) & (inner > 1.0))
        best = np.lexsort((xs, ys, -np.round(inner[ys, xs], 6)))[:corners]
        ys, xs = ys[best] + RADIUS + 1, xs[best] + RADIUS + 1
        if not len(ys):
            continue
        smooth = _blur(x)
        patch = smooth[ys[:, None] + _DISK[0], xs[:, None] + _DISK[1]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2((patch * _DISK[0]).sum(1), (patch * _DISK[1]).sum(1))
        turn = np.rint(angle / (2 * np.pi / TURNS)).astype(int) % TURNS
        yield smooth, ys, xs, turn, patch.std(1) + 1e-6, scale


def _values(smooth: np.ndarray, ys: np.ndarray, xs: np.ndarray, turn: np.ndarray, contrast: np.ndarray, scale: float, points: np.ndarray) -> np.ndarray:
    """What each comparison measures at each corner, in units of its patch's contrast."""
    at = points[turn].astype(np.int64)
    one, two = (smooth[ys[:, None] + at[:, :, k, 1], xs[:, None] + at[:, :, k, 0]] for k in (0, 1))
    return (one - two) / contrast[:, None]


#: A feature: its descriptor, turn, scale (sixteenths of its log2) and place (in GRAINs of a pixel).
_RECORD = np.dtype([("words", "<u4", PARTS), ("turn", "u1"), ("s", "i1"), ("x", "<u2"), ("y", "<u2")])


def features(image: np.ndarray, by: Tests, corners: int | None = None) -> np.ndarray:
    """Records of the corners of an image."""
    corners = CORNERS * max(1, -(-image.size // AREA)) if corners is None else corners
    thin = -(-max(image.shape) // LARGEST)  # of very large images every second, third.. pixel
    out = [np.zeros(0, _RECORD)]
    for smooth, ys, xs, turn, contrast, scale in corners_of(image[::thin, ::thin], corners):
        own = np.zeros(len(ys), _RECORD)
        own["words"] = np.packbits(_values(smooth, ys, xs, turn, contrast, scale, by.points) > by.middle, axis=1).view("<u4")
        own["turn"], own["s"] = turn, np.rint(-np.log2(scale) * 16)
        own["x"], own["y"] = np.rint(xs / scale * GRAIN), np.rint(ys / scale * GRAIN)
        out.append(own)
    return np.concatenate(out)


def _described(by: Tests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, records = [], []
            for value in batch.column(1):
                image = decode(value.as_py())
                digests.append(None if image is None else hashlib.blake2b(struct.pack("<II", *image.shape) + image.tobytes(), digest_size=16).digest())
                records.append(features(image, by).tobytes() if image is not None else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(records, pa.binary())], names=["media_id", "digest", "features"])

    return run


def _meet(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Whether descriptors that agree in part t are near, and agree in no part before it: each match counts once."""
    apart = a ^ b
    return (np.bitwise_count(apart).sum(1, dtype=np.uint8) <= NEAR) & (apart[:, :t] != 0).all(1)


class _Block:
    def __init__(self, table: pa.Table):
        self.reps, parts = table["rep"].to_numpy(), table["features"].to_pylist()
        self.features = np.frombuffer(b"".join(parts), _RECORD)
        sizes = np.array([len(p) // _RECORD.itemsize for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.image = np.repeat(np.arange(len(parts)), sizes)
        self.words = np.ascontiguousarray(self.features["words"])


def _agreeing(x: _Block, y: _Block, fx: np.ndarray, fy: np.ndarray, code: np.ndarray, votes: int) -> np.ndarray:
    """The codes (of pairs of images) with enough matches that agree on scale, turn and shift; cells of two grids, so that no edge divides them."""
    turned = (x.reps[x.image[fx]] > y.reps[y.image[fy]])[:, None]
    left, right = x.features[fx], y.features[fy]
    a, b = {}, {}
    for k in ("turn", "s", "x", "y"):
        both = np.column_stack([left[k], right[k]]).astype(np.float64) / (GRAIN if k in ("x", "y") else 1)
        a[k], b[k] = np.where(turned, both[:, ::-1], both).T
    own = np.where(turned[:, 0], fy, fx)
    turn, zoom = (b["turn"] - a["turn"]) % TURNS, b["s"] - a["s"]
    angle, scale = turn * (2 * np.pi / TURNS), 2.0 ** (zoom / 16)
    dx = b["x"] - scale * (np.cos(angle) * a["x"] - np.sin(angle) * a["y"])
    dy = b["y"] - scale * (np.sin(angle) * a["x"] + np.cos(angle) * a["y"])
    out = []
    for g in (0.0, 0.5):
        rows = np.column_stack([code, zoom, np.floor(turn / 2 + g), np.floor(dx / 8 + g), np.floor(dy / 8 + g), own]).astype(np.int64)
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(1))]  # a feature votes once
        begin = np.flatnonzero(np.append(True, (rows[1:, :-1] != rows[:-1, :-1]).any(1)))
        out.append(rows[begin[np.diff(np.append(begin, len(rows))) >= votes], 0])
    return np.unique(np.concatenate(out))


def _confirmed(x: _Block, y: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of images have CONFIRM features that agree when all are compared."""
    fx, fy, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    out = [np.zeros(0, np.int64)]
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        apart = x.words[x.first[a] : x.first[a + 1], None] ^ y.words[None, y.first[b] : y.first[b + 1]]
        p, q = np.nonzero(np.bitwise_count(apart).sum(2, dtype=np.uint8) <= NEAR)
        fx.append(p + x.first[a])
        fy.append(q + y.first[b])
        code.append(np.full(len(p), k))
        if k % 512 == 511 or k == len(i) - 1:
            parts = [np.concatenate(v) for v in (fx, fy, code)]
            if len(parts[0]):
                out.append(_agreeing(x, y, *parts, CONFIRM))
            fx, fy, code = [], [], []
    return np.concatenate(out)


def _linked(x: _Block, y: _Block, same: bool, votes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked images of two blocks; each pair once."""
    lists, total = [], np.zeros(len(x.words) + 1, np.int64)
    for t in range(PARTS):
        mine, theirs = x.words[:, t], y.words[:, t]
        order = np.argsort(theirs, kind="stable").astype(np.int32)
        theirs = theirs[order]
        lo = np.searchsorted(theirs, mine).astype(np.int32)
        n = np.searchsorted(theirs, mine, "right").astype(np.int32) - lo
        total[1:] += n
        lists.append((order, lo, n))
    total = np.cumsum(total)[x.first]  # matches before each image
    width, start, found = len(y.reps), 0, [np.zeros((2, 0), np.int64)]
    while start < len(x.reps):
        stop = int(np.searchsorted(total, total[start] + LIST, "right")) - 1
        stop = min(max(stop, start + 1), start + max(1, (1 << 22) // max(width, 1)), len(x.reps))
        i, j, pairs = x.first[start], x.first[stop], []
        for t, (order, lo, n) in enumerate(lists):
            own = n[i:j].astype(np.int64)
            fx = np.repeat(np.arange(i, j), own)
            fy = order[np.repeat(lo[i:j] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
            keep = _meet(x.words[fx], y.words[fy], t)
            if same:
                keep &= x.reps[x.image[fx]] < y.reps[y.image[fy]]
            pairs.append((fx[keep], fy[keep]))
        fx, fy = (np.concatenate(p) for p in zip(*pairs, strict=True))
        code = (x.image[fx] - start) * width + y.image[fy]
        enough = np.bincount(code, minlength=1)[code] >= votes if len(code) else np.zeros(0, bool)
        if enough.any():
            fx, fy, code = fx[enough], fy[enough], code[enough]
            sure = _agreeing(x, y, fx, fy, code, CONFIRM)
            maybe = np.setdiff1d(_agreeing(x, y, fx, fy, code, votes), sure)
            maybe = maybe[_confirmed(x, y, maybe // width + start, maybe % width)]
            code = np.concatenate([sure, maybe])
            found.append(np.stack([code // width + start, code % width]))
        start = stop
    i, j = np.concatenate(found, 1)
    return i, j


def _reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n nodes that each reaches by links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(votes: int):
    """Over the images (x, y, own, rep, features) of two blocks: those with links, the least image reached by them, their number."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        same = key[0] == key[1]
        x = _Block(table.filter(pa.compute.equal(table["own"], key[0])))
        y = x if same else _Block(table.filter(pa.compute.equal(table["own"], key[1])))
        i, j = _linked(x, y, same, votes)
        reps, at = np.unique(np.concatenate([x.reps[i], y.reps[j]]), return_inverse=True)
        root = reps[_reached(len(reps), at[: len(i)], at[len(i) :])]
        return pa.table({"rep": pa.array(reps, pa.int64()), "root": pa.array(root, pa.int64()), "n": pa.array(np.bincount(at, minlength=len(reps)), pa.int64())})

    return compare


def copies(media: DataFrame, id_col: str = "media_id", bytes_col: str = "bytes", votes: int = VOTES) -> DataFrame:
    """(media_id, n_features, n_links, component_id): links between classes of equal images, and the least id that each reaches."""
    plain = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(bytes_col).alias("bytes"))
    found = stage(plain.mapInArrow(lean(_described(tests())), "media_id long, digest binary, features binary"), "described")
    reps = stage(found.where("digest IS NOT NULL AND media_id IS NOT NULL").groupBy("digest").agg(F.min("media_id").alias("rep")), "classes")
    # of each class the features of its first image
    chosen = found.join(reps.select("digest", F.col("rep").alias("media_id")), ["digest", "media_id"]).dropDuplicates(["digest", "media_id"])
    size = chosen.agg(F.sum(F.length("features"))).first()[0] or 0
    blocks = max(size // BLOCK + 1, BLOCKS)
    own = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("long")
    dealt = chosen.where(F.length("features") > 0).select(F.col("media_id").alias("rep"), "features").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "features")
    reached = stage(dealt.groupBy("x", "y").applyInArrow(lean_group(_compared(votes)), "rep long, root long, n long"), "links")
    links = reached.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    degree = reached.groupBy("rep").agg(F.sum("n").alias("n_links"))
    joined = components(links).withColumnRenamed("node", "rep")
    named = reps.join(joined, "rep", "left").join(degree, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = found.select("media_id", F.floor(F.length("features") / _RECORD.itemsize).cast("long").alias("n_features"), "digest").join(named, "digest", "left")
    component = F.when(F.col("media_id").isNotNull(), F.coalesce("component", "media_id"))
    return out.select("media_id", "n_features", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))


def pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def drawn(vector: np.ndarray, size: int = 72) -> np.ndarray:
    """A picture for a vector, always the same: a soft ground with shapes, all from a generator that the vector seeds."""
    rng = np.random.default_rng(np.frombuffer(hashlib.blake2b(np.ascontiguousarray(vector, np.float64).tobytes(), digest_size=16).digest(), np.uint32))
    ground = _resized(rng.uniform(60, 190, (5, 5)), size / 5)[:size, :size]
    out = np.pad(ground, ((0, size - ground.shape[0]), (0, size - ground.shape[1])), mode="edge")
    for _ in range(22):
        x, y, w, h = rng.integers(0, size - 6), rng.integers(0, size - 6), rng.integers(4, 22), rng.integers(4, 22)
        out[y : y + h, x : x + w] += rng.uniform(-80, 80)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def edited(pixels: np.ndarray, kind: int) -> np.ndarray:
    """A copy: cropped, brightened, cropped and darkened, noisy, or turned by a quarter."""
    if kind == 0:
        return pixels[4:66, 6:70]
    if kind == 1:
        return np.clip(pixels * 0.85 + 24, 0, 255).astype(np.uint8)
    if kind == 2:
        return np.clip(pixels[8:, :66] * 0.9, 0, 255).astype(np.uint8)
    if kind == 3:
        return np.clip(pixels + np.random.default_rng(1).integers(-2, 3, pixels.shape), 0, 255).astype(np.uint8)
    return np.rot90(pixels)


def gallery(vectors: DataFrame, every: int = 10, offset: int = 10**12) -> DataFrame:
    """A media table (media_id, bytes) drawn from vectors: one image for each row, and for ids divisible by `every` an edited copy under id + offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                picture = drawn(np.array([np.nan if x is None else x for x in v], np.float64)) if v is not None else None
                ids.append(i)
                data.append(pgm(picture) if picture is not None else None)
                if i is not None and i % every == 0 and picture is not None:
                    ids.append(i + offset)
                    data.append(pgm(edited(picture, i // every % 5)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["media_id", "bytes"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(lean(run), "media_id long, bytes binary")
