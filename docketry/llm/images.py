"""Copies among images, cropped or edited, by local descriptors.

Corners are found at many scales, each gets an orientation and 256 binary brightness tests turned by it.  A table key
joins a sample of a corner's tests with one of a neighbour's and with how the two lie to each other, so corners that
look alike in many images (the corner of a box, a letter) don't share a key.  Images that meet in two keys are
candidates: all their descriptors are compared by Hamming distance, and a consensus of matches on one similarity
transform, refitted to its corners, makes a link.

Images are 8-bit grey PGM (P5) in a binary column.  Mirrored copies aren't found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import by_shuffle, materialise, only
from docketry.llm.neardup import components

#: Scales of an octave; a corner is the strongest within this many pixels at its scale, so cropping doesn't choose others.
OCTAVE, ALONE = 6, 4
#: Smaller images are enlarged to this side, by MOST at most.
SIDE_LEAST, MOST = 96, 4.0
RADIUS, TESTS, ANGLES = 13, 256, 36
#: A test holds where one point is brighter than the other by this share of the patch's deviation.
BRIGHTER = 0.15
EDGE = RADIUS + 2
#: Tables, bits that each of two corners gives to a key, and neighbours of a corner that give keys with it.
TABLES, KEY_BITS, NEIGHBOURS = 2, 26, 3
#: Keys in common that make two images candidates.
MEETINGS = 2
#: Entries of a bucket up to which its pairs are formed where it lies; larger ones are cut into blocks of so many entries.
SMALL = 64
#: Descriptors farther apart than this aren't the same corner.
NEAR = 48
#: Corners that must agree on one transform in both images, and the pixels apart that make two of them.
CONSENSUS, APART = 8, 6.0
#: Rows and cells that a task holds at once.
GATHER, CELLS = 100_000, 1_000_000

_HEADER = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", re.DOTALL)


def to_pgm(pixels: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.astype(np.uint8).tobytes()


def from_pgm(data: bytes | None) -> np.ndarray | None:
    """The pixels, or None for what isn't a whole image of this kind."""
    m = _HEADER.match(data or b"")
    if not m or m[3] != b"255":
        return None
    width, height = int(m[1]), int(m[2])
    raw = data[m.end() :]
    return np.frombuffer(raw, dtype=np.uint8, count=width * height).reshape(height, width).astype(np.float32) if width * height and len(raw) >= width * height else None


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    y, x = (np.arange(height) + 0.5) * image.shape[0] / height - 0.5, (np.arange(width) + 0.5) * image.shape[1] / width - 0.5
    y, x = y.clip(0, image.shape[0] - 1), x.clip(0, image.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), image.shape[0] - 2).clip(0), np.minimum(x.astype(int), image.shape[1] - 2).clip(0)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None, :].astype(np.float32)
    top, low = image[y0], image[y1]
    return (top[:, x0] * (1 - fx) + top[:, x1] * fx) * (1 - fy) + (low[:, x0] * (1 - fx) + low[:, x1] * fx) * fy


def _blur(a: np.ndarray, times: int = 1) -> np.ndarray:
    """Binomial weights 1, 2, 1 along both axes; the edge is repeated."""
    for _ in range(times):
        b = 2 * a
        b[1:] += a[:-1]
        b[:-1] += a[1:]
        b[0] += a[0]
        b[-1] += a[-1]
        a = 2 * b
        a[:, 1:] += b[:, :-1]
        a[:, :-1] += b[:, 1:]
        a[:, 0] += b[:, 0]
        a[:, -1] += b[:, -1]
        a *= 0.0625
    return a


def _highest(a: np.ndarray, radius: int) -> np.ndarray:
    """The greatest value within ``radius`` along both axes."""
    for _ in range(2):
        padded = np.full((a.shape[0] + 2 * radius, a.shape[1]), -np.inf, dtype=a.dtype)
        padded[radius:-radius] = a
        width, n = 1, len(a)
        while 2 * width <= 2 * radius + 1:
            padded, width = np.maximum(padded[:-width], padded[width:]), 2 * width
        last = 2 * radius + 1 - width
        a = np.ascontiguousarray(np.maximum(padded[:n], padded[last : last + n]).T)
    return a


def corners(image: np.ndarray) -> np.ndarray:
    """Rows (y, x) of corners away from the border, each the strongest within ALONE pixels."""
    gy, gx = np.gradient(image)
    xx, yy, xy = _blur(gx * gx, 2), _blur(gy * gy, 2), _blur(gx * gy, 2)
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    y, x = np.nonzero((strength == _highest(strength, ALONE)) & (strength > 1.0))
    inside = (y >= EDGE) & (y < image.shape[0] - EDGE) & (x >= EDGE) & (x < image.shape[1] - EDGE)
    return np.column_stack([y[inside], x[inside]])


def enlarged(image: np.ndarray) -> np.ndarray:
    """A small image enlarged so that corners away from the border fit in; others as they are."""
    by = min(SIDE_LEAST / min(image.shape), MOST)
    return image if by <= 1 else resize(image, round(image.shape[0] * by), round(image.shape[1] * by))


def _points() -> np.ndarray:
    """Rows (y, x) of brightness points: the centre and four rings around it."""
    out = [np.zeros((1, 2))]
    for share, n in ((0.3, 6), (0.55, 10), (0.8, 14), (1.0, 18)):
        turn = np.arange(n) * 2 * np.pi / n + share
        out.append(share * RADIUS * np.column_stack([np.sin(turn), np.cos(turn)]))
    return np.concatenate(out)


@lru_cache(maxsize=1)
def _turned() -> tuple[np.ndarray, np.ndarray]:
    """Brightness points for each angle (ANGLES, points, 2), and the disc of the orientation."""
    turn = np.arange(ANGLES) * 2 * np.pi / ANGLES
    c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]
    y, x = _points().T
    grid = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1].reshape(2, -1).T
    return np.rint(np.stack([s * x + c * y, c * x - s * y], axis=-1)).astype(np.int64), grid[(grid**2).sum(1) <= RADIUS**2]


def _patches(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y, level, angle) of all corners, in the image's own pixels, and brightness at their points over the patch's deviation.

    Levels go down as far as corners fit in.
    """
    turned, disc = _turned()
    spots, values, level = [np.zeros((0, 4))], [np.zeros((0, turned.shape[1]))], 0
    while (scale := 2 ** (-level / OCTAVE)) * min(image.shape) > 2 * EDGE + 4:
        small = image if level == 0 else resize(image, round(image.shape[0] * scale), round(image.shape[1] * scale))
        smooth = _blur(small, 2)
        at = corners(smooth)
        if len(at):
            smooth = _blur(smooth, 1)
            patch = smooth[at[:, :1] + disc[:, 0], at[:, 1:] + disc[:, 1]]
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.arctan2(patch @ disc[:, 0], patch @ disc[:, 1]) % (2 * np.pi)
            place = at[:, None] + turned[np.rint(angle * ANGLES / (2 * np.pi)).astype(int) % ANGLES]
            values.append(smooth[place[..., 0], place[..., 1]] / (patch.std(1, keepdims=True) + 1e-3))
            spots.append(np.column_stack([at[:, 1] / scale, at[:, 0] / scale, np.full(len(at), level), angle]))
        level += 1
    return np.concatenate(spots), np.concatenate(values)


def _samples() -> list[np.ndarray]:
    """Drawn pictures from which the tests are chosen: boxes and textures."""
    rng, out = np.random.default_rng(11), []
    for k in range(45):
        canvas = np.full((128, 128), 128.0, dtype=np.float32)
        if k % 3:
            for y, x, h, w, shade in zip(*rng.integers(0, 112, (2, 40)), *rng.integers(6, 48, (2, 40)), rng.integers(0, 256, 40), strict=True):
                canvas[y : y + h, x : x + w] = shade
        else:
            canvas += sum(resize(rng.normal(0, 30, (n, n)).astype(np.float32), 128, 128) for n in (11, 21, 41))
        out.append(_blur(canvas).clip(0, 255))
    return out


@lru_cache(maxsize=1)
def chosen_tests() -> np.ndarray:
    """TESTS pairs of brightness points: those that hold most evenly over drawn pictures and depend least on each other."""
    n = len(_points())
    pairs = np.column_stack(np.triu_indices(n, 1))
    values = np.concatenate([_patches(p)[1] for p in _samples()])
    values = values[np.random.default_rng(3).permutation(len(values))[:3000]]
    held = (values[:, pairs[:, 1]] - values[:, pairs[:, 0]] > BRIGHTER).astype(np.float32)
    mean = held.mean(0)
    unit = (held - mean) / np.maximum(held.std(0), 1e-3)
    alike = np.abs(unit.T @ unit / len(unit))
    limit = 0.4
    while True:
        out: list[int] = []
        for k in np.argsort(np.abs(mean - 0.5), kind="stable"):
            if len(out) < TESTS and (not out or alike[k, out].max() < limit):
                out.append(int(k))
        if len(out) == TESTS:
            return pairs[out]
        limit += 0.05


@lru_cache(maxsize=1)
def _key_bits() -> np.ndarray:
    """The tests that each table samples of a corner and of its neighbour."""
    rng = np.random.default_rng(7)
    return np.stack([[rng.permutation(TESTS)[:KEY_BITS] for _ in range(2)] for _ in range(TABLES)])


def describe(image: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y, level, angle), and descriptors of TESTS bits each."""
    spots, values = _patches(image)
    return spots, values[:, tests[:, 1]] - values[:, tests[:, 0]] > BRIGHTER


def table_keys(spots: np.ndarray, bits: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Distinct keys of all tables: a corner, a near neighbour at its scale, the bearing, turn and distance between them."""
    own, other, lie = [], [], []
    for level in np.unique(spots[:, 2]):
        at = np.flatnonzero(spots[:, 2] == level)
        x, y, angle = spots[at, 0], spots[at, 1], spots[at, 3]
        for start in range(0, len(at), 500):
            some = slice(start, start + 500)
            dx, dy = x[None, :] - x[some, None], y[None, :] - y[some, None]
            far = np.hypot(dx, dy)
            far[far == 0] = np.inf
            near = np.argsort(far, axis=1, kind="stable")[:, :NEIGHBOURS]
            i = np.repeat(np.arange(len(near)), near.shape[1])
            j = near.ravel()
            i, j = i[np.isfinite(far[i, j])], j[np.isfinite(far[i, j])]
            sector = lambda a: np.floor(a % (2 * np.pi) * 16 / (2 * np.pi)).astype(np.int64) % 16
            steps = np.floor(2 * np.log2(far[i, j] * 2 ** (-level / OCTAVE))).astype(np.int64)
            lie.append((sector(np.arctan2(dy[i, j], dx[i, j]) - angle[start + i]) * 16 + sector(angle[j] - angle[start + i])) * 64 + steps)
            own.append(at[start + i])
            other.append(at[j])
    if not own:
        return np.zeros(0, dtype=np.int64)
    own, other, lie = map(np.concatenate, (own, other, lie))
    weights = 1 << np.arange(KEY_BITS, dtype=np.int64)
    out = []
    for table, (first, second) in enumerate(samples):
        # the sums are hashes: they may run over
        out.append((bits[:, first] @ weights)[own] * np.int64(0x1E3779B97F4A7C15) ^ (bits[:, second] @ weights)[other] * np.int64(0x5851F42D4C957F2D) ^ (lie * TABLES + table) * np.int64(0x14057B7EF767814F))
    return np.unique(np.concatenate(out))


def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of descriptors (four words each) that are no farther apart than NEAR."""
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    step = max(1, CELLS // max(len(b), 1))
    for start in range(0, len(a), step):
        far = sum(np.bitwise_count(a[start : start + step, None, k] ^ b[None, :, k]).astype(np.int16) for k in range(TESTS // 64))
        i, j = np.nonzero(far <= NEAR)
        left.append(i + start)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def consensus(p: np.ndarray, q: np.ndarray) -> int:
    """Corners apart in both images that agree on one similarity transform from matched rows (x, y, level, angle) of p to those of q.

    Each match proposes its own transform; the three with the most support are fitted to it, twice.
    """
    if len(p) < CONSENSUS:
        return 0
    za, zb = p[:, 0] + 1j * p[:, 1], q[:, 0] + 1j * q[:, 1]
    own = 2 ** ((q[:, 2] - p[:, 2]) / OCTAVE) * np.exp(1j * (q[:, 3] - p[:, 3]))
    shift, size = zb - own * za, 2 ** (q[:, 2] / OCTAVE)

    def agrees(by: np.ndarray) -> np.ndarray:
        ratio = own / by
        return (np.abs(np.log2(np.abs(ratio))) < 0.3) & (np.abs(np.angle(ratio)) < 0.35)

    support = np.zeros(len(p), dtype=np.int64)
    step = max(1, CELLS // len(p))
    for start in range(0, len(p), step):
        m, t = own[start : start + step, None], shift[start : start + step, None]
        off = np.abs(m * za + t - zb)
        reach = np.abs(za - za[start : start + step, None]) * np.abs(m)
        support[start : start + step] = ((off < 3 + 0.2 * reach) & agrees(m)).sum(1)
    best = 0
    for h in np.argsort(-support, kind="stable")[:3]:
        m, t, loose = own[h], shift[h], 3 + 0.2 * np.abs(za - za[h]) * np.abs(own[h])
        for tight in (loose, 4.0 + size, 2.0 + size):
            fit = (np.abs(m * za + t - zb) < tight) & agrees(m)
            if fit.sum() < 2:
                break
            ca, cb = za[fit].mean(), zb[fit].mean()
            spread = (np.abs(za[fit] - ca) ** 2).sum()
            if spread < 1e-6:
                break
            m = (np.conj(za[fit] - ca) * (zb[fit] - cb)).sum() / spread
            if not 0.05 < abs(m) < 20:
                break
            t = cb - m * ca
        else:
            fit = (np.abs(m * za + t - zb) < 2.0 + size) & agrees(m)
            apart = lambda z: len(np.unique(np.round(z / APART)))
            best = max(best, min(apart(za[fit]), apart(zb[fit])))
    return best


#: A spot as it is stored; the angle is a share of 256.
SPOT = np.dtype([("x", "<f4"), ("y", "<f4"), ("level", "u1"), ("angle", "u1")])


def _packed(spots: np.ndarray) -> bytes:
    out = np.empty(len(spots), dtype=SPOT)
    out["x"], out["y"], out["level"], out["angle"] = spots[:, 0], spots[:, 1], spots[:, 2], np.rint(spots[:, 3] * 128 / np.pi).astype(int) % 256
    return out.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    own = np.frombuffer(raw, dtype=SPOT)
    return np.column_stack([own["x"], own["y"], own["level"], own["angle"] * (np.pi / 128)]).astype(float)


def _described(images: DataFrame) -> DataFrame:
    """``id, digest, spots, codes``: the digest of the pixels is null for what isn't an image; the rest is of the image ``enlarged``."""
    tests = chosen_tests()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 50):
                rows = []
                for i, data in zip(batch["id"][start : start + 50], batch["image"][start : start + 50], strict=True):
                    data = None if data is None else bytes(data)
                    image = from_pgm(data)
                    if image is None:
                        rows.append((i, None, None, None))
                        continue
                    spots, bits = describe(enlarged(image), tests)
                    rows.append((i, hashlib.blake2b(data, digest_size=16).digest(), _packed(spots), np.packbits(bits, axis=1).tobytes()))
                yield pd.DataFrame(rows, columns=["id", "digest", "spots", "codes"])

    return images.mapInPandas(run, "id long, digest binary, spots binary, codes binary")


def _entries(shown: DataFrame) -> DataFrame:
    """``key, id``: the table keys of all images."""
    samples = _key_bits()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 100):
                some = batch.iloc[start : start + 100]
                keys = []
                for spots, codes in zip(some["spots"], some["codes"], strict=True):
                    bits = np.unpackbits(np.frombuffer(codes, dtype=np.uint8).reshape(-1, TESTS // 8), axis=1)
                    keys.append(table_keys(_unpacked(spots), bits, samples))
                yield pd.DataFrame({"key": np.concatenate(keys), "id": np.repeat(some["id"].to_numpy(), [len(k) for k in keys])})

    return shown.select("id", "spots", "codes").mapInPandas(run, "key long, id long")


def _meetings(entries: DataFrame, small: int) -> DataFrame:
    """``key, block, a, b`` from ``key, id``: pairs of images that share a small bucket (key null), and the entries of large ones with their block (b null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, large, before = pd.DataFrame({"key": np.zeros(0, np.int64), "id": np.zeros(0, np.int64)}), None, 0
        for batch in batches:
            rows = pd.concat([held, batch], ignore_index=True)
            if len(rows) < GATHER:
                held = rows
                continue
            # the last bucket may go on; one that is large already needn't be held
            last = rows["key"].iloc[-1]
            whole = int(np.searchsorted(rows["key"].to_numpy(), last, side="left"))
            if len(rows) - whole > small:
                begun = {large: before, last: before if last == large else 0}
                yield _met(rows, begun, small)
                held, large, before = rows.iloc[len(rows) :], last, begun[last] + len(rows) - whole
            else:
                yield _met(rows.iloc[:whole], {large: before}, small)
                held = rows.iloc[whole:]
        yield _met(held, {large: before}, small)

    dealt = entries.repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInPandas(run, "key long, block long, a long, b long")


def _met(rows: pd.DataFrame, large: dict, small: int) -> pd.DataFrame:
    """The pairs of small buckets and the entries of large ones, those named among them with their entries before these; rows are sorted by key."""
    key, ids = rows["key"].to_numpy(), rows["id"].to_numpy()
    if not len(key):
        return pd.DataFrame({"key": [], "block": [], "a": [], "b": []}).astype("Int64")
    new = np.concatenate([[True], key[1:] != key[:-1]])
    edge = np.append(np.flatnonzero(new), len(key))
    n, before = np.diff(edge), np.zeros(len(edge) - 1, dtype=np.int64)
    big = n > small
    for k, earlier in large.items():
        if k is not None:
            at = key[edge[:-1]] == k
            big, before = big | at, before + at * earlier
    after = np.where(np.repeat(big, n), 0, np.repeat(edge[1:], n) - np.arange(len(key)) - 1)
    i = np.repeat(np.arange(len(key)), after)
    j = np.arange(int(after.sum())) - np.repeat(np.cumsum(after) - after, after) + i + 1
    out = np.flatnonzero(np.repeat(big, n))
    block = (np.arange(len(key)) - np.repeat(edge[:-1] - before, n)) // small
    pair = np.concatenate([np.ones(len(i), dtype=bool), np.zeros(len(out), dtype=bool)])
    none = np.zeros(len(i), np.int64)
    return pd.DataFrame({
        "key": pd.arrays.IntegerArray(np.concatenate([none, key[out]]), pair),
        "block": pd.arrays.IntegerArray(np.concatenate([none, block[out]]), pair),
        "a": np.concatenate([ids[i], ids[out]]),
        "b": pd.arrays.IntegerArray(np.concatenate([ids[j], np.zeros(len(out), np.int64)]), ~pair),
    })


def _block_pairs(entries: DataFrame) -> DataFrame:
    """``a, b``: all pairs of images that share a large bucket, from ``key, block, id``; once for each bucket.

    Any two blocks of a bucket meet under a key of their own, so a bucket is dealt over tasks, and none holds more of it
    than two blocks at once.  Blocks follow each other by id.
    """
    blocks = materialise(entries.groupBy("key", "block").agg(F.sort_array(F.collect_list("id")).alias("ids")), "images-blocks")
    last = blocks.groupBy("key").agg(F.max("block").alias("last"))
    low = blocks.join(by_shuffle(last), "key").repartition("key", "block").select("key", F.col("block").alias("x"), F.explode(F.sequence("block", "last")).alias("y"), F.col("ids").alias("low"))
    high = blocks.repartition("key", "block").select("key", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("x"), F.col("block").alias("y"), F.col("ids").alias("high"))
    both = low.join(by_shuffle(high), ["key", "x", "y"])
    return both.select("high", F.explode("low").alias("a")).select("a", F.explode("high").alias("b")).where("a < b")


def _linked(pairs: DataFrame, shown: DataFrame) -> DataFrame:
    """Of ``a, b`` the pairs whose descriptors reach a consensus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = lambda raw: np.frombuffer(raw, dtype=np.uint64).reshape(-1, TESTS // 64)
        for batch in batches:
            rows = []
            for a, b, sa, ca, sb, cb in batch.itertuples(index=False):
                i, j = matches(codes(ca), codes(cb))
                if consensus(_unpacked(sa)[i], _unpacked(sb)[j]) >= CONSENSUS:
                    rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    shown = shown.join(ids, "id", "left_semi")
    side = lambda n: shown.select(F.col("id").alias(n), F.col("spots").alias(f"s{n}"), F.col("codes").alias(f"c{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "ca", "sb", "cb")
    return materialise(both.mapInPandas(run, "a long, b long").distinct(), "images-linked")


def image_copies(images: DataFrame, id_col: str = "media_id", image_col: str = "image", small: int = SMALL) -> DataFrame:
    """``media_id, component_id, n_links``: groups of images of which one shows a part of another, edited or not.

    Equal images are one class, represented by its smallest id.  Every bucket forms all its pairs, those of more than
    ``small`` entries by blocks of so many.  ``n_links`` counts the links of the class to other classes.
    Null, empty and broken images, and those too small or too plain for corners, have no links; repeated rows are
    equal images; an empty table gives no rows; a null id is its own group; other columns are ignored.
    """
    rows = only(images, id=id_col, image=image_col).select(F.col("id").cast("long").alias("id"), "image")
    described = materialise(_described(rows), "images-described")
    classes = described.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "images-classes")
    repeated = described.select("id", "digest").join(classes.where("copies > 1").withColumnRenamed("id", "first"), "digest").where("id <> first").select("id")
    repeated = materialise(repeated.distinct(), "images-repeated")
    shown = described.where("digest IS NOT NULL AND id IS NOT NULL").select("id", "spots", "codes").join(repeated, "id", "left_anti")
    met = materialise(_meetings(_entries(shown), small), "images-met")
    pairs, large = met.where("key IS NULL").select("a", "b"), met.where("key IS NOT NULL").select("key", "block", F.col("a").alias("id"))
    if not large.isEmpty():
        pairs = pairs.unionByName(_block_pairs(large))
    often = pairs.where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MEETINGS).select("a", "b")
    links = _linked(materialise(often, "images-near"), shown)
    labels = components(links, "images")
    degree = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    groups = classes.join(labels, "id", "left").join(degree, "id", "left").where("copies > 1 OR component IS NOT NULL").select("digest", F.coalesce("component", "id").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    groups = materialise(groups, "images-groups")
    out = described.where("digest IS NOT NULL").select("id", "digest").join(groups, "digest", "left").select("id", "component", "n_links").unionByName(described.where("digest IS NULL").select("id", F.lit(None).cast("long").alias("component"), F.lit(0).cast("long").alias("n_links")))
    return out.select(F.col("id").alias("media_id"), F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


SIDE = 96


def picture(vector: np.ndarray) -> np.ndarray:
    """A picture made of a vector alone: rectangles whose places and shades its values fix.  Equal vectors give equal pictures."""
    seed = int.from_bytes(hashlib.blake2b(np.asarray(vector, dtype=np.float32).tobytes(), digest_size=8).digest(), "big")
    rng = np.random.default_rng(seed)
    out = np.full((SIDE, SIDE), 128.0, dtype=np.float32)
    for y, x, h, w, shade in zip(*rng.integers(0, SIDE - 8, (2, 32)), *rng.integers(8, 32, (2, 32)), rng.integers(0, 256, 32), strict=True):
        out[y : y + h, x : x + w] = shade
    return _blur(out)


def edited(image: np.ndarray, kind: int) -> np.ndarray:
    """A copy of the picture: cropped and brightened, cropped and scaled, turned by a quarter, or faded."""
    if kind % 4 == 0:
        return (image[8:, 6:] * 0.8 + 30).clip(0, 255)
    if kind % 4 == 1:
        part = image[4:88, 4:88]
        return resize(part, 76, 76)
    if kind % 4 == 2:
        return np.rot90(image[:, :84])
    return (image * 0.6 + 60).clip(0, 255)


def media_of(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``media_id, image``: for every row its picture (twice the id), and for every fourth id an edited copy too (one more).

    Null or empty vectors have null images.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, images = [], []
            for i, v in zip(batch["id"], batch["vector"], strict=True):
                made = picture(np.asarray(v)) if v is not None and len(v) else None
                ids.append(2 * int(i))
                images.append(None if made is None else to_pgm(made))
                if i % 4 == 0:
                    ids.append(2 * int(i) + 1)
                    images.append(None if made is None else to_pgm(edited(made, int(i) // 4)))
            yield pd.DataFrame({"media_id": ids, "image": images})

    rows = only(embeddings, id=id_col, vector=vector_col).where("id IS NOT NULL")
    return rows.mapInPandas(run, "media_id long, image binary")
