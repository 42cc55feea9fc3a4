"""Neighbourhood filters: dense blocks with a halo, each evaluated in numpy; ``stencil`` does so for any function of a user."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.sources.tables import COORDINATES

WINDOW = 3.5


def gaussian_kernel(sigma: float, order: int = 0, window: float = WINDOW) -> list[float]:
    """Weights from -r to r with r = ceil(window * sigma): Gaussian (sum 1), or its first or second derivative."""
    r = max(1, math.ceil(window * sigma))
    g = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    total = sum(g)
    g = [w / total for w in g]
    if order == 1:
        d = [-i / sigma**2 * w for i, w in zip(range(-r, r + 1), g)]
        scale = -sum(i * w for i, w in zip(range(-r, r + 1), d))
        return [w / scale for w in d]
    if order == 2:
        d = [(i * i / sigma**4 - 1 / sigma**2) * w for i, w in zip(range(-r, r + 1), g)]
        mean = sum(d) / len(d)
        d = [w - mean for w in d]
        scale = sum(i * i * w for i, w in zip(range(-r, r + 1), d)) / 2
        return [w / scale for w in d]
    return g


def within(px: DataFrame, shape: dict[str, int]) -> DataFrame:
    for axis, n in shape.items():
        px = px.where(F.col(axis).between(0, n - 1))
    return px


@dataclass
class Block:
    """A dense block with its halo: values (absent pixels are 0), which pixels are present, which lie within the image, and
    where the block begins along each axis."""

    values: np.ndarray
    present: np.ndarray
    inside: np.ndarray
    axes: str
    low: dict[str, int]

    def along(self, kernels: dict[str, list[float]], image: np.ndarray | None = None) -> np.ndarray:
        """Correlates with a kernel along each named axis, in turn; what leaves the image on the way is dropped."""
        image = self.values if image is None else image
        for a, k in kernels.items():
            image = correlate(image, k, self.axes.index(a)) * self.inside
        return image

    def reached(self, radii: dict[str, int], mask: np.ndarray | None = None) -> np.ndarray:
        """Places within ``radii`` of present pixels."""
        mask = self.present if mask is None else mask
        for a, r in radii.items():
            mask = dilate(mask, r, self.axes.index(a)) & self.inside
        return mask


def correlate(a: np.ndarray, kernel: list[float] | np.ndarray, axis: int) -> np.ndarray:
    """The sums of ``kernel[i] * a[place + i - r]`` along one axis, r being the kernel's radius; 0 beyond the ends."""
    a = np.moveaxis(a, axis, 0)
    out, r, n = np.zeros_like(a), len(kernel) // 2, len(a)
    for i, w in enumerate(kernel):
        d = i - r
        if w and abs(d) < n:
            out[max(0, -d) : n - max(0, d)] += w * a[max(0, d) : n - max(0, -d)]
    return np.moveaxis(out, 0, axis)


def dilate(mask: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Places at most ``r`` from a marked one along one axis."""
    m = np.moveaxis(mask, axis, 0)
    n = len(m)
    total = np.concatenate([np.zeros((1, *m.shape[1:]), dtype=np.int64), np.cumsum(m, axis=0, dtype=np.int64)])
    k = np.arange(n)
    return np.moveaxis(total[np.minimum(k + r + 1, n)] > total[np.maximum(k - r, 0)], 0, axis)


#: What a user's stencil returns: the channels it makes of a block, and where they hold.
Stencil = Callable[[Block], tuple[Sequence[np.ndarray], np.ndarray]]


def stencil(px: DataFrame, fn: Stencil, halo: int | dict[str, int], block: int = 64, axes: str = "yx", shape: dict[str, int] | None = None) -> DataFrame:
    """Evaluates ``fn`` on every dense block of 2D (``yx``) or 3D (``zyx``) images with its halo, in one shuffle.

    ``fn`` gets a Block that is ``halo`` wider than its core on every side and returns arrays of the block's shape, the
    channels, and a mask of the places where they hold; those of the core within ``shape`` become pixels. With k channels,
    channel c of an image becomes channels c * k and following. The result does not depend on the blocks as long as no
    place of ``fn``'s result looks further than the halo. Memory is bounded by the block with its halo.
    """
    reach = {a: halo if isinstance(halo, int) else halo.get(a, 0) for a in axes}
    rows = px.select(*COORDINATES, F.col("v").cast("double").alias("v"))
    if shape:
        rows = within(rows, {a: n for a, n in shape.items() if a in axes})
    for a in axes:
        rows = rows.select("*", F.explode(F.sequence(F.floor((F.col(a) - reach[a]) / block), F.floor((F.col(a) + reach[a]) / block))).alias(f"b{a}"))
    key = [c for c in COORDINATES if c not in axes] + [f"b{a}" for a in axes]
    core = tuple(slice(reach[a], reach[a] + block) for a in axes)

    def compute(pdf: pd.DataFrame) -> pd.DataFrame:
        low = {a: int(pdf[f"b{a}"].iloc[0]) * block - reach[a] for a in axes}
        size = tuple(block + 2 * reach[a] for a in axes)
        values, present, inside = np.zeros(size), np.zeros(size, dtype=bool), np.ones(size, dtype=bool)
        at = tuple(pdf[a].to_numpy() - low[a] for a in axes)
        values[at] = pdf["v"].to_numpy()
        present[at] = True
        for i, a in enumerate(axes):
            if shape and a in shape:
                place = np.arange(low[a], low[a] + size[i])
                inside &= ((place >= 0) & (place < shape[a])).reshape([-1 if j == i else 1 for j in range(len(axes))])
        channels, mask = fn(Block(values, present, inside, axes, low))
        found = np.nonzero((mask & inside)[core])
        n, k = len(found[0]), len(channels)
        out = {c: np.repeat(pdf[c].iloc[0], n * k) for c in COORDINATES if c not in axes}
        out |= {a: np.tile(f + low[a] + reach[a], k) for a, f in zip(axes, found)}
        out["c"] = out["c"] * k + np.repeat(np.arange(k), n)
        out["v"] = np.concatenate([ch[core][found] for ch in channels])
        return pd.DataFrame(out)[[*COORDINATES, "v"]]

    return _dealt(rows, key).groupBy(*key).applyInPandas(compute, "image_id string, t int, z int, y int, x int, c int, v double")


def _dealt(rows: DataFrame, key: list[str]) -> DataFrame:
    """Blocks over all shuffle partitions: few pixels may still be many blocks, which few tasks would compute one after the other."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def _radii(kernels: dict[str, list[float]]) -> dict[str, int]:
    return {a: len(k) // 2 for a, k in kernels.items()}


def gaussian_smoothing(px: DataFrame, sigma: float | dict[str, float], axes: str = "yx", shape: dict[str, int] | None = None) -> DataFrame:
    """Separable Gaussian, block by block; ``sigma`` may differ by axis. Absent pixels count as 0, places that a pixel reaches are filled."""
    if not axes:
        return px.select(*COORDINATES, "v")
    return smoothed_along(px, {a: gaussian_kernel(sigma[a] if isinstance(sigma, dict) else sigma) for a in axes}, shape)


def smoothed_along(px: DataFrame, kernels: dict[str, list[float]], shape: dict[str, int] | None = None) -> DataFrame:
    """Correlates with a kernel along each named axis, the others left alone."""
    axes = "zyx" if "z" in kernels else "yx"
    return stencil(px, lambda b: ([b.along(kernels)], b.reached(_radii(kernels))), _radii(kernels), _side(axes), axes, shape)


def _side(axes: str) -> int:
    return 32 if "z" in axes else 64


def difference_of_gaussians(px: DataFrame, s0: float, s1: float, shape: dict[str, int]) -> DataFrame:
    first, second = ({a: gaussian_kernel(s) for a in "yx"} for s in (s0, s1))
    widest = _radii(first if s0 >= s1 else second)
    return stencil(px, lambda b: ([b.along(first) - b.along(second)], b.reached(widest)), widest, shape=shape)


def _derived(sigma: float, orders: list[dict[str, int]], axes: str) -> Callable[[Block], list[np.ndarray]]:
    """Separable derivative filters of a block, one for each of ``orders``."""
    kernels = [{a: gaussian_kernel(sigma, order.get(a, 0)) for a in axes} for order in orders]
    return lambda b: [b.along(k) for k in kernels]


def _derivative_stencil(px: DataFrame, sigma: float, orders: list[dict[str, int]], shape: dict[str, int], axes: str, then: Callable[[list[np.ndarray]], list[np.ndarray]] = list) -> DataFrame:
    """What ``then`` makes of several derivatives, as channels."""
    radii, derived = _radii({a: gaussian_kernel(sigma) for a in axes}), _derived(sigma, orders, axes)
    return stencil(px, lambda b: (then(derived(b)), b.reached(radii)), radii, _side(axes), axes, shape)


def anisotropic_smoothing(px: DataFrame, sigmas: dict[str, float], shape: dict[str, int] | None = None) -> DataFrame:
    """Gaussian smoothing with a sigma of its own along each named axis; axes of sigma 0 are left alone."""
    axes = "".join(a for a in "zyx" if sigmas.get(a, 0) > 0)
    return gaussian_smoothing(px, sigmas, axes, shape)


def _orders(axes: str) -> list[dict[str, int]]:
    """Derivative orders of the upper triangle of the Hessian."""
    return [{a: 2} if a == b else {a: 1, b: 1} for i, a in enumerate(axes) for b in axes[i:]]


def hessian(px: DataFrame, sigma: float, shape: dict[str, int], axes: str = "yx") -> DataFrame:
    """Second derivatives as channels: the upper triangle, row by row (3 channels in 2D, 6 in 3D)."""
    return _derivative_stencil(px, sigma, _orders(axes), shape, axes)


def eigen_channels(triangle: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Eigenvalues, largest first, of the symmetric matrices whose upper triangles are given."""
    n = 2 if len(triangle) == 3 else 3
    m = np.empty((*triangle[0].shape, n, n))
    for (i, j), v in zip(((i, j) for i in range(n) for j in range(i, n)), triangle):
        m[..., i, j] = m[..., j, i] = v
    return list(np.moveaxis(np.linalg.eigvalsh(m)[..., ::-1], -1, 0))


def hessian_eigenvalues(px: DataFrame, sigma: float, shape: dict[str, int], axes: str = "yx") -> DataFrame:
    return _derivative_stencil(px, sigma, _orders(axes), shape, axes, eigen_channels)


def hessian_first_eigenvalue(px: DataFrame, sigma: float, shape: dict[str, int], axes: str = "yx") -> DataFrame:
    """The largest eigenvalue of the Hessian."""
    return _derivative_stencil(px, sigma, _orders(axes), shape, axes, lambda d: eigen_channels(d)[:1])


def structure_tensor_eigenvalues(px: DataFrame, inner: float, outer: float, shape: dict[str, int], axes: str = "yx") -> DataFrame:
    """Products of gradients at ``inner``, smoothed at ``outer``, and their eigenvalues as channels."""
    slopes, smooth = _derived(inner, [{a: 1} for a in axes], axes), {a: gaussian_kernel(outer) for a in axes}
    near, far = _radii({a: gaussian_kernel(inner) for a in axes}), _radii(smooth)

    def tensor(b: Block) -> tuple[list[np.ndarray], np.ndarray]:
        g = slopes(b)
        products = [b.along(smooth, g[i] * g[j]) for i in range(len(axes)) for j in range(i, len(axes))]
        return eigen_channels(products), b.reached(far, b.reached(near))

    return stencil(px, tensor, {a: near[a] + far[a] for a in axes}, _side(axes), axes, shape)


def gradient_magnitude(px: DataFrame, sigma: float, shape: dict[str, int]) -> DataFrame:
    return _derivative_stencil(px, sigma, [{"y": 1}, {"x": 1}], shape, "yx", lambda d: [np.sqrt(d[0] * d[0] + d[1] * d[1])])


def laplacian(px: DataFrame, sigma: float, shape: dict[str, int]) -> DataFrame:
    return _derivative_stencil(px, sigma, [{"y": 2}, {"x": 2}], shape, "yx", lambda d: [d[0] + d[1]])


FEATURES = ["gaussian", "laplacian", "gradient", "dog", "hessian_0", "hessian_1", "tensor_0", "tensor_1"]


def _eigenvalues(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the matrices ((a, b), (b, c)), largest first."""
    half, root = (a + c) / 2, np.sqrt(((a - c) / 2) ** 2 + b * b)
    return half + root, half - root


def _smoothed(image: np.ndarray, kernel: list[float] | np.ndarray) -> np.ndarray:
    for axis in range(image.ndim):
        image = correlate(image, kernel, axis)
    return image


def presmoothing(sigma: float) -> tuple[float, float]:
    """Scales above 1 are those of the image smoothed beforehand, filtered at 1: the sigma of either step, 0 for none."""
    return (math.sqrt(sigma * sigma - 1.0), 1.0) if sigma > 1.0 else (0.0, sigma)


def halo_of(sigma: float) -> int:
    """How far the features of a scale look: the smoothing beforehand, a derivative and the smoothing of a structure tensor."""
    before, at = presmoothing(sigma)
    radius = lambda s: len(gaussian_kernel(s)) // 2 if s else 0
    return radius(before) + radius(at) + radius(0.5 * at)


def block_features(image: np.ndarray, sigma: float, features: Sequence[str] = FEATURES) -> dict[str, np.ndarray]:
    """The named features of one dense 2D block at one scale; what none of them needs is not computed."""
    before, at = presmoothing(sigma)
    if before:
        image = _smoothed(image, gaussian_kernel(before))
    wanted, known = set(features), {}
    kernels = [gaussian_kernel(at, o) for o in range(3)]

    def derived(oy: int, ox: int) -> np.ndarray:
        for order in ((oy, None), (oy, ox)):
            if order not in known:
                known[order] = correlate(image, kernels[oy], 0) if order[1] is None else correlate(known[oy, None], kernels[ox], 1)
        return known[oy, ox]

    found = {}
    if wanted & {"gaussian", "dog"}:
        found["gaussian"] = derived(0, 0)
    if "dog" in wanted:
        found["dog"] = found["gaussian"] - _smoothed(image, gaussian_kernel(0.66 * at))
    if "laplacian" in wanted:
        found["laplacian"] = derived(2, 0) + derived(0, 2)
    if "gradient" in wanted:
        found["gradient"] = np.sqrt(derived(1, 0) ** 2 + derived(0, 1) ** 2)
    if wanted & {"hessian_0", "hessian_1"}:
        found["hessian_0"], found["hessian_1"] = _eigenvalues(derived(2, 0), derived(1, 1), derived(0, 2))
    if wanted & {"tensor_0", "tensor_1"}:
        gy, gx, outer = derived(1, 0), derived(0, 1), gaussian_kernel(0.5 * at)
        found["tensor_0"], found["tensor_1"] = _eigenvalues(*(_smoothed(p, outer) for p in (gy * gy, gy * gx, gx * gx)))
    return {f: found[f] for f in features}


def feature_bank(px: DataFrame, sigmas: list[float], features: list[str] | None = None, block: int = 64) -> DataFrame:
    """Selected features at several scales for every present pixel: ``image_id, t, z, y, x, c, f ARRAY<FLOAT>``.

    Scales above 1 are those of the image smoothed by ``sqrt(scale ** 2 - 1)``, filtered at 1. Every block is computed with a
    halo as wide as the largest scale looks (structure tensors smooth twice), each scale on as much of it as that scale
    needs, so that the result does not depend on the blocks. All scales are computed in one pass over a block. Absent
    pixels count as 0.
    """
    return features_at(px, [(f, s) for s in sigmas for f in features or FEATURES], block)


def features_at(px: DataFrame, chosen: list[tuple[str, float]], block: int = 64) -> DataFrame:
    """The bank of chosen pairs of feature and scale, in their order."""
    scales = sorted({s for _, s in chosen})
    halo = max(map(halo_of, scales))

    def compute(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = {}
        for s in scales:
            cut = halo - halo_of(s)
            names = list(dict.fromkeys(f for f, scale in chosen if scale == s))
            y, x = at - cut
            inner = values[tuple(slice(cut, n - cut) for n in values.shape)]
            for f, v in block_features(inner, s, names).items():
                found[f, s] = v[y, x]
        return np.stack([found[c] for c in chosen], axis=1)

    return at_pixels(px, compute, halo, block, "yx")


#: Blocks of a bank are gathered in tiles about as wide, so that not each small block has a halo of its own.
TILE = {"yx": 64, "zyx": 32}


def at_pixels(px: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], halo: int, block: int, axes: str) -> DataFrame:
    """Evaluates ``fn`` at every present pixel: ``image_id, t, z, y, x, c, f ARRAY<FLOAT>``, in one shuffle.

    ``fn`` gets a dense array and the places, one column for each pixel, at which a row of features is wanted; the array reaches
    ``halo`` beyond these places on every side. Pixels are gathered in tiles of as many whole blocks as ``TILE`` holds, one
    at least, and an array is no larger than what is present in the tile and its halo. Memory is bounded by the tile.
    """
    tile = block * max(1, TILE[axes] // block)
    rows = px.select(*COORDINATES, F.col("v").cast("double").alias("v"))
    for a in axes:
        rows = rows.select("*", F.explode(F.sequence(F.floor((F.col(a) - halo) / tile), F.floor((F.col(a) + halo) / tile))).alias(f"b{a}"))
    fields = [*((c, pa.string() if c == "image_id" else pa.int32()) for c in COORDINATES), ("f", pa.list_(pa.float32()))]

    def compute(table: pa.Table) -> pa.Table:
        at = np.stack([table[a].to_numpy().astype(np.int64) - table[f"b{a}"][0].as_py() * tile for a in axes])
        core = ((at >= 0) & (at < tile)).all(axis=0)
        if not core.any():
            return pa.schema(fields).empty_table()
        low, high = at[:, core].min(axis=1) - halo, at[:, core].max(axis=1) + halo + 1
        near = ((at >= low[:, None]) & (at < high[:, None])).all(axis=0)
        values = np.zeros(high - low)
        values[tuple(at[:, near] - low[:, None])] = table["v"].to_numpy()[near]
        found = fn(values, at[:, core] - low[:, None]).astype(np.float32)
        starts = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(found.ravel()))
        return table.select(COORDINATES).filter(pa.array(core)).append_column("f", lists).cast(pa.schema(fields))

    key = [c for c in COORDINATES if c not in axes] + [f"b{a}" for a in axes]
    return _dealt(rows, key).groupBy(*key).applyInArrow(compute, "image_id string, t int, z int, y int, x int, c int, f array<float>")


#: The scales and features that users choose from, as rows and columns of a matrix.
SCALES = [0.3, 0.7, 1.0, 1.6, 3.5, 5.0, 10.0]


def select_features(px: DataFrame, matrix: dict[str, list[float]], block: int = 64) -> DataFrame:
    """The bank of the chosen pairs of feature and scale: a pixel table with one channel for each pair, and its name.

    ``matrix`` gives the scales of each feature; channels are numbered in the order of FEATURES, then of scales. A pixel
    of several channels gives those of channel 0 first. Result: ``image_id, t, z, y, x, c, name, v``.
    """
    unknown = sorted(set(matrix) - set(FEATURES))
    if unknown:
        raise ValueError(f"no such features: {unknown}")
    chosen = [(f, s) for f in FEATURES for s in sorted(set(matrix.get(f, [])))]
    if not chosen:
        raise ValueError("no features chosen")
    bank = features_at(px, chosen, block)
    values = F.array(*(F.struct(F.lit(f"{f} {s}").alias("name"), F.get("f", F.lit(i)).cast("double").alias("v")) for i, (f, s) in enumerate(chosen)))
    rows = bank.select("image_id", "t", "z", "y", "x", F.col("c").alias("_c"), F.posexplode(values).alias("i", "u"))
    return rows.select("image_id", "t", "z", "y", "x", (F.col("_c") * len(chosen) + F.col("i")).alias("c"), "u.name", "u.v")


def invalid_scales(meta: DataFrame, scales: list[float]) -> DataFrame:
    """Scales whose kernels are wider than an image."""
    rows = meta.select("image_id", "n_y", "n_x", F.explode(F.array(*(F.lit(float(s)) for s in scales))).alias("scale"))
    return rows.where(F.ceil(F.col("scale") * WINDOW) + 1 > F.least("n_y", "n_x")).select("image_id", "scale")
