"""Growing regions from seeds: watersheds, carving of region graphs, distance transforms, SLIC superpixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.operators import regions, superpixels
from voxelry.operators.components import numbered
from voxelry.operators.filters import _dealt, gaussian_smoothing, gradient_magnitude, hessian_first_eigenvalue
from voxelry.operators.geometry import zero_default
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES


def grow_over_edges(edges: DataFrame, seeds: DataFrame, background: int | None = None, priority: float = 1.0, unbiased_below: float = 0.0, max_rounds: int = 64) -> DataFrame:
    """``node, label``: labels of ``seeds(node, label)`` grown over ``edges(src, dst, w)``, lightest edges first.

    Equal weights are ordered by columns ``a`` and ``b`` of the edges, if there are any, and else by their ends.

    The result is the minimum spanning forest rooted in the seeds: what flooding in ascending order of weight gives, but
    in rounds. In each round every cluster without a seed is tied to the one across its lightest edge. Clusters then become nodes and parallel edges are reduced to the lightest, so that the
    edge table at least halves. Edges towards a cluster of label ``background`` count ``priority`` times their weight
    from ``unbiased_below`` on. Nodes that no seed reaches have no row; loops and null ends or weights are ignored.
    """
    ends = [F.col("a"), F.col("b")] if "a" in edges.columns else [F.least("src", "dst"), F.greatest("src", "dst")]
    ordered = edges.where("src <> dst and w is not null").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.struct(F.col("w").cast("double").alias("w"), ends[0].alias("a"), ends[1].alias("b")).alias("e"))
    seeds = written(seeds.groupBy("node").agg(F.min("label").alias("label")), "seeds")
    now = _lightest(ordered, seeds)
    merged = []
    for _ in range(max_rounds):
        ends = now.select(F.col("u").alias("n"), F.col("v").alias("to"), "e").unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("to"), "e"))
        free = ends.join(seeds.select(F.col("node").alias("n")), "n", "left_anti")
        weight: Column = F.col("e.w")
        if background is not None and priority != 1.0:
            free = free.join(seeds.select(F.col("node").alias("to"), "label"), "to", "left")
            weight = F.when((F.col("label") == background) & (weight >= unbiased_below), weight * priority).otherwise(weight)
        picks = free.groupBy("n").agg(F.min(F.struct(weight.alias("w"), "e.a", "e.b", "to")).alias("p")).select("n", F.col("p.to").alias("to"))
        into = _roots(written(picks, "picks"))
        if into is None:
            break
        merged.append(into)
        for end in ("u", "v"):
            now = now.join(into.select(F.col("n").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        now = _lightest(now.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "e").where("u <> v"), seeds)
    else:
        raise RuntimeError(f"not grown after {max_rounds} rounds")
    labels = seeds
    for into in reversed(merged):
        labels = labels.unionByName(into.join(labels.select(F.col("node").alias("to"), "label"), "to").select(F.col("n").alias("node"), "label"))
    return labels


def _lightest(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """One edge for each pair of clusters, without pairs that both hold seeds."""
    known = edges
    for end in ("u", "v"):
        known = known.join(seeds.select(F.col("node").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    return written(known.where("not (coalesce(_u, false) and coalesce(_v, false))").groupBy("u", "v").agg(F.min("e").alias("e")), "edges")


def _roots(picks: DataFrame, max_rounds: int = 64) -> DataFrame | None:
    """``n, to``: the end of the chain of picks that starts in n. Of two clusters that pick each other the smaller is the end."""
    back = picks.select(F.col("n").alias("to"), F.col("to").alias("n"), F.lit(True).alias("mutual"))
    chains = written(picks.join(back, ["n", "to"], "left").where("mutual is null or n > to").select("n", "to"), "chains")
    if chains.isEmpty():
        return None
    for _ in range(max_rounds):
        ahead = chains.select(F.col("n").alias("to"), F.col("to").alias("further"))
        longer = written(chains.join(ahead, "to", "left").select("n", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "chains")
        chains = longer.select("n", "to")
        if longer.where("moved").isEmpty():
            return chains
    raise RuntimeError(f"chains have not settled after {max_rounds} rounds")


#: Sides of the blocks that are contracted one by one.
BLOCK = {"z": 16, "y": 64, "x": 64}
_VOLUME = ["image_id", "t", "c"]


def numbered_pixels(px: DataFrame) -> DataFrame:
    """Adds ``node LONG``: a number for each pixel, rising in raster order (z, y, x) within its frame and channel."""
    low_high = px.agg(*(f(a).alias(f"{n}{a}") for a in "zyx" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    span = {a: (low_high[f"hi{a}"] - low_high[f"lo{a}"] + 1) if low_high[f"lo{a}"] is not None else 1 for a in "zyx"}
    bits = int(span["z"] * span["y"] * span["x"] - 1).bit_length()  # the others number the frames
    start = {a: low_high[f"lo{a}"] or 0 for a in "zyx"}
    frames = px.select(*_VOLUME).distinct().withColumn("_hash", F.xxhash64(*_VOLUME)).withColumn("_all", F.lit(0))
    frames = written(numbered(frames, ["_all"], "_hash", F.shiftright("_hash", 48), 0).select(*_VOLUME, F.col("number").alias("_frame")), "frames")
    at = {a: F.col(a).cast("long") - start[a] for a in "zyx"}
    place = (at["z"] * span["y"] + at["y"]) * span["x"] + at["x"]
    return px.join(frames, _VOLUME).withColumn("node", F.shiftleft("_frame", bits) + place).drop("_frame")


def pixel_edges(px: DataFrame, axes: str = "zyx") -> DataFrame:
    """Edges ``src, dst, w`` between pixels with numbers that share a face; w is the larger of both values."""
    steps = F.array(*(F.struct(*(F.lit(int(a == b)).alias(b) for b in "zyx")) for a in axes))
    ahead = px.select(F.col("node").alias("src"), "image_id", "t", "c", *(F.col(a).alias(f"{a}_") for a in "zyx"), F.col("v").alias("w"), F.explode(steps).alias("d"))
    ahead = ahead.select("src", "w", "image_id", "t", "c", *((F.col(f"{a}_") + F.col(f"d.{a}")).alias(a) for a in "zyx"))
    return ahead.join(px, COORDINATES).select("src", F.col("node").alias("dst"), F.greatest("w", "v").alias("w"))


def contract(node: np.ndarray, label: np.ndarray, core: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties pixels of a block together along edges that are sure to be in the spanning forest.

    ``node`` are the pixels' numbers, ``label`` their seeds (0 without), ``core`` those of the block itself; the others lie
    around it. ``u, v, w`` are edges between places of these arrays. A cluster of core pixels without a seed is tied across its
    lightest edge unless that leads out of the block. Returns each pixel's root, a place of the arrays, and the places of
    the edges that are left between different clusters: those to pixels around, and the lightest between two of the block.
    """
    order = np.lexsort((np.maximum(node[u], node[v]), np.minimum(node[u], node[v]), w))
    u, v = u[order], v[order]
    root, seeded = np.arange(len(node)), label != 0
    left = np.arange(len(u))
    while True:
        a, b = root[u[left]], root[v[left]]
        open_ = (a != b) & ~(seeded[a] & seeded[b])
        left, a, b = left[open_], a[open_], b[open_]
        best = np.full(len(node), len(order))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        picks = np.nonzero((best < len(order)) & core & ~seeded & (root == np.arange(len(node))))[0]
        to = np.where(root[u[best[picks]]] == picks, root[v[best[picks]]], root[u[best[picks]]])
        picks, to = picks[core[to]], to[core[to]]
        if not len(picks):
            break
        jump = np.arange(len(node))
        jump[picks] = to
        mutual = picks[(jump[to] == picks) & (picks < to)]
        jump[mutual] = mutual  # of two clusters that pick each other the first is the root
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        root = jump[root]
    a, b = root[u[left]], root[v[left]]
    out = ~(core[a] & core[b])
    _, first = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)  # edges are in order: the first of a pair is its lightest
    keep = out.copy()
    keep[first] = True
    return root, order[left[keep]]


def _contracted(px: DataFrame, axes: str) -> DataFrame:
    """Blocks of ``px(COORDINATES, v, node, label)`` contracted one by one.

    Rows ``a, b, w, node, cluster, label``: of pixels (``a`` null) their cluster, named after one of its pixels, and its
    seed's label; of edges (``node`` null) their ends ``a`` and ``b``, pixels of different clusters.
    """
    spans = [F.array_distinct(F.array(*(F.floor((F.col(a) + d) / BLOCK[a]).cast("int") for d in (0, -1, 1)))) for a in axes]
    rows = px
    for a, span in zip(axes, spans):
        rows = rows.withColumn(f"b{a}", F.explode(span))
    key = [c for c in COORDINATES if c not in axes] + [f"b{a}" for a in axes]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        place = {a: pdf[a].to_numpy() - int(pdf[f"b{a}"].iloc[0]) * BLOCK[a] + 1 for a in axes}
        core = np.ones(len(pdf), dtype=bool)
        grid = np.full([BLOCK[a] + 2 for a in axes], -1, dtype=np.int64)
        grid[tuple(place[a] for a in axes)] = np.arange(len(pdf))
        for a in axes:
            core &= (place[a] >= 1) & (place[a] <= BLOCK[a])
        none = pd.DataFrame({"a": [], "b": [], "w": [], "node": [], "cluster": [], "label": []})
        if not core.any():
            return none
        ends = []
        for i in range(len(axes)):
            near, far = np.moveaxis(grid, i, 0)[:-1].ravel(), np.moveaxis(grid, i, 0)[1:].ravel()
            both = (near >= 0) & (far >= 0)
            ends.append((near[both], far[both]))
        u, v = (np.concatenate(x) for x in zip(*ends))
        inner = core[u] | core[v]
        u, v = u[inner], v[inner]
        node, value, label = pdf["node"].to_numpy(), pdf["v"].to_numpy(), pdf["label"].to_numpy()
        w = np.maximum(value[u], value[v])
        root, edges = contract(node, np.where(core, label, 0), core, u, v, w)
        low, high = np.minimum(node[u], node[v])[edges], np.maximum(node[u], node[v])[edges]
        # an edge out of the block is met in both blocks and told by that of its lower end
        lower_is_core = np.where(node[u[edges]] == low, core[u[edges]], core[v[edges]])
        low, high, w = low[lower_is_core], high[lower_is_core], w[edges][lower_is_core]
        ways = pd.DataFrame({"a": low, "b": high, "w": w})
        mine = pd.DataFrame({"node": node[core], "cluster": node[root[core]], "label": label[root[core]]})
        return pd.concat([none, mine, ways], ignore_index=True).astype({c: "Int64" for c in ("a", "b", "node", "cluster", "label")})

    return rows.groupBy(*key).applyInPandas(work, "a long, b long, w double, node long, cluster long, label long")


def seeded_watershed(px: DataFrame, seeds: DataFrame, axes: str = "zyx") -> DataFrame:
    """Labels of the pixels of ``px`` flooded from ``seeds`` (a label image) in ascending order of value.

    Only pixels present in ``px`` are flooded; seeds on absent pixels are ignored, as are those of label 0. Pixels no
    seed reaches are absent from the result. Equal values are ordered by the raster order of an edge's pixels. Blocks are
    contracted one by one: within a block all clusters but those whose lightest edge leads out of it are tied together, so
    that only clusters and edges along the faces of blocks enter the rounds of grow_over_edges.
    """
    relief = px.where("v is not null").select(*COORDINATES, F.col("v").cast("double").alias("v"))
    marks = seeds.where("v <> 0").groupBy(*COORDINATES).agg(F.min(F.col("v").cast("long")).alias("label"))
    relief = numbered_pixels(written(relief.join(marks, COORDINATES, "left").fillna({"label": 0}), "relief"))
    relief = written(relief, "relief")
    rows = written(_contracted(relief, axes), "contracted")
    pixels = rows.where("node is not null").select("node", "cluster", "label")
    ends = rows.where("a is not null").select("a", "b", "w")
    for end, name in (("a", "src"), ("b", "dst")):
        ends = ends.join(pixels.select(F.col("node").alias(end), F.col("cluster").alias(name)), end)
    named = pixels.where("label <> 0").select(F.col("cluster").alias("node"), "label").distinct()
    grown = grow_over_edges(written(ends, "faces"), named)
    of_pixels = pixels.select("node", "cluster").join(grown.select(F.col("node").alias("cluster"), F.col("label").alias("found")), "cluster")
    return relief.join(of_pixels.select("node", "found"), "node").select(*COORDINATES, F.col("found").alias("v"))


def local_minima(px: DataFrame, axes: str = "zyx") -> DataFrame:
    """Numbered plateaus that no pixel with a face on them is lower than or, without belonging to them, equal to."""
    steps = F.array(*(F.struct(*(F.lit(s * int(a == b)).alias(b) for b in "zyx")) for a in axes for s in (-1, 1)))
    px = written(px.select(*COORDINATES, "v"), "relief")
    around = px.select("image_id", "t", "c", *(F.col(a).alias(f"{a}_") for a in "zyx"), F.col("v").alias("w"), F.explode(steps).alias("d"))
    around = around.select("image_id", "t", "c", *((F.col(f"{a}_") + F.col(f"d.{a}")).alias(a) for a in "zyx"), "w")
    lowest = around.groupBy(*COORDINATES).agg(F.min("w").alias("w"))
    state = written(px.join(lowest, COORDINATES, "left").select(*COORDINATES, "v", F.coalesce(F.col("w") >= F.col("v"), F.lit(True)).alias("flat")), "minima")
    plateaus = written(regions.connected_components(state.where("flat").withColumn("v", F.lit(1.0))), "plateaus")
    slopes = state.where("not flat").select("image_id", "t", "c", *(F.col(a).alias(f"{a}_") for a in "zyx"), F.col("v").alias("w"), F.explode(steps).alias("d"))
    slopes = slopes.select("image_id", "t", "c", *((F.col(f"{a}_") + F.col(f"d.{a}")).alias(a) for a in "zyx"), "w")
    leaking = slopes.join(state.where("flat").select(*COORDINATES, F.col("v").alias("w")), [*COORDINATES, "w"]).select(*COORDINATES).join(plateaus, COORDINATES).select("image_id", "t", "c", "v").distinct()
    return plateaus.join(leaking, ["image_id", "t", "c", "v"], "left_anti").select(*COORDINATES, "v")


def unseeded_watershed(px: DataFrame, axes: str = "zyx") -> DataFrame:
    """The catchment basin of every local minimum. Frames within a block of ``BLOCK`` are flooded one by one, in one shuffle."""
    px = written(px.select("image_id", *(F.col(a).cast("int").alias(a) for a in COORDINATES[1:]), F.col("v").cast("double").alias("v")), "relief")
    spread = [(F.floor(F.max(a) / n) > F.floor(F.min(a) / n)).alias(f"wide_{a}") for a, n in BLOCK.items()]
    wide = written(px.groupBy(*_VOLUME).agg(*spread).where("wide_z or wide_y or wide_x").select(*_VOLUME), "wide")
    if wide.isEmpty():
        return _basins_within(px, axes)
    large = written(px.join(wide, _VOLUME, "left_semi"), "relief")
    return _basins_within(px.join(wide, _VOLUME, "left_anti"), axes).unionByName(seeded_watershed(large, local_minima(large, axes), axes))


def _basins_within(px: DataFrame, axes: str) -> DataFrame:
    def basins(table: pa.Table) -> pa.Table:
        table = table.sort_by([(a, "ascending") for a in "zyx"])
        place = np.stack([table[a].to_numpy().astype(np.int64) for a in "zyx"])
        known, value = table["v"].is_valid().to_numpy(), table["v"].to_numpy()
        value = np.where(np.isnan(value), np.inf, value)
        low = place.min(axis=1, keepdims=True)
        grid = np.full(place.max(axis=1) - low[:, 0] + 1, -1)
        grid[tuple(place - low)] = np.arange(len(value))
        ends = []
        for i in range(3):
            if "zyx"[i] in axes:
                near, far = np.moveaxis(grid, i, 0)[:-1].ravel(), np.moveaxis(grid, i, 0)[1:].ravel()
                both = (near >= 0) & (far >= 0)
                ends.append((near[both], far[both]))
        u, v = (np.concatenate(x) for x in zip(*ends))
        both = known[u] & known[v]
        u, v = u[both], v[both]
        flat = np.ones(len(value), dtype=bool)
        flat[u[value[u] > value[v]]] = False
        flat[v[value[v] > value[u]]] = False
        plateau = np.zeros(len(value), dtype=np.int64)
        local = regions._label_block(*place[:, flat], np.ones(int(flat.sum())), False)
        plateau[flat] = np.unique(local, return_inverse=True)[1] + 1
        level = value[u] == value[v]
        leaking = np.concatenate([plateau[u[level & ~flat[v]]], plateau[v[level & ~flat[u]]]])
        seed = np.where(np.isin(plateau, leaking), 0, plateau)
        seed[~known] = 0
        root, _ = contract(np.arange(len(value)), seed, np.ones(len(value), dtype=bool), u, v, np.maximum(value[u], value[v]))
        found = np.where(known, seed[root], 0)
        table = table.drop_columns(["v"]).append_column("v", pa.array(found))
        return table.select([*COORDINATES, "v"]).filter(pa.array(found != 0))

    return _dealt(px, _VOLUME).groupBy(*_VOLUME).applyInArrow(basins, "image_id string, t int, z int, y int, x int, c int, v long")


def labeled_threshold_cores(px: DataFrame, level: float, cores: DataFrame) -> DataFrame:
    """Pixels from ``level`` on, grown from the labelled cores in descending order of value, so that touching cores stay apart."""
    return seeded_watershed(px.where(F.col("v") >= level).withColumn("v", -F.col("v")), cores)


#: Columns of a frame whose distances are found at once.
STRIP = 64


def strip_distances(y: np.ndarray, x: np.ndarray, height: int, first: int, n: int) -> np.ndarray:
    """Squared distances of ``n`` columns from ``first`` on to the nearest of the given pixels; infinite without any.

    Of a row's pixels outside the strip only the nearest on either side matter.
    """
    rows, at = np.unique(y, return_inverse=True)
    left, right = np.full((len(rows), n), -np.inf), np.full((len(rows), n), np.inf)
    place, before, after = x - first, x < first + n, x >= first
    np.maximum.at(left, (at[before], np.maximum(place[before], 0)), x[before])
    np.minimum.at(right, (at[after], np.minimum(place[after], n - 1)), x[after])
    left, right = np.maximum.accumulate(left, axis=1), np.minimum.accumulate(right[:, ::-1], axis=1)[:, ::-1]
    columns = np.arange(first, first + n)
    across = np.minimum(columns - left, right - columns) ** 2
    best = np.full((height, n), np.inf)
    down = np.arange(height)[:, None]
    for r, g in zip(rows, across):
        np.minimum(best, (down - r) ** 2 + g, out=best)
    return best


def distance_transform(mask: DataFrame, frames: DataFrame, height: int, width: int) -> DataFrame:
    """Euclidean distance of every place of 2D ``frames(image_id, t, z, c)`` to the nearest pixel of ``mask``; null in frames without any.

    Only mask pixels are shuffled: each goes to the strips of ``STRIP`` columns for which it is the nearest of its row somewhere.
    In a strip the nearest pixel of each row is found first, then, column by column, the least sum of squares: nothing
    larger than a strip is gathered.
    """
    frame, strips = ["image_id", "t", "z", "c"], -(-width // STRIP)
    marked = mask.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(*COORDINATES).distinct()
    if strips > 1:
        row = Window.partitionBy(*frame, "y").orderBy("x")
        sent = F.sequence(*(F.floor(x.over(row) / STRIP).cast("int") for x in (F.lag("x", 1, 0), F.lead("x", 1, width - 1))))
        marked = marked.select(*COORDINATES, sent.alias("sent")).select(*frame, "y", "x", F.explode("sent").alias("strip"))
    else:
        marked = marked.select(*frame, "y", "x", F.lit(0).alias("strip"))
    none = F.lit(None).cast("int")
    wanted = frames.select(*frame, none.alias("y"), none.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"))
    fields = [*((c, pa.string() if c == "image_id" else pa.int32()) for c in COORDINATES), ("v", pa.float64())]

    def strip(table: pa.Table) -> pa.Table:
        at = table.filter(pc.is_valid(table["x"]))
        if len(at) == len(table):  # pixels of a frame that is not asked for
            return pa.schema(fields).empty_table()
        first = table["strip"][0].as_py() * STRIP
        n = min(STRIP, width - first)
        best = np.sqrt(strip_distances(at["y"].to_numpy().astype(np.int64), at["x"].to_numpy().astype(np.int64), height, first, n)).ravel()
        out = {c: pa.repeat(table[c][0].cast(dict(fields)[c]), len(best)) for c in frame}
        out |= {"y": np.repeat(np.arange(height, dtype=np.int32), n), "x": np.tile(np.arange(first, first + n, dtype=np.int32), height)}
        return pa.table([*(pa.array(out[c]) for c in COORDINATES), pa.array(best, mask=np.isinf(best))], schema=pa.schema(fields))

    key = [*frame, "strip"]
    return _dealt(marked.unionByName(wanted), key).groupBy(*key).applyInArrow(strip, "image_id string, t int, z int, y int, x int, c int, v double")


def dt_watershed(px: DataFrame, threshold: float, sigma: float, smallest: int, alpha: float, height: int, width: int) -> DataFrame:
    """Superpixels of a boundary map: the maxima of the smoothed distance to pixels from ``threshold`` on are the seeds,
    ``alpha * v + (1 - alpha) * (1 - distance / largest distance)`` is flooded; regions below ``smallest`` pixels are given
    to their neighbours by flooding again without them. A frame without boundaries becomes one region."""
    frames = px.select("image_id", "t", "z", "c").distinct()
    distance = written(distance_transform(px.where(F.col("v") >= threshold), frames, height, width).withColumn("v", F.coalesce("v", F.lit(0.0))), "distance")
    smooth = gaussian_smoothing(distance, sigma, "yx", {"y": height, "x": width}) if sigma > 0 else distance
    # rounded, so that sums taken in another order make no other plateaus
    seeds = written(local_minima(smooth.withColumn("v", -F.round("v", 9)), "yx"), "seeds")
    most = distance.groupBy("image_id", "t", "z", "c").agg(F.max("v").alias("most"))
    raw = zero_default(px, frames, height, width).withColumnRenamed("v", "b")
    near = F.when(F.col("most") > 0, F.col("v") / F.nullif(F.col("most"), F.lit(0.0))).otherwise(0.0)
    relief = written(distance.join(most, ["image_id", "t", "z", "c"]).join(raw, COORDINATES).select(*COORDINATES, (alpha * F.col("b") + (1 - alpha) * (1 - near)).alias("v")), "relief")
    first = written(seeded_watershed(relief, seeds, "yx"), "basins")
    large = first.groupBy("image_id", "t", "z", "c", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= smallest).drop("n")
    kept = seeds.join(large, ["image_id", "t", "z", "c", "v"], "left_semi")
    whole = first.join(large.select("image_id", "t", "z", "c").distinct(), ["image_id", "t", "z", "c"], "left_anti")
    return seeded_watershed(relief, kept.select(*COORDINATES, "v"), "yx").unionByName(whole.select(*COORDINATES, "v"))


def boundary_filter(px: DataFrame, mode: str, sigma: float, shape: dict[str, int]) -> DataFrame:
    """A boundary map: ``bright`` or ``dark`` lines (the largest eigenvalue of the Hessian of the negative or of the image itself),
    ``gradient`` (steps), ``raw`` or ``inverted`` (smoothed values, as they are or below the largest)."""
    if mode == "gradient":
        return gradient_magnitude(px, sigma, shape)
    if mode in ("bright", "dark"):
        return hessian_first_eigenvalue(px.withColumn("v", -F.col("v")) if mode == "bright" else px, sigma, shape)
    smooth = gaussian_smoothing(px, sigma, "yx", shape)
    if mode == "raw":
        return smooth
    if mode != "inverted":
        raise ValueError(f"no boundary filter {mode!r}")
    top = smooth.groupBy("image_id").agg(F.max("v").alias("top"))
    return smooth.join(top, "image_id").select(*COORDINATES, (F.col("top") - F.col("v")).alias("v"))


def carve(edges: DataFrame, seeds: DataFrame, background: int = 1, priority: float = 0.95, unbiased_below: float = 64.0) -> DataFrame:
    """``image_id, sp, label``: seeds ``(image_id, sp, label)`` grown over a region graph ``(image_id, sp1, sp2, w)``."""
    name = lambda c: F.concat_ws("|", "image_id", F.lpad(F.col(c).cast("string"), 20, "0"))
    grown = grow_over_edges(edges.select(name("sp1").alias("src"), name("sp2").alias("dst"), "w"), seeds.select(name("sp").alias("node"), F.col("label").cast("long").alias("label")), background, priority, unbiased_below)
    return grown.select(F.regexp_extract("node", r"^(.*)\|", 1).alias("image_id"), F.regexp_extract("node", r"(\d+)$", 1).cast("long").alias("sp"), "label")


def carved_object(store: DataFrame, name: str, carved: DataFrame, foreground: int = 2) -> DataFrame:
    """``store(name, image_id, sp)`` with the object saved, or replaced, under a name."""
    new = carved.where(F.col("label") == foreground).select(F.lit(name).alias("name"), "image_id", "sp")
    return store.where(F.col("name") != name).unionByName(new)


def carved_at(store: DataFrame, sp: DataFrame, place: dict[str, int]) -> DataFrame:
    """Names of stored objects at one place."""
    here = sp
    for axis, at in place.items():
        here = here.where(F.col(axis) == at)
    return here.select("image_id", F.col("v").alias("sp")).join(store, ["image_id", "sp"]).select("image_id", "name").distinct()


def done_image(store: DataFrame, sp: DataFrame) -> DataFrame:
    """Pixels of stored objects with the object's name; where objects overlap, the last name."""
    owner = store.groupBy("image_id", F.col("sp").alias("v")).agg(F.max("name").alias("name"))
    return sp.join(owner, ["image_id", "v"]).select(*COORDINATES, "name")


#: Side in pixels of the blocks in which superpixels are found, in whole cells.
SLIC_BLOCK = 256


def slic_superpixels(px: DataFrame, height: int, width: int, count: int = 100, compactness: float = 10.0, iterations: int = 10) -> DataFrame:
    """k-means of value and position with about ``count`` centres a frame: ``v`` is the number of the pixel's centre.

    Centres start as means of grid cells of side s. A pixel is compared with the centres that started in its own and the
    eight neighbouring cells. Distance is ``(dv)^2 + (compactness / s)^2 (dy^2 + dx^2)``, ties go to the smaller number.
    Pixels outside the grid are left out. Regions need not be connected; ``regions.connected_components`` of the result parts them.

    A round looks two cells far: from a pixel to a centre and on to its members. Frames within a block go through all rounds at
    once; others in passes of as many rounds as a halo of half a block, one round at least, allows. Memory is bounded by the block
    with its halo.
    """
    s = max(1, int((height * width / count) ** 0.5))
    across, down = -(-width // s), -(-height // s)
    frame = ["image_id", "t", "z", "c"]
    cells = max(1, SLIC_BLOCK // s)
    single = across <= cells and down <= cells
    at = {"y": F.floor(F.col("y") / s), "x": F.floor(F.col("x") / s)}
    inside = at["y"].between(0, down - 1) & at["x"].between(0, across - 1)
    assigned = px.where(inside).select("image_id", *(F.col(a).cast("int").alias(a) for a in COORDINATES[1:]), F.col("v").cast("double").alias("v"), (at["y"] * across + at["x"] + 1).cast("long").alias("k"))
    left = iterations
    while left:
        rounds = left if single else min(left, max(1, cells // 4))
        left -= rounds
        rows = assigned
        for a, n in (("y", down), ("x", across)):
            ends = [F.floor((F.greatest(F.least(at[a] + d, F.lit(n - 1)), F.lit(0))) / cells).cast("int") for d in (-2 * rounds, 2 * rounds)]
            rows = rows.withColumn(f"b{a}", F.lit(0) if single else F.explode(F.sequence(*ends)))
        work = _slic_rounds(s, across, down, cells, rounds, compactness * compactness / (s * s))
        key = [*frame, "by", "bx"]
        assigned = _dealt(rows, key).groupBy(*key).applyInArrow(work, "image_id string, t int, z int, y int, x int, c int, v double, k long")
        if left:
            assigned = written(assigned, "assigned")
    return assigned.select(*COORDINATES, F.col("k").alias("v"))


def _slic_rounds(s: int, across: int, down: int, cells: int, rounds: int, weight: float) -> Callable[[pa.Table], pa.Table]:
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x", "ascending")])  # sums do not depend on the order of rows
        y, x, k = (table[c].to_numpy().astype(np.int64) for c in "yxk")
        v, known = table["v"].to_numpy(), table["v"].is_valid().to_numpy()
        cy, cx = y // s, x // s
        low, wide = (cy.min() - 1, cx.min() - 1), cx.max() - cx.min() + 3
        size = (cy.max() - cy.min() + 3) * wide
        of = lambda ky, kx: (ky - low[0]) * wide + kx - low[1]
        for _ in range(rounds):
            mine = of((k - 1) // across, (k - 1) % across)
            n, values = np.bincount(mine, minlength=size), np.bincount(mine[known], minlength=size)
            my, mx = (np.bincount(mine, p, minlength=size) / np.maximum(n, 1) for p in (y, x))
            mv = np.bincount(mine[known], v[known], minlength=size) / np.maximum(values, 1)
            best, k = np.full(len(y), np.inf), np.zeros(len(y), dtype=np.int64)
            for ky, kx in ((cy + dy, cx + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                to = of(ky, kx)
                dv, dy, dx = v - mv[to], y - my[to], x - mx[to]
                far = dv * dv + weight * (dy * dy + dx * dx)
                nearer = (ky >= 0) & (ky < down) & (kx >= 0) & (kx < across) & (n[to] > 0) & ((k == 0) | (far < best))
                k[nearer] = (ky * across + kx + 1)[nearer]
                best[nearer] = np.where(np.isnan(far), np.inf, far)[nearer]
        core = (cy // cells == table["by"][0].as_py()) & (cx // cells == table["bx"][0].as_py())
        return table.select([*COORDINATES, "v"]).append_column("k", pa.array(k)).filter(pa.array(core))

    return work


def split_mergers(labels: DataFrame, counts: DataFrame, iterations: int = 10) -> DataFrame:
    """Objects of ``counts(image_id, t, object_id, k)`` with k > 1 become k objects by k-means of their pixels' places.

    Centres start at the means of k slices of equal width along the object's longest axis; each round is a join and a grouped
    mean, so that no object is gathered. The first part keeps its id, the others get ids above the largest of the frame. Parts
    that lose all their pixels vanish.
    """
    frame, key = ["image_id", "t"], ["image_id", "t", "v"]
    wanted = counts.where("k > 1").select("image_id", "t", F.col("object_id").alias("v"), F.col("k").cast("int").alias("n"))
    spans = labels.join(wanted, key).groupBy(*key, "n").agg(*(F.min(a).alias(f"{a}0") for a in "zyx"), *((F.max(a) - F.min(a) + 1).alias(f"{a}n") for a in "zyx"))
    longest = F.greatest("zn", "yn", "xn")
    along = F.when(F.col("xn") == longest, F.col("x") - F.col("x0")).when(F.col("yn") == longest, F.col("y") - F.col("y0")).otherwise(F.col("z") - F.col("z0"))
    part = written(labels.join(spans, key).select(*COORDINATES, "v", "n", F.floor(along * F.col("n") / longest).cast("int").alias("part")), "parts")
    for _ in range(iterations):
        centres = part.groupBy(*key, "part").agg(*(F.avg(a).alias(f"m{a}") for a in "zyx"))
        far = sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in "zyx"), F.lit(0.0))
        pairs = part.drop("part").join(centres, key)
        best = pairs.groupBy(*COORDINATES, "v", "n").agg(F.min(F.struct(far.alias("far"), "part")).alias("b"))
        part = written(best.select(*COORDINATES, "v", "n", "b.part"), "parts")
    top = labels.groupBy(*frame).agg(F.max("v").alias("top"))
    fresh = part.where("part > 0").select(*key, "part").distinct().withColumn("i", F.row_number().over(Window.partitionBy(*frame).orderBy("v", "part")))
    ids = fresh.join(top, frame).select(*key, "part", (F.col("top") + F.col("i")).cast("long").alias("new"))
    moved = part.join(ids, [*key, "part"], "left").select(*COORDINATES, F.coalesce("new", "v").alias("v"))
    return labels.join(wanted, key, "left_anti").select(*COORDINATES, "v").unionByName(moved)


def boundary_superpixels(px: DataFrame, mode: str, sigma: float, shape: dict[str, int], reduce_to: float | None = None, regularizer: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Basins of a boundary map and the graph of touching basins, weighted by the mean of the map along their border.

    Numbers of basins hold within an image: each frame is best an image of its own. With ``reduce_to`` basins are merged,
    cheapest borders first, until that share of each image's basins is left (see superpixels.merge_tree).
    """
    border = written(boundary_filter(px, mode, sigma, shape).withColumn("v", F.round("v", 9)), "border")
    basins = written(unseeded_watershed(border, "yx"), "basins")
    if reduce_to is not None and reduce_to < 1:
        low = border.groupBy("image_id").agg(F.min("v").alias("low"))  # borders of eigenvalues may be negative; costs start at 0
        edges = superpixels.edge_features(basins, border).join(low, "image_id").select(*superpixels.EDGE, (F.col("mean") - F.col("low")).alias("w"), "n")
        sizes = basins.groupBy("image_id", F.col("v").alias("sp")).agg(F.count(F.lit(1)).alias("size"))
        basins = written(superpixels.project_node_labels(basins, superpixels.reduce_superpixels(written(sizes, "sizes"), edges, reduce_to, regularizer)), "reduced")
    return basins, superpixels.edge_features(basins, border).select(*superpixels.EDGE, F.col("mean").alias("w"))
