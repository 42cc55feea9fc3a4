"""Joint assignment in tracking: links, divisions, appearances, disappearances and false detections of least total cost.

Every object offers a start (where a link leaves it) and an end (where one comes in). A link takes one of each; what is left
free costs a disappearance or an appearance; a false detection takes both of its own; a division offers a second start. The
cheapest choice is an assignment of starts to ends, over all frames at once. It falls apart into the connected components of
the graph of links. Images of up to ``AT_ONCE`` objects are solved exactly, in bundles, many at a time, and so are components
of that many objects in larger images. Larger ones are cut into tiles of space and time with no more objects than that; a tile is solved exactly, given the links that leave it, and
the tiles of the next pass lie elsewhere, so that the cost falls from pass to pass and never exceeds that of the start,
which is the assignment by mutually cheapest links.
"""

from __future__ import annotations

import math
from collections import defaultdict
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.components import connected_components
from voxelry.operators.objects import OBJECT
from voxelry.operators.tracking import bundled, by_bundle, link_tracks
from voxelry.plans.stored import written

#: Objects that are solved together: about a second's work, which grows in proportion.
AT_ONCE = 20_000
#: Frames that a tile spans at most, and its side in pixels before it is halved.
TILE_FRAMES = 16
TILE_SIDE = 1024.0
HALVINGS = 11
_LINK = ["image_id", "t", "src", "dst"]


def tracking_problem(objects: DataFrame, borders: DataFrame, detections: DataFrame | None = None, divisions: DataFrame | None = None) -> DataFrame:
    """``image_id, t, object_id, cy, cx, appear, disappear, false_cost, divide_cost`` of all objects.

    ``borders`` is as by border_costs. ``false_cost`` is what a false detection costs more than one cell (``detections`` as
    by detection_costs), ``divide_cost`` what a division costs more than none (``divisions`` as by division_costs); null where an
    object cannot be one. A division that gains more than a disappearance costs counts as gaining just that.
    """
    rows = objects.select(*OBJECT, "cy", "cx").join(borders.select(*OBJECT, "appear", "disappear"), OBJECT)
    null = F.lit(None).cast("double")
    if detections is not None:
        cost = lambda k: F.max(F.when(F.col("k") == k, F.col("cost")))
        rows = rows.join(detections.groupBy(*OBJECT).agg((cost(0) - cost(1)).alias("false_cost")), OBJECT, "left")
    else:
        rows = rows.withColumn("false_cost", null)
    if divisions is not None:
        cost = lambda yes: F.max(F.when(F.col("divides") == yes, F.col("cost")))
        rows = rows.join(divisions.groupBy(*OBJECT).agg((cost(True) - cost(False)).alias("divide_cost")), OBJECT, "left")
    else:
        rows = rows.withColumn("divide_cost", null)
    return rows.withColumn("divide_cost", F.when(F.col("divide_cost").isNotNull(), F.greatest(F.col("divide_cost"), -F.col("disappear"))))


def least_cost_columns(cost: np.ndarray) -> np.ndarray:
    """For each row of ``cost`` (no more rows than columns) its column in the assignment of least cost, by shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=bool)
        while True:
            done[j] = True
            reach = cost[owner[j] - 1] - u[owner[j]] - v[1:]
            nearer = ~done[1:] & (reach < least[1:])
            least[1:][nearer] = reach[nearer]
            way[1:][nearer] = j
            open_ = np.where(done, np.inf, least)
            open_[0] = np.inf
            j = int(open_.argmin())
            step = open_[j]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    columns = np.empty(n, dtype=np.int64)
    columns[owner[1:][owner[1:] > 0] - 1] = np.nonzero(owner[1:])[0]
    return columns


def least_cost_choice(options: list[dict[int, float]]) -> list[int]:
    """For each row one of its columns (``options[row]``: column -> cost), or -1 at cost 0, at the least total cost, no column twice.

    Shortest augmenting paths over the given pairs only, row after row; a row that stays free does so for good.
    """
    u, v = [0.0] * len(options), defaultdict(float)
    chosen, owner = [-1] * len(options), {}
    for i, mine in enumerate(options):
        u[i] = min(0.0, min((c - v[j] for j, c in mine.items()), default=0.0))
        row, far, best, end = i, 0.0, math.inf, (i, -1)
        rows, least, way, done, heap = {i: 0.0}, {}, {}, {}, []
        while True:
            if far - u[row] < best:
                best, end = far - u[row], (row, -1)
            for j, c in options[row].items():
                d = far + c - u[row] - v[j]
                if j not in done and d < best and d < least.get(j, math.inf):
                    least[j], way[j] = d, row
                    heappush(heap, (d, j))
            while heap and heap[0][1] in done:
                heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            far, j = heappop(heap)
            done[j] = far
            if j not in owner:
                best, end = far, (way[j], j)
                break
            row = owner[j]
            rows[row] = far
        for row, d in rows.items():
            u[row] += best - d
        for j, d in done.items():
            v[j] -= best - d
        row, j = end
        while True:  # every row on the path hands its column to the row before it
            left, chosen[row] = chosen[row], j
            if j >= 0:
                owner[j] = row
            if row == i:
                break
            row, j = way[left], left
    return chosen


def solve(nodes: list[tuple], links: list[tuple]) -> tuple[list[tuple], list]:
    """The cheapest choice for ``nodes (name, appear, disappear, false, divide, start, end, more)`` and ``links (src, dst, cost)``.

    ``start`` and ``end`` tell whether an object's first start and its end are free, ``more`` whether a second start is. Returns the links ``(src, dst, second)`` chosen
    and the names of false detections. Exact but for divisions of what might be a false detection: those are put right after.
    """
    place = {x[0]: k for k, x in enumerate(nodes)}
    component = list(range(len(nodes)))

    def root(k: int) -> int:
        while component[k] != k:
            component[k] = component[component[k]]
            k = component[k]
        return k

    for src, dst, _ in links:
        component[root(place[src])] = root(place[dst])
    parts: dict[int, tuple[list[int], list[tuple]]] = {}
    for k in range(len(nodes)):
        parts.setdefault(root(k), ([], []))[0].append(k)
    for link in links:
        parts[root(place[link[0]])][1].append(link)
    chosen, false = [], []
    for members, mine in parts.values():
        found, none = _solve_component([nodes[k] for k in members], mine)
        chosen += found
        false += none
    return chosen, false


def _solve_component(nodes: list[tuple], links: list[tuple]) -> tuple[list[tuple], list]:
    place = {x[0]: k for k, x in enumerate(nodes)}
    starts = [(k, False) for k, x in enumerate(nodes) if x[5]] + [(k, True) for k, x in enumerate(nodes) if x[4] is not None and x[7]]
    gain: dict[tuple[int, bool], dict[int, float]] = {s: {} for s in starts}

    def offer(start: tuple[int, bool], j: int, value: float) -> None:
        if start in gain and value > gain[start].get(j, 0.0):  # what gains nothing stays free
            gain[start][j] = value

    for src, dst, cost in links:
        i, j = place[src], place[dst]
        if nodes[j][6]:
            offer((i, False), j, nodes[i][2] + nodes[j][1] - cost)
            if (i, True) in gain:
                offer((i, True), j, nodes[j][1] - cost - nodes[i][4])
    for k, (_, appear, disappear, wrong, _, start, end, _) in enumerate(nodes):
        if wrong is not None and start and end:
            offer((k, False), k, appear + disappear - wrong)
    columns = least_cost_choice([{j: -g for j, g in gain[s].items()} for s in starts])
    taken = {s: j for s, j in zip(starts, columns) if j >= 0}
    chosen, false = [], []
    for k, x in enumerate(nodes):
        first, second = taken.get((k, False)), taken.get((k, True))
        if second is not None and x[5]:
            if first == k:  # a false detection does not divide: the better of both stays
                if gain[k, False].get(second, 0.0) > gain[k, False][k]:
                    first = second
                second = None
            elif first is None:
                first, second = second, None
        if first == k:
            false.append(x[0])
        elif first is not None:
            chosen.append((x[0], nodes[first][0], False))
        if second is not None:
            chosen.append((x[0], nodes[second][0], True))
    return chosen, false


def joint_links(nodes: DataFrame, links: DataFrame, passes: int = 6, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """The links ``image_id, t, src, dst, cost, second`` and the false detections ``image_id, t, object_id`` of least total cost.

    ``nodes`` is as by tracking_problem, ``links(image_id, t, src, dst, cost)`` are the candidates; of links between the same
    objects the cheapest counts, links of objects that are no nodes are left out. ``second`` marks the second child of a
    division. ``passes`` bounds the rounds over components of more than ``at_once`` objects; smaller ones are exact.
    """
    nodes = written(nodes.select(*OBJECT[:2], F.col("object_id").cast("long").alias("object_id"), "cy", "cx", "appear", "disappear", "false_cost", "divide_cost"), "objects")
    bundles, large = bundled(nodes, at_once)
    links = links.select(*_LINK, "cost")
    if large is None:
        return _whole_images(nodes, links, bundles)
    chosen, false = _whole_images(nodes.join(large, "image_id", "left_anti"), links.join(large, "image_id", "left_anti"), bundles)
    more, wrong = _large_images(nodes.join(large, "image_id", "left_semi"), links.join(large, "image_id", "left_semi"), passes, at_once)
    return chosen.unionByName(more), false.unionByName(wrong)


def _whole_images(nodes: DataFrame, links: DataFrame, bundles: int) -> tuple[DataFrame, DataFrame]:
    """The exact choice for images that are no larger than what is solved at once."""
    kind = pa.schema([("image_id", pa.string()), ("t", pa.int32()), ("src", pa.int64()), ("dst", pa.int64()), ("cost", pa.float64()), ("second", pa.bool_())])

    def work(mine: pa.Table, ways: pa.Table) -> pa.Table:
        mine = mine.sort_by([(c, "ascending") for c in OBJECT])
        names = list(zip(*(mine[c].to_pylist() for c in OBJECT)))
        place = {name: k for k, name in enumerate(names)}
        costs = list(zip(*(mine[c].to_pylist() for c in ("appear", "disappear", "false_cost", "divide_cost"))))
        cheapest: dict[tuple[int, int], float] = {}
        for image, t, src, dst, cost in zip(*(ways[c].to_pylist() for c in (*_LINK, "cost"))):
            a, b = place.get((image, t, src)), place.get((image, t + 1, dst))
            # a link that costs more than both its ends left free is never a first child, nor a second one
            if a is not None and b is not None and cost is not None and cost < costs[a][1] + costs[b][0] and cost < cheapest.get((a, b), math.inf):
                cheapest[a, b] = cost
        chosen, false = solve([(k, *c, True, True, True) for k, c in enumerate(costs)], [(a, b, c) for (a, b), c in sorted(cheapest.items())])
        out = [(*names[a], names[b][2], cheapest[a, b], second) for a, b, second in chosen] + [(*names[k], None, None, False) for k in false]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)] if out else [pa.array([], f.type) for f in kind], schema=kind)

    both = by_bundle(nodes, bundles).cogroup(by_bundle(links, bundles))
    found = written(both.applyInArrow(work, "image_id string, t int, src long, dst long, cost double, second boolean"), "found")
    return found.where("dst is not null"), found.where("dst is null").select("image_id", "t", F.col("src").alias("object_id"))


def _large_images(nodes: DataFrame, links: DataFrame, passes: int, at_once: int) -> tuple[DataFrame, DataFrame]:
    """Components of up to ``at_once`` objects exactly, others in tiles."""
    key = F.concat_ws("|", "image_id", F.lpad(F.col("t").cast("string"), 10, "0"), F.lpad(F.col("object_id").cast("string"), 20, "0"))
    nodes = written(nodes.withColumn("node", key), "objects")
    ends = nodes.select("image_id", "t", F.col("object_id").alias("src"), F.col("node").alias("a"), "disappear")
    others = nodes.select("image_id", (F.col("t") - 1).alias("t"), F.col("object_id").alias("dst"), F.col("node").alias("b"), "appear")
    links = links.groupBy(*_LINK).agg(F.min("cost").alias("cost")).join(ends, ["image_id", "t", "src"]).join(others, ["image_id", "t", "dst"])
    # a link that costs more than both its ends left free is never a first child, nor a second one
    links = written(links.where("cost < appear + disappear").select(*_LINK, "cost", "a", "b"), "links")
    parts = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    nodes = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    nodes = written(nodes.join(sizes, "component"), "components")
    bundles = max(1, -(-nodes.count() // at_once))
    small = nodes.where(F.col("members") <= at_once).withColumn("block", F.concat(F.lit("bundle "), F.pmod(F.xxhash64("component"), F.lit(bundles)).cast("string")))
    large = nodes.where(F.col("members") > at_once)
    if large.isEmpty():
        return _solved(small, links, None)
    greedy = link_tracks(links.join(large.select(F.col("node").alias("a")), "a", "left_semi").select(*_LINK, "cost"))
    state = greedy.select(*_LINK, F.lit(False).alias("second")), large.select(*OBJECT).limit(0)
    for k in range(passes):
        tiles = _tiles(large, k, at_once)
        state = _solved(small.unionByName(tiles) if k + 1 == passes else tiles, links, state)
    return state


def _tiles(nodes: DataFrame, number: int, at_once: int) -> DataFrame:
    """``block`` for each node: the largest tile, of those halved again and again, that holds at most ``at_once`` objects.

    Every pass shifts the tiles. Objects that crowd a single pixel are dealt by hash.
    """
    left, done = nodes, None
    frames = F.floor((F.col("t") + number * TILE_FRAMES // 2) / TILE_FRAMES)
    for level in range(HALVINGS + 1):
        side = TILE_SIDE / (1 << level)
        shift = side * (number % 3) / 3
        tile = [F.floor((F.col(f"c{a}") + shift) / side).cast("string") for a in "yx"]
        if level == HALVINGS:
            tile.append(F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / at_once)).cast("string"))
        here = left.withColumn("block", F.concat_ws("|", "image_id", F.lit(level).cast("string"), frames.cast("string"), *tile))
        crowd = here.groupBy("block").agg(F.count(F.lit(1)).alias("crowd"))
        here = written(here.join(crowd, "block"), "tiles")
        fits = here if level == HALVINGS else here.where(F.col("crowd") <= at_once)
        done = fits.drop("crowd") if done is None else done.unionByName(fits.drop("crowd"))
        left = here.where(F.col("crowd") > at_once).drop("crowd", "block")
        if level == HALVINGS or left.isEmpty():
            return done


def _solved(nodes: DataFrame, links: DataFrame, state: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """Solves every block given what is chosen between blocks; the links and false detections that then hold."""
    nodes = written(nodes.select("block", "node", *OBJECT, "appear", "disappear", "false_cost", "divide_cost"), "blocks")
    home = nodes.select("node", "block")
    places = nodes.select("node", *OBJECT)
    inner = links.join(home.select(F.col("node").alias("a"), "block"), "a").join(home.select(F.col("node").alias("b"), F.col("block").alias("other")), "b")
    inner = written(inner, "inner")
    kept = None
    if state is not None:
        chosen = state[0].join(inner.select(*_LINK, "a", "b", "block", "other"), _LINK)
        # if one link of a division leaves the block, both are kept
        leaving = chosen.where("block <> other").select("a").distinct()
        kept = written(chosen.join(leaving, "a", "left_semi").select(*_LINK, "second", "a", "b"), "kept")
        out = kept.groupBy(F.col("a").alias("node")).agg(F.lit(True).alias("out"), F.count(F.lit(1)).alias("children"))
        come = kept.select(F.col("b").alias("node"), F.lit(True).alias("come"))
        nodes = nodes.join(out, "node", "left").join(come, "node", "left")
    else:
        nodes = nodes.withColumns({"out": F.lit(False), "children": F.lit(0), "come": F.lit(False)})
    nodes = nodes.select("block", "node", "appear", "disappear", "false_cost", "divide_cost", (~F.coalesce("out", F.lit(False))).alias("start"), (~F.coalesce("come", F.lit(False))).alias("end"), (F.coalesce("children", F.lit(0)) < 2).alias("more"))

    def work(mine: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        none = lambda x: None if x is None or x != x else float(x)
        mine, ways = mine.sort_values("node"), ways.sort_values(["a", "b"])
        rows = [(r.node, float(r.appear), float(r.disappear), none(r.false_cost), none(r.divide_cost), bool(r.start), bool(r.end), bool(r.more)) for r in mine.itertuples()]
        chosen, false = solve(rows, [(r.a, r.b, float(r.cost)) for r in ways.itertuples()]) if rows else ([], [])
        out = [(a, b, second) for a, b, second in chosen] + [(x, None, False) for x in false]
        return pd.DataFrame(out, columns=["a", "b", "second"]).astype({"second": "bool"})

    ways = inner.where("block = other").select("block", "a", "b", "cost")
    found = written(nodes.groupBy("block").cogroup(ways.groupBy("block")).applyInPandas(work, "a string, b string, second boolean"), "found")
    new = found.where("b is not null").join(inner.select(*_LINK, "a", "b"), ["a", "b"]).select(*_LINK, "second")
    if kept is not None:
        new = new.unionByName(kept.select(*_LINK, "second"))
    false = found.where("b is null").select(F.col("a").alias("node")).join(places, "node").select(*OBJECT)
    new = written(new.join(links.select(*_LINK, "cost"), _LINK).select(*_LINK, "cost", "second"), "chosen")
    return new, written(false, "false")


def assignment_cost(nodes: DataFrame, chosen: DataFrame, false: DataFrame | None = None) -> DataFrame:
    """``image_id, cost``: the total cost of chosen links (``second`` may be absent), divisions, free ends and false detections."""
    chosen = chosen if "second" in chosen.columns else chosen.withColumn("second", F.lit(False))
    out = chosen.groupBy("image_id", "t", F.col("src").alias("object_id")).agg(F.sum("cost").alias("links"), F.max("second").alias("divides"))
    come = chosen.select("image_id", (F.col("t") + 1).alias("t"), F.col("dst").alias("object_id"), F.lit(True).alias("come"))
    rows = nodes.join(out, OBJECT, "left").join(come, OBJECT, "left")
    rows = rows.join(false.select(*OBJECT, F.lit(True).alias("wrong")), OBJECT, "left") if false is not None else rows.withColumn("wrong", F.lit(None).cast("boolean"))
    active = F.when(F.col("links").isNull(), F.col("disappear")).otherwise(F.col("links")) + F.when(F.col("come").isNull(), F.col("appear")).otherwise(0.0) + F.when(F.col("divides"), F.col("divide_cost")).otherwise(0.0)
    return rows.groupBy("image_id").agg(F.sum(F.when(F.col("wrong"), F.col("false_cost")).otherwise(active)).alias("cost"))
