"""Growing from seeds against plain Python on small inputs."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from voxelry.operators import growing, superpixels

PX = "image_id string, t int, z int, y int, x int, c int, v double"


def forest(edges, seeds):
    """Kruskal's minimum spanning forest in which no tree holds two seeds."""
    parent = {n: n for a, b, _ in edges for n in (a, b)} | {n: n for n in seeds}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    label = dict(seeds)
    for _, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
        a, b = find(a), find(b)
        if a == b or (a in label and b in label):
            continue
        if a in label:
            a, b = b, a
        parent[a] = b
    return {n: label[find(n)] for n in parent if find(n) in label}


def grown(spark, edges, seeds, **more):
    e = spark.createDataFrame(edges, "src string, dst string, w double")
    s = spark.createDataFrame(list(seeds.items()), "node string, label long")
    rows = growing.grow_over_edges(e, s, **more).collect()
    got = {r["node"]: r["label"] for r in rows}
    assert len(got) == len(rows)
    return got


def test_forest_of_a_random_graph_with_ties_repeats_and_parts_without_seed(spark):
    rng = random.Random(1)
    nodes = [f"n{i:02}" for i in range(60)]
    edges = [(a, b, float(rng.randrange(8))) for a, b in (rng.sample(nodes, 2) for _ in range(90))]
    edges += edges[:10] + [("n03", "n03", 0.0), ("lone", "lone2", 1.0)]
    seeds = {n: i % 3 + 1 for i, n in enumerate(rng.sample(nodes, 7))}
    got = grown(spark, edges, seeds)
    assert got == forest(edges, seeds)
    assert "lone" not in got


def test_no_edges_no_seeds_and_nulls(spark):
    assert grown(spark, [], {"a": 5}) == {"a": 5}
    assert grown(spark, [("a", "b", 1.0)], {}) == {}
    assert grown(spark, [("a", "b", None), ("b", "c", 1.0), (None, "c", 1.0)], {"b": 2}) == {"b": 2, "c": 2}


def test_edges_towards_the_background_count_less(spark):
    edges = [("a", "b", 10.0), ("b", "c", 9.0)]
    assert grown(spark, edges, {"a": 1, "c": 2})["b"] == 2
    assert grown(spark, edges, {"a": 1, "c": 2}, background=1, priority=0.5)["b"] == 1
    assert grown(spark, edges, {"a": 1, "c": 2}, background=1, priority=0.5, unbiased_below=50.0)["b"] == 2


def line(spark, values):
    return spark.createDataFrame([("i", 0, 0, 0, x, 0, float(v)) for x, v in enumerate(values)], PX)


def by_x(df):
    return [r["v"] for r in df.orderBy("x").collect()]


def test_watersheds_of_a_line(spark):
    px = line(spark, [0, 1, 5, 2, 0, 0, 3, 9, 1])
    seeds = line(spark, [1, 0, 0, 0, 0, 2, 0, 0, 0])
    assert by_x(growing.seeded_watershed(px, seeds)) == [1, 1, 1, 2, 2, 2, 2, 2, 2]
    assert [r["x"] for r in growing.local_minima(px).orderBy("x").collect()] == [0, 4, 5, 8]
    assert by_x(growing.unseeded_watershed(px)) == [1, 1, 1, 2, 2, 2, 2, 2, 3]
    assert growing.unseeded_watershed(px.where("false")).count() == 0


def test_touching_cores_stay_apart(spark):
    px = line(spark, [9, 8, 5, 6, 9, 1, 7])
    cores = line(spark, [1, 0, 0, 0, 2, 0, 0])
    assert by_x(growing.labeled_threshold_cores(px, 4.0, cores)) == [1, 1, 1, 2, 2]


def test_distance_without_any_mask_is_null(spark):
    px = line(spark, [1, 1, 1])
    frames = px.select("image_id", "t", "z", "c").distinct()
    assert by_x(growing.distance_transform(px.where("false"), frames, 1, 3)) == [None] * 3
    assert by_x(growing.distance_transform(px.where("x = 2"), frames, 1, 3)) == [2, 1, 0]


def test_dt_watershed_parts_two_chambers(spark):
    wall = [("i", 0, 0, y, 6, 0, 1.0) for y in range(9)] + [("i", 0, 0, 0, 0, 0, 0.0)]
    got = growing.dt_watershed(spark.createDataFrame(wall, PX), 0.5, 0.0, 4, 0.9, 9, 13).collect()
    assert len(got) == 9 * 13
    assert len({r["v"] for r in got if r["x"] < 6} & {r["v"] for r in got if r["x"] > 6}) == 0


def test_an_object_of_two_blobs_is_split(spark):
    rows = [("i", 0, 0, y, x, 0, 1) for y in range(3) for x in (*range(3), *range(10, 13))] + [("i", 0, 0, 9, 9, 0, 4)]
    labels = spark.createDataFrame(rows, PX.replace("v double", "v long"))
    counts = spark.createDataFrame([("i", 0, 1, 2)], "image_id string, t int, object_id long, k int")
    got = {(r["y"], r["x"]): r["v"] for r in growing.split_mergers(labels, counts).collect()}
    assert {v for (_, x), v in got.items() if x < 3} == {1} and {v for (y, x), v in got.items() if x >= 10} == {5} and got[9, 9] == 4


def test_carving_a_region_graph(spark):
    edges = spark.createDataFrame([("i|1", 1, 2, 80.0), ("i|1", 2, 3, 90.0), ("i|1", 3, 4, 10.0)], "image_id string, sp1 long, sp2 long, w double")
    seeds = spark.createDataFrame([("i|1", 1, 1), ("i|1", 4, 2)], "image_id string, sp long, label int")
    assert sorted(map(tuple, growing.carve(edges, seeds).collect())) == [("i|1", 1, 1), ("i|1", 2, 1), ("i|1", 3, 2), ("i|1", 4, 2)]


def test_blocks_change_no_label(spark, monkeypatch):
    """Contracted blocks of any size against the graph of all pixels: plateaus, holes, several frames, seeds on faces."""
    rng = random.Random(12)
    pixels, marks = [], {}
    for image, t, z in (("a", 0, 0), ("a", 1, 0), ("b|", 0, 0), ("b|", 0, 1)):
        for y in range(14):
            for x in range(17):
                if rng.random() < 0.9:
                    pixels.append((image, t, z, y, x, 0, float(rng.randrange(6))))
        for k in range(5):
            marks[image, t, z, rng.randrange(14), rng.randrange(17), 0] = k % 3 + 1 + 10 * z
    px, seeds = spark.createDataFrame(pixels, PX), spark.createDataFrame([(*k, float(v)) for k, v in marks.items()], PX)
    for axes in ("yx", "zyx"):
        relief = growing.numbered_pixels(px)
        edges = [(r["src"], r["dst"], r["w"]) for r in growing.pixel_edges(relief, axes).collect()]
        node = {tuple(r[c] for c in ("image_id", "t", "z", "y", "x", "c")): r["node"] for r in relief.collect()}
        assert len(set(node.values())) == len(pixels)
        want = forest(edges, {node[k]: v for k, v in marks.items() if k in node})
        for side in (64, 5, 3):
            monkeypatch.setattr(growing, "BLOCK", {"z": side, "y": side, "x": side})
            rows = growing.seeded_watershed(px, seeds, axes).collect()
            assert {node[tuple(r[c] for c in ("image_id", "t", "z", "y", "x", "c"))]: r["v"] for r in rows} == want and len(rows) == len(want)


def test_few_edges_leave_the_blocks(spark):
    rng = random.Random(13)
    px = spark.createDataFrame([("a", 0, 0, y, x, 0, rng.random()) for y in range(128) for x in range(128)], PX).withColumn("label", F.lit(0).cast("long"))
    rows = growing._contracted(growing.numbered_pixels(px), "yx")
    assert rows.where("a is not null").count() < 0.1 * 2 * 128 * 128 and rows.where("node is not null").count() == 128 * 128


def queue_merges(sizes, borders, left):
    """Merging by one queue: always the cheapest border of all, until ``left`` regions are left."""
    sizes, borders, into = dict(sizes), {tuple(sorted(k)): list(v) for k, v in borders.items()}, {n: n for n in sizes}

    def cost(k):
        return borders[k][0] / borders[k][1] / (sizes[k[0]] ** -0.5 + sizes[k[1]] ** -0.5)

    while len(sizes) > left and borders:
        a, b = min(borders, key=lambda k: (cost(k), k))
        sizes[a] += sizes.pop(b)
        into = {n: a if m == b else m for n, m in into.items()}
        new = {}
        for k, (total, n) in borders.items():
            k = tuple(sorted({a if x == b else x for x in k}))
            if len(k) == 2:
                t, m = new.get(k, (0.0, 0.0))
                new[k] = [t + total, m + n]
        borders = new
    return into


def test_merging_in_rounds_is_that_of_one_queue(spark):
    rng = random.Random(21)
    sizes, borders, want = {}, {}, {}
    for image in ("a", "b"):
        mine = {n: rng.randint(1, 40) for n in range(1, 31)}
        ways = {}
        for _ in range(70):
            a, b = rng.sample(range(1, 29), 2)  # 29 and 30 touch none
            n = rng.randint(1, 9)
            ways[tuple(sorted((a, b)))] = rng.random() * n, float(n)
        sizes |= {(image, k): v for k, v in mine.items()}
        borders |= {(image, *k): v for k, v in ways.items()}
        for share in (0.5, 0.2, 0.0):
            want[image, share] = queue_merges(mine, ways, math.ceil(30 * share))
    nodes = spark.createDataFrame([(*k, v) for k, v in sizes.items()], "image_id string, sp long, size long")
    edges = spark.createDataFrame([(*k, t / n, n) for k, (t, n) in borders.items()], "image_id string, sp1 long, sp2 long, w double, n double")
    for share in (0.5, 0.2, 0.0):
        got = {(r["image_id"], r["sp"]): r["segment"] for r in superpixels.reduce_superpixels(nodes, edges, share).collect()}
        assert got == {(image, n): m for image in ("a", "b") for n, m in want[image, share].items()}
    assert superpixels.reduce_superpixels(nodes.limit(0), edges.limit(0), 0.5).count() == 0


def test_distances_across_strips_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    at = [("a", y, x) for y, x in {(int(rng.integers(0, 7)), int(rng.integers(0, 200))) for _ in range(9)}] + [("c", 1, 1), ("a", 3, 250)]
    mask = spark.createDataFrame([(i, 0, 0, y, x, 0, 1.0) for i, y, x in at], PX)
    frames = spark.createDataFrame([("a", 0, 0, 0), ("b", 0, 0, 0)], "image_id string, t int, z int, c int")
    found = growing.distance_transform(mask, frames, 7, 200)
    got = {(r["image_id"], r["y"], r["x"]): r["v"] for r in found.collect()}
    assert len(got) == 2 * 7 * 200 and all(got["b", y, x] is None for y in range(7) for x in range(200))
    assert all(got["a", y, x] == min(((y - b) ** 2 + (x - k) ** 2) ** 0.5 for i, b, k in at if i == "a" and k < 200) for y in range(7) for x in range(200))


def _slic(pixels, height, width, count, compactness, iterations):
    """Superpixels of one frame ``(y, x) -> v``, by looking at all."""
    s = max(1, int((height * width / count) ** 0.5))
    across, down = -(-width // s), -(-height // s)
    of = {(y, x): y // s * across + x // s + 1 for y, x in pixels}
    for _ in range(iterations):
        members: dict = {}
        for p, k in of.items():
            members.setdefault(k, []).append(p)
        mean = lambda a: sum(a) / len(a)
        centre = {k: (mean([y for y, _ in m]), mean([x for _, x in m]), mean([pixels[p] for p in m])) for k, m in members.items()}

        def far(y, x, k):
            dy, dx, dv = y - centre[k][0], x - centre[k][1], pixels[y, x] - centre[k][2]
            return dv * dv + compactness * compactness / (s * s) * (dy * dy + dx * dx)

        near = lambda y, x: [ky * across + kx + 1 for ky in range(y // s - 1, y // s + 2) for kx in range(x // s - 1, x // s + 2) if 0 <= ky < down and 0 <= kx < across]
        of = {(y, x): min((far(y, x, k), k) for k in near(y, x) if k in centre)[1] for y, x in of}
    return of


def test_superpixels_by_blocks_are_those_of_the_whole_frame(spark, monkeypatch):
    rng = random.Random(6)
    frames = {t: {(y, x): float(rng.randrange(40)) for y in range(26) for x in range(31) if rng.random() < 0.8} for t in range(2)}
    px = spark.createDataFrame([("a", t, 0, y, x, 0, v) for t, f in frames.items() for (y, x), v in f.items()], "image_id string, t int, z int, y int, x int, c int, v double")
    want = {(t, *p, k) for t, f in frames.items() for p, k in _slic(f, 26, 31, 50, 5.0, 3).items()}
    for side in (256, 12, 3):  # s is 4
        monkeypatch.setattr(growing, "SLIC_BLOCK", side)
        found = growing.slic_superpixels(px, 26, 31, 50, 5.0, 3)
        assert {(r["t"], r["y"], r["x"], r["v"]) for r in found.collect()} == want


def test_superpixels_of_a_frame_within_a_block_take_one_shuffle(spark):
    px = spark.range(100).selectExpr("'a' image_id", "0 t", "0 z", "cast(id div 10 as int) y", "cast(id % 10 as int) x", "0 c", "if(id = 7, null, cast(id % 3 as double)) v")
    found = growing.slic_superpixels(px, 10, 10, 4, 10.0, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and found.count() == 100


def test_basins_of_frames_within_a_block_are_those_of_rounds(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("a", t, z, y, x, 0, None if rng.random() < 0.03 else float(rng.randrange(6))) for t in range(2) for z in range(2) for y in range(13) for x in range(17) if rng.random() < 0.9]
    px = spark.createDataFrame(rows, "image_id string, t int, z int, y int, x int, c int, v double")
    for axes in ("yx", "zyx"):
        with monkeypatch.context() as m:
            for name in ("local_minima", "seeded_watershed"):
                m.setattr(growing, name, None)
            within = {tuple(r) for r in growing.unseeded_watershed(px, axes).collect()}
        px = px.cache()
        assert within == {tuple(r) for r in growing.seeded_watershed(px, growing.local_minima(px, axes), axes).collect()} and len(within) > 500
    monkeypatch.setattr(growing, "BLOCK", {"z": 16, "y": 10, "x": 20})
    mixed = px.where("t = 0 or y < 10")  # frame 0 is wide, frame 1 is not
    assert {tuple(r) for r in growing.unseeded_watershed(mixed).collect() if r["t"] == 0} == {r for r in within if r[1] == 0}


def test_regions_of_small_images_are_merged_one_by_one(spark, monkeypatch):
    rng = random.Random(9)
    nodes = spark.createDataFrame([(i, k, rng.randrange(1, 4)) for i in ("a", "b") for k in range(1, 41)] + [("c", 5, 1)], "image_id string, sp long, size long")
    pairs = {(i, *sorted(rng.sample(range(1, 41), 2))) for i in ("a", "b") for _ in range(90)}
    edges = spark.createDataFrame([(*p, None if rng.random() < 0.03 else float(rng.randrange(1, 5)), rng.randrange(1, 4)) for p in sorted(pairs)] + [("a", 3, 99, 0.5, 1)], "image_id string, sp1 long, sp2 long, w double, n long")
    for share in (0.0, 0.3, 0.8, 1.0):
        rows = lambda: sorted(map(tuple, superpixels.reduce_superpixels(nodes, edges, share).collect()))  # noqa: B023, E731
        with monkeypatch.context() as m:
            for name in ("merge_tree", "merge_superpixels"):
                m.setattr(superpixels, name, None)
            alone = rows()
        if share == 0.3:
            with monkeypatch.context() as m:
                m.setattr(superpixels, "MERGED_AT_ONCE", 0)
                assert rows() == alone
        assert len(alone) == 81 and len({r[2] for r in alone if r[0] == "a"}) >= math.ceil(40 * share)
