"""Joint assignment against all choices by brute force, windows against pixels, costs that never rise."""

import itertools
import math
import random
import time

import numpy as np
import pytest

from voxelry.operators import assignment, tracking

NODES = "image_id string, t int, object_id long, cy double, cx double, appear double, disappear double, false_cost double, divide_cost double"
LINKS = "image_id string, t int, src long, dst long, cost double"


def total(nodes, links, chosen, false):
    """The cost of a choice, None if it breaks a rule. ``chosen``: links (t, src, dst) with their place among ``links``."""
    out, come = {}, {}
    for t, src, dst, cost in chosen:
        out.setdefault((t, src), []).append(cost)
        come[t + 1, dst] = come.get((t + 1, dst), 0) + 1
    cost = 0.0
    for (t, o), (appear, disappear, wrong, divide) in nodes.items():
        mine, n = out.get((t, o), []), come.get((t, o), 0)
        if (t, o) in false:
            if mine or n or wrong is None:
                return None
            cost += wrong
            continue
        if n > 1 or len(mine) > 2 or len(mine) == 2 and divide is None:
            return None
        cost += sum(mine) + (0 if mine else disappear) + (0 if n else appear) + (divide if len(mine) == 2 else 0)
    return cost


def least(nodes, links):
    doubtful = [k for k, v in nodes.items() if v[2] is not None]
    best = math.inf
    for size in range(len(links) + 1):
        for chosen in itertools.combinations(links, size):
            used = {(t, s) for t, s, _, _ in chosen} | {(t + 1, d) for t, _, d, _ in chosen}
            free = [k for k in doubtful if k not in used]
            base = total(nodes, links, chosen, ())
            if base is None:
                continue
            # each unused doubtful object decides for itself
            best = min(best, base + sum(min(0.0, nodes[k][2] - nodes[k][0] - nodes[k][1]) for k in free))
    return best


def graph(rng, frames, most, doubt, divide):
    nodes = {(t, o): (rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(-3, 12) if rng.random() < doubt else None, max(rng.uniform(-4, 6), 0.0) if rng.random() < divide else None) for t in range(frames) for o in range(rng.randint(1, most))}
    nodes = {k: (a, d, w, None if v is None else max(v, -d)) for k, (a, d, w, v) in nodes.items()}
    pairs = [(t, a, b) for (t, a) in nodes for (u, b) in nodes if u == t + 1]
    links = [(*p, rng.uniform(0, 14)) for p in rng.sample(pairs, min(len(pairs), 9))]
    return nodes, links


def solved(nodes, links):
    rows = [(k, a, d, w, v, True, True, True) for k, (a, d, w, v) in nodes.items()]
    chosen, false = assignment.solve(rows, [((t, a), (t + 1, b), c) for t, a, b, c in links])
    cost = {(t, a, b): c for t, a, b, c in links}
    for src, dst, second in chosen:
        assert not second or (src, False) in {(s, x) for s, _, x in chosen}
    return total(nodes, links, [(*s, d[1], cost[s[0], s[1], d[1]]) for s, d, _ in chosen], set(false))


@pytest.mark.parametrize("doubt, divide", [(0.0, 0.0), (0.8, 0.0), (0.0, 0.7)])
def test_assignment_is_the_optimum(doubt, divide):
    rng = random.Random(8)
    for _ in range(60):
        nodes, links = graph(rng, rng.randint(2, 4), 3, doubt, divide)
        assert solved(nodes, links) == pytest.approx(least(nodes, links))


def test_with_doubts_and_divisions_the_choice_is_allowed_and_near_the_optimum():
    rng, found, best = random.Random(9), 0.0, 0.0
    for _ in range(60):
        nodes, links = graph(rng, 3, 3, 0.5, 0.5)
        cost = solved(nodes, links)
        assert cost is not None
        found, best = found + cost, best + least(nodes, links)
    assert found <= 1.02 * best


def test_least_cost_columns():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, m = rng.integers(1, 5), 6
        cost = rng.normal(size=(n, m))
        got = assignment.least_cost_columns(cost)
        assert len(set(got.tolist())) == n
        assert cost[np.arange(n), got].sum() == pytest.approx(min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(m), int(n))))


def movie(spark, n, frames, images=("a",), seed=3):
    rng = random.Random(seed)
    nodes, links = {}, []
    for image in images:
        places = {(t, o): (rng.uniform(0, 40), rng.uniform(0, 40)) for t in range(frames) for o in range(1, n + 1)}
        for (t, o), (y, x) in places.items():
            nodes[image, t, o] = (y, x, 0.0 if t == 0 else 30.0, 0.0 if t == frames - 1 else 30.0, rng.choice([None, 5.0, 90.0]), None)
            near = sorted((math.hypot(y - b[0], x - b[1]), p) for (u, p), b in places.items() if u == t + 1)[:3]
            links += [(image, t, o, p, 3.0 * d) for d, p in near]
    return spark.createDataFrame([(*k, *v) for k, v in nodes.items()], NODES), spark.createDataFrame(links, LINKS)


def cost_of(df):
    return {r["image_id"]: r["cost"] for r in df.collect()}


def test_blocks_never_cost_more_than_the_start_and_end_near_the_optimum(spark, monkeypatch):
    nodes, links = (x.cache() for x in movie(spark, 12, 6))
    whole = cost_of(assignment.assignment_cost(nodes, *assignment.joint_links(nodes, links)))["a"]
    greedy = cost_of(assignment.assignment_cost(nodes, tracking.link_tracks(links)))["a"]
    monkeypatch.setattr(assignment, "TILE_SIDE", 64.0)
    monkeypatch.setattr(assignment, "TILE_FRAMES", 4)
    chosen, false = assignment.joint_links(nodes, links, passes=3, at_once=40)
    assert chosen.groupBy("image_id", "t", "src").count().where("count > 1").isEmpty() and chosen.groupBy("image_id", "t", "dst").count().where("count > 1").isEmpty()
    parts = cost_of(assignment.assignment_cost(nodes, chosen, false))["a"]
    print(f"joint {whole:.1f}, in blocks {parts:.1f}, greedy {greedy:.1f}")
    assert whole <= parts + 1e-6 and parts <= greedy + 1e-6 and whole < greedy


def test_images_are_tracked_apart_and_empty_ones_not_at_all(spark):
    nodes, links = movie(spark, 5, 3, ("a|1", "b"))
    chosen, false = assignment.joint_links(nodes, links)
    both = cost_of(assignment.assignment_cost(nodes, chosen, false))
    for image in both:
        alone = nodes.where(nodes.image_id == image), links.where(links.image_id == image)
        assert cost_of(assignment.assignment_cost(alone[0], *assignment.joint_links(*alone)))[image] == pytest.approx(both[image])
    none, nothing = assignment.joint_links(nodes.limit(0), links.limit(0))
    assert none.count() == 0 and nothing.count() == 0


def test_windows_find_what_pixels_in_them_show(spark):
    rng = random.Random(5)
    pixels, objects = [], []
    for t in range(2):
        for o in range(1, 25):
            y, x = rng.randrange(90), rng.randrange(90)
            mine = {(y + rng.randrange(6), x + rng.randrange(9)) for _ in range(rng.randrange(1, 14))}
            pixels += [("a", t, 0, yy, xx, 0, o) for yy, xx in mine]
            objects.append(("a", t, o, float(np.mean([p[0] for p in mine])), float(np.mean([p[1] for p in mine])), len(mine)))
    labels = spark.createDataFrame(pixels, "image_id string, t int, z int, y int, x int, c int, v long")
    frame = spark.createDataFrame(objects, "image_id string, t int, object_id long, cy double, cx double, count long")
    got = {(r["t"], r["src"], r["dst"], r["rank"]) for r in tracking.window_links(frame, labels, 30).collect()}
    want = set()
    for _, t, o, cy, cx, _ in objects:
        lo = round(cy) - 15, round(cx) - 15
        seen = {p[6] for p in pixels if p[1] == t + 1 and 0 <= p[3] - lo[0] < 30 and 0 <= p[4] - lo[1] < 30}
        near = sorted((math.hypot(cy - y, cx - x), q) for _, u, q, y, x, n in objects if u == t + 1 and q in seen and n >= 4)[:3]
        want |= {(t, o, q, k + 1) for k, (_, q) in enumerate(near)}
    assert got == want


def test_annotations_name_births_deaths_divisions_and_misdetections(spark):
    objects = spark.createDataFrame([("a", t, o) for t in range(4) for o in (1, 2)], "image_id string, t int, object_id long")
    chosen = spark.createDataFrame([("a", 0, 1, 1, 1.0), ("a", 1, 1, 1, 1.0), ("a", 2, 2, 2, 1.0)], LINKS)
    second = spark.createDataFrame([("a", 1, 1, 2, 1.0)], LINKS)
    kept = objects.where("not (t = 0 and object_id = 2) and not (t = 3 and object_id = 1)")
    tree = tracking.family_tree(kept, chosen, second)
    got = {(r["t"], r["object_id"], r["kind"]) for r in tracking.tracking_annotations(tree, 3, objects).collect()}
    assert got == {(1, 1, "division"), (1, 2, "appearance"), (1, 2, "disappearance"), (2, 1, "disappearance"), (0, 2, "misdetection"), (3, 1, "misdetection")}


def test_manual_divisions_and_mergers(spark):
    given = spark.createDataFrame([("a", 0, 1, 5), ("a", 0, 1, 3), ("a", 0, 2, 4)], "image_id string, t int, object_id long, track_id int")
    born = spark.createDataFrame([("a", 3, 5, 8), ("a", 3, 5, 7), ("a", 2, 4, 9)], "image_id string, t int, track_id int, child int")
    tracks, divisions = tracking.manual_divisions(given, born)
    assert {(r["object_id"], tuple(r["tracks"])) for r in tracks.collect()} == {(1, (3, 5)), (2, (4,))}
    assert [tuple(r) for r in divisions.collect()] == [("a", 3, 5, 7, 8)]
    labels = spark.createDataFrame([("a", 0, 0, 0, x, 0, x + 1) for x in range(3)], "image_id string, t int, z int, y int, x int, c int, v long")
    counts = spark.createDataFrame([("a", 0, 2, 3), ("a", 0, 1, 1)], "image_id string, t int, object_id long, k int")
    assert {(r["x"], r["v"]) for r in tracking.mergers_only(labels, counts).collect()} == {(0, 0), (1, 2), (2, 0)}


def test_sparse_choice_equals_brute_force_and_is_quick():
    def brute(options, used=frozenset()):
        if not options:
            return 0.0
        rest = [c + brute(options[1:], used | {j}) for j, c in options[0].items() if j not in used]
        return min([brute(options[1:], used), *rest])

    for seed in range(200):
        rng = random.Random(seed)
        options = [{j: -rng.choice([rng.random() * 9, float(rng.randint(1, 4))]) for j in range(5) if rng.random() < 0.6} for _ in range(rng.randint(1, 5))]
        got = assignment.least_cost_choice(options)
        taken = [j for j in got if j >= 0]
        assert len(taken) == len(set(taken))
        assert sum(o[j] for o, j in zip(options, got) if j >= 0) == pytest.approx(brute(options))
    rng = random.Random(1)
    nodes = [(k, 60.0, 60.0, None, None, True, True, True) for k in range(1500)]
    links = [(k, min(1499, k + rng.randint(1, 30)), rng.uniform(1, 90)) for k in range(1499) for _ in range(3)]
    began = time.time()
    chosen, _ = assignment.solve(nodes, links)
    assert chosen and time.time() - began < 2.0


def test_whole_images_are_solved_exactly_and_without_tiles(spark, monkeypatch):
    nodes, links = (x.cache() for x in movie(spark, 80, 6))
    with monkeypatch.context() as m:
        for name in ("_tiles", "connected_components"):
            m.setattr(assignment, name, None)
        chosen, false = assignment.joint_links(nodes, links.unionByName(links.withColumn("cost", links.cost + 1)))
        joint = cost_of(assignment.assignment_cost(nodes, chosen, false))["a"]
    rows = [((r["t"], r["object_id"]), r["appear"], r["disappear"], r["false_cost"], r["divide_cost"], True, True, True) for r in nodes.collect()]
    ways = {((r["t"], r["src"]), (r["t"] + 1, r["dst"])): r["cost"] for r in links.collect()}
    best, wrong = assignment.solve(rows, [(*k, c) for k, c in ways.items()])
    taken, given, wrong = {a for a, _, _ in best}, {b for _, b, _ in best}, set(wrong)
    free = sum(n[3] if n[0] in wrong else n[2] * (n[0] not in taken) + n[1] * (n[0] not in given) for n in rows)
    assert joint == pytest.approx(sum(ways[a, b] for a, b, _ in best) + free)


def test_small_and_large_images_are_solved_side_by_side(spark):
    both = [movie(spark, 4, 3, ("s",)), movie(spark, 20, 4, ("w",))]
    nodes, links = (both[0][i].unionByName(both[1][i]).cache() for i in (0, 1))
    whole = cost_of(assignment.assignment_cost(nodes, *assignment.joint_links(nodes, links)))
    parts = cost_of(assignment.assignment_cost(nodes, *assignment.joint_links(nodes, links, passes=1, at_once=30)))
    assert parts["s"] == pytest.approx(whole["s"]) and parts["w"] >= whole["w"] - 1e-6


def test_tracks_of_bundles_are_those_of_contraction(spark, monkeypatch):
    rng = random.Random(4)
    objects = spark.createDataFrame([(i, t, o) for i in ("a", "b|1") for t in range(12) for o in range(1, 5) if rng.random() < 0.9], "image_id string, t int, object_id int")
    links = spark.createDataFrame([(i, t, rng.randint(1, 4), rng.randint(1, 4)) for i in ("a", "b|1", "none") for t in range(11) for _ in range(2)], "image_id string, t int, src int, dst int")
    rows = lambda: sorted(map(tuple, tracking.lineages(objects, links).collect()))
    with monkeypatch.context() as m:
        m.setattr(tracking, "connected_components", None)
        bundled = rows()
    for most in (0, objects.where("image_id = 'a'").count() - 1):
        monkeypatch.setattr(tracking, "TRACKED_AT_ONCE", most)
        assert rows() == bundled
