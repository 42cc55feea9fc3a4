"""Tracking: candidate links between frames, division features, assignment, lineages and track tables.

Objects have ``image_id, t, object_id, cy, cx`` and further features; links go from ``src`` in frame t to ``dst`` in t + 1.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from voxelry.operators.components import NUMBERED_AT_ONCE, connected_components, numbered
from voxelry.operators.filters import _dealt
from voxelry.operators.objects import OBJECT
from voxelry.operators.regions import boundary_pixels, relabel_by_map
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES


def filter_detections(objects: DataFrame, size: tuple[int, int], field: dict[str, tuple[int, int]]) -> DataFrame:
    """Objects whose size is in [low, high) and whose box meets the field of view."""
    kept = objects.where((F.col("count") >= size[0]) & (F.col("count") < size[1]))
    for a, (low, high) in field.items():
        kept = kept.where((F.col(f"max_{a}") > low) & (F.col(f"min_{a}") < high))
    return kept


def clamp_probabilities(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-7)), F.lit(0.99999999))


def candidate_links(objects: DataFrame, nearest: int = 3, most: float = 30.0) -> DataFrame:
    """The nearest objects of the next frame within a distance: ``image_id, t, src, dst, dist, rank``; ties by id.

    Objects meet through a grid whose cells are as wide as the distance: each looks into nine cells.
    """
    cell = lambda a: F.floor(F.col(f"c{a}") / most).cast("int")
    near = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1))))
    src = objects.select("image_id", "t", F.col("object_id").alias("src"), F.col("cy").alias("y1"), F.col("cx").alias("x1"), cell("y").alias("gy0"), cell("x").alias("gx0"), near.alias("d"))
    src = src.select("image_id", (F.col("t") + 1).alias("t1"), "t", "src", "y1", "x1", (F.col("gy0") + F.col("d.dy")).alias("gy"), (F.col("gx0") + F.col("d.dx")).alias("gx"))
    dst = objects.select("image_id", F.col("t").alias("t1"), F.col("object_id").alias("dst"), F.col("cy").alias("y2"), F.col("cx").alias("x2"), cell("y").alias("gy"), cell("x").alias("gx"))
    dist = F.sqrt(F.pow(F.col("y1") - F.col("y2"), F.lit(2)) + F.pow(F.col("x1") - F.col("x2"), F.lit(2)))
    pairs = src.join(dst, ["image_id", "t1", "gy", "gx"]).withColumn("dist", dist).where(F.col("dist") <= most)
    rank = F.row_number().over(Window.partitionBy("image_id", "t", "src").orderBy("dist", "dst"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= nearest).select("image_id", "t", "src", "dst", "dist", "rank")


def window_links(objects: DataFrame, labels: DataFrame, window: int = 50, smallest: int = 4, nearest: int = 3) -> DataFrame:
    """The nearest objects of the next frame that reach into a window around the centre: ``image_id, t, src, dst, dist, rank``.

    The window is ``window`` pixels wide along every axis, around the centre rounded to even; an object counts if one of its
    pixels lies in it and it has ``smallest`` pixels at least. Distances are those of centres, ties go to the smaller id.
    Pixels are joined to runs along x that carry their object's centre; windows and runs meet in a grid of cells twice as wide
    as the window, of which a window touches four at most. What is not among the nearest of its cell is not shuffled.
    """
    half, cell = window // 2, 2 * window
    axes = [a for a in "zyx" if f"c{a}" in objects.columns]
    ahead = objects.where(F.col("count") >= smallest).select("image_id", "t", F.col("object_id").cast("long").alias("dst"), *(F.col(f"c{a}").alias(f"c{a}2") for a in axes))
    row = ["image_id", "t", "z", "y", "c", "dst", *(f"c{a}2" for a in axes)]
    runs = labels.where("v <> 0").select(*COORDINATES, F.col("v").cast("long").alias("dst")).join(ahead, ["image_id", "t", "dst"])
    runs = runs.withColumn("at", F.col("x") - F.dense_rank().over(Window.partitionBy(*row).orderBy("x"))).groupBy(*row, "at").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    cells = F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))
    runs = runs.select("image_id", (F.col("t") - 1).alias("t"), "z", "y", "x0", "x1", "dst", *(f"c{a}2" for a in axes), F.floor(F.col("y") / cell).alias("gy"), F.explode(cells).alias("gx"))
    first = {a: F.bround(F.col(f"c{a}"), 0).cast("int") - half for a in axes}
    corners = lambda a: F.array_distinct(F.array(F.floor(F.col(f"{a}_") / cell), F.floor((F.col(f"{a}_") + 2 * half - 1) / cell)))
    parents = objects.select("image_id", "t", F.col("object_id").cast("long").alias("src"), *(F.col(f"c{a}").alias(f"c{a}1") for a in axes), *(first[a].alias(f"{a}_") for a in axes))
    parents = parents.withColumn("gy", F.explode(corners("y"))).withColumn("gx", F.explode(corners("x")))
    inside = (F.col("x1") >= F.col("x_")) & (F.col("x0") < F.col("x_") + 2 * half)
    for a in axes[:-1]:
        inside &= (F.col(a) >= F.col(f"{a}_")) & (F.col(a) < F.col(f"{a}_") + 2 * half)
    dist = F.sqrt(sum(((F.col(f"c{a}1") - F.col(f"c{a}2")) * (F.col(f"c{a}1") - F.col(f"c{a}2")) for a in axes), F.lit(0.0)))
    pairs = parents.join(runs, ["image_id", "t", "gy", "gx"]).where(inside).select("image_id", "t", "src", "dst", dist.alias("dist"))
    # an object is met once for each of its runs: equal places share a rank
    rank = F.dense_rank().over(Window.partitionBy("image_id", "t", "src").orderBy("dist", "dst"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= nearest).distinct()


def division_features(objects: DataFrame, links: DataFrame, default: float = 9999.0) -> DataFrame:
    """Distances of the three best children, and the ratios and the angle a division would have, for each parent.

    ``children_ratio`` (at most 1) and ``parent_children_ratio`` (parent over the sum of both) compare the means of the two
    nearest, and those ending in ``_count`` their sizes; ``angle`` is the widest, in degrees, between two of the three.
    Null where there are not two children or nothing to divide by.
    """
    features = [c for c in ("mean", "count") if c in objects.columns]
    child = objects.select("image_id", (F.col("t") - 1).alias("t"), F.col("object_id").alias("dst"), F.col("cy").alias("y2"), F.col("cx").alias("x2"), *(F.col(c).cast("double").alias(f"{c}2") for c in features))
    rows = links.join(child, ["image_id", "t", "dst"]).groupBy("image_id", "t", "src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst", "y2", "x2", *(f"{c}2" for c in features)))).alias("k"))
    rows = rows.join(objects.select("image_id", "t", F.col("object_id").alias("src"), "cy", "cx", *features), ["image_id", "t", "src"])
    at = lambda i, f: F.get(F.col("k"), i)[f]
    zero = F.lit(0.0)

    def ratios(c: str) -> list[Column]:
        one, other = at(0, f"{c}2"), at(1, f"{c}2")
        end = "" if c == "mean" else f"_{c}"
        return [F.least(one / F.nullif(other, zero), other / F.nullif(one, zero)).alias(f"children_ratio{end}"), (F.col(c) / F.nullif(one + other, zero)).alias(f"parent_children_ratio{end}")]

    def angle(i: int, j: int) -> Column:
        dot = (at(i, "y2") - F.col("cy")) * (at(j, "y2") - F.col("cy")) + (at(i, "x2") - F.col("cx")) * (at(j, "x2") - F.col("cx"))
        cosine = F.greatest(F.least(dot / F.nullif(at(i, "dist") * at(j, "dist"), zero), F.lit(1.0)), F.lit(-1.0))
        return F.when(at(j, "dist").isNotNull(), F.coalesce(F.degrees(F.acos(cosine)), zero))

    widest = F.greatest(angle(0, 1), angle(0, 2), angle(1, 2))
    return rows.select(
        "image_id", "t", F.col("src").alias("object_id"), *(F.coalesce(at(i, "dist"), F.lit(default)).alias(f"dist_{i}") for i in range(3)), *(r for c in features for r in ratios(c)), widest.alias("angle")
    )


def link_costs(links: DataFrame, weight: float = 10.0, scale: float = 5.0) -> DataFrame:
    """Transition costs ``-weight * ln p`` with p falling exponentially with distance."""
    p = clamp_probabilities(F.exp(-F.col("dist") / scale))
    return links.withColumn("cost", -weight * F.ln(p))


def detection_costs(objects: DataFrame, counts: dict[int, float] | None = None, weight: float = 10.0) -> DataFrame:
    """``image_id, t, object_id, k, cost``: the cost that an object holds k cells, from ``p ARRAY`` or from fixed shares ``counts``."""
    p = F.col("p") if counts is None else F.array(*(F.lit(float(counts.get(k, 0.0))) for k in range(max(counts) + 1)))
    return objects.select(*OBJECT, F.posexplode(p).alias("k", "p")).select(*OBJECT, "k", (-weight * F.ln(clamp_probabilities(F.col("p")))).alias("cost"))


def division_costs(divisions: DataFrame, weight: float = 10.0) -> DataFrame:
    """``image_id, t, object_id, divides, cost`` from probabilities ``p`` of division, for both outcomes."""
    both = F.array(F.struct(F.lit(False).alias("divides"), (1 - F.col("p")).alias("p")), F.struct(F.lit(True).alias("divides"), F.col("p").alias("p")))
    return divisions.select(*OBJECT, F.explode(both).alias("o")).select(*OBJECT, "o.divides", (-weight * F.ln(clamp_probabilities(F.col("o.p")))).alias("cost"))


def border_costs(objects: DataFrame, last_frame: int, shape: dict[str, int], appearance: float = 500.0, disappearance: float = 500.0, border: float = 0.0) -> DataFrame:
    """``appear`` and ``disappear`` for each object: nothing in the first and last frame, less within ``border`` of an edge of the image."""
    margin = F.least(*(F.least(F.col(f"c{a}"), F.lit(float(n - 1)) - F.col(f"c{a}")) for a, n in shape.items()))
    share = F.when(margin >= border, 1.0).otherwise(F.greatest(margin, F.lit(0.0)) / border) if border else F.lit(1.0)
    return objects.select(*OBJECT, F.when(F.col("t") == 0, 0.0).otherwise(appearance * share).alias("appear"), F.when(F.col("t") == last_frame, 0.0).otherwise(disappearance * share).alias("disappear"))


def combined_features(objects: DataFrame, divisions: DataFrame) -> DataFrame:
    """Region and division features of each object in one table; objects without candidates keep null division features."""
    return objects.join(divisions, OBJECT, "left")


#: Links of a frame that are chosen in one task; frames with more are settled in rounds.
LINKS_AT_ONCE = 100_000


def _cheapest_first(table: pa.Table) -> pa.Table:
    """The links of a frame taken in the order of cost, source and target unless either end is taken."""
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("cost", "src", "dst")])
    table = table.take(order)
    sources, targets, taken = set(), set(), []
    for i, (src, dst) in enumerate(zip(table["src"].to_pylist(), table["dst"].to_pylist())):
        if src not in sources and dst not in targets:
            sources.add(src)
            targets.add(dst)
            taken.append(i)
    return table.take(pa.array(taken, pa.int64()))


def link_tracks(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """One-to-one assignment between frames: the cheapest links first, ties by ids. Links without ends or cost are ignored.

    Frames of up to ``LINKS_AT_ONCE`` links are settled one by one; larger ones in rounds of mutually cheapest links, which
    come to the same.
    """
    frame = ["image_id", "t"]
    left = links.select(*frame, "src", "dst", "cost")
    left = written(left.dropna(), "links")
    sizes = left.groupBy(*frame).agg(F.count(F.lit(1)).alias("n"))
    small = left.join(sizes.where(F.col("n") <= LINKS_AT_ONCE).select(*frame), frame, "left_semi")
    chosen = _dealt(small, frame).groupBy(*frame).applyInArrow(_cheapest_first, left.schema)
    large = sizes.where(F.col("n") > LINKS_AT_ONCE).select(*frame)
    if large.isEmpty():
        return chosen
    left = written(left.join(large, frame, "left_semi"), "links")
    for _ in range(max_rounds):
        by = F.struct("cost", "src", "dst")
        out = left.groupBy(*frame, "src").agg(F.min(by).alias("b")).select(*frame, "b.src", "b.dst", "b.cost")
        back = left.groupBy(*frame, "dst").agg(F.min(by).alias("b")).select(*frame, "b.src", "b.dst", "b.cost")
        mutual = written(out.join(back, [*frame, "src", "dst", "cost"]), "mutual")
        if mutual.isEmpty():
            return chosen
        chosen = chosen.unionByName(mutual)
        left = left.join(mutual.select(*frame, "src"), [*frame, "src"], "left_anti").join(mutual.select(*frame, "dst"), [*frame, "dst"], "left_anti")
        left = written(left, "links")
    raise RuntimeError(f"not settled after {max_rounds} rounds")


#: Objects that images are bundled to, so that not each small image is a group of its own.
BUNDLE = 400
#: Objects of an image whose tracks are found in one task.
TRACKED_AT_ONCE = 200_000


def bundled(objects: DataFrame, most: int) -> tuple[int, DataFrame | None]:
    """The number of bundles for images of up to ``most`` objects, and the larger images, if any."""
    sizes = objects.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    all_ = sizes.agg(F.sum(F.when(F.col("n") <= most, F.col("n"))).alias("small"), F.max("n").alias("most")).first()
    large = written(sizes.where(F.col("n") > most).select("image_id"), "large") if (all_["most"] or 0) > most else None
    return max(1, -(-(all_["small"] or 0) // BUNDLE)), large


def by_bundle(rows: DataFrame, bundles: int) -> GroupedData:
    """Rows grouped with all others of their image, over all shuffle partitions."""
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("image_id"), F.lit(bundles)))
    return _dealt(rows, ["bundle"]).groupBy("bundle")


def lineages(objects: DataFrame, links: DataFrame) -> DataFrame:
    """``image_id, t, object_id, track_id``: objects joined by chosen links form a track, named after its first object.

    Images of up to ``TRACKED_AT_ONCE`` objects are settled in bundles, larger ones by contraction of their links.
    """
    own = written(objects.select(*OBJECT), "objects")
    links = links.select("image_id", "t", "src", "dst")
    bundles, large = bundled(own, TRACKED_AT_ONCE)
    if large is None:
        return _tracked(own, links, bundles)
    small, rest = ([x.join(large, "image_id", how) for x in (own, links)] for how in ("left_anti", "left_semi"))
    return _tracked(*small, bundles).unionByName(_contracted_tracks(*rest))


def _tracked(objects: DataFrame, links: DataFrame, bundles: int) -> DataFrame:
    def tracks(mine: pa.Table, ways: pa.Table) -> pa.Table:
        places = list(zip(*(mine[c].to_pylist() for c in OBJECT)))
        links = [((i, t, a), (i, t + 1, b)) for i, t, a, b in zip(*(ways[c].to_pylist() for c in ("image_id", "t", "src", "dst"))) if a is not None and b is not None]
        above = {p: p for p in places} | {p: p for ends in links for p in ends}

        def root(p: tuple) -> tuple:
            while above[p] != p:
                above[p] = above[above[p]]
                p = above[p]
            return p

        for a, b in links:
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
        roots = [root(p) for p in places]
        number, seen = {}, {}
        for r in sorted(set(roots)):
            number[r] = seen[r[0]] = seen.get(r[0], 0) + 1
        return mine.select(OBJECT).append_column("track_id", pa.array([number[r] for r in roots], pa.int64()))

    types = {f.name: f.dataType.simpleString() for f in objects.schema}
    both = by_bundle(objects, bundles).cogroup(by_bundle(links, bundles))
    return both.applyInArrow(tracks, ", ".join(f"{c} {types[c]}" for c in OBJECT) + ", track_id long")


def _contracted_tracks(objects: DataFrame, links: DataFrame) -> DataFrame:
    name = lambda t, o: F.concat_ws("|", "image_id", F.lpad(t.cast("string"), 10, "0"), F.lpad(o.cast("string"), 20, "0"))
    edges = links.select(name(F.col("t"), F.col("src")).alias("src"), name(F.col("t") + 1, F.col("dst")).alias("dst"))
    tracks = connected_components(edges)
    named = objects.select(*OBJECT).withColumn("node", name(F.col("t"), F.col("object_id"))).join(tracks, "node", "left").withColumn("root", F.coalesce("component", "node"))
    roots = named.select("image_id", "root").distinct()
    # names end with the frame and the object of a track's start
    place = F.split("root", r"\|")
    start = F.concat(F.element_at(place, -2), F.lpad(F.floor(F.element_at(place, -1).cast("long") / NUMBERED_AT_ONCE).cast("string"), 20, "0"))
    roots = numbered(roots, ["image_id"], "root", start).withColumnRenamed("number", "track_id")
    return named.join(roots, ["image_id", "root"]).select(*OBJECT, "track_id")


def tracking_table(objects: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row for each object: frame, object and track, -1 where it has none, with its size and centre."""
    return objects.join(tracks, OBJECT, "left").select(F.col("t").alias("frame"), "image_id", F.col("object_id").alias("labelimageId"), F.coalesce("track_id", F.lit(-1)).alias("trackId"), "count", "cy", "cx")


def full_tracking_table(objects: DataFrame, tree: DataFrame, mergers: DataFrame | None = None) -> DataFrame:
    """One row for each object in the order of frames and ids: frame, object, track, lineage, parent track and merger, then its features.

    Objects without a track have -1 as track and lineage and 0 as parent; ``mergers(image_id, t, object_id, merger_id)``
    names the merged object an object was split from, 0 otherwise.
    """
    joined = objects.join(tree, OBJECT, "left")
    joined = joined.join(mergers, OBJECT, "left") if mergers is not None else joined.withColumn("merger_id", F.lit(0))
    rest = [c for c in objects.columns if c not in OBJECT]
    table = joined.select(
        "image_id", F.col("t").alias("frame"), F.col("object_id").alias("labelimageId"), F.coalesce("track_id", F.lit(-1)).alias("trackId"), F.coalesce("lineage_id", F.lit(-1)).alias("lineageId"),
        F.coalesce("parent_track_id", F.lit(0)).alias("parentTrackId"), F.coalesce("merger_id", F.lit(0)).alias("mergerLabelId"), *rest,
    )
    return table.orderBy("image_id", "frame", "labelimageId")


def track_lines(tree: DataFrame) -> DataFrame:
    """``value``: for each track its id, first and last frame and parent (0 without), as lines of text for ``write.text``."""
    spans = tree.groupBy("image_id", "track_id").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("parent_track_id").alias("parent"))
    return spans.select("image_id", "track_id", F.concat_ws(" ", "track_id", "first", "last", F.coalesce("parent", F.lit(0))).alias("value"))


def track_spans(tracks: DataFrame) -> DataFrame:
    """First and last frame and length of each track."""
    return tracks.groupBy("image_id", "track_id").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("objects"))


def tracking_flat(assignments: DataFrame, most: int) -> DataFrame:
    """Columns track1 to trackN for each object from ``(image_id, t, object_id, track_id)``, ascending, padded with 0."""
    found = assignments.groupBy(*OBJECT).agg(F.array_sort(F.collect_set("track_id")).alias("k"))
    return found.select(*OBJECT, *(F.coalesce(F.get("k", F.lit(i)), F.lit(0)).alias(f"track{i + 1}") for i in range(most)))


def merge_refreshed_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Features of ``old`` overwritten by those of ``new`` for the same objects; new objects are added."""
    columns = [c for c in old.columns if c not in OBJECT]
    joined = old.alias("o").join(new.alias("n"), OBJECT, "full_outer")
    return joined.select(*OBJECT, *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns))


def annotations(tracks: DataFrame, last_frame: int) -> DataFrame:
    """Appearances and disappearances of tracks that do not span all frames."""
    spans = track_spans(tracks)
    return spans.select("image_id", "track_id", "first", "last", (F.col("first") > 0).alias("appears"), (F.col("last") < last_frame).alias("disappears"))


def tracking_annotations(tree: DataFrame, last_frame: int, detections: DataFrame | None = None) -> DataFrame:
    """Training annotations of tracks: ``image_id, t, object_id, track_id, kind`` with kind ``appearance``, ``disappearance``, ``division`` or ``misdetection``.

    ``tree`` is as by family_tree. A track appears at its first object unless it starts in frame 0 or from a division, and
    disappears at its last unless that lies in ``last_frame`` or divides; the last object of a track with children is a
    division. Objects of ``detections(image_id, t, object_id)`` without a track are misdetections (track -1).
    """
    ends = tree.groupBy("image_id", "track_id").agg(F.min(F.struct("t", "object_id")).alias("first"), F.max(F.struct("t", "object_id")).alias("last"), F.max("parent_track_id").alias("parent"))
    mothers = tree.where("parent_track_id > 0").select("image_id", F.col("parent_track_id").alias("track_id"), F.lit(True).alias("divides")).distinct()
    ends = ends.join(mothers, ["image_id", "track_id"], "left")
    divides = F.coalesce("divides", F.lit(False))
    marks = F.array_compact(F.array(
        F.when((F.col("first.t") > 0) & (F.col("parent") == 0), F.struct(F.col("first").alias("at"), F.lit("appearance").alias("kind"))),
        F.when((F.col("last.t") < last_frame) & ~divides, F.struct(F.col("last").alias("at"), F.lit("disappearance").alias("kind"))),
        F.when(divides, F.struct(F.col("last").alias("at"), F.lit("division").alias("kind"))),
    ))
    found = ends.select("image_id", F.explode(marks).alias("m"), "track_id").select("image_id", "m.at.t", "m.at.object_id", "track_id", "m.kind")
    if detections is None:
        return found
    wrong = detections.select(*OBJECT).distinct().join(tree.select(*OBJECT), OBJECT, "left_anti")
    return found.unionByName(wrong.select(*OBJECT, F.lit(-1).cast(tree.schema["track_id"].dataType).alias("track_id"), F.lit("misdetection").alias("kind")))


def mergers_only(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """The label image with only the objects of ``counts(image_id, t, object_id, k)`` that hold more than one cell; the rest is 0."""
    several = counts.where("k > 1").select("image_id", "t", F.col("object_id").alias("v"), F.lit(True).alias("_kept")).distinct()
    return labels.join(several, ["image_id", "t", "v"], "left").select(*COORDINATES, F.when(F.col("_kept"), F.col("v")).otherwise(F.lit(0).cast(labels.schema["v"].dataType)).alias("v"))


def division_links(links: DataFrame, chosen: DataFrame, divisions: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Second children: objects of ``divisions(image_id, t, object_id)`` with a chosen link take one more target that no link
    has taken, by the same rounds of mutually cheapest links."""
    dividing = divisions.select("image_id", "t", F.col("object_id").alias("src")).distinct().join(chosen.select("image_id", "t", "src"), ["image_id", "t", "src"], "left_semi")
    free = links.join(dividing, ["image_id", "t", "src"], "left_semi").join(chosen.select("image_id", "t", "dst"), ["image_id", "t", "dst"], "left_anti")
    return link_tracks(free, max_rounds)


def family_tree(objects: DataFrame, chosen: DataFrame, second: DataFrame) -> DataFrame:
    """``image_id, t, object_id, track_id, lineage_id, parent_track_id``: a division ends a track and starts two with it as parent.

    A lineage is all that descends from one first object. Tracks without a parent have parent 0.
    """
    place = ["image_id", "t", "src"]
    both = chosen.select(*place, "dst").unionByName(second.select(*place, "dst"))
    tracks = written(lineages(objects, chosen.join(second.select(*place), place, "left_anti")), "tracks")
    families = lineages(objects, both).withColumnRenamed("track_id", "lineage_id")
    mothers = tracks.select("image_id", "t", F.col("object_id").alias("src"), F.col("track_id").alias("parent_track_id"))
    born = both.join(second.select(*place), place, "left_semi").join(mothers, place).select("image_id", (F.col("t") + 1).alias("t"), F.col("dst").alias("object_id"), "parent_track_id")
    parents = born.join(tracks, OBJECT).select("image_id", "track_id", "parent_track_id")
    return tracks.join(families, OBJECT).join(parents, ["image_id", "track_id"], "left").select(*OBJECT, "track_id", "lineage_id", F.coalesce("parent_track_id", F.lit(0)).alias("parent_track_id"))


def label_by(labels: DataFrame, assigned: DataFrame, column: str) -> DataFrame:
    """The label image with each object's track, lineage or other number; objects without one become 0."""
    return relabel_by_map(labels, assigned.select("image_id", "t", F.col("object_id").alias("old"), F.col(column).alias("new")))


def manual_tracking(labels: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The track image of ``assignments(image_id, t, object_id, track_id)`` and the image of objects without a track (1, else 0).

    An object of several tracks shows the smallest.
    """
    first = assignments.groupBy(*OBJECT).agg(F.min("track_id").alias("track_id"))
    image = label_by(labels, first, "track_id")
    return image, image.withColumn("v", (F.col("v") == 0).cast("int"))


def manual_divisions(assignments: DataFrame, divisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What users tracked by hand, as tables: the tracks of each object, ``image_id, t, object_id, tracks ARRAY``, and the divisions,
    ``image_id, t, track_id, child_1, child_2`` of ``divisions(image_id, t, track_id, child)``; only those with two children."""
    tracks = assignments.groupBy(*OBJECT).agg(F.array_sort(F.collect_set("track_id")).alias("tracks"))
    children = divisions.groupBy("image_id", "t", "track_id").agg(F.array_sort(F.collect_set("child")).alias("k")).where(F.size("k") == 2)
    return tracks, children.select("image_id", "t", "track_id", F.get("k", F.lit(0)).alias("child_1"), F.get("k", F.lit(1)).alias("child_2"))


def learn_link_weights(links: DataFrame, annotated: DataFrame, columns: list[str]) -> dict[str, float]:
    """Weights of the features of links, by logistic regression of ``annotated(image_id, t, src, dst)`` against the other links of the same objects.

    Returns the coefficient of each column and, as ``""``, the intercept; all 0 where only one class is known.
    """
    key = ["image_id", "t", "src"]
    known = links.join(annotated.select(*key).distinct(), key, "left_semi").join(annotated.select(*key, "dst", F.lit(1.0).alias("label")).distinct(), [*key, "dst"], "left").fillna({"label": 0.0})
    known = written(known.select("label", *columns), "known")  # it is read once for the classes and again by each step of training
    rows = known.select("label", array_to_vector(F.array(*(F.col(c).cast("double") for c in columns))).alias("features"))
    if rows.select("label").distinct().count() < 2:
        return {c: 0.0 for c in ["", *columns]}
    model = LogisticRegression(regParam=1e-3).fit(rows)
    return {"": float(model.intercept), **{c: float(w) for c, w in zip(columns, model.coefficients)}}


def spots_and_links(objects: DataFrame, tree: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables for track editors: spots with their features and track, links with the track of their source, and tracks with their span and parent."""
    spots = objects.join(tree, OBJECT)
    tied = links.join(tree.select("image_id", "t", F.col("object_id").alias("src"), "track_id"), ["image_id", "t", "src"]).select("image_id", "t", "src", "dst", "track_id")
    spans = tree.groupBy("image_id", "track_id").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("parent_track_id").alias("parent_track_id"))
    return spots, tied, spans


def frame_statistics(objects: DataFrame) -> DataFrame:
    """For each frame: objects, mean and spread of their sizes, all their pixels, and the mean of their intensities."""
    return objects.groupBy("image_id", "t").agg(
        F.count(F.lit(1)).alias("objects"), F.avg("count").alias("mean_size"), F.stddev_pop("count").alias("size_spread"), F.sum("count").alias("pixels"), F.avg("mean").alias("mean_intensity")
    )


def outline_records(labels: DataFrame) -> DataFrame:
    """The outline of each object, one row for each boundary pixel in its turn: ``image_id, t, object_id, position, y, x``.

    Pixels are ordered by angle around the centre of the object's pixels (from the positive x axis towards positive y),
    then by distance, y and x. For objects that are star-shaped around their centre this is the way along the outline.
    """
    centres = labels.where("v <> 0").groupBy("image_id", "t", F.col("v").alias("object_id")).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    edge = boundary_pixels(labels.where("v <> 0")).select("image_id", "t", F.col("v").alias("object_id"), "y", "x")
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    turn = Window.partitionBy("image_id", "t", "object_id").orderBy(F.round(F.atan2(dy, dx), 6), F.round(dy * dy + dx * dx, 6), "y", "x")
    return edge.join(centres, ["image_id", "t", "object_id"]).select("image_id", "t", "object_id", (F.row_number().over(turn) - 1).alias("position"), "y", "x")
