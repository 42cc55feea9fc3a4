"""Choice of features for training: by information, by trying, and contexts learned from earlier predictions."""

from __future__ import annotations

import math
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.operators.learning import dealt, predict, train
from voxelry.plans.stored import written
from voxelry.sources.tables import COORDINATES

#: Sets of features that are tried side by side: the many short jobs of one fit leave most of a cluster idle.
TRIED_AT_ONCE = 4
#: Training rows of all sets that are tried side by side: a fit keeps its rows, in memory or on disk.
TRIED_ROWS = 16_000_000


def binned(matrix: DataFrame, count: int, bins: int = 16, features: str = "f") -> DataFrame:
    """``label, b ARRAY<INT>``: each feature in ``bins`` equal bins between its extremes; values missing or not finite in bin -1."""
    value = lambda i: F.when(F.isnan(F.get(features, F.lit(i))) | (F.abs(F.get(features, F.lit(i))) == float("inf")), None).otherwise(F.get(features, F.lit(i))).cast("double")
    span = matrix.agg(*(f(value(i)).alias(f"{n}{i}") for i in range(count) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    out = []
    for i in range(count):
        lo, hi = span[f"lo{i}"], span[f"hi{i}"]
        place = F.lit(0) if lo is None or hi <= lo else F.least(F.floor((value(i) - lo) * (bins / (hi - lo))), F.lit(bins - 1)).cast("int")
        out.append(F.coalesce(F.when(value(i).isNotNull(), place), F.lit(-1)))
    return matrix.select("label", F.array(*out).alias("b"))


def _information(counts: dict[tuple, float]) -> float:
    """Mutual information, in nats, of the pairs counted."""
    total = sum(counts.values())
    left: dict = {}
    right: dict = {}
    for (a, b), n in counts.items():
        left[a] = left.get(a, 0) + n
        right[b] = right.get(b, 0) + n
    return sum(n / total * math.log(n * total / (left[a] * right[b])) for (a, b), n in counts.items())


def information_feature_selection(matrix: DataFrame, names: list[str], count: int, bins: int = 16, features: str = "f") -> list[str]:
    """Greedy choice by interaction capping: a feature's information about the label, less what each chosen feature already tells.

    The loss to a chosen feature s is ``max(0, I(f; s) - I(f; s | label))``. Spark counts pairs of bins; only these tables,
    whose size depends on bins and features and not on rows, reach the driver.
    """
    rows = written(binned(matrix, len(names), bins, features), "bins")
    if not names or rows.isEmpty():
        return []
    each = rows.select("label", F.posexplode("b").alias("i", "x"))
    relevance: list[dict] = [{} for _ in names]
    for r in each.groupBy("i", "x", "label").agg(F.count(F.lit(1)).alias("n")).collect():
        relevance[r["i"]][r["x"], r["label"]] = r["n"]
    gain = [_information(c) for c in relevance]
    lost = [0.0] * len(names)
    chosen: list[int] = []
    while len(chosen) < min(count, len(names)):
        best = max((i for i in range(len(names)) if i not in chosen), key=lambda i: (gain[i] - lost[i], -i))
        chosen.append(best)
        if len(chosen) == count:
            break
        tables: list[dict] = [{} for _ in names]
        for r in rows.select("label", F.get("b", F.lit(best)).alias("s"), F.posexplode("b").alias("i", "x")).groupBy("i", "x", "s", "label").agg(F.count(F.lit(1)).alias("n")).collect():
            tables[r["i"]][r["x"], r["s"], r["label"]] = r["n"]
        for i, t in enumerate(tables):
            total, both, by_label = sum(t.values()), {}, {}
            for (x, s, y), n in t.items():
                both[x, s] = both.get((x, s), 0) + n
                by_label.setdefault(y, {})[x, s] = n
            given = sum(sum(c.values()) / total * _information(c) for c in by_label.values())
            lost[i] += max(0.0, _information(both) - given)
    return [names[i] for i in chosen]


def wrapper_feature_selection(matrix: DataFrame, names: list[str], backward: bool = False, penalty: float = 0.07, trees: int = 10, features: str = "f", seed: int = 0) -> list[str]:
    """Greedy search of the set with the best held-out accuracy less ``penalty`` times its share of all features.

    Forward search adds one feature at a time as long as the score rises by more than its standard error; backward search
    removes one at a time as long as the score does not fall. A third of the rows, chosen by the hash of the row, is held
    out for every set alike. Of equal sets the one that differs in the first feature is taken. The answer depends on the
    rows and the seed, not on their partitions.
    """
    held = F.pmod(F.xxhash64("label", "f", F.lit(seed)), F.lit(3)) == 0
    rows = written(matrix.select("label", F.col(features).alias("f")).withColumn("held", held), "matrix")
    sizes = rows.agg(F.count_if("held").alias("held"), F.count_if(~F.col("held")).alias("others"), F.max(F.when(~F.col("held"), F.col("label"))).alias("most")).first()
    size, learned = sizes["held"], sizes["others"]
    # dealt once, by whole rows: a set of features is a projection of what lies there
    known = dealt(rows.where("not held").select("label", F.col("f").alias("features")), learned).persist(StorageLevel.DISK_ONLY)

    def accuracy(kept: list[int]) -> float:
        if not learned or learned < sizes["most"]:
            return -math.inf
        model = train(known.select("label", F.array(*(F.get("features", F.lit(i)) for i in kept)).alias("f")), trees=trees, seed=seed, lies=True)
        if model is None:
            return -math.inf
        part = rows.where("held").select("label", F.array(*(F.get("f", F.lit(i)) for i in kept)).alias("f"))
        scored = predict(part, model, int(model.numClasses) - 1)
        return scored.where(F.array_position("p", F.array_max("p")) == F.col("label")).count() / size

    def cost(kept: list[int]) -> float:
        return penalty * len(kept) / len(names)

    at_once = max(1, min(TRIED_AT_ONCE, TRIED_ROWS // max(learned, 1)))
    try:
        kept = list(range(len(names))) if backward else []
        hit = accuracy(kept) if backward and size else -math.inf
        best = hit - cost(kept)
        while size and ((len(kept) > 1) if backward else (len(kept) < len(names))):
            options = [[k for k in kept if k != i] if backward else [*kept, i] for i in range(len(names)) if backward == (i in kept)]
            with ThreadPool(min(at_once, len(options))) as pool:
                found = pool.map(inheritable_thread_target(rows.sparkSession)(accuracy), options, chunksize=1)
            at = max(range(len(options)), key=lambda i: (found[i], -i))
            top = found[at] - cost(options[at])
            noise = math.sqrt(sum(p * (1 - p) for p in (hit, found[at]) if 0 < p < 1) / size)
            if top < best or not backward and top <= best + noise:
                break
            hit, best, kept = found[at], top, options[at]
    finally:
        known.unpersist()
    return [names[i] for i in sorted(kept)]


def autocontext(images: DataFrame, labels: DataFrame, classes: int, bank: Callable[[DataFrame], DataFrame], stages: int = 2, trees: int = 20) -> DataFrame:
    """Pixel classification in stages: each stage sees the features of the image and of the probabilities of the stage before.

    ``bank`` turns a pixel table into ``COORDINATES, f``, channel by channel. Returns ``image_id, t, z, y, x, c, p``.
    """
    own = written(bank(images).select(*COORDINATES, "f"), "bank")
    place = COORDINATES[:-1]
    rows, scored = own, own
    for stage in range(stages):
        matrix = written(rows.join(labels.where("label > 0").select(*COORDINATES, "label"), COORDINATES).select("label", "f"), "matrix")
        scored = written(predict(rows, train(matrix, trees=trees, seed=stage), classes).select(*COORDINATES, "p"), "stage")
        if stage + 1 == stages:
            break
        context = bank(scored.select(*place, F.posexplode("p").alias("k", "v")).select(*place, F.col("k").alias("c"), "v"))
        wide = context.groupBy(*place).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("c", "f"))), lambda s: s["f"])).alias("more"))
        rows = written(own.join(wide, place).select(*COORDINATES, F.concat("f", "more").alias("f")), "rows")
    return scored
