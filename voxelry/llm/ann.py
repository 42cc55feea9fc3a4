"""Approximate nearest neighbours with balanced posting lists, centroid graphs and distance-ratio pruning.

Equal vectors are one entry of the index with their smallest ids, so that very common vectors cost nothing extra.
Lists hold ``LIST_TARGET`` entries on average at any size of the table: their number grows with it. Lists are made within
cells of about ``CELL_TARGET`` entries, so that neither a task nor the driver ever meets all centroids; a small table is one
cell. Within a cell the centroids are the entries next to the centres of balanced k-means on a bounded sample of the cell.
Every entry goes to the list of its nearest centroid and, near a boundary, to those of further centroids that are almost
as close, also in neighbouring cells. Centroids of a cell are searched by a neighbour graph in memory, best first. A query
reads the lists whose centroids are at most ``SEARCH_RATIO`` times as far as the nearest (or as that list is wide),
at least ``LEAST_LISTS``, and as many more as it takes until they certainly hold more different ids than asked for. Long
lists are read in blocks, by several tasks; within a block distances are exact, and only the best few of a block are
passed on. A list's copies of entries of other lists are stored apart from its own entries: a query whose lists hold more
copies than there are entries in all other lists reads the own entries of every list instead, so that no query reads more
entries than the index has vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.shared import written

NEIGHBOURS = 10
QUERY_EVERY = 100
SAMPLE = 32_768
LIST_TARGET = 128
CELL_TARGET = 131_072
#: Cells a table is parted into at most; cells grow beyond CELL_TARGET from 536 million different vectors on.
MOST_CELLS = 4096
REPLICAS = 4
REPLICA_RATIO = 1.15
SEARCH_RATIO = 1.16
#: Cells are only a way to hold centroids apart; a query looks at the lists of all cells that may hold one within SEARCH_RATIO.
CELL_RATIO = 1.3
LEAST_LISTS = 4
BEAM = 160
DEGREE = 24
BLOCK = 4096
#: Vectors that meet the centroids of a cell in one task.
ASSIGNED = 16_384
LIST_BITS = 24


def usable(vector: Column, dimension: int) -> Column:
    """Vectors that take part: of the common dimension, without null or non-finite components, not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dimension) & good & F.exists(v, lambda x: x != 0)


def common_dimension(vectors: DataFrame, column: str) -> int:
    found = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k-means in which a centroid's pull weakens while its cluster is larger than the average."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    handicap = np.zeros(k)
    for _ in range(rounds):
        nearest, spread = np.empty(len(x), dtype=np.int64), 0.0
        for at in range(0, len(x), 4096):
            d = _squares(x[at : at + 4096], centroids)
            nearest[at : at + 4096] = np.argmin(d + handicap, axis=1)
            spread += float(d.min(axis=1).sum())
        sizes = np.bincount(nearest, minlength=k)
        handicap += 0.2 * spread / len(x) * np.clip(sizes * k / len(x) - 1.0, -1.0, 1.0)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :], 0.0)


@dataclass
class CentroidGraph:
    """Neighbour graph over centroids, searched best first for many vectors at a time."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray, degree: int = DEGREE, seed: int = 0) -> CentroidGraph:
        k = len(centroids)
        near = min(degree, k - 1)
        rows = []
        for at in range(0, k, 1024):
            d = _squares(centroids[at : at + 1024], centroids)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            rows.append(np.argpartition(d, near - 1, axis=1)[:, :near] if near else np.zeros((len(d), 0), dtype=np.int64))
        rng = np.random.default_rng(seed)
        far = np.stack([rng.permutation(k), rng.permutation(k), (np.arange(k) + 1) % k], axis=1)  # keeps the graph connected
        entries = rng.choice(k, min(k, 16), replace=False)
        return CentroidGraph(centroids, np.hstack([np.vstack(rows), far]), entries)

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest centroids found, nearest first, and their distances."""
        beam = min(beam, len(self.centroids))
        ids = np.broadcast_to(self.entries[:beam], (len(x), min(beam, len(self.entries)))).copy()
        dist = self._distances(x, ids)
        done = np.zeros(ids.shape, dtype=bool)
        everyone = np.arange(len(x))
        for _ in range(2 * beam):
            open_ = np.where(done, np.inf, dist)
            at = open_.argmin(axis=1)
            if not np.isfinite(open_[everyone, at]).any():
                break
            done[everyone, at] = True
            new = np.sort(self.neighbours[ids[everyone, at]], axis=1)
            d = self._distances(x, new)
            d[:, 1:][new[:, 1:] == new[:, :-1]] = np.inf
            d[(new[:, :, None] == ids[:, None, :]).any(axis=2)] = np.inf
            ids, dist, done = np.hstack([ids, new]), np.hstack([dist, d]), np.hstack([done, np.isinf(d)])
            if ids.shape[1] > beam:
                best = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, done = (np.take_along_axis(a, best, axis=1) for a in (ids, dist, done))
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)

    def _distances(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        c = self.centroids[ids]
        return np.sqrt(((c - x[:, None, :]) ** 2).sum(axis=2))


def posting_lists(graph: CentroidGraph, x: np.ndarray) -> list[list[int]]:
    """The lists each vector belongs to: the nearest, and near boundaries further ones."""
    ids, dist = graph.search(x, min(BEAM, 4 * REPLICAS))
    out = []
    for row, d in zip(ids, dist):
        mine = [int(row[0])]
        for c, far in zip(row[1:], d[1:]):
            if len(mine) == REPLICAS or not far <= REPLICA_RATIO * d[0]:
                break
            between = np.sqrt(((graph.centroids[mine] - graph.centroids[c]) ** 2).sum(axis=1)).min()
            if between > 0.5 * far:  # else a list that is already chosen serves the same queries
                mine.append(int(c))
        out.append(mine)
    return out


def lists_to_read(graph: CentroidGraph, x: np.ndarray, radius: np.ndarray, certain: np.ndarray, count: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The lists of a cell that a query may read, nearest first, and their distances.

    Those at most SEARCH_RATIO times as far as the nearest (or as that is wide), LEAST_LISTS at least, and further ones
    until more than ``count`` different ids are in them for certain: ``certain`` has the number of ids whose nearest list
    each list is. Where the lists found by the graph do not hold so many, all of the cell follow in order of distance.
    """
    ids, dist = graph.search(x)
    out = []
    for q, row, d in zip(x, ids, dist):
        near = np.isfinite(d)
        row, d = row[near], d[near]
        if certain[row].sum() <= count:
            d = graph._distances(q[None], np.arange(len(graph.centroids))[None])[0]
            row = np.argsort(d, kind="stable")
            d = d[row]
        enough = int(np.searchsorted(np.cumsum(certain[row]), count, side="right")) + 1
        most = max(int((d <= SEARCH_RATIO * max(d[0], radius[row[0]])).sum()), LEAST_LISTS, enough)
        out.append((row[:most], d[:most]))
    return out


def nearest_cells(cells: np.ndarray, certain: np.ndarray, x: np.ndarray, count: int = NEIGHBOURS) -> list[list[int]]:
    """The cells whose lists a query looks at, nearest first: all within CELL_RATIO, and as many as surely hold enough ids."""
    out = []
    for d in np.sqrt(_squares(x, cells)):
        order = np.argsort(d, kind="stable")
        enough = int(np.searchsorted(np.cumsum(certain[order]), count, side="right")) + 1
        out.append(order[: max(int((d <= CELL_RATIO * d[order[0]]).sum()), enough)].tolist())
    return out


def best_of_block(queries: np.ndarray, vectors: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the rows and exact distances of its ``count`` nearest vectors, ties at the end included."""
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        rough = _squares(part, vectors)
        slack = 1e-9 * ((part * part).sum(1) + float((vectors * vectors).sum(1).max()))
        if rough.shape[1] > count:
            edge = np.partition(rough, count - 1, axis=1)[:, count - 1] + slack
        else:
            edge = np.full(len(part), np.inf)
        for i, q in enumerate(part):
            rows = np.nonzero(rough[i] <= edge[i])[0]
            yield at + i, rows, np.sqrt(((vectors[rows] - q) ** 2).sum(axis=1))


def _by_vector(rows: DataFrame, most: int) -> DataFrame:
    """Different vectors with their ``most`` smallest ids. Only that many rows of a vector leave each task."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def _graph(centroids: pd.DataFrame) -> tuple[CentroidGraph, np.ndarray]:
    """The graph of a cell's centroids, and the numbers of their lists."""
    centroids = centroids.sort_values("list")
    k = len(centroids)
    entries = np.random.default_rng(0).choice(k, min(k, 16), replace=False)
    return CentroidGraph(np.stack(centroids["centre"].to_numpy()), np.stack(centroids["near"].to_numpy()).astype(np.int64), entries), centroids["list"].to_numpy()


def _beside(centroids: DataFrame, plan: DataFrame) -> DataFrame:
    """The centroids of each cell once for each of its parts in ``plan(cell, parts)``."""
    return centroids.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(c for c in centroids.columns if c != "cell"))


def _fit_cell(rows: pd.DataFrame, target: int) -> pd.DataFrame:
    """Centroids of one cell, one for each ``target`` entries, from a sample of its vectors: those next to the centres of balanced k-means, and their graph."""
    rows = rows.sort_values("key")
    x = np.stack(rows["v"].to_numpy())
    k = max(1, min(int(rows["n"].iloc[0]) // target, len(x)))
    centres = balanced_centroids(x, k)
    nearest = np.concatenate([_squares(centres[at : at + 256], x).argmin(axis=1) for at in range(0, k, 256)])
    centroids = x[np.unique(nearest)]
    own, d = [], []
    for at in range(0, len(x), 4096):
        squares = _squares(x[at : at + 4096], centroids)
        own.append(squares.argmin(axis=1))
        d.append(np.sqrt(squares.min(axis=1)))
    sizes = np.bincount(np.concatenate(own), minlength=len(centroids))
    radius = np.bincount(np.concatenate(own), np.concatenate(d), minlength=len(centroids)) / np.maximum(sizes, 1)
    graph = CentroidGraph.build(centroids)
    cell = int(rows["cell"].iloc[0])
    return pd.DataFrame({"cell": cell, "list": (cell << LIST_BITS) + np.arange(len(centroids)), "centre": list(centroids), "radius": radius, "near": [r.tolist() for r in graph.neighbours]})


def build_index(vectors: DataFrame, count: int = NEIGHBOURS, cell_target: int = CELL_TARGET) -> tuple[np.ndarray, DataFrame, DataFrame] | None:
    """Centres of the cells, the table of centroids ``cell, list, centre, radius, near, certain`` and the posting lists
    ``ids, v, key, place, list`` of ``vectors(vec_id, v)``; None without vectors. ``place`` is 0 in an entry's nearest list."""
    # one id more than asked for, since a query is not its own neighbour
    entries = written(_by_vector(vectors.select("vec_id", "v"), count + 1).withColumn("key", F.xxhash64("v")), "entries")
    size = entries.count()
    if not size:
        return None
    parts, target = max(1, min(MOST_CELLS, size // cell_target)), LIST_TARGET
    sample = np.stack(entries.orderBy("key", F.col("ids")[0]).limit(min(SAMPLE, size) if parts > 1 else 1).select("v").toPandas()["v"].to_numpy())
    cells = balanced_centroids(sample, min(parts, len(sample)))

    @F.pandas_udf("int")
    def home(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(_in_parts(v, lambda x: _squares(x, cells).argmin(axis=1).tolist()), dtype="int32")

    placed = written(entries.withColumn("cell", home("v")), "placed")
    # one row for each cell, at most MOST_CELLS: small enough to be sent to every task
    sizes = F.broadcast(written(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "sizes"))
    share = F.greatest(F.lit(float(SAMPLE)), 8 * F.col("n") / LIST_TARGET) / F.col("n")
    fitted = placed.join(sizes, "cell").where(F.pmod("key", F.lit(1 << 20)) < share * (1 << 20)).select("cell", "n", "key", "v")
    # a cell of which no row is drawn cannot be: the share is 1 up to SAMPLE rows
    centroids = written(fitted.groupBy("cell").applyInPandas(lambda rows: _fit_cell(rows, target), "cell int, list long, centre array<double>, radius double, near array<int>"), "centroids")
    plan = sizes.select("cell", F.ceil(F.col("n") / ASSIGNED).cast("int").alias("parts"))
    rows = placed.join(plan, "cell").select("cell", F.pmod("key", "parts").cast("int").alias("part"), "ids", "key", "v")
    beside = _beside(centroids, plan)

    def assign(rows: pd.DataFrame, centroids: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"ids": [], "v": [], "key": [], "lists": []})
        graph, lists = _graph(centroids)
        return pd.DataFrame({"ids": rows["ids"], "v": rows["v"], "key": rows["key"], "lists": [lists[m].tolist() for m in _in_parts(rows["v"], lambda x: posting_lists(graph, x))]})

    kind = f"ids {entries.schema['ids'].dataType.simpleString()}, v array<double>, key long, lists array<long>"
    assigned = rows.groupBy("cell", "part").cogroup(beside.groupBy("cell", "part")).applyInPandas(assign, kind)
    postings = written(assigned.select("ids", "v", "key", F.posexplode("lists").alias("place", "list")), "postings")
    # an id may have several vectors and counts where the first of its places is
    homes = postings.where("place = 0").select(F.explode("ids").alias("id"), "list").groupBy("id").agg(F.min("list").alias("list"))
    certain = homes.groupBy("list").agg(F.count(F.lit(1)).alias("certain"))
    return cells, written(centroids.join(certain, "list", "left").na.fill(0, ["certain"]), "lists"), postings


def nearest_neighbours(vectors: DataFrame, queries: Column | None = None, count: int = NEIGHBOURS, cell_target: int = CELL_TARGET) -> DataFrame:
    """For each query row its ``count`` nearest other rows of ``vectors(vec_id, embedding)`` as found by the index.

    Returns ``query_id, rank`` (from 1, nearest first), ``vec_id, score``: the Euclidean distance in double precision on
    the original vectors; ties go to the smaller vec_id. Queries are the rows for which ``queries`` holds (by default
    those whose vec_id is divisible by 100); rows with the query's vec_id are not its neighbours. Vectors that are null,
    zero, hold null or non-finite components or have an uncommon dimension take no part on either side, nor do rows
    without an id. With too few other rows all are returned; an empty table gives no rows. Repeated rows (same id, same
    vector) are one candidate and one query. Further columns are ignored.
    """
    queries = F.col("vec_id") % QUERY_EVERY == 0 if queries is None else queries
    most = count + 1
    dimension = common_dimension(vectors, "embedding")
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), dimension)).select("vec_id", queries.alias("asks"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    index = build_index(rows, count, cell_target)
    if index is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {_kind(vectors)}, rank int, vec_id {_kind(vectors)}, score double")
    cells, centroids, postings = index
    asked = written(rows.where("asks").select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("key")).distinct(), "queries")
    different = asked.groupBy("key").agg(F.first("v").alias("v"))
    postings = postings.withColumn("copy", F.col("place") > 0)
    sizes = written(postings.groupBy("list", "copy").agg(F.count(F.lit(1)).alias("entries")), "entries")
    read = _without_excess(_probes(different, cells, centroids, count), sizes, centroids)
    probes = written(read.join(different, "key").join(sizes.select("list", "copy"), ["list", "copy"]), "probes")
    part = ["list", "copy"]
    blocks = sizes.select(*part, F.ceil(F.col("entries") / BLOCK).cast("int").alias("blocks"))
    shares = probes.groupBy(*part).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("shares"))
    plan = written(blocks.join(shares, part), "plan")
    stored = postings.join(plan, part).select(*part, F.pmod("key", "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "ids", "v")
    asking = probes.join(plan, part).select(*part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod("key", "shares").cast("int").alias("share"), "key", "v")

    def search(queries_: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries_) and len(block):
            keys, ids = queries_["key"].to_numpy(), block["ids"].to_list()
            for q, at, d in best_of_block(np.stack(queries_["v"].to_numpy()), np.stack(block["v"].to_numpy()), most):
                found = sorted((float(x), int(i)) for x, j in zip(d, at) for i in ids[j])[:most]
                out.extend((keys[q], i, x) for x, i in found)
        return pd.DataFrame(out, columns=["key", "vec_id", "score"]).astype({"key": "int64", "vec_id": "int64", "score": "float64"})

    group = [*part, "block", "share"]
    found = asking.groupBy(*group).cogroup(stored.groupBy(*group)).applyInPandas(search, "key long, vec_id long, score double")
    return _ranked(asked.select("query_id", "key"), found, count).select("query_id", "rank", F.col("vec_id").cast(_kind(vectors)).alias("vec_id"), "score")


def _probes(asked: DataFrame, cells: np.ndarray, centroids: DataFrame, count: int) -> DataFrame:
    """The lists ``asked(key, v)`` read: ``key, list``. Candidates come from the cells, the ratio is that to the nearest of all."""
    held = centroids.groupBy("cell").agg(F.sum("certain").alias("n"))
    certain = np.zeros(len(cells), dtype=np.int64)
    for r in held.collect():  # at most MOST_CELLS rows
        certain[r["cell"]] = r["n"]

    @F.pandas_udf("array<int>")
    def looks_at(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(_in_parts(v, lambda x: nearest_cells(cells, certain, x, count)), dtype=object)

    looking = written(asked.select("key", "v", F.explode(looks_at("v")).alias("cell")), "looking")
    # one row for each cell, at most MOST_CELLS: small enough to be sent to every task
    plan = F.broadcast(written(looking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASSIGNED).cast("int").alias("parts")), "parts"))
    rows = looking.join(plan, "cell").select("cell", F.pmod("key", "parts").cast("int").alias("part"), "key", "v")
    beside = _beside(centroids, plan)

    def candidates(rows: pd.DataFrame, centroids: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(centroids):
            graph, lists = _graph(centroids)
            ordered = centroids.sort_values("list")
            radius, held = ordered["radius"].to_numpy(), ordered["certain"].to_numpy()
            for key, (row, d) in zip(rows["key"], _in_parts(rows["v"], lambda x: lists_to_read(graph, x, radius, held, count))):
                out.extend((key, lists[i], x, radius[i], held[i]) for i, x in zip(row, d))
        return pd.DataFrame(out, columns=["key", "list", "dist", "radius", "certain"]).astype({"key": "int64", "list": "int64", "dist": "float64", "radius": "float64", "certain": "int64"})

    found = rows.groupBy("cell", "part").cogroup(beside.groupBy("cell", "part")).applyInPandas(candidates, "key long, list long, dist double, radius double, certain long")
    order = Window.partitionBy("key").orderBy("dist", "list")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    base = F.first(F.greatest("dist", "radius")).over(order)
    found = found.select("key", "list", "dist", base.alias("base"), F.row_number().over(order).alias("n"), F.coalesce(F.sum("certain").over(ahead), F.lit(0)).alias("ahead"))
    read = found.where((F.col("dist") <= SEARCH_RATIO * F.col("base")) | (F.col("n") <= LEAST_LISTS) | (F.col("ahead") <= count))
    return read.select("key", "list")


def _without_excess(read: DataFrame, sizes: DataFrame, centroids: DataFrame) -> DataFrame:
    """``key, list, copy``: the parts of lists that are read, own entries and copies; where the copies would be more than
    the own entries of all other lists, the own entries of all lists."""
    read = written(read, "read")
    of_list = sizes.groupBy("list").agg(*(F.sum(F.when(F.col("copy") == c, F.col("entries")).otherwise(0)).alias(n) for c, n in ((False, "own"), (True, "copies"))))
    total = of_list.agg(F.sum("own")).first()[0]
    whole = written(read.join(of_list, "list").groupBy("key").agg(F.sum("own").alias("own"), F.sum("copies").alias("copies")).where(F.col("copies") >= total - F.col("own")).select("key"), "whole")
    some = read.join(whole, "key", "left_anti").select("key", "list", F.explode(F.array(F.lit(False), F.lit(True))).alias("copy"))
    most = centroids.agg(F.max("cell")).first()[0]
    every = whole.select("key", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("cell")).join(centroids.select("cell", "list"), "cell")
    return some.unionByName(every.select("key", "list", F.lit(False).alias("copy")))


def _ranked(asked: DataFrame, found: DataFrame, count: int) -> DataFrame:
    """The best rows for each different query vector, then for each query row, its own id left out.

    A vector that is stored in several lists may be found several times and counts once.
    """
    order = Window.partitionBy("key").orderBy("score", "vec_id")
    best = found.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= count + 1)
    lists = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    mine = asked.join(lists, "key").select("query_id", F.filter("best", lambda x: x["vec_id"] != F.col("query_id")).alias("best"))
    return mine.select("query_id", F.posexplode(F.slice("best", 1, count)).alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _in_parts(vectors: pd.Series, assign) -> list:
    out: list = []
    for at in range(0, len(vectors), 512):
        out.extend(assign(np.stack(vectors.iloc[at : at + 512].to_numpy())))
    return out


def _kind(vectors: DataFrame) -> str:
    return vectors.schema["vec_id"].dataType.simpleString()


def exact_neighbours(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, count: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
    """Brute force for tests and for measuring recall: for each index in ``queries`` its nearest (distance, id)."""
    out = []
    for q in queries:
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        out.append(sorted((float(x), int(i)) for x, i in zip(d, ids) if i != ids[q])[:count])
    return out
