"""Operator 3: nearest neighbours by balanced posting lists.

Fit. Centroids come from balanced k-means on at most ``sample`` vectors (smallest key hashes): an
assignment pays for the size its cluster has already. A neighbour graph over the centroids is kept
in memory; its size is bounded by ``MOST_LISTS``.

Index. Every vector walks the graph and goes to its nearest centroid's list, and, when it lies near
a boundary, also to up to ``COPIES - 1`` more: those whose distance is within ``REPLICATE`` times
the nearest, unless a list it already has is nearer to that centroid than the vector is.

Search. A query walks the graph with a wide beam and probes every list whose centroid is within
``PROBE`` times the distance of the nearest, and further lists in order of distance until the probed
ones hold ``CANDIDATES * k`` entries: a query that lies on the centroid of a tiny list would else see
that list alone. Queries that still get fewer than ``k`` rows are compared with every vector. Lists are cut into blocks of bounded size, so a list
that holds a third of all vectors spreads over many tasks; each task compares its block with the
queries that probe the list, and only each query's best ``k`` of a block are shuffled on.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
vectors of another length than the most frequent in the sample, nor rows without a key. Repeated
keys are one candidate per distinct vector; a query's own key never comes out. Ties go to the
smaller key. An empty table, or one without queries, gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.files import scan_partitions
from monthloom.llm.vectors import pair_cosines, units, usable
from monthloom.shipping import ship_package
from monthloom.staging import stage

SAMPLE = 20_000
LIST_SIZE = 256
MOST_LISTS = 16_384
COPIES = 2
REPLICATE = 1.05
PROBE = 1.30
CANDIDATES = 32
BEAM = 512
DEGREE = 16
BLOCK = 2_048
QUERY_BLOCK = 1_024


def distances(cosines: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from their cosines."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10, weight: float = 0.02,
                       seed: int = 11) -> np.ndarray:
    """Spherical k-means in which a cluster's price rises with its share of the sample."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centre = x[rng.choice(len(x), k, replace=False)]
    size = np.full(k, len(x) / k)
    for _ in range(rounds):
        owner = np.empty(len(x), np.int64)
        for at in range(0, len(x), 2048):
            part = x[at: at + 2048]
            owner[at: at + 2048] = (part @ centre.T - weight * size * k / len(x)).argmax(axis=1)
        size = 0.5 * size + 0.5 * np.bincount(owner, minlength=k)
        order = np.argsort(owner, kind="stable")
        got, first = np.unique(owner[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        good = norm[:, 0] > 1e-9
        centre[got[good]] = sums[good] / norm[good]
    return centre


@dataclass
class Graph:
    """Centroids (unit vectors) and for each its nearest others plus a few far links."""

    centre: np.ndarray
    links: np.ndarray
    entry: np.ndarray

    @staticmethod
    def over(centre: np.ndarray, degree: int = DEGREE, seed: int = 5) -> Graph:
        k = len(centre)
        rng = np.random.default_rng(seed)
        near = min(degree, k - 1)
        links = np.empty((k, near + min(4, k)), np.int32)
        for at in range(0, k, 1024):
            cos = centre[at: at + 1024] @ centre.T
            rows = np.arange(len(cos))
            cos[rows, rows + at] = -2
            if near:
                links[at: at + 1024, :near] = np.argpartition(-cos, near - 1, axis=1)[:, :near]
        links[:, near:] = rng.integers(0, k, (k, min(4, k)))
        return Graph(centre, links, rng.choice(k, min(8, k), replace=False))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk of all rows at once: centroid numbers and cosines, nearest first."""
        n, k = len(x), len(self.centre)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        rows = np.arange(n)[:, None]
        ids = np.broadcast_to(self.entry, (n, len(self.entry))).copy()
        cos = x @ self.centre[self.entry].T
        seen[rows, ids] = True
        expanded = np.zeros_like(ids, bool)
        while True:
            waiting = np.where(expanded, -np.inf, cos)
            step = min(4, waiting.shape[1])
            pick = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
            live = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            if not live.any():
                break
            expanded[rows, pick] = True
            new = self.links[ids[rows, pick]].reshape(n, -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.links.shape[1], axis=1)
            seen[rows, np.where(fresh, new, ids[:, :1])] = True
            new_cos = np.where(fresh, np.einsum("nd,nmd->nm", x, self.centre[new]), -np.inf)
            # The same centroid may be met twice in one step; all but one drop out.
            order = np.argsort(new, axis=1, kind="stable")
            twice = np.zeros_like(fresh)
            ordered = np.take_along_axis(new, order, axis=1)
            twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
            again = np.zeros_like(fresh)
            np.put_along_axis(again, order, twice, axis=1)
            new_cos[again] = -np.inf
            ids = np.concatenate([ids, new], axis=1)
            cos = np.concatenate([cos, new_cos], axis=1)
            expanded = np.concatenate([expanded, ~np.isfinite(new_cos)], axis=1)
            if ids.shape[1] > beam:
                best = np.argpartition(-cos, beam - 1, axis=1)[:, :beam]
                ids, cos = ids[rows, best], cos[rows, best]
                expanded = expanded[rows, best]
        order = np.argsort(-cos, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(cos, order, axis=1)

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and lists of vectors: the nearest, and more for boundary vectors."""
        ids, cos = self.search(x, 4 * COPIES)
        ids, dist = ids[:, : 4 * COPIES], distances(cos[:, : 4 * COPIES])
        own = np.full((len(x), COPIES), -1)
        own[:, 0] = ids[:, 0]
        count = np.ones(len(x), np.int64)
        for j in range(1, ids.shape[1]):
            good = (dist[:, j] <= REPLICATE * dist[:, 0]) & (count < COPIES)
            for c in range(COPIES):
                between = distances((self.centre[ids[:, j]] * self.centre[own[:, c]]).sum(axis=1))
                good &= (own[:, c] < 0) | (between > dist[:, j])
            at = np.flatnonzero(good)
            own[at, count[at]] = ids[at, j]
            count[at] += 1
        rows, slot = np.nonzero(own >= 0)
        return rows, own[rows, slot]

    def probes_of(self, x: np.ndarray, held: np.ndarray, enough: int, beam: int = BEAM
                  ) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and lists to probe; ``held`` has the entries of every list."""
        ids, cos = self.search(x, beam)
        dist = distances(cos)
        size = held[ids]
        before = np.cumsum(size, axis=1) - size
        rows, slot = np.nonzero(((dist <= PROBE * dist[:, :1]) | (before < enough))
                                & np.isfinite(cos))
        return rows, ids[rows, slot]


# --- Spark -------------------------------------------------------------------------------------

def _matrix(column: pd.Series) -> np.ndarray:
    return units(np.vstack(column.to_numpy()).astype(np.float64))


def _place(table: DataFrame, graph: Graph, held: np.ndarray | None = None,
           enough: int = 0) -> DataFrame:
    """Rows of ``key, vector`` once per list that holds them, or that they probe where ``held``
    has the entries of every list."""
    schema = pa.schema([("list", pa.int32()), ("key", pa.int64()),
                        ("vector", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = units(np.vstack([np.asarray(v, np.float64)
                                     for v in part.column(1).to_pylist()]))
                rows, lists = (graph.lists_of(x) if held is None
                               else graph.probes_of(x, held, enough))
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), taken.column(0), taken.column(1)],
                    schema=schema)

    return table.mapInArrow(run, "list int, key long, vector array<double>")


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
        sample: int = SAMPLE, list_size: int = LIST_SIZE) -> tuple[Graph, int] | None:
    """Graph over the centroids and the length of vectors; None where no vector is usable."""
    good = vectors.filter(usable(vector) & F.col(key).isNotNull())
    total = good.count()
    if not total:
        return None
    rows = (good.select(key, F.col(vector).cast("array<double>").alias("v"))
            .orderBy(F.xxhash64(F.col(key), F.lit("lists")), key).limit(sample).collect())
    length = pd.Series([len(r.v) for r in rows]).mode()[0]
    x = units(np.array([r.v for r in rows if len(r.v) == length], np.float64))
    lists = max(1, min(total // list_size, len(x) // 8, MOST_LISTS))
    return Graph.over(balanced_centroids(x, lists)), int(length)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id",
            vector: str = "embedding", sample: int = SAMPLE,
            list_size: int = LIST_SIZE) -> DataFrame:
    """The ``k`` nearest found of every query row: ``query_id, rank, vec_id, score``."""
    spark = vectors.sparkSession
    ship_package(spark)
    fitted = fit(vectors, key, vector, sample, list_size)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph, length = fitted
    good = vectors.filter(usable(vector) & F.col(key).isNotNull()
                          & (F.size(vector) == length)).select(
        F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"),
        is_query.alias("asks"))
    tasks = 2 * spark.sparkContext.defaultParallelism
    spread = good.repartition(max(tasks, scan_partitions(vectors)), "key")
    posted = stage(_place(spread.select("key", "vector"), graph), "ann-postings")
    held = np.zeros(len(graph.centre), np.int64)
    for r in posted.groupBy("list").count().collect():  # at most MOST_LISTS rows
        held[r["list"]] = r["count"]
    asking = spread.filter("asks").select("key", "vector")
    # Boundary copies and the query itself are entries, too.
    probes = stage(_place(asking, graph, held, CANDIDATES * COPIES * k + 1), "ann-probes")
    best = stage(_best(posted, probes, k), "ann-best")
    full = best.filter(F.size("best") >= k)
    short = stage(asking.join(full, asking["key"] == full["query_id"], "left_anti"), "ann-short")
    if not short.isEmpty():
        whole = [t.select(F.lit(0).alias("list"), "key", "vector") for t in (spread, short)]
        best = full.unionByName(_best(*whole, k))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id",
        (-F.col("b.far")).alias("score"))


def _best(posted: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """The ``k`` best entries of the lists that every query probes: ``query_id, best``."""
    # One row per list: how many blocks its vectors and the queries that probe it fill.
    blocks = stage(
        posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        .join(probes.groupBy("list").agg(
            F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("asked")), "list"), "ann-blocks")

    def dealt(table: DataFrame, own: str, other: str) -> DataFrame:
        return table.join(blocks, "list").select(
            "list", F.pmod(F.xxhash64("key", F.lit(own)), F.col(own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "key", "vector")

    def compare(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v, q = _matrix(held["vector"]), _matrix(asked["vector"])
        v_key, q_key = held["key"].to_numpy(), asked["key"].to_numpy()
        cos = q @ v.T
        cos[q_key[:, None] == v_key[None, :]] = -np.inf
        n = min(k, len(v))
        least = -np.partition(-cos, n - 1, axis=1)[:, n - 1]
        qi, vi = np.nonzero((cos >= least[:, None] - 1e-9) & np.isfinite(cos))
        score = pair_cosines(q[qi], v[vi])
        order = np.lexsort((v_key[vi], -score, qi))
        qi, vi, score = qi[order], vi[order], score[order]
        first = np.searchsorted(qi, np.arange(len(q)))
        top = np.arange(len(qi)) - first[qi] < n
        return pd.DataFrame({"query_id": q_key[qi[top]], "vec_id": v_key[vi[top]],
                             "score": score[top]})

    keys = ["list", "blocks", "asked"]
    found = (dealt(posted, "blocks", "asked").groupBy(*keys)
             .cogroup(dealt(probes, "asked", "blocks").groupBy(*keys))
             .applyInPandas(compare, "query_id long, vec_id long, score double"))
    # At most lists probed x k rows of a query, each vector once however many lists hold it.
    return found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(
        F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
