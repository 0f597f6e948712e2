"""Operator 2: near-duplicate vectors by sorted projection passes.

Each pass hashes every vector with its own random hyperplanes, orders the vectors of a label
lexicographically by the concatenated bits, and compares each with its neighbours in a bounded
window: vectors that agree on the leading bits lie side by side. The number of passes follows the
size of the largest label. What the windows may still miss is read off the orders themselves: a
vector that shares L bits with the row a window away meets, in that pass, every partner that shares
more than L. Vectors for which all passes together could miss a partner at the limit with a
probability above ``MISS`` are compared with their whole label, block by block.

Verified links are united into components. The windows do not see all links inside a large clump of
near copies, so an exact count follows: each component is cut into blocks and every pair of blocks
is compared, which counts all links of a vector without listing pairs.

Equal vectors of a label are one representative with a multiplicity, so thousands of exact copies
cost one comparison. Blocks and windows bound the memory of a task; a component of m different
vectors costs m * m / BLOCK shuffled rows, u unsure vectors of a label of n cost 2 * u * n / BLOCK.

Vectors that are null, empty, zero or hold null or non-finite components, rows with a null label or
key, and rows of another length link with nothing: they are their own component. Rows that repeat a
key count as other vectors. An empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.components import components
from monthloom.llm.vectors import units, usable
from monthloom.operators.ordering import ordered_index
from monthloom.shipping import ship_package
from monthloom.staging import stage

LEAST = 0.93
PASSES = 12
BITS = 48
WINDOW = 256
BLOCK = 512
MISS = 1e-4


def agreement(least: float) -> float:
    """Probability that one hash bit of two vectors at cosine ``least`` is the same."""
    return 1.0 - float(np.arccos(np.clip(least, -1.0, 1.0))) / np.pi


def passes_for(size: int, least: float, window: int, miss: float = MISS,
               fewest: int = PASSES) -> int:
    """Passes after which a label of ``size`` spread vectors misses a link at ``least`` with a
    probability of at most ``miss``."""
    shared = 1.0 + max(0.0, float(np.log2(max(size, 1) / window)))
    met = agreement(least) ** shared
    if met >= 1.0:
        return fewest
    # Beyond the cap a vector is dearer to place than to compare with its label.
    return max(fewest, int(min(256.0, np.ceil(np.log(miss) / np.log1p(-met)))))


def projection_keys(x: np.ndarray, passes: int, bits: int, seed: int = 23) -> np.ndarray:
    """One integer per row and pass, whose order is that of the concatenated hash bits."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(x), passes), np.int64)
    value = (1 << np.arange(bits, dtype=np.int64)[::-1])
    for p in range(passes):
        out[:, p] = ((x @ rng.standard_normal((x.shape[1], bits))) > 0) @ value
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that links reach from each of ``n`` positions."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _representatives(vectors: DataFrame, key: str, vector: str, label: str) -> tuple:
    """Rows with the hash of their class, and one row per class of equal vectors."""
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
        (usable(vector) & F.col(label).isNotNull() & F.col(key).isNotNull()).alias("good"))
    rows = rows.withColumns({
        "c1": F.when(F.col("good"), F.xxhash64("label", "vector")),
        "c2": F.when(F.col("good"), F.xxhash64("vector", "label", F.lit("second")))})
    classes = rows.filter("good").groupBy("c1", "c2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"),
        F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
    # A class keeps the number under which it is written.
    return rows, stage(classes.withColumn("class", F.monotonically_increasing_id()),
                       "vector-classes")


def _window_links(classes: DataFrame, least: float, passes: int, bits: int, window: int
                  ) -> DataFrame:
    """Links ``a, b`` that windows show (``shared`` null), and per pass of a class ``a`` how many
    bits it shares with the rows a window away (``b`` null)."""
    schema = pa.schema([("pass", pa.int32()), ("place", pa.int64()), ("class", pa.int64()),
                        ("vector", pa.list_(pa.float64()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_pylist()
            lengths = np.array([len(v) for v in held])
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                places = projection_keys(
                    units(np.array([held[i] for i in at], np.float64)), passes, bits)
                part = batch.take(pa.array(at))
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), pa.array(places[:, p]),
                         part.column(0), part.column(1)], schema=schema)

    groups = classes.select("class", F.struct("label", F.size("vector")).alias("group"))
    keyed = classes.select("class", "vector").mapInArrow(
        hashed, "pass int, place long, class long, vector array<double>").join(groups, "class")
    ordered = ordered_index(keyed, ["group", "pass"], ["place", "class"], "at", "size")
    block = F.floor((F.col("at") - 1) / window)
    last = F.floor((F.col("size") - 1) / window)
    blocks = ordered.select(
        "group", "pass", "class", "vector", "place", "at",
        F.explode(F.when(block < last, F.array(block, block + 1)).otherwise(F.array(block)))
        .alias("block"), block.alias("own"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        x = units(np.vstack(part["vector"].to_numpy()))
        ids, place = part["class"].to_numpy(), part["place"].to_numpy()
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        low = _roots(len(ids), a, b)
        tied = np.flatnonzero(low != np.arange(len(ids)))
        # Rows exactly a window apart lie in one part together, once.
        far = np.arange(max(0, len(ids) - window))
        differ = place[far] ^ place[far + window]
        # frexp gives the bit length exactly: places have fewer bits than a double.
        shared = bits - np.frexp(differ.astype(np.float64))[1]
        passed = part["pass"].iloc[0]
        return pd.concat([
            pd.DataFrame({"a": ids[tied], "b": ids[low[tied]], "pass": passed, "shared": None}),
            pd.DataFrame({"a": np.concatenate([ids[far], ids[far + window]]), "b": None,
                          "pass": passed, "shared": np.tile(shared, 2)}),
        ]).astype({"a": "Int64", "b": "Int64", "pass": "Int32", "shared": "Int32"})

    return blocks.groupBy("group", "pass", "block").applyInPandas(
        compare, "a long, b long, pass int, shared int")


def _unsure(shared: DataFrame, least: float, passes: int, miss: float) -> DataFrame:
    """Classes for which the windows may miss a partner at ``least`` with a probability above
    ``miss``. A pass in which a row has no row a window away on one side is judged by the other."""
    met = F.pow(F.lit(agreement(least)), F.max("shared") + 1)
    # A class without any row a window away saw its whole label in that pass.
    return (shared.groupBy("a", "pass").agg(met.alias("met")).groupBy("a")
            .agg(F.sum(F.log1p(-F.least(F.col("met"), F.lit(1.0 - 1e-12)))).alias("missed"),
                 F.count("*").alias("n"))
            .filter((F.col("n") == passes) & (F.col("missed") > float(np.log(miss))))
            .select(F.col("a").alias("class")))


def _label_links(classes: DataFrame, unsure: DataFrame, least: float, block: int) -> DataFrame:
    """Links ``a, b`` between the classes ``unsure`` and all others of their label, exactly."""
    every = classes.select("class", F.struct("label", F.size("vector")).alias("group"), "vector")
    asking = stage(every.join(unsure, "class"), "vector-unsure")
    sizes = stage(
        every.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        .join(asking.groupBy("group").agg(
            F.ceil(F.count("*") / block).cast("int").alias("chunks")), "group"), "vector-parts")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        return rows.join(sizes, "group").select(
            "group", F.pmod(F.xxhash64("class", F.lit(own)), F.col(own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "class", "vector")

    def compare(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame({"a": [], "b": []})
        x, y = (units(np.vstack(t["vector"].to_numpy())) for t in (held, asked))
        ids, at = np.unique(np.concatenate([held["class"], asked["class"]]), return_inverse=True)
        a, b = np.nonzero(x @ y.T >= least)
        low = _roots(len(ids), at[a], at[len(x) + b])
        tied = np.flatnonzero(low != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[tied], "b": ids[low[tied]]})

    keys = ["group", "parts", "chunks"]
    return (dealt(every, "parts", "chunks").groupBy(*keys)
            .cogroup(dealt(asking, "chunks", "parts").groupBy(*keys))
            .applyInPandas(compare, "a long, b long"))


def _count_links(members: DataFrame, least: float, block: int) -> DataFrame:
    """Exact ``class, links``: links of every member to other members of its component, weighted
    by their copies. Components of one block are dealt many to a task."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    sized = members.join(sizes, "component")
    small = sized.filter(F.col("size") <= block)
    large = sized.filter(F.col("size") > block)

    def counts(x, w, y, v) -> tuple[np.ndarray, np.ndarray]:
        hit = x @ y.T >= least
        return hit @ v, w @ hit

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in part.groupby("component", sort=False):
            x, w = units(np.vstack(g["vector"].to_numpy())), g["copies"].to_numpy()
            links, _ = counts(x, w, x, w)
            # Its own copies are among them; a vector does not link with itself.
            own = (x * x).sum(axis=1) >= least
            out.append(pd.DataFrame({"class": g["class"], "links": links - own * w}))
        return pd.concat(out)

    def pair(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        a, b = part[part["own"] == i], part[part["own"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"class": [], "links": []})
        x, y = (units(np.vstack(t["vector"].to_numpy())) for t in (a, b))
        w, v = a["copies"].to_numpy(), b["copies"].to_numpy()
        left, right = counts(x, w, y, v)
        if i == j:
            return pd.DataFrame({"class": a["class"], "links": left - w})
        return pd.DataFrame({"class": np.concatenate([a["class"], b["class"]]),
                             "links": np.concatenate([left, right])})

    schema = "class long, links long"
    tasks = F.greatest(F.lit(1), F.ceil(F.lit(members.count()) / 5_000)).cast("int")
    alone = (small.withColumn("deal", F.pmod(F.xxhash64("component"), tasks))
             .groupBy("deal").applyInPandas(whole, schema))
    parts = F.ceil(F.col("size") / block).cast("int")
    dealt = large.withColumn("own", F.pmod(F.xxhash64("class"), parts).cast("int"))
    paired = dealt.select("component", "class", "copies", "vector", "own", F.explode(F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j"))))
        .alias("p")).select("component", "class", "copies", "vector", "own", "p.i", "p.j")
    across = paired.groupBy("component", "i", "j").applyInPandas(pair, schema)
    return alone.unionByName(across).groupBy("class").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, least: float = LEAST, key: str = "vec_id",
                 vector: str = "embedding", label: str = "label", passes: int = PASSES,
                 bits: int = BITS, window: int = WINDOW, block: int = BLOCK,
                 miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row. ``passes`` is the least number."""
    ship_package(vectors.sparkSession)
    rows, classes = _representatives(vectors, key, vector, label)
    largest = classes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0]
    passes = passes_for(largest or 0, least, window, miss, passes)
    seen = stage(_window_links(classes, least, passes, bits, window), "vector-windows")
    links = seen.filter("b IS NOT NULL").select("a", "b")
    if largest and largest > window:
        unsure = _unsure(seen.filter("b IS NULL"), least, passes, miss)
        links = links.unionByName(_label_links(classes, unsure, least, block))
    links = links.distinct()
    tied = components(links)
    members = stage(
        classes.join(tied, classes["class"] == tied["node"])
        .select("class", "component", "copies", "least", "vector"),
        "vector-members")
    roots = members.groupBy("component").agg(F.min("least").alias("component_id"))
    counted = (members.select("class", "component")
               .join(_count_links(members, least, block), "class").join(roots, "component")
               .select("class", "links", "component_id"))
    known = stage(classes.drop("vector").join(counted, "class", "left").select(
        "c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component_id", "least").alias("component_id")), "vector-links")
    out = rows.select("vec_id", "c1", "c2").join(known, ["c1", "c2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
