"""Operator 9: near-duplicate texts by dart hashing of weighted shingle sets.

Darts are thrown at the plane of (element, weight) x rank. The plane of an element is cut into
cells of bounded area; a hash of (element, cell) says how many darts a cell holds (a Poisson
draw) and where each lies, so equal elements meet equal darts in every document. A document keeps
the darts below its elements' weights and below a rank bound chosen so that about
``k ln k + 2 k`` remain, whatever its length; every dart belongs to one of ``k`` coordinates, and
the dart of least rank in a coordinate is its value there. Two documents agree on a coordinate with
the probability of their weighted Jaccard similarity. Coordinates form bands; documents that agree
on a whole band are compared exactly.

Near-duplicate classes are the connected components of exact similarity >= ``LEAST`` over
five-word shingles (case-folded words; texts of fewer words are one shingle; by default each
distinct shingle weighs one, ``counted`` weighs it by its occurrences). Texts with equal shingle
weights are one representative, so thousands of exact copies cost one comparison.

Within a band's bucket all members are compared with ``HUBS`` well connected ones, not with each
other; the choice differs from band to band, so a member meets many hubs. What is then still in
several components of the bucket is compared across them in a second round, but for those members
and pairs that sizes, shingles without a second holder or distances to a hub rule out. So a bucket
of n near copies costs about ``HUBS`` n comparisons, and no pair that shares a band is lost. Shingle lists
travel only for documents that share a band with another; a bit set of fixed size, which every
task gets, keeps the others' texts from being shuffled for that.

Texts without words link with nothing. Null keys link with nothing. Rows that repeat a key are
separate rows of one class. An empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.llm.components import components
from monthloom.llm.textcodes import mix, prefix_hash, segment_hash, slices, words
from monthloom.shipping import ship_package
from monthloom.staging import stage

SHINGLE = 5
LEAST = 0.8
BANDS = 24
HUBS = 4
ROUNDS = 3
FILTER_BYTES = 1 << 23
ROWS = 5
_TEXTS = 500
_FIRST_RANK = -3  # the lowest rank range is [0, 2**-3)
_CELL_AREA = 32.0


def _odd(number: int) -> np.uint64:
    return np.uint64((number * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from hashes."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


@lru_cache(maxsize=256)
def _poisson_steps(area: float) -> np.ndarray:
    """Cumulative Poisson probabilities, from which a uniform number reads a count."""
    most = int(area + 12 * np.sqrt(area) + 16)
    p = np.exp(-area) * np.cumprod(np.concatenate([[1.0], area / np.arange(1, most)]))
    return np.cumsum(p)


def _cells(low: float, high: float, width: float) -> list[tuple[float, float]]:
    """Cut [low, high) of the rank axis so that no cell of this width exceeds the area bound."""
    n = max(1, int(np.ceil((high - low) * width / _CELL_AREA - 1e-9)))
    edge = np.linspace(low, high, n + 1)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def sketches(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int,
             ) -> np.ndarray:
    """``n x k`` dart values of the weighted sets given as (owner, element, weight) triples;
    zeros where a set is empty. A set that leaves a coordinate empty throws on, at higher ranks."""
    out = np.zeros(n * k, np.uint64)
    rank = np.full(n * k, np.inf)
    total = np.bincount(owner, weight, n)
    want = k * np.log(k) + 2 * k
    bound = np.divide(want, total, out=np.zeros(n), where=total > 0)
    top = np.ceil(np.log2(np.maximum(bound, 2.0 ** _FIRST_RANK))).astype(np.int64)
    done = np.full(n, _FIRST_RANK - 1)  # rank ranges up to this level are thrown
    open_ = total > 0
    while open_.any():
        thrown = []
        for level in range(_FIRST_RANK, int(top[open_].max()) + 1):
            take = (open_ & (top >= level) & (done < level))[owner]
            if take.all():
                thrown += _throw(owner, element, weight, k, level)
            elif take.any():
                thrown += _throw(owner[take], element[take], weight[take], k, level)
        if thrown:
            at, r, dart = (np.concatenate(x) for x in zip(*thrown))
            order = np.lexsort((r, at))
            at = at[order]
            first = np.append(True, at[1:] != at[:-1])
            at, r, dart = at[first], r[order[first]], dart[order[first]]
            better = r < rank[at]
            rank[at[better]], out[at[better]] = r[better], dart[better]
        done = np.where(open_, np.maximum(done, top), done)
        open_ &= np.isinf(rank).reshape(n, k).any(axis=1)
        top = np.where(open_, done + 1, top)
    return out.reshape(n, k)


def _throw(owner, element, weight, k: int, level: int) -> list[tuple]:
    """The darts of one dyadic rank range that hit: coordinate, rank and identity."""
    low, high = (0.0 if level == _FIRST_RANK else 2.0 ** (level - 1)), 2.0 ** level
    found = []
    step = 0
    while True:
        below = 0.0 if step == 0 else 2.0 ** (step - 1)
        width = 1.0 if step == 0 else below
        if step:
            heavy = weight > below
            if not heavy.any():
                return found
            owner, element, weight = owner[heavy], element[heavy], weight[heavy]
        for number, (a, b) in enumerate(_cells(low, high, width)):
            area = (b - a) * width
            cell = mix(element ^ _odd(((level + 64) << 40) + (step << 24) + number))
            u = _unit(cell)
            hit = np.flatnonzero(u >= np.exp(-area))
            darts = np.searchsorted(_poisson_steps(area), u[hit], side="right")
            nth = np.arange(int(darts.sum())) - np.repeat(np.cumsum(darts) - darts, darts)
            hit = np.repeat(hit, darts)
            dart = mix(cell[hit] + (nth + 1).astype(np.uint64) * _odd(1))
            if weight.min(initial=np.inf) < below + width:
                inside = below + width * _unit(mix(dart + _odd(101))) < weight[hit]
                hit, dart = hit[inside], dart[inside]
            r = a + (b - a) * _unit(mix(dart + _odd(102)))
            at = owner[hit] * k + (mix(dart + _odd(103)) % np.uint64(k)).astype(np.int64)
            found.append((at, r, dart))
        step += 1


def shingles(texts: list[str], counted: bool = False
             ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first text, number of texts, and (owner, shingle hash, weight) of its shingles,
    sorted by owner and hash."""
    for piece in slices([t.lower() for t in texts]):
        n = len(piece.starts) - 1
        b, e, doc = words(piece)
        if not len(b):
            none = np.zeros(0, np.int64)
            yield piece.first, n, none, none.astype(np.uint64), none.astype(np.float64)
            continue
        h = segment_hash(prefix_hash(piece), b, e)
        count = np.bincount(doc, minlength=n)
        first = np.searchsorted(doc, np.arange(n))
        left = first[doc] + count[doc] - np.arange(len(doc))  # words from here to the end
        opens = np.flatnonzero((left >= SHINGLE) | (np.arange(len(doc)) == first[doc]))
        value = np.zeros(len(opens), np.uint64)
        for i in range(SHINGLE):
            there = left[opens] > i
            value[there] = mix(value[there] * np.uint64(0x100000001B3)
                               + h[opens[there] + i] + np.uint64(i))
        who = doc[opens]
        order = np.lexsort((value, who))
        who, value = who[order], value[order]
        new = np.append(True, (who[1:] != who[:-1]) | (value[1:] != value[:-1]))
        at = np.flatnonzero(new)
        weight = np.diff(at, append=len(who)).astype(np.float64)
        yield (piece.first, n, who[at], value[at],
               weight if counted else np.ones(len(at)))


def _fingerprints(who: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int
                  ) -> list[pa.Array]:
    """Two 64-bit hashes of each weighted set, null for an empty one."""
    out = []
    heft = (weight * 4096).astype(np.uint64)
    at = np.searchsorted(who, np.arange(n))
    there = np.bincount(who, minlength=n) > 0
    for salt in (11, 12):
        one = mix(mix(value + _odd(salt)) ^ heft)
        total = np.zeros(n, np.uint64)
        if len(one):
            total[there] = np.add.reduceat(one, at[there])
        out.append(pa.array(total.view(np.int64), mask=~there))
    return out


def _batches(batches: Iterator[pa.RecordBatch], texts_at: int) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            part = batch.slice(at, _TEXTS)
            yield part, part.column(texts_at).to_pylist()


def signed(source: DataFrame, bands: int, rows: int, counted: bool) -> DataFrame:
    """``doc_id, n, set_a, set_b, bands`` of every row ``doc_id, text``: total weight, a 128-bit
    fingerprint of its weighted shingles (null without words) and one hash per band."""
    k = bands * rows
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.float64()), ("set_a", pa.int64()),
                        ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches, 1):
            for first, n, who, value, weight in shingles(texts, counted):
                sketch = sketches(who, value, weight, n, k).reshape(n, bands, rows)
                band = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    band = mix(band * np.uint64(0x100000001B3) + sketch[:, :, r])
                band += np.arange(bands, dtype=np.uint64) * _odd(7)
                prints = _fingerprints(who, value, weight, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(first, n), pa.array(np.bincount(who, weight, n)),
                     *prints, pa.array(list(band.view(np.int64)), pa.list_(pa.int64()))],
                    schema=schema)

    return source.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n double, set_a long, set_b long, bands array<long>")


def _key_bits(keys: np.ndarray, size: int) -> np.ndarray:
    """Two bit numbers of each key in a bit set of ``size`` bytes."""
    h = keys.astype(np.int64).view(np.uint64)
    bits = np.uint64(8 * size)
    return np.stack([mix(h + _odd(s)) % bits for s in (201, 202)])


def key_filter(keys: DataFrame, size: int = FILTER_BYTES) -> np.ndarray:
    """Bit set of the keys: ``size`` bytes whatever their number. Tasks set bits of parts of it,
    which are united part by part before the driver gets each part once. With very many keys it
    lets others pass too, which costs time and changes nothing."""
    part = 1 << 16

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(_key_bits(batch["key"].to_numpy(), size)).astype(np.int64)
            yield pd.DataFrame({"part": at // (8 * part), "bit": at % (8 * part)})

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(8 * part, bool)
        flags[rows["bit"].to_numpy()] = True
        return pd.DataFrame({"part": rows["part"].iloc[:1], "bytes": [np.packbits(flags).tobytes()]})

    marked = (keys.select("key").mapInPandas(bits, "part long, bit long").distinct()
              .groupBy("part").applyInPandas(unite, "part long, bytes binary"))
    out = np.zeros(size, np.uint8)
    for row in marked.toLocalIterator():
        out[row["part"] * part: (row["part"] + 1) * part] = np.frombuffer(row["bytes"], np.uint8)
    return out


def _shingle_lists(source: DataFrame, held: np.ndarray, counted: bool) -> DataFrame:
    """``set_a, set_b, items, weights`` of rows ``doc_id, text`` whose key passes the bit set,
    items ascending; weights are left empty where all are one."""
    schema = pa.schema([("set_a", pa.int64()), ("set_b", pa.int64()),
                        ("items", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0).fill_null(0))
            bit = _key_bits(keys, len(held)).astype(np.int64)
            found = ((held[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).all(axis=0)
            chosen = batch.take(pa.array(np.flatnonzero(found)))
            for _, texts in _batches([chosen], 1):
                for _, n, who, value, weight in shingles(texts, counted):
                    edge = np.searchsorted(who, np.arange(n + 1)).astype(np.int32)
                    items = pa.ListArray.from_arrays(pa.array(edge),
                                                     pa.array(value.view(np.int64)))
                    heft = pa.ListArray.from_arrays(
                        pa.array(edge if counted else np.zeros(n + 1, np.int32)),
                        pa.array(weight if counted else np.zeros(0)))
                    yield pa.RecordBatch.from_arrays(
                        [*_fingerprints(who, value, weight, n), items, heft], schema=schema)

    return source.select("doc_id", "text").mapInArrow(
        run, "set_a long, set_b long, items array<long>, weights array<double>")


def _similarities(pairs: DataFrame, lists: DataFrame, counted: bool) -> DataFrame:
    """Pairs ``a, b`` with their exact similarity ``sim``."""
    one = lists.select(F.col("node").alias("a"), F.col("items").alias("ia"),
                       F.col("weights").alias("wa"))
    two = lists.select(F.col("node").alias("b"), F.col("items").alias("ib"),
                       F.col("weights").alias("wb"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    if not counted:
        shared = F.size(F.array_intersect("ia", "ib"))
        union = F.size("ia") + F.size("ib") - shared
        return both.select("a", "b", (shared / union).alias("sim"))
    heft = F.map_from_arrays("ib", "wb")
    shared = F.aggregate(
        F.zip_with("ia", "wa", lambda i, w: F.least(w, F.coalesce(F.try_element_at(heft, i),
                                                                  F.lit(0.0)))),
        F.lit(0.0), lambda s, x: s + x)
    total = (F.aggregate("wa", F.lit(0.0), lambda s, x: s + x)
             + F.aggregate("wb", F.lit(0.0), lambda s, x: s + x))
    return both.select("a", "b", (shared / (total - shared)).alias("sim"))


def _still_split(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    split = members.groupBy("band").agg(F.min("component").alias("lo"),
                                        F.max("component").alias("hi")).filter("lo < hi")
    return members.join(split.select("band"), "band")


def _own_weight(members: DataFrame, lists: DataFrame, counted: bool) -> DataFrame:
    """``node, own``: the weight of shingles that no other member of any bucket holds."""
    held = lists.join(members.select("node").distinct(), "node")
    if counted:
        rows = held.select("node", F.explode(F.arrays_zip("items", "weights")).alias("s")).select(
            "node", F.col("s.items").alias("item"), F.col("s.weights").alias("w"))
    else:
        rows = held.select("node", F.explode("items").alias("item"), F.lit(1.0).alias("w"))
    once = rows.groupBy("item").agg(F.count("*").alias("c"), F.max("node").alias("node"),
                                    F.max("w").alias("w")).filter("c = 1")
    return once.groupBy("node").agg(F.sum("w").alias("own"))


def _reachable(members: DataFrame, least: float) -> DataFrame:
    """Members that their sizes and own shingles allow to be similar to another one of a bucket.

    What two sets share is at most the smaller of their weights less what they own alone; so a
    similarity of ``least`` needs ``n_a + n_b <= (1 + 1 / least) (n_a - own_a)``. A member needs
    one as small as that bound leaves, and one whose own bound is as large as itself; both are
    looked up per bucket, without comparing members."""
    reach = (1 + 1 / least) * (F.col("n") - F.col("own")) - F.col("n")
    marked = members.withColumn("reach", reach)
    bound = marked.groupBy("band").agg(F.min("n").alias("smallest"), F.max("reach").alias("widest"))
    return marked.join(bound, "band").filter(
        (F.col("reach") >= F.col("smallest") - 1e-6) & (F.col("n") <= F.col("widest") + 1e-6)
    ).select("band", "node", "n", "own", "component")


def near_texts(docs: DataFrame, least: float = LEAST, key: str = "doc_id", text: str = "text",
               bands: int = BANDS, rows: int = ROWS, counted: bool = False) -> DataFrame:
    """``doc_id, class_id, kept`` of every row; ``class_id`` is the smallest key of its class."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = stage(signed(source, bands, rows, counted), "dart-signatures")
    worded = every.filter("set_a is not null and doc_id is not null")
    # One node per distinct shingle set; its number is fixed by being written once.
    sets = stage(worded.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
                 .withColumn("node", F.monotonically_increasing_id()), "dart-sets")
    first_row = worded.join(sets, ["set_a", "set_b"]).filter("doc_id = rep")
    member = stage(first_row.select("node", F.explode("bands").alias("band")).distinct(),
                   "dart-bands")
    crowd = member.groupBy("band").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    shared = stage(member.join(crowd, "band"), "dart-buckets")
    # A document's company over all its buckets: the source of a family of copies has most.
    size = worded.groupBy("set_a", "set_b").agg(F.max("n").alias("n"))
    company = stage(
        shared.groupBy("node").agg(F.sum("crowd").alias("company")).join(sets, "node")
        .join(size, ["set_a", "set_b"]), "dart-company")
    held = stage(shared.select("band", "node").join(company.select("node", "n", "company"), "node"),
                 "dart-members")
    passing = key_filter(company.select(F.col("rep").alias("key")))
    lists = stage(
        _shingle_lists(source, passing, counted)
        .join(company.select("set_a", "set_b", "node"), ["set_a", "set_b"])
        .select("node", "items", "weights").dropDuplicates(["node"]), "dart-lists")

    def sized(pairs: DataFrame) -> DataFrame:
        """Sets of too different sizes cannot be similar enough."""
        return pairs.filter(F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))

    slot = F.pmod(F.xxhash64("node", "band"), F.lit(HUBS))
    best = F.struct("company", (-F.col("node")).alias("neg"), "n")
    hubs = held.groupBy("band").agg(
        F.max(best).alias("top"),
        *[F.max(F.when(slot == i, best)).alias(f"h{i}") for i in range(HUBS)])
    hub = hubs.select("band", F.explode(F.array(*[f"h{i}" for i in range(HUBS)])).alias("h")).filter(
        "h is not null").select("band", (-F.col("h.neg")).alias("hub"), F.col("h.n").alias("nh"))
    star = sized(held.join(hub, "band").filter("node <> hub").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"),
        F.col("n").alias("na"), F.col("nh").alias("nb"))).select("a", "b").distinct()
    star = stage(star, "dart-stars")
    compared = stage(_similarities(star, lists, counted), "dart-compared")
    first = compared.filter(F.col("sim") >= least).select("a", "b")
    tied = components(first)

    # Second round: pairs of a bucket across the components that the first one left apart.
    apart = held.join(tied, "node", "left").select(
        "band", "node", "n", F.coalesce("component", "node").alias("component"))
    apart = stage(_still_split(apart), "dart-apart")
    for _ in range(ROUNDS):  # what shared shingles only with those that left may leave, too
        apart = stage(_still_split(_reachable(apart.select("band", "node", "n", "component").join(
            _own_weight(apart, lists, counted), "node", "left").fillna(0.0, ["own"]), least)),
            "dart-reachable")
    # One minus the similarity is a metric: documents whose distances to the bucket's hub differ
    # by more than the threshold's distance cannot be similar enough, and need no comparison.
    open_ = (apart.join(hubs.select("band", (-F.col("top.neg")).alias("hub")), "band")
             .withColumns({"a": F.least("node", "hub"), "b": F.greatest("node", "hub")})
             .join(compared, ["a", "b"], "left")
             .withColumn("far", F.when(F.col("node") == F.col("hub"), F.lit(0.0))
                         .otherwise(1 - F.col("sim"))))
    open_ = stage(open_.select("band", "node", "n", "own", "component", "far"), "dart-open")
    # A pair meets in its first common bucket only.
    open_ = open_.join(open_.groupBy("node").agg(F.collect_set("band").alias("all")), "node")
    left = open_.select("band", F.col("node").alias("a"), F.col("n").alias("na"),
                        F.col("own").alias("oa"), F.col("component").alias("ca"),
                        F.col("far").alias("fa"), F.col("all").alias("ba"))
    right = open_.select("band", F.col("node").alias("b"), F.col("n").alias("nb"),
                         F.col("own").alias("ob"), F.col("component").alias("cb"),
                         F.col("far").alias("fb"), F.col("all").alias("bb"))
    room = (1 + 1 / least) * F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob"))
    near = F.coalesce(F.abs(F.col("fa") - F.col("fb")) <= 1 - least + 1e-9, F.lit(True))
    cross = sized(left.join(right, "band").filter(
        near & F.expr("a < b and ca <> cb") & (room >= F.col("na") + F.col("nb") - 1e-6)
        & (F.array_min(F.array_intersect("ba", "bb")) == F.col("band"))
    )).select("a", "b")
    cross = cross.join(star, ["a", "b"], "left_anti")
    second = _similarities(cross, lists, counted).filter(F.col("sim") >= least).select("a", "b")
    links = stage(first.unionByName(second), "dart-links")
    placed = stage(sets.join(components(links), "node", "left").select(
        "set_a", "set_b", "rep", F.coalesce("component", "node").alias("component")),
        "dart-classes")
    classes = placed.join(placed.groupBy("component").agg(F.min("rep").alias("class")),
                          "component").select("set_a", "set_b", "class")
    out = every.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(),
                                       F.coalesce("class", "doc_id")).alias("class_id"),
                      (F.col("doc_id").isNull() | (F.coalesce("class", "doc_id")
                                                   == F.col("doc_id"))).alias("kept"))
