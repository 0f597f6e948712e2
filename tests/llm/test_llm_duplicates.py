"""Duplicate operators against brute force on small rows with every odd case."""
import collections
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.llm import induced_sort
from monthloom.llm.components import components
from monthloom.llm.dart_minhash import near_texts, sketches
from monthloom.llm.near_vectors import near_vectors
from monthloom.llm.posting_lists import nearest
from monthloom.llm.substring_dedup import merged, remove_repeats
from monthloom.llm.vectors import units


# --- components --------------------------------------------------------------------------------

def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    links += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (None, 3), (300, 301)]
    got = {r.node: r.component for r in
           components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    want |= {200 + i: 200 for i in range(9)} | {300: 300, 301: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffix sorting ----------------------------------------------------------------------------

@pytest.mark.parametrize("options", [{}, {"in_memory": 2, "batch": 5, "buffer": 7}])
def test_induced_order_and_prefixes_equal_brute_force(tmp_path, options):
    rng = np.random.default_rng(0)
    for trial in range(120):
        text = rng.integers(0, int(rng.integers(1, 5)) + 1,
                            int(rng.integers(1, 60))).astype(np.uint8)
        if trial % 3 == 0:
            text = np.tile(text, 3)[:80]
        out = list(induced_sort.suffix_order(text, 1000, str(tmp_path), **options))
        order = np.concatenate([p for p, _ in out])[::-1].tolist()
        symbols = text.tolist()
        want = sorted(range(len(text)), key=lambda i: symbols[i:])
        assert order == want
        prefixes = [0]
        for a, b in zip(want[::-1], want[::-1][1:]):
            k = 0
            while max(a, b) + k < len(text) and symbols[a + k] == symbols[b + k]:
                k += 1
            prefixes.append(k)
        assert np.concatenate([x for _, x in out]).tolist() == prefixes


def test_queue_spills_and_keeps_push_order(tmp_path):
    queue = induced_sort.Queue(str(tmp_path), buffer=3)
    for i in range(10):
        queue.push(np.array([i % 2, 5]), np.array([i, 100 + i]), np.array([i, 0]))
    assert any(tmp_path.iterdir())
    assert queue.pop(0)[0].tolist() == [0, 2, 4, 6, 8]
    assert queue.pop(5)[0].tolist() == [100 + i for i in range(10)]
    assert queue.pop(1)[0].tolist() == [1, 3, 5, 7, 9]
    assert queue.pop(1)[0].tolist() == []


def test_queue_reads_runs_forward_and_deletes_them(tmp_path):
    for descending in (False, True):
        queue = induced_sort.Queue(str(tmp_path), buffer=50, descending=descending)
        rng = np.random.default_rng(5)
        waiting = collections.defaultdict(list)
        order = range(400)[::-1] if descending else range(400)
        for step, symbol in enumerate(order):
            ahead = np.array([s for s in rng.integers(0, 400, 9)
                              if (s <= symbol if descending else s >= symbol)], np.int64)
            place = np.arange(len(ahead)) + 1000 * step
            queue.push(ahead, place, place.astype(np.int32))
            for s, v in zip(ahead.tolist(), place.tolist()):
                waiting[s].append(v)
            assert queue.pop(symbol)[0].tolist() == waiting[symbol]
        assert queue.number > 10 and not any(tmp_path.iterdir())


def test_least_prefix_by_time_stamps():
    rng = np.random.default_rng(9)
    least, history, last = induced_sort._RangeMin(40), [0], {}
    last[3] = -1
    least.end_of_text(3)
    for size in [1, 3, 40, 16, 17, 200, 1, 0, 90]:
        prefix = rng.integers(0, 30, size).astype(np.int32)
        at = np.flatnonzero(rng.random(size) < 0.6)
        symbol = rng.integers(0, 40, len(at))
        got = least.step(prefix, at, symbol)
        base = len(history)
        history += prefix.tolist()
        want = []
        for a, s in zip((at + base).tolist(), symbol.tolist()):
            want.append(min(history[last[s] + 1: a + 1]) if s in last else -1)
            last[s] = a
        assert got.tolist() == want


def test_recursion_stays_in_proportion(tmp_path):
    """CPU time of a forced recursion: the alphabet one level down grows with the text."""
    rng = np.random.default_rng(1)
    spent = []
    for n in (4_000, 32_000):
        text = rng.integers(0, 60, n).astype(np.uint16)
        text = np.concatenate([text, text[: n // 3]])
        begin = time.process_time()
        out = [p for p, _ in induced_sort.suffix_order(text, 400, str(tmp_path), in_memory=100)]
        spent.append(time.process_time() - begin)
        assert sum(map(len, out)) == len(text)
    assert spent[1] < 24 * spent[0]  # eight times the text; a quadratic sort takes 64 times


# --- repeated substrings -----------------------------------------------------------------------

def brute_repeats(rows, length):
    seen = collections.Counter()
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        seen.update(b[p: p + length] for p in range(len(b) - length + 1))
    out = []
    for k, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p: p + length]] > 1:
                gone[p: p + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcé ") for _ in range(300)) for _ in range(6)]
    rows = [None, "", "a" * 1000, "ab" * 300, base[0], base[0], base[1] + base[0][50:200] + base[2],
            base[2][100:] + base[3], "x" + base[3][:90] * 2, "tiny", base[5] * 30]
    rows += ["".join(rng.choice("ab") for _ in range(rng.randint(30, 400))) for _ in range(30)]
    rows += [f"q{i}{base[4][:150]}z{i * 7}" for i in range(50)]
    return [(i % 50 if i % 9 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("options", [
    {"length": 40, "gram": 8}, {"length": 40, "gram": 8, "hot": 5, "shard_bytes": 3000},
    {"length": 12, "gram": 4},
])
def test_repeats_equal_brute_force(spark, options):
    rows = passages()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                 "doc_id long, text string, k1 int, kept string").repartition(4)
    got = remove_repeats(docs, **options).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, options["length"])


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(empty, length=10, gram=20)
    lo, hi = merged([{"s": 5, "e": 9}, {"s": 0, "e": 5}, {"s": 20, "e": 22}], 30)
    assert lo.tolist() == [0, 20] and hi.tolist() == [9, 22]


# --- near texts --------------------------------------------------------------------------------

def shingle_set(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_classes(rows, similar):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if None not in (rows[i][0], rows[j][0]) and similar(rows[i][1], rows[j][1]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    smallest = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            smallest[find(i)] = min(k, smallest.get(find(i), k))
    return sorted(((k, None if k is None else smallest[find(i)]) for i, (k, _) in enumerate(rows)),
                  key=str)


def families():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for _ in range(12):
        source = [rng.choice(vocabulary) for _ in range(rng.randint(8, 120))]
        rows.append(" ".join(source))
        for _ in range(rng.randint(0, 12)):
            words = list(source)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append("  ".join(words).upper())
    rows += [None, "", " \n", "one", "One", "two words", "a b c d", rows[0], "z " * 3000,
             "z " * 2900]
    rng.shuffle(rows)
    return [(i if i % 13 else None, t) for i, t in enumerate(rows)] + [(5, rows[5]), (1, "other")]


def jaccard(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return bool(x) and bool(y) and len(x & y) >= 0.8 * len(x | y)


def test_near_texts_equal_brute_force(spark):
    rows = families()
    docs = spark.createDataFrame([(*r, "s") for r in rows],
                                 "doc_id long, text string, band string").repartition(3)
    got = near_texts(docs).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(rows, jaccard)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.class_id) for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_texts(empty).count() == 0


def test_counted_shingles_weigh_repetition(spark):
    line = "one two three four five six seven"
    rows = [(1, line), (2, f"{line} {line} {line} {line} {line}"), (3, line + " eight"),
            (4, f"{line} {line} {line} {line} {line} eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_texts(docs, counted=True, bands=40, rows=2).collect()}

    def bag(t):
        w = t.split()
        return collections.Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4))

    def similar(a, b):
        return sum((bag(a) & bag(b)).values()) >= 0.8 * sum((bag(a) | bag(b)).values())

    assert sorted(got.items()) == brute_classes(rows, similar)


def test_sketches_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60).astype(float), rng.integers(1, 9, 60).astype(float)
    s = sketches(np.repeat([0, 1], 60), np.tile(items, 2), np.concatenate([a, b]), 3, 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.05 and not s[2].any()


# --- vectors -----------------------------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(6)
    rows = []
    for f in range(25):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 14))):
            rows.append(((centre + rng.normal(size=16) * 0.1).tolist(), f % 3))
    rows += [rows[0]] * 5 + [(rows[0][0], 1), (rows[1][0], None), (None, 0), ([0.0] * 16, 0),
                             ([float("nan")] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0), ([], 0),
                             ([float("inf")] + [1.0] * 15, 0), ([1.0, 2.0], 0),
                             ([x * 1e30 for x in rows[2][0]], rows[2][1])]
    out = [(i, v, label) for i, (v, label) in enumerate(rows)]
    return [*out, (3, *out[3][1:]), (None, *out[0][1:])]


def good(v):
    return bool(v) and None not in v and np.isfinite(v).all() and any(v)


def test_near_vectors_equal_brute_force(spark):
    rows = vectors()
    docs = spark.createDataFrame([(*r, 0) for r in rows],
                                 "vec_id long, embedding array<double>, label int, c1 int")
    docs = docs.repartition(3)

    def similar(a, b):
        (v, x), (w, y) = a, b
        if x is None or x != y or not good(v) or not good(w) or len(v) != len(w):
            return False
        u = units(np.array([v, w], float))
        return float(u[0] @ u[1]) >= 0.93

    keyed = [(k, (v, label)) for k, v, label in rows]
    links = [sum(similar(a[1], b[1]) for j, b in enumerate(keyed)
                 if j != i and b[0] is not None) if a[0] is not None else 0
             for i, a in enumerate(keyed)]
    for options in ({}, {"window": 4, "block": 5}):
        got = near_vectors(docs, **options).collect()
        assert sorted(((r.vec_id, r.component_id) for r in got), key=str) == brute_classes(
            keyed, similar)
        assert sorted(((r.vec_id, r.n_links) for r in got), key=str) == sorted(
            ((k, n) for (k, _), n in zip(keyed, links)), key=str)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shift", [0.0, 1.2])
def test_isolated_pairs_of_a_large_label_are_linked(spark, shift):
    rng = np.random.default_rng(3)
    x = units(rng.standard_normal((1500, 32)) / np.sqrt(32) + shift / np.sqrt(32))
    side = rng.standard_normal((150, 32))
    side -= (side * x[:150]).sum(axis=1, keepdims=True) * x[:150]
    x = np.concatenate([x, 0.935 * x[:150] + np.sqrt(1 - 0.935 ** 2) * units(side)])
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert want.sum() >= 300
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r for r in near_vectors(docs, passes=2, window=16, block=256).collect()}
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    assert all(got[1500 + i].component_id == got[i].component_id for i in range(150))


def test_posting_lists_find_the_nearest(spark):
    rows = [(k, v) for k, v, _ in vectors() if k is not None]
    docs = spark.createDataFrame([(*r, 0) for r in rows],
                                 "vec_id long, embedding array<double>, list int").repartition(3)
    got = nearest(docs, F.col("vec_id") % 5 == 0, k=3, list_size=20).collect()
    usable = {k: v for k, v in rows if good(v) and len(v) == 16}
    keys = sorted(usable)
    x = units(np.array([usable[k] for k in keys]))
    hits = total = 0
    for i, q in enumerate(keys):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        if q % 5:
            assert not mine
            continue
        score = (x[i] * x).sum(axis=1)
        want = [keys[j] for j in np.lexsort((keys, -score)) if keys[j] != q][:3]
        assert [m[0] for m in mine] == [1, 2, 3]
        assert all(abs(m[2] - score[keys.index(m[1])]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & set(want))
        total += 3
    assert hits / total >= 0.9
    assert nearest(docs.limit(0), F.lit(True)).count() == 0
    few = docs.filter("vec_id < 3")
    assert {r.query_id: r.rank for r in nearest(few, F.lit(True)).collect()} == {0: 2, 1: 2, 2: 2}


def test_a_query_in_a_tiny_list_gets_k_rows(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((4, 16)), 150, axis=0) + rng.normal(0, 0.02, (600, 16))
    x = np.concatenate([x, rng.standard_normal((30, 16))])  # rare vectors that become centroids
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<double>").repartition(3)
    got = nearest(docs, F.col("vec_id") >= 600, k=5, list_size=8).groupBy("query_id").count()
    assert {r.query_id: r["count"] for r in got.collect()} == {i: 5 for i in range(600, 630)}


def test_repeated_keys_in_the_nearest_lists_do_not_shorten_the_answer(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((900, 16))
    near = x[0] + rng.normal(0, 0.01, (500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, v.tolist()) for v in near]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = nearest(docs, F.col("vec_id") == 0, k=5, list_size=16).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3, 4, 5] and all(r.vec_id for r in got)


def test_ties_go_to_the_smaller_key(spark):
    docs = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)],
                                 "vec_id long, embedding array<double>")
    got = nearest(docs, F.col("vec_id") == 3, k=4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 4] and len({r.score for r in got}) == 1
    assert abs(got[0].score - 1.0) < 1e-15
