"""Lexical search against plain counting, exact tiles, ties and odd rows."""
import math
import re
from collections import Counter

import numpy as np
import pytest

from monthloom.llm import lexical_search
from monthloom.llm.lexical_search import Best, ItemTiles, search, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL_LETTERS = {c: c + 32 for c in range(0x41, 0x5B)}
ODD = [None, "", "  ..!", "alpha", "Alpha beta", "alpha alpha beta É é", "é\x85ü beta-gamma_x9",
       "alpha", "w " * 30_000, "x" * 70_000, "gamma " * 5 + "beta", "日本 alpha", "beta"]


def terms_of(text):
    return TERM.findall((text or "").translate(SMALL_LETTERS))


def brute_force(docs, items, top):
    bags = [(key, Counter(terms_of(t))) for key, t in docs]
    bags = [(key, b, b.total()) for key, b in bags if b]
    n_docs, words = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for key, bag, n in bags:
            m = 75 + (25 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms_of(text)
                        if t in bag)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        for rank, (s, _, _, key) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1):
            out.append((item, rank, key, -s))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0], r[3] * -1, r[2] is None, r[2] or 0, r[1]))


@pytest.mark.parametrize(("top", "exact"), [(3, 1 << 53), (20, 1 << 53), (4, 2_500_000_000)])
def test_equals_plain_counting_with_odd_rows(spark, top, exact):
    docs = [(i if i % 6 else None, t) for i, t in enumerate(ODD * 2)] + [(4, "Alpha beta")]
    items = [(1, "ALPHA beta beta"), (2, "é gamma"), (3, None), (4, "..."), (5, "absent"),
             (1, "ALPHA beta beta"), (6, "alpha " * 50 + "x" * 70_000)]
    table = spark.createDataFrame([(k, t, 0.5, 7) for k, t in docs],
                                  "doc_id long, text string, score double, rank int")
    asked = spark.createDataFrame([(k, t, 1) for k, t in items],
                                  "item_id long, text string, doc_id int")
    got = [tuple(r) for r in search(table.repartition(5), asked, top, exact=exact).collect()]
    assert order(got) == order(brute_force(docs, list(dict.fromkeys(items)), top))


def test_several_item_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    items = spark.createDataFrame([(i, f"alpha {w}") for i, w in enumerate(
        ["beta", "gamma", "é", "w", "x9"])], "item_id int, text string")
    want = sorted(map(tuple, search(docs, items).collect()))
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 2)
    assert sorted(map(tuple, search(docs, items).collect())) == want and want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0


def test_pieces_do_not_cut_terms(monkeypatch):
    text = ("ab " * 50 + "c" * 300 + " " + "Ab,é " * 40).encode()
    want = term_counts(text)
    for size in (1, 2, 7, 64, 299):
        monkeypatch.setattr(lexical_search, "_PIECE", size)
        assert term_counts(text) == want


def test_tiles_stay_exact_where_one_product_would_not():
    rng = np.random.default_rng(3)
    items, terms, docs = 7, 40, 9
    item, term = np.repeat(np.arange(items), terms), np.tile(np.arange(terms), items)
    weight = rng.integers(0, 3 << 33, items * terms)
    impact = rng.integers(1, lexical_search.MOST_IMPACT, (terms, docs))
    cut = ItemTiles.cut(items, item, term, weight.tolist())
    assert len(cut.tiles) > 1
    doc, at = np.tile(np.arange(docs), terms), np.repeat(np.arange(terms), docs)
    got = cut.scores(doc, at, impact.ravel(), docs)
    want = [[sum(int(a) * int(b) for a, b in zip(row, column)) for column in impact.T]
            for row in weight.reshape(items, terms)]
    assert got.tolist() == want


def test_best_keeps_the_smaller_key_of_ties_across_tiles():
    best = Best(1, 3)
    none = np.zeros(4, bool)
    best.add(np.array([[5, 5, 5, 5]]), np.array([9, 8, 7, 6]), none)
    best.add(np.array([[5, 1, 0, 5]]), np.array([1, 2, 3, 4]), np.array([False, False, False, True]))
    assert best.key[0].tolist() == [1, 6, 7] and best.score[0].tolist() == [5, 5, 5]
