"""Classifiers: held-out accuracy, odd rows, and flattened trees against a walk node by node."""
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from monthloom.llm import quality, textcodes, toxicity
from tests.conftest import MEDIUM

LARGE = "/root/testdata/sf0.1"  # the smaller tables hold 28 toxic documents to learn from

ODD = [None, "", " ", "x", "!!!", "same text here", "same text here", "w " * 20_000, "é\n\n|||", "7"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 4 else None, t, 0.5, "a") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")


@pytest.mark.parametrize(("name", "folder", "label", "modulus", "rest", "least"), [
    ("op1_quality", MEDIUM, "quality", 4, 2, 0.95), ("op8_toxicity", LARGE, "toxic", 3, 1, 0.94),
])
def test_held_out_accuracy(spark, name, folder, label, modulus, rest, least):
    rows = {r.doc_id: r for r in entry.queries()[name](spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    right = total = 0
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        out = rows[r.doc_id]
        assert out.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= out.score <= 1 and out.predicted == int(out.score >= 0.7)
        if out.held_out:
            total += 1
            right += out.predicted == r[label]
    assert right / total >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows_are_scored(spark, docs, module):
    labels = spark.createDataFrame(
        [(1, 1, 1, "z"), (2, 0, 0, "z"), (3, None, None, "z"), (5, 1, 1, "z"), (5, 0, 0, "z"),
         (6, 0, 0, "z"), (6, 0, 0, "z"), (None, 1, 1, "z"), (7, 1, 1, "z"), (999, 1, 0, "z")],
        "doc_id long, quality int, toxic int, text string")
    model = module.fit(docs, labels, F.lit(True))
    got = module.score(docs, model, keep=("predicted",)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    by_text = module.score(docs.withColumn("n", F.length("text")), model, keep=("n",)).collect()
    assert len({r.score for r in by_text if r.n == 14}) == 1
    assert module.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_two_kinds_of_labels_the_share_is_the_score(spark, docs, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for labels, want in ((none, 0.0), (ones, 1.0)):
        model = module.fit(docs, labels, F.lit(True))
        assert all(abs(r.score - want) < 1e-6 for r in module.score(docs, model).collect())


@pytest.mark.parametrize(("module", "trainer"), [(quality, "grow"), (toxicity, "train")])
def test_fitting_leaves_no_freed_memory_with_the_driver(spark, docs, monkeypatch, module, trainer):
    def held_mb():
        return int(Path("/proc/self/statm").read_text().split()[1]) / 256

    kept = []

    def train(*_):
        many = [np.ones(10_000) for _ in range(2_500)]  # 200 MB, of which one block stays in use
        kept.append(many[-1])
        return held_mb()

    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(module, trainer, train)
    assert module.fit(docs, labels, F.lit(True)) - held_mb() > 150


def test_the_sample_is_bounded_and_the_same_every_time(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)],
                                   "doc_id long, quality int, toxic int")
    pick = [sorted(r.doc_id for r in toxicity.labelled_sample(
        docs, labels.repartition(n), "quality", F.lit(True), 3).collect()) for n in (1, 4)]
    assert len(set(pick[0])) <= 3 and pick[0] == pick[1]


def test_the_sample_keeps_rare_labels(spark):
    n = 400
    docs = spark.createDataFrame([(i, "t") for i in range(n)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 40 == 0)) for i in range(n)],
                                   "doc_id long, toxic int")
    for size, want in ((60, 10), (12, 6), (395, 10), (1000, 10)):
        got = toxicity.labelled_sample(docs, labels, "toxic", F.lit(True), size,
                                       by_label=True).collect()
        assert sum(r.label for r in got) == want and len(got) == min(size, n)


def test_few_toxic_texts_are_learned_from():
    rng = np.random.default_rng(2)
    plain = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choice(plain, 30)) for _ in range(205)]
    for i in range(5):
        texts[i] += " zqxjkv"
    model = toxicity.train(texts, np.array([1] * 5 + [0] * 200))
    insult, other = model.word_logits(["zqxjkv", "word3"])
    assert insult > 0 and insult > other + 1


def test_training_needs_few_bytes_a_word():
    rng = np.random.default_rng(3)
    plain = np.array([f"w{i}" for i in range(3_000)])
    texts = [" ".join(rng.choice(plain, 5_000)) for _ in range(1_000)]  # 5 million words
    toxicity.train(texts[:2], np.arange(2), rounds=1)  # tables that stay are not counted
    tracemalloc.start()
    try:
        toxicity.train(texts, np.arange(1_000) % 2, rounds=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 125e6


def test_flat_trees_equal_a_walk_node_by_node():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(float)
    forest = quality.grow(x, y, trees=30, depth=3)
    binned = forest.bins(x)
    for row, got in zip(binned[:50], forest.scores(x)[:50]):
        z = forest.base
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            z += leaf[node - len(feature)]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.9
    assert forest.scores(np.zeros((0, 5))).tolist() == []


def test_misspellings_share_subwords():
    rng = np.random.default_rng(0)
    clean = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor"]

    def text(word):
        words = [clean[i] for i in rng.integers(0, len(clean), 30)]
        return " ".join([*words[:11], word, *words[11:]])

    texts = [text("wretchedly") for _ in range(40)] + [text("dolor") for _ in range(160)]
    model = toxicity.train(texts, np.array([1] * 40 + [0] * 160))
    scorer = toxicity._Scorer(model)
    unseen, fine = scorer.scores([text("wretchedlly"), text("ipsumm")])
    assert unseen > 0.7 > fine


def test_statistics_see_the_worst_stretch():
    good = " ".join(f"word{i} runs on," for i in range(200)) + "."
    names = list(quality.NAMES)
    a, b, c = quality.statistics([good, good + " STOP!!" * 64, ""])
    assert b[names.index("max_upper")] > 0.9 > a[names.index("max_upper")]
    assert b[names.index("max_same")] > a[names.index("max_same")]
    assert not c[: names.index("max_other")].any()


def test_a_worker_holds_the_words_of_one_stage_alone():
    codes = textcodes.SegmentCodes(lambda strings: [[len(s)] for s in strings])
    text, begin, end = "one two", np.array([0, 4]), np.array([3, 7])
    hashes = np.array([1, 2], np.uint64)
    assert codes.lookup(text, begin, end, hashes)[1].tolist() == [3, 3] and codes.n == 2
    model = toxicity.Model(np.linspace(-1, 1, toxicity.BUCKETS), 0.1)
    scorer = toxicity._Scorer(model)
    first = scorer.scores(["one two", "three"])
    assert codes.n == 0 and len(scorer.keys) == 3
    assert codes.lookup(text, begin, end, hashes)[1].tolist() == [3, 3] and not len(scorer.keys)
    assert (scorer.scores(["one two", "three"]) == first).all()
