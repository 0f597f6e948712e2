"""Language identification: held-out accuracy, plain n-gram counts, a plain trainer, odd rows."""
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__ as entry
from monthloom.llm import language
from monthloom.llm.language import BUCKETS, Model, Scorer, fit_temperature, gram_counts, train
from tests.conftest import MEDIUM

ODD = [None, "", " 12 !?", "the cat sat on the mat", "le chat est sur la table", "É", "x" * 60_000,
       "the the " * 20_000, "日本語のテキスト", "the cat sat on the mat", "…", "a\x00b"]


def test_held_out_accuracy_and_contract(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = entry.queries()["op11_language"](spark, MEDIUM).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    held = [r for r in rows if r.held_out]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        text = docs[r.doc_id].text
        assert (r.lang_pred == "und") == (not regex.search(r"\p{L}", text or ""))
    right = np.mean([r.lang_pred == docs[r.doc_id].lang for r in held])
    assert right >= 0.98
    # Calibrated: the mean score is close to the share that is right.
    assert abs(np.mean([r.score for r in held]) - right) < 0.05


def plain_counts(text):
    out = Counter()
    for word in regex.findall(r"\p{L}+", text.lower()):
        framed = f"\x02{word}\x02"
        out.update(g for n in language.N_GRAMS for g in
                   (framed[i: i + n] for i in range(len(framed) - n + 1)) if g != "\x02")
    return out


def test_gram_counts_equal_plain_counting():
    texts = ["Ab ab.c", "", "éa1é", "zz zz zz", "…"]
    got = {}
    for first, _, doc, _, count in gram_counts(texts):
        for d, c in zip(doc.tolist(), count.tolist()):
            got.setdefault(first + d, []).append(c)
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(plain_counts(text).values())


def plain_leader(rows, labels, kinds, rounds, rate, l1, l2, order):
    """The same trainer one weight at a time, batches of one."""
    z, n = {}, {}

    def weight(k, penalty):
        a, b = z.get(k, 0.0), n.get(k, 0.0)
        if abs(a) <= penalty:
            return 0.0
        return (np.sign(a) * penalty - a) / ((1 + np.sqrt(b)) / rate + l2)

    for turn in range(rounds):
        for i in order[turn]:
            keys = [*rows[i], ("bias", 1.0)]
            w = {(f, c): weight((f, c), 0.0 if f == "bias" else l1)
                 for f, _ in keys for c in range(kinds)}
            logits = np.array([sum(v * w[f, c] for f, v in keys) for c in range(kinds)])
            p = np.exp(logits - logits.max())
            p /= p.sum()
            for f, v in keys:
                for c in range(kinds):
                    g = v * (p[c] - (labels[i] == c))
                    before = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - (
                        np.sqrt(before + g * g) - np.sqrt(before)) / rate * w[f, c]
                    n[f, c] = before + g * g
    return lambda f, c: weight((f, c), 0.0 if f == "bias" else l1)


def test_trainer_equals_a_plain_one_and_is_sparse():
    rng = np.random.default_rng(5)
    rows = [[(int(f), float(v)) for f, v in zip(rng.choice(12, 4, False), rng.random(4))]
            for _ in range(30)]
    labels = rng.integers(0, 3, 30)
    starts = np.arange(0, 121, 4)
    buckets = np.array([f for r in rows for f, _ in r])
    values = np.array([v for r in rows for _, v in r])
    got, bias = train(starts, buckets, values, labels, 3, rounds=2, batch=1, rate=0.5, l1=0.4,
                      l2=0.01, seed=4)
    again = np.random.default_rng(4)
    want = plain_leader(rows, labels, 3, 2, 0.5, 0.4, 0.01,
                        [again.permutation(30) for _ in range(2)])
    for f in range(12):
        assert np.allclose(got[f], [want(f, c) for c in range(3)], atol=1e-12)
    assert np.allclose(bias, [want("bias", c) for c in range(3)], atol=1e-12)
    assert (got[:12] == 0).any() and (got[:12] != 0).any() and not got[12:].any()


def test_temperature_is_found():
    rng = np.random.default_rng(6)
    logits = rng.normal(size=(20_000, 3)) * 2
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = (rng.random(20_000)[:, None] > p.cumsum(axis=1)).sum(axis=1)
    assert abs(fit_temperature(logits * 4, labels) - 4) < 0.2


def test_word_cache_changes_nothing():
    rng = np.random.default_rng(7)
    model = Model(["a", "b"], rng.normal(size=(BUCKETS, 2)), np.zeros(2), 1.5)
    texts = [t or "" for t in ODD]
    fresh, small = Scorer(model), Scorer(model, most=3)
    one = fresh.score(texts)
    for _ in range(2):
        for i, t in enumerate(texts):
            names, score = small.score([t])
            assert names[0] == one[0][i] and abs(score[0] - one[1][i]) < 1e-9


@pytest.mark.parametrize("langs", [["en", "fr"], ["en", "en"], [None, None]])
def test_odd_rows(spark, langs):
    rows = [(i if i % 5 else None, t, langs[i % 2] if i % 7 else None, 0.5, "q")
            for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = language.fit(docs, F.lit(True), sample=50)
    got = language.predict(docs.repartition(3), model).collect()
    assert len(got) == len(ODD)
    known = {x for x in langs if x}
    for r in got:
        assert r.lang_pred in known | {"und"} and 0 <= r.score <= 1
        if r.lang_pred == "und":
            assert r.score == 0
    assert sum(r.lang_pred == "und" for r in got) == (4 if known else len(ODD))
    assert language.predict(docs.limit(0), model).count() == 0
    assert language.fit(docs.limit(0), F.lit(True)).languages == []


def test_sample_is_bounded_when_one_row_repeats(spark):
    docs = spark.createDataFrame([(1, "the same text", "en")] * 500 + [(2, "un autre texte", "fr")],
                                 "doc_id long, text string, lang string")
    drawn = language._sampled(docs.toDF("key", "text", "lang"), 10).collect()
    assert len(drawn) == 2
