"""The pipeline: its stages on odd rows, and the whole against a brute-force composition."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from monthloom.llm import quality, toxicity
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def odd(spark):
    good = " ".join(f"word{i} runs" for i in range(60))
    rows = [(1, good, "en", "s", 5), (2, good, "en", "s", 5), (2, good, "en", "s", 5),
            (None, good, None, None, None), (None, None, None, None, None), (3, "", "en", "s", 0),
            (4, good + " tail", "en", "s", 9), (5, "other text", "de", "t", 10)]
    extra = [(*r, "k", 0.1) for r in rows]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_chars long, "
               "`__id` string, score double")


def test_stages_keep_the_columns_and_survive_odd_rows(spark, odd):
    docs = odd
    for name, step in corpus_pipeline.STAGES[2:4]:
        out = step(spark, docs.drop("__id"), SMALL)
        assert out.columns == docs.drop("__id").columns, name
    for _, step in corpus_pipeline.STAGES[:2]:
        out = step(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() <= docs.count()
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), SMALL).count() == 0


def test_one_of_each_class_stays(spark, odd):
    kept = corpus_pipeline.keep_one_of_each(spark, odd.drop("__id"), SMALL).collect()
    assert sorted(((r.doc_id, (r.text or "")[-4:]) for r in kept), key=str) == sorted(
        [(1, "runs"), (None, ""), (3, ""), (5, "text")], key=str)


def test_repeats_are_cut_and_counted(spark, odd):
    rows = corpus_pipeline.cut_repeats(spark, odd, SMALL).collect()
    assert len(rows) == odd.count()
    assert {r.text for r in rows} == {"", " tail", "other text"}
    assert all(r.n_chars == len(r.text) for r in rows)


def test_whole_run_equals_a_composition_by_hand(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().sort_values("doc_id")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().set_index("doc_id")

    def trained(module, rows, label, modulus, rest):
        known = rows[rows.doc_id.isin(labels.index)]
        crc = known.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % modulus)
        known = known[crc != rest]
        y = labels.loc[known.doc_id, label].to_numpy(float)
        if module is quality:
            return quality.grow(quality.statistics(known.text.tolist()), y).scores(
                quality.statistics(rows.text.tolist()))
        return toxicity._Scorer(toxicity.train(known.text.tolist(), y)).scores(rows.text.tolist())

    docs = docs[trained(toxicity, docs, "toxic", 3, 1) < 0.7]
    docs = docs[trained(quality, docs, "quality", 4, 2) >= 0.7]
    sets = []
    for t in docs.text:
        w = t.lower().split()
        sets.append(frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    docs = docs[[find(i) == i for i in range(len(sets))]]
    seen, kept = {}, []
    data = [t.encode() for t in docs.text]
    for b in data:
        for p in range(len(b) - 399):
            seen[b[p: p + 400]] = seen.get(b[p: p + 400], 0) + 1
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p: p + 400]] > 1:
                gone[p: p + 400] = True
        kept.append(bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    want = {i: library.encode(t, add_special_tokens=False).ids + [2]
            for i, t in zip(docs.doc_id, kept)}

    got = {}
    for r in entry.queries()["pipeline"](spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {k: [x for _, ids in sorted(v) for x in ids] for k, v in got.items()} == want
