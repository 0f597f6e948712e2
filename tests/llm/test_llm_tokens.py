"""Token operators against the public libraries, and exact tiling and round trips."""
import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from monthloom.llm.byte_pairs import decode, encode
from monthloom.llm.packing import Example, Packer, pack
from monthloom.llm.textcodes import SegmentCodes, first_indices, pretokens, safe_pieces, slices
from monthloom.llm.token_store import TokenStore, build_hash, hash_slots
from monthloom.llm.tokens import merge_bytes, read_ranks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    signs = list("  \n'strevlmdS1½é!日aİ") + ["́"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 3000))) for _ in range(25)]
    return [None, "", " ", "'", "it's we'll 'tis", "x" * 5000, "word " * 3000, " " * 4000, "same",
            "same", "İ! É É á", "<|endoftext|> x", *made]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 11 else None, t, "a", 1, i) for i, t in enumerate(texts())]
    rows += rows[3:6]  # repeated rows
    return spark.createDataFrame(
        rows, "doc_id long, text string, ids string, row_id int, sequence_id int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def load(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def tik():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_pretokens_equal_the_pattern():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    for t in filter(None, texts()):
        piece = next(slices([t], limit=1 << 30))
        assert pretokens(piece).tolist() == [m.start() for m in pattern.finditer(t)]


def test_long_texts_are_cut_without_loss():
    t = "ab cd " * 500
    parts = safe_pieces(t, 100)
    assert len(parts) > 5 and "".join(parts) == t
    assert safe_pieces("x" * 1000, 100) == ["x" * 1000]


def test_segment_table_starts_anew_when_full():
    codes = SegmentCodes(lambda words: [[len(w)] for w in words], most=2)
    for w in ("a", "bb", "ccc", "dddd", "a"):
        size, flat = codes.lookup(w, np.array([0]), np.array([len(w)]),
                                  np.array([hash(w)], np.int64).view(np.uint64))
        assert size.tolist() == [1] and flat.tolist() == [len(w)]


def test_merges_equal_the_library_on_long_pretokens():
    ranks, library = read_ranks(RANKS), tik()
    rng = random.Random(1)
    for n in (1, 5, 64, 65, 700):
        word = "".join(rng.choice("abé") for _ in range(n))
        assert merge_bytes(word.encode(), ranks) == library.encode_ordinary(word)


@pytest.mark.parametrize("chunk", [1024, 32_768])
def test_byte_pairs_equal_the_library(docs, chunk):
    library = tik()
    want = sorted((r.doc_id or -1, library.encode_ordinary(r.text or "")) for r in docs.collect())
    rows = decode(encode(docs, RANKS, chunk=chunk), RANKS).collect()
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    assert sorted(hashlib.sha256(r.decoded).hexdigest() for r in rows) == sorted(
        hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)


def test_store_reads_back_what_the_library_encodes(spark, docs, empty):
    library = load(BYTES)
    want, start = [], 0
    ordered = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()),
                     key=lambda x: x[:2])
    store = TokenStore(spark, docs, BYTES, keys_per_part=7)
    got = store.get(docs)
    assert got.count() == docs.count()
    seen = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.ids_crc32)
                   for r in got.collect()), key=lambda x: x[0])
    for s, key, ids, crc in seen:
        assert s == start and ids[-1] == 0 and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    lists = sorted(library.encode(t, add_special_tokens=False).ids + [0] for _, _, t in ordered)
    assert sorted(x[2] for x in seen) == lists
    assert [x[1] or 0 for x in seen] == [k for _, k, _ in ordered]
    absent = spark.createDataFrame([(10 ** 9,), (5,)], "doc_id long")
    assert {r.doc_id for r in store.get(absent).collect()} == {5}
    assert TokenStore(spark, empty, BYTES).get(empty).count() == 0


def test_minimal_perfect_hash_is_a_bijection():
    keys = np.unique(np.random.default_rng(0).integers(0, 2 ** 63, 5000)).astype(np.uint64)
    table = build_hash(keys)
    assert sorted(hash_slots(table, keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        build_hash(np.array([7, 7], np.uint64))
    assert hash_slots(build_hash(keys[:0]), keys[:3]).tolist() == [-1] * 3


def tiles(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at and length > 0
        at += length
    return at


def test_packing_tiles_documents_and_sequences(docs, empty):
    library = load(WORDS)
    rows = pack(docs, WORDS).collect()
    sequences, total = {}, 0
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        total += r.length
    ends = [tiles(x) for x in sequences.values()]
    assert all(n <= 4096 and n & (n - 1) == 0 for n in ends)
    want = [library.encode(r.text or "", add_special_tokens=False).ids + [2]
            for r in docs.collect()]
    assert total == sum(map(len, want))
    unique = {r.doc_id for r in rows if r.doc_id}
    source = {r.doc_id: i for i, r in enumerate(docs.collect())}
    for key in sorted(unique - {3, 4, 5}):  # those three are repeated
        parts = {(r.start, r.ids) for r in rows if r.doc_id == key}
        joined = b"".join(ids for _, ids in sorted(parts))
        assert np.frombuffer(joined, "<u4").tolist() == want[source[key]]
    assert pack(empty, WORDS).count() == 0


@pytest.mark.parametrize("limits", [(64, 4, 20), (64, 64, 64), (16, 1, 5)])
def test_vector_packing_keeps_all_limits(limits):
    tokens, segments, loss = limits
    rng = np.random.default_rng(3)
    examples = []
    for i in range(200):
        n = int(rng.integers(1, 90))
        examples.append(Example(i, np.arange(n, dtype="<u4"), int(rng.integers(0, n + 1))))
    pieces = []
    packer = Packer(lambda *p: pieces.append(p), tokens, segments, loss, pool=32)
    for e in examples:
        packer.add(e)
    packer.finish()
    by_doc, by_sequence = {}, {}
    for e, start, length, sequence, offset in pieces:
        by_doc.setdefault(e.key, []).append((start, length))
        bears = sum(1 for t in range(start, start + length) if t >= len(e.ids) - e.loss)
        by_sequence.setdefault(sequence, []).append((offset, length, bears))
    assert {k: tiles(v) for k, v in by_doc.items()} == {e.key: len(e.ids) for e in examples}
    for parts in by_sequence.values():
        assert tiles([p[:2] for p in parts]) <= tokens
        assert len(parts) <= segments and sum(p[2] for p in parts) <= loss
    with pytest.raises(ValueError):
        Packer(print, 0)


def test_loss_share_column_may_be_null(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (2, "d e", 0.5)],
                                 "doc_id long, text string, share double")
    assert sum(r.length for r in pack(docs, WORDS, loss="share", max_loss=3).collect()) == 7
