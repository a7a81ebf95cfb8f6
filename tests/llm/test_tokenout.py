import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from daymosaic.llm import tokenout as t

from .conftest import ODD

TOKENIZERS = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module")
def path():
    return t.default_tokenizer()


STRANGE = ["Don't stop!!! I'll go, it's 'tis <|endoftext|> x<|startoftext|>y café CAFÉ ẖ H̱ İ İ Σας ΟΔΟΣ 日本語 😀👍 ﬁ ½ a\x00b \x1f  z ǄÀÉ <| foo", "", "  ", "x" * 3000, "ÄÖ\u0085ü µ ª", "12 3,4 a1b2 ***a&&& b.."]


@pytest.mark.parametrize("most", [10, 10_000])
def test_chunks_give_the_same_ids_as_whole_texts(path, most):
    cache, rng = t.ChunkCache(path, most), random.Random(1)
    words = [w for s in STRANGE for w in s.split()] + ["The", "the.", "ñandú,", "foo", "Bar"]
    batches = [STRANGE, [" ".join(rng.choices(words, k=40)) for _ in range(60)], STRANGE + [None]]
    for texts in batches:
        ids, sizes = cache.encode(pa.array(texts, pa.string()))
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [cache.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(path, text):
    cache = t.cache_for(path)
    text = text.encode("utf-8", "ignore").decode()
    ids, sizes = cache.encode(pa.array([text, text]))
    want = cache.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want + want and sizes.tolist() == [len(want)] * 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), max_size=30), min_size=1, max_size=12), st.sampled_from([4, 16]))
def test_round_trip(lists, lanes):
    flat = np.array([x for s in lists for x in [*s, 2]], np.uint32)
    tokens, counts = np.unique(flat, return_counts=True)
    table = t.Table.from_bytes(t.Table.fit(tokens, counts).to_bytes())
    raw = t.pack_file([None, *range(len(lists) - 1)], np.array([len(s) + 1 for s in lists]), flat, table, 3, block=32, lanes=lanes)
    f = t.TokenFile(raw + b"\n", table)
    assert f.blocks().tolist() == flat.tolist() and f.nulls[0] and f.head["ordinal"] == 3
    for i in range(len(f.index)):  # each block on its own
        at = int(f.index["first_token"][i])
        assert f.blocks(i, i + 1).tolist() == flat[at : at + 32].tolist()


def test_damage_is_noticed_and_size_is_near_the_entropy():
    rng = np.random.default_rng(0)
    flat = rng.geometric(0.02, 200_000).astype(np.uint32)
    tokens, counts = np.unique(flat, return_counts=True)
    table = t.Table.fit(tokens, counts)
    assert int(table.freq.sum()) == 1 << table.scale and (table.freq > 0).all()
    raw = t.pack_file([1], np.array([len(flat)]), flat, table, 0)
    p = counts / counts.sum()
    assert len(raw) * 8 < 1.02 * len(flat) * -(p * np.log2(p)).sum() + 60_000
    for at in (30, 60, len(raw) - 5):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            t.TokenFile(bytes(bad), table).blocks()


def test_one_symbol():
    flat = np.full(1000, 7, np.uint32)
    table = t.Table.fit(np.array([7]), np.array([1000]))
    assert t.TokenFile(t.pack_file([1], np.array([1000]), flat, table, 0), table).blocks().tolist() == flat.tolist()


@pytest.mark.parametrize("name", TOKENIZERS)
def test_files_hold_all_documents_in_order(spark, docs_of, tmp_path, monkeypatch, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(t, "FILE_TOKENS", 2000)
    tokenizer = public_tokenizers.path(name)
    rows = [*ODD, *[(50 - i, f"Document number {i}, with words. " * (i % 7)) for i in range(40)]]
    out = t.token_output(docs_of(rows), tokenizer, tmp_path.as_uri()).collect()
    plain = Tokenizer.from_file(tokenizer)
    want, start = [], 0
    ids = [(d, [*plain.encode(x or "", add_special_tokens=False).ids, 2]) for d, x in rows]
    for d, own in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((d, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted([tuple(r) for r in out], key=lambda r: r[1]) == want
    read = {r["doc_id"]: r["ids"] for r in t.read_tokens(spark, tmp_path.as_uri(), with_ids=True).collect()}
    assert read[50] == [2] and read[100] == [2] and read[49] == dict(ids)[49]
    assert len(list((tmp_path / "files").glob("part-*"))) > 3


def test_a_hot_id_is_cut_into_files(spark, tmp_path, monkeypatch):
    """Null ids, one hot id with different texts, and equal rows of it, in many files whose tokens follow each other."""
    import public_tokenizers

    monkeypatch.setattr(t, "FILE_TOKENS", 2000)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = [*[(None, f"text {i}") for i in range(1000)], *[(7, "the same text") for _ in range(1500)], *[(7, f"other {i}") for i in range(500)], (9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted((tuple(r) for r in t.token_output(docs, tokenizer, tmp_path.as_uri()).collect()), key=lambda r: r[1])
    assert [d for d, *_ in out] == [None] * 1000 + [7] * 2000 + [9] and out[0][1] == 0
    assert all(b[1] == a[1] + a[2] for a, b in zip(out, out[1:], strict=False))
    sizes = [r["n"] for r in t.read_tokens(spark, tmp_path.as_uri()).groupBy("ordinal").agg(F.sum("n_tokens").alias("n")).collect()]
    assert len(sizes) > 3 and max(sizes) < sum(sizes) / 2


def test_starts_of_many_files(spark):
    files = spark.createDataFrame([(i, i % 5 + 1) for i in range(40)], "ordinal long, n long")
    got = {r["ordinal"]: r["base"] for r in t.file_starts(files, 7).collect()}
    assert got == {i: sum(j % 5 + 1 for j in range(i)) for i in range(40)}


def test_empty_table(spark, docs_of, path):
    assert t.token_output(docs_of([(1, "a")]).limit(0), path).count() == 0
