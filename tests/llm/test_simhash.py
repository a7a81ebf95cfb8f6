import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from daymosaic.llm import simhash

from .conftest import ODD


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs, radius=4):
    prints = [slow_fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted([(d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(docs, prints, strict=True))], key=repr)


def run(docs, radius=4):
    return sorted([(r["doc_id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in simhash.simhash_groups(docs, radius).collect()], key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, docs_of, seed):
    rng = random.Random(seed)
    docs = list(ODD)
    for i in range(8):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 200]))]
        for j in range(12):
            copy = list(base)
            for _ in range(j // 2):
                copy[rng.randrange(len(copy))] = f"u{rng.randrange(999)}"
            docs.append((1000 - 12 * i - j, " ".join(copy)))
    assert run(docs_of(docs)) == brute(docs)


def test_chains_and_hot_groups_are_whole(spark):
    """Fingerprints in a chain of 4-bit steps, a dense ball of many, and random ones; against all pairs."""
    rng = np.random.default_rng(5)
    chain = [0]
    for i in range(30):
        chain.append(chain[-1] ^ (0b1111 << (4 * i % 61)))
    centre = int(rng.integers(1 << 62))
    ball = [centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 7)), replace=False)) for _ in range(400)]
    noise = rng.integers(-(1 << 62), 1 << 62, 300).tolist()
    signed = lambda x: int(np.uint64(x & (2**64 - 1)).astype(np.int64))
    prints = sorted({signed(x) for x in chain + ball + noise})
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.group_rows(df).collect()}
    a = np.array(prints)
    near = np.array([[((x ^ y) & (2**64 - 1)).bit_count() <= 4 for y in prints] for x in prints])
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None], len(a)).min(1)
        if (new == label).all():
            break
        label = new
    assert got == dict(zip(prints, label.tolist(), strict=True))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_near_prints_share_a_variant(x, bits):
    """The keys as cells and their variants make them: a segment without a third, and the third with one bit left out."""
    def keys(f):
        return {(i, f & mask & ~(((1 << n) - 1) << at), f & (((1 << n) - 1) << at) & ~(1 << (at + j)), j) for i, (mask, at, n) in enumerate(simhash.thirds(4)) for j in range(n)}

    y = x
    for b in bits:
        y ^= 1 << b
    assert len(simhash.segments(4)) == 3 and len(simhash.thirds(4)) == 9 and keys(x) & keys(y)


def test_cells_of_signed_prints(spark):
    prints = [-1, 0, 1, -(1 << 63), (1 << 63) - 1, 123456789]
    made = spark.createDataFrame([(p,) for p in prints], "fp long").select("fp", F.explode(F.array(*simhash.cells(F.col("fp")))).alias("c")).collect()
    want = {(p, i, (p & (2**64 - 1)) & mask & ~(((1 << n) - 1) << at)) for p in prints for i, (mask, at, n) in enumerate(simhash.thirds(4))}
    assert {(r["fp"], r["c"]["kind"], r["c"]["cell"] & (2**64 - 1)) for r in made} == want and len(made) == 9 * len(prints)


def all_pairs(prints):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, x in enumerate(prints):
        for j in range(i):
            if ((x ^ prints[j]) & (2**64 - 1)).bit_count() <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, x in enumerate(prints):
        least[root(i)] = min(least.get(root(i), x), x)
    return {x: least[root(i)] for i, x in enumerate(prints)}


def test_distance_counts_the_highest_bit():
    a = np.array([-(1 << 63) + 1, -1, 5], np.int64)
    assert simhash.distance(a, np.int64(0)).tolist() == [2, 64, 2]


def test_large_buckets_are_cut_again(spark, monkeypatch):
    """Prints that share a segment, so that all fall into one bucket of each of its variants; and its pairs across segments."""
    monkeypatch.setattr(simhash, "LARGE", 30)
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = np.random.default_rng(3)
    fixed = int(rng.integers(1 << 21))
    base = [(int(rng.integers(1 << 43)) << 21) | fixed for _ in range(150)]
    near = [b ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, 6)), replace=False)) for b in base for _ in range(2)]
    prints = np.array(sorted({x & (2**64 - 1) for x in base + near}), np.uint64).view(np.int64)
    label = {int(p): int(p) for p in prints}
    found = []
    for i, (mask, at, n) in enumerate(simhash.thirds(4)):
        cell = prints & np.int64(simhash._signed(mask & ~(((1 << n) - 1) << at)))
        order = np.argsort(cell, kind="stable")
        own = prints[order]
        found += [(own[a], own[b]) for a, b in simhash.cell_edges(np.full(len(own), i), cell[order], own, 4, lambda x, y, own=own: simhash.distance(own[x], own[y]) <= 4)]
    parent = dict(label)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        for x, y in zip(np.atleast_1d(a).tolist(), np.atleast_1d(b).tolist(), strict=True):
            assert ((x ^ y) & (2**64 - 1)).bit_count() <= 4
            parent[max(root(x), root(y))] = min(root(x), root(y))
    want = all_pairs(prints.tolist())
    assert {x: root(x) for x in label} == want and len(set(want.values())) < len(want)


def test_whole_cells_keep_runs_together():
    rng = np.random.default_rng(1)
    kind = np.sort(rng.integers(0, 3, 5000)).astype(np.int32)
    cell = np.concatenate([np.sort(rng.integers(0, 40, n)) for n in np.bincount(kind)])
    batches = [pa.RecordBatch.from_arrays([pa.array(kind[a:z]), pa.array(cell[a:z])], names=["kind", "cell"]) for a, z in zip([0, 7, 7, 40, 900, 901, 905, 3000], [7, 7, 40, 900, 901, 905, 3000, 5000], strict=True)]
    out = list(simhash.whole_cells(iter(batches), 100))
    assert np.array_equal(np.concatenate([o[1] for o in out]), cell) and len(out) >= 3
    for a, b in zip(out, out[1:], strict=False):
        assert (a[0][-1], a[1][-1]) != (b[0][0], b[1][0])


def test_one_document_of_each_group_stays(spark, docs_of):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    docs = docs_of([(5, a), (3, a), (3, a), (4, b), (None, b), (9, " "), (8, None), (None, "q r s t u")])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == [3, 4, 8, None]


def test_empty_table(spark, docs_of):
    assert run(docs_of([(1, "a")]).limit(0)) == []
    assert simhash.drop_near_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0
