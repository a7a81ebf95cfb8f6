import random

import corpus_pipeline
import pytest
from daymosaic.llm import nearcopies

from .conftest import ODD


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(docs, least=0.8):
    """The smallest doc_id of each group that links of all pairs make; nulls last."""
    sets, group = [grams(t) for _, t in docs], list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                group[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        best.setdefault(root(i), []).append((d is None, d or 0))
    return sorted(None if none else d for none, d in (min(x) for x in best.values()) if not none), sum(min(x)[0] for x in best.values())


def planted(seed):
    """Originals, copies at similarities of 0.6 to 1, and copies of copies."""
    rng, docs, near = random.Random(seed), [], 0
    for i in range(40):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([60, 150, 400, 1200]))]
        docs.append((100 * i, " ".join(base)))
        for j in range(1, 6):
            copy = list(base if j < 5 else docs[-1][1].split())
            for _ in range(max(1, int(len(base) * rng.uniform(0.002, 0.05)))):
                copy[rng.randrange(len(copy))] = f"u{rng.randrange(999)}"
            docs.append((100 * i + j, " ".join(copy)))
            near += 0.8 <= jaccard(grams(docs[-1][1]), grams(" ".join(base))) < 0.95
    return docs, near


def test_the_stage_drops_copies_from_0_8_on(spark, docs_of):
    docs, near = planted(1)
    assert near > 40
    kept = corpus_pipeline.near_duplicates(spark, docs_of(docs), "")
    assert kept.columns == docs_of(docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(docs)[0]


def test_odd_texts_and_large_groups(spark, docs_of):
    base = [f"b{i}" for i in range(100)]
    chain = [(2000 + i, " ".join(base[i:] + [f"c{j}" for j in range(i)])) for i in range(0, 60, 2)]
    group = [(3000 + i, " ".join([*base[:50], f"x{i}", *(f"d{j}" for j in range(60))])) for i in range(80)]
    docs = [d for d in ODD + chain + group + [(None, None)] if d[0] != 104]
    got = [r["doc_id"] for r in nearcopies.drop_near_copies(docs_of(docs)).collect()]
    ids, nulls = brute(docs)
    assert sorted(d for d in got if d is not None) == ids and got.count(None) == nulls


def test_empty(spark, docs_of):
    assert nearcopies.drop_near_copies(docs_of([(1, "a")]).limit(0)).count() == 0


def test_a_large_group_is_not_compared_in_pairs(spark, docs_of, monkeypatch):
    """Copies of one text that are less similar than 0.8 to each other, and some that are not."""
    rng, base, docs = random.Random(3), [f"b{i}" for i in range(150)], []
    for i in range(500):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([2, 5, 6, 7])):
            copy[at] = f"u{i}x{at}"
        docs.append((i, " ".join(copy)))
    tested, similar = [], nearcopies.similar
    monkeypatch.setattr(nearcopies, "similar", lambda pairs, *rest: tested.append(pairs.count()) or similar(pairs, *rest))
    kept = sorted(r["doc_id"] for r in nearcopies.drop_near_copies(docs_of(docs)).collect())
    assert kept == brute(docs)[0] and 100 < len(kept) < 400
    assert sum(tested) < 20 * len(docs)  # there are 124,750 pairs


def test_pairs_grow_with_a_group_not_with_its_square(spark):
    """One text's near copies, and as many again that links have left apart though a few are as similar to the text."""
    rng, sets, roots = random.Random(3), {0: set(range(146))}, {0: 0}
    for i in range(1, 600):
        gone = rng.randint(1, 10) if i < 300 else rng.randint(8, 18)
        sets[i] = set(rng.sample(range(146), 146 - gone)) | {1000 * i + j for j in range(gone)}
        roots[i] = 0 if i < 300 else i
    own = spark.createDataFrame([(x, 7, roots[x], 0, 600) for x in sets], "node long, family long, root long, main long, members long")
    table = spark.createDataFrame([(x, sorted(s)) for x, s in sets.items()], "node long, hashes array<long>")
    found = {(r["u"], r["v"]) for r in nearcopies.alike(own, table, 0.8).collect()}
    assert {(i, 0) for i in range(300, 600) if jaccard(sets[i], sets[0]) >= 0.8} <= found
    assert len(found) < 5 * len(sets)


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_pairs_connect_all_that_are_similar(spark, least):
    """Families with a middle, without one, with several, and of sets that differ in size; some nodes are linked before."""
    rng, sets, family = random.Random(5), {}, {}
    for f in range(12):
        kinds = [{rng.randrange(10**9) for _ in range(rng.choice([10, 40, 100]))} for _ in range(rng.choice([1, 2, 6]))]
        for _ in range(50):
            base = sorted(rng.choice(kinds))
            own = set(rng.sample(base, rng.randint(len(base) * 6 // 10, len(base)))) | {rng.randrange(10**9) for _ in range(rng.randrange(len(base) // 4))}
            family[len(sets)] = f
            sets[len(sets)] = own
    group = {x: x for x in sets}

    def root(x):
        return x if group[x] == x else root(group[x])

    links = [(a, b) for a in sets for b in range(a) if family[a] == family[b] and jaccard(sets[a], sets[b]) >= least]
    for a, b in rng.sample(links, len(links) // 20):
        group[root(a)] = root(b)
    roots = {x: root(x) for x in sets}
    for a, b in links:
        group[root(a)] = root(b)
    wanted = {x: root(x) for x in sets}
    own = spark.createDataFrame([(x, family[x], roots[x], 50) for x in sets], "node long, family long, root long, members long")
    table = spark.createDataFrame([(x, sorted(s)) for x, s in sets.items()], "node long, hashes array<long>")
    group = dict(roots)
    for r in nearcopies.similar(nearcopies.alike(own, table, least), table, least).collect():
        assert r["u"] > r["v"] and (r["u"], r["v"]) in set(links)
        group[root(r["u"])] = root(r["v"])
    got = {x: root(x) for x in sets}
    assert len({(got[x], wanted[x]) for x in sets}) == len(set(wanted.values())) == len(set(got.values()))
    assert len(set(roots.values())) > len(set(got.values())) > 12
