import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daymosaic.llm import mixing, toxicity

from ..conftest import same_rows
from .conftest import ODD
from .test_models import slow_scores
from .test_nearcopies import brute as slow_copies


def slow_targets(sizes):
    """By rounds: share by weight, stop those above twice their size, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "a", "a", "a", "B", "c", "é", None, "z"])
        rows.append((i, "w " * rng.choice([0, 1, 5, 80]) + rng.choice(["", "### ***"]), source))
    rows += [(700, None, "empty"), (701, "", "empty"), (5, "again and again", "c"), (None, "x y z", "c")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).withColumns({"key": F.lit(1), "size": F.lit(2), "target": F.lit(3), "src": F.lit(4)})


@pytest.mark.parametrize("cells", [1, 17, 5000])
def test_mix_reaches_targets(spark, sources, monkeypatch, cells):
    monkeypatch.setattr(mixing, "cells_for", lambda rows: cells)
    rows, df = sources
    got = mixing.taken_words(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = slow_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2, s
    for s in sizes:  # complete epochs come first, and at most one document is cut
        ratios = [r["taken"] / r["size"] for r in got if r["source"] == s and r["size"]]
        assert not ratios or max(ratios) - min(ratios) <= 1 and sum(x not in (0, 1, 2) for x in ratios) <= 1


def test_mix_is_the_same_however_rows_lie(spark, sources):
    _, df = sources
    once, again = (sorted((tuple(r) for r in mixing.taken_words(d).collect()), key=repr) for d in (df, df.repartition(7)))
    assert once == again
    other = sorted((tuple(r) for r in mixing.taken_words(df, seed=1).collect()), key=repr)
    assert other != once


def test_targets_of_many_sources(spark, monkeypatch):
    """Sums by ranges give what one window gives."""
    rng = random.Random(5)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 40, 3000]) for i in range(400)} | {None: 77}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    once = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert once == pytest.approx(slow_targets(sizes))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10)
    assert {r["source"]: r["target"] for r in mixing.source_targets(df).collect()} == once


def test_a_column_of_weights(spark, sources):
    rows, df = sources
    given = df.withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 50.0).otherwise(F.lit(None)))
    got = mixing.taken_words(given, weight="quality").collect()
    plain = mixing.taken_words(df).collect()
    total = lambda rs: Counter({s: sum(r["taken"] for r in rs if r["source"] == s) for s in {r["source"] for r in rs}})
    assert total(got) == total(plain)  # a column changes which documents are taken, not how much
    # Only the largest source is sampled; of the others all documents are taken twice.
    heavy = lambda rs: sum(r["taken"] for r in rs if r["source"] == "a" and r["doc_id"] % 2 == 0)
    assert heavy(got) > 1.1 * heavy(plain) and mixing.mix(given, weight="quality").columns == given.columns


def test_heavier_documents_come_earlier(spark):
    keys = spark.range(20_000).select(mixing.sampling_key(F.col("id"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25), 0).alias("k"), (F.col("id") % 2).alias("light"))
    first = keys.orderBy("k").limit(4000).groupBy("light").count().collect()
    heavy = {r["light"]: r["count"] for r in first}
    assert heavy[0] / heavy[1] == pytest.approx(3.5, rel=0.15)
    assert keys.where("light = 0").agg(F.avg("k")).first()[0] == pytest.approx(1, rel=0.05)


def test_mixed_rows_keep_their_columns(spark, sources):
    rows, df = sources
    got = mixing.mix(df)
    assert got.columns == df.columns
    words = Counter()
    for r in got.collect():
        words[r["source"]] += len((r["text"] or "").split())
    targets = slow_targets({s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {r[2] for r in rows}})
    assert all(abs(words[s] - t) <= 82 for s, t in targets.items())


def test_odd_and_empty_tables(spark, docs_of):
    docs = docs_of(ODD)
    assert mixing.taken_words(docs).count() == len(ODD) and mixing.mix(docs).columns == docs.columns
    assert mixing.taken_words(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_query_equals_sql(spark, sf, duck):
    assert same_rows(mixing.query(spark, sf), duck, mixing.SQL)


def test_quality_weights(spark):
    df = spark.createDataFrame([("plain words",), ("###",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(mixing.quality_weight(F.col("t"))).collect()] == pytest.approx([1.0, 0.1, 0.1, 0.1])


# --- pipeline ---


def test_stages_against_brute_force(spark, sf):
    """Each stage on its own input: what the slow versions keep, and all columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "decontamination", "mixing", "tokens"] and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert kept.columns == docs.columns
        pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
            learnt = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1 and i in dict(pairs)}
            copies = toxicity.copies([toxicity.sketch([w for w in words_of(dict(pairs)[i])]) for i in learnt])
            assert len(set(copies.tolist())) <= len(learnt)
            scores = slow_scores(dict(pairs), learnt, groups=dict(zip(learnt, copies.tolist(), strict=True)))
            assert got == sorted(d for d, _ in pairs if scores[d] < 0.7)
        elif name == "simhash":
            assert got == slow_copies(pairs)[0]
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {d for d, _, hit, _ in slow_contamination_fast(pairs, items) if hit}
            assert got == sorted(d for d, _ in pairs if d not in bad)
        else:
            # What op9 takes of each document, whose sums and targets have a slow version above, in whole documents.
            taken = {r["doc_id"]: r for r in mixing.taken_words(docs).collect()}
            copies, cut = Counter(got), Counter()
            for d, r in taken.items():
                whole, part = divmod(r["taken"], r["size"]) if r["size"] else (1, 0)
                assert copies[d] in ({whole} if not part else {whole, whole + 1})
                cut[r["source"]] += part > 0
            assert max(cut.values(), default=0) <= 1 and max(copies.values()) <= 2 and len(got) > len(pairs)
        docs = kept
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = sorted((tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()), key=lambda r: r[1])
    ids = [(r["doc_id"], [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    assert [r[0] for r in out] == sorted(d for d, _ in ids)
    assert Counter((d, n, crc) for d, _, n, crc in out) == Counter((d, len(x), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))) for d, x in ids)
    start = 0
    for r in out:
        assert r[1] == start
        start += r[2]


def words_of(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def slow_contamination_fast(docs, items):
    """Brute force with a set of windows."""
    from .test_decontam import words

    windows = defaultdict(set)
    for item, t in items:
        b = words(t)
        n = min(13, len(b))
        for s in range(len(b) - n + 1):
            windows[n, tuple(b[s : s + n])].add(item)
    lengths = {n for n, _ in windows}
    out = []
    for d, t in docs:
        w, hit = words(t), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (n, tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
        out.append((d, len(w), len(hit), ()))
    return out


def test_stages_take_odd_documents(spark, docs_of, tmp_path):
    """Null, empty, long and repeated texts: clean ones stay, copies and texts with a benchmark window go."""
    spark.createDataFrame([(104, 1), (105, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "same same")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(ODD, n_chars=3)
    ids = sorted((d for d, _ in ODD), key=repr)
    without = lambda *gone: sorted((d for d in ids if d not in gone), key=repr)
    want = {"simhash": sorted([*without(101, 102, 106), 106], key=repr), "decontamination": without(106)}
    for name, stage in corpus_pipeline.STAGES:
        out = sorted((r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()), key=repr)
        assert out == want.get(name, out) and set(out) <= set(ids) and (name in ("toxicity", "mixing") or out)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
