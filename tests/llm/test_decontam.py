import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from daymosaic.llm import decontam

from ..conftest import same_rows
from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(window, len(b))
            if item is None or not b:
                continue
            for s in range(len(b) - n + 1):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[s : s + n]:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_contamination(docs, bench, **options).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in found], key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_on_few_words(spark, docs_of, seed):
    """Few words, so windows repeat, overlap and share rarest terms."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("ab C. D é-e 7".split()) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 9]))) for i in range(5)] + [(1, text(3)), (None, "a"), (9, None), (8, "...")]
    docs = [(i, text(rng.randrange(30))) for i in range(25)]
    assert run(spark, docs_of(docs), items, window=4, depth=1 + seed % 3) == brute(docs, items, 4)


def test_odd_documents_and_blocks(spark, docs_of, monkeypatch):
    items = [(i, f"alpha{i} same beta gamma word word word delta eps zeta eta theta iota kappa lambda mu") for i in range(6)] + [(7, "same same")]
    docs = [*ODD, (1, "x " + items[2][1] + " y"), (2, items[3][1].upper())]
    want = brute(docs, items)
    assert run(spark, docs_of(docs), items) == want
    monkeypatch.setattr(decontam, "TERM_ROWS", 4)  # beyond the bounds terms and windows meet by a shuffle
    monkeypatch.setattr(decontam, "PROBE_ROWS", 4)
    assert run(spark, docs_of(docs), items) == want


def test_empty_tables(spark, docs_of):
    assert run(spark, docs_of([(1, "a b")]).limit(0), [(1, "a")]) == []
    assert run(spark, docs_of([(1, "a b")]), [(None, None)]) == [(1, 2, 0, ())]


def test_removal_keeps_clean_rows_and_columns(spark, docs_of):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = docs_of([(1, passage), (2, "clean " * 50), (3, passage + " clean" * 500), (4, None), (2, "clean " * 50)])
    kept = decontam.remove_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 4]
    assert decontam.find_contamination(kept, spark.createDataFrame([(1, passage)], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_rows_are_the_same_however_scans_are_split(spark, tmp_path):
    """Row names come from the file, so rows flagged by one scan go in another whose splits differ."""
    from daymosaic.llm import common

    spark.range(20_000).selectExpr("id as doc_id", "repeat(cast(id as string), 20) as text").repartition(3).write.option("parquet.block.size", 65536).parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert common.steady(docs) is docs and common.steady(docs.where("doc_id >= 0")) is not None
    flagged = common.stored(common.with_row(docs, doc_id="doc_id").where("doc_id % 10 = 0").select("row"), "flagged")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("60k", "200k", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            left = common.without_rows(docs, flagged)
            assert left.count() == 18_000 and left.where("doc_id % 10 = 0").count() == 0
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tables_that_are_no_files_are_stored_once(spark):
    from daymosaic.llm import common

    for df in (spark.range(5), spark.range(5).union(spark.range(5)), spark.range(3).withColumn("_metadata", F.lit(1))):
        kept = common.steady(df)
        assert common.with_row(kept, id="id").select("row").distinct().count() == df.count()


def test_joins_beyond_the_broadcast_bound(spark):
    from daymosaic.llm import common

    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    rows = lambda d: sorted((tuple(r) for r in d.select("k", "id", "v").collect()), key=repr)
    for how in ("left", "inner"):
        assert rows(common.spread_join(left, right, "k", how, "id", 0)) == rows(left.join(right, "k", how))


def test_running_sums(spark):
    from daymosaic.llm import common

    df = spark.range(500).select("id", (F.col("id") * 7 % 13).alias("x"))
    got = {r["id"]: r["s"] for r in common.running(df, [F.col("x"), F.col("id").desc()], {"s": F.col("x")}, 500, 60).collect()}
    order = sorted(got, key=lambda i: (i * 7 % 13, -i))
    total = 0
    for i in order:
        assert got[i] == total
        total += i * 7 % 13


def test_proximity(spark, docs_of):
    docs = docs_of([(1, "red x green y blue"), (2, "blue green x x x x red"), (3, "red green"), (4, "green red blue " + "z " * 50 + "red q blue q green")])
    phrases = spark.createDataFrame([("p", "red green blue"), ("q", "...")], "phrase_id string, text string")
    got = {(r["doc_id"], r["start"], r["end"]) for r in decontam.proximity_matches(docs, phrases, 2).collect()}
    assert got == {(1, 0, 5), (4, 0, 3), (4, 53, 58)}


def test_query_equals_sql(spark, sf, duck):
    assert same_rows(decontam.query(spark, sf), duck, decontam.SQL)


def test_digest_of_items(spark, sf):
    r = decontam.query(spark, sf).where("n_items = 0").first()
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest() and not r["contaminated"]


def test_main_path_has_no_python(spark, sf):
    plan = decontam.query(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!ColumnVector)", plan)
