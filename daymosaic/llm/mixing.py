"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Each source gets a word target. As many complete epochs as fit come first; the rest is filled in the order of
exponential keys -ln(u) / w, where u depends on the document's id alone and w is its quality weight, until the prefix
sum of sizes reaches the rest. A prefix sum over a hot source would need one task, so keys are cut into ordered cells:
cell totals (pre-aggregated) locate the one cell that holds the boundary, and only that cell is sorted. What comes out
is one threshold per source, so the mix itself is a narrow map over the documents.

Defined cases: null text has size 0; a null source is a source of its own, after all others; ties on the key are
broken by doc_id (null first), and rows equal in both share what is left evenly; an empty table gives no rows; a source
without words has target 0. Other columns are kept by mix() and not read. A document's quality weight is the share of
letters and white space in its text, or any column of weights above 0 that is named (null or other values: the least, 0.1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import maybe_broadcast, running, spread_join, stored, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in code point order, repeating.
CYCLE = (3, 1, 2)
#: Words of the mix per word of the input, and the most that a source may be repeated.
SHARE, MOST = 1.5, 2
#: Sources up to which their targets are found in one task.
FEW_SOURCES = 100_000


def cells_for(rows: int) -> int:
    """Cells of keys for a source with so many rows: as many as a cell then has rows, so both grow slowly."""
    return math.isqrt(rows) + 1


def size_of(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Quality weight of a text: from 0.1 to 1 with its share of letters and white space; 0.1 for null or empty texts."""
    marks = F.char_length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.coalesce(F.when(F.char_length(text) > 0, 1.0 - 0.9 * (marks / F.char_length(text))), F.lit(0.1))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """Exponential key: the smallest keys are a weighted sample without replacement."""
    return -F.ln(uniform(doc_id, F.lit(seed))) / weight


def source_targets(sized: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Targets share `share` of all words by weight and stop at `most` times the source's size, the excess being shared
    again. Closed form: in the order of size / weight, sources are full until the level of those left is below their
    own. Beyond FEW_SOURCES the sums over that order are made by ranges instead of in one task.
    """
    sources = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    count, words = sources.agg(F.count("*"), F.sum("source_size")).first()

    def sums(df: DataFrame, order: list[Column], columns: dict[str, Column]) -> DataFrame:
        if count > FEW_SOURCES:
            return running(df, order, columns, count)
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in columns.items()})

    named = sums(sources, [F.col("source").asc_nulls_last()], {"number": F.lit(1)})
    weights = F.element_at(F.array(*[F.lit(c) for c in cycle]), (F.col("number") % len(cycle) + 1).cast("int"))
    ranked = stored(named.withColumn("weight", weights).withColumn("cap", most * F.col("source_size")).withColumn("own", F.col("cap") / F.col("weight")).drop("number"), "ranked")
    parts = ranked.agg(F.sum("weight")).first()[0] or 0
    filled = sums(ranked, [F.col("own").asc(), F.col("source").asc_nulls_last()], {"before": F.col("cap"), "closed": F.col("weight")})
    leveled = stored(filled.withColumn("level", (F.lit(share * (words or 0)) - F.col("before")) / (F.lit(parts) - F.col("closed"))), "leveled")
    # The first source in the order that stays below its own level; later sources have a greater `before`.
    first = leveled.where("own > level").agg(F.min_by("level", F.struct("own", F.col("source").isNull(), "source"))).first()[0]
    target = F.col("cap").cast("double") if first is None else F.least(F.col("cap").cast("double"), F.lit(first) * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def plan_mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: epochs, rest (words of the fractional epoch) and the boundary (edge_key, edge_id, edge_words, edge_rows).

    sized (source, doc_id, size, key) is a stored narrow table. Rows before the boundary are taken whole, rows at it
    take edge_words together, and rows after it nothing.
    """
    largest = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    cells = cells_for(largest)
    plan = stored(targets, "targets").withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("source_size") > 0, F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))).otherwise(0).cast("long"))
    placed = sized.select(F.struct("source").alias("src"), "doc_id", "size", "key", F.least(F.floor((1 - F.exp(-F.col("key"))) * cells), F.lit(cells - 1)).cast("long").alias("cell"))
    totals = placed.groupBy("src", "cell").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    rests = plan.select(F.struct("source").alias("src"), "rest")
    starts = totals.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).join(maybe_broadcast(rests), "src")
    edge_cells = starts.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("src", "cell", "before", "rest")
    # One cell per source is sorted; rows that are equal in key and id stand together.
    groups = placed.join(maybe_broadcast(stored(edge_cells, "edge_cells")), ["src", "cell"]).groupBy("src", "cell", "before", "rest", "key", "doc_id").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    within = Window.partitionBy("src").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    prefix = groups.withColumn("at", F.col("before") + F.coalesce(F.sum("words").over(within), F.lit(0)))
    edges = prefix.where((F.col("at") <= F.col("rest")) & (F.col("rest") < F.col("at") + F.col("words"))).select("src", F.struct(F.col("key").alias("key"), F.col("doc_id").alias("doc_id")).alias("edge"), (F.col("rest") - F.col("at")).alias("edge_words"), F.col("rows").alias("edge_rows"), F.col("words").alias("edge_total"))
    return stored(plan.withColumn("src", F.struct("source")).drop("source").join(edges, "src", "left"), "mix_plan")


def _weight(text: str, weight: str | None) -> Column:
    if weight is None:
        return quality_weight(F.col(text))
    given = F.col(f"`{weight}`").cast("double")
    return F.when((given > 0) & (given < float("inf")), given).otherwise(0.1)


def _measured(docs: DataFrame, seed: int, key: str, text: str, source: str, weight: str | None) -> DataFrame:
    measured = docs.select(F.col(source).alias("source"), F.col(key).alias("doc_id"), size_of(F.col(text)).alias("size"), _weight(text, weight).alias("weight"))
    return measured.select("source", "doc_id", "size", sampling_key(F.col("doc_id"), F.col("weight"), seed).alias("key"))


def _position(key: Column, doc_id: Column) -> tuple[Column, Column]:
    """Whether a row is before, or at, its source's boundary; a plan without boundary takes no fraction."""
    here = F.struct(key.alias("key"), doc_id.alias("doc_id"))
    return F.coalesce(here < F.col("edge"), F.lit(False)), F.col("edge").isNotNull() & here.eqNullSafe(F.col("edge"))


def taken_words(docs: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words in the mix, repeats counted).

    The document at the boundary is cut to the words that are left, so a source's taken words equal its target,
    rounded down.
    """
    sized = stored(_measured(docs, seed, key, text, source, weight), "sized")
    plan = plan_mix(sized, source_targets(sized))
    joined = spread_join(sized.withColumn("src", F.struct("source")), plan, "src", "inner", "doc_id")
    before, at = _position(F.col("key"), F.col("doc_id"))
    fraction = F.when(before, F.col("size")).when(at, F.least(F.col("size"), F.floor(F.col("edge_words") / F.col("edge_rows")))).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + fraction).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """docs with its rows repeated as the mix takes them; the columns stay as they are.

    Whole documents only: the one at the boundary is taken if at least half of it fits. Documents without words are
    kept once, as they cost nothing. The texts are never shuffled: a row's copies follow from its source's plan.
    """
    sized = stored(_measured(docs, seed, key, text, source, weight), "sized")
    plan = plan_mix(sized, source_targets(sized))
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.struct(F.col(source).alias("source")).alias("src"), F.col(key).alias("id"), _weight(text, weight).alias("weight"), size_of(F.col(text)).alias("size"))
    joined = spread_join(doc, plan, "src", "inner", "id")
    before, at = _position(sampling_key(F.col("id"), F.col("weight"), seed), F.col("id"))
    extra = F.when(before, 1).when(at & (2 * F.col("edge_words") >= F.col("edge_total")), 1).otherwise(0)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + extra)
    return joined.select("doc", copies.cast("int").alias("copies")).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: how much of every document the mix takes."""
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CASE WHEN length(text) > 0 THEN 1.0::DOUBLE - 0.9::DOUBLE * (length(regexp_replace(text, '[\p{L}\x20\x09-\x0D]+', '', 'g'))::DOUBLE / length(text)::DOUBLE) ELSE 0.1::DOUBLE END AS w,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size AS cap, [3, 1, 2][CAST(i % 3 + 1 AS INT)] AS wt, (2 * source_size)::DOUBLE / [3, 1, 2][CAST(i % 3 + 1 AS INT)]::DOUBLE AS own FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY own, source NULLS LAST) AS place,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY own, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(wt) OVER (ORDER BY own, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM r),
o AS (SELECT min_by(level, place) AS level FROM l WHERE own > level),
t AS (SELECT l.source, source_size, CASE WHEN o.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, o.level * wt) END AS target FROM l, o),
p AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
q AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs,
         CASE WHEN p.source_size > 0 THEN CAST(floor(p.target - p.epochs * p.source_size) AS BIGINT) ELSE 0 END AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM q
"""
