"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors lie in bands of their length (norm) and, inside a band, in blocks of bounded bytes; queries lie in blocks of the
same bytes, so that neither side is copied more often than the other needs. In a block every dimension is a sorted list;
for a query, lists are read from the end that its component's sign favours, in growing steps. What a step shows for the
first time is scored exactly, and reading stops when the threshold (the score of a vector that stood at the current
depth of all lists) is below the k-th best. Equal scores go to the smaller id, so reading goes on while the threshold
equals the k-th best.

Queries first meet one block of the longest vectors. The k-th score found there goes along to the other blocks: it stops
their reading earlier, and a query isn't sent at all to a band whose lengths can't reach it. `scored` tells how many
vectors of the row's block were scored for its query.

Defined cases: a vector that is null or holds null or non-finite components takes no part; rows without id are
candidates, after all others on ties, but no queries; rows that repeat an id are queries and candidates of their own,
also of each other; only vectors of the query's dimension are candidates; a vector without components scores 0; scores
that 64 bits don't hold are an error, sums on the way are exact however large; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import maybe_broadcast, ship, spread_join, stored

SCALE, K, EVERY = 1024, 10, 100
#: Bytes of a block's vectors, vectors from which on a band has several blocks, and as many as it has then at least.
BLOCK_BYTES, SEVERAL, AT_LEAST = 32 << 20, 4096, 8
#: First step down the lists; bands of length for each doubling.
STEP, BANDS = 32, 4
NO_ID = np.iinfo(np.int64).max


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole doubles."""
    out = np.floor(vectors * scale)
    if not np.isfinite(out).all():
        raise OverflowError("a component is too large to be scaled")
    return out


def exact_pair(vectors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which all sums of products are exact: doubles, 64-bit integers or Python's integers."""
    reach = float(np.abs(vectors).max(0, initial=0) @ np.abs(queries).max(0, initial=0)) if vectors.shape[1] else 0.0
    most = max(float(np.abs(x).max(initial=0)) for x in (vectors, queries))
    if reach < 2**53 and most < 2**53:
        return vectors, queries
    if reach < 2**62 and most < 2**62:
        return vectors.astype(np.int64), queries.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(vectors), whole(queries)


class SortedLists:
    """The vectors of a block with one list per dimension, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        self.ids, self.vectors, self.rows = ids, vectors, ids if rows is None else rows
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(vectors, self.order, axis=0)

    def search(self, query: np.ndarray, own: int, k: int = K, floor: float | int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best k, best first, and how many vectors were scored. own: the query's row, which is left
        out; floor: a score below which nothing is sought."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.rows == own
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        depth, step, scored = 0, STEP, 0
        if floor is not None and n and self._threshold(query, up, down, 1) < floor:
            return best_ids, best, 0
        while depth < n:
            to = min(n, depth + step)
            if to == n or not (len(up) or len(down)):
                new, to = np.flatnonzero(~seen), n
            else:
                shown = np.zeros(n, bool)
                shown[self.order[n - to : n - depth, up].ravel()] = True
                shown[self.order[depth:to, down].ravel()] = True
                new = np.flatnonzero(shown & ~seen)
            seen[new] = True
            scored += len(new)
            ids, scores = np.concatenate([best_ids, self.ids[new]]), np.concatenate([best, self.vectors[new] @ query])
            if len(ids) > 4 * k and scores.dtype != object:  # all that can be among the best, ties included
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[scores >= edge], scores[scores >= edge]
            order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
            best_ids, best = ids[order], scores[order]
            if to == n:
                break
            threshold = self._threshold(query, up, down, to)
            if (len(best) == k and best[-1] > threshold) or (floor is not None and threshold < floor):
                break
            depth, step = to, step * 2
        return best_ids, best, scored

    def _threshold(self, query: np.ndarray, up: np.ndarray, down: np.ndarray, to: int) -> float | int:
        return self.values[len(self.ids) - to, up] @ query[up] + self.values[to - 1, down] @ query[down]


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, flat.size // max(1, table.num_rows))


def taking_part(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, vec_id, x, dim, band) of the rows that take part; x as doubles, band by the length of x."""
    raw = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x")).where("x is not null")
    finite = F.forall("x", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    largest = F.greatest(F.array_max(F.transform("x", lambda c: F.abs(c))), F.lit(1e-9))  # so that squares don't overflow
    norm = largest * F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + (c / largest) * (c / largest)))
    # A component may lose up to 1 by rounding down, so the length of floor(scale * x) is at most this.
    bound = F.when(F.size("x") > 0, norm * SCALE + F.sqrt(F.size("x"))).otherwise(1.0)
    return raw.where(finite).select(F.monotonically_increasing_id().alias("row"), "vec_id", "x", F.size("x").alias("dim"), F.ceil(F.log2(bound) * BANDS).cast("int").alias("band"), bound.alias("length"))


def _place(n: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("row", F.lit(seed)), n).cast("int")


def exact_top_k(vectors: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score, scored): queries are the rows whose id is divisible by `every`."""
    ship(vectors.sparkSession)
    rows = stored(taking_part(vectors, key, vector), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("length", "reach").drop("band")
    count = lambda df, *by: df.groupBy("dim", *by).agg(F.count("*").alias("n"))
    by_bytes = F.ceil(F.col("n") * F.greatest(F.col("dim"), F.lit(1)) * 8 / BLOCK_BYTES)
    several = F.least(F.lit(AT_LEAST), F.ceil(F.col("n") / SEVERAL))
    blocks = stored(count(rows, "band").select("dim", "band", F.greatest(by_bytes, several).cast("int").alias("blocks")), "blocks")
    query_blocks = stored(count(asked).select("dim", by_bytes.cast("int").alias("query_blocks")), "query_blocks")
    longest = blocks.groupBy("dim").agg(F.max("band").alias("band"))
    cell = ["dim", "band", "b", "q"]
    placed = asked.join(maybe_broadcast(query_blocks), "dim").withColumn("q", _place(F.col("query_blocks"), 1)).drop("query_blocks")
    right = rows.join(maybe_broadcast(blocks), ["dim", "band"]).withColumn("b", _place(F.col("blocks"), 2))
    right = right.join(maybe_broadcast(query_blocks), "dim").withColumn("q", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    right = right.select(*cell, "row", "vec_id", "x", F.lit(False).alias("asked"), F.lit(None).cast("string").alias("floor"))
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def run(group: pa.Table) -> pa.Table:
        mask = group.column("asked").combine_chunks()
        queries, block = group.filter(mask), group.filter(pc.invert(mask))
        out: list[list] = [[], [], [], [], []]
        if queries.num_rows and block.num_rows:
            ids = block.column("vec_id").fill_null(NO_ID).to_numpy()
            held, sought = exact_pair(integers(_matrix(block)), integers(_matrix(queries)))
            lists = SortedLists(ids, held, block.column("row").to_numpy())
            for own, name, floor, query in zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), queries.column("floor").to_pylist(), sought, strict=True):
                found, scores, scored = lists.search(query, own, k, None if floor is None else int(floor))
                whole = [int(s) for s in scores.tolist()]
                for o, x in zip(out, ([own] * len(found), [name] * len(found), [None if i == NO_ID else i for i in found.tolist()], [str(s) for s in whole], [scored] * len(found)), strict=True):
                    o += x
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        return pa.table({n: pa.array(o, t) for n, o, t in zip(("row", "query_id", "vec_id", "score", "scored"), out, kinds, strict=True)})

    schema = "row long, query_id long, vec_id long, score string, scored long"
    meet = lambda left, right: left.select(*cell, "row", "vec_id", "x", F.lit(True).alias("asked"), "floor").unionByName(right).groupBy(*cell).applyInArrow(run, schema)
    start = longest.withColumn("b", F.lit(0))
    # Scores travel as text, as a sum may need more than 64 bits until it is known to be among the best.
    first = stored(meet(placed.join(maybe_broadcast(start), "dim").withColumn("floor", F.lit(None).cast("string")), right.join(maybe_broadcast(start), ["dim", "band", "b"], "left_semi")), "first")
    floors = first.groupBy("row").agg(F.count("*").alias("n"), F.min(F.col("score").cast("decimal(38,0)")).alias("floor")).where(F.col("n") >= k).select("row", "floor")
    known = spread_join(placed, stored(floors, "floors"), "row", "left", "row")
    sent = known.join(maybe_broadcast(blocks), "dim").withColumn("b", every_block).drop("blocks").join(maybe_broadcast(start.withColumn("done", F.lit(True))), ["dim", "band", "b"], "left").where("done is null")
    can = F.col("floor").isNull() | (F.col("reach") * F.pow(F.lit(2.0), F.col("band") / BANDS) * (1 + 1e-9) >= F.col("floor").cast("double"))
    others = meet(sent.where(can).withColumn("floor", F.col("floor").cast("string")), right.join(maybe_broadcast(start), ["dim", "band", "b"], "left_anti"))
    met = first.unionByName(others).withColumn("exact", F.col("score").cast("decimal(38,0)"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc_nulls_last("exact"), F.asc_nulls_last("vec_id")))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"), "scored")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the 10 best of every hundredth vector."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor(1024 * c) AS HUGEINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 10
"""
