"""SimHash near copies at a similarity of five-word shingles, for stages that op8's settings don't bind.

Two sets with a Jaccard similarity of 0.8 differ in some 15 % of SimHash bits, far more than the few bits that one print's
segments can miss. So a text gets PRINTS independent prints of its shingle set, each indexed by deletion-variant
signatures as in simhash, and a pair is a candidate where one segment of one print differs by at most one bit, that
print by at most RADIUS bits and the next print by at most NEXT. At a similarity of exactly 0.8 a pair is a candidate
with a probability of some 0.98, at 0.85 of 0.998 (README: measured). Links are then decided on the whole sets of shingle hashes.

Texts with equal sets are one node first. A cell of the index emits spanning forests of its candidates, so a large group of
copies costs its size, not its square. What candidates connect is a family. Where a family's links turn out to be less
similar, so that its members are left in several components, pairs between these are found by a prefix filter over how
whole sets differ from the family's middle, which loses none; so each pair of a family is either linked through others,
ruled out or tested.

Defined cases: null and wordless texts have the same empty set; texts shorter than a shingle are one shingle; letters
A-Z are lower-cased and words are set apart by ASCII white space, as in simhash; a node is the 64-bit hash of its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, made
from .common import maybe_broadcast, pieces, release, ship, spread_join, steady, stored, texts_of, with_row, without_rows
from .simhash import cell_edges, cells, components, distance, thirds, whole_cells

SEED, SHINGLE, LEAST = 42, 5, 0.8
#: Prints of a text, bits in which a pair may differ in the print whose segment it shares, and in the next print.
PRINTS, RADIUS, NEXT = 8, 12, 18
#: Segments are cut as for this radius: three of 21 or 22 bits.
CUT = 4
#: Edges whose components one task finds.
SMALL_GRAPH = 500_000
#: Hashes of families' middles that are broadcast.
MIDDLES = 1_000_000


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    import xxhash

    words = (text or b"").lower().split()
    grams = {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else ()
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def prints_of(hashes: np.ndarray) -> np.ndarray:
    """PRINTS independent SimHashes of a set, as signed numbers: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64 * PRINTS, np.int64)
    salts = (np.arange(1, PRINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for at in range(0, len(hashes), 255):  # so that sums fit a byte
        x = hashes[at : at + 255, None] ^ salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def marks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, doc_id, node, size, prints) of every row of a steady table; node is a hash of the whole set."""
    ship(docs.sparkSession)
    slim = with_row(docs, doc_id=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for b in pieces(batch, 2):
                sets = [shingles(x) for x in texts_of(b, 2)]
                node = pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets], pa.int64())
                prints = pa.array([prints_of(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, pa.array([len(s) for s in sets], pa.int64()), prints], names=["row", "doc_id", "node", "size", "prints"])
        release()

    return slim.mapInArrow(run, slim.drop("text").schema.add("node", "long").add("size", "long").add("prints", T.ArrayType(T.LongType())))


def spanning(edges: np.ndarray) -> np.ndarray:
    """Which of the edges (cell, smaller, larger), sorted, make a spanning forest of each cell; those of small nodes first."""
    keep = np.ones(edges.shape[1], bool)
    cells_, count = np.unique(edges[0], return_counts=True)
    several = np.flatnonzero(np.repeat(count > 1, count))
    parent: dict[int, int] = {}
    last = None

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for i, cell, a, b in zip(several.tolist(), *edges[:, several].tolist(), strict=True):
        if cell != last:
            parent, last = {}, cell
        a, b = root(a), root(b)
        if a == b:
            keep[i] = False
        else:
            parent[max(a, b)] = min(a, b)
    return keep


def candidates(nodes: DataFrame, least: float) -> DataFrame:
    """(u, v, fit): edges of the forests of candidates in the index's cells; fit: the sets' sizes allow the similarity."""
    kinds = len(thirds(CUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, cell, own, following, size, node in whole_cells(batches):
            near = lambda a, b, x=own, y=following: (distance(x[a], x[b]) <= RADIUS) & (distance(y[a], y[b]) <= NEXT)
            found = list(cell_edges(kind, cell, own, CUT, near, node))
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            # All edges of a cell are one tree, whatever the bit that was left out.
            number = np.cumsum(np.concatenate([[0], (kind[1:] != kind[:-1]) | (cell[1:] != cell[:-1])]))[a]
            fit = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])
            edges = np.unique(np.stack([number, np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), fit]), axis=1)
            # The same few links for a group in all its cells, so that few pairs are left when they are made distinct.
            edges = edges[:, spanning(edges[:3])]
            edges = np.unique(edges[1:], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(edges[1]), pa.array(edges[0]), pa.array(edges[2] > 0)], names=["u", "v", "fit"])
        release()

    def entries(i: int) -> list[Column]:
        own, following = F.col("prints")[i], F.col("prints")[(i + 1) % PRINTS]
        return [F.struct(c["kind"].alias("kind"), c["cell"].alias("cell"), own.alias("own"), following.alias("following"), F.col("size").cast("int").alias("size")) for c in cells(own, CUT, i * kinds)]

    each = [e for i in range(PRINTS) for e in entries(i)]
    met = nodes.select(F.explode(F.array(*each)).alias("c"), "node").select("c.*", "node")
    return met.repartition("kind", "cell").sortWithinPartitions("kind", "cell").mapInArrow(run, "u long, v long, fit boolean")


def sets_of(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Stored (node, hashes) of the given (row, node)."""
    slim = with_row(docs, text=text).join(maybe_broadcast(rows), "row").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1):
                hashes = [shingles(x).view(np.int64) for x in texts_of(b, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.list_(pa.int64()))], names=["node", "hashes"])
        release()

    return stored(slim.mapInArrow(run, "node long, hashes array<long>"), "sets")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the distinct pairs (u, v), u > v, whose sets reach the similarity."""
    a, b = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"{n}_set")) for n in ("u", "v"))
    common = F.size(F.array_intersect("u_set", "v_set"))
    met = pairs.join(a, "u").join(b, "v").withColumn("common", common)
    return met.where(F.col("common") >= F.lit(least) * (F.size("u_set") + F.size("v_set") - F.col("common"))).select("u", "v")


def near_links(sets: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Distinct (u, v) of similar nodes, enough to connect what all similar pairs of a family would."""
    # A node's edge to the neighbour with most edges is tested first; then the others that still lie between components.
    fit = edges.where("fit").select("u", "v")
    ways = fit.unionByName(fit.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degrees = stored(ways.groupBy("v").agg(F.count("*").alias("n")), "degrees")
    hubs = spread_join(ways, degrees, "v", "inner", "u").groupBy("u").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    few = stored(hubs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "few")
    first = stored(similar(few, sets, least), "near")
    stars = components(first, SMALL_GRAPH)
    rest = rooted(rooted(fit.join(few, ["u", "v"], "left_anti"), stars, "u"), stars, "v").where("u_root <> v_root").select("u", "v")
    linked = stored(first.unionByName(similar(rest, sets, least)), "near")
    families, roots = components(edges.select("u", "v"), SMALL_GRAPH), components(linked, SMALL_GRAPH)
    members = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    own = stored(rooted(rooted(members, families, "node", "family"), roots, "node", "root"), "own")
    several = own.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
    split = stored(spread_join(own, stored(several.where("low < high").select("family", "members"), "split"), "family", "inner", "node"), "apart")
    return linked.unionByName(similar(stored(alike(split, sets, least), "alike"), sets, least)).distinct()


def rooted(rows: DataFrame, stars: DataFrame, node: str, name: str | None = None) -> DataFrame:
    """rows with the mark of the component of their column `node`: itself, if components (u, v) don't have it."""
    name = name or f"{node}_root"
    marks = stars.select(F.col("u").alias(node), F.col("v").alias(name))
    by = "v" if node == "u" and "v" in rows.columns else "u" if node == "v" and "u" in rows.columns else node
    return spread_join(rows, marks, node, "left", by).withColumn(name, F.coalesce(name, node))


def alike(own: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Distinct (u, v), u > v, of nodes of one family and different roots that may be similar; with those of one root they
    connect all that are.

    own (node, family, root, members). Members of a family are mostly a middle with changes: the hashes that over half of them
    hold. Sets x and y differ as much as what each differs from the middle, X and Y, does: they are similar if and only if X and
    Y have (excess of x + excess of y) / 2 hashes in common, where excess = |X| - |x| (1 - least) / (1 + least). Pairs that need
    none are similar; as each of such a pair needs none with the member of least excess either, links to that member stand
    for all of them, one for each node. The others need a common hash, which a prefix filter finds: put all hashes in one
    order, then sets that share enough have their first common hash early in both. Hashes that only one component has come
    first and can't be common, the others by how many have them. One of two components isn't the family's largest, so
    how early depends on the least excess outside that one for all, and on the least of all for the others.
    """
    held = stored(own.join(sets, "node").select("node", "family", "root", "members", "hashes"), "held")
    often = held.select("family", "members", F.explode("hashes").alias("hash")).groupBy("family", "members", "hash").count().where("2 * count > members")
    middles = stored(often.groupBy("family").agg(F.collect_list("hash").alias("middle")), "middles")
    few = (middles.agg(F.sum(F.size("middle") + 1)).first()[0] or 0) <= MIDDLES
    middle = F.coalesce("middle", F.array().cast("array<long>"))
    changed = F.concat(F.array_except("hashes", middle), F.array_except(middle, "hashes"))
    part = spread_join(held, middles, "family", "left", "node", None if few else 0).select("node", "family", "root", F.size("hashes").alias("size"), changed.alias("changed"))
    part = stored(part.withColumn("excess", F.size("changed") - F.col("size") * F.lit((1 - least) / (1 + least))), "changed")
    needed = lambda a, b: F.ceil((a + b) / 2 - 1e-9)  # noqa: E731  common hashes
    # Links to the member of least excess, and the components that they leave.
    best = stored(part.groupBy("family").agg(F.min_by(F.struct("node", "root", "excess"), F.struct("excess", "node")).alias("best")), "best")
    near = spread_join(part.drop("changed"), best, "family", "inner", "node").where((F.col("root") != F.col("best.root")) & (needed(F.col("excess"), F.col("best.excess")) <= 0))
    near = stored(near.select("node", "root", "best"), "stars")
    joined = stored(near.select("root", F.col("best.root").alias("new")).distinct(), "joined")
    part = spread_join(part, joined, "root", "left", "node").withColumn("root", F.coalesce("new", "root")).drop("new")
    sums = stored(part.groupBy("family", "root").agg(F.count("*").alias("n"), F.min("excess").alias("low")), "sums")
    main = sums.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.min("low").alias("any"), F.count("*").alias("n")).where("n > 1").drop("n")
    others = stored(spread_join(sums, stored(main, "main"), "family", "inner", "root").where("root <> main"), "others")
    low = others.groupBy("family", "main", "any").agg(F.min("low").alias("outside"))
    part = stored(spread_join(part, stored(low, "lows"), "family", "inner", "node"), "parts")

    of = part.select("node", "family", "root", F.explode("changed").alias("hash"))
    shared = of.groupBy("family", "hash").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("family", "hash", "n")
    lists = of.select("node", "family", "hash").join(shared, ["family", "hash"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("shared"))
    rows = part.select("node", "family", "root", "main", "size", "excess", "any", "outside", F.size("changed").alias("changes")).join(lists, "node")
    # Of two components one isn't the main one; two others meet once.
    rows = stored(rows.withColumn("free", F.col("changes") - F.size("shared")), "lists")

    def prefixes(some: DataFrame, other: str) -> DataFrame:
        take = (F.col("changes") - F.greatest(F.lit(1), needed(F.col("excess"), F.col(other))) + 1 - F.col("free")).cast("int")
        some = some.withColumn("take", take).where("take > 0").select("*", F.posexplode(F.slice("shared", F.lit(1), F.col("take"))).alias("at", "x"))
        return some.select("family", "node", "root", "main", "size", "excess", (F.col("changes") - F.col("free") - F.col("at")).alias("rest"), F.col("x.hash").alias("hash"))

    a = stored(prefixes(rows, "outside"), "prefixes").alias("a")
    b = stored(prefixes(rows.where("root <> main"), "any"), "prefixes").drop("main").alias("b")
    both = lambda f, name: f(f"a.{name}", f"b.{name}")
    fits = (F.col("a.root") != F.col("b.root")) & ((F.col("a.root") == F.col("a.main")) | (F.col("a.root") < F.col("b.root"))) & (both(F.least, "size") >= F.lit(least) * both(F.greatest, "size")) & (both(F.least, "rest") >= needed(F.col("a.excess"), F.col("b.excess")))
    met = a.join(b, [F.col("a.family") == F.col("b.family"), F.col("a.hash") == F.col("b.hash"), fits])
    met = met.select(both(F.greatest, "node").alias("u"), both(F.least, "node").alias("v"))
    return met.unionByName(near.select(F.greatest("node", "best.node").alias("u"), F.least("node", "best.node").alias("v"))).distinct()


def drop_near_copies(docs: DataFrame, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component of the links: that of the smallest doc_id (nulls last)."""
    docs = steady(docs)
    since = made()
    rows = stored(marks(docs, key, text), "marks")
    nodes = stored(rows.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("prints").alias("prints")), "nodes")
    edges = stored(candidates(nodes.where("size > 0"), least).distinct(), "edges")
    named = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = sets_of(docs, stored(nodes.join(named, "node").select("row", "node"), "named"), text)
    roots = stored(components(near_links(sets, edges, least), SMALL_GRAPH).select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
    groups = stored(spread_join(rows.select("row", "doc_id", "node"), roots, "node", "left", "row").select("row", "doc_id", F.coalesce("root", "node").alias("root")), "rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    kept = groups.groupBy("root").agg(best.alias("row")).select("row")
    dropped = stored(groups.select("row").join(kept, "row", "left_anti"), "dropped")
    discard(docs.sparkSession, since, made() - 1)
    return without_rows(docs, dropped)
