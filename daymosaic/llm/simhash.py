"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most k bits are found by cutting the 64 bits into k // 2 + 1 segments: one of them then
differs by at most one bit. Every segment is indexed once per bit with that bit left out, so such a pair shares a key.
A segment is shuffled by two of its thirds, of which a pair shares those that don't hold the differing bit; the variants
of the other third are made where the rows meet. So nine rows are shuffled for three segments, not one for each bit.

Equal fingerprints are one node first. In each bucket the members are verified, and a bucket emits the edges of a
spanning forest of its links (at most its size less one), never all pairs. Buckets of more than LARGE members are cut
again by the same scheme over the other bits, which loses no link. Components come from alternating large-star and
small-star rounds, each written to the shared folder.

Defined cases: null or wordless texts have fingerprint zero, which links like any other; texts shorter than a shingle
are one shingle; a null doc_id takes part and is ignored when a component's smallest id is chosen (null if it has none);
repeated rows stay rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, spread_join, steady, stored, texts_of, with_row, without_rows

SEED, RADIUS, SHINGLE = 42, 4, 4
#: Members up to which a bucket's pairs are compared directly, and from which on a bucket is cut again.
SMALL, LARGE = 24, 4096


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit integer."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return int(np.uint64(h(joined, SEED)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]])
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, fp) of every row of a steady table; fp is the fingerprint as a signed 64-bit integer."""
    ship(docs.sparkSession)
    slim = with_row(docs, doc_id=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 2):
                prints = pa.array([fingerprint(x) for x in texts_of(b, 2)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), prints], names=["row", "doc_id", "fp"])

    return slim.mapInArrow(run, slim.drop("text").schema.add("fp", "long"))


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the radius // 2 + 1 segments."""
    cuts = np.linspace(0, 64, radius // 2 + 2).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def thirds(radius: int) -> list[tuple[int, int, int]]:
    """(mask of the segment, first bit and bits of the third that is left out) of every cell kind."""
    out = []
    for first, bits in segments(radius):
        cuts = np.linspace(first, first + bits, 4).round().astype(int).tolist()
        out += [(((1 << bits) - 1) << first, a, z - a) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(fp: Column, radius: int = RADIUS, tag: int = 0) -> list[Column]:
    """Structs (kind, cell): for every kind, its segment without the third that is left out. tag: first kind's number."""
    return [F.struct(F.lit(tag + i).alias("kind"), fp.bitwiseAND(F.lit(_signed(mask & ~(((1 << n) - 1) << at))).cast("long")).alias("cell")) for i, (mask, at, n) in enumerate(thirds(radius))]


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal (sorted) keys."""
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(keys)))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; on unsigned numbers, as numpy counts the bits of a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def forest(members: np.ndarray, prints: np.ndarray, near: Near, rank: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (numbers of members) of a spanning forest of the graph of near ones. Starts at the least rank, or without ranks
    at the print nearest the middle."""
    if rank is not None:
        return _grown(members[np.argsort(rank[members], kind="stable")], near)
    bits = np.unpackbits(prints[members].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    middle = np.packbits(2 * bits > len(members), bitorder="little").view("<i8")[0]
    return _grown(members[np.argsort(distance(prints[members], middle), kind="stable")], near)


def _grown(rest: np.ndarray, near: Near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Trees grown from the first of those that are left."""
    out = []
    while rest.size:
        front, rest = [rest[:1]], rest[1:]
        while front and rest.size:
            block = front.pop()
            for p in block:
                close = near(rest, p)
                if close.any():
                    new = rest[close]
                    out.append((np.full(new.size, p), new))
                    front.append(new)
                    rest = rest[~close]
                    if not rest.size:
                        break
    return out


def cut_again(members: np.ndarray, prints: np.ndarray, mask: int, radius: int, near: Near, rank: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Forests of a large bucket's parts: the scheme once more, over the bits outside the bucket's segment."""
    others = [b for b in range(64) if not mask >> b & 1]
    out = []
    for part in np.array_split(np.array(others), radius // 2 + 1):
        whole = sum(1 << int(b) for b in part)
        for b in part.tolist():
            keys = prints[members] & np.int64(_signed(whole & ~(1 << b)))
            order = np.argsort(keys, kind="stable")
            for start, n in zip(*runs_of(keys[order]), strict=True):
                if n > 1:
                    out += forest(members[order[start : start + n]], prints, near, rank)
    return out


def bucket_edges(keys: np.ndarray, prints: np.ndarray, mask: int, radius: int, near: Near, rank: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (numbers of rows) between near rows of equal keys, enough to connect them."""
    order = np.argsort(keys, kind="stable")
    starts, sizes = runs_of(keys[order])
    out = []
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        members = order[s : s + n]
        out += forest(members, prints, near, rank) if n <= LARGE else cut_again(members, prints, mask, radius, near, rank)
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    rows, k = order[few], keys[order[few]]
    for step in range(1, SMALL):
        same = k[step:] == k[:-step]
        if not same.any():
            break
        a, b = rows[:-step][same], rows[step:][same]
        close = near(a, b)
        out.append((a[close], b[close]))
    return out


def cell_edges(kinds: np.ndarray, places: np.ndarray, prints: np.ndarray, radius: int, near: Near, rank: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (numbers of rows) within cells, for every kind and bit of the third that is left out. Rows are sorted by cell."""
    shapes = thirds(radius)
    for kind in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == kind)
        mask, at, n = shapes[kind % len(shapes)]
        starts, sizes = runs_of(places[rows])
        full = np.repeat(sizes > 1, sizes)
        if not full.any():
            continue
        rows, number = rows[full], np.repeat(np.arange(len(sizes)), sizes)[full].astype(np.int64)
        third = (prints[rows] >> at) & ((1 << n) - 1)
        for j in range(n):
            keys = (number << n) | (third & ~(1 << j))
            local, own = prints[rows], None if rank is None else rank[rows]
            for a, b in bucket_edges(keys, local, mask, radius, lambda x, y, rows=rows: near(rows[x], rows[y]), own):
                yield rows[a], rows[b]


def whole_cells(batches: Iterator[pa.RecordBatch], least: int = 1 << 18) -> Iterator[list[np.ndarray]]:
    """Columns of runs of whole cells; the first two columns are kind and cell, by which rows are sorted. Cells are put
    together until they have `least` rows."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        held.append(columns)
        if sum(len(h[0]) for h in held) < least:
            continue
        kind, cell = columns[0], columns[1]
        if kind[0] == kind[-1] and cell[0] == cell[-1]:  # the last cell may go on, and perhaps fills the batch
            if not (len(held) > 1 and (held[-2][0][-1] != kind[0] or held[-2][1][-1] != cell[0])):
                continue
        joined = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = (joined[0] != joined[0][-1]) | (joined[1] != joined[1][-1])
        cut = int(last.nonzero()[0][-1]) + 1 if last.any() else 0
        if cut:
            yield [x[:cut] for x in joined]
        held = [[x[cut:] for x in joined]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct edges (u, v), u > v, that connect distinct fingerprints within radius as all their links would."""
    ship(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds, places, prints in whole_cells(batches):
            near: Near = lambda a, b, prints=prints: distance(prints[a], prints[b]) <= radius
            found = list(cell_edges(kinds, places, prints, radius, near))
            if found:
                a, b = (prints[np.concatenate(x)] for x in zip(*found, strict=True))
                edges = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["u", "v"])

    met = nodes.select(F.explode(F.array(*cells(F.col("fp"), radius))).alias("c"), "fp").select("c.kind", "c.cell", "fp")
    return met.repartition("kind", "cell").sortWithinPartitions("kind", "cell").mapInArrow(run, "u long, v long").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    met = spread_join(near, stored(least, "least"), "u", "inner", "v")
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    return met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """(u, v): every node that isn't the least of its component, with the least. edges (u, v) have u > v.

    small: edges up to which one task does it, which saves the rounds.
    """
    edges, last = stored(edges, "links"), None
    while True:
        mark = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == last or not mark[0]:
            return edges
        if last is None and mark[0] <= small:
            return stored(edges.coalesce(1).mapInArrow(_in_one_task, "u long, v long"), "stars")
        last, edges = mark, stored(_star(stored(_star(edges, True), "stars"), False), "stars")


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of all edges, by hooking roots to lesser ones and halving paths."""
    ends = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate([x for e in zip(*ends, strict=True) for x in e]), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    own = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])


def group_rows(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint; prints (doc_id, fp) is a stored narrow table."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    stars = components(links(nodes.select("fp"), radius))
    roots = stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()
    members = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(roots)
    placed = stored(nodes.join(members, "fp", "left").select("fp", "first_id", "root"), "placed")
    # Only components of several fingerprints meet by their root; a large one is dealt to several tasks.
    least = stored(placed.where("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id")), "least")
    found = spread_join(placed, least, "root", "left", "fp")
    return stored(found.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id")), "groups")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: row, doc_id, fp, root (a component's own mark), component_id (smallest doc_id that links reach)."""
    prints = stored(fingerprints(steady(docs), key, text), "prints")
    return prints.join(group_rows(prints, radius), "fp").select("row", "doc_id", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (nulls last), of equal ones the first in its file."""
    docs = steady(docs)
    groups = stored(simhash_groups(docs, radius, key, text).select("row", "doc_id", "root"), "rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
    kept = groups.groupBy("root").agg(best.alias("row")).select("row")
    return without_rows(docs, stored(groups.select("row").join(kept, "row", "left_anti"), "dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: fingerprint and component of every document."""
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
