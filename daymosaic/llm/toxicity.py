"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are all words (runs of letters in lower case) of the examples, a bounded sample of labelled documents, and these
words' first four and five letters, as many languages bend the ends of words. A term's weight is (1 + ln tf) * idf *
relevance: idf from its document frequency in all documents, relevance from FLOOR to 1 by how far the term goes with
either label among the examples (chi-square over chi-square + HALF). No term is left out, so a document without telling
words has neighbours too. Near copies among the examples are one example with their mean label.

The examples' unit vectors form an inverted index with the maximum weight per term and block. Lists of terms that many
examples hold are kept whole and multiplied for many documents at once; a block's bound is the greatest such sum in it plus
its other terms' maxima. Blocks are read in the order of their bounds until no block left can hold a nearer example, so
the neighbours are exact. Neighbours
vote with their cosine as weight, next to the rate among all examples, and the vote is calibrated by isotonic regression
on the examples' own votes, each without itself.

Scale: texts are read twice, for document frequencies and scores, by narrow maps; the driver and each worker hold the
examples' vectors and words only (at most some MOST_TOXIC + MOST_CLEAN documents, one per id). A worker drops what other
operators' tasks kept in it.

Defined cases: null, empty or wordless texts, and texts without any word of the examples, get the rate; without labelled
examples all scores are 0; a document with several labels counts as toxic if any says so; null labels are ignored; of rows
that repeat a labelled id the greatest text is the example; repeated rows get a score each; ties among neighbours go to
the example that stands first, toxic ones before others, then by id; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, pieces, release, ship, steady, stored, text_remainder, uniform, with_row, without_rows

#: Bounds of the fitted sample.
MOST_TOXIC, MOST_CLEAN = 1_000, 2_000
#: Least relevance of a term, and the chi-square at which it is half.
FLOOR, HALF = 0.01, 20.0
NEIGHBOURS, BLOCK, PRIOR = 15, 32, 0.5
#: Blocks that are read first.
FIRST = 6
#: A term that one example in so many holds has a whole list.
WHOLE = 16
#: Documents whose whole lists are multiplied at once, bytes of texts whose words are looked up at once.
BATCH, TOGETHER = 256, 1 << 20
THRESHOLD = 0.7


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words of many texts, the distinct words, and how many words each text has. Null is empty."""
    texts = pc.fill_null(texts, "")
    try:
        lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
    except pa.ArrowInvalid:  # not UTF-8
        fixed = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()])
        lists = pc.split_pattern_regex(pc.utf8_lower(fixed), r"[^\p{L}]+")
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # stands before and after other characters at a text's ends
        keep = codes != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))
        codes = codes[keep]
    return codes, coded.dictionary, sizes


def words_in(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """coded_words with the words as a list."""
    codes, words, sizes = coded_words(texts)
    return codes, words.to_pylist(), sizes


def terms_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings; these end in a star."""
    return (word,) + ((word[:4] + "*",) if len(word) > 4 else ()) + ((word[:5] + "*",) if len(word) > 5 else ())


class Numbered:
    """Numbers of words' terms: the word, its first four and five letters. Looked up for many words at once."""

    def __init__(self, number: dict[str, int]) -> None:
        self.total, self.sets = len(number), []
        for letters in (0, 4, 5):
            own = [t for t in number if (len(t) == letters + 1 if t.endswith("*") else not letters)]
            self.sets.append((letters, pa.array([t.removesuffix("*") for t in own], pa.string()), np.array([number[t] for t in own] + [-1], np.int32)))

    def of(self, words: pa.Array) -> np.ndarray:
        """[3, words]; -1: unknown, or the word is no longer than that."""
        out, sizes = np.empty((3, len(words)), np.int32), pc.utf8_length(words).to_numpy(zero_copy_only=False)
        for i, (letters, own, numbers) in enumerate(self.sets):
            some = words
            if letters:  # many words begin alike
                coded = pc.utf8_slice_codeunits(words, 0, letters).dictionary_encode()
                some = coded.dictionary
            found = numbers[pc.fill_null(pc.index_in(some, own), -1).to_numpy(zero_copy_only=False)]
            out[i] = np.where(sizes > letters, found[coded.indices.to_numpy()], -1) if letters else found
        return out


def counted(texts: pa.Array, known: Numbered) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the known terms of each text, ascending, how often they occur, and how many there are per text."""
    codes, words, sizes = coded_words(texts)
    width = max(1, known.total)
    base, keys = np.repeat(np.arange(len(sizes)) * width, sizes), []
    for numbers in known.of(words):
        found = numbers[codes]
        held = found >= 0
        keys.append(base[held] + found[held])
    pairs, tf = np.unique(np.concatenate(keys), return_counts=True)
    return pairs % width, tf, np.bincount(pairs // width, minlength=len(sizes))


def sketch(words: list[str]) -> list[int]:
    """Four keys, of two minima each, over shingles of five words; texts that share a key are taken for copies."""
    import xxhash

    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    h = np.array([xxhash.xxh64_intdigest(s) for s in shingles], np.uint64)
    minima = [int((h * np.uint64(2 * i + 1) ^ (h >> np.uint64(7 + 5 * i))).min()) for i in range(8)]
    return [xxhash.xxh64_intdigest(f"{i} {minima[i]} {minima[i + 1]}") >> 1 for i in range(0, 8, 2)]


def copies(keys: list[list[int]]) -> np.ndarray:
    """Group of each example of the (bounded) sample: those linked by shared keys."""
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    for i, own in enumerate(keys):
        for k in own:
            j = first.setdefault(k, i)
            parent[root(i)] = root(j)
    return np.array([root(i) for i in range(len(keys))], np.int64)


def labelled_ids(labels: DataFrame, key: str, label: str, held_out: tuple[int, int]) -> tuple[DataFrame, dict[int, float]]:
    """Bounded, stored (doc_id, toxic), chosen by a hash of the id; and how many labelled documents each stands for."""
    divisor, out = held_out
    once = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.max((F.col(label) == 1).cast("int")).alias("toxic"))
    learnt = once.where(text_remainder("doc_id", divisor) != out)
    count = {r["toxic"]: r["count"] for r in learnt.groupBy("toxic").count().collect()}
    share = {t: min(1.0, most / max(1, count.get(t, 0))) for t, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))}
    chosen = learnt.where(uniform(F.col("doc_id"), F.lit("toxic")) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    return stored(chosen, "labelled"), {t: 1 / s for t, s in share.items()}


class Examples:
    """The labelled sample: one entry per group of copies, its terms by number, their counts, mean label and weight."""

    def __init__(self, rows: list[tuple], stands: dict[int, float]) -> None:
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        groups = copies([r[2] for r in rows])
        first, entry = np.unique(groups, return_index=True), {}
        order = sorted(first[1].tolist())
        for place, i in enumerate(order):
            entry[groups[i]] = place
        member = np.array([entry[g] for g in groups.tolist()], np.int64) if rows else np.zeros(0, np.int64)
        toxic = np.array([r[1] for r in rows], float)
        weight = np.array([stands[int(t)] for t in toxic])
        self.ids = [rows[i][0] for i in order]
        size = np.bincount(member, minlength=len(order))
        self.label = np.bincount(member, toxic, len(order)) / np.maximum(1, size)
        self.weight = np.bincount(member, weight, len(order)) / np.maximum(1, size)
        self.number: dict[str, int] = {}
        self.vectors = []
        for i in order:
            found: Counter[int] = Counter()
            for w, n in zip(*(x.as_py() if isinstance(x, pa.Scalar) else x for x in rows[i][3:5]), strict=True):
                for t in terms_of(w):
                    found[self.number.setdefault(t, len(self.number))] += n
            at = np.array(sorted(found), np.int64)
            self.vectors.append((at, np.array([found[t] for t in at.tolist()], float)))

    def relevance(self) -> np.ndarray:
        """FLOOR to 1 for every word, by the chi-square (with Yates's correction) of its presence and the label."""
        n, t = len(self.label), float(self.label.sum())
        a, b = np.zeros(len(self.number)), np.zeros(len(self.number))
        for (at, _), y in zip(self.vectors, self.label.tolist(), strict=True):
            a[at] += y
            b[at] += 1 - y
        c = n - t
        spread = t * c * (a + b) * (n - a - b)
        off = np.maximum(0, np.abs(a * (c - b) - b * (t - a)) - n / 2)
        chi2 = np.where(spread > 0, n * off**2 / np.where(spread > 0, spread, 1), 0.0)
        return FLOOR + (1 - FLOOR) * chi2 / (chi2 + HALF)


def read_examples(docs: DataFrame, chosen: DataFrame, stands: dict[int, float], key: str, text: str) -> Examples:
    """The chosen documents, one per id; bounded by the sample."""
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "doc_id")
    once = slim.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for b in pieces(batch, 2):
                codes, words, sizes = words_in(b.column(2))
                keys, terms, counts = [], [], []
                for c in np.split(codes, np.cumsum(sizes)[:-1]):
                    keys.append(sketch([words[i] for i in c.tolist()]))
                    distinct, n = np.unique(c, return_counts=True)
                    terms.append([words[i] for i in distinct.tolist()])
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "toxic", "keys", "terms", "counts"])

    schema = once.select("doc_id", "toxic").schema
    for name, kind in (("keys", T.LongType()), ("terms", T.StringType()), ("counts", T.LongType())):
        schema = schema.add(name, T.ArrayType(kind))
    found = once.mapInArrow(run, schema).toArrow().combine_chunks()
    ids, toxic, keys = (found.column(c).to_pylist() for c in ("doc_id", "toxic", "keys"))
    # Words stay in Arrow's memory until an example's turn comes.
    return Examples(list(zip(ids, toxic, keys, found.column("terms"), found.column("counts"), strict=True)), stands)


def document_frequencies(docs: DataFrame, sent: Broadcast, text: str) -> tuple[np.ndarray, int]:
    """In how many documents each word occurs, and how many documents there are."""
    terms = sent.value.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, total = sent.value, 0
        df = np.zeros(terms + 1, np.int64)
        for batch in batches:
            for b in pieces(batch, 0, TOGETHER):
                at, _, _ = counted(b.column(0), known)
                df += np.bincount(at, minlength=len(df))
                total += b.num_rows
        df[-1] = total
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], names=["term", "n"])
        release()

    parts = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "term long, n long")
    found = parts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per word of the examples at most
    df = np.zeros(terms + 1, np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return df[:-1], int(df[-1])


def signed(x: np.ndarray, most: int) -> np.ndarray:
    """x in the narrowest signed type that holds up to `most`, as every worker keeps the index."""
    return x.astype(np.min_scalar_type(-1 - most))


class BlockMaxIndex:
    """Lists of the examples' unit vectors: whole ones, and others cut into blocks of examples; a cell is what a term has in
    a block, and `ceiling` its greatest weight."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], terms: int) -> None:
        self.n = len(examples)
        self.blocks = max(1, -(-self.n // BLOCK))
        who = np.repeat(np.arange(self.n), [len(a) for a, _ in examples]).astype(np.int64)
        term = np.concatenate([a for a, _ in examples]) if self.n else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in examples]) if self.n else np.zeros(0)
        held = np.bincount(term, minlength=terms)
        many = np.flatnonzero(held > max(BLOCK, self.n // WHOLE))
        self.place = np.full(terms, -1)  # row of a term's whole list
        self.place[many] = np.arange(len(many))
        self.whole = np.zeros((len(many), self.blocks * BLOCK))
        often = self.place[term] >= 0
        self.whole[self.place[term[often]], who[often]] = weight[often]
        who, term, weight = who[~often], term[~often], weight[~often]
        order = np.lexsort((who, term))
        who, self.weight = who[order], weight[order]
        cell = term[order] * self.blocks + who // BLOCK
        names, first = np.unique(cell, return_index=True)
        self.who, self.first = signed(who, self.n), signed(first, len(cell))
        self.many = signed(np.diff(np.append(first, len(cell))), BLOCK)
        self.block = signed(names % self.blocks, self.blocks)
        self.ceiling = np.maximum.reduceat(self.weight, self.first) if len(cell) else np.zeros(0)
        self.cells = np.searchsorted(names, np.arange(terms + 1) * self.blocks)  # where a term's cells begin

    def sums_of_whole(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What whole lists add to every example's cosine, for many documents."""
        dense = np.zeros((len(vectors), len(self.whole)))
        for i, (at, weight) in enumerate(vectors):
            row = self.place[at]
            dense[i, row[row >= 0]] = weight[row >= 0]
        return dense @ self.whole

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, leave: int = -1, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers and cosines of the k nearest examples with a cosine above 0, and how many blocks were read; leave: an
        example that doesn't count; start: this document's sums of whole lists, if they are known."""
        start = self.sums_of_whole([(at, weight)])[0] if start is None else start
        cut = self.place[at] < 0
        begin, end = self.cells[at[cut]], self.cells[at[cut] + 1]
        cells = _ranges(begin, end - begin)
        own, block = np.repeat(weight[cut], end - begin), self.block[cells]
        bound = start.reshape(self.blocks, BLOCK).max(1) + np.bincount(block, own * self.ceiling[cells], self.blocks)
        order = np.argsort(-bound, kind="stable")
        best, cosine, done, upto = np.zeros(0, np.int64), np.zeros(0), 0, FIRST
        while done < len(order) and bound[order[done]] > 0:
            some = np.zeros(self.blocks, bool)
            some[order[done:upto]] = True
            here = np.flatnonzero(some[block])
            those = cells[here]
            many = self.many[those]
            spots = _ranges(self.first[those], many)
            sums = np.bincount(self.who[spots], self.weight[spots] * np.repeat(own[here], many), len(start))
            sums = sums + start
            if leave >= 0:
                sums[leave] = 0
            who = np.flatnonzero((sums > (max(0.0, cosine[-1] - 1e-12) if len(best) == k else 0.0)) & np.repeat(some, BLOCK))
            who, sums = np.concatenate([best, who]), np.concatenate([cosine, sums[who]])
            top = np.lexsort((who, -sums))[:k]
            best, cosine, done = who[top], sums[top], min(upto, len(order))
            # All blocks that may hold a nearer example are read next, and that ends it, as the k-th cosine only rises.
            least = cosine[-1] - 1e-12 if len(best) == k else 0.0
            upto = done + int((bound[order[done:]] >= max(least, 1e-300)).sum())
            if upto == done:
                break
        return best, cosine, done


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start and size, in a row."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing fit of y on x (pool adjacent violators)."""
    values, where = np.unique(x, return_inverse=True)
    sums, weights = np.bincount(where, y * w), np.bincount(where, w)
    pools: list[list[float]] = []
    for v, s, n in zip(values.tolist(), sums.tolist(), weights.tolist(), strict=True):
        pools.append([v, v, s, n])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    knots = [(v, s / n) for a, z, s, n in pools for v in ((a, z) if a != z else (a,))]
    return np.array([v for v, _ in knots]), np.array([s for _, s in knots])


class Classifier:
    """Index, weights and calibration."""

    def __init__(self, examples: Examples, df: np.ndarray, total: int) -> None:
        self.term_weight = np.log((2 + total) / (1 + df)) * examples.relevance()
        self.label, weight = examples.label, examples.weight
        self.rate = float(weight @ self.label / weight.sum()) if len(weight) else 0.0
        vectors = [self.unit(at, tf) for at, tf in examples.vectors]
        self.index = BlockMaxIndex(vectors, len(df))
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        if len(vectors):
            votes = np.array([self.vote(*self.index.nearest(*v, leave=i)[:2]) for i, v in enumerate(vectors)])
            self.knots = isotonic(np.append(votes, self.rate), np.append(self.label, self.rate), np.append(weight, weight.mean()))

    def unit(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(tf)) * self.term_weight[at]
        return at, weight / np.sqrt((weight**2).sum()) if len(at) else weight

    def vote(self, who: np.ndarray, cosine: np.ndarray) -> float:
        """Share of toxic neighbours by cosine, next to the prior's weight."""
        return float((cosine @ self.label[who] + PRIOR * self.rate) / (cosine.sum() + PRIOR))

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[float], list[list[int]]]:
        """Calibrated score of each document, and its nearest examples as evidence."""
        vectors = [self.unit(at, tf) for at, tf in found]
        out, evidence = [], []
        for at in range(0, len(vectors), BATCH):
            some = vectors[at : at + BATCH]
            for v, start in zip(some, self.index.sums_of_whole(some), strict=True):
                who, cosine, _ = self.index.nearest(*v, start=start)
                vote = self.vote(who, cosine) if len(who) else self.rate
                out.append(float(np.clip(np.interp(vote, *self.knots), 0, 1)) if self.index.n else 0.0)
                evidence.append(who.tolist())
        return out, evidence


def classify(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(row, doc_id, score, evidence) of every row of docs; evidence: doc_ids of the nearest examples, nearest first."""
    spark, docs = docs.sparkSession, steady(docs)
    ship(spark)
    chosen, stands = labelled_ids(labels, key, label, held_out)
    examples = read_examples(docs, chosen, stands, key, text)
    terms = spark.sparkContext.broadcast(Numbered(examples.number))
    fitted = Classifier(examples, *document_frequencies(docs, terms, text))
    sent = spark.sparkContext.broadcast((fitted, examples.ids))
    slim = with_row(docs, doc_id=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        (model, ids), known = sent.value, terms.value
        for batch in batches:
            for b in pieces(batch, 2, TOGETHER):
                at, tf, sizes = counted(b.column(2), known)
                cuts = np.cumsum(sizes)[:-1]
                scores, evidence = model.scores(list(zip(np.split(at, cuts), np.split(tf, cuts), strict=True)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([[ids[i] for i in e] for e in evidence], pa.list_(b.schema.field(1).type))], names=["row", "doc_id", "score", "evidence"])
        release()

    schema = slim.select("row", "doc_id").schema.add("score", "double").add("evidence", T.ArrayType(slim.schema["doc_id"].dataType))
    return slim.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose score reaches the threshold; the columns stay as they are."""
    docs = steady(docs)
    bad = classify(docs, labels, key=key, text=text).where(F.col("score") >= threshold).select("row")
    return without_rows(docs, stored(bad, "toxic"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: learn from two thirds of the labelled ids, score all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = classify(docs, labels)
    return found.select("doc_id", (text_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
