"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Classes and units. A word's class is a hash of its last letters; the end of a text is a class of its own. The most frequent
training words are units of their own, WORDS_BY_TYPES times the square root of the number of distinct training words, so the
model grows with the corpus; a class's other words are one unit, its rest, inside which a word has its smoothed share of
the training count. So a word's probability is that of its class given the words before, times that of its unit given
the class and the words before, times its share; these add up to one over all known words and one unknown word per class.

Model. A position's vector is the sum over the preceding CONTEXT units of c_j * r_unit (elementwise); the score of a class
or of a unit inside its class is its product with a vector q plus a bias. Training contrasts every position with noise
classes, and with noise units of the position's class, both from unigrams, in numpy; scoring multiplies batches of
positions by all classes, and a class's positions by all its units, and normalises both exactly.

Scale. Words are counted over all training documents and meet once in a shuffle of per-task sums. Training is data
parallel: in each round every task trains on its own share of the documents from the shared parameters, and what the
tasks changed is averaged by TREE at a time until the driver has that many. Counts of the FREQUENT words go to the workers (bounded); the rarer words of
all documents, a fixed share of the input, are looked up by a join that is shuffled by word.

Defined cases: a null text is empty (its only token is the end); a null doc_id counts as the empty text for the split;
repeated rows are scored each; without training documents all counts are 0; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_BYTES, pieces, ship, split_words, steady, stored, text_remainder, with_row

#: Words whose counts every worker holds; units by the square root of the distinct words; classes but for the end's.
FREQUENT, WORDS_BY_TYPES, SHAPES = 131_072, 8, 128
CONTEXT, WIDTH = 3, 32
#: Rounds (each on its own part of the documents), noise classes, noise units of a class, positions of a batch, rate.
ROUNDS, NOISE, INSIDE, BATCH, RATE = 2, 32, 8, 4096, 0.15
#: Positions that are scored at once, and scores that are made at once.
SCORED, ROOM = 32_768, 1 << 18
#: Longest runs of equal rows that are added up place by place.
SHORT = 4
#: Steps that a worker takes on a piece of text, however short it is.
LEAST_STEPS = 24
#: Results of tasks that are averaged together.
TREE = 16
LOG10 = float(np.log(10))
END = 0


def shape(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SHAPES


def count_words(training: DataFrame, text: str) -> DataFrame:
    """Stored (word, shape, c) over all training documents."""
    ship(training.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([shape(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "shape", "c"])

        counts: Counter[bytes] = Counter()
        for batch in batches:
            for b in pieces(batch, 0, ARROW_BYTES):
                codes, words, _ = split_words(b.column(0))
                for w, n in zip(words.tolist(), np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                    if n:
                        counts[w] += n
                if len(counts) > 150_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    partial = training.select(F.col(text).alias("text")).mapInArrow(run, "word binary, shape int, c long")
    return stored(partial.groupBy("word", "shape").agg(F.sum("c").alias("c")), "words")


class Vocabulary:
    """Statistics of the training words; its size is bounded by FREQUENT."""

    def __init__(self, words: DataFrame, documents: int) -> None:
        step = F.floor(F.log2("c") * 8)
        by_step = sorted(words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect(), reverse=True)
        kept, least = 0, None
        for r in by_step:  # whole steps of the count, as long as they fit
            if kept + r["n"] > FREQUENT:
                break
            kept, least = kept + r["n"], r["step"]
        frequent = words.where(step >= least).collect() if least is not None else []
        frequent.sort(key=lambda r: (-r["c"], r["word"]))
        self.tokens = sum(r["c"] for r in by_step) + documents
        self.types = sum(r["n"] for r in by_step) + (documents > 0)
        self.end_count = documents
        own = frequent[: int(np.ceil(WORDS_BY_TYPES * np.sqrt(max(0, self.types - 1))))]
        totals = {r["shape"]: (r["c"], r["n"]) for r in words.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
        rest_count, rest_types = (np.array([totals.get(s, (0, 0))[i] for s in range(SHAPES)], float) for i in (0, 1))
        members: list[list[int]] = [[] for _ in range(SHAPES)]
        for i, r in enumerate(own):
            members[r["shape"]].append(i)
            rest_count[r["shape"]] -= r["c"]
            rest_types[r["shape"]] -= 1
        #: First unit of each class, and the number of units; a class's last unit is its rest. Unit and class 0: the end.
        self.units = np.concatenate([[0], 1 + np.cumsum([0, *[len(m) + 1 for m in members]])])
        self.rest = self.units[2:] - 1
        #: word -> place; unit, count and log10(share in its unit) by place.
        self.places = {bytes(r["word"]): i for i, r in enumerate(frequent)}
        self.counts = np.array([r["c"] for r in frequent], float)
        self.shape_total = np.log10(rest_count + 0.5 * (rest_types + 1))
        shapes = np.array([r["shape"] for r in frequent], np.int64)
        self.unit = self.rest[shapes].astype(np.int32) if frequent else np.zeros(0, np.int32)
        self.inside = np.log10(self.counts + 0.5) - self.shape_total[shapes] if frequent else np.zeros(0)
        self.unit_counts = np.zeros(self.units[-1])
        self.unit_counts[0], self.unit_counts[self.rest] = documents, rest_count
        for first, m in zip(self.units[1:].tolist(), members, strict=False):
            self.unit[m], self.inside[m] = np.arange(first, first + len(m)), 0.0
            self.unit_counts[first : first + len(m)] = self.counts[m]

    def units_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Unit and place (-1: not among the frequent) of each word."""
        get = self.places.get
        place = np.array([get(w, -1) for w in words], np.int64)
        unit = self.unit[place] if len(self.unit) else np.zeros(len(words), np.int32)
        rare = np.flatnonzero(place < 0)
        unit[rare] = self.rest[[shape(words[i]) for i in rare.tolist()]] if len(rare) else 0
        return unit, place


def sorting(keys: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers below a bound; small ones are sorted by digits."""
    return np.argsort(keys.astype(np.uint16) if below <= 1 << 16 else keys, kind="stable")


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, starts and ends of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[starts], starts, np.append(starts[1:], len(sorted_keys))[: len(starts)]


class Model:
    """Parameters as one vector; r: context units, q: predicted units, p: predicted classes, c: places of the context,
    b and a: biases of units and classes. units: first unit of each class, and the number of units."""

    def __init__(self, units: np.ndarray, flat: np.ndarray) -> None:
        n, classes = int(units[-1]), len(units) - 1
        sizes = np.cumsum([0, n * WIDTH, n * WIDTH, classes * WIDTH, CONTEXT * WIDTH, n, classes])
        self.first, self.flat = units, flat
        self.r, self.q, self.p, self.c, self.b, self.a = (flat[i:j] for i, j in zip(sizes, sizes[1:], strict=False))
        self.r, self.q, self.p, self.c = (x.reshape(-1, WIDTH) for x in (self.r, self.q, self.p, self.c))
        self.class_of = np.repeat(np.arange(classes), np.diff(units))

    @classmethod
    def start(cls, unit_counts: np.ndarray, units: np.ndarray) -> Model:
        n, classes, rng = int(units[-1]), len(units) - 1, np.random.default_rng(0)
        m = cls(units, rng.normal(0, 0.1, n * (2 * WIDTH + 1) + classes * (WIDTH + 1) + CONTEXT * WIDTH).astype(np.float32))
        m.c[:] = 1.0
        by_class, inside = noise_of(unit_counts, units)
        m.a[:], m.b[:] = np.log(by_class), np.log(inside)
        return m

    def vectors(self, context: np.ndarray) -> np.ndarray:
        h = np.take(self.r, context[:, 0], axis=0) * self.c[0]
        for j in range(1, CONTEXT):
            h += np.take(self.r, context[:, j], axis=0) * self.c[j]
        return h

    def log10_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target unit: of its class over all classes, times of the unit over all units of the class."""
        group = self.class_of[target]
        order = sorting(group, len(self.first))
        h, target, group = self.vectors(context[order]), target[order], group[order]
        size, out = _length(h), np.zeros(len(h))
        parts = [(self.p, self.a, group, 0, 0, len(h))]
        for k, i, j in zip(*(x.tolist() for x in runs(group)), strict=True):
            first, last = self.first[k], self.first[k + 1]
            if last - first > 1:
                parts.append((self.q[first:last], self.b[first:last], target, first, i, j))
        for q, bias, own, first, start, end in parts:
            some, most = max(1, ROOM // len(q)), size * _length(q) + float(np.abs(bias).max())
            for i in range(start, end, some):
                j = min(i + some, end)
                out[i:j] += _own_log(h[i:j], q, bias, own[i:j] - first, most)
        result = np.empty(len(out))
        result[order] = out / LOG10
        return result


def _length(x: np.ndarray) -> float:
    """The greatest length of a row."""
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))


def _own_log(h: np.ndarray, q: np.ndarray, bias: np.ndarray, own: np.ndarray, most: float) -> np.ndarray:
    """Logarithm of each row's softmax of h @ q.T + bias at its own column; most: a bound of the scores' sizes."""
    scores = h @ q.T
    scores += bias
    mine = scores[np.arange(len(own)), own]
    # Within 60 no exponential overflows, nor do all of a row vanish.
    if not most <= 60 and (scores.max(initial=0) > 60 or scores.min(initial=0) < -60):
        peak = scores.max(1)
        scores -= peak[:, None]
        mine -= peak
    return mine - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], scores.dtype))


def noise_of(unit_counts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unigram of the classes, and of each unit inside its class."""
    weight = unit_counts + 0.5
    sums = np.add.reduceat(weight, units[:-1])
    return sums / sums.sum(), weight / np.repeat(sums, np.diff(units))


def contexts(units: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The CONTEXT units before each position, nearest first; the end unit stands before a text's beginning.

    units: texts one after another, each closed by END; starts: where each text begins.
    """
    out = np.empty((len(units), CONTEXT), np.int32)
    since = np.arange(len(units)) - np.repeat(starts, np.diff(np.append(starts, len(units))))
    for j in range(CONTEXT):
        out[j + 1 :, j] = units[: -j - 1]
        out[since <= j, j] = END
    return out


def _sigma(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation with noise shared by a batch, or by a class's positions in it, and per-parameter
    (Adagrad) rates; only rows that a batch touches are updated."""

    def __init__(self, model: Model, unit_counts: np.ndarray, seed: int) -> None:
        self.m, self.rng = model, np.random.default_rng(seed)
        by_class, inside = noise_of(unit_counts, model.first)
        self.log_class, self.class_cdf = np.log(by_class * NOISE).astype(np.float32), np.cumsum(by_class)
        self.log_inside = np.log(inside * INSIDE).astype(np.float32)
        self.cdf = np.cumsum(by_class[model.class_of] * inside)
        self.sums = Model(model.first, np.full_like(model.flat, 0.1))
        self.samples = 0

    def _update(self, name: str, grad: np.ndarray, n: int, rows: np.ndarray | slice = slice(None)) -> None:
        past, p = getattr(self.sums, name), getattr(self.m, name)
        grad *= np.float32(1 / np.sqrt(n))
        seen = grad * grad
        seen += past[rows] if isinstance(rows, slice) else np.take(past, rows, axis=0)
        past[rows] = seen
        grad *= np.float32(RATE)
        grad /= np.sqrt(seen, out=seen)
        p[rows] -= grad

    def _by_row(self, index: np.ndarray, *grads: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct rows, and the sums of each gradient for them."""
        order = sorting(index, len(self.m.r))
        rows, starts, ends = runs(index[order])
        count = ends - starts
        long = np.flatnonzero(count > SHORT)
        rest = np.flatnonzero(np.repeat(count > SHORT, count) & (np.arange(len(order)) - np.repeat(starts, count) >= SHORT))
        of_long = np.cumsum(count[long] - SHORT) - (count[long] - SHORT)
        places = [(has, order[starts[has] + k]) for k in range(1, SHORT) if len(has := np.flatnonzero(count > k))]
        out = []
        for g in grads:
            total = np.take(g, order[starts], axis=0)
            for has, at in places:
                total[has] += np.take(g, at, axis=0)
            if len(long):  # numbers are added in twos, which takes half as many loops
                total[long] += np.add.reduceat(np.take(g, order[rest], axis=0).view(np.complex64 if g.ndim > 1 else g.dtype), of_long, axis=0).view(g.dtype)
            out.append(total)
        return rows, *out

    def noise_units(self, classes: np.ndarray) -> np.ndarray:
        """INSIDE units of each class, by their unigram in it."""
        first, last = self.m.first[classes], self.m.first[classes + 1]
        low = np.where(first > 0, self.cdf[first - 1], 0.0)
        drawn = low[:, None] + self.rng.random((len(classes), INSIDE)) * (self.cdf[last - 1] - low)[:, None]
        return np.clip(np.searchsorted(self.cdf, drawn), first[:, None], last[:, None] - 1)

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        m, n = self.m, len(target)
        group = m.class_of[target]
        order = sorting(group, len(m.first))
        context, target, group = context[order], target[order], group[order]
        rows = [np.take(m.r, context[:, j], axis=0) for j in range(CONTEXT)]
        h = rows[0] * m.c[0]
        for x, c in zip(rows[1:], m.c[1:], strict=True):
            h += x * c
        # d loss / d score: sigma(score - log(k * noise)) - 1 for what is there, sigma(...) for noise.
        noise = np.minimum(np.searchsorted(self.class_cdf, self.rng.random(NOISE)), len(self.class_cdf) - 1)
        own, others = np.take(m.p, group, axis=0), m.p[noise]
        e = _sigma(m.a[group] + np.einsum("ij,ij->i", h, own) - self.log_class[group]) - 1
        f = _sigma(h @ others.T + (m.a[noise] - self.log_class[noise]))
        own *= e[:, None]
        dh = f @ others
        dh += own
        dp, da = np.zeros_like(m.p), np.zeros_like(m.a)
        names, starts, ends = runs(group)
        for k, i, j in zip(names, starts, ends, strict=True):
            dp[k] = e[i:j] @ h[i:j]
        da[names] = np.add.reduceat(e, starts)
        np.add.at(dp, noise, f.T @ h)
        np.add.at(da, noise, f.sum(0))
        # The end is a class of one unit and stands first.
        z = int(ends[0]) if m.first[names[0] + 1] - m.first[names[0]] == 1 else 0
        if z < n:
            names, starts, ends = (x[1:] if z else x for x in (names, starts - z, ends - z))
            hz, dz, inner = h[z:], dh[z:], target[z:]
            drawn = self.noise_units(names)
            near, vectors = np.take(m.q, inner, axis=0), m.q[drawn]
            bias = m.b[drawn] - self.log_inside[drawn]
            s = np.empty((n - z, INSIDE), np.float32)
            for v, d, i, j in zip(vectors, bias, starts, ends, strict=True):
                np.matmul(hz[i:j], v.T, out=s[i:j])
                s[i:j] += d
            s = _sigma(s)
            g = _sigma(m.b[inner] + np.einsum("ij,ij->i", hz, near) - self.log_inside[inner]) - 1
            near *= g[:, None]
            dz += near
            dn = np.empty_like(vectors)
            for k, (v, i, j) in enumerate(zip(vectors, starts, ends, strict=True)):
                dz[i:j] += s[i:j] @ v
                dn[k] = s[i:j].T @ hz[i:j]
            touched, dq, db = self._by_row(np.concatenate([inner, drawn.ravel()]), np.concatenate([g[:, None] * hz, dn.reshape(-1, WIDTH)]), np.concatenate([g, np.add.reduceat(s, starts, axis=0).ravel()]))
            self._update("q", dq, n, touched)
            self._update("b", db, n, touched)
        dc = np.stack([np.einsum("ij,ij->j", dh, x) for x in rows])
        touched, dr = self._by_row(context.T.ravel(), (dh[None] * m.c[:, None]).reshape(-1, WIDTH))
        self._update("r", dr, n, touched)
        for name, grad in (("p", dp), ("a", da), ("c", dc)):
            self._update(name, grad, n)
        self.samples += n


class Piece(NamedTuple):
    """Some rows and their texts as units, each text closed by END."""

    rows: pa.RecordBatch
    words: np.ndarray  # distinct words
    codes: np.ndarray  # of all words
    sizes: np.ndarray  # words of each text
    units: np.ndarray
    starts: np.ndarray  # of the texts, in units
    place: np.ndarray  # of all words among the frequent ones, or -1


def _as_units(batches: Iterator[pa.RecordBatch], text: int, vocabulary: Vocabulary) -> Iterator[Piece]:
    for batch in batches:
        for b in pieces(batch, text, 2 << 20):
            codes, words, sizes = split_words(b.column(text))
            unit, place = vocabulary.units_of(words.tolist())
            upto = np.cumsum(sizes)
            yield Piece(b, words, codes, sizes, np.insert(unit[codes], upto, END), upto - sizes + np.arange(len(sizes)), place[codes])


def merged(parts: DataFrame, tasks: int) -> DataFrame:
    """Results (part, samples, change) averaged by TREE at a time, weighted by samples, until there are TREE at most."""

    def average(group: pa.Table) -> pa.Table:
        total, change = 0, 0.0
        for n, x in zip(group.column("samples").to_pylist(), group.column("change").to_pylist(), strict=True):
            total, change = total + n, change + n * np.frombuffer(x, np.float16).astype(np.float32)
        return pa.table({"part": group.column("part")[:1], "samples": [total], "change": [(change / total).astype(np.float16).tobytes()]})

    while tasks > TREE:
        tasks = -(-tasks // TREE)
        parts = parts.withColumn("part", F.floor(F.col("part") / TREE)).groupBy("part").applyInArrow(average, "part long, samples long, change binary")
    return parts


def train(training: DataFrame, key: str, text: str, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Rounds of data-parallel training; every training document takes part in one of them, with all its positions."""
    sc = training.sparkSession.sparkContext
    model = Model.start(vocabulary.unit_counts, vocabulary.units)
    words = sc.broadcast(vocabulary)
    slim = training.select(F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("round")), F.lit(rounds)).alias("round"))
    tasks = slim.rdd.getNumPartitions()
    for turn in range(rounds):
        start = sc.broadcast(model.flat.copy())

        def run(batches: Iterator[pa.RecordBatch], start: object = start, turn: int = turn) -> Iterator[pa.RecordBatch]:
            v, task = words.value, TaskContext.get().partitionId()
            t = Trainer(Model(v.units, start.value.copy()), v.unit_counts, 1000 * turn + task)
            for p in _as_units(batches, 0, v):
                units, before = p.units, contexts(p.units, p.starts)
                spots = np.arange(len(units))
                t.rng.shuffle(spots)
                size = min(BATCH, max(64, len(spots) // LEAST_STEPS))
                for at in range(0, len(spots), size):
                    some = spots[at : at + size]
                    t.step(before[some], units[some])
            if t.samples:
                change = (t.m.flat - start.value).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([t.samples]), pa.array([change.tobytes()], pa.binary())], names=["part", "samples", "change"])

        trained = slim.where(F.col("round") == turn).select("text").mapInArrow(run, "part long, samples long, change binary")
        parts = merged(trained, tasks).collect()
        if parts:
            shares = np.array([r["samples"] for r in parts], float)
            mean = sum(w * np.frombuffer(bytes(r["change"]), np.float16).astype(float) for w, r in zip(shares / shares.sum(), parts, strict=True))
            model = Model(vocabulary.units, (model.flat + mean).astype(np.float32))
    return model


def score(docs: DataFrame, held_out: tuple[int, int] = (5, 1), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document row."""
    spark, docs = docs.sparkSession, steady(docs)
    ship(spark)
    held = text_remainder(key, held_out[0]) == held_out[1]
    training = docs.where(~held)
    words = count_words(training, text)
    vocabulary = Vocabulary(words, training.count())
    model = train(training, key, text, vocabulary)
    sent = spark.sparkContext.broadcast((vocabulary, model.flat))
    slim = with_row(docs, doc_id=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, flat = sent.value
        m = Model(v.units, flat)
        for b, words, codes, sizes, units, starts, place in _as_units(batches, 2, v):
            before, log10 = contexts(units, starts), np.empty(len(units))
            for at in range(0, len(units), SCORED):
                log10[at : at + SCORED] = m.log10_probability(before[at : at + SCORED], units[at : at + SCORED])
            texts = len(sizes)
            doc = np.repeat(np.arange(texts), sizes)
            known = place >= 0
            inside = np.zeros(len(place))
            if known.any():
                inside[known] = v.inside[place[known]]
            inside[~known] = -v.shape_total[m.class_of[np.delete(units, starts + sizes)[~known]] - 1]
            counted = np.bincount(doc[known], np.log10(v.counts[place[known]] + 0.5), texts) if known.any() else np.zeros(texts)
            model_part = np.add.reduceat(log10, starts) + np.bincount(doc, inside, texts)
            n_known = np.bincount(doc[known], minlength=texts) + (v.end_count > 0)
            rows = b.column(0).to_pylist()
            none, n = pa.nulls, b.num_rows
            # A document's own row carries a key that no word equals, as words hold no space.
            marks = pa.array([b" %d %d" % (r["file"], r["at"]) for r in rows], pa.binary())
            columns = [marks, b.column(0), none(n, pa.int64()), pa.array(np.ones(n, bool)), b.column(1), pa.array(sizes + 1), pa.array(n_known.astype(np.int64)), pa.array(counted + np.log10(v.end_count + 0.5)), pa.array(model_part)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            rare, n = np.unique(doc[~known] * len(words) + codes[~known], return_counts=True)
            if len(rare):
                k, rare_doc = len(rare), rare // len(words)
                columns = [pa.array(words[rare % len(words)], pa.binary()), b.column(0).take(pa.array(rare_doc)), pa.array(n), none(k, pa.bool_()), none(k, b.schema.field(1).type), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.float64()), none(k, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["word", "row", "n", "whole", "doc_id", "n_tokens", "n_known", "counted", "model_part"]
    schema = docs.select(F.lit(b"").alias("word"), F.struct(F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("at")).alias("row"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("whole"), F.col(key).alias("doc_id")).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("counted", "double"), ("model_part", "double")):
        schema = schema.add(name, kind)
    for f in schema.fields:
        f.nullable = True
    scored = slim.mapInArrow(run, schema).join(words.select("word", "c"), "word", "left")
    log_c = F.when(F.col("whole").isNull(), F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).otherwise(0.0)
    whole = scored.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"), F.max("counted").alias("counted"), F.max("model_part").alias("model_part"),
        F.sum(log_c).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0)).alias("rare_known"),
    )
    total = float(np.log10(vocabulary.tokens + 0.5 * (vocabulary.types + 1)))
    return whole.select(
        "doc_id", (text_remainder("doc_id", held_out[0]) == held_out[1]).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("rare_known")).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("counted") + F.col("rare") - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("model_part") + F.col("rare")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: train on four fifths of the documents' ids, score all."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
