"""Language identification with a string kernel.

Kernel: texts are compared by which n-grams (1 to 3 letters, words separated by one space) they hold at all, the
blended spectrum; k(x, y) is the number of shared n-grams over the geometric mean of the two numbers. N-grams are of code
points, whatever the script, and none are left out. Landmark texts of every language give the Nystroem features
K(x, L) K(L, L)^-1/2; a ridge regression per language separates it from the rest. As the kernel is linear in presence
vectors, scoring multiplies a batch of presence rows by the matrix of landmark n-grams x languages into which landmarks and
regressions are folded.

Fitted on a bounded sample of labelled documents (PER_LANGUAGE of each language, whole texts, chosen by a hash of the
id). Features and the normal equations' sums are made in tasks; the driver holds the landmarks' n-grams (at most LANDMARKS
of a language and MOST_LANDMARKS in all, but FEWEST of each language), and matrices of landmarks x landmarks. Every document is scored on
its whole text.

Defined cases: null texts and texts without a letter are `und` with score 0; no labelled document at all makes every
document `und`; a text without any n-gram of a landmark is equally like all languages, and the first is given; rows
without language or text teach nothing; repeated rows each get a row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import maybe_broadcast, pieces, ship, stored, text_remainder, texts_of, uniform

#: Labelled documents of a language that are fitted on, and the ridge's strength per document.
PER_LANGUAGE, RIDGE = 300, 1e-3
#: Landmarks of a language, in all, and of a language however many languages there are.
LANDMARKS, MOST_LANDMARKS, FEWEST = 32, 1024, 4
#: Tasks that sum the sample's normal equations, numbers in a batch's presence rows, columns multiplied at once.
TASKS, BATCH_CELLS, CHUNK = 8, 4 << 20, 1 << 14
#: Bits of a code point in an n-gram's code; a space is 0, and codes of shorter n-grams are tagged.
POINT = 21


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def points(text: bytes) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), "<u4")


def spectrum(text: bytes) -> np.ndarray:
    """Sorted distinct codes of all 1-, 2- and 3-grams of a text; none if it has no letter."""
    p = points(text).astype(np.int64)
    c = np.concatenate([[0], np.where(_is_letter()[p], p, 0), [0]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one space around and between words
    if not c.any():
        return np.zeros(0, np.int64)
    pair = (c[:-1] << POINT) | c[1:]
    # No code point needs all 21 bits, so tags in the third place's highest bits can't be met by a 3-gram.
    grams = np.concatenate([c | (3 << 61), pair | (1 << 62), ((pair[:-1] << POINT) | c[2:])])
    grams.sort()
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


def presence(spectra: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1: which of the (sorted) columns each spectrum holds."""
    x = np.zeros((len(spectra), len(columns)), np.float32)
    for row, g in zip(x, spectra, strict=True):
        at = np.minimum(np.searchsorted(columns, g), max(0, len(columns) - 1))
        if len(columns):
            row[at[columns[at] == g]] = 1
    return x


def kernel(spectra: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """k of every text with every landmark, by matrix products over chunks of the landmarks' n-grams."""
    columns = np.unique(np.concatenate(landmarks)) if landmarks else np.zeros(0, np.int64)
    shared = np.zeros((len(spectra), len(landmarks)))
    for at in range(0, len(columns), CHUNK):
        some = columns[at : at + CHUNK]
        shared += presence(spectra, some) @ presence(landmarks, some).T
    sizes = [np.maximum(1, np.array([len(g) for g in s], float)) for s in (spectra, landmarks)]
    return shared / np.sqrt(np.outer(*sizes))


def _sample(docs: DataFrame, key: str, text: str, lang: str, held_out: tuple[int, int]) -> DataFrame:
    """A bounded sample (text, lang, u): PER_LANGUAGE documents of each language in expectation."""
    divisor, out = held_out
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (text_remainder(key, divisor) != out))
    counts = labelled.groupBy(F.col(lang).alias("lang")).count()
    share = stored(counts.select("lang", F.least(F.lit(1.0), F.lit(float(PER_LANGUAGE)) / F.col("count")).alias("share")), "langs")
    slim = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), uniform(F.col(key), F.lit("lang")).alias("u"))
    return stored(slim.join(maybe_broadcast(share), "lang").where("u < share").select("text", "lang", "u"), "sample")


def _landmarks(sample: DataFrame) -> list[tuple[str, np.ndarray]]:
    """(language, spectrum) of the landmark texts: those of each language that the sample's hash puts first."""
    languages = sample.select("lang").distinct().count()
    each = min(LANDMARKS, max(FEWEST, MOST_LANDMARKS // max(1, languages)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("u", F.xxhash64("text")))
    chosen = sample.withColumn("n", first).where(F.col("n") <= each).select("text", "lang", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, lang, n in zip(texts_of(b, 0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.int32()), pa.array([spectrum(t)], pa.list_(pa.int64()))], names=["lang", "n", "grams"])

    found = sorted((r["lang"], r["n"], r["grams"]) for r in chosen.mapInArrow(run, "lang string, n int, grams array<long>").collect())
    return [(lang, np.array(g, np.int64)) for lang, _, g in found if g]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out: tuple[int, int] = (4, 2)) -> dict:
    """The model: languages, columns (the landmarks' n-grams), weights (columns x languages); also its parts: marks,
    root (K(L, L)^-1/2) and ridge (features x languages)."""
    spark = docs.sparkSession
    ship(spark)
    sample = _sample(docs, key, text, lang, held_out)
    named = _landmarks(sample)
    languages = sorted({name for name, _ in named})
    if not languages:
        return {"languages": [], "columns": np.zeros(0, np.int64), "weights": np.zeros((0, 0), np.float32)}
    marks = [g for _, g in named]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    sent = spark.sparkContext.broadcast((marks, root, languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, root, languages = sent.value
        place = {name: i for i, name in enumerate(languages)}
        width = root.shape[1]
        sums, n = np.zeros((width, width + len(languages))), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                known = [(g, place[x]) for g, x in ((spectrum(t), x) for t, x in zip(texts_of(b, 0), b.column(1).to_pylist(), strict=True)) if len(g) and x in place]
                if known:
                    feature = kernel([g for g, _ in known], marks) @ root
                    y = np.full((len(known), len(languages)), -1.0)
                    y[np.arange(len(known)), [x for _, x in known]] = 1
                    sums += feature.T @ np.concatenate([feature, y], 1)
                    n += len(known)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tobytes()], pa.binary())], names=["n", "sums"])

    parts = sample.select("text", "lang").coalesce(TASKS).mapInArrow(run, "n long, sums binary").collect()
    width = root.shape[1]
    sums = sum(np.frombuffer(bytes(r["sums"])).reshape(width, -1) for r in parts)
    n = sum(r["n"] for r in parts)
    ridge = np.linalg.solve(sums[:, :width] + RIDGE * n * np.eye(width), sums[:, width:])
    columns = np.unique(np.concatenate(marks))
    folded = root @ ridge / np.sqrt(np.array([[len(g)] for g in marks], float))
    weights = np.concatenate([presence(marks, columns[at : at + CHUNK]).T.astype(float) @ folded for at in range(0, len(columns), CHUNK)])
    return {"languages": languages, "columns": columns, "weights": weights.astype(np.float32), "marks": marks, "root": root, "ridge": ridge}


def score_texts(texts: list[bytes], model: dict) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    columns, languages = model["columns"], model["languages"]
    spectra = [spectrum(t) for t in texts]
    letters = np.array([len(g) > 0 for g in spectra])
    if not languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    raw = np.zeros((len(texts), len(languages)))
    rows = max(1, BATCH_CELLS // max(1, len(columns)))
    for at in range(0, len(texts), rows):
        raw[at : at + rows] = presence(spectra[at : at + rows], columns) @ model["weights"]
    raw /= np.sqrt(np.maximum(1, np.array([[len(g)] for g in spectra], float)))
    share = np.clip((raw + 1) / 2, 1e-6, 1)
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    return [languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, share.max(1), 0.0)


def predict(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document row, from its text alone."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("languages", "columns", "weights")})
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 1):
                names, scores = score_texts(texts_of(b, 1), sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores.astype(float))], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, slim.select("doc_id").schema.add("lang_pred", "string").add("score", "double"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: learn from three quarters of the documents' ids, predict all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs))
    return found.select("doc_id", (text_remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
