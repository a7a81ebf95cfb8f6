"""Language identification, language-model scoring and toxicity."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daymosaic.llm import langid, lm, toxicity

from .conftest import ODD

# Everyday words of four languages.
SPEECH = {
    "en": "the of and to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous comme mais pouvoir avec tout y aller voir bien où sans tu ou leur homme si deux même être très".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr".split(),
}


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(SPEECH[g], k=rng.choice([4, 30, 120]))), g) for i, g in enumerate(rng.choices(list(SPEECH), k=400))]
    return spark.createDataFrame([*rows, (1000, None, "en"), (1001, "!?", "fr"), (1002, "the of and", None), (None, "der die und das ist", "de")], "doc_id long, text string, lang string").repartition(3)


def test_languages_of_held_out_texts(spark, speech):
    model = langid.fit(speech)
    got = langid.predict(speech.drop("lang"), model)
    joined = got.join(speech, "doc_id").where("doc_id < 1000").collect()
    held = [r for r in joined if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 50 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in joined)
    rest = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.where("doc_id is null or doc_id >= 1000").collect()}
    assert rest[1000] == rest[1001] == ("und", 0.0) and rest[1002][0] == "en" and rest[None][0] == "de"


def slow_spectrum(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = " " + " ".join(words) + " "
    return {line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)} if words else set()


def slow_kernel(x, y):
    return len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y)))


def test_kernel_counts_shared_grams_of_any_script():
    texts = ["the of, and", "Привет мир", "你好 世界 the", "γειά σου κόσμε", "être à"]
    spectra = [langid.spectrum(t.encode()) for t in texts]
    assert [len(g) for g in spectra] == [len(slow_spectrum(t)) for t in texts]
    want = [[slow_kernel(slow_spectrum(a), slow_spectrum(b)) for b in texts] for a in texts]
    assert langid.kernel(spectra, spectra) == pytest.approx(np.array(want))
    assert not len(langid.spectrum(b"12 !?")) and not len(langid.spectrum(b""))


def test_model_equals_a_slow_kernel_machine(spark, speech, monkeypatch):
    """Nystroem features and ridge regression from slow kernel values, against the folded batched product."""
    monkeypatch.setattr(langid, "LANDMARKS", 5)
    monkeypatch.setattr(langid, "CHUNK", 100)
    model = langid.fit(speech)
    sample = langid._sample(speech, "doc_id", "text", "lang", (4, 2)).collect()
    marks = []
    for lang in sorted({r["lang"] for r in sample}):
        marks += [r["text"] for r in sorted((r for r in sample if r["lang"] == lang), key=lambda r: r["u"])[:5] if slow_spectrum(r["text"])]
    rows = [r for r in sample if slow_spectrum(r["text"])]
    k = lambda a, b: np.array([[slow_kernel(slow_spectrum(x), slow_spectrum(y)) for y in b] for x in a])
    values, vectors = np.linalg.eigh(k(marks, marks))
    inverse_root = vectors @ np.diag(np.where(values > 1e-8 * values.max(), np.maximum(values, 1e-12) ** -0.5, 0)) @ vectors.T
    feature = k([r["text"] for r in rows], marks) @ inverse_root
    y = np.array([[1.0 if r["lang"] == x else -1.0 for x in model["languages"]] for r in rows])
    ridge = np.linalg.solve(feature.T @ feature + langid.RIDGE * len(rows) * np.eye(len(marks)), feature.T @ y)
    texts = [*marks, "the of and to in", "être et à il avoir", "für über", "xyz"]
    want = np.clip((k(texts, marks) @ inverse_root @ ridge + 1) / 2, 1e-6, 1)
    want /= want.sum(1, keepdims=True)
    names, scores = langid.score_texts([t.encode() for t in texts], model)
    assert names == [model["languages"][i] for i in want.argmax(1)] and scores == pytest.approx(want.max(1), abs=1e-4)


def test_scripts_without_a_common_letter(spark):
    rng = random.Random(4)
    letters = {"ru": "абвгдежзиклмнопрст", "el": "αβγδεζηθικλμνξοπρ", "zh": "的一是不了人我在有他这中大来上", "ko": "가나다라마바사아자차카타파하", "en": "abcdefghijklmnopqr"}
    rows = [(i, " ".join("".join(rng.choices(letters[g], k=rng.randrange(1, 6))) for _ in range(20)), g) for i, g in enumerate(rng.choices(list(letters), k=300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got == {i: g for i, _, g in rows}


def test_languages_of_odd_documents(spark, docs_of):
    docs = docs_of(ODD)
    assert langid.predict(docs, langid.fit(docs)).count() == len(ODD)
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


# --- language model ---


def slow_base(rows, divisor=5, out=1):
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % divisor == out for d, _ in rows]
    words = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for (d, _), h, ws in zip(rows, held, words, strict=True)]


def scored(docs):
    return lm.score(docs).collect()


@pytest.mark.parametrize("frequent", [5, 100_000])
def test_base_scores_equal_the_formula(spark, docs_of, monkeypatch, frequent):
    """Also when nearly all words are looked up by the join."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = random.Random(1)
    rows = [*ODD, *[(i, " ".join(rng.choices([*SPEECH["en"], "The", "x y", "É"], k=rng.randrange(40)))) for i in range(60)]]
    got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in scored(docs_of(rows))], key=repr)
    want = sorted(slow_base(rows), key=repr)
    key = lambda r: (repr(r[0]), r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_model_beats_the_base_where_context_tells(spark, speech):
    rows = [r for r in scored(speech) if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 4 * len(rows)


def test_probabilities_add_up_to_one(spark, speech, monkeypatch):
    """Over all units, and over the words of a class's rest with one unknown word."""
    monkeypatch.setattr(lm, "WORDS_BY_TYPES", 3)
    words = lm.count_words(speech.where("doc_id % 2 = 0"), "text")
    v = lm.Vocabulary(words, 200)
    model = lm.train(speech.where("doc_id % 2 = 0"), "doc_id", "text", v, rounds=1)
    rng, n = np.random.default_rng(0), int(v.units[-1])
    assert 1 + lm.SHAPES < n < 1 + lm.SHAPES + len(v.unit)
    for context in rng.integers(0, n, (5, lm.CONTEXT)):
        p = model.log10_probability(np.repeat(context[None], n, 0), np.arange(n))
        assert (10**p).sum() == pytest.approx(1, abs=1e-4)
    for s in range(lm.SHAPES):
        own = [i for i, u in enumerate(v.unit) if u == v.rest[s]]
        assert sum(10 ** v.inside[i] for i in own) + 0.5 / 10 ** v.shape_total[s] == pytest.approx(1)


def test_scores_equal_a_slow_model(spark, docs_of, monkeypatch):
    """Token by token: class, unit in the class, share in the rest, each from the parameters by plain loops."""
    monkeypatch.setattr(lm, "WORDS_BY_TYPES", 2)
    monkeypatch.setattr(lm, "FREQUENT", 40)
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.setdefault("model", kept.setdefault("v", a[3]) and train(*a)))
    rng = random.Random(2)
    rows = [*[r for r in ODD if r[0] not in (104, 105)], *[(i, " ".join(rng.choices([*SPEECH["en"], *SPEECH["fr"]], k=rng.randrange(30)))) for i in range(80)], (900, "unseen words the of")]
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["score"]) for r in scored(docs_of(rows)))
    model, v = kept["model"], kept["v"]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    words = [(t or "").encode().lower().split() for _, t in rows]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    modelled = {w: int(v.unit[i]) for w, i in v.places.items() if v.unit[i] not in v.rest}
    assert 5 < len(modelled) < len(counts) and len(v.places) < len(counts)
    want = []
    for (d, _), ws in zip(rows, words, strict=True):
        before, total = [0, 0, 0], 0.0
        for w in [*ws, None]:
            h = [sum(float(model.r[u][k] * model.c[j][k]) for j, u in enumerate(before)) for k in range(lm.WIDTH)]
            group = 0 if w is None else 1 + lm.shape(w)
            unit = 0 if w is None else modelled.get(w, int(v.rest[group - 1]))
            dot = lambda q, h=h: sum(x * float(y) for x, y in zip(h, q, strict=True))
            classes = [math.exp(dot(model.p[i]) + float(model.a[i])) for i in range(1 + lm.SHAPES)]
            inside = {i: math.exp(dot(model.q[i]) + float(model.b[i])) for i in range(int(v.units[group]), int(v.units[group + 1]))}
            p = classes[group] / sum(classes) * inside[unit] / sum(inside.values())
            if w is not None and w not in modelled:
                rest = {x: c for x, c in counts.items() if x not in modelled and lm.shape(x) == group - 1}
                p *= (rest.get(w, 0) + 0.5) / (sum(rest.values()) + 0.5 * (len(rest) + 1))
            total += math.log10(p)
            before = [unit, *before[:2]]
        want.append((repr(d), len(ws) + 1, total))
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-4)


def test_units_grow_with_the_vocabulary(spark, docs_of):
    size = lambda n: int(lm.Vocabulary(lm.count_words(docs_of([(1, " ".join(f"w{i}" for i in range(n)))]), "text"), 1).units[-1]) - 1 - lm.SHAPES
    assert size(400) == 160 and size(10_000) == 800


def test_results_are_averaged_in_a_tree(spark):
    rng = np.random.default_rng(0)
    change, samples = rng.normal(size=(300, 6)).astype(np.float16), rng.integers(1, 9, 300)
    parts = spark.createDataFrame([(i, int(samples[i]), bytearray(change[i].tobytes())) for i in range(300)], "part long, samples long, change binary")
    rows = lm.merged(parts, 300).collect()
    assert len(rows) == 2 and sum(r["samples"] for r in rows) == samples.sum()
    mean = sum(r["samples"] * np.frombuffer(bytes(r["change"]), np.float16).astype(float) for r in rows) / samples.sum()
    assert mean == pytest.approx((change.astype(float) * samples[:, None]).sum(0) / samples.sum(), abs=3e-3)


def test_training_step_follows_the_gradient():
    """The loss of batches falls where the word before tells the next, among units of one class and of others."""
    rng = np.random.default_rng(0)
    counts, units = np.array([10.0, 500, 300, 200, 100]), np.array([0, 1, 3, 5])
    model = lm.Model.start(counts, units)
    trainer = lm.Trainer(model, counts, 0)
    context = rng.integers(1, 5, (40_000, lm.CONTEXT)).astype(np.int32)
    target = np.where(rng.random(40_000) < 0.9, context[:, 0], 1).astype(np.int32)  # mostly the word before
    before = model.log10_probability(context, target).mean()
    for at in range(0, 40_000, 2048):
        trainer.step(context[at : at + 2048], target[at : at + 2048])
    after = lm.Model(units, model.flat.copy()).log10_probability(context, target).mean()
    assert after > before + 0.2


def test_no_training_documents(spark, docs_of):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = scored(docs_of([(held, "a b")]))
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0
    assert scored(docs_of([(1, "a")]).limit(0)) == []


# --- toxicity ---

BAD = ["scumx", "idiotx", "loserx", "trashx", "moronx"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = rng.choices([f"w{rng.randrange(3000)}", *SPEECH["en"]], k=60)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(60), rng.choice(BAD) + rng.choice(["", ".", "###"]))
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, int(toxic)))
    copy = " ".join(f"copyword{chr(97 + i)}{chr(97 + i // 5)}" for i in range(25)) + " idiotx scumx"
    rows += [(2000 + i, copy) for i in range(60)]  # copies of one toxic document
    labels += [(2000 + i, 1) for i in range(60)]
    rows += [(3000, copy.replace("idiotx scumx", "")[:60] + " " + " ".join(SPEECH["en"])), (3001, None), (3002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs.withColumns({"row": F.lit(1), "at": F.lit(2), "toxic": F.lit("x"), "tf": F.lit(0)}), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")


def test_toxic_documents_are_found(spark, labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    for i in range(900):
        assert (got[i]["score"] >= toxicity.THRESHOLD) == (i % 6 == 0), i
    assert got[2000]["score"] > 0.7 and got[2000]["evidence"]
    assert got[3000]["score"] < 0.7  # shares rare words with the copies, but none that toxic documents share
    assert got[3001]["score"] == got[3002]["score"] < 0.3
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(i % 6 != 0 for i in range(900)) + 3


@pytest.mark.parametrize("seed", range(3))
def test_neighbours_are_exact(seed, monkeypatch):
    """Against all cosines; few terms, so that some lists are whole, and steps of few blocks."""
    rng = np.random.default_rng(seed)
    terms = 400
    chance = 1 / np.arange(1, terms + 1)

    def vector():
        at = np.sort(rng.choice(terms, rng.integers(1, 30), replace=False, p=chance / chance.sum()))
        w = rng.integers(1, 4, len(at)) * (1 + at.astype(float))
        return at, w / np.sqrt((w**2).sum())

    examples = [vector() for _ in range(700)]
    index = toxicity.BlockMaxIndex(examples, terms)
    assert 0 < len(index.whole) < terms
    dense = np.zeros((700, terms))
    for i, (a, w) in enumerate(examples):
        dense[i, a] = w
    read = 0
    for n in range(60):
        at, w = vector()
        cosine = dense[:, at] @ w
        leave = 7 * n if n % 2 else -1
        if n % 2:
            cosine[leave] = 0
        want = [i for i in np.lexsort((np.arange(700), -np.round(cosine, 12)))[: toxicity.NEIGHBOURS] if cosine[i] > 0]
        who, got, blocks = index.nearest(at, w, leave=leave)
        read += blocks
        assert np.allclose(got, cosine[want]) and np.allclose(cosine[who], got)
    assert read < 60 * index.blocks  # some blocks' bounds are too low


def slow_scores(texts, labelled, neighbours=15, groups=None):
    """Scores by plain loops: weights, cosines with all examples, votes without oneself, isotonic calibration.

    groups: which labelled documents are copies of each other; the first (toxic first, then by id) stands for them all.
    """
    def terms(t):
        return Counter(x for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split() for x in toxicity.terms_of(w))

    bags = {i: terms(t) for i, t in texts.items()}
    order, members = [], {}
    for i in sorted(labelled, key=lambda i: (-labelled[i], i)):
        members.setdefault(i if groups is None else ("g", groups[i]), []).append(i)
    order = [m[0] for m in members.values()]
    labelled = {m[0]: sum(labelled[i] for i in m) / len(m) for m in members.values()}
    n, toxic = len(order), sum(labelled.values())
    weight = {}
    for t in {t for i in order for t in bags[i]}:
        a = sum(labelled[i] for i in order if t in bags[i])
        b = sum(1 - labelled[i] for i in order if t in bags[i])
        spread = toxic * (n - toxic) * (a + b) * (n - a - b)
        chi2 = n * max(0, abs(a * (n - toxic - b) - b * (toxic - a)) - n / 2) ** 2 / spread if spread else 0
        idf = math.log((2 + len(texts)) / (1 + sum(t in x for x in bags.values())))
        weight[t] = idf * (0.01 + 0.99 * chi2 / (chi2 + 20))

    def unit(i):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in bags[i].items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    units = {i: unit(i) for i in texts}
    rate = toxic / n

    def vote(i, leave):
        near = sorted((-round(sum(x * units[j].get(t, 0) for t, x in units[i].items()), 12), place, j) for place, j in enumerate(order) if j != leave)[:neighbours]
        near = [(-c, j) for c, _, j in near if c < 0]
        return (sum(c * labelled[j] for c, j in near) + 0.5 * rate) / (sum(c for c, _ in near) + 0.5) if units[i] else rate

    points = sorted([(vote(i, i), labelled[i], 1.0) for i in order] + [(rate, rate, 1.0)])
    pools = []
    for x, y, w in points:
        pools.append([x, x, y * w, w])
        while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]):
            z = pools.pop()
            pools[-1] = [pools[-1][0], z[1], pools[-1][2] + z[2], pools[-1][3] + z[3]]
    xs, ys = [p[k] for p in pools for k in (0, 1)], [p[2] / p[3] for p in pools for _ in (0, 1)]
    return {i: float(np.interp(vote(i, None), xs, ys)) for i in texts}


def test_votes_and_calibration_equal_slow_loops(spark):
    """classify() against plain loops, on texts whose copies none of the sketch's keys join."""
    rng = random.Random(8)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnrs") + rng.choice("aeiou") + rng.choice(["", "t", "ks", "ster"])
    texts = {i: " ".join([word() for _ in range(rng.choice([8, 30]))] + [rng.choice(BAD) for _ in range(2 * (i % 3 == 0))]) for i in range(120)} | {500: None, 501: "12 !"}
    labels = {i: int(i % 3 == 0) for i in range(120) if i % 5 and zlib.crc32(str(i).encode()) % 3 != 1}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    given = spark.createDataFrame([(i, y) for i, y in labels.items()] + [(i, 1) for i in range(120) if i % 5 and i not in labels], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, given).collect()}
    want = slow_scores(texts, labels)
    assert got == pytest.approx(want, abs=1e-9) and len(set(np.round(list(want.values()), 6))) > 3


def test_words_are_runs_of_letters():
    import pyarrow as pa

    texts = ["Ab, c3d É-日本 x_y", None, "", "  ", "Z", "İstanbul ß"]
    codes, words, sizes = toxicity.words_in(pa.array(texts))
    assert sizes.tolist()[:5] == [7, 0, 0, 0, 1] and [words[i] for i in codes[:8]] == ["ab", "c", "d", "é", "日本", "x", "y", "z"]
    broken = pa.array([b"ab\xff c", b"d"]).view(pa.string())
    codes, words, sizes = toxicity.words_in(broken)
    assert [words[i] for i in codes] == ["ab", "c", "d"] and sizes.tolist() == [2, 1]


def test_isotonic_is_monotone_and_keeps_means():
    rng = np.random.default_rng(1)
    x, w = rng.integers(0, 20, 200) / 20, rng.uniform(0.5, 2, 200)
    y = (rng.random(200) < x).astype(float)
    knots = toxicity.isotonic(x, y, w)
    fitted = np.interp(x, *knots)
    assert (np.diff(knots[1]) >= 0).all() and (fitted * w).sum() == pytest.approx((y * w).sum())


def test_near_copies_are_grouped():
    base = [f"word{i}" for i in range(200)]
    other = [*base[:100], "changed", *base[101:]]
    keys = [toxicity.sketch(w) for w in (base, other, [f"else{i}" for i in range(200)], [])]
    groups = toxicity.copies(keys)
    assert groups[0] == groups[1] != groups[2] != groups[3]


def test_few_or_no_labels(spark, docs_of):
    docs = docs_of(ODD)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.classify(docs, labels).collect()} == {0.0}
    few = spark.createDataFrame([(104, 1), (105, 0), (106, 0), (106, 1)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.classify(docs, few).collect())
    assert toxicity.classify(docs.limit(0), few).count() == 0


def test_terms_are_looked_up_for_many_words_at_once():
    """The same numbers as word by word, without a look-up for every new word."""

    class Watched(dict):
        asked = 0

        def get(self, *key):
            Watched.asked += 1
            return super().get(*key)

    texts = [None, "", " 12 ", "é É ñ 日本 😀 abcde ABCD abcdef abcdeg", "Handat handatss hand ab*", *(f"w{chr(97 + i)}rd the Thehand" for i in range(26))]
    number = Watched((t, i) for i, t in enumerate(dict.fromkeys(t for w in ("handat", "hand", "thehand", "abcde", "日本", "wxrd", "é") for t in toxicity.terms_of(w))))
    at, tf, sizes = toxicity.counted(pa.array(texts), toxicity.Numbered(number))
    assert Watched.asked == 0
    ends = sizes.cumsum()
    for text, a, z in zip(texts, ends - sizes, ends, strict=True):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        want = Counter(number[t] for w in words for t in toxicity.terms_of(w) if t in number)
        assert dict(zip(at[a:z].tolist(), tf[a:z].tolist(), strict=True)) == want and (at[a:z] == sorted(want)).all()
