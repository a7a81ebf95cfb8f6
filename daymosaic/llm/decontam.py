"""Benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

A benchmark item is cut into windows of consecutive words. Each window is looked up from its rarest terms: the
postings (term, document, position) of those terms are stored in the shared folder, the lists are intersected
after each position is moved back by the term's offset in the item, and what is left is compared word by word with
the neighbourhood that the rarest term's postings carry as payload.

Scale: text is read twice (term frequencies, postings), however long the benchmark is; only postings of rare terms are
kept. The benchmark side of each join is broadcast if its counted rows are few, and else shuffled by term, where AQE
splits hot terms. Lists meet by (document, item, shift), which spreads a hot passage over its documents.

Defined cases: a null or wordless text has no words, no hits and is not contaminated; benchmark rows with a null
item_id or without words are ignored; rows that repeat an item_id count as one item; repeated document rows each get
their own result row; an empty benchmark leaves all documents clean; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import maybe_broadcast, steady, stored, with_row, without_rows

#: Characters that end a word (after A-Z are lower-cased): all ASCII but digits and lower-case letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of benchmark terms, and of looked-up places with their windows, up to which they are broadcast.
TERM_ROWS, PROBE_ROWS = 1_000_000, 200_000
#: Stands for the end of a document in the index; its position is the document's length. No word is empty.
END = ""


def words_of(text: Column) -> Column:
    """Words of a text; ASCII letters in lower case. Null gives an empty array."""
    # lower() equals an A-Z lower-casing on pure ASCII and is much faster than translate().
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def build_index(docs: DataFrame, terms: DataFrame | None, reach: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store postings (term, row, doc_id, pos, context, lead) and one END posting per document row of a steady table.

    terms (term, payload boolean): the terms to index; None indexes every word. Where payload is true a posting carries
    the words up to `reach` before and after it; lead is how many of them stand before it.
    """
    split = with_row(docs, doc_id=key, text=text).select("row", "doc_id", words_of(F.col("text")).alias("words"))
    tokens = split.select("row", "doc_id", "words", F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("pos", "term"))
    if terms is None:
        found = tokens.withColumn("payload", F.lit(False))
    else:
        marker = terms.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(False).alias("payload"))
        found = tokens.join(maybe_broadcast(terms.select("term", "payload").unionByName(marker), TERM_ROWS), "term")
    lead = F.least(F.col("pos"), F.lit(reach))
    context = F.when(F.col("payload"), F.slice("words", F.col("pos") - lead + 1, lead + reach + 1))
    return stored(found.select("term", "row", "doc_id", "pos", context.alias("context"), lead.alias("lead")), "postings")


def term_frequencies(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """How often each term of the vocabulary (a stored table) occurs in all documents."""
    tokens = docs.select(F.explode(words_of(F.col(text))).alias("term"))
    counted = tokens.join(maybe_broadcast(vocabulary, TERM_ROWS), "term").groupBy("term").agg(F.count("*").alias("freq"))
    return vocabulary.join(counted, "term", "left").select("term", F.coalesce("freq", F.lit(0)).alias("freq"))


def plan_windows(items: DataFrame, freq: DataFrame, window: int, depth: int) -> DataFrame:
    """One row per item position that is looked up: (term, item, item_id, p, windows).

    windows is null for positions that only confirm; for the rarest term of a window it lists the windows that
    start from it: off (places before p where the window starts), n, words, others (offsets of the next rarest).
    """
    spots = items.select("item", "item_id", "words", F.posexplode("words").alias("p", "term")).join(freq, "term")
    n = F.least(F.lit(window), F.size("words"))
    inside = spots.withColumn("n", n).withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - F.col("n") + 1), F.least(F.col("p"), F.size("words") - F.col("n")))))
    by_rarity = Window.partitionBy("item", "s").orderBy("freq", "p")
    ranked = inside.withColumn("rank", F.row_number().over(by_rarity)).where(F.col("rank") <= depth)
    windows = ranked.groupBy("item", "item_id", "s", "n").agg(F.min_by("p", "rank").alias("p"), F.min_by("term", "rank").alias("term"), F.max_by("words", "rank").alias("words"), F.collect_list(F.when(F.col("rank") > 1, F.col("p"))).alias("others"))
    entry = F.struct((F.col("p") - F.col("s")).alias("off"), "n", F.slice("words", F.col("s") + 1, F.col("n")).alias("words"), F.transform("others", lambda o: o - F.col("p")).alias("others"))
    seeds = windows.groupBy("term", "item", "item_id", "p").agg(F.collect_list(entry).alias("windows"))
    confirm = ranked.where(F.col("rank") > 1).select("term", "item", "item_id", "p").distinct()
    return confirm.join(seeds, ["term", "item", "item_id", "p"], "full").select("term", "item", "item_id", "p", "windows")


def phrase_matches(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Exact matches (row, item, item_id, spans): intersect offset-adjusted lists, then compare the words themselves.

    spans: start and end (exclusive) of each occurring window, in words of the document.
    """
    met = index.where(F.col("term") != END).join(maybe_broadcast(probes, PROBE_ROWS), "term")
    seed = F.when(F.col("windows").isNotNull(), F.struct("p", "context", "lead", "windows"))
    lists = met.groupBy("row", "item", "item_id", (F.col("pos") - F.col("p")).alias("shift")).agg(F.collect_set("p").alias("present"), F.collect_list(seed).alias("seeds"))

    def occurring(s: Column) -> Column:
        def same(w: Column) -> Column:
            together = F.forall(w["others"], lambda o: F.array_contains(F.col("present"), s["p"] + o))
            # The slice starts at 1 at least, so that windows which would begin before the text fail without an error.
            here = F.slice(s["context"], F.greatest(s["lead"] - w["off"] + 1, F.lit(1)), w["n"])
            return together & (s["lead"] >= w["off"]) & (here == w["words"])

        return F.transform(F.filter(s["windows"], same), lambda w: F.struct((F.col("shift") + s["p"] - w["off"]).alias("start"), (F.col("shift") + s["p"] - w["off"] + w["n"]).alias("end")))

    spans = F.flatten(F.transform("seeds", occurring))
    return lists.select("row", "item", "item_id", spans.alias("spans")).where(F.size("spans") > 0)


def _covered(spans: Column) -> Column:
    """Words under the union of spans, which are sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, depth: int = 2, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: row, doc_id, n_words, n_hit, item_ids (sorted strings), spans (sorted, distinct).

    row names the row of docs (see common.with_row; other tables than Parquet files are stored first). window: words of
    a window; depth: how many of a window's rarest terms are intersected before the words are compared.
    """
    docs = steady(docs)
    items = benchmark.select(F.col(item_key).cast("string").alias("item_id"), words_of(F.col(item_text)).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    items = stored(items.withColumn("item", F.monotonically_increasing_id()), "items")
    vocabulary = stored(items.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    probes = stored(plan_windows(items, term_frequencies(docs, vocabulary, text), window, depth), "probes")
    terms = stored(probes.groupBy("term").agg(F.max(F.col("windows").isNotNull()).alias("payload")), "terms")
    index = build_index(docs, terms, window - 1, key, text)
    found = phrase_matches(index, probes)
    lengths = index.where(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    per_doc = found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    none = F.array().cast("array<string>")
    return lengths.join(per_doc, "row", "left").select("row", "doc_id", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), "spans")


def proximity_matches(docs: DataFrame, phrases: DataFrame, slack: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, phrase_id, start, end): stretches of at most (distinct terms + slack) words that hold all terms of a phrase.

    phrases (phrase_id, text). Each occurrence of the phrase's rarest term is tried with the terms
    around it; the shortest stretch is returned, the first of equals. Phrases without words match nothing.
    """
    docs = steady(docs)
    parsed = stored(phrases.select("phrase_id", F.array_distinct(words_of(F.col("text"))).alias("terms")).where(F.size("terms") > 0), "phrases")
    spots = parsed.select("phrase_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    vocabulary = stored(spots.select("term").distinct(), "vocabulary")
    ranked = spots.join(term_frequencies(docs, vocabulary, text), "term").withColumn("rank", F.row_number().over(Window.partitionBy("phrase_id").orderBy("freq", "term")))
    probes = stored(ranked.select("phrase_id", "n", "term", "rank"), "probes")
    index = build_index(docs, vocabulary.withColumn("payload", F.lit(False)), 0, key, text).where(F.col("term") != END)
    lists = index.join(maybe_broadcast(probes, PROBE_ROWS), "term").select("row", "doc_id", "phrase_id", "n", "term", "rank", "pos")
    width = F.col("n") + slack
    # Meeting by blocks of `width` words keeps every join key small, however often a term occurs in a long text.
    anchors = lists.where("rank = 1").select("row", "doc_id", "phrase_id", "n", F.col("pos").alias("anchor"), F.explode(F.sequence((F.col("pos") / width).cast("int") - 1, (F.col("pos") / width).cast("int") + 1)).alias("cell"))
    around = lists.select("row", "phrase_id", "term", "pos", (F.col("pos") / width).cast("int").alias("cell"))
    near = anchors.join(around, ["row", "phrase_id", "cell"]).where(F.abs(F.col("pos") - F.col("anchor")) < width)
    sets = near.groupBy("row", "doc_id", "phrase_id", "n", "anchor").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("spots"))

    def stretch(a: Column) -> Column:
        # For each start, the earliest end at which all terms have been seen.
        firsts = F.transform(F.array_distinct(F.transform("spots", lambda x: x["term"])), lambda t: F.array_min(F.transform(F.filter("spots", lambda x: (x["term"] == t) & (x["pos"] >= a["pos"])), lambda x: x["pos"])))
        end = F.when(F.exists(firsts, lambda f: f.isNull()) | (F.size(firsts) < F.col("n")), F.lit(None)).otherwise(F.array_max(firsts) + 1)
        return F.struct((end - a["pos"]).alias("len"), a["pos"].alias("start"), end.alias("end"))

    best = F.array_min(F.filter(F.transform("spots", stretch), lambda s: s["end"].isNotNull() & (s["len"] <= width) & (s["start"] <= F.col("anchor")) & (s["end"] > F.col("anchor"))))
    return sets.select("doc_id", "phrase_id", best.alias("m")).where("m is not null").select("doc_id", "phrase_id", F.col("m.start").alias("start"), F.col("m.end").alias("end")).distinct()


def contaminated(found: DataFrame) -> Column:
    """A document is contaminated if a twentieth of its words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that hold any benchmark window, however long the rest of the text; the columns stay as they are.

    The contract's `contaminated` asks for a twentieth of the words and would leave a passage that is quoted in a long
    text. An item of fewer words than a window is one window, so very short items remove every text that holds them.
    """
    docs = steady(docs)
    found = find_contamination(docs, benchmark, key=key, text=text)
    return without_rows(docs, stored(found.where("n_hit > 0").select("row"), "flagged"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document against the whole benchmark."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated(found).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM b WHERE len(w) > 0) x),
dw AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) k WHERE len(w) >= n) x),
m AS (SELECT r, s, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM m) y) z GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) y GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
