import math
"""Exact top-k search, archives, and license scans."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymosaic.llm import licenses, topk, warc

from ..conftest import same_rows
from .conftest import ODD


def brute_top(rows, k):
    """Python's integers; every row but the query's own is a candidate; rows without id stand last among equals."""
    good = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (q, x) in enumerate(good):
        if q is not None and q % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i is None, i or 0) for m, (i, y) in enumerate(good) if m != n and len(y) == len(x))
            out += [(q, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def got_top(df, k, **options):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(df, k, **options).collect()), key=repr)


@pytest.mark.parametrize(("seed", "spread", "kind"), [(0, 1.0, "float"), (1, 0.002, "float"), (2, 1e4, "double")])
def test_top_k_equals_brute_force(spark, monkeypatch, seed, spread, kind):
    """Small spread gives many equal scores, lengths differ by a factor of 50, ids repeat."""
    rng = np.random.default_rng(seed)
    number = (lambda x: x.astype(np.float32).tolist()) if kind == "float" else (lambda x: x.tolist())
    rows = [(i, number(rng.normal(0, spread * rng.choice([1, 50]), 6))) for i in range(-200, 500)]
    rows += [(700, None), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (900, [float("nan")] * 6), (1000, [float("inf")] * 6), (1100, [0.0] * 6), (1200, [1.0]), (1201, [2.0]), (100, [9.0] * 6), (100, [9.0] * 6), (None, [9.0] * 6), (None, [1.0] * 6), (1300, [])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("row", F.lit(1))
    monkeypatch.setattr(topk, "BLOCK_BYTES", 128 * 6 * 8)
    assert got_top(df, 5) == brute_top(rows, 5)


def test_large_scores_are_exact_or_an_error(spark):
    rows = [(0, [20000.0, 1.0]), (1, [30000.0, 0.0]), (2, [20000.0, 5.0]), (100, [2.0**40, -(2.0**40)]), (3, [2.0**40 + 1, 2.0**40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got_top(df.where("vec_id < 3"), 3) == brute_top(rows[:3], 3)
    assert [r[:3] for r in got_top(df.where("vec_id in (0, 1, 2)"), 2)] == [(0, 1, 1), (0, 2, 2)]
    assert got_top(df.where("vec_id in (100, 3)"), 3) == [(100, 1, 3, 1 << 60)]  # the products need 120 bits, their sum 61
    with pytest.raises(Exception, match="OVERFLOW|CAST"):
        got_top(spark.createDataFrame([(0, [2.0**30]), (1, [2.0**30])], "vec_id long, embedding array<double>"), 1)


def test_bands_that_cannot_win_are_not_read(spark):
    """Short vectors are never scored once the long ones gave k scores; reading stops early where few dimensions matter."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(0, 1, 4) * (1000 if i % 7 == 0 else 1) * np.array([1, 0.1, 0.01, 0.001])).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got_top(df, 10) == brute_top(rows, 10)
    long = {i for i, _ in rows if i % 7 == 0}
    best = topk.exact_top_k(df).collect()
    assert sum(r["scored"] < 400 for r in best if r["query_id"] in long) > 0


def test_reading_stops_early_when_one_dimension_decides():
    rng = np.random.default_rng(2)
    v = rng.integers(-5, 6, (4000, 8)).astype(float)
    v[:, 0] = np.arange(4000)
    lists = topk.SortedLists(np.arange(4000), v)
    ids, scores, scored = lists.search(np.array([1000.0, 1, 0, 0, 0, 0, 0, -1]), -1)
    assert scored < 1000 and ids.tolist() == np.lexsort((np.arange(4000), -(v @ np.array([1000.0, 1, 0, 0, 0, 0, 0, -1]))))[:10].tolist()


def test_no_vectors(spark):
    df = spark.createDataFrame([(0, [1e30, -1e30])], "vec_id long, embedding array<double>")
    assert topk.exact_top_k(df.limit(0)).count() == 0 and topk.exact_top_k(df).count() == 0


def test_top_k_query_equals_sql(spark, sf, duck):
    assert same_rows(topk.query(spark, sf), duck, topk.SQL)


# --- archives ---


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_by_declared_lengths(version):
    tricky = b"http://x 0.0.0.0 20000101000000 text/html 5\nhello\n\nWARC/1.0\r\n\r\n"
    records = [warc.ArcRecord("http://a/b", "1.2.3.4", "20010203040506", "text/html", tricky, "404"), warc.ArcRecord("dns:x", "0.0.0.0", "1999", "text/dns", b"")]
    got = list(warc.read_arc(warc.write_arc(records, version)))
    assert [r[:5] for r in got] == [r[:5] for r in records]
    assert got[0].status == ("404" if version == 2 else "-")


def test_damaged_archives_are_refused():
    raw = warc.write_arc([warc.ArcRecord("u", "0", "20000101000000", "t", b"body")], 1)
    for bad in (raw[:-4], raw.replace(b"filedesc", b"nothing!"), raw.replace(b"\n1 0 ", b"\n9 0 "), raw.replace(b"u 0 2000", b"u 2000")):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))
    record = warc.to_warc(warc.ArcRecord("u", "0", "20000101", "t", b"body"), 1, None)
    with pytest.raises(ValueError):
        list(warc.read_warc(record.replace(b"body", b"bodx")))
    with pytest.raises(ValueError):
        list(warc.read_warc(record[:-3]))


def test_archives_are_closed_by_bytes(spark, tmp_path, monkeypatch):
    """Files of bounded bytes, a larger record alone; also when many digests occur more than once."""
    from daymosaic.llm import common

    rows = [(i, f"http://h/{i}", "page " * (i % 40)) for i in range(300)] + [(1000, "http://h/big", "x" * 30_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    schema = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(tuple(r) for r in warc.arc_to_warc(pages).select(*schema).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    raw = b"".join(warc.to_warc(warc.ArcRecord("u", "0", "20000101000000", "t", b"x" * 20_000), 1, None) for _ in range(2))
    assert len(list(warc.read_warc(raw))) == 2
    path = tmp_path.as_uri() + "/w"
    assert sorted(tuple(r) for r in warc.arc_to_warc(pages, path).select(*schema).collect()) == want
    assert sum(r[3] == "revisit" for r in want) == 260 and {r[4] for r in want} <= {None, *range(260, 300)}


def test_dates_and_identifiers():
    assert [warc.warc_date(d) for d in ("20010203040506", "200102030405", "20010203")] == ["2001-02-03T04:05:06Z", "2001-02-03T04:05:00Z", "2001-02-03T00:00:00Z"]
    a, b = warc.record_id("u", "d", "x", 1), warc.record_id("u", "d", "x", 2)
    assert a != b and a == warc.record_id("u", "d", "x", 1) and a.startswith("<urn:uuid:")
    assert warc.arc_url(" a b\n") == "%20a%20b%0A" and warc.arc_url(None) == "urn:none"


def test_pages(spark, tmp_path):
    rows = [(1, "http://a", "same"), (5, "http://b c", "same"), (3, None, "same"), (None, "http://n", "same"), (7, "u", None), (8, "u", ""), (9, "u", "é\r\n\r\nWARC/1.0 x"), (9, "u", "é\r\n\r\nWARC/1.0 x"), (10, "v", "z" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS sha", "2 AS owner")
    got = sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.arc_to_warc(df, tmp_path.as_uri() + "/w").collect()], key=repr)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    owner = {"same": 5, "": 8, rows[6][2]: 9, rows[8][2]: 10}
    want = [(p, len((h or "").encode()), sha(h), "response" if p == owner[h or ""] else "revisit", None if p == owner[h or ""] else owner[h or ""]) for p, _, h in rows]
    assert got == sorted(want, key=repr)
    kept = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, tmp_path.as_uri() + "/w", with_payload=True).collect()}
    assert bytes(kept[9]).decode() == rows[6][2] and kept[1] is None
    alone = warc.arc_to_warc(df, tmp_path.as_uri() + "/v", least=5).where("record_type = 'revisit'").collect()
    assert alone == []


def test_no_pages(spark):
    assert warc.arc_to_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_query_equals_sql(spark, sf, duck):
    assert same_rows(warc.query(spark, sf), duck, warc.SQL)


# --- licenses ---


def plain_coverage(template, words):
    """Longest common subsequence over the best stretch, unbanded."""
    n, m = len(template), len(words)
    table = np.zeros((n + 1, m + 1), int)
    for i in range(n):
        for j in range(m):
            table[i + 1, j + 1] = table[i, j] + 1 if template[i] == words[j] else max(table[i, j + 1], table[i + 1, j])
    return table[n, m] / n


def test_every_template_is_found_where_it_stands():
    index = licenses._index(tuple(sorted(licenses.TEMPLATES.items())))
    for name, template in licenses.TEMPLATES.items():
        text = f"Some words before. {template.upper()} And after."
        (found,) = [r for r in licenses.scan_text(text.encode(), index) if r[0] == name]
        n = len(licenses.words_of(template))
        assert found[1:5] == (n, 1.0, 3, 3 + n) and text[found[5] : found[6]].upper().startswith(template.upper()[:10].lstrip('"'))


def test_changed_templates_against_plain_alignment():
    rng = random.Random(4)
    index = licenses._index(tuple(sorted(licenses.TEMPLATES.items())))
    for name in ("MIT", "Apache-2.0", "ISC", "GPL-3.0-or-later"):
        words = licenses.words_of(licenses.TEMPLATES[name])
        for _ in range(6):
            share = rng.choice([0.02, 0.1])
            copy = [w for w in words if rng.random() > share / 2]
            copy = [x for w in copy for x in ([w, "zzz"] if rng.random() < share / 2 else ["yyy"] if rng.random() < share / 2 else [w])]
            got = [r for r in licenses.scan_text(" ".join(["aa", *copy, "bb"]).encode(), index) if r[0] == name]
            want = plain_coverage(words, copy)
            if want >= 0.85:
                assert got and got[0][2] == pytest.approx(want, abs=0.03) and got[0][2] <= want + 1e-9


def test_repeated_beginnings_keep_spans_apart_and_cost_little():
    """A notice, a thousand times its first words, the notice: two stretches, each where it stands."""
    import time

    index = licenses._index(tuple(sorted(licenses.TEMPLATES.items())))
    mit = licenses.TEMPLATES["MIT"]
    n = len(licenses.words_of(mit))
    text = " ".join([mit, *["Permission is hereby granted free of charge"] * 1000, mit]).encode()
    began = time.process_time()
    got = [r for r in licenses.scan_text(text, index) if r[0] == "MIT"]
    assert time.process_time() - began < 3
    assert [r[1:5] for r in got] == [(n, 1.0, 0, n), (n, 1.0, n + 7000, 7000 + 2 * n)]


def test_other_versions_are_not_taken_for_each_other():
    index = licenses._index(tuple(sorted(licenses.TEMPLATES.items())))
    names = lambda t: [r[0] for r in licenses.scan_text(t.encode(), index)]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0-line"]
    assert names("This work is licensed under the GNU General Public License, version 7.") == []
    assert names("Licensed under CC BY-SA 3.0.") == ["CC-BY-SA-3.0-line"] and names("Licensed under the Apache License, Version 1.1.") == []


def test_a_fifth_of_the_words_may_differ_anywhere():
    """Every template, with as many words replaced as `least` allows, evenly or at random, is found."""
    rng = random.Random(6)
    index = licenses._index(tuple(sorted(licenses.TEMPLATES.items())))
    for name, template in licenses.TEMPLATES.items():
        words = licenses.words_of(template)
        free = [i for i, w in enumerate(words) if not w.isdigit()]
        changes = len(words) - math.ceil(licenses.LEAST * len(words) - 1e-9)
        for trial in range(6):
            spots = set(rng.sample(free, changes)) if trial else {free[len(free) * (2 * i + 1) // (2 * changes)] for i in range(changes)}
            text = " ".join(["q", *("zzz" if i in spots else w for i, w in enumerate(words)), "q"])
            assert any(matched / len(index.templates[index.names.index(n)]) >= licenses.LEAST for n, matched, *_ in licenses.scan_text(text.encode(), index)), (name, text)


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(0)
    for n in range(1, 30):
        h = rng.integers(0, 8, n).astype(np.uint64)
        kept = set(licenses.winnow(h, 4).tolist())
        assert all(any(a + j in kept and h[a + j] == h[a : a + 4].min() for j in range(4)) for a in range(max(0, n - 3)))


def test_scan(spark, docs_of):
    docs = docs_of([*ODD, (1, "x Released under the MIT License. y Licensed under CC BY-NC 4.0."), (2, "Released*** under$$$ the### MIT&&& License.%%%"), (3, "released under a license"), (4, "Released under the MIT License.\n" * 3)])
    got = sorted((r["doc_id"], r["license"], r["coverage"], r["start_word"], r["end_word"]) for r in licenses.scan(docs).collect())
    assert got == [(1, "CC-BY-NC-4.0-line", 1.0, 7, 14), (1, "MIT-line", 1.0, 1, 6), (2, "MIT-line", 1.0, 0, 5), (4, "MIT-line", 1.0, 0, 5), (4, "MIT-line", 1.0, 5, 10), (4, "MIT-line", 1.0, 10, 15)]
    assert licenses.scan(docs.limit(0)).count() == 0
