"""The queries of queries.py as DuckDB SQL, put together from shared parts."""

from __future__ import annotations

from ..functions.scalar import random_directions

SCHED = """
s0 AS (
  SELECT user_id, event_id, CAST(extract(day FROM ts) AS INT) AS d,
         CAST(extract(hour FROM ts) * 60 + extract(minute FROM ts) AS INT) AS m,
         CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'shop' WHEN 'purchase' THEN 'work'
              WHEN 'signup' THEN 'education' ELSE 'leisure' END AS act
  FROM events),
s1 AS (SELECT user_id, d, act, m, row_number() OVER w AS rn, lead(m) OVER w AS nx FROM s0
       WINDOW w AS (PARTITION BY user_id, d ORDER BY m, event_id)),
sched AS (
  SELECT CASE WHEN d <= 15 THEN 'observed' WHEN d % 2 = 0 THEN 'model_a' ELSE 'model_b' END AS model,
         user_id * 100 + d AS pid, user_id, d, act,
         CAST(CASE WHEN rn = 1 THEN 0 ELSE m END AS DOUBLE) AS start_t, CAST(coalesce(nx, 1440) AS DOUBLE) AS end_t,
         CAST(coalesce(nx, 1440) - CASE WHEN rn = 1 THEN 0 ELSE m END AS DOUBLE) AS duration, rn AS seq
  FROM s1)"""
EP = """
ep AS (
  SELECT *, row_number() OVER (PARTITION BY model, pid, act ORDER BY seq) - 1 AS k, seq - 1 AS pos,
         lead(act, 1) OVER w AS a1, lead(act, 2) OVER w AS a2, lead(act, 3) OVER w AS a3, lead(duration) OVER w AS d1
  FROM sched WINDOW w AS (PARTITION BY model, pid ORDER BY seq))"""
ALL = "mem AS (SELECT model, pid, count(*) AS len, 'all' AS cat FROM sched GROUP BY model, pid)"
BY_SEGMENT = "mem AS (SELECT model, pid, count(*) AS len, any_value(c_mktsegment) AS cat FROM sched JOIN customer ON user_id = c_custkey GROUP BY model, pid)"
BIN = "(floor({0} / 15) * 15 + 7.5) / 1440"

#: name: (rows of values above 0 or of episodes, zeros: least length of persons that count or None, penalty, domain)
VALUES: dict[str, tuple[str, int | None, bool, str]] = {
    "lengths": ("SELECT model, pid, 'sequence lengths' AS segment, CAST([] AS VARCHAR[]) AS acts, count(*) AS v1, NULL AS v2 FROM sched GROUP BY ALL", 0, False, "participations"),
    "participation rate": ("SELECT model, pid, act AS segment, [act] AS acts, count(*) AS v1, NULL AS v2 FROM sched GROUP BY ALL", 0, False, "participations"),
    "pair participation rate": (
        "SELECT a.model, a.pid, a.act || '+' || b.act AS segment, [a.act, b.act] AS acts, least(a.n, b.n) // 2 AS v1, NULL AS v2 "
        "FROM (SELECT model, pid, act, count(*) AS n FROM sched GROUP BY ALL) a JOIN (SELECT model, pid, act, count(*) AS n FROM sched GROUP BY ALL) b "
        "ON a.model = b.model AND a.pid = b.pid AND a.act <= b.act WHERE least(a.n, b.n) >= 2", 0, False, "participations"),
    "seq participation rate": ("SELECT model, pid, CAST(pos AS VARCHAR) || act AS segment, [act] AS acts, 1 AS v1, NULL AS v2 FROM ep", 0, False, "participations"),
    "enum participation rate": ("SELECT model, pid, act || CAST(k AS VARCHAR) AS segment, [act] AS acts, 1 AS v1, NULL AS v2 FROM ep", 0, False, "participations"),
    "2-gram": ("SELECT model, pid, act || '>' || a1 AS segment, [act, a1] AS acts, count(*) AS v1, NULL AS v2 FROM ep WHERE a1 IS NOT NULL GROUP BY ALL", 2, False, "transitions"),
    "3-gram": ("SELECT model, pid, act || '>' || a1 || '>' || a2 AS segment, [act, a1, a2] AS acts, count(*) AS v1, NULL AS v2 FROM ep WHERE a2 IS NOT NULL GROUP BY ALL", 3, False, "transitions"),
    "4-gram": ("SELECT model, pid, act || '>' || a1 || '>' || a2 || '>' || a3 AS segment, [act, a1, a2, a3] AS acts, count(*) AS v1, NULL AS v2 FROM ep WHERE a3 IS NOT NULL GROUP BY ALL", 4, False, "transitions"),
    "full sequences": ("SELECT model, pid, string_agg(substr(act, 1, 1), '>' ORDER BY seq) AS segment, list_distinct(list(act)) AS acts, 1 AS v1, NULL AS v2 FROM sched GROUP BY model, pid", 0, False, "sequences"),
    "start times": ("SELECT model, pid, act || CAST(k AS VARCHAR) AS segment, [act] AS acts, start_t / 1440 AS v1, NULL AS v2 FROM ep", None, True, "timing"),
    "durations": ("SELECT model, pid, act || CAST(k AS VARCHAR) AS segment, [act] AS acts, duration / 1440 AS v1, NULL AS v2 FROM ep", None, True, "timing"),
    "start-durations": (f"SELECT model, pid, act AS segment, [act] AS acts, {BIN.format('start_t')} AS v1, {BIN.format('duration')} AS v2 FROM ep", None, True, "timing"),
    "joint-durations": (f"SELECT model, pid, act AS segment, [act] AS acts, {BIN.format('duration')} AS v1, {BIN.format('d1')} AS v2 FROM ep WHERE a1 IS NOT NULL", None, True, "timing"),
    "start times by act": (f"SELECT model, pid, act AS segment, [act] AS acts, {BIN.format('start_t')} AS v1, NULL AS v2 FROM ep", None, True, "timing"),
    "end times by act": (f"SELECT model, pid, act AS segment, [act] AS acts, {BIN.format('end_t')} AS v1, NULL AS v2 FROM ep", None, True, "timing"),
    "durations by act": (f"SELECT model, pid, act AS segment, [act] AS acts, {BIN.format('duration')} AS v1, NULL AS v2 FROM ep", None, True, "timing"),
    "time consistency": (
        "SELECT model, pid, segment, CAST([] AS VARCHAR[]) AS acts, 1 AS v1, NULL AS v2 FROM ("
        "SELECT model, pid, unnest(['starts at 0', 'ends at 1440', 'duration is 1440']) AS segment, unnest([arg_min(start_t, seq) = 0, arg_max(end_t, seq) = 1440, sum(duration) = 1440]) AS ok FROM sched GROUP BY model, pid) z WHERE ok", 0, False, "timing"),
}
LINES = ("lengths", "participation rate", "pair participation rate", "2-gram", "3-gram", "4-gram", "start times", "durations")
#: Segments that exist even if nobody has them.
ALWAYS = {
    "pair participation rate": "SELECT DISTINCT a.model, a.act || '+' || b.act AS segment, [a.act, b.act] AS acts FROM (SELECT DISTINCT model, act FROM sched) a JOIN (SELECT DISTINCT model, act FROM sched) b ON a.model = b.model AND a.act <= b.act",
    "time consistency": "SELECT DISTINCT model, unnest(['starts at 0', 'ends at 1440', 'duration is 1440']) AS segment, CAST([] AS VARCHAR[]) AS acts FROM sched",
}


def _histograms(names: tuple[str, ...], min_count: int, members: str = ALL) -> str:
    """CTEs up to h(feature, domain, penal, model, cat, segment, v1, v2, w), seg and pres."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS feature, model, pid, segment, acts, CAST(v1 AS DOUBLE) AS v1, CAST(v2 AS DOUBLE) AS v2 FROM ({VALUES[n][0]}) x" for n in names)
    always = "".join(f" UNION SELECT '{n}' AS feature, model, segment, list_sort(acts) AS acts FROM ({ALWAYS[n]}) x" for n in names if n in ALWAYS)
    grams = ", ".join(f"'{n}'" for n in names if n.endswith("gram")) or "''"
    rare = f"WHERE NOT (feature IN ({grams}) AND total < {min_count} AND persons > 10)" if min_count else ""
    base = " ".join(f"WHEN feature = '{n}' THEN {VALUES[n][1]}" for n in names if VALUES[n][1] is not None)
    base = f"CASE {base} END" if base else "NULL"
    return f"""{SCHED}, {EP}, {members},
r AS ({rows}),
ppl AS (SELECT model, count(DISTINCT pid) AS persons FROM sched GROUP BY model),
seg AS (
  SELECT feature, model, segment, acts FROM (
    SELECT feature, model, segment, list_sort(any_value(acts)) AS acts, sum(v1) AS total FROM r GROUP BY feature, model, segment) t JOIN ppl USING (model) {rare}{always}),
sg AS (SELECT feature, model, segment, any_value(acts) AS acts, {base} AS base FROM seg GROUP BY feature, model, segment),
f AS (SELECT feature, model, cat, segment, v1, v2, count(*) AS w FROM r JOIN mem USING (model, pid) SEMI JOIN sg USING (feature, model, segment) GROUP BY ALL),
z AS (
  SELECT sg.feature, sg.model, n.cat, sg.segment, 0.0 AS v1, NULL AS v2, n.n - coalesce(p.n, 0) AS w
  FROM sg JOIN (SELECT model, cat, b.base, count(*) FILTER (len >= b.base) AS n FROM mem, (SELECT DISTINCT base FROM sg WHERE base IS NOT NULL) b GROUP BY ALL) n ON sg.model = n.model AND sg.base = n.base
  LEFT JOIN (SELECT feature, model, cat, segment, sum(w) AS n FROM f GROUP BY ALL) p ON p.feature = sg.feature AND p.model = sg.model AND p.cat = n.cat AND p.segment = sg.segment),
h AS (SELECT feature, model, cat, segment, v1, v2, CAST(sum(w) AS BIGINT) AS w FROM (SELECT * FROM f UNION ALL SELECT * FROM z WHERE w > 0) u GROUP BY ALL)"""


def _scores(names: tuple[str, ...], min_count: int, members: str = ALL) -> str:
    """CTEs up to e(feature, domain, model, cat, segment, value, weight, obs_weight): raw distances of lines."""
    penal = ", ".join(f"'{n}'" for n in names if VALUES[n][2]) or "''"
    domain = "CASE " + " ".join(f"WHEN feature = '{n}' THEN '{VALUES[n][3]}'" for n in names) + " END"
    return f"""{_histograms(names, min_count, members)},
ms AS (SELECT unnest(['model_a', 'model_b']) AS model),
cats AS (SELECT DISTINCT cat FROM mem WHERE model = 'observed'),
pres AS (SELECT model, cat, list(DISTINCT act) AS present FROM sched JOIN mem USING (model, pid) GROUP BY model, cat),
hb AS (
  SELECT h.* FROM h JOIN sg ON h.feature = sg.feature AND h.model = sg.model AND h.segment = sg.segment JOIN pres ON pres.model = h.model AND pres.cat = h.cat
  SEMI JOIN cats ON cats.cat = h.cat WHERE h.model <> 'observed' AND list_has_all(present, acts)),
ok AS (SELECT sg.feature, sg.segment, cats.cat FROM sg, cats WHERE sg.model = 'observed'),
wo AS (SELECT ok.*, CAST(coalesce(sum(w), 0) AS BIGINT) AS obs_weight, sum(w * v1) / sum(w) AS mean FROM ok LEFT JOIN (SELECT * FROM h WHERE model = 'observed') h ON h.feature = ok.feature AND h.segment = ok.segment AND h.cat = ok.cat GROUP BY ALL),
wm AS (SELECT feature, model, cat, segment, CAST(sum(w) AS BIGINT) AS weight, sum(w * v1) / sum(w) AS mean FROM hb GROUP BY ALL),
keys AS (SELECT feature, segment, cat, model, obs_weight, weight FROM (SELECT feature, segment, cat, obs_weight, model FROM wo, ms) a FULL JOIN (SELECT feature, segment, cat, model, weight FROM wm) b USING (feature, segment, cat, model)),
p0 AS (
  SELECT feature, cat, segment, ms.model, v1, w AS wa, 0 AS wb FROM h, ms WHERE h.model = 'observed'
  UNION ALL SELECT feature, cat, segment, model, v1, 0, w FROM hb),
t AS (SELECT feature, cat, segment, model, sum(wa) AS na, sum(wb) AS nb FROM p0 GROUP BY ALL),
p AS (
  SELECT feature, cat, segment, model, v1, sum(wa) AS wa, sum(wb) AS wb FROM (
    SELECT * FROM p0 UNION ALL SELECT feature, cat, segment, model, 0.0, CASE WHEN na = 0 THEN 1 ELSE 0 END, CASE WHEN nb = 0 THEN 1 ELSE 0 END FROM t WHERE na = 0 OR nb = 0) u GROUP BY ALL),
st AS (
  SELECT feature, cat, segment, model, abs(sum(wa) OVER w / sum(wa) OVER x - sum(wb) OVER w / sum(wb) OVER x) * (lead(v1) OVER w - v1) AS step
  FROM p WINDOW w AS (PARTITION BY feature, cat, segment, model ORDER BY v1), x AS (PARTITION BY feature, cat, segment, model)),
sm AS (SELECT feature, cat, segment, model, coalesce(sum(step), 0) AS value FROM st GROUP BY ALL),
e AS (
  SELECT {domain} AS domain, feature, segment, cat, model, coalesce(weight, 0) AS weight, obs_weight,
         CASE WHEN feature IN ({penal}) AND (coalesce(obs_weight, 0) = 0 OR coalesce(weight, 0) = 0) THEN 1.0 ELSE coalesce(value, 0) END AS value
  FROM keys LEFT JOIN sm USING (feature, segment, cat, model))"""


FLAGS = """
lg AS (SELECT *, lag(act) OVER (PARTITION BY model, pid ORDER BY seq) AS before FROM sched),
fl0 AS (
  SELECT model, pid, arg_min(act, seq) <> 'home' AS not_start, arg_max(act, seq) <> 'home' AS not_end,
         bool_or(act = 'home' AND coalesce(before = act, false)) AS consecutive_home, bool_or(act = 'work' AND coalesce(before = act, false)) AS consecutive_work,
         bool_or(act = 'education' AND coalesce(before = act, false)) AS consecutive_education
  FROM lg GROUP BY model, pid),
fl AS (
  SELECT *, not_start OR not_end AS not_home_based, consecutive_home OR consecutive_work OR consecutive_education AS consecutive,
         not_start OR not_end OR consecutive_home OR consecutive_work OR consecutive_education AS invalid FROM fl0)"""
SIGNS = "sig AS (SELECT model, pid, string_agg(act || ' ' || CAST(duration AS VARCHAR), ';' ORDER BY seq) AS signature FROM sched GROUP BY model, pid)"


def _rates(source: str, suffix: str = "") -> str:
    rows = [("invalid", "all", "invalid"), ("not home based", "all", "not_home_based"), ("not home based", "starts", "not_start"), ("not home based", "ends", "not_end"), ("consecutive", "all", "consecutive")]
    rows += [("consecutive", a, f"consecutive_{a}") for a in ("home", "work", "education")]
    return " UNION ALL ".join(f"SELECT model, '{f}{suffix}' AS feature, '{s}' AS segment, avg(CAST({c} AS INT)) AS value, count(*) AS weight FROM {source} GROUP BY model" for f, s, c in rows)


NOVEL = "fresh AS (SELECT fl.* FROM fl JOIN sig USING (model, pid) WHERE model <> 'observed' AND signature NOT IN (SELECT signature FROM sig WHERE model = 'observed'))"
CREATIVITY = """
ct AS (
  SELECT model, count(*) AS n, count(DISTINCT signature) AS different,
         count(DISTINCT CASE WHEN signature NOT IN (SELECT signature FROM sig WHERE model = 'observed') THEN signature END) AS fresh FROM sig GROUP BY model),
cr AS (SELECT model, n, different / n AS diversity, CASE WHEN model = 'observed' THEN 1.0 ELSE fresh / different END AS novelty FROM ct)"""


def _raw(extra: str = "") -> str:
    """CTEs up to raw(domain, feature, segment, model, value, weight, obs_weight) of a whole comparison without planes."""
    fe = _rates("fl")
    return f"""{_scores(LINES, 3)}, {FLAGS}, {SIGNS}, {CREATIVITY}, {NOVEL},
ft AS (SELECT *, max(CASE WHEN model = 'observed' THEN weight END) OVER (PARTITION BY feature, segment) AS obs_weight FROM ({fe}) y),
raw AS (
  SELECT domain, feature, segment, model, value, weight, obs_weight FROM e
  UNION ALL SELECT 'feasibility', feature, segment, model, value, weight, obs_weight FROM ft WHERE model <> 'observed'
  UNION ALL SELECT 'creativity', 'homogeneity', 'all', model, 1 - diversity, n, (SELECT n FROM ct WHERE model = 'observed') FROM cr WHERE model <> 'observed'
  UNION ALL SELECT 'creativity', 'conservatism', 'all', model, 1 - novelty, n, (SELECT n FROM ct WHERE model = 'observed') FROM cr WHERE model <> 'observed'
  {extra})"""


DROPPED = "NOT (domain = 'feasibility' AND feature IN ('not home based', 'consecutive') AND segment <> 'all')"
MEAN = "sum(value * (weight + obs_weight) / 2) / nullif(sum((weight + obs_weight) / 2), 0)"
WIDE = "round(max(CASE WHEN model = 'model_a' THEN value END), 9) AS model_a, round(max(CASE WHEN model = 'model_b' THEN value END), 9) AS model_b"
GROUPS = f"g AS (SELECT domain, feature, model, {MEAN} AS value FROM raw WHERE {DROPPED} GROUP BY domain, feature, model)"
DOMAINS = "dm AS (SELECT domain, model, avg(value) AS value FROM g WHERE NOT (domain = 'feasibility' AND feature IN ('not home based', 'consecutive')) GROUP BY domain, model)"


def _hist(name: str, min_count: int = 0, plane: bool = False) -> str:
    return f"WITH {_histograms((name,), min_count)} SELECT model, segment, round(v1, 9) AS v1, {'round(v2, 9) AS v2, ' * plane}w FROM h"


def _emd(name: str, min_count: int = 0) -> str:
    return f"WITH {_scores((name,), min_count)} SELECT model, segment, round(value, 9) AS emd FROM e"


def _split(by: str) -> str:
    keys = "domain, feature, 'segment' AS label" + ", cat" * (by == "cat")
    group = "domain, feature" + ", cat" * (by == "cat")
    # A category's rows without any weight give null, as features without persons do.
    return f"""WITH {_scores(('participation rate', '2-gram', 'start times'), 3, BY_SEGMENT)}, {FLAGS}, {SIGNS},
sc AS (SELECT sig.*, cat FROM sig JOIN mem USING (model, pid)),
ct AS (SELECT a.model, a.cat, count(*) AS n, count(DISTINCT signature) AS different,
         count(DISTINCT CASE WHEN NOT EXISTS (SELECT 1 FROM sc o WHERE o.model = 'observed' AND o.cat = a.cat AND o.signature = a.signature) THEN signature END) AS fresh FROM sc a GROUP BY a.model, a.cat),
fc AS (SELECT fl.*, cat FROM fl JOIN mem USING (model, pid)),
fr AS (SELECT model, cat, unnest(['invalid', 'not home based', 'not home based', 'not home based', 'consecutive', 'consecutive', 'consecutive', 'consecutive']) AS feature,
         unnest(['all', 'all', 'starts', 'ends', 'all', 'home', 'work', 'education']) AS segment,
         unnest([avg(CAST(invalid AS INT)), avg(CAST(not_home_based AS INT)), avg(CAST(not_start AS INT)), avg(CAST(not_end AS INT)), avg(CAST(consecutive AS INT)), avg(CAST(consecutive_home AS INT)), avg(CAST(consecutive_work AS INT)), avg(CAST(consecutive_education AS INT))]) AS value,
         count(*) AS weight FROM fc GROUP BY model, cat),
raw AS (
  SELECT domain, feature, segment, cat, model, value, weight, obs_weight FROM e
  UNION ALL SELECT 'feasibility', a.feature, a.segment, a.cat, a.model, a.value, a.weight, o.weight FROM fr a JOIN fr o ON o.model = 'observed' AND o.cat = a.cat AND o.feature = a.feature AND o.segment = a.segment WHERE a.model <> 'observed'
  UNION ALL SELECT 'creativity', 'homogeneity', 'all', a.cat, a.model, 1 - a.different / a.n, a.n, o.n FROM ct a JOIN ct o ON o.model = 'observed' AND o.cat = a.cat WHERE a.model <> 'observed'
  UNION ALL SELECT 'creativity', 'conservatism', 'all', a.cat, a.model, CASE WHEN a.different > 0 THEN 1 - a.fresh / a.different ELSE 1 END, a.n, o.n FROM ct a JOIN ct o ON o.model = 'observed' AND o.cat = a.cat WHERE a.model <> 'observed'),
g AS (SELECT {group}, model, {MEAN} AS value FROM raw WHERE {DROPPED} GROUP BY {group}, model)
SELECT {keys}, {WIDE} FROM g GROUP BY {group}"""


OBS = f"WITH {SCHED}, obs AS (SELECT * FROM sched WHERE model = 'observed')"
GRID = f"""{OBS},
ap AS (SELECT arg_min(act, pid * 1000 + seq) AS first, count(DISTINCT pid) AS n FROM obs),
gr AS (SELECT act, bin FROM (SELECT DISTINCT act FROM obs) a, (SELECT unnest(range(96)) AS bin) b),
di AS (SELECT pid, bin, arg_max(act, seq) AS act FROM obs, (SELECT unnest(range(96)) AS bin) b WHERE start_t <= bin * 15 AND bin * 15 < end_t GROUP BY pid, bin),
fo AS (SELECT bin, act, count(*) AS found FROM di GROUP BY bin, act),
jo AS (SELECT gr.bin, gr.act, coalesce(found, 0) AS found, sum(coalesce(found, 0)) OVER (PARTITION BY gr.bin) AS covered FROM gr LEFT JOIN fo ON fo.bin = gr.bin AND fo.act = gr.act),
gd AS (SELECT bin, act, n, found + CASE WHEN act = first THEN n - covered ELSE 0 END AS persons FROM jo, ap)
"""
DAYS = f"""WITH {SCHED},
dy AS (SELECT CAST(d AS BIGINT) AS pid, act, start_t, end_t, duration, row_number() OVER (PARTITION BY d ORDER BY start_t, user_id, seq) AS seq FROM sched)"""


def _vectors(name: str, rows: str) -> str:
    """CTEs of normalised values n_<name>(pid, key, x), all persons and keys."""
    return f"""
v_{name} AS ({rows}),
a_{name} AS (SELECT p.pid, k.key, coalesce(v.value, 0) AS value FROM (SELECT DISTINCT pid FROM dy) p CROSS JOIN (SELECT DISTINCT key FROM v_{name}) k LEFT JOIN v_{name} v ON v.pid = p.pid AND v.key = k.key),
n_{name} AS (SELECT pid, key, value, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END AS x FROM a_{name} JOIN (SELECT key, min(value) AS lo, max(value) AS hi FROM a_{name} GROUP BY key) s USING (key)),
d_{name} AS (SELECT a.pid AS pid_a, b.pid AS pid_b, avg(abs(a.x - b.x)) AS mae, avg(CASE WHEN (a.x <> 0) <> (b.x <> 0) THEN 1.0 ELSE 0.0 END) AS hamming FROM n_{name} a JOIN n_{name} b ON a.key = b.key AND a.pid < b.pid GROUP BY a.pid, b.pid)"""


PART = _vectors("p", "SELECT pid, act AS key, CAST(count(*) AS DOUBLE) AS value FROM dy GROUP BY pid, act")
TRAN = _vectors("t", "SELECT pid, act || '>' || nxt AS key, CAST(count(*) AS DOUBLE) AS value FROM (SELECT pid, act, lead(act) OVER (PARTITION BY pid ORDER BY seq) AS nxt FROM dy) x WHERE nxt IS NOT NULL GROUP BY ALL")
TIME = _vectors("m", "SELECT pid, act AS key, avg(duration) / 1440.0 AS value FROM dy GROUP BY pid, act")

SQL: dict[str, str] = {
    "schedule_view": f"WITH {SCHED} SELECT model, pid, act, start_t, end_t, duration, seq FROM sched",
    "seq_lengths_hist": _hist("lengths"),
    "participation_hist": _hist("participation rate"),
    "pair_participation_hist": _hist("pair participation rate"),
    "seq_rate_hist": _hist("seq participation rate"),
    "enum_rate_hist": _hist("enum participation rate"),
    "ngram2_hist": _hist("2-gram"),
    "ngram3_hist": _hist("3-gram"),
    "ngram4_hist": _hist("4-gram"),
    "ngram_min_count": _hist("4-gram", 3),
    "full_sequence_hist": _hist("full sequences"),
    "start_hist": _hist("start times"),
    "duration_hist": _hist("durations"),
    "start_duration_hist2d": _hist("start-durations", plane=True),
    "joint_duration_hist2d": _hist("joint-durations", plane=True),
    "start_by_act_hist": _hist("start times by act"),
    "end_by_act_hist": _hist("end times by act"),
    "duration_by_act_hist": _hist("durations by act"),
    "time_consistency": _hist("time consistency"),
    "feature_averages": f"WITH {_histograms(LINES, 3)} SELECT model, feature, segment, CAST(sum(w) AS BIGINT) AS weight, round(sum(v1 * w) / sum(w), 9) AS value FROM h GROUP BY model, feature, segment",
    "emd1d_start": _emd("start times"),
    "emd1d_duration": _emd("durations"),
    "emd1d_participation": _emd("participation rate"),
    "emd1d_pair_participation": _emd("pair participation rate"),
    "emd1d_ngram2": _emd("2-gram", 3),
    "emd1d_ngram4": _emd("4-gram", 3),
    "feasibility_flags": f"WITH {SCHED}, {FLAGS} SELECT model, pid, invalid, not_home_based, not_start, not_end, consecutive, consecutive_home, consecutive_work, consecutive_education FROM fl",
    "feasibility_rates": f"WITH {SCHED}, {FLAGS} SELECT model, feature, segment, round(value, 9) AS value, weight FROM ({_rates('fl')}) x",
    "feasibility_novel": f"WITH {SCHED}, {FLAGS}, {SIGNS}, {NOVEL} SELECT model, feature, segment, round(value, 9) AS value, weight FROM ({_rates('fresh')}) x",
    "creativity_descriptions": f"WITH {SCHED}, {SIGNS}, {CREATIVITY} SELECT model, 'diversity' AS feature, round(diversity, 9) AS value, n AS weight FROM cr UNION ALL SELECT model, 'novelty', round(novelty, 9), n FROM cr",
    "creativity_distances": f"WITH {SCHED}, {SIGNS}, {CREATIVITY} SELECT model, 'homogeneity' AS feature, round(1 - diversity, 9) AS value, n AS weight FROM cr UNION ALL SELECT model, 'conservatism', round(1 - novelty, 9), n FROM cr",
    "filter_novel": f"WITH {SCHED}, {SIGNS} SELECT pid, count(*) AS episodes FROM sched WHERE model = 'model_a' AND pid IN (SELECT pid FROM sig WHERE model = 'model_a' AND signature NOT IN (SELECT signature FROM sig WHERE model = 'observed')) GROUP BY pid",
    "filter_non_home_based": f"WITH {SCHED}, {FLAGS} SELECT pid, count(*) AS episodes FROM sched WHERE pid IN (SELECT pid FROM fl WHERE not_home_based) GROUP BY pid",
    "filter_consecutive": f"WITH {SCHED}, {FLAGS} SELECT pid, count(*) AS episodes FROM sched WHERE pid IN (SELECT pid FROM fl WHERE consecutive) GROUP BY pid",
    "split_numeric_bins": f"""WITH {SCHED},
bal AS (SELECT DISTINCT pid, model, c_acctbal AS x FROM sched JOIN customer ON user_id = c_custkey),
q AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS e FROM bal WHERE model = 'observed')
SELECT CASE WHEN x <= e[1] THEN 'lowest' WHEN x <= e[2] THEN 'low' WHEN x <= e[3] THEN 'mid' WHEN x <= e[4] THEN 'high' ELSE 'highest' END AS cat, count(*) AS schedules, min(pid) AS first_pid
FROM bal, q GROUP BY 1""",
    "split_by_category": _split("cat"),
    "split_by_attribute": _split("label"),
    "features_tier_1d": f"WITH {_raw()}, g AS (SELECT domain, feature, segment, model, {MEAN} AS value FROM raw GROUP BY domain, feature, segment, model) SELECT domain, feature, segment, {WIDE} FROM g GROUP BY domain, feature, segment",
    "groups_tier_1d": f"WITH {_raw()}, {GROUPS} SELECT domain, feature, {WIDE} FROM g GROUP BY domain, feature",
    "group_descriptions_1d": f"""WITH {_raw()},
dr AS (
  SELECT CASE WHEN feature LIKE '%gram' THEN 'transitions' WHEN feature IN ('start times', 'durations') THEN 'timing' ELSE 'participations' END AS domain, feature, segment, 'observed' AS model, mean AS value, obs_weight AS weight FROM wo
  UNION ALL SELECT CASE WHEN feature LIKE '%gram' THEN 'transitions' WHEN feature IN ('start times', 'durations') THEN 'timing' ELSE 'participations' END, feature, segment, model, mean, weight FROM wm
  UNION ALL SELECT 'feasibility', feature, segment, model, value, weight FROM ft
  UNION ALL SELECT 'creativity', 'diversity', 'all', model, diversity, n FROM cr UNION ALL SELECT 'creativity', 'novelty', 'all', model, novelty, n FROM cr),
dg AS (SELECT domain, feature, model, coalesce(sum(value * weight) / nullif(sum(weight), 0), 0) AS value FROM dr WHERE {DROPPED} GROUP BY domain, feature, model)
SELECT domain, feature, round(coalesce(max(CASE WHEN model = 'observed' THEN value END), 0), 9) AS observed, round(coalesce(max(CASE WHEN model = 'model_a' THEN value END), 0), 9) AS model_a, round(coalesce(max(CASE WHEN model = 'model_b' THEN value END), 0), 9) AS model_b FROM dg GROUP BY domain, feature""",
    "domains_tier_1d": f"WITH {_raw()}, {GROUPS}, {DOMAINS} SELECT domain, {WIDE} FROM dm GROUP BY domain",
    "domains_tier_novel": f"""WITH {_raw("UNION ALL SELECT 'feasibility', feature, segment, model, value, weight, (SELECT n FROM ct WHERE model = 'observed') FROM (" + _rates("fresh", " (novel)") + ") q")}, {GROUPS}, {DOMAINS}
SELECT domain, {WIDE} FROM dm GROUP BY domain""",
    "rank_models": f"WITH {_raw()}, {GROUPS}, {DOMAINS} SELECT model, round(avg(value), 9) AS distance FROM dm GROUP BY model",
    "rank_groups": f"WITH {_raw()}, {GROUPS} SELECT domain, feature, model, CAST(rank() OVER (PARTITION BY domain, feature ORDER BY round(value, 9)) AS INT) AS rank FROM g",
    "activity_density": f"""{GRID}SELECT bin, act, CAST(persons AS BIGINT) AS persons, round(persons / n, 9) AS density FROM gd""",
    "density_curves": f"""{GRID}SELECT act AS segment, round(bin * (15 / 1440), 9) AS value, round(persons / n, 9) AS weight FROM gd""",
    "joint_time_bins": f"{OBS} SELECT act, CAST(floor(start_t / 30) * 30 AS BIGINT) AS start_bin, CAST(floor(duration / 30) * 30 AS BIGINT) AS duration_bin, count(*) AS episodes FROM obs GROUP BY 1, 2, 3",
    "gantt_rows": f"{OBS} SELECT pid, act, start_t, end_t, seq FROM obs WHERE pid IN (SELECT DISTINCT pid FROM obs ORDER BY pid LIMIT 8)",
    "schedule_count": f"{OBS} SELECT 'all' AS segment, CAST(count(DISTINCT pid) AS DOUBLE) AS value, CAST(1 AS BIGINT) AS weight FROM obs",
    "time_use": f"""{OBS}
SELECT t AS minute, act, round(count(DISTINCT pid) / (SELECT count(DISTINCT pid) FROM obs), 9) AS share FROM (SELECT pid, act, unnest(range(CAST(start_t AS BIGINT), CAST(end_t AS BIGINT))) AS t FROM obs) x GROUP BY t, act""",
    "sequence_probs": f"{OBS} SELECT sequence, count(*) AS persons, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT pid, string_agg(act, '>' ORDER BY seq) AS sequence FROM obs GROUP BY pid) x GROUP BY sequence",
    "bigram_matrix": f"{OBS} SELECT act, nxt AS after, round(count(*) / (SELECT count(DISTINCT pid) FROM obs), 9) AS rate FROM (SELECT act, lead(act) OVER (PARTITION BY pid ORDER BY seq) AS nxt FROM obs) x WHERE nxt IS NOT NULL GROUP BY act, nxt",
    "participation_summary": f"""{OBS},
w AS (SELECT pid, min(start_t) AS first, sum(duration) AS total FROM obs WHERE act = 'work' GROUP BY pid),
s AS (SELECT 'work' AS act, count(*) AS persons, round(avg(first), 6) AS first_start, round(avg(total), 6) AS total_duration FROM w)
SELECT o.act, round(count(*) / (SELECT count(DISTINCT pid) FROM obs), 9) AS rate, round(count(DISTINCT pid) / (SELECT count(DISTINCT pid) FROM obs), 9) AS share, any_value(s.persons) AS persons, any_value(first_start) AS first_start, any_value(total_duration) AS total_duration
FROM obs o LEFT JOIN s ON s.act = o.act GROUP BY o.act""",
    "start_time_bins": f"{OBS} SELECT act, CAST(floor(start_t / 30) * 30 AS BIGINT) AS bin, count(*) AS episodes FROM obs GROUP BY 1, 2",
    "length_table": f"{OBS} SELECT length, count(*) AS persons FROM (SELECT pid, count(*) AS length FROM obs GROUP BY pid) x GROUP BY length",
    "scalar_distances": f"""WITH {SCHED},
hi AS (SELECT model, act, floor(start_t / 30) * 30 AS v, count(*) AS w FROM sched GROUP BY ALL),
ro AS (
  SELECT model, act, v, sum(wa) AS wa, sum(wb) AS wb FROM (
    SELECT m.model, act, v, w AS wa, 0 AS wb FROM hi, (SELECT unnest(['model_a', 'model_b']) AS model) m WHERE hi.model = 'observed'
    UNION ALL SELECT model, act, v, 0, w FROM hi WHERE model <> 'observed') u GROUP BY model, act, v),
ws AS (SELECT model, act, abs(sum(wa) OVER w / sum(wa) OVER x - sum(wb) OVER w / sum(wb) OVER x) * (lead(v) OVER w - v) AS step FROM ro WINDOW w AS (PARTITION BY model, act ORDER BY v), x AS (PARTITION BY model, act)),
ag AS (SELECT model, act, avg(abs(wa - wb)) AS mae, avg((wa - wb) * (wa - wb)) AS mse, sum(v * wa) / sum(wa) AS a, sum(v * wb) / sum(wb) AS b FROM ro GROUP BY model, act)
SELECT ag.model, ag.act, round(mae, 9) AS mae, round(mse, 9) AS mse, round(abs(a - b), 9) AS abs_av_diff,
       round(CASE WHEN a = b THEN 0 ELSE least(1, abs(a - b) / CASE WHEN b = 0 THEN a ELSE b END) END, 9) AS mape, round(distance, 9) AS distance
FROM ag JOIN (SELECT model, act, sum(step) AS distance FROM ws GROUP BY model, act) q ON q.model = ag.model AND q.act = ag.act""",
    "pairwise_default": f"{DAYS}, {PART}, {TRAN}, {TIME} SELECT pid_a, pid_b, round((d_p.mae + d_t.mae + d_m.mae) / 3, 9) AS distance FROM d_p JOIN d_t USING (pid_a, pid_b) JOIN d_m USING (pid_a, pid_b)",
    "pairwise_participation_mae": f"{DAYS}, {PART} SELECT pid_a, pid_b, round(mae, 9) AS distance FROM d_p",
    "pairwise_hamming": f"{DAYS}, {TRAN} SELECT pid_a, pid_b, round(hamming, 9) AS distance FROM d_t",
    "pairwise_chamfer": f"""{DAYS},
ac AS (SELECT act, (row_number() OVER (ORDER BY act) - 1) / (SELECT count(DISTINCT act) FROM dy) AS code FROM (SELECT DISTINCT act FROM dy) x),
pt AS (
  SELECT g.pid, g.seq, coalesce(code, 1.0) AS x, coalesce(duration / 1440, 0.0) AS y
  FROM (SELECT pid, unnest(range(1, 13)) AS seq FROM (SELECT DISTINCT pid FROM dy) p) g LEFT JOIN dy ON dy.pid = g.pid AND dy.seq = g.seq LEFT JOIN ac ON ac.act = dy.act),
pr AS (SELECT a.pid AS pid_a, b.pid AS pid_b, a.seq AS i, b.seq AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r FROM pt a JOIN pt b ON a.pid < b.pid),
ro AS (SELECT pid_a, pid_b, avg(r) AS m FROM (SELECT pid_a, pid_b, i, min(r) AS r FROM pr GROUP BY ALL) x GROUP BY pid_a, pid_b),
co AS (SELECT pid_a, pid_b, avg(r) AS m FROM (SELECT pid_a, pid_b, j, min(r) AS r FROM pr GROUP BY ALL) x GROUP BY pid_a, pid_b)
SELECT pid_a, pid_b, round((ro.m + co.m) / 2 / sqrt(2), 9) AS distance FROM ro JOIN co USING (pid_a, pid_b)""",
    "feature_catalogue": """
SELECT * FROM (VALUES
  ('participations', 'lengths', 'lengths', 'Number of episodes of each person.', TRUE),
  ('participations', 'participation rate', 'rates', 'How often each person does each activity.', TRUE),
  ('participations', 'pair participation rate', 'pair_rates', 'How often each person does both activities of a pair.', TRUE),
  ('participations', 'seq participation rate', 'seq_rates', 'Whether each person does an activity at a position.', FALSE),
  ('participations', 'enum participation rate', 'enum_rates', 'Whether each person does an activity for the n-th time.', FALSE),
  ('transitions', '2-gram', '2-gram', 'How often each person makes each sequence of 2 activities.', TRUE),
  ('transitions', '3-gram', '3-gram', 'How often each person makes each sequence of 3 activities.', TRUE),
  ('transitions', '4-gram', '4-gram', 'How often each person makes each sequence of 4 activities.', TRUE),
  ('timing', 'start times', 'start_times', 'Start of each activity''s n-th occurrence.', TRUE),
  ('timing', 'durations', 'durations', 'Duration of each activity''s n-th occurrence.', TRUE),
  ('timing', 'start-durations', 'start_durations', 'Start and duration of each activity, binned.', TRUE),
  ('timing', 'joint-durations', 'joint_durations', 'Durations of an episode and the next, binned, by the first one''s activity.', TRUE),
  ('timing', 'start times by act', 'start_times_by_act', 'Start of each activity, binned.', FALSE),
  ('timing', 'end times by act', 'end_times_by_act', 'End of each activity, binned.', FALSE),
  ('timing', 'durations by act', 'durations_by_act', 'Duration of each activity, binned.', FALSE),
  ('timing', 'time consistency', 'time_consistency', 'Whether schedules start at 0, end with the day and fill it.', FALSE),
  ('sequences', 'full sequences', 'full_sequences', 'Whether each person has a sequence of activity initials.', FALSE)
) AS t(domain, name, config_key, description, in_default_config)""",
    "sliced_wasserstein": f"""WITH {SCHED},
di AS (SELECT * FROM (VALUES {", ".join(f"({k}, CAST('{x!r}' AS DOUBLE), CAST('{y!r}' AS DOUBLE))" for k, (x, y) in enumerate(random_directions(2).tolist()))}) AS t(k, dx, dy)),
pr AS (
  SELECT m.model, k, start_t / 1440 * dx + duration / 1440 * dy AS v, CAST(sched.model = 'observed' AS INT) AS wa, CAST(sched.model <> 'observed' AS INT) AS wb
  FROM sched, di, (SELECT unnest(['model_a', 'model_b']) AS model) m WHERE sched.model IN ('observed', m.model)),
gr AS (SELECT model, k, v, sum(wa) AS wa, sum(wb) AS wb FROM pr GROUP BY model, k, v),
st AS (
  SELECT model, k, abs(sum(wa) OVER w / sum(wa) OVER x - sum(wb) OVER w / sum(wb) OVER x) * (lead(v) OVER w - v) AS step
  FROM gr WINDOW w AS (PARTITION BY model, k ORDER BY v), x AS (PARTITION BY model, k))
SELECT model, round(avg(d), 9) AS distance FROM (SELECT model, k, sum(step) AS d FROM st GROUP BY model, k) q GROUP BY model""",
}
