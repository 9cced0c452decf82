"""Queries on support, change points, attribution, baselines, corrections and de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.durable import cut, store
from tideline.operators import attribution, baselines, changes, correction, dedup, pipeline, postings, relations, support
from tideline.operators.graph import connected_components
from tideline.plans import base
from tideline.plans.base import NAME, SQL_BASE, TEST, sql_pairs

W, TH = TEST
LEVEL, SHIFTS, SIGMA, ALPHA = 20, 1000, 500.0, 0.05
CONFIG = pipeline.Config(window=W, theta=TH, permutations=SHIFTS, alpha=ALPHA)


def _given(spark, d):
    found, own = base.pairs(spark, d)
    n = base.length(spark, d)
    return found, base.held(spark, d, "times", lambda: store(postings.timestamps(own, found))), base.events(spark, n), n, own


def _points(spark, d):
    found, times, events, n, _ = _given(spark, d)
    return base.held(spark, d, "points", lambda: cut(changes.from_intervals(found, times, W, n, LEVEL))), events, n


def _rounded(frame, *columns, digits=6):
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def s1_support_series(spark, d):
    """The support of single brands at every position."""
    own = base.occ(spark, d).select(F.array("item").alias("pattern"), "t")
    return support.series(own, own, W, base.length(spark, d)).select(base.text(), "t", "support")


def s3_probe(spark, d):
    """The support of pairs at places all over the axis."""
    _, times, _, n, _ = _given(spark, d)
    asked = times.select("pattern").distinct().select("pattern", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(max(1, n // 50)).cast("long"))).alias("t"))
    return support.probe(times, asked, W).select(base.text(), "t", "support")


def s4_change_points(spark, d):
    points, _, _ = _points(spark, d)
    return _rounded(points.select(base.text(), "s", "e", "time", "direction", "magnitude", "before", "after"), "magnitude", "before", "after")


def s5_threshold_crossings(spark, d):
    own = base.occ(spark, d).select(F.array("item").alias("pattern"), "t")
    found = changes.detect(own, own, W, base.length(spark, d), "threshold_crossing", theta=75, level=LEVEL)
    return _rounded(found.select(base.text(), "time", "direction", "magnitude", "before", "after"), "magnitude", "before", "after")


def s6_cusum(spark, d):
    """Alarms on the support of every brand; a fold over the whole axis, which recursive SQL is too slow for. Tested against the plain fold."""
    own = base.occ(spark, d).select(F.array("item").alias("pattern"), "t")
    found = changes.detect(own, own, 100, base.length(spark, d), "cusum", drift=0.5, bound=4.0)
    return _rounded(found.select(base.text(), "time", "direction", "magnitude", "before", "after"), "magnitude")


def s8_bare_points(spark, d):
    found, _ = base.pairs(spark, d)
    n = base.length(spark, d)
    bag, once = (changes.bare(found, W, n, c).withColumn("convention", F.lit(c)) for c in ("bag", "set"))
    return bag.unionByName(once).select(base.text(), "time", "convention")


def f14_support_range(spark, d):
    found, times, _, n, _ = _given(spark, d)
    return changes.support_range(support.steps(times, found, W, n), 14).select(base.text())


def f15_sampled_range(spark, d):
    found, times, _, n, _ = _given(spark, d)
    return changes.sampled_range(found, times, W, n, 15).select(base.text())


def f16_strong_points(spark, d):
    points, _, _ = _points(spark, d)
    return changes.strong(points, 1.5, 0.1).select(base.text(), "s", "e", "time", "direction")


def a3_scores(spark, d):
    points, events, _ = _points(spark, d)
    found = attribution.score(points, events, SIGMA)
    return _rounded(found.select(base.text(), "s", "e", "time", "event_id", "proximity", "score"), "proximity", "score")


def a3_ablations(spark, d):
    points, events, _ = _points(spark, d)
    parts = [attribution.score(points, events, SIGMA, normalisation=n, ablation=a, threshold=t).withColumn("kind", F.lit(f"{n} {a}")) for n, a, t in (("full", None, 0.1), ("none", "no_prox", 1.2), ("sqrt", "no_mag", 0.5))]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).select(base.text(), "time", "event_id", "kind", "score"), "score")


def a4_observed(spark, d):
    points, events, _ = _points(spark, d)
    return _rounded(attribution.observed(attribution.score(points, events, SIGMA), "pattern").select(base.text(), "event_id", "observed"), "observed")


def a5_shifts(spark, d):
    """Events under every shift."""
    n = base.length(spark, d)
    top = support.positions(W, n)
    moves = base.events(spark, n).join(F.broadcast(attribution.offsets(spark, SHIFTS, top)), F.lit(True))
    begin, end = attribution.shifted(F.col("start"), F.col("end"), F.col("offset"), top)
    return moves.select("event_id", "b", begin.alias("start"), end.alias("end"))


def _tested(spark, d, unit=("pattern", "s", "e")):
    points, events, n = _points(spark, d)
    return base.held(spark, d, ("tested", unit), lambda: cut(attribution.permutation_test(points, events, support.positions(W, n), SIGMA, permutations=SHIFTS, unit=unit))), points, events


def a6_permutation_test(spark, d):
    """One p for each pattern, interval and event."""
    tested, _, _ = _tested(spark, d)
    return _rounded(tested.select(base.text(), "s", "e", "event_id", "observed", "p_value"), "observed", "p_value")


def a6_pooled_test(spark, d):
    """One p for each pattern and event."""
    tested, _, _ = _tested(spark, d, ("pattern",))
    return _rounded(tested.select(base.text(), "event_id", "observed", "p_value"), "observed", "p_value")


def a10_within_pattern(spark, d):
    tested, _, _ = _tested(spark, d, ("pattern",))
    return _rounded(attribution.within_pattern(tested).select(base.text(), "event_id", "adjusted"), "adjusted")


def a11_series_attribution(spark, d):
    """From threshold crossings of the series, within each pattern."""
    found, times, events, n, own = _given(spark, d)
    config = pipeline.Config(window=W, theta=TH, permutations=SHIFTS, alpha=ALPHA, change_method="threshold_crossing", global_correction=False, correction="bonferroni")
    rows = pipeline.attribute(found, own, events, n, config, times)
    return _rounded(rows.select(base.text(), "event_name", "time", "score", "p_value", "adjusted"), "score", "p_value", "adjusted")


def a12_attribution(spark, d):
    """The whole chain: mining, change points, permutation test over intervals, correction."""
    found, times, events, n, own = _given(spark, d)
    rows = pipeline.attribute(found, own, events, n, CONFIG, times)
    return _rounded(rows.select(base.text(), "interval_start", "interval_end", "time", "direction", "event_name", "score", "p_value", "adjusted"), "score", "p_value", "adjusted")


def a12_every_hypothesis(spark, d):
    """The same with every hypothesis kept, whatever its p."""
    found, times, events, n, own = _given(spark, d)
    rows = pipeline.attribute(found, own, events, n, pipeline.Config(window=W, theta=TH, permutations=SHIFTS, alpha=2.0), times)
    return _rounded(rows.select(base.text(), "interval_start", "interval_end", "time", "direction", "event_name", "score", "p_value", "adjusted"), "score", "p_value", "adjusted")


def a13_pooled_attribution(spark, d):
    found, times, events, n, own = _given(spark, d)
    rows = pipeline.attribute(found, own, events, n, pipeline.Config(window=W, theta=TH, permutations=SHIFTS, alpha=ALPHA, unit="pattern"), times)
    return _rounded(rows.select(base.text(), "event_name", "time", "score", "p_value", "adjusted"), "score", "p_value", "adjusted")


def a7_independent(spark, d):
    """Every hypothesis with shifts of its own."""
    points, events, n = _points(spark, d)
    tested = attribution.permutation_test(points, events, support.positions(W, n), SIGMA, permutations=SHIFTS, unit=("pattern",), seed=5, independent=True)
    return _rounded(tested.select(base.text(), "event_id", "observed", "p_value"), "observed", "p_value")


def g3_p_dedup(spark, d):
    """Pairs of a pattern and event, de-duplicated by their adjusted p: by overlap, then by subsets."""
    tested, _, events = _tested(spark, d, ("pattern",))
    rows = correction.benjamini_hochberg(tested).join(F.broadcast(events), "event_id").select("pattern", F.col("name").alias("event_name"), F.round("adjusted", 9).alias("adjusted"))
    return _rounded(dedup.by_p(cut(rows)).select(base.text(), "event_name", "adjusted"), "adjusted")


def a14_naive(spark, d):
    points, events, _ = _points(spark, d)
    return _rounded(attribution.naive(points, events, SIGMA).select(base.text(), "event_name", "time", "score"), "score")


def c1_benjamini_hochberg(spark, d):
    tested, _, _ = _tested(spark, d)
    return _rounded(correction.benjamini_hochberg(tested).select(base.text(), "s", "e", "event_id", "adjusted"), "adjusted")


def c2_bonferroni(spark, d):
    tested, _, _ = _tested(spark, d)
    return _rounded(correction.bonferroni(tested).select(base.text(), "s", "e", "event_id", "adjusted"), "adjusted")


def _scored_pairs(spark, d):
    """Each pair and event with its summed score, as rows to de-duplicate."""
    points, events, _ = _points(spark, d)
    rows = attribution.observed(attribution.score(points, events, SIGMA), "pattern").join(F.broadcast(events), "event_id")
    return cut(rows.select("pattern", F.col("name").alias("event_name"), F.col("observed").alias("score")))


def _with_triples(spark, d):
    """The same with triples made of pairs of neighbours, scored a little higher, so that some patterns hold others."""
    rows = _scored_pairs(spark, d)
    longer = rows.where(F.col("pattern")[1] < 24).select(F.concat("pattern", F.array(F.lit(24).cast("long"))).alias("pattern"), "event_name", (F.col("score") + 0.25).alias("score"))
    return cut(rows.unionByName(longer))


def g1_overlap_dedup(spark, d):
    rows = _scored_pairs(spark, d)
    better = [F.desc("score"), F.desc(F.size("pattern")), F.col("pattern")]
    return _rounded(dedup.by_overlap(rows, better).select(base.text(), "event_name", "score"), "score")


def g2_subset_dedup(spark, d):
    better = [F.desc("score"), F.desc(F.size("pattern")), F.col("pattern")]
    rows = _with_triples(spark, d)
    return _rounded(dedup.by_subset(rows, better).select(base.text(), "event_name", "score"), "score")


def g4_effect_dedup(spark, d):
    rows = _with_triples(spark, d).withColumn("effect", F.col("score"))
    return _rounded(dedup.by_effect(rows).select(base.text(), "event_name", "effect"), "effect")


def g5_components(spark, d):
    """Components of customers and suppliers that share a nation and the first digits of their balance."""
    edges = base.table(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.concat_ws("/", "c_nationkey", F.floor(F.col("c_acctbal") / 40).cast("string")).alias("k"))
    first = edges.groupBy("k").agg(F.min("a").alias("b"))
    links = edges.join(first, "k").select("a", "b").unionByName(edges.where("a > 7").select("a", (F.col("a") - F.col("a") % 7).alias("b")).where("a % 3 = 0"))
    return connected_components(links)


def g6_best_per_pair(spark, d):
    points, events, _ = _points(spark, d)
    rows = attribution.score(points, events, SIGMA).withColumnRenamed("name", "event_name")
    return _rounded(dedup.best_per_pair(rows).select(base.text(), "event_name", "score"), "score")


def _baseline(method):
    def query(spark, d):
        found, times, events, n, _ = _given(spark, d)
        if method == "coincidence":
            tested = baselines.coincidence(found, events, W, n)
        elif method == "contrast":
            tested = baselines.contrast(times, events, n)
        else:
            tested = getattr(baselines, method)(support.steps(times, found, W, n), events, W)
        return _rounded(tested.select(base.text(), "event_id", "effect", "p_value"), "effect", "p_value", digits=5)

    return query


def _named(name, method):
    made = _baseline(method)
    made.__name__ = name
    made.__doc__ = f"The {method} test of every pair and event."
    return made


b1_mann_whitney = _named("b1_mann_whitney", "mann_whitney")
b3_causal_impact = _named("b3_causal_impact", "causal_impact")
b4_interrupted = _named("b4_interrupted", "interrupted")
b6_event_study = _named("b6_event_study", "event_study")
b7_coincidence = _named("b7_coincidence", "coincidence")
b8_contrast = _named("b8_contrast", "contrast")


def b10_finished(spark, d):
    """The coincidence test, corrected and cut."""
    found, _, events, n, _ = _given(spark, d)
    rows = baselines.finished(cut(baselines.coincidence(found, events, W, n)), 0.5)
    return _rounded(rows.select(base.text(), "event_name", "adjusted"), "adjusted", digits=5)


def z1_relations(spark, d):
    found, _, events, _, _ = _given(spark, d)
    return relations.relations(found, events, 100, 150).select(base.text(), "s", "e", "event_id", "relation", "overlap")


QUERIES = [s1_support_series, s3_probe, s4_change_points, s5_threshold_crossings, s6_cusum, s8_bare_points, f14_support_range, f15_sampled_range, f16_strong_points, a3_scores, a3_ablations, a4_observed, a5_shifts, a6_permutation_test, a7_independent, a6_pooled_test, a10_within_pattern, a11_series_attribution, a12_attribution, a12_every_hypothesis, a13_pooled_attribution, a14_naive, c1_benjamini_hochberg, c2_bonferroni, g1_overlap_dedup, g2_subset_dedup, g3_p_dedup, g4_effect_dedup, g5_components, g6_best_per_pair, b1_mann_whitney, b3_causal_impact, b4_interrupted, b6_event_study, b7_coincidence, b8_contrast, b10_finished, z1_relations]

# --- SQL -------------------------------------------------------------------

_PAIRS = f"with recursive{sql_pairs(W, TH)}{base.sql_times()}"
_SINGLE = f"""with recursive{SQL_BASE},
gd as (select item, unnest(generate_series(0, n - 1)) as t from item, n),
s1 as (select item, t, support from (select gd.item, gd.t, (sum(case when occ.t is null then 0 else 1 end) over (partition by gd.item order by gd.t rows between current row and {W - 1} following))::bigint as support from gd left join occ on occ.item = gd.item and occ.t = gd.t), n where t <= n - {W})"""
_POINTS = _PAIRS + f""",
mp as (select n - {W} + 1 as top from n),
av as (select pattern, t, coalesce(avg(support) over (partition by pattern order by t rows between {LEVEL} preceding and 1 preceding), 0) as before,
  coalesce(avg(support) over (partition by pattern order by t rows between current row and {LEVEL - 1} following), 0) as after from sr),
cp0 as (select pattern, s, e, s as time, 'up' as direction from d2 union all select pattern, s, e, e + 1, 'down' from d2),
cp as (select cp0.*, before, after, greatest(1.0, case when direction = 'up' then after - before else before - after end) as magnitude from cp0 join av on av.pattern = cp0.pattern and av.t = time)"""
_NEAR = "exp(-least(abs(time - start), abs(time - \"end\"))::double / 500.0)"
_SCORING = f""",
sc as (select *, round({_NEAR} * (magnitude / sqrt(greatest(1.0, before))), 9) as score, {_NEAR} as proximity from cp, ev)
, sk as (select * from sc where score >= 0.1)"""

_SCORED = _POINTS + _SCORING
#: Change points where the series of a pair crosses the least support.
_CROSSED = _PAIRS + f""",
mp as (select n - {W} + 1 as top from n),
x as (select *, support >= {TH} as now, coalesce(lag(support >= {TH}) over (partition by pattern order by t), false) as was,
  coalesce(avg(support) over (partition by pattern order by t rows between {LEVEL} preceding and 1 preceding), 0) as before, coalesce(avg(support) over (partition by pattern order by t rows between current row and {LEVEL - 1} following), 0) as after from sr),
cp as (select pattern, null::bigint as s, null::bigint as e, t as time, case when now then 'up' else 'down' end as direction, before, after, greatest(1.0, case when now then after - before else before - after end) as magnitude from x where now <> was)""" + _SCORING


def _permuted(unit: str, scored: str = _SCORED, own: str | None = None) -> str:
    """Hypotheses ``te`` with their p; ``own``: the shift of a hypothesis by itself instead of a sweep for all."""
    if own:
        return scored + f""",
ob as (select {unit}, event_id, round(sum(score), 9) as observed from sk group by {unit}, event_id),
sf as (select {unit}, event_id, b, top, 1 + {own} % (top - 1) as off from ob, mp, (select unnest(generate_series(0, {SHIFTS - 1})) as b)),
mv as (select {unit}, event_id, b, (start + off) % top as start, least((start + off) % top + "end" - start, top - 1) as "end" from ev join sf using (event_id)),
ps as (select {unit}, event_id, b, round(sum(score), 9) as sm from (select {unit}, event_id, b, round({_NEAR} * (magnitude / sqrt(greatest(1.0, before))), 9) as score from cp join mv using ({unit})) where score >= 0.1 group by {unit}, event_id, b),
cn as (select {unit}, event_id, count(*) as k from ps join ob using ({unit}, event_id) where sm >= observed group by {unit}, event_id),
te as (select {unit}, event_id, observed, (coalesce(k, 0) + 1) / {SHIFTS + 1}.0::double as p_value from ob left join cn using ({unit}, event_id))"""
    return scored + f""",
ob as (select {unit}, event_id, round(sum(score), 9) as observed from sk group by {unit}, event_id),
sf as (select b, 1 + (b * 7919 + 104729) % (top - 1) as off, top from mp, (select unnest(generate_series(0, {SHIFTS - 1})) as b)),
mv as (select event_id, b, (start + off) % top as start, least((start + off) % top + "end" - start, top - 1) as "end" from ev, sf),
ps as (select {unit}, event_id, b, round(sum(score), 9) as sm from (select {", ".join("cp." + c.strip() for c in unit.split(","))}, mv.event_id, b, round({_NEAR} * (magnitude / sqrt(greatest(1.0, before))), 9) as score from cp, mv) where score >= 0.1 group by {unit}, event_id, b),
cn as (select {unit}, event_id, count(*) as k from ps join ob using ({unit}, event_id) where sm >= observed group by {unit}, event_id),
te as (select {unit}, event_id, observed, (coalesce(k, 0) + 1) / {SHIFTS + 1}.0::double as p_value from ob left join cn using ({unit}, event_id))"""


_OWN = "('0x' || substr(md5(concat_ws('|', '5', pattern::varchar, event_id, b)), 1, 13))::bigint"
_BH = """,
rk as (select *, row_number() over (order by p_value) as rn, count(*) over () as m from te),
ad as (select *, min(least(1.0, p_value * m / rn)) over (order by rn desc rows unbounded preceding) as adjusted from rk),
bh as (select *, max(adjusted) over (partition by p_value) as a2, min(adjusted) over (partition by p_value) as a1 from ad)"""
_BEST = ", bs as (select pattern, s, e, event_id, name, time, direction, row_number() over (partition by {unit}, event_id order by score desc, time, direction desc) as r from sk)"
_CLUSTER = """
rw as (select *, row_number() over () as id from rows0),
eg as (select a.id as x, b.id as y from rw a join rw b on a.event_name = b.event_name and a.id <> b.id and {test}),
rc(x, y) as (select id, id from rw union select rc.x, eg.y from rc join eg on rc.y = eg.x),
cc as (select x as id, min(y) as c from rc group by x),
bt as (select pattern, event_name, score, row_number() over (partition by c order by score desc, len(pattern) desc, pattern) as r from rw join cc using (id))
select array_to_string(pattern, ',') as pattern, event_name, round(score, 6) as {score} from bt where r = 1"""
_ROWS = _SCORED + ", ob as (select pattern, name as event_name, round(sum(score), 9) as score from sk group by pattern, name)"
_TRIPLES = ", tr as (select * from ob union all select list_append(pattern, 24), event_name, score + 0.25 from ob where pattern[2] < 24)"
_SHARED = "len(list_intersect(a.pattern, b.pattern))"
_ERF = "(((((1.061405429 * k + -1.453152027) * k) + 1.421413741) * k + -0.284496736) * k + 0.254829592) * k * exp(-x * x)"


def _with_p(source: str) -> str:
    """p from a CTE ``ef`` (pattern, event_id, effect, z)."""
    return f"""{source},
kx as (select *, abs(z) / sqrt(2.0) as x, 1.0 / (1.0 + 0.3275911 * (abs(z) / sqrt(2.0))) as k from ef where z is not null),
pv as (select pattern, event_id, effect, least(1.0, greatest(0.0, 1.0 - 0.5 * (1.0 + case when z >= 0 then 1 - {_ERF} else -(1 - {_ERF}) end))) as p_value from kx)"""


def _p(source: str) -> str:
    return _with_p(source) + f" select {NAME}, event_id, round(effect, 5) as effect, round(p_value, 5) as p_value from pv"


_GRID = _PAIRS + f""",
gr as (select sr.pattern, sr.t, sr.support::double as y, ev.*, (sr.t <= "end" and sr.t + {W - 1} >= start) as inside, (sr.t + {W - 1} < start) as pre from sr, ev)"""
_ECA = _PAIRS + f""",
pt2 as (select pattern, s as time from d2, n where s >= 0 and s <= n - {W} union all select pattern, e + 1 from d2, n where e + 1 <= n - {W}),
mm as (select pattern, count(*)::double as m from pt2 group by pattern having count(*) >= 3),
kk as (select pattern, event_id, any_value(m) as m, sum(case when time between start - {W} and "end" + {W} then 1 else 0 end)::double as k, least(1.0, ("end" - start + 1 + {2 * W}) / n::double) as l from pt2 join mm using (pattern), ev, n group by pattern, event_id, start, "end", n),
ef as (select pattern, event_id, k as effect, case when m * l * (1 - l) > 1e-12 then (k - m * l) / sqrt(m * l * (1 - l)) end as z from kk)"""

SQL = {
    "s1_support_series": f"{_SINGLE} select item::varchar as pattern, t, support from s1",
    "s3_probe": f"{_PAIRS}, a as (select pattern, unnest(generate_series(0, n - 1, greatest(1, n // 50)))::bigint as t from pt, n) select array_to_string(a.pattern, ',') as pattern, a.t, count(tm.t) as support from a left join tm on tm.pattern = a.pattern and tm.t >= a.t and tm.t <= a.t + {W - 1} group by a.pattern, a.t",
    "s4_change_points": f"{_POINTS} select {NAME}, s, e, time, direction, round(magnitude, 6) as magnitude, round(before, 6) as before, round(after, 6) as after from cp",
    "s5_threshold_crossings": f"""{_SINGLE}, x as (select *, support >= 75 as now, coalesce(lag(support >= 75) over (partition by item order by t), false) as was,
  coalesce(avg(support) over (partition by item order by t rows between {LEVEL} preceding and 1 preceding), 0) as before, coalesce(avg(support) over (partition by item order by t rows between current row and {LEVEL - 1} following), 0) as after from s1)
select item::varchar as pattern, t as time, case when now then 'up' else 'down' end as direction, round(greatest(1.0, case when now then after - before else before - after end), 6) as magnitude, round(before, 6) as before, round(after, 6) as after from x where now <> was""",
    "s8_bare_points": f"""{_PAIRS} select {NAME}, time, 'bag' as convention from (select pattern, s as time from d2, n where s >= 0 and s <= n - {W} union all select pattern, e + 1 from d2, n where e + 1 <= n - {W})
union all select distinct array_to_string(pattern, ','), time, 'set' from (select pattern, s as time from d2 union all select pattern, e + 1 from d2, n where e + 1 < n)""",
    "f14_support_range": f"{_PAIRS} select {NAME} from sr group by sr.pattern having max(support) - min(support) >= 14",
    "f15_sampled_range": f"""{_PAIRS},
q as (select pattern, floor((s + e) / 2.0)::bigint as t, true as i from d2 union all select pattern, floor((e + nx) / 2.0)::bigint, false from (select *, lead(s) over (partition by pattern order by s, e) as nx from d2) where nx is not null
  union all select pattern, 0, false from pt union all select pattern, n - {W}, false from pt, n)
select {NAME} from (select pattern, coalesce(max(support) filter (i), 0) as hi, coalesce(min(support) filter (not i), 0) as lo from (select q.*, sr.support from q join sr using (pattern, t)) group by pattern) where hi - lo >= 15""",
    "f16_strong_points": f"{_POINTS} select {NAME}, s, e, time, direction from cp where magnitude >= 1.5 and magnitude / greatest(1.0, before) >= 0.1",
    "a3_scores": f"{_SCORED} select {NAME}, s, e, time, event_id, round(proximity, 6) as proximity, round(score, 6) as score from sk",
    "a3_ablations": f"""{_POINTS}, z as (select pattern, time, event_id, 'full None' as kind, round({_NEAR} * (magnitude / greatest(1.0, before)), 9) as score, 0.1 as th from cp, ev
  union all select pattern, time, event_id, 'none no_prox', round(magnitude, 9), 1.2 from cp, ev union all select pattern, time, event_id, 'sqrt no_mag', round({_NEAR}, 9), 0.5 from cp, ev)
select {NAME}, time, event_id, kind, round(score, 6) as score from z where score >= th""",
    "a4_observed": f"{_SCORED} select {NAME}, event_id, round(round(sum(score), 9), 6) as observed from sk group by pattern, event_id",
    "a5_shifts": f"""with{SQL_BASE}, sf as (select b, 1 + (b * 7919 + 104729) % (n - {W}) as off, n - {W} + 1 as top from n, (select unnest(generate_series(0, {SHIFTS - 1})) as b))
select event_id, b::int as b, (start + off) % top as start, least((start + off) % top + "end" - start, top - 1) as "end" from ev, sf""",
    "a6_permutation_test": f"{_permuted('pattern, s, e')} select {NAME}, s, e, event_id, round(observed, 6) as observed, round(p_value, 6) as p_value from te",
    "a6_pooled_test": f"{_permuted('pattern')} select {NAME}, event_id, round(observed, 6) as observed, round(p_value, 6) as p_value from te",
    "a7_independent": f"{_permuted('pattern', own=_OWN)} select {NAME}, event_id, round(observed, 6) as observed, round(p_value, 6) as p_value from te",
    "a10_within_pattern": f"{_permuted('pattern')} select {NAME}, event_id, round(least(1.0, p_value * count(*) over (partition by pattern)), 6) as adjusted from te",
    "a11_series_attribution": f"""{_permuted('pattern', _CROSSED)}, ap as (select *, least(1.0, p_value * count(*) over (partition by pattern)) as a1 from te){_BEST.format(unit='pattern')}
select array_to_string(ap.pattern, ',') as pattern, name as event_name, time, round(observed, 6) as score, round(p_value, 6) as p_value, round(a1, 6) as adjusted
from ap join bs on bs.pattern = ap.pattern and bs.event_id = ap.event_id and bs.r = 1 where a1 < {ALPHA}""",
    "a12_attribution": f"""{_permuted('pattern, s, e')}{_BH}{_BEST.format(unit='pattern, s, e')}
select array_to_string(bh.pattern, ',') as pattern, bh.s as interval_start, bh.e as interval_end, time, direction, name as event_name, round(observed, 6) as score, round(p_value, 6) as p_value, round(a1, 6) as adjusted
from bh join bs on bs.pattern = bh.pattern and bs.s = bh.s and bs.e = bh.e and bs.event_id = bh.event_id and bs.r = 1 where a1 < {ALPHA}""",
    "a12_every_hypothesis": f"""{_permuted('pattern, s, e')}{_BH}{_BEST.format(unit='pattern, s, e')}
select array_to_string(bh.pattern, ',') as pattern, bh.s as interval_start, bh.e as interval_end, time, direction, name as event_name, round(observed, 6) as score, round(p_value, 6) as p_value, round(a1, 6) as adjusted
from bh join bs on bs.pattern = bh.pattern and bs.s = bh.s and bs.e = bh.e and bs.event_id = bh.event_id and bs.r = 1""",
    "a13_pooled_attribution": f"""{_permuted('pattern')}{_BH}{_BEST.format(unit='pattern')}
select array_to_string(bh.pattern, ',') as pattern, name as event_name, time, round(observed, 6) as score, round(p_value, 6) as p_value, round(a1, 6) as adjusted
from bh join bs on bs.pattern = bh.pattern and bs.event_id = bh.event_id and bs.r = 1 where a1 < {ALPHA}""",
    "a14_naive": f"{_SCORED} select {NAME}, event_name, time, round(score, 6) as score from (select pattern, name as event_name, time, score, row_number() over (partition by pattern, name order by s, time, direction) as r from sk) where r = 1",
    "c1_benjamini_hochberg": f"{_permuted('pattern, s, e')}{_BH} select {NAME}, s, e, event_id, round(a1, 6) as adjusted from bh",
    "c2_bonferroni": f"{_permuted('pattern, s, e')} select {NAME}, s, e, event_id, round(least(1.0, p_value * count(*) over ()), 6) as adjusted from te",
    "g1_overlap_dedup": _ROWS + ", rows0 as (select * from ob)," + _CLUSTER.format(test=f"len(a.pattern) = len(b.pattern) and {_SHARED} >= ceil(len(a.pattern) / 2.0)", score="score"),
    "g2_subset_dedup": _ROWS + _TRIPLES + ", rows0 as (select * from tr)," + _CLUSTER.format(test=f"{_SHARED} = least(len(a.pattern), len(b.pattern))", score="score"),
    "g3_p_dedup": f"""{_permuted('pattern')}{_BH}, rw as (select *, row_number() over () as id from (select pattern, name as event_name, round(a1, 9) as adjusted from bh join ev using (event_id))),
eg as (select a.id as x, b.id as y from rw a join rw b on a.event_name = b.event_name and a.id <> b.id and {_SHARED} >= 1),
rc(x, y) as (select id, id from rw union select rc.x, eg.y from rc join eg on rc.y = eg.x),
cc as (select x as id, min(y) as c from rc group by x),
bt as (select pattern, event_name, adjusted, row_number() over (partition by c order by adjusted, pattern) as r from rw join cc using (id))
select {NAME}, event_name, round(adjusted, 6) as adjusted from bt where r = 1""",
    "g4_effect_dedup": _ROWS + _TRIPLES + ", rows0 as (select * from tr)," + _CLUSTER.format(test=f"{_SHARED} >= greatest(1, least(len(a.pattern), len(b.pattern)) // 2)", score="effect"),
    "g5_components": """with recursive ed as (select c_custkey as a, c_nationkey || '/' || floor(c_acctbal / 40)::bigint as k from customer),
lk as (select a, min(a) over (partition by k) as b from ed union all select a, a - a % 7 from ed where a > 7 and a % 3 = 0),
bo as (select a as x, b as y from lk union select b, a from lk),
rc(x, y) as (select x, x from bo union select rc.x, bo.y from rc join bo on rc.y = bo.x)
select x as node, min(y) as component from rc group by x""",
    "g6_best_per_pair": f"{_SCORED} select {NAME}, event_name, round(max(score), 6) as score from (select pattern, name as event_name, score from sk) group by pattern, event_name",
    "b1_mann_whitney": _p(_GRID + """,
ra as (select pattern, event_id, inside, y, rank() over w + (count(*) over (partition by pattern, event_id, y) - 1) / 2.0 as r, count(*) over (partition by pattern, event_id, y) as c from gr window w as (partition by pattern, event_id order by y)),
ag as (select pattern, event_id, count(*) filter (inside)::double as nx, count(*) filter (not inside)::double as ny, sum(r) filter (inside) as rs, sum(c::double * c - 1) as ti from ra group by pattern, event_id),
ef as (select pattern, event_id, (rs - nx * (nx + 1) / 2) / (nx * ny) as effect, case when nx * ny / 12 * (nx + ny + 1 - ti / ((nx + ny) * (nx + ny - 1))) > 1e-12 then (rs - nx * (nx + 1) / 2 - nx * ny / 2 - 0.5) / sqrt(nx * ny / 12 * (nx + ny + 1 - ti / ((nx + ny) * (nx + ny - 1)))) end as z from ag where nx >= 5 and ny >= 5)"""),
    "b3_causal_impact": _p(_GRID + """,
fi as (select pattern, event_id, regr_slope(y, t) filter (pre) as b, regr_intercept(y, t) filter (pre) as a, count(*) filter (pre) as np, count(*) filter (inside) as nd from gr group by pattern, event_id),
su as (select pattern, event_id, any_value(np)::double as np, any_value(nd)::double as nd, sum(y - a - b * t) filter (inside) as ef, sum((y - a - b * t) * (y - a - b * t)) filter (pre) as ssr from gr join fi using (pattern, event_id) group by pattern, event_id),
ef as (select pattern, event_id, ef as effect, case when sqrt(ssr / greatest(1, np - 2)) * sqrt(nd * (1 + nd / np)) >= 1e-12 then ef / (sqrt(ssr / greatest(1, np - 2)) * sqrt(nd * (1 + nd / np))) end as z from su where nd >= 5 and np >= 10)"""),
    "b4_interrupted": _p(_GRID + """,
fi as (select pattern, event_id, inside, any_value(start) as st, count(*)::double as c, regr_slope(y, t) as b, regr_intercept(y, t) as a, regr_sxx(y, t) as sxx, avg(t) as mt from gr group by pattern, event_id, inside),
rs as (select g.pattern, g.event_id, g.inside, sum((y - a - b * t) * (y - a - b * t)) as ssr from gr g join fi on fi.pattern = g.pattern and fi.event_id = g.event_id and fi.inside = g.inside group by g.pattern, g.event_id, g.inside),
fr as (select * from fi join rs using (pattern, event_id, inside)),
ef as (select o.pattern, o.event_id, (i.a + i.b * i.st) - (o.a + o.b * o.st) as effect,
  ((i.a + i.b * i.st) - (o.a + o.b * o.st)) / sqrt((i.ssr + o.ssr) / (i.c + o.c - 4) * (1 / i.c + (i.st - i.mt) * (i.st - i.mt) / i.sxx + 1 / o.c + (o.st - o.mt) * (o.st - o.mt) / o.sxx)) as z
  from fr i join fr o on i.pattern = o.pattern and i.event_id = o.event_id and i.inside and not o.inside where i.c >= 10 and o.c >= 10)"""),
    "b6_event_study": _p(_GRID + """,
ag as (select pattern, event_id, avg(y) filter (pre) as mu, stddev_pop(y) filter (pre) as sd, count(*) filter (pre) as np, count(*) filter (inside)::double as nd, sum(y) filter (inside) as sy from gr group by pattern, event_id),
ef as (select pattern, event_id, sy - nd * mu as effect, case when sd >= 1e-6 then (sy - nd * mu) / (sd * sqrt(nd)) end as z from ag where nd >= 5 and np >= 10)"""),
    "b7_coincidence": _p(_ECA),
    "b8_contrast": _p(_PAIRS + """,
xy as (select pattern, event_id, sum(case when t between start and "end" then 1.0 else 0 end)::double as x, sum(case when t between start and "end" then 0 else 1.0 end)::double as y, any_value("end" - start + 1)::double as n1, any_value(n)::double as n from tm, ev, n group by pattern, event_id),
ef as (select pattern, event_id, x / n1 - y / (n - n1) as effect, (x / n1 - y / (n - n1)) / sqrt((x + y) / n * (1 - (x + y) / n) * (1 / n1 + 1 / (n - n1))) as z from xy)"""),
    "b10_finished": _with_p(_ECA) + f""",
te as (select pattern, event_id, p_value from pv){_BH} select {NAME}, name as event_name, round(a1, 5) as adjusted from bh join ev using (event_id) where a1 < 0.5""",
    "z1_relations": f"""{_PAIRS}, r as (select pattern, s, e, event_id, start as a, "end" as b from d2, ev),
z as (select *, 'DenseFollowsEvent' as relation, null::bigint as overlap from r where a between e - 100 and e + 100 union all select *, 'EventFollowsDense', null from r where s between b - 100 and b + 100
  union all select *, 'DenseContainsEvent', null from r where s <= a and e + 100 >= b union all select *, 'EventContainsDense', null from r where a <= s and b + 100 >= e
  union all select *, 'DenseOverlapsEvent', e - a from r where s < a and e - a >= 50 and e < b + 100 union all select *, 'EventOverlapsDense', b - s from r where a < s and b - s >= 50 and b < e + 100)
select {NAME}, s, e, event_id, relation, overlap from z""",
}
