"""Queries on evaluation, reports, retail preparation and synthetic data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.durable import cut
from tideline.operators import baselines, changes, correction, evaluation, itemsets, pipeline, support
from tideline.plans import attribution as at
from tideline.plans import base
from tideline.plans.base import NAME, SQL_BASE
from tideline.sources import readers, retail, sinks, synthetic

W, TH = at.W, at.TH
CONFIG = pipeline.Config(window=W, theta=TH, permutations=at.SHIFTS, alpha=at.ALPHA, unit="pattern")


def _attributed(spark, d):
    found, times, events, n, own = at._given(spark, d)
    return base.held(spark, d, "attributed", lambda: cut(pipeline.attribute(found, own, events, n, CONFIG, times))), found, events, own


def _truth(found, events):
    """Ground truth: the longest interval of a pair with an even sum that meets an event."""
    met = found.where((F.col("pattern")[0] + F.col("pattern")[1]) % 2 == 0).join(F.broadcast(events), (F.col("s") <= F.col("end")) & (F.col("e") >= F.col("start")))
    best = F.max_by(F.struct("s", "e"), F.struct(F.col("e") - F.col("s"), -F.col("s")))
    return met.groupBy("pattern", "event_id").agg(best.alias("x")).select("pattern", "event_id", F.col("x.s").alias("interval_start"), F.col("x.e").alias("interval_end"))


def e1_interval_evaluation(spark, d):
    rows, found, events, _ = _attributed(spark, d)
    out = evaluation.intervals_and_events(rows, _truth(found, events), events)
    return at._rounded(out, "precision", "recall", "f1")


def e2_pair_evaluation(spark, d):
    rows, found, events, _ = _attributed(spark, d)
    out = evaluation.patterns_and_events(rows, _truth(found, events), events)
    return at._rounded(out, "precision", "recall", "f1")


def e3_false_attribution(spark, d):
    """Unrelated: pairs whose first item is a multiple of three."""
    rows, found, _, _ = _attributed(spark, d)
    return at._rounded(evaluation.false_attribution(rows, found.where(F.col("pattern")[0] % 3 == 0)), "rate")


def _seeds(spark, d):
    """Mean values of each quarter hour of events, as results by seed (the hour) and condition (the type)."""
    rows = base.table(spark, d, "events").where("value is not null")
    return rows.groupBy("event_type", F.hour("ts").alias("seed")).agg((F.avg("value") / 200).alias("f1"), F.count("*").alias("k"))


def e4_means(spark, d):
    return at._rounded(evaluation.means(_seeds(spark, d), "event_type", values=("f1",)), "f1")


def e5_confidence(spark, d):
    return at._rounded(evaluation.confidence(_seeds(spark, d), "f1", "event_type"), "mean", "sd", "se", "low", "high")


def e6_null_discoveries(spark, d):
    """Hours as seeds without effects: those with a rare high value count as false discoveries."""
    rows = base.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("seed")).agg(F.sum(F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).alias("n_predicted"))
    return at._rounded(evaluation.null_discoveries(rows), "fdr")


def e7_coupon_consistency(spark, d):
    """Coupons: a campaign covers the items that leave its number when divided by ten."""
    rows, _, _, _ = _attributed(spark, d)
    items = base.brands(spark, d).select("item")
    coupons = items.select((F.col("item") % 10).alias("campaign"), "item")
    return evaluation.coupon_consistency(evaluation.of_type(rows.withColumnRenamed("event_name", "name"), "TypeA").withColumnRenamed("name", "event_name"), coupons).select(base.text(), "event_id", "campaign", "coupon_consistent")


def e7_consistency_rate(spark, d):
    rows, _, _, _ = _attributed(spark, d)
    items = base.brands(spark, d).select("item")
    coupons = items.select((F.col("item") % 10).alias("campaign"), "item")
    return at._rounded(evaluation.consistency_rate(evaluation.coupon_consistency(rows, coupons)), "rate")


def e7_named_items(spark, d):
    items = base.brands(spark, d)
    return evaluation.named_items(items.select("item"), items.where("item % 3 <> 0").select("item", F.col("p_brand").alias("commodity")))


def e8_top_per_event(spark, d):
    rows, _, events, _ = _attributed(spark, d)
    return at._rounded(evaluation.top_per_event(rows, events).select("event_id", "rank", base.text(), "score"), "score")


def e9_funnel(spark, d):
    found, times, events, n, _ = at._given(spark, d)
    passing = changes.sampled_range(found, times, W, n, 10)
    points = changes.from_intervals(found, times, W, n, at.LEVEL)
    return evaluation.funnel(found, points, events, passing)


def e10_range_sweep(spark, d):
    found, times, _, n, _ = at._given(spark, d)
    return evaluation.range_sweep(support.steps(times, found, W, n))


def _tests(spark, d):
    found, _, events, n, _ = at._given(spark, d)
    return cut(baselines.coincidence(found, events, W, n).select("pattern", "event_id", F.round("p_value", 6).alias("p_value"))), found, events


def e11_counts_below(spark, d):
    return evaluation.counts_below(_tests(spark, d)[0])


def e11_lowest(spark, d):
    tested = correction.benjamini_hochberg(_tests(spark, d)[0])
    return at._rounded(evaluation.lowest(tested.withColumn("adjusted", F.round("adjusted", 5))).select(base.text(), "event_id", "adjusted"), "adjusted")


def e12_ranked_tests(spark, d):
    tested, found, events = _tests(spark, d)
    out = evaluation.ranked_tests(tested, _truth(found, events))
    return at._rounded(out.select(base.text(), "event_id", "adjusted", "bonferroni", "is_true"), "adjusted", "bonferroni", digits=5)


def e12_alpha_sweep(spark, d):
    tested, found, events = _tests(spark, d)
    truth = _truth(found, events)
    return at._rounded(evaluation.alpha_sweep(evaluation.ranked_tests(tested, truth), truth), "precision", "recall", "f1")


def e13_histogram(spark, d):
    return evaluation.histogram(_tests(spark, d)[0])


def e14_random_match(spark, d):
    """Suppliers as campaigns, their parts as coupon products."""
    coupons = base.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("campaign"), F.col("l_partkey").alias("item"))
    return at._rounded(evaluation.random_match(coupons, 100_000), "chance")


def e15_jaccard(spark, d):
    own = base.occ(spark, d)
    a, b = (itemsets.singles(own, 100, th) for th in (8, 9))
    return at._rounded(evaluation.jaccard(a, b).select(base.text(), "jaccard"), "jaccard")


def w6_attribution_rows(spark, d):
    rows, _, _, _ = _attributed(spark, d)
    return at._rounded(sinks.attribution_rows(rows), "change_magnitude", "proximity", "attribution_score", "p_value", "adjusted_p_value")


def w5_report(spark, d):
    rows, _, _, _ = _attributed(spark, d)
    return sinks.report(rows)


def r5_parsed_numbers(spark, d):
    """Numbers in customers' names after their sign, -1 for those that are cut short."""
    text = F.when(F.col("c_custkey") % 10 == 0, F.lit("none")).otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")))
    return base.table(spark, d, "customer").select("c_custkey", readers.number_or(text).alias("n"), evaluation.number_of(F.concat(F.lit("C"), F.col("c_custkey").cast("string"))).alias("m"))


def _sales(spark, d):
    """Lines as sales rows: invoice, code, quantity, price, country and date."""
    rows = base.table(spark, d, "lineitem").join(base.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    invoice = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("C"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    code = F.when(F.col("l_partkey") % 40 == 0, F.lit("POST")).when(F.col("l_partkey") % 41 != 0, F.concat(F.lit(" P"), (F.col("l_partkey") % 50).cast("string")))
    country = F.when(F.col("o_orderkey") % 3 == 0, F.lit("France")).otherwise(F.lit("United Kingdom"))
    return rows.select(invoice.alias("Invoice"), code.alias("StockCode"), F.col("l_quantity").alias("Quantity"), F.col("l_extendedprice").alias("Price"), country.alias("Country"), F.col("o_orderdate").alias("InvoiceDate"))


def r8_clean(spark, d):
    return retail.clean(_sales(spark, d)).groupBy("Date", "Invoice", "StockCode").agg(F.count("*").alias("n"))


def r9_invoice_baskets(spark, d):
    made = retail.baskets(retail.clean(_sales(spark, d)), ["Date", "Invoice"], "StockCode")
    return made.select("t", "Invoice", F.array_join("codes", " ").alias("codes"))


def _receipts(spark, d):
    rows = base.table(spark, d, "lineitem").join(base.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))
    # a week's receipts count on its first day, so that most days have none
    return rows.select(F.col("l_orderkey").alias("BASKET_ID"), (day - day % 7).alias("DAY"), (F.col("l_partkey") % 60).alias("PRODUCT_ID"))


def r10_receipts(spark, d):
    return retail.receipts(_receipts(spark, d)).select("t", "basket", F.array_join(F.transform("codes", lambda x: x.cast("string")), " ").alias("codes"))


def r11_days(spark, d):
    return retail.days(_receipts(spark, d)).select("t", "day", F.array_join("codes", " ").alias("codes"))


def r12_date_ranges(spark, d):
    """Quarters as events on the axis of orders."""
    dated = base.axis(spark, d).select("t", F.to_date("o_orderdate").alias("date"))
    quarter = F.trunc("date", "quarter")
    ranges = dated.select(quarter.alias("date_start")).distinct().select(F.concat(F.lit("Q"), F.date_format("date_start", "yyyyMM")).alias("event_id"), "date_start", F.date_sub(F.add_months("date_start", 3), 1).alias("date_end"))
    return retail.date_ranges(dated, ranges)


def r13_day_ranges(spark, d):
    """Campaigns whose days may be missing or out of range."""
    made = cut(retail.receipts(_receipts(spark, d)).select("t", "day"))
    low = made.agg(F.min("day").alias("low"))
    ranges = spark.sql("select * from values ('A', -100, 40), ('B', 5, 100), ('C', 300, 425), ('D', 1000, 100000) as t(event_id, x, y)").join(F.broadcast(low), F.lit(True)).select("event_id", (F.col("low") + F.col("x")).alias("day_start"), (F.col("low") + F.col("y")).alias("day_end"))
    return retail.day_ranges(made, ranges)


def r14_campaign_names(spark, d):
    rows = base.table(spark, d, "supplier").select(F.concat(F.lit("Type"), (F.col("s_nationkey") % 3).cast("string")).alias("description"), F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") * 37 % 101).alias("start"))
    return retail.campaign_names(rows)


def r15_metadata(spark, d):
    made, _ = retail.encoded(retail.receipts(_receipts(spark, d)))
    return retail.metadata(made)


def r7_encoded_items(spark, d):
    made, _ = retail.encoded(retail.baskets(retail.clean(_sales(spark, d)), ["Date", "Invoice"], "StockCode"))
    return sinks.transaction_lines(made)


def r1_basket_lines(spark, d):
    """Lines of text, written as baskets and read again by the parser."""
    flags = base.occ_baskets(spark, d).groupBy("t", "basket_id").agg(F.array_join(F.array_sort(F.collect_list("item")), " ").alias("x"))
    lines = flags.groupBy("t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("basket_id", "x"))), lambda v: v["x"]), " | ").alias("line"))
    return readers.numbered_baskets(lines).select("t", F.size("baskets").alias("n_baskets"), F.aggregate(F.flatten("baskets"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def y2_ground_truth(spark, d):
    found, _, events, _, _ = at._given(spark, d)
    return _truth(found, events).select(base.text(), "event_id", "interval_start", "interval_end")


def y4_zipf(spark, d):
    return at._rounded(synthetic.zipf_chances(spark, 200), "p", digits=9)


QUERIES = [e1_interval_evaluation, e2_pair_evaluation, e3_false_attribution, e4_means, e5_confidence, e6_null_discoveries, e7_coupon_consistency, e7_consistency_rate, e7_named_items, e8_top_per_event, e9_funnel, e10_range_sweep, e11_counts_below, e11_lowest, e12_ranked_tests, e12_alpha_sweep, e13_histogram, e14_random_match, e15_jaccard, w5_report, w6_attribution_rows, r5_parsed_numbers, r8_clean, r9_invoice_baskets, r10_receipts, r11_days, r12_date_ranges, r13_day_ranges, r14_campaign_names, r15_metadata, r7_encoded_items, r1_basket_lines, y2_ground_truth, y4_zipf]

_TRUTH = """,
gt as (select pattern, event_id, arg_max({s: s, e: e}, (e - s) * 1000000 - s) as x from d2, ev where s <= "end" and e >= start and (pattern[1] + pattern[2]) % 2 = 0 group by pattern, event_id)"""
_ATTRIBUTED = at._permuted("pattern") + at._BH + at._BEST.format(unit="pattern") + f""",
att as (select bh.pattern, bs.s, bs.e, bs.time, bs.direction, bh.event_id, ev.name, ev.start, ev."end", observed as score, p_value, a1 as adjusted
from bh join bs on bs.pattern = bh.pattern and bs.event_id = bh.event_id and bs.r = 1 join ev on ev.event_id = bh.event_id where a1 < {at.ALPHA})""" + _TRUTH
_RATES = """select tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from
(select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as p, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as r from
(select count(*) filter (a and g) as tp, count(*) filter (a and not g) as fp, count(*) filter (g and not a) as fn from (select bool_or(k = 1) as a, bool_or(k = 2) as g from ({0}) group by {1})))"""
_COUPON = "exists (select 1 from (select unnest(pattern) as item) where item % 10 = substr(event_id, 2)::bigint)"
_SEEDS = "with z as (select event_type, hour(ts) as seed, avg(value) / 200 as f1 from events where value is not null group by all)"
_ECA = at._with_p(at._ECA) + ", te as (select pattern, event_id, round(p_value, 6) as p_value from pv)" + _TRUTH + at._BH
_SALES = """with sales as (select case when o_orderkey % 11 = 0 then 'C' else '' end || o_orderkey as invoice, case when l_partkey % 40 = 0 then 'POST' when l_partkey % 41 <> 0 then 'P' || (l_partkey % 50) end as code,
 l_quantity as q, l_extendedprice as p, o_orderkey % 3 <> 0 as uk, o_orderdate::date as dt from lineitem join orders on l_orderkey = o_orderkey),
cl as (select * from sales where uk and not starts_with(invoice, 'C') and code is not null and code not in ('POST', 'D', 'C2', 'M', 'BANK CHARGES', 'PADS', 'DOT', 'CRUK', 'AMAZONFEE', 'S', 'ADJUST', 'B') and dt is not null and q > 0 and p > 0),
iv as (select (row_number() over (order by dt, invoice) - 1)::bigint as t, * from (select dt, invoice, list_sort(list(distinct code)) as codes from cl group by dt, invoice))"""
_RECEIPTS = """with rc as (select l_orderkey as b, date_diff('day', date '1990-01-01', o_orderdate::date)::int as day, l_partkey % 60 as p from lineitem join orders on l_orderkey = o_orderkey),
r5 as (select * replace (day - day % 7 as day) from rc),
re as (select (row_number() over (order by day, basket) - 1)::bigint as t, * from (select b::varchar as basket, max(day) as day, list_sort(list(distinct p)) as codes from r5 group by b))"""

SQL = {
    "e1_interval_evaluation": f"{_ATTRIBUTED} " + _RATES.format("select pattern, event_id, s, e, 1 as k from att union all select pattern, event_id, x.s, x.e, 2 from gt", "pattern, event_id, s, e"),
    "e2_pair_evaluation": f"{_ATTRIBUTED} " + _RATES.format("select pattern, event_id, 1 as k from att union all select pattern, event_id, 2 from gt", "pattern, event_id"),
    "e3_false_attribution": f"{_ATTRIBUTED} select count(*) as n_unrelated, count(*) filter (pattern in (select pattern from att)) as n_false, round(count(*) filter (pattern in (select pattern from att)) / greatest(1, count(*))::double, 6) as rate from pt where pattern[1] % 3 = 0",
    "e4_means": f"{_SEEDS} select event_type, round(avg(f1), 6) as f1 from z group by event_type",
    "e5_confidence": f"""{_SEEDS}, a as (select event_type, count(*) as n, avg(f1) as m, stddev_samp(f1) as sd from z group by event_type)
select event_type, n, round(m, 6) as mean, round(sd, 6) as sd, round(sd / sqrt(n), 6) as se, round(greatest(0, m - 2.093 * sd / sqrt(n)), 6) as low, round(least(1, m + 2.093 * sd / sqrt(n)), 6) as high from a""",
    "e6_null_discoveries": "select count(*) as seeds, count(*) filter (k > 0) as seeds_with_false, round(count(*) filter (k > 0) / count(*)::double, 6) as fdr from (select count(*) filter (event_id % 97 = 0) as k from events group by date_trunc('hour', ts))",
    "e7_coupon_consistency": f"{_ATTRIBUTED} select distinct {NAME}, event_id, substr(event_id, 2)::bigint as campaign, {_COUPON} as coupon_consistent from att where contains(name, 'TypeA')",
    "e7_consistency_rate": f"{_ATTRIBUTED} select count(*) filter (c) as consistent, count(*) as total, case when count(*) > 0 then round(count(*) filter (c) / count(*)::double, 6) else 0 end as rate from (select distinct pattern, event_id, {_COUPON} as c from att)",
    "e7_named_items": f"with{SQL_BASE} select item, case when item % 3 = 0 then 'ID:' || item else p_brand end as commodity from item",
    "e8_top_per_event": f"{_ATTRIBUTED}, k as (select event_id, pattern, score, row_number() over (partition by event_id order by score desc, pattern) as rank from att) select ev.event_id, coalesce(rank, 0)::int as rank, array_to_string(pattern, ',') as pattern, round(coalesce(score, 0), 6) as score from ev left join (select * from k where rank <= 3) k on k.event_id = ev.event_id",
    "e9_funnel": at.SQL["f15_sampled_range"].replace(f"select {NAME} from", ", pa as (select pattern from").replace("lo >= 15", "lo >= 10)") + f""",
wc as (select distinct pattern from (select pattern, s as time from d2 union all select pattern, e + 1 from d2), n where time >= 0 and time <= n - {W} and pattern in (select pattern from pa))
select (select count(*) from pt) as patterns, (select count(*) from pt) as longer, (select count(*) from pa) as passing, (select count(*) from wc) as with_changes, 5::bigint as events, (select count(*) from wc) * 5 as hypotheses""",
    "e10_range_sweep": f"{at._PAIRS}, r as (select max(support) - min(support) as x from sr group by pattern) select delta::int as delta, count(*) filter (x >= delta)::bigint as patterns from r, (values (0), (1), (2), (3), (5), (10), (20)) as v(delta) group by delta",
    "e11_counts_below": f"{_ECA} select bound::double as bound, count(*) filter (p_value < bound::double)::bigint as n from te, (values (0.001), (0.005), (0.01), (0.05), (0.1), (0.2), (0.5), (1.0)) as v(bound) group by bound",
    "e11_lowest": f"{_ECA} select {NAME}, event_id, round(a1, 5) as adjusted from bh order by round(a1, 5), bh.pattern, event_id limit 20",
    "e12_ranked_tests": f"{_ECA} select {NAME}, event_id, round(a1, 5) as adjusted, round(least(1.0, p_value * m), 5) as bonferroni, exists (select 1 from gt where gt.pattern = bh.pattern and gt.event_id = bh.event_id) as is_true from bh",
    "e12_alpha_sweep": f"""{_ECA}, c as (select alpha::double as alpha, count(*) filter (a1 < alpha::double and k)::bigint as tp, count(*) filter (a1 < alpha::double and not k)::bigint as fp from (select *, exists (select 1 from gt where gt.pattern = bh.pattern and gt.event_id = bh.event_id) as k from bh), (values (0.01), (0.05), (0.1), (0.2), (0.5)) as v(alpha) group by alpha),
f as (select *, (select count(*) from gt) - tp as fn from c), g as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as p, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as r from f)
select alpha, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from g""",
    "e13_histogram": f"{_ECA} select least(floor(p_value * 20), 19)::int as bin, count(*) as n from te group by 1",
    "e14_random_match": "select kind, count(*) as campaigns, round(avg(1 - (100000 - c) / 100000.0::double * ((99999 - c) / 99999.0::double)), 6) as chance from (select count(distinct l_partkey)::double as c, case when count(distinct l_partkey) >= 3000 then 'A' when count(distinct l_partkey) >= 200 then 'B' else 'C' end as kind from lineitem group by l_suppkey) group by kind",
    "e15_jaccard": f"""with{SQL_BASE}, t1 as (select item, t from occ),{base.sql_dense("t1", "da", 100, 8, "item")},{base.sql_dense("t1", "db", 100, 9, "item")},
a as (select item, sum(e - s + 1) as n from da group by item), b as (select item, sum(e - s + 1) as n from db group by item),
c as (select da.item, sum(least(da.e, db.e) - greatest(da.s, db.s) + 1) as n from da join db on da.item = db.item and da.s <= db.e and db.s <= da.e group by da.item)
select item::varchar as pattern, round(coalesce(c.n, 0)::double / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(c.n, 0))::double, 6) as jaccard from a full join b using (item) left join c using (item)""",
    "w6_attribution_rows": f"""{_ATTRIBUTED} select array_to_string(att.pattern, ' ') as pattern, att.time as change_time, att.direction as change_direction, round(cp.magnitude, 6) as change_magnitude, name as event_name, start as event_start, "end" as event_end,
round(exp(-least(abs(att.time - start), abs(att.time - "end"))::double / 500.0), 6) as proximity, round(score, 6) as attribution_score, round(p_value, 6) as p_value, round(adjusted, 6) as adjusted_p_value
from att join cp on cp.pattern = att.pattern and cp.s = att.s and cp.e = att.e and cp.time = att.time and cp.direction = att.direction""",
    "w5_report": f"{_ATTRIBUTED} select '{{' || array_to_string(pattern, ', ') || '}} <- ' || name || ' at ' || time || ' (' || direction || ') ' || format('score={{:.4f}} p={{:.4f}} adj_p={{:.4f}}', score::double, p_value::double, adjusted::double) as value from att",
    "r5_parsed_numbers": "select c_custkey, case when c_custkey % 10 = 0 then -1 else c_custkey end as n, c_custkey as m from customer",
    "r8_clean": f'{_SALES} select dt as "Date", invoice as "Invoice", code as "StockCode", count(*) as n from cl group by all',
    "r9_invoice_baskets": f"{_SALES} select t, invoice as \"Invoice\", array_to_string(codes, ' ') as codes from iv",
    "r10_receipts": f"{_RECEIPTS} select t, basket, array_to_string(codes, ' ') as codes from re",
    "r11_days": f"{_RECEIPTS} select (row_number() over (order by day) - 1)::bigint as t, day, array_to_string(list_sort(list(distinct p::varchar)), ' ') as codes from r5 group by day",
    "r12_date_ranges": f"with{SQL_BASE} select 'Q' || strftime(date_trunc('quarter', o_orderdate), '%Y%m') as event_id, min(t) as start, max(t) as \"end\" from tx group by 1",
    "r13_day_ranges": f"""{_RECEIPTS}, b as (select min(day) as lo, max(day) as hi from re), g as (select v.*, least(greatest(lo + x, lo), hi) as a, least(greatest(lo + y, lo), hi) as z from b, (values ('A', -100, 40), ('B', 5, 100), ('C', 300, 425), ('D', 1000, 100000)) as v(event_id, x, y))
select event_id, min(t) filter (day >= a) as start, max(t) filter (day <= z) as "end" from g, re group by event_id having min(t) filter (day >= a) <= max(t) filter (day <= z)""",
    "r14_campaign_names": "select *, description || '_' || row_number() over (partition by description order by pos) as name from (select 'Type' || (s_nationkey % 3) as description, s_suppkey as pos, s_suppkey * 37 % 101 as start from supplier)",
    "r15_metadata": f"{_RECEIPTS} select count(*) as n_transactions, round(avg(len(codes)), 2) as avg_size, max(len(codes))::int as max_size, min(len(codes))::int as min_size, (select count(distinct p) from r5) as n_items from re",
    "r7_encoded_items": f"{_SALES}, dc as (select code, row_number() over (order by code) - 1 as item from cl group by code) select t, string_agg(item::varchar, ' ' order by item) as value from (select t, unnest(codes) as code from iv) join dc using (code) group by t",
    "r1_basket_lines": f"with{SQL_BASE} select t, count(distinct basket_id)::int as n_baskets, sum(item)::bigint as total from occb group by t",
    "y2_ground_truth": f"{at._PAIRS}{_TRUTH} select {NAME}, event_id, x.s as interval_start, x.e as interval_end from gt",
    "y4_zipf": "select k as item, round(least(3.0 / k::double, 0.1), 9) as p from (select unnest(generate_series(1, 200)) as k)",
}
