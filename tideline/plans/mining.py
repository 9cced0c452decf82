"""Queries on postings, intervals and mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.durable import cut
from tideline.operators import dense, intervals, itemsets, postings
from tideline.plans import base
from tideline.plans.base import MINE, NAME, SQL_BASE, sql_dense, sql_pairs, sql_triples
from tideline.sources import sinks

W, TH = MINE


def r7_dictionary(spark, d):
    return base.brands(spark, d)


def f1_basket_postings(spark, d):
    return base.occ_baskets(spark, d)


def f2_transaction_postings(spark, d):
    return postings.by_transaction(base.occ_baskets(spark, d))


def f5_bag_projection(spark, d):
    """How often each pair is in the baskets of a transaction that has it several times."""
    own = base.occ_baskets(spark, d)
    pairs = cut(itemsets.pair_counts(own).select(F.array("a", "b").alias("pattern")))
    bag = postings.to_transactions(postings.intersect(own.select("item", "basket_id", "t"), pairs, "basket_id"))
    return bag.groupBy("pattern", "t").agg(F.count("*").alias("n")).where("n > 1").select(base.text(), "t", "n")


def f6_intersection(spark, d):
    """Transactions with the first two, and the first three brands."""
    pairs = spark.sql("select * from values (array(0L, 1L)), (array(0L, 1L, 2L)) as t(pattern)")
    return postings.timestamps(base.occ_baskets(spark, d), pairs).select(base.text(), "t")


def _single_runs(spark, d, setting=MINE):
    own = base.occ(spark, d)
    return cut(itemsets.singles(own, *setting)), own


def f7_interval_intersection(spark, d):
    """Where both of two neighbouring brands are dense, and wide enough (F8)."""
    runs, _ = _single_runs(spark, d)
    own = runs.select(F.col("pattern")[0].alias("item"), "s", "e")
    other = own.select((F.col("item") - 1).alias("item"), "s", "e")
    return intervals.at_least(intervals.overlap(own, other, "item"), W)


def f9_covering(spark, d):
    """Runs that cover places all over the axis."""
    runs, _ = _single_runs(spark, d)
    n = base.length(spark, d)
    own = runs.select(F.col("pattern")[0].alias("item"), "s", "e")
    points = own.select("item").distinct().select("item", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(max(1, n // 100)).cast("long"))).alias("p"))
    return intervals.covering(points, own, "item")


def f10_covered(spark, d):
    """Whether runs of a brand lie in runs of the same brand at a lower support."""
    runs, own = _single_runs(spark, d)
    wide = itemsets.singles(own, W, TH - 2).select(F.col("pattern")[0].alias("item"), (F.col("s") + 5).alias("s"), "e")
    return intervals.is_covered(runs.select(F.col("pattern")[0].alias("item"), "s", "e"), wide, "item")


def f11_insert_merge(spark, d):
    """Runs of a brand with those of the next brand put in."""
    runs, _ = _single_runs(spark, d)
    own = runs.select(F.col("pattern")[0].alias("item"), "s", "e")
    return intervals.insert(own, own.select((F.col("item") - 1).alias("item"), "s", "e"), "item")


def d1_left_endpoint(spark, d):
    runs, _ = _single_runs(spark, d)
    return runs.select(base.text(), "s", "e")


def d1_span(spark, d):
    own = base.occ(spark, d).select(F.array("item").alias("pattern"), "t")
    return dense.runs(own, W, TH + 4, convention="span").select(base.text(), "s", "e")


def d2_within_ranges(spark, d):
    """Runs of items inside three ranges of the axis: its first quarter, the third sixth and the last third."""
    own, n = base.occ(spark, d).select(F.array("item").alias("pattern"), "t"), base.length(spark, d)
    ranges = own.select("pattern").distinct().join(F.broadcast(spark.createDataFrame([(0, n // 4), (n // 3, n // 2), (2 * n // 3, n)], "s long, e long")), F.lit(True))
    return dense.runs_within(own, W, TH, ranges).select(base.text(), "s", "e")


def d2_scanned(spark, d):
    """Runs found by scanning from the first to the last occurrence of each brand."""
    own = base.occ(spark, d).select(F.array("item").alias("pattern"), "t")
    ranges = own.groupBy("pattern").agg(F.min("t").alias("s"), F.max("t").alias("e"))
    return dense.scanned_within(own, W, TH, ranges).select(base.text(), "s", "e")


def dense_brand_pairs(spark, d):
    """The flagship: dense pairs of brands with their intervals."""
    return base.pairs(spark, d, MINE)[0].select(base.text(), "s", "e")


def m1_candidates(spark, d):
    level = base.pairs(spark, d, MINE)[0].select("pattern").distinct()
    return itemsets.candidates(cut(level)).select(base.text())


def m2_prune(spark, d):
    level = cut(base.pairs(spark, d, MINE)[0].select("pattern").distinct())
    return itemsets.prune(itemsets.candidates(level), level).select(base.text())


def m4_dense_itemsets(spark, d):
    """Dense itemsets of up to three brands."""
    return itemsets.dense_itemsets(base.occ(spark, d), 500, 5, max_length=3).select(base.text(), "size", "s", "e")


def m4_several_baskets(spark, d):
    """Dense pairs where orders have several baskets, which count each."""
    return itemsets.dense_itemsets(base.occ_baskets(spark, d), W, 4, max_length=2).select(base.text(), "size", "s", "e")


def m6_timestamps(spark, d):
    found, own = base.pairs(spark, d)
    return postings.timestamps(own, found).select(base.text(), "t")


def m7_pair_counts(spark, d):
    return itemsets.pair_counts(base.occ(spark, d))


def w1_pattern_rows(spark, d):
    found, _ = base.pairs(spark, d, MINE)
    return sinks.pattern_rows(found)


def w2_interval_lines(spark, d):
    found, _ = base.pairs(spark, d, MINE)
    return sinks.interval_lines(found)


def w3_transaction_lines(spark, d):
    return sinks.transaction_lines(base.occ(spark, d).groupBy("t").agg(F.collect_list("item").alias("items")))


def hourly_user_itemsets(spark, d):
    """Event types of users within hours: many baskets per transaction."""
    rows = base.table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("hour"), "user_id", "event_type")
    kinds = postings.small(cut(postings.dictionary(rows, "event_type")))
    hours = cut(postings.dictionary(rows, "hour", "t"))
    made = rows.join(kinds, "event_type").join(postings.small(hours), "hour").select("t", F.xxhash64("t", "user_id").alias("basket_id"), "item").distinct()
    return itemsets.dense_itemsets(cut(made), 24, 4, max_length=2).where("size = 2").select(base.text(), "s", "e")


QUERIES = [r7_dictionary, f1_basket_postings, f2_transaction_postings, f5_bag_projection, f6_intersection, f7_interval_intersection, f9_covering, f10_covered, f11_insert_merge, d1_left_endpoint, d1_span, d2_within_ranges, d2_scanned, dense_brand_pairs, m1_candidates, m2_prune, m4_dense_itemsets, m4_several_baskets, m6_timestamps, m7_pair_counts, w1_pattern_rows, w2_interval_lines, w3_transaction_lines, hourly_user_itemsets]

_ONE = f"with{SQL_BASE},\nt1 as (select item, t from occ),{sql_dense('t1', 'd1', W, TH, 'item')}"
_TWO = f"with{sql_pairs(W, TH)}"
_MERGED = """, mx as (select *, max(e) over (partition by item order by s, e rows between unbounded preceding and 1 preceding) as pe from al),
gr as (select *, sum(case when pe is null or s > pe + 1 then 1 else 0 end) over (partition by item order by s, e rows unbounded preceding) as grp from mx)
select item, min(s) as s, max(e) as e from gr group by item, grp"""

SQL = {
    "r7_dictionary": f"with{SQL_BASE} select * from item",
    "f1_basket_postings": f"with{SQL_BASE} select * from occb",
    "f2_transaction_postings": f"with{SQL_BASE} select distinct item, t from occb",
    "f5_bag_projection": f"with{SQL_BASE} select a.item || ',' || b.item as pattern, a.t, count(*) as n from occb a join occb b on a.basket_id = b.basket_id and a.item < b.item group by all having count(*) > 1",
    "f6_intersection": f"with{SQL_BASE} select '0,1' as pattern, t from occb where item in (0, 1) group by t having count(distinct item) = 2 union all select '0,1,2', t from occb where item in (0, 1, 2) group by t having count(distinct item) = 3",
    "f7_interval_intersection": f"{_ONE} select a.item, greatest(a.s, b.s) as s, least(a.e, b.e) as e from d1 a join d1 b on b.item = a.item + 1 and a.s <= b.e and b.s <= a.e where least(a.e, b.e) - greatest(a.s, b.s) >= {W}",
    "f9_covering": f"{_ONE}, p as (select item, unnest(generate_series(0, n - 1, greatest(1, n // 100))) as p from (select distinct item from d1), n) select p.item, p.p, d1.s, d1.e from p left join d1 on d1.item = p.item and p.p between d1.s and d1.e",
    "f10_covered": f"{_ONE},{sql_dense('t1', 'dw', W, TH - 2, 'item')} select item, s, e, exists (select 1 from dw where dw.item = d1.item and dw.s + 5 <= d1.s and d1.e <= dw.e) as covered from d1",
    "f11_insert_merge": f"{_ONE}, al as (select item, s, e from d1 union all select item - 1, s, e from d1){_MERGED}",
    "d1_left_endpoint": f"{_ONE} select item::varchar as pattern, s, e from d1",
    "d2_scanned": f"{_ONE} select item::varchar as pattern, s, e from d1",
    "d1_span": f"with{SQL_BASE},\nt1 as (select item, t from occ),{sql_dense('t1', 'd1', W, TH + 4, 'item')} select * from (select item::varchar as pattern, (select min(t) from t1 where t1.item = d1.item and t >= d1.s) as s, (select max(t) from t1 where t1.item = d1.item and t <= d1.e + {W}) as e from d1) where e - s >= {W}",
    "d2_within_ranges": f"{_ONE} select item::varchar as pattern, greatest(s, a) as s, least(e, b) as e from d1 join (select 0 as a, n // 4 as b from n union all select n // 3, n // 2 from n union all select 2 * n // 3, n from n) as r on s <= b and a <= e",
    "dense_brand_pairs": f"{_TWO} select {NAME}, s, e from d2",
    "m1_candidates": f"{_TWO}, l as (select distinct pattern as p from d2) select a.p[1] || ',' || a.p[2] || ',' || b.p[2] as pattern from l a join l b on a.p[1] = b.p[1] and a.p[2] < b.p[2]",
    "m2_prune": f"{_TWO}, l as (select distinct pattern as p from d2) select a.p[1] || ',' || a.p[2] || ',' || b.p[2] as pattern from l a join l b on a.p[1] = b.p[1] and a.p[2] < b.p[2] join l c on c.p[1] = a.p[2] and c.p[2] = b.p[2]",
    "m4_dense_itemsets": f"with{sql_triples(500, 5)} select {NAME}, len(pattern)::int as size, s, e from (select * from d1 union all select * from d2 union all select * from d3)",
    "m4_several_baskets": f"with{sql_pairs(W, 4, 'occb')} select {NAME}, len(pattern)::int as size, s, e from (select * from d1 union all select * from d2)",
    "m6_timestamps": f"with{sql_pairs(*base.TEST)}{base.sql_times()} select {NAME}, t from tm",
    "m7_pair_counts": f"with{SQL_BASE} select a.item as a, b.item as b, count(*) as n from occ a join occ b on a.basket_id = b.basket_id and a.item < b.item group by all",
    "w1_pattern_rows": f"{_TWO} select '[{{' || array_to_string(pattern, ', ') || '}}]' as pattern_components, '[]' as pattern_gaps, len(pattern)::int as pattern_size, count(*)::int as intervals_count, string_agg('(' || s || ',' || e || ')', ';' order by s, e) as intervals from d2 group by pattern",
    "w2_interval_lines": f"{_TWO} select '[' || array_to_string(pattern, ', ') || '] ' || s || ' ' || e as value from d2",
    "w3_transaction_lines": f"with{SQL_BASE} select t, string_agg(item::varchar, ' ' order by item) as value from occ group by t",
    "hourly_user_itemsets": f"""with k as (select event_type, (row_number() over (order by event_type) - 1)::bigint as item from events where event_type is not null group by event_type),
h as (select hour, (row_number() over (order by hour) - 1)::bigint as t from (select distinct date_trunc('hour', ts) as hour from events)),
o as (select distinct t, user_id, item from events join k using (event_type) join h on h.hour = date_trunc('hour', ts)),
t1 as (select distinct [item] as pattern, t from o),{sql_dense("t1", "d1", 24, 4)},
a2 as (select distinct [a.pattern[1], b.pattern[1]] as pattern, greatest(a.s, b.s) as s, least(a.e, b.e) as e from d1 a join d1 b on a.pattern[1] < b.pattern[1] and a.s <= b.e and b.s <= a.e where least(a.e, b.e) - greatest(a.s, b.s) >= 24),
o2 as (select [a.item, b.item] as pattern, a.t from o a join o b on a.t = b.t and a.user_id = b.user_id and a.item < b.item),{sql_dense("o2", "u2", 24, 4)}
select {NAME}, s, e from (select distinct u2.pattern, greatest(u2.s, a2.s) as s, least(u2.e, a2.e) as e from u2 join a2 on u2.pattern = a2.pattern and u2.s <= a2.e and a2.s <= u2.e)""",
}
