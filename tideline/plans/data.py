"""Queries on files, settings, generated data and experiments."""

from __future__ import annotations

import io
import json
import zipfile
from uuid import uuid4
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from tideline.durable import cut, shared_folder, temporary
from tideline.operators import evaluation, experiments, intervals, itemsets, pipeline, postings
from tideline.plans import attribution as at
from tideline.plans import base, reports
from tideline.plans.base import NAME, SQL_BASE, sql_dense
from tideline.sources import readers, sinks, synthetic


def _folder(spark) -> str:
    """A new folder that is deleted when the application ends."""
    path = f"{shared_folder(spark)}/files-{uuid4()}"
    temporary(spark, path)
    return path


def _line_file(spark, d, several: bool):
    """The orders as lines of one text file, a line for each position of the axis; its path."""
    own = (base.occ_baskets if several else base.occ)(spark, d)
    baskets = own.groupBy("t", "basket_id").agg(F.array_join(F.array_sort(F.collect_list("item")), " ").alias("x"))
    lines = baskets.groupBy("t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("basket_id", "x"))), lambda v: v["x"]), " | ").alias("value"))
    every = spark.range(base.length(spark, d)).select(F.col("id").alias("t")).join(lines, "t", "left")
    path = _folder(spark)
    every.select("t", F.coalesce("value", F.lit("")).alias("value")).repartition(1).sortWithinPartitions("t").select("value").write.text(path)
    return path


def r1_basket_file(spark, d):
    """A text file of baskets, written and read in splits."""
    rows = readers.basket_text(spark, _line_file(spark, d, True))
    return rows.select("t", F.size("baskets").alias("n_baskets"), F.array_join(F.transform(F.flatten("baskets"), lambda x: x.cast("string")), " ").alias("items"))


def r2_flat_file(spark, d):
    """A text file of flat transactions, written and read in splits."""
    return readers.flat_text(spark, _line_file(spark, d, False)).select("t", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))


def _json_file(spark, rows) -> str:
    """A JSON array of a small table in one file."""
    path = _folder(spark)
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ",\n"), F.lit("]")).alias("value")).coalesce(1).write.text(path)
    return path


def r3_events(spark, d):
    return readers.events_json(spark, _json_file(spark, base.events(spark, base.length(spark, d))))


SETTINGS = {"apriori_parameters": {"window_size": 100, "min_support": 8, "max_length": 3}}


def r4_settings(spark, d):
    """The mining parameters of a settings text, as rows."""
    found = readers.settings(json.dumps(SETTINGS))["apriori_parameters"]
    return spark.createDataFrame(sorted(found.items()), "name string, value long")


def r5_csv(spark, d):
    """Customers written as CSV and read back, one column by header and one by place."""
    path = _folder(spark)
    base.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(path, header=True)
    rows = readers.csv(spark, path, {"name": "c_name", "key": 0})
    return rows.select("name", readers.number_or("key").alias("key"))


def _workbook(path, sheets: dict[str, list[list]]) -> None:
    """The least that makes a workbook, at a path or in a file: sheets of numbers and texts, some of the texts shared, some cells left out."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    texts: dict[str, int] = {}

    def cell(i: int, j: int, value) -> str:
        at = f'r="{chr(65 + j)}{i + 1}"'
        if value is None:
            return ""
        if isinstance(value, str):
            return f'<c {at} t="inlineStr"><is><t>{escape(value)}</t></is></c>' if len(value) % 2 else f'<c {at} t="s"><v>{texts.setdefault(value, len(texts))}</v></c>'
        return f"<c {at}><v>{value}</v></c>"

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{i + 1}">{"".join(cell(i, j, v) for j, v in enumerate(row))}</row>' for i, row in enumerate(rows))
            out.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{escape(t)}</t></si>" for t in texts)}</sst>')
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(f"""<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>""" for k, n in enumerate(sheets, 1))}</sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>""" for k in range(1, len(sheets) + 1))}</Relationships>')


def r6_workbook(spark, d):
    """The nations and regions as two sheets of a workbook, and their union read back."""
    sheets = {}
    for name, table in (("Nations", "nation"), ("Regions & co", "region")):
        key, text = f"{table[0]}_{table}key", f"{table[0]}_name"
        rows = base.table(spark, d, table).select(key, text).orderBy(key).limit(100).collect()
        sheets[name] = [["no", "Name", "day"]] + [[r[0], r[1], 40_000.5 + r[0]] for r in rows]
    made = io.BytesIO()
    _workbook(made, sheets)
    context, path = spark.sparkContext, f"{_folder(spark)}/book.xlsx"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(made.getvalue()))
    out.close()
    rows = readers.workbook(spark, path, list(sheets), ["Name", "no", "day"])
    return rows.select(F.col("Name").alias("name"), readers.number_or("no").alias("no"), F.date_format(readers.serial_date("day"), "yyyy-MM-dd HH:mm").alias("day"))


def f12_first(spark, d):
    """For each brand, its first order at or after the middle of the axis, and the first after that place, as ranks."""
    half = base.length(spark, d) // 2
    own = base.occ(spark, d).groupBy("item").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return own.select("item", intervals.first_at_least(F.col("ts"), F.lit(half)).cast("long").alias("at_least"), intervals.first_above(F.col("ts"), F.lit(half)).cast("long").alias("above"))


def m5_as_baskets(spark, d):
    """Flat transactions as ones of a single basket."""
    flat = base.occ(spark, d).groupBy("t").agg(F.collect_list("item").alias("items"))
    return postings.occurrences(readers.as_baskets(flat))


def f4_flat_postings(spark, d):
    return postings.flat_postings(base.occ(spark, d).groupBy("t").agg(F.collect_list("item").alias("items")))


def r16_truth(spark, d):
    """Ground truth written as JSON and read back, with the names of its events."""
    found, _, events, _, _ = at._given(spark, d)
    rows = readers.truth_json(spark, _json_file(spark, reports._truth(found, events)))
    named = rows.join(F.broadcast(events.select("event_id", F.col("name").alias("event_name"))), "event_id").drop("event_id")
    return evaluation.with_ids(named, events).select(base.text(), "event_id", "interval_start", "interval_end")


def w4_json(spark, d):
    """Customers' balances written as JSON with rounded doubles, and read back."""
    path = _folder(spark)
    sinks.write_json(base.table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal").cast("double") / 7).alias("share")), path, digits=3)
    return spark.read.schema("c_custkey long, share double").json(path)


TINY, BETA = synthetic.tiny(), synthetic.beta(0.5)
#: A scenario of rare items with three events, for the layers of a figure.
FIGURE = synthetic.Scenario(
    n=5000, items=20, base=0.03, seed=3,
    planted=tuple(synthetic.Planted((1001 + 2 * k, 1002 + 2 * k), f"E{k + 1}", f"event_{k + 1}", 800 + 1200 * k, 1200 + 1200 * k, 0.5) for k in range(3)),
    decoys=(synthetic.Decoy("D1", "decoy_1", 1500, 1700), synthetic.Decoy("D2", "decoy_2", 4000, 4200)),
)


def y1_synthetic(spark, d):
    """Generated scenarios, mined: dense pairs of the tiny and of the beta scenario."""
    out = []
    for name, scenario, setting in (("tiny", TINY, (5, 2)), ("beta", BETA, (50, 12))):
        own = synthetic.occurrences(spark, scenario).select("t", F.col("t").alias("basket_id"), "item")
        out.append(itemsets.dense_itemsets(cut(own), *setting, max_length=2).where("size = 2").select(F.lit(name).alias("scenario"), base.text(), "s", "e"))
    return out[0].unionByName(out[1])


def y3_rescaled(spark, d):
    """The beta scenario at the length of the axis."""
    own = synthetic.rescaled(synthetic.beta(), base.length(spark, d))
    rows = [(kind, x.start, x.end) for kind, xs in (("planted", own.planted), ("unrelated", own.unrelated), ("decoy", own.decoys)) for x in xs]
    return spark.createDataFrame(rows, "kind string, start long, end long")


def _parts(spark, made: dict[str, synthetic.Scenario]):
    rows = [(name, kind, ",".join(map(str, getattr(x, "pattern", ()))), x.start, x.end, float(getattr(x, "boost", 0))) for name, own in made.items() for kind, xs in (("planted", own.planted), ("unrelated", own.unrelated), ("decoy", own.decoys)) for x in xs]
    return spark.createDataFrame(rows, "scenario string, kind string, pattern string, start long, end long, boost double")


def y5_scenarios(spark, d):
    """What the scenarios at 5,000 transactions plant."""
    return _parts(spark, {f.__name__: f(0.4) for f in (synthetic.beta, synthetic.overlapping, synthetic.confounded, synthetic.crowded, synthetic.short, synthetic.zipf)})


def y6_scenarios(spark, d):
    """What the longer scenarios plant, at 10,000 transactions."""
    return _parts(spark, {"null": synthetic.null(n=10_000), "two_intervals": synthetic.two_intervals(n=10_000), "two_boosts": synthetic.two_boosts(n=10_000), "by_length": synthetic.by_length(3, n=10_000), "tiny": TINY})


def y7_injection(spark, d):
    """Planted brands in real orders: how many transactions each brand is in, inside the event and outside."""
    own = base.occ(spark, d)
    n = base.length(spark, d)
    event = synthetic.Planted((3, 11), "E1", "event_1", n // 4, n // 2, 2.0)
    made = synthetic.injected(own, [event])
    return made.groupBy("item", F.col("t").between(event.start, event.end).alias("inside")).agg(F.count("*").alias("n"))


SMALL = pipeline.Config(window=40, theta=12, permutations=200, alpha=0.2, sigma=8.0, deduplicate=True)


def _small(seed: int, length: int = 2, boost: float = 0.8) -> synthetic.Scenario:
    pattern = tuple(range(3, 3 + length))
    return synthetic.Scenario(n=800, items=8, base=0.05, planted=(synthetic.Planted(pattern, "E1", "sale", 300, 420, boost),), unrelated=(synthetic.Unrelated((1, 2), 600, 700, 0.5),), decoys=(synthetic.Decoy("D1", "decoy", 60, 110),), seed=seed)


def _summed(rows):
    return at._rounded(evaluation.means(cut(rows), "condition", "method", values=("precision", "recall", "f1", "far")), "precision", "recall", "f1", "far")


def x3_conditions(spark, d):
    """Two conditions, strong and weak effects: this method and a baseline. Tested by what is planted."""
    return _summed(experiments.run(spark, {"strong": [_small(0)], "weak": [_small(0, boost=0.3)]}, SMALL, ("proposed", "coincidence"), max_length=2))


def x4_null(spark, d):
    """False discoveries without effects. Tested by what is planted."""
    own = [synthetic.Scenario(n=600, items=6, base=0.05, unrelated=(synthetic.Unrelated((1, 2), 300, 360, 0.6),), decoys=(synthetic.Decoy("D1", "decoy", 20, 40),), seed=k) for k in (0, 1)]
    return at._rounded(evaluation.null_discoveries(experiments.null_run(spark, own, SMALL)), "fdr")


def x5_lengths(spark, d):
    """Planted patterns of two and three items. Tested by what is planted."""
    return _summed(experiments.run(spark, {f"length {k}": [_small(0, length=k)] for k in (2, 3)}, SMALL, max_length=3))


def x9_semi_synthetic(spark, d):
    """Signals planted in the orders: all of them, and their recall. Tested by what is planted."""
    own, n = base.occ(spark, d), base.length(spark, d)
    planted = [synthetic.Planted((3, 11), "E1", "event_1", n // 4, n // 4 + n // 10, 3.0), synthetic.Planted((5, 17), "E2", "event_2", n // 2, n // 2 + n // 10, 3.0)]
    config = pipeline.Config(window=base.TEST[0], theta=base.TEST[1] * 4, permutations=at.SHIFTS, alpha=at.ALPHA, sigma=at.SIGMA / 10, deduplicate=True)
    return at._rounded(experiments.semi_synthetic(own, planted, [synthetic.Decoy("D1", "decoy", n // 8, n // 7)], n, config), "precision", "recall", "f1")


def x11_figure(spark, d):
    return at._rounded(experiments.figure_series(spark, FIGURE, (1001, 1002), 50, 3), "value")


QUERIES = [r1_basket_file, r2_flat_file, r3_events, r4_settings, r5_csv, r6_workbook, r16_truth, w4_json, f4_flat_postings, f12_first, m5_as_baskets, y1_synthetic, y3_rescaled, y5_scenarios, y6_scenarios, y7_injection, x3_conditions, x4_null, x5_lengths, x9_semi_synthetic, x11_figure]

# --- SQL -------------------------------------------------------------------


def _uniform(seed: int, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join((str(seed), *parts))})), 1, 13))::bigint * {2.0**-52!r})"


def sql_scenario(x: synthetic.Scenario, name: str) -> str:
    """The occurrences of a scenario with a base chance as the CTE ``name`` (t, item)."""
    parts = [f"select t, item from range({x.n}) a(t), range(1, {x.items + 1}) b(item) where {_uniform(x.seed, repr('base'), 't', 'item')} < {x.base}"]
    listed = lambda p: f"unnest([{', '.join(map(str, p))}]) as item"
    for k, p in enumerate(x.planted):
        parts.append(f"select t, {listed(p.pattern)} from range({x.n}) a(t) where t between {p.start} and {p.end} and {_uniform(x.seed, repr(f'planted{k}'), 't')} < {min(1.0, p.boost)}")
        rare = [i for i in p.pattern if i > x.items]
        if rare:
            parts.append(f"select t, item from (select t, {listed(rare)} from range({x.n}) a(t) where t not between {p.start} and {p.end}) where {_uniform(x.seed, repr(f'rare{k}'), 't', 'item')} < {x.base}")
    for k, p in enumerate(x.unrelated):
        parts.append(f"select t, {listed(p.pattern)} from range({x.n}) a(t) where t between {p.start} and {p.end} and {_uniform(x.seed, repr(f'unrelated{k}'), 't')} < {min(1.0, p.boost)}")
    return f"\n{name} as (select distinct t::bigint as t, item::bigint as item from ({' union all '.join(parts)}))"


def _mined(x: synthetic.Scenario, name: str, window: int, theta: int) -> str:
    return f"""{sql_scenario(x, name)},
{name}1 as (select [item] as pattern, t from {name}),{sql_dense(f'{name}1', f'{name}d', window, theta)},
{name}a as (select distinct [a.pattern[1], b.pattern[1]] as pattern, greatest(a.s, b.s) as s, least(a.e, b.e) as e from {name}d a join {name}d b on a.pattern[1] < b.pattern[1] and a.s <= b.e and b.s <= a.e where least(a.e, b.e) - greatest(a.s, b.s) >= {window}),
{name}2 as (select [a.item, b.item] as pattern, a.t from {name} a join {name} b on a.t = b.t and a.item < b.item),{sql_dense(f'{name}2', f'{name}u', window, theta)},
{name}r as (select distinct u.pattern, greatest(u.s, a.s) as s, least(u.e, a.e) as e from {name}u u join {name}a a on u.pattern = a.pattern and u.s <= a.e and a.s <= u.e)"""


_FIVE = """five(k, p) as (values (0, '5,15'), (1, '25,35'), (2, '45,55'), (3, '201,202,203'), (4, '205,206,207,208')),
b5 as (select 'planted' as kind, p as pattern, 400 + 800 * k as start, 699 + 800 * k as "end", 0.4 as boost from five),
u5 as (select 'unrelated' as kind, '65,75' as pattern, 800 as start, 1099 as "end", 0.4 as boost union all select 'unrelated', '85,95', 4300, 4599, 0.4),
d5 as (select 'decoy' as kind, '' as pattern, 1650 as start, 1849 as "end", 0.0 as boost union all select 'decoy', '', 4700, 4899, 0.0)"""

SQL = {
    "r1_basket_file": f"with{SQL_BASE}, g as (select t, count(*)::int as n_baskets, string_agg(x, ' ' order by basket_id) as items from (select t, basket_id, string_agg(item::varchar, ' ' order by item) as x from occb group by t, basket_id) group by t) select tx.t, coalesce(n_baskets, 0)::int as n_baskets, coalesce(items, '') as items from tx left join g using (t)",
    "r2_flat_file": f"with{SQL_BASE}, g as (select t, string_agg(item::varchar, ' ' order by item) as items from occ group by t) select tx.t, coalesce(items, '') as items from tx left join g using (t)",
    "r3_events": f'with{SQL_BASE} select event_id, name, start, "end" from ev',
    "r4_settings": "select * from (values ('window_size', 100::bigint), ('min_support', 8), ('max_length', 3)) as t(name, value)",
    "r5_csv": "select c_name as name, c_custkey::bigint as key from customer",
    "r6_workbook": "select name, k as no, strftime(timestamp '1899-12-30' + interval 1 day * (40000 + k) + interval 12 hour, '%Y-%m-%d %H:%M') as day from (select n_name as name, n_nationkey::bigint as k from nation union all select r_name, r_regionkey::bigint from region)",
    "r16_truth": reports.SQL["y2_ground_truth"],
    "w4_json": "select c_custkey::bigint as c_custkey, round(c_acctbal::double / 7, 3) as share from customer",
    "f4_flat_postings": f"with{SQL_BASE} select item, t from occ",
    "f12_first": f"with{SQL_BASE} select item, count(*) filter (t < n // 2) as at_least, count(*) filter (t <= n // 2) as above from occ, n group by item",
    "m5_as_baskets": f"with{SQL_BASE} select t, dense_rank() over (order by t) - 1 as basket_id, item from occ",
    "y1_synthetic": f"with{_mined(TINY, 'ti', 5, 2)},{_mined(BETA, 'be', 50, 12)} select 'tiny' as scenario, {NAME}, s, e from tir union all select 'beta', {NAME.split(' as ')[0]}, s, e from ber",
    "y3_rescaled": f"with n as (select count(*)::bigint as n from orders), {_FIVE} select kind, floor(start * n / 5000.0 + 0.5)::bigint as start, floor(\"end\" * n / 5000.0 + 0.5)::bigint as \"end\" from (select * from b5 union all select * from u5 union all select * from d5), n",
    "y5_scenarios": f"""with {_FIVE},
o5 as (select * from (values ('planted', '5,15', 800, 1400, 0.4), ('planted', '25,35', 1100, 1700, 0.4), ('planted', '45,55', 3000, 3600, 0.4)) as t(kind, pattern, start, "end", boost)),
c5 as (select 'planted' as kind, p as pattern, 300 + 750 * k as start, 599 + 750 * k as "end", 0.4 as boost from (select * from five union all select 5, '105,115')),
t5 as (select kind, pattern, start, start + 79 as "end", boost from b5),
x5 as (select kind, case start when 400 then '65,75' else '85,95' end as pattern, start, "end", boost from (select 'unrelated' as kind, start, "end", boost from b5 where start < 2000)),
s5 as (select 'beta' as scenario, * from b5 union all select 'beta', * from u5 union all select 'beta', * from d5
 union all select 'overlapping', * from o5 union all select 'overlapping', * from u5 union all select 'overlapping', * from d5
 union all select 'confounded', * from b5 union all select 'confounded', * from x5 union all select 'confounded', * from d5
 union all select 'crowded', * from c5 union all select 'crowded', * from u5 union all select 'crowded', * from d5
 union all select 'short', * from t5 union all select 'short', * from u5 union all select 'short', * from d5
 union all select 'zipf', * from b5 union all select 'zipf', * from u5 union all select 'zipf', * from d5)
select scenario, kind, pattern, start::bigint as start, "end"::bigint as "end", boost::double as boost from s5""",
    "y6_scenarios": """with k4(k) as (values (0), (1), (2), (3)), k5 as (select * from k4 union all select 4),
s as (select 'null' as scenario, 'unrelated' as kind, (5 + 20 * k) || ',' || (15 + 20 * k) as pattern, 2 * (500 + 1000 * k) as start, 2 * (799 + 1000 * k) as "end", 0.3 as boost from k4
 union all select 'null', 'decoy', '', 2 * (50 + 950 * k), 2 * (150 + 950 * k), 0 from k5
 union all select * from (values ('two_intervals', 'planted', '5,15', 2000, 2598, 0.3), ('two_intervals', 'unrelated', '5,15', 7000, 7598, 0.3), ('two_intervals', 'decoy', '', 4800, 5198, 0),
  ('two_boosts', 'planted', '5,15', 2000, 2598, 0.5), ('two_boosts', 'planted', '5,15', 7000, 7598, 0.1), ('tiny', 'planted', '1,2', 10, 25, 0.9))
 union all select 'by_length', 'planted', (201 + 10 * k) || ',' || (202 + 10 * k) || ',' || (203 + 10 * k), 2 * (700 + 1500 * k), 2 * (999 + 1500 * k), 0.3 from k4 where k < 3)
select scenario, kind, pattern, start::bigint as start, "end"::bigint as "end", boost::double as boost from s""",
    "y7_injection": f"""with{SQL_BASE}, tt as (select distinct t from occ),
i as (select t, unnest([3, 11])::bigint as item from tt, n where t between n // 4 and n // 2),
m as (select t, item from occ union select t, item from i where {_uniform(0, "'inject0'", 't', 'item')} < {2.0 * 0.3})
select item, t between n // 4 and n // 2 as inside, count(*) as n from m, n group by all""",
    "x11_figure": f"""with{sql_scenario(FIGURE, 'oc')},
tm as (select 1 as pattern, t from oc where item in (1001, 1002) group by t having count(*) = 2),{sql_dense('tm', 'dn', 50, 3)},
sr as (select g.t, (sum(case when tm.t is null then 0 else 1 end) over (order by g.t rows between current row and 49 following))::bigint as support from range(5000) g(t) left join tm on tm.t = g.t),
x as (select t, support >= 3 as now, coalesce(lag(support >= 3) over (order by t), false) as was, coalesce(avg(support) over (order by t rows between 20 preceding and 1 preceding), 0) as before, coalesce(avg(support) over (order by t rows between current row and 19 following), 0) as after from sr where t <= 4950)
select 'support' as layer, t, null::bigint as "end", support::double as value, '' as label from sr where t <= 4950 union all select 'dense', s, e, 3.0, '' from dn
union all select 'change', t, null, round(greatest(1.0, case when now then after - before else before - after end), 6), case when now then 'up' else 'down' end from x where now <> was
union all select 'event', * from (values (800, 1200, 0.0, 'event_1'), (2000, 2400, 0.0, 'event_2'), (3200, 3600, 0.0, 'event_3'), (1500, 1700, 0.0, 'decoy_1'), (4000, 4200, 0.0, 'decoy_2'))""",
}
