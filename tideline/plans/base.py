"""Transactions, patterns and events made from the star-schema tables, with the SQL for the same.

A transaction is an order, by date and key; its items are the brands of its
lines. In the variant of several baskets, a basket is the lines of an order with
one return flag. External events are five stretches of the axis.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.durable import cut, store
from tideline.operators.itemsets import dense_itemsets
from tideline.operators.postings import dictionary, ordered_index, small

T = TypeVar("T")
#: Window and least support for mining, and for tests of events.
MINE, TEST = (100, 8), (500, 24)


_HELD: dict[tuple, object] = {}


def held(spark: SparkSession, sf_dir: str, name: object, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once for a session and the present state of the tables: queries of one session share it."""
    context = spark.sparkContext
    stamp = []
    for file in ("orders", "lineitem", "part"):
        path = context._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{file}.parquet")
        stamp.append(path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime())
    key = (context.applicationId, sf_dir, name, *stamp)
    if key not in _HELD:
        for old in [k for k in _HELD if k[0] != context.applicationId or (k[1:3] == key[1:3])]:
            del _HELD[old]
        _HELD[key] = make()
    return _HELD[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(pattern: Column | str = "pattern") -> Column:
    """A pattern as text, for results."""
    return F.array_join(F.transform(pattern, lambda x: x.cast("string")), ",").alias("pattern")


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_index(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey")


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(table(spark, sf_dir, "part"), "p_brand")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(t, l_returnflag, item)``: the dictionary joins the parts, the parts the lines, the lines the axis."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(small(cut(brands(spark, sf_dir))), "p_brand").select(F.col("p_partkey").alias("l_partkey"), "item")
    bought = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(parts, "l_partkey")
    return bought.join(axis(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), "t"), "l_orderkey").select("t", "l_returnflag", "item")


def occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(t, basket_id, item)``, one basket per order."""
    return held(spark, sf_dir, "occ", lambda: store(lines(spark, sf_dir).select("t", F.col("t").alias("basket_id"), "item").distinct()))


def occ_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a basket for each return flag of an order; the number of a basket is 3 t + the flag's place."""
    place = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return held(spark, sf_dir, "occ_baskets", lambda: store(lines(spark, sf_dir).select("t", (3 * F.col("t") + place).alias("basket_id"), "item").distinct()))


def length(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "orders").count()


def events(spark: SparkSession, n: int) -> DataFrame:
    rows = [(f"C{k}", f"Type{'A' if k % 2 else 'B'}_{k}", n * k // 10, n * k // 10 + n // 20) for k in (1, 3, 5, 7, 8)]
    return spark.sql("select * from values " + ", ".join(f"('{i}', '{x}', {a}L, {b}L)" for i, x, a, b in rows) + " as t(event_id, name, start, end)")


def pairs(spark: SparkSession, sf_dir: str, setting: tuple[int, int] = TEST) -> tuple[DataFrame, DataFrame]:
    """Dense pairs and the occurrences."""
    own = occ(spark, sf_dir)
    return held(spark, sf_dir, ("pairs", setting), lambda: cut(dense_itemsets(own, *setting, max_length=2).where("size = 2").select("pattern", "s", "e"))), own


SQL_BASE = """
tx as (select o_orderkey, o_orderdate, (row_number() over (order by o_orderdate, o_orderkey) - 1)::bigint as t from orders),
item as (select p_brand, (dense_rank() over (order by p_brand) - 1)::bigint as item from part group by p_brand),
ln as (select t, l_returnflag, item from tx join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey join item using (p_brand)),
occ as (select distinct t, t as basket_id, item from ln),
occb as (select distinct t, 3 * t + case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as basket_id, item from ln),
n as (select count(*)::bigint as n from orders),
ev as (select 'C' || k as event_id, 'Type' || case when k % 2 = 1 then 'A' else 'B' end || '_' || k as name, n * k // 10 as start, n * k // 10 + n // 20 as "end" from n, (values (1), (3), (5), (7), (8)) as v(k))"""


def sql_dense(source: str, name: str, window: int, theta: int, key: str = "pattern") -> str:
    """Dense intervals of ``source`` (key, t) as CTEs that end in ``name``."""
    return f"""
{name}_ld as (select {key}, t, lead(t, {theta - 1}) over (partition by {key} order by t) as t2 from {source}),
{name}_sg as (select {key}, t2 - {window} as s, t as e from {name}_ld where t2 - t <= {window}),
{name}_mx as (select *, max(e) over (partition by {key} order by s, e rows between unbounded preceding and 1 preceding) as pe from {name}_sg),
{name}_gr as (select *, sum(case when pe is null or s > pe + 1 then 1 else 0 end) over (partition by {key} order by s, e rows unbounded preceding) as grp from {name}_mx),
{name} as (select {key}, min(s)::bigint as s, max(e)::bigint as e from {name}_gr group by {key}, grp)"""


def sql_pairs(window: int, theta: int, occ: str = "occ") -> str:
    """Dense singles ``d1`` and pairs ``d2``, within the common ranges of their items."""
    return SQL_BASE + f""",
t1 as (select distinct [item] as pattern, t from {occ}),{sql_dense("t1", "d1", window, theta)},
r2 as (select [a.pattern[1], b.pattern[1]] as pattern, greatest(a.s, b.s) as s, least(a.e, b.e) as e from d1 a join d1 b on a.pattern[1] < b.pattern[1] and a.s <= b.e and b.s <= a.e),
a2 as (select distinct * from r2 where e - s >= {window}),
o2 as (select a.basket_id, a.t, [a.item, b.item] as pattern from {occ} a join {occ} b on a.basket_id = b.basket_id and a.item < b.item where [a.item, b.item] in (select pattern from a2)),{sql_dense("o2", "u2", window, theta)},
d2 as (select distinct u2.pattern, greatest(u2.s, a2.s) as s, least(u2.e, a2.e) as e from u2 join a2 on u2.pattern = a2.pattern and u2.s <= a2.e and a2.s <= u2.e)"""


def sql_triples(window: int, theta: int) -> str:
    """And triples ``d3``, whose three pairs are all dense."""
    return sql_pairs(window, theta) + f""",
l2 as (select distinct pattern from d2),
c3 as (select [a.pattern[1], a.pattern[2], b.pattern[2]] as pattern from l2 a join l2 b on a.pattern[1] = b.pattern[1] and a.pattern[2] < b.pattern[2] where [a.pattern[2], b.pattern[2]] in (select pattern from l2)),
a3 as (select distinct c3.pattern, greatest(r2.s, d1.s) as s, least(r2.e, d1.e) as e from c3 join r2 on r2.pattern = c3.pattern[1:2] join d1 on d1.pattern[1] = c3.pattern[3] and d1.s <= r2.e and r2.s <= d1.e where least(r2.e, d1.e) - greatest(r2.s, d1.s) >= {window}),
o3 as (select o2.t, list_append(o2.pattern, b.item) as pattern from o2 join occ b on o2.basket_id = b.basket_id and o2.pattern[2] < b.item where list_append(o2.pattern, b.item) in (select pattern from a3)),{sql_dense("o3", "u3", window, theta)},
d3 as (select distinct u3.pattern, greatest(u3.s, a3.s) as s, least(u3.e, a3.e) as e from u3 join a3 on u3.pattern = a3.pattern and u3.s <= a3.e and a3.s <= u3.e)"""


def sql_times(patterns: str = "d2") -> str:
    """``tm``: transactions that have both items of each pair, and ``sr``: the support series, for the test setting."""
    window = TEST[0]
    return f""",
pt as (select distinct pattern from {patterns}),
tm as (select pattern, a.t from pt join (select distinct t, item from occ) a on a.item = pattern[1] join (select distinct t, item from occ) b on b.item = pattern[2] and b.t = a.t),
gd as (select pattern, unnest(generate_series(0, n - 1)) as t from pt, n),
sr as (select pattern, t, support from (select gd.pattern, gd.t, (sum(case when tm.t is null then 0 else 1 end) over (partition by gd.pattern order by gd.t rows between current row and {window - 1} following))::bigint as support from gd left join tm on tm.pattern = gd.pattern and tm.t = gd.t), n where t <= n - {window})"""


NAME = "array_to_string(pattern, ',') as pattern"
