"""The registered queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.durable import shared_folder
from tideline.llm import binary, decontaminate, licences, lines, mixing, quality, secrets, simhash, suffixes, tokens

WORD = r"[^\x20\x09-\x0D]+"


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, in order of first training position."""
    rows = mixing.mix(_table(spark, sf_dir, "documents"))
    return rows.withColumn("position", F.round(F.get("placements", F.lit(0))["position"], 9)).drop("placements").orderBy("position", "doc_id")


OP1_SQL = f"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end as k,
    coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '') || '|1|' || md5(coalesce(text, ''))) as digest
  from documents
), s as (select k, sum(size)::bigint as source_size from d group by k),
r as (select *, (row_number() over (order by k) - 1) % 3 as kind from s),
w as (select *, case kind when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 2.0::double as lim from r),
q as (select *, lim / weight as ratio from w),
l as (select *, (sum(source_size) over () * 1.5::double
    - (sum(lim) over (order by ratio, k rows unbounded preceding) - lim))
    / (sum(weight) over () - sum(weight) over (order by ratio, k rows unbounded preceding) + weight) as level from q),
t as (select k, source_size, kind, coalesce(least(weight * max(case when level <= ratio then level end) over (), lim), lim) as target from l),
p as (select d.doc_id, d.size, t.source_size, t.target, t.kind, round(t.target)::bigint as demand,
    (sum(d.size) over (partition by d.k order by d.digest, d.size rows unbounded preceding) - d.size)::bigint as b
  from d join t using (k)),
c as (select *, least(greatest(demand - b, 0), size) as w0, least(greatest(demand - b - source_size, 0), size) as w1 from p)
select doc_id, size, source_size, target, (w0 + w1)::bigint as taken,
  case when w0 > 0 then round(least(greatest(case kind
    when 0 then 2.0::double * (b / target) / (1.5::double + sqrt(2.25::double - 2.0::double * (b / target)))
    when 1 then b / target
    else case when b / target >= 0.375::double then 0.5::double + 2.0::double * (b / target - 0.375::double) / (1.0::double + sqrt(1.0::double + 2.0::double * (b / target - 0.375::double)))
      else 2.0::double * (b / target) / (0.5::double + sqrt(0.25::double + 2.0::double * (b / target))) end
  end, 0.0::double), 1.0::double), 9) end as position
from c
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each document that other documents repeat."""
    return suffixes.repeats(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document under the 32k piece model."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents share."""
    return lines.drop_repeated_lines(_table(spark, sf_dir, "documents")).drop("kept_text")


OP4_SQL = """
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
bad as (select key from k where key <> '' group by key having count(distinct r) >= 10)
select doc_id, count(*)::bigint as n_lines, count(*) filter (key in (select key from bad))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (key not in (select key from bad)), '')) as kept_sha256
from k group by r, doc_id
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.components(_table(spark, sf_dir, "documents"))


def op6_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All token sequences of all documents in training order, written to shards in the shared folder."""
    return binary.training_shards(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), uri=f"{shared_folder(spark)}/shards-{uuid4()}")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or that of the nearest directory above it.

    The table has no paths. A document's is its source's directory, or that of its
    language or a part of it below, by its number; one whose first line speaks of
    a licence is the licence file there.
    """
    name = F.when(F.rlike(F.substring_index("text", "\n", 1), F.lit("(?i)licen[cs]e")), F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.lit(""), "source", F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("part-"), (F.col("doc_id") % 4).cast("string"))), name)
    return licences.scan(_table(spark, sf_dir, "documents"), path=path)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and whether the rules keep it."""
    return quality.judge(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document leaks."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets in every document."""
    rows = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written(F.col("base_spans")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def _op10_sql() -> str:
    """Each rule's matches and the pieces between them, whose lengths add up to places."""
    quoted = lambda p: p.replace("'", "''")
    parts = []
    for rank, rule in enumerate((*secrets.BASE, *secrets.MORE)):
        p = quoted(rule.pattern)
        parts.append(f"""select r, doc_id, {rank} as rank, '{rule.kind}' as kind, unnest(f) as f, unnest(g) as g, unnest(p[1:len(f)]) as p, generate_subscripts(f, 1) as i
  from (select r, doc_id, regexp_extract_all(t, '{p}', 0) as f, regexp_extract_all(t, '{p}', {rule.group}) as g, regexp_split_to_array(t, '{p}') as p from d where regexp_matches(t, '{p}'))""")
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
h as ({" union all ".join(parts)}),
e as (select r, rank, kind, length(f) as n, sum(length(p) + length(f)) over (partition by r, rank order by i rows unbounded preceding) as e,
    length(g) >= case kind {" ".join(f"when '{x.kind}' then {x.least}" for x in (*secrets.BASE, *secrets.MORE))} end as ok from h),
s as (select r, rank, kind, e - n as b, kind || ':' || (e - n)::bigint::varchar || ':' || e::bigint::varchar as span from e where ok),
a as (select r, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
    string_agg(span, ',' order by b, rank) filter (rank < 3) as base, string_agg(span, ',' order by b, rank) as spans from s group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (r)
"""


def _op7_sql() -> str:
    """Sentences, their vectors and cosines, and the nearest directory with a licence file."""
    quoted = lambda p: p.replace("'", "''")
    known = ", ".join(f"('{t}', '{name}', '{name}#{k}', {float(ts.count(t))})" for name, texts in licences.TEMPLATES.items() for k, text in enumerate(texts) for ts in [licences._terms(text)] for t in dict.fromkeys(ts))
    word, stop = quoted(licences.trigger(licences.TEMPLATES)), f"'{licences.STOP}', '\\1' || chr(10), 'g'"
    last = ", ".join(f"'{x}'" for x in licences.LAST)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t,
    concat_ws('/', '', source, case when doc_id % 3 > 0 then lang end, case when doc_id % 3 = 2 then 'part-' || (doc_id % 4) end,
      case when regexp_matches(split_part(coalesce(text, ''), chr(10), 1), '(?i)licen[cs]e') then 'LICENSE' else doc_id || '.txt' end) as path from documents),
sa as (select r, path, t, list_transform(list_filter(string_split(regexp_replace(t, {stop}), chr(10)), lambda x: regexp_matches(x, '{word}')), lambda x: regexp_replace(x, '^[\\x20\\x09#*;%/-]+|[\\x20\\x09-\\x0D]+$', '', 'g')) as a,
    regexp_replace(regexp_replace(chr(10) || t, '{licences.MARKS}', chr(10), 'g'), '\\n\\n+', chr(1), 'g') as p from d),
sb as (select r, path, t, a, list_transform(list_filter(string_split(replace(regexp_replace(replace(p, chr(10), ' '), {stop}), chr(1), chr(10)), chr(10)), lambda x: regexp_matches(x, '{word}')), lambda x: trim(x)) as b from sa),
s as (select r, list_concat(list_concat(a, list_distinct(list_filter(b, lambda x: not list_contains(a, x)))), case when regexp_matches(path, '{licences.FILE}') then [t] else [] end) as s from sb),
u as (select r, unnest(s) as said, generate_subscripts(s, 1) as u from s),
w as (select r, u, term, count(*)::double as tf from (select r, u, unnest(regexp_extract_all(lower(said), '[a-z0-9]+')) as term from u) group by all),
n as (select count(*)::double as n from (select distinct r, u from w)),
k as (select term, licence, template, tf::double as tf from (values {known}) as v(term, licence, template, tf)),
f as (select term, count(w.term) as df from (select distinct term from k) left join w using (term) group by term),
i as (select term, ln((n + 1) / (df + 1)) + 1 as idf from f, n),
kw as (select term, licence, template, tf * idf as x from k join i using (term)),
kn as (select template, sqrt(sum(x * x)) as l from kw group by template),
ww as (select r, u, term, tf * coalesce(idf, ln((n + 1) / 2) + 1) as x from w left join i using (term), n),
wn as (select r, u, sqrt(sum(x * x)) as l from ww group by r, u),
c as (select r, u, licence, licence in ({last}) as z, template, round(sum(ww.x * kw.x) / any_value(wn.l) / any_value(kn.l), 6) as cosine from ww join kw using (term) join wn using (r, u) join kn using (template) group by r, u, licence, template),
b as (select r, u, licence, z, cosine, row_number() over (partition by r, u order by z, cosine desc, licence) as p from c where cosine >= {licences.SIMILAR}),
o as (select r, count(distinct u) as n_statements, first(licence order by z, cosine desc, licence) as licence, first(cosine order by z, cosine desc, licence) as similarity, first(z order by z, cosine desc, licence) as z from b where p = 1 group by r),
g as (select r, doc_id, path, licence, similarity, z, coalesce(n_statements, 0)::bigint as n_statements, regexp_replace(regexp_replace(path, '^/+', ''), '/?[^/]*$', '') as folder from d left join o using (r)),
h as (select folder as dir, first(licence order by z, similarity desc, licence) as given from g where licence is not null and regexp_matches(path, '{licences.FILE}') group by folder),
q as (select distinct folder, list_filter(string_split(folder, '/'), lambda x: x <> '') as ps from g where licence is null),
a as (select folder, unnest(list_transform(range(0, len(ps) + 1), lambda i: struct_pack(i := i, dir := array_to_string(ps[1:i], '/')))) as x from q),
m as (select folder, arg_max(h.dir, x.i) as dir, arg_max(given, x.i) as given from a join h on h.dir = x.dir group by folder)
select doc_id, path, licence, similarity, n_statements, case when licence is null then m.dir end as inherited_from, coalesce(licence, given) as effective from g left join m using (folder)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_mixing, op2_suffix_dedup, op3_token_counts, op4_line_dedup, op5_simhash, op6_binary_output, op7_licences, op8_quality_rules, op9_decontamination, op10_secrets)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op4_line_dedup": OP4_SQL, "op7_licences": _op7_sql(), "op10_secrets": _op10_sql()}
