"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that any match
must contain. Postings list the documents of each trigram that a query names;
intersecting them gives candidate documents, and the regex is run on those
alone. A rule without mandatory trigrams scans every document. Built from
DataFrame operations only.

Trigrams are those of the lower-cased text, so a query may let too many
documents through, but never too few.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.durable import cut
from tideline.llm.text import let, row_key, whole


@dataclass(frozen=True)
class Rule:
    """A pattern that Java, RE2 and Python read alike; ``least`` characters in ``group``, or the match is dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The patterns of the base kinds, and prefixes and lengths that services publish for their keys.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{50,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]+@"),
)

#: Greatest number of literal strings that an expression may stand for before it is cut into parts.
MOST_STRINGS = 64

Query = list[list[frozenset[str]]]  # and of or of trigrams that must all be there


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _absorbed(options: set[frozenset[str]]) -> list[frozenset[str]]:
    """Without options that ask for more than another one does."""
    return sorted((x for x in options if not any(y < x for y in options)), key=sorted)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regex; empty if it has no mandatory trigram."""
    strings, clauses = _read(list(re._parser.parse(pattern)))
    return clauses + _clause(strings)


def _clause(strings: set[str] | None) -> Query:
    if not strings or any(len(x) < 3 for x in strings):
        return []
    return [_absorbed({_grams(x) for x in strings})]


def _read(items: list) -> tuple[set[str] | None, Query]:
    """The strings a sequence can be, if they are few, and else the clauses that hold for it."""
    held: set[str] = {""}
    clauses: Query = []
    loose = False
    for item in items:
        strings, own = _one(item)
        if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
            held = {a + b for a, b in product(held, strings)}
            clauses += own
            continue
        loose = True
        clauses += _clause(held) + own
        held = strings if strings is not None else {""}
    if loose:
        return None, clauses + _clause(held)
    return held, clauses


def _one(item: tuple) -> tuple[set[str] | None, Query]:
    name, value = str(item[0]), item[1]
    if name == "LITERAL":
        return {chr(value).lower()}, []
    if name == "IN":
        if all(str(k) == "LITERAL" for k, _ in value) and len(value) <= 8:
            return {chr(v).lower() for _, v in value}, []
        return None, []
    if name == "SUBPATTERN":
        return _read(list(value[3]))
    if name == "BRANCH":
        parts = [_read(list(x)) for x in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), []
        wholes = [own + _clause(s) for s, own in parts]
        if all(wholes):  # of each branch, its first clause: any branch's option may hold
            return None, [_absorbed({x for w in wholes for x in w[0]})]
        return None, []
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, body = value
        strings, own = _read(list(body))
        if strings is not None and int(high) <= 4 and len(strings) ** max(int(high), 1) <= MOST_STRINGS:
            out: set[str] = set()
            for n in range(int(low), int(high) + 1):
                out |= {"".join(x) for x in product(strings, repeat=n)}
            return out, []
        return None, (own + _clause(strings)) if low else []
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}, []
    return None, []


def postings(docs: DataFrame, grams: list[str], text: str = "text") -> DataFrame:
    """The inverted index: ``gram, k1, k2`` for each of ``grams`` and each document that has it."""
    found = let(F.lower(F.col("text")), lambda t: F.array_compact(F.array(*(F.when(F.contains(t, F.lit(g)), F.lit(g)) for g in grams))))
    return docs.select("k1", "k2", F.explode(found).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``k1, k2, kinds``: the documents whose postings meet each rule's query, and for which rules.

    Postings of a document meet in one group; whether an option holds is a
    count of distinct trigrams, added up before the shuffle.
    """
    options = sorted({o for q in queries.values() for clause in q for o in clause}, key=sorted)
    names = {o: f"o{i}" for i, o in enumerate(options)}
    met = index.distinct().groupBy("k1", "k2").agg(*((F.sum(F.when(F.col("gram").isin(*o), 1).otherwise(0)) == len(o)).alias(n) for o, n in names.items()))

    def holds(query: Query) -> Column:
        out = F.lit(True)
        for clause in query:
            some = F.lit(False)
            for o in clause:
                some = some | F.col(names[o])
            out = out & some
        return out

    kinds = F.array_compact(F.array(*(F.when(holds(q), F.lit(kind)) for kind, q in queries.items())))
    return met.select("k1", "k2", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _hits(text: Column, rule: Rule) -> Column:
    """An array of a struct per match: kind, code points before it since the last match, its own, and whether it is long enough."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    pieces = F.split(text, rule.pattern, -1)
    made = F.transform(F.arrays_zip(found.alias("f"), sized.alias("g"), F.slice(pieces, F.lit(1), F.size(found)).alias("p")), lambda x: F.struct(F.lit(rule.kind).alias("kind"), F.length(x["p"]).alias("gap"), F.length(x["f"]).alias("n"), (F.length(x["g"]) >= rule.least).alias("ok")))
    return F.when(F.rlike(text, F.lit(rule.pattern)), made)


def find_secrets(docs: DataFrame, *, text: str = "text", ident: str = "doc_id", base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, send: int = 200_000) -> DataFrame:
    """``doc_id, n_<kind>`` of each base kind, ``base_spans`` and ``spans`` for each document.

    Spans are arrays of structs (start, rank, kind, end) in code points, end
    exclusive, by start and then rank, the place of the kind in the list of
    rules. Base spans are among ``spans``. Candidates are looked up by a
    broadcast if there are at most ``send`` of them (16 bytes each, counted),
    else by a shuffle join.

    Null and empty text: no spans. Null ``doc_id`` stays null. Repeated rows
    each give a row. Empty table: no rows. Extra columns are ignored. Java's
    regex engine reads whole texts; no pattern backtracks beyond a match.
    """
    rules = (*base, *more)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    keyed = docs.select(F.col(ident).alias("doc_id"), whole(text).alias("text"))
    keyed = keyed.select("*", *row_key(keyed, "doc_id", "text"))
    indexed = {k: q for k, q in queries.items() if q}
    parts = [keyed.select("k1", "k2", F.posexplode(_hits(F.col("text"), r)).alias("at", "hit")) for r in rules if not queries[r.kind]]
    if indexed:
        grams = sorted({g for q in indexed.values() for clause in q for o in clause for g in o})
        chosen = cut(candidates(postings(keyed, grams), indexed))
        looked = keyed.join(F.broadcast(chosen) if chosen.count() <= send else chosen, ["k1", "k2"])
        every = F.flatten(F.array(*(F.coalesce(F.when(F.array_contains("kinds", r.kind), F.transform(_hits(F.col("text"), r), lambda h, i: F.struct(i.alias("at"), h.alias("hit")))), F.array().cast("array<struct<at:int,hit:struct<kind:string,gap:int,n:int,ok:boolean>>>")) for r in rules if queries[r.kind])))
        parts.append(looked.select("k1", "k2", F.explode(every).alias("x")).select("k1", "k2", "x.at", "x.hit"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    # equal rows share a key, and their hits are the same
    hits = hits.select("k1", "k2", "at", "hit.*").dropDuplicates(["k1", "k2", "kind", "at"])
    order = Window.partitionBy("k1", "k2", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(order)
    rank = F.lit(len(rules))
    for i, r in enumerate(rules):
        rank = F.when(F.col("kind") == r.kind, F.lit(i)).otherwise(rank)
    spans = hits.withColumn("end", end).where("ok").select("k1", "k2", F.struct((F.col("end") - F.col("n")).alias("start"), rank.alias("rank"), "kind", "end").alias("span"))
    lists = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("span")).alias("spans"))  # bounded by one document
    rows = keyed.select("doc_id", "k1", "k2").join(lists, ["k1", "k2"], "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)))
    return rows.select("doc_id", *(F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(base)), F.filter("spans", lambda s: s["rank"] < len(base)).alias("base_spans"), "spans")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
