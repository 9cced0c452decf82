"""Quality rules: base rules and robust multivariate outliers.

Documents that pass the base rules become vectors of five transformed
statistics. For each language and source, a minimum-covariance-determinant
estimate is found by concentration steps from a start at medians and median
absolute deviations, reweighted once, and a document is rejected when its
squared Mahalanobis distance passes ``cutoff``. Built from DataFrame operations
only; the covariances are factored by column expressions over one row per group.

Each step is one pass over a narrow table with partial aggregation, so that a
source with a third of all rows is no burden; quantiles are sketches of bounded
size over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.durable import cut, store
from tideline.llm.text import BLANKS, let, whole, words

SYMBOLS = "#*$%&|<>"
FEATURES = 5
#: Least standard deviation that counts for each feature: a spread below it is no evidence.
FLOOR = (0.5, 0.5, 0.08, 0.16, 0.16)
#: The share of rows an estimate rests on, its consistency factor for 5 features, and the 0.975 quantile of chi-square with 5 degrees.
HALF, CONSISTENT, REWEIGHT = 0.75, 1.41, 12.83
STEPS = 3
#: The squared distance beyond which a document is rejected: far beyond the 0.975 quantile, as the statistics of clean texts have longer tails than a normal distribution.
CUTOFF = 45.0
KEYS = ["g_lang", "g_source", "g_small"]
#: Greatest number of groups whose estimates are sent to all executors (about 400 bytes each).
SEND_GROUPS = 50_000


def _repeat_words(w: Column, n: Column) -> Column:
    """Words in windows of three that occur twice or more: equal windows meet by sorting (hash, place) pairs."""
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        at = lambda i: F.get(s, i)["h"]
        same = F.filter(s, lambda x, j: at(j + 1).eqNullSafe(x["h"]) | F.when(j > 0, at(j - 1) == x["h"]).otherwise(F.lit(False)))
        places = F.array_sort(F.transform(same, lambda x: x["i"]))
        # a window adds the words that the one before it doesn't hold
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, j - 1)))), F.lit(0).cast("long"), lambda a, x: a + x))

    hashes = lambda v: F.transform(v, lambda x: x["h"])
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(windows, lambda v: F.when(F.size(F.array_distinct(hashes(v))) == F.size(v), F.lit(0).cast("long")).otherwise(let(F.sort_array(v), covered))))


def statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text, each word split once."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    counted = let(lines, lambda v: F.struct(F.size(v).alias("all"), F.size(F.array_distinct(v)).alias("distinct")))
    own = let(words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w, F.size(w)).alias("again")))
    return let(F.struct(own.alias("w"), counted.alias("l")), lambda x: F.struct(
        x["w"]["n"].cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        x["l"]["all"].cast("long").alias("n_lines"),
        (x["l"]["all"] - x["l"]["distinct"]).cast("long").alias("n_dup_lines"),
        x["w"]["again"].alias("n_repeat_words"),
    ))


def _measured(docs: DataFrame, text: str, lang: str, source: str, ident: str, carry: bool, min_words: int) -> DataFrame:
    """A row per document with its statistics, the verdict of the base rules, features x0..x4 and group."""
    own = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if carry else [F.col(ident).alias("doc_id")]
    stats = docs.select(*own, F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), statistics(whole(text)).alias("s"))
    s = lambda c: F.col("s")[c]
    n = F.greatest(s("n_words"), F.lit(1)).cast("double")
    failed = (s("n_words") < min_words) | (100 * s("n_repeat_words") > 50 * s("n_words"))
    values = (
        F.log1p(s("n_words").cast("double")),
        s("word_chars") / n,
        F.sqrt(s("n_symbols") / n),
        F.sqrt(s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1))),
        F.sqrt(s("n_repeat_words") / n),
    )
    return stats.select(*(["row"] if carry else ["doc_id"]), "s", "g_lang", "g_source", failed.alias("base_failed"), *(v.cast("double").alias(f"x{i}") for i, v in enumerate(values)))


def _distance(x: list[Column], shared: str) -> Column:
    """The squared Mahalanobis distance by forward substitution with the factor in the struct column ``shared``."""
    e, z = F.col(shared), []
    for i in range(FEATURES):
        left = x[i] - e[f"m{i}"]
        for j in range(i):
            left = left - e[f"l{i}{j}"] * z[j]
        z.append(left / e[f"l{i}{i}"])
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


def _factor(moments: DataFrame, scale: float) -> DataFrame:
    """Keys and ``estimate``: mean and Cholesky factor of the covariance times ``scale`` with squared floors added."""
    n = F.col("n")
    table = moments.select(*KEYS, *((F.col(f"c{i}") + F.col(f"s{i}") / n).alias(f"m{i}") for i in range(FEATURES)), *(((F.col(f"p{i}{j}") / n - F.col(f"s{i}") / n * (F.col(f"s{j}") / n)) * scale + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"v{i}{j}") for i in range(FEATURES) for j in range(i + 1)))
    for i in range(FEATURES):
        for j in range(i + 1):
            left = F.col(f"v{i}{j}")
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            table = table.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l{j}{j}"))
    return table.select(*KEYS, F.struct(*(f"m{i}" for i in range(FEATURES)), *(f"l{i}{j}" for i in range(FEATURES) for j in range(i + 1))).alias("estimate"))


def _with(rows: DataFrame, table: DataFrame, groups: int, how: str = "left") -> DataFrame:
    table = table.withColumnsRenamed({k: f"t_{k}" for k in KEYS})
    same = F.lit(True)
    for k in KEYS:
        if k in rows.columns:
            same = same & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    return rows.join(F.broadcast(table) if groups <= SEND_GROUPS else table, same, how).drop(*(f"t_{k}" for k in KEYS))


def _grouped(rows: DataFrame, sizes: DataFrame, groups: int) -> DataFrame:
    """Rows with ``g_small``; the small groups of a language are pooled, without a source of their own."""
    table = sizes.select(F.col("g_lang").alias("t_lang"), F.col("g_source").alias("t_source"), "g_small")
    same = F.col("g_lang").eqNullSafe(F.col("t_lang")) & F.col("g_source").eqNullSafe(F.col("t_source"))
    rows = rows.join(F.broadcast(table) if groups <= SEND_GROUPS else table, same, "left").drop("t_lang", "t_source")
    small = F.coalesce("g_small", F.lit(True))
    return rows.withColumns({"g_small": small, "g_source": F.when(~small, F.col("g_source"))})


def estimates(passed: DataFrame, least: int = 50, steps: int = STEPS) -> tuple[DataFrame, int]:
    """``g_lang, g_source, g_small, estimate`` of the groups with ``least`` rows or more, and how many there are.

    ``passed``: ``g_lang, g_source, g_small, x0..x4`` of documents that pass the base rules.
    """
    keys = KEYS
    x = [F.col(f"x{i}") for i in range(FEATURES)]
    centre = passed.groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile_approx(v, 0.5, 2000).alias(f"c{i}") for i, v in enumerate(x))).where(F.col("n") >= least).drop("n")
    centre = cut(centre)
    groups = centre.count()
    spread = _with(passed, centre, groups, "inner").groupBy(*keys).agg(*(F.percentile_approx(F.abs(v - F.col(f"c{i}")), 0.5, 2000).alias(f"d{i}") for i, v in enumerate(x)))
    spread = _with(centre, spread, groups, "inner")
    zero, wide = F.lit(0.0), [F.sqrt((F.col(f"d{i}") * 1.4826) ** 2 + FLOOR[i] ** 2) for i in range(FEATURES)]
    start = spread.select(*keys, F.struct(*(F.col(f"c{i}").alias(f"m{i}") for i in range(FEATURES)), *((wide[i] if i == j else zero).alias(f"l{i}{j}") for i in range(FEATURES) for j in range(i + 1))).alias("estimate"))
    now = cut(start)
    for step in range(steps + 1):
        measured = _with(passed, now, groups, "inner").withColumn("d", _distance(x, "estimate"))
        measured = _with(measured.drop("estimate"), centre, groups, "inner")
        if step < steps:
            limits = cut(measured.groupBy(*keys).agg(F.percentile_approx("d", HALF, 2000).alias("limit")))
            inside = _with(measured, limits, groups, "inner").where("d <= limit")
        else:
            inside = measured.where(F.col("d") <= REWEIGHT)
        off = [v - F.col(f"c{i}") for i, v in enumerate(x)]
        moments = inside.groupBy(*keys).agg(F.count("*").alias("n"), *(F.first(f"c{i}").alias(f"c{i}") for i in range(FEATURES)), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(off)), *(F.sum(off[i] * off[j]).alias(f"p{i}{j}") for i in range(FEATURES) for j in range(i + 1)))
        now = cut(_factor(moments, CONSISTENT if step < steps else 1.0))
    return now, groups


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", ident: str = "doc_id", cutoff: float = CUTOFF, least: int = 50, min_words: int = 50) -> DataFrame:
    """Statistics and verdict of each document.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance, kept``. The base rules fail
    documents of fewer than ``min_words`` words, and those with over half their
    words in repeated windows of three. The rest are rejected if their squared distance
    from their language and source passes ``cutoff``; the groups of fewer than
    ``least`` documents in a language are pooled, and if those are still fewer
    than ``least``, none of them is rejected.

    Null and empty text: no words, fails. Null language or source: a group of
    its own. Repeated rows count each. Empty table: no rows. Extra columns are
    ignored. Window equality is by 64-bit hash within one text.
    """
    judged = _judged(cut(_measured(docs, text, lang, source, ident, False, min_words)), cutoff, least)
    return judged.select("doc_id", *(F.col("s")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", F.round("distance", 6).alias("distance"), "kept")


def _judged(base: DataFrame, cutoff: float, least: int) -> DataFrame:
    """The measured rows with ``distance`` and ``kept``."""
    x = [f"x{i}" for i in range(FEATURES)]
    passed = base.where(~F.col("base_failed")).select("g_lang", "g_source", *x)
    sizes = cut(passed.groupBy("g_lang", "g_source").agg((F.count("*") < least).alias("g_small")))
    number = sizes.count()
    table, groups = estimates(_grouped(passed, sizes, number), least)
    judged = _with(_grouped(base, sizes, number), table, groups).withColumn("distance", _distance([F.col(v) for v in x], "estimate"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))


def keep_good(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", ident: str = "doc_id", cutoff: float = CUTOFF, least: int = 50, min_words: int = 50) -> DataFrame:
    """The documents that :func:`judge` keeps, with their columns.

    Texts are read and measured once, and written with their measures, whose
    columns alone the estimates read. (A filter on the base rules before the
    table is written would be pushed down and measure each text again.)
    """
    base = store(_measured(docs, text, lang, source, ident, True, min_words).drop("s"))
    judged = _judged(base, cutoff, least).where("kept")
    return judged.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
