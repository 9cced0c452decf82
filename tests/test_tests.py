"""Attribution, baselines, corrections, de-duplication, evaluation, data and sinks."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions.stats import normal_cdf
from tideline.operators import attribution, baselines, correction, dedup, evaluation, itemsets, pipeline, relations
from tideline.sources import sinks, synthetic
from tideline.streaming import dense as stream

EVENT = "event_id string, name string, start long, end long"


POINTS = "pattern array<long>, s long, e long, time long, direction string, magnitude double, before double, after double"


def test_scores_by_definition(spark):
    draw = random.Random(41)
    points = [([k], 0, 0, draw.randrange(400), "up", draw.choice((1.0, 2.5, 40.0, 0.01)), draw.choice((0.0, 0.5, 9.0)), 0.0) for k in range(40)]
    events = [(f"E{k}", f"e{k}", a := draw.randrange(350), a + draw.randrange(60)) for k in range(7)]
    frame, held = spark.createDataFrame(points, POINTS), spark.createDataFrame(events, EVENT)
    for sigma in (0.0, 0.4, 20.0, 300.0):
        for mode, ablation in (("none", None), ("sqrt", None), ("full", None), ("sqrt", "no_prox"), ("none", "no_mag"))[: None if sigma == 20 else 1]:
            expected = {}
            for p in points:
                for i, _, a, b in events:
                    away = min(abs(p[3] - a), abs(p[3] - b))
                    near = math.exp(-away / sigma) if sigma else float(away == 0)
                    weight = p[5] / {"none": 1, "sqrt": math.sqrt(max(1, p[6])), "full": max(1, p[6])}[mode]
                    value = round({None: near * weight, "no_prox": weight, "no_mag": near}[ablation], 9)
                    if value >= 0.1:
                        expected[p[0][0], i] = value
            got = {(r.pattern[0], r.event_id): r.score for r in attribution.score(frame, held, sigma, normalisation=mode, ablation=ablation).collect()}
            assert got == pytest.approx(expected) and (expected or sigma < 1)
    for wrong in ({"ablation": "no_name"}, {"normalisation": "cube"}, {"threshold": 0}):
        with pytest.raises(ValueError):
            attribution.score(frame, held, 5.0, **wrong)
    assert attribution.score(frame, held.limit(0), 5.0).count() == 0 == attribution.score(frame.limit(0), held, 5.0).count()


def test_shifts_by_definition(spark):
    rows = [(s, s + w, o) for s in (0, 7, 29) for w in (0, 4, 11) for o in (1, 12, 29)]
    frame = spark.createDataFrame(rows, "s long, e long, o long")
    begin, end = attribution.shifted(F.col("s"), F.col("e"), F.col("o"), 30)
    got = {(r.s, r.e, r.o): (r.x, r.y) for r in frame.select("*", begin.alias("x"), end.alias("y")).collect()}
    assert got == {(s, e, o): ((s + o) % 30, min((s + o) % 30 + e - s, 29)) for s, e, o in rows}


def test_permutation_matches_brute_force(spark):
    draw = random.Random(4)
    points = [(f"p{k}", 0, 9, draw.randrange(100), "up", draw.uniform(1, 4), draw.uniform(0, 5), 0.0) for k in range(6) for _ in range(2)]
    events = [("A", "a", 10, 20), ("B", "b", 60, 90)]
    frame = spark.createDataFrame(points, "pattern string, s long, e long, time long, direction string, magnitude double, before double, after double")
    got = {(r.pattern, r.event_id): r.p_value for r in attribution.permutation_test(frame, spark.createDataFrame(events, EVENT), 100, 10.0, permutations=40, unit=("pattern",), seed=7).collect()}
    offsets = [r.offset for r in attribution.offsets(spark, 40, 100, 7).orderBy("b").collect()]

    def total(p, start, end):
        parts = [round(math.exp(-min(abs(x[3] - start), abs(x[3] - end)) / 10) * x[5] / math.sqrt(max(1, x[6])), 9) for x in points if x[0] == p]
        parts = [x for x in parts if x >= 0.1]
        return round(sum(parts), 9) if parts else None

    expected = {}
    for p in {x[0] for x in points}:
        for i, _, a, b in events:
            seen = total(p, a, b)
            if seen is not None:
                moved = [total(p, (a + o) % 100, min((a + o) % 100 + b - a, 99)) for o in offsets]
                expected[p, i] = (1 + sum(m is not None and m >= seen for m in moved)) / 41
    assert got == pytest.approx(expected)
    assert attribution.permutation_test(frame, spark.createDataFrame(events, EVENT), 1, 10.0).count() == 0
    # every hypothesis with shifts of its own
    own = {(r.pattern, r.event_id): r.p_value for r in attribution.permutation_test(frame, spark.createDataFrame(events, EVENT), 100, 10.0, permutations=40, unit=("pattern",), seed=7, independent=True).collect()}
    expected = {}
    for p, i in got:
        a, b = next((a, b) for j, _, a, b in events if j == i)
        offsets = [1 + int(hashlib.md5(f"7|{p}|{i}|{k}".encode()).hexdigest()[:13], 16) % 99 for k in range(40)]
        moved = [total(p, (a + o) % 100, min((a + o) % 100 + b - a, 99)) for o in offsets]
        expected[p, i] = (1 + sum(m is not None and m >= total(p, a, b) for m in moved)) / 41
    assert own == pytest.approx(expected)
    same = attribution.permutation_test(frame, spark.createDataFrame(events, EVENT), 100, 10.0, permutations=40, unit=("pattern",), seed=7, ablation="no_prox").collect()
    assert same and {r.p_value for r in same} == {1.0}


def adjusted_by_definition(ps):
    """For each p, the least of q * m / (number of values up to q) over all q of p or more, 1 at most."""
    return [min(1.0, min(q * len(ps) / sum(x <= q for x in ps) for q in ps if q >= p)) for p in ps]


def test_corrections_by_definition(spark):
    draw = random.Random(2)
    rows = [(g, round(draw.random() ** 2, places)) for g, n, places in (("a", 60, 1), ("b", 1, 3), ("c", 300, 7)) for _ in range(n)]
    frame = spark.createDataFrame(rows, "g string, p_value double").repartition(5)
    own = {g: [p for h, p in rows if h == g] for g in "abc"}
    expected = sorted((g, p, q) for g, ps in own.items() for p, q in zip(ps, adjusted_by_definition(ps)))
    got = sorted((r.g, r.p_value, r.adjusted) for r in correction.benjamini_hochberg(frame, "p_value", "g").collect())
    assert [x[:2] for x in got] == [x[:2] for x in expected] and [x[2] for x in got] == pytest.approx([x[2] for x in expected])
    every = [p for _, p in rows]
    got = sorted((r.p_value, r.adjusted) for r in correction.benjamini_hochberg(frame).collect())
    assert [x[1] for x in got] == pytest.approx([q for _, q in sorted(zip(every, adjusted_by_definition(every)))])
    got = sorted((r.g, r.adjusted) for r in correction.bonferroni(frame, "p_value", "g").collect())
    assert [x[1] for x in got] == pytest.approx([q for _, q in sorted((g, min(1.0, p * len(own[g]))) for g, p in rows)])
    assert correction.benjamini_hochberg(frame.limit(0)).count() == 0


def clusters(rows, linked):
    """The components of linked rows, as lists of places."""
    left, out = set(range(len(rows))), []
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            a = todo.pop()
            near = {b for b in left if rows[a][1] == rows[b][1] and linked(set(rows[a][0]), set(rows[b][0]))}
            left -= near
            group += near
            todo += near
        out.append(group)
    return out


@pytest.mark.parametrize("longest", [12, 2])
def test_dedup_by_definition(spark, monkeypatch, longest):
    monkeypatch.setattr(dedup, "LONGEST", longest)
    draw = random.Random(51)
    rows = {(tuple(sorted(draw.sample(range(14), draw.randint(1, 6)))), draw.choice("EF")) for _ in range(70)}
    rows = [(list(p), e, round(draw.random(), 3)) for p, e in sorted(rows)]
    frame = spark.createDataFrame(rows, "pattern array<long>, event_name string, score double")
    better = [F.desc("score"), F.desc(F.size("pattern")), F.col("pattern")]
    tests = (
        (lambda f: dedup.by_overlap(f, better), lambda a, b: len(a) == len(b) and 2 * len(a & b) >= len(a)),
        (lambda f: dedup.by_subset(f, better), lambda a, b: a <= b or b <= a),
        (lambda f: dedup.by_effect(f, "score"), lambda a, b: len(a & b) >= max(1, min(len(a), len(b)) // 2)),
    )
    for made, linked in tests:
        best = {min(group, key=lambda k: (-rows[k][2], -len(rows[k][0]), rows[k][0])) for group in clusters(rows, linked)}
        got = {(tuple(r.pattern), r.event_name) for r in made(frame).collect()}
        assert got == {(tuple(rows[k][0]), rows[k][1]) for k in best}


def test_dedup(spark):
    rows = spark.createDataFrame([([1, 2], "E", 10.0), ([1, 3], "E", 5.0), ([1, 2, 9], "E", 3.0), ([7, 8], "E", 1.0), ([1, 3], "F", 2.0)], "pattern array<long>, event_name string, score double")
    got = {(tuple(r.pattern), r.event_name) for r in dedup.by_score(rows).collect()}
    assert got == {((1, 2), "E"), ((7, 8), "E"), ((1, 3), "F")}


def test_normal_distribution(spark):
    for z, p in ((0, 0.5), (1, 0.8413447), (-1, 0.1586553), (2, 0.9772499), (3, 0.9986501)):
        assert spark.range(1).select(normal_cdf(F.lit(float(z)))).first()[0] == pytest.approx(p, abs=2e-7)


def test_rank_sum_against_scipy_like_ranks(spark):
    values = [1] * 10 + [5, 6, 7, 8, 9, 6, 7, 8] + [1, 2] * 6
    steps = spark.createDataFrame([("x", t, t, v) for t, v in enumerate(values)], "pattern string, a long, b long, support long")
    events = spark.createDataFrame([("E", "e", 10, 17), ("F", "f", 20, 26)], EVENT)
    got = {r.event_id: r.p_value for r in baselines.mann_whitney(steps, events, 1).collect()}
    assert got["E"] < 0.001 and got["F"] > 0.5


def test_interrupted_series_finds_the_jump(spark):
    values = [2 + 3 * t + (5 if t >= 10 else 0) for t in range(20)]
    noise = [0, 1, 0, -1] * 5
    steps = spark.createDataFrame([("x", t, t, v + n) for t, (v, n) in enumerate(zip(values, noise))], "pattern string, a long, b long, support long")
    row = baselines.interrupted(steps, spark.createDataFrame([("E", "e", 10, 19)], EVENT), 1).first()
    assert row.effect == pytest.approx(5, abs=1.0) and row.p_value < 0.01


def test_evaluation(spark):
    events = spark.createDataFrame([("E1", "one", 0, 9), ("E2", "two", 20, 29)], EVENT)
    truth = spark.createDataFrame([([1, 2], "E1", 0, 0), ([3, 4], "E2", 0, 0)], "pattern array<long>, event_id string, interval_start long, interval_end long")
    predicted = spark.createDataFrame([([2, 1], "one", 5, 9)], "pattern array<long>, event_name string, interval_start long, interval_end long")
    for found in (evaluation.patterns_and_events(predicted, truth, events), evaluation.intervals_and_events(predicted, truth, events)):
        r = found.first()
        assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 0, 1, 1.0, 0.5)
    r = evaluation.patterns_and_events(predicted.limit(0), truth, events).first()
    assert (r.tp, r.precision, r.recall, r.f1) == (0, 0.0, 0.0, 0.0)
    assert evaluation.false_attribution(predicted, truth).first().rate == 0.5
    top = evaluation.top_per_event(spark.createDataFrame([("E1", [1, 2], 2.0)], "event_id string, pattern array<long>, score double"), events)
    assert {(r.event_id, r.rank) for r in top.collect()} == {("E1", 1), ("E2", 0)}


def test_planted_signal_is_attributed(spark):
    scenario = synthetic.Scenario(n=1200, items=12, base=0.05, planted=(synthetic.Planted((3, 7), "E1", "sale", 500, 650, 0.7),), decoys=(synthetic.Decoy("D1", "decoy", 100, 160),))
    occ = synthetic.occurrences(spark, scenario).select("t", F.col("t").alias("basket_id"), "item").cache()
    found = itemsets.dense_itemsets(occ, 50, 12, max_length=2).cache()
    config = pipeline.Config(window=50, theta=12, permutations=200, alpha=0.2, deduplicate=True, seed=1, sigma=10.0)
    rows = pipeline.attribute(found, occ, synthetic.events(spark, scenario), 1200, config).collect()
    assert {(tuple(r.pattern), r.event_name) for r in rows} == {((3, 7), "sale")}
    truth = synthetic.ground_truth(spark, scenario, found)
    assert [r.event_id for r in truth.collect()] == ["E1"]
    for method in baselines.METHODS:
        assert pipeline.baseline(method, found, occ, synthetic.events(spark, scenario), 1200, config).columns
    crossing = pipeline.Config(window=50, theta=12, permutations=50, alpha=1.1, change_method="threshold_crossing", global_correction=False, correction="bonferroni", sigma=10.0)
    assert ((3, 7), "sale") in {(tuple(r.pattern), r.event_name) for r in pipeline.attribute(found, occ, synthetic.events(spark, scenario), 1200, crossing).collect()}


def test_generator_is_reproducible(spark):
    for scenario in (synthetic.tiny(), synthetic.zipf(correlated=True)):
        small = synthetic.rescaled(scenario, min(scenario.n, 400))
        a = {tuple(r) for r in synthetic.occurrences(spark, small).collect()}
        assert a == {tuple(r) for r in synthetic.occurrences(spark, small).repartition(3).collect()} and a
    for made in (synthetic.beta(), synthetic.overlapping(), synthetic.confounded(), synthetic.crowded(), synthetic.short(), synthetic.null(), synthetic.two_intervals(), synthetic.two_boosts(), synthetic.by_length(3)):
        assert all(0 <= x.start <= x.end < made.n for x in (*made.planted, *made.unrelated, *made.decoys))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([([1, 2], 0, 4), ([1, 2], 7, 9), ([1, 2, 3], 1, 2), ([5], 0, 1)], "pattern array<long>, s long, e long")
    sinks.write_patterns_csv(rows, str(tmp_path / "p"))
    got = [tuple(r) for r in spark.read.csv(str(tmp_path / "p"), header=True).collect()]
    assert got == [("[{1, 2, 3}]", "[]", "3", "1", "(1,2)"), ("[{1, 2}]", "[]", "2", "2", "(0,4);(7,9)")]
    assert "[1, 2] 0 4" in {r.value for r in sinks.interval_lines(rows).collect()}
    sinks.write_transactions(spark.createDataFrame([(1, [3, 1]), (0, [])], "t long, items array<long>"), str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["", "1 3"]


def test_relations(spark):
    found = spark.createDataFrame([([1], 10, 20)], "pattern array<long>, s long, e long")
    events = spark.createDataFrame([("A", "", 21, 30), ("B", "", 12, 15), ("C", "", 15, 40), ("D", "", 100, 110)], EVENT)
    got = {(r.event_id, r.relation) for r in relations.relations(found, events, 2, 5).collect()}
    assert {("A", "DenseFollowsEvent"), ("B", "DenseContainsEvent"), ("C", "DenseOverlapsEvent")} <= got and not any(e == "D" for e, _ in got)


def test_streaming_runs_match_batch(spark, tmp_path):
    from tideline.operators import dense

    draw = random.Random(9)
    groups = {k: sorted(draw.choices(range(80), k=30)) for k in ("a", "b")}
    batch = spark.createDataFrame([(k, t) for k, ts in groups.items() for t in ts], "pattern string, t long")
    expected = {(r.pattern, r.s, r.e) for r in dense.runs(batch, 6, 3).collect()}
    (tmp_path / "in").mkdir()
    for part, lines in enumerate((lambda t: t < 40, lambda t: t >= 40)):
        (tmp_path / "in" / f"{part}.csv").write_text("".join(f"{k},{t}\n" for k, ts in groups.items() for t in ts if lines(t)))
    (tmp_path / "in" / "2.csv").write_text("a,-1\nb,-1\n")
    import os
    for part in range(3):
        os.utime(tmp_path / "in" / f"{part}.csv", (1000 + part, 1000 + part))
    source = spark.readStream.schema("pattern string, t long").option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
    query = stream.dense_runs(source, 6, 3).writeStream.outputMode("append").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.pattern, r.s, r.e) for r in spark.table("runs").collect()} == expected


def test_experiments(spark):
    from tideline.operators import experiments

    def scenario(seed):
        return synthetic.Scenario(n=800, items=8, base=0.05, planted=(synthetic.Planted((3, 7), "E1", "sale", 300, 420, 0.8),), unrelated=(synthetic.Unrelated((1, 2), 600, 700, 0.5),), decoys=(synthetic.Decoy("D1", "decoy", 60, 110),), seed=seed)

    config = pipeline.Config(window=40, theta=12, permutations=100, alpha=0.25, sigma=8.0, seed=1, unit="interval", deduplicate=True)
    rows = experiments.run(spark, {"a": [scenario(0), scenario(1)]}, config, ("proposed", "coincidence"), max_length=2)
    assert rows.count() == 4 and evaluation.means(rows.where("method = 'proposed'"), "condition").first().recall == 1.0
    null = synthetic.Scenario(n=600, items=6, base=0.05, unrelated=(synthetic.Unrelated((1, 2), 300, 360, 0.6),), decoys=(synthetic.Decoy("D1", "decoy", 20, 40),))
    assert evaluation.null_discoveries(experiments.null_run(spark, [null], config)).first().seeds == 1
    base = synthetic.occurrences(spark, synthetic.Scenario(n=600, items=6, base=0.2))
    made = experiments.semi_synthetic(base, [synthetic.Planted((2, 5), "E1", "sale", 200, 320, 3.0)], [], 600, pipeline.Config(window=40, theta=16, permutations=100, alpha=0.3, sigma=8.0, seed=2))
    assert made.first().recall == 1.0
