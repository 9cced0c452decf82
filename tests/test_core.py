"""Worked examples and brute force for mining, support and change points."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tideline.operators import changes, dense, intervals, itemsets, postings, support
from tideline.operators.graph import connected_components
from tideline.sources import readers


def times(spark, groups):
    return spark.createDataFrame([(k, t) for k, ts in groups.items() for t in ts], "pattern string, t long")


def left_ends(ts, w, th):
    """Dense intervals by definition: try every left end."""
    if not ts:
        return []
    hits = [x for x in range(min(ts) - w - 1, max(ts) + 2) if sum(x <= t <= x + w for t in ts) >= th]
    out = []
    for x in hits:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(x) for x in out]


def spans(ts, w, th):
    return [(s, e) for s, e in ((min(t for t in ts if t >= a), max(t for t in ts if t <= b + w)) for a, b in left_ends(ts, w, th)) if e - s >= w]


@pytest.mark.parametrize("w,th", [(1, 1), (3, 2), (10, 3), (7, 5)])
def test_dense_runs_match_the_definition(spark, w, th):
    draw = random.Random(w * 100 + th)
    groups = {f"g{k}": sorted(draw.choices(range(draw.choice((20, 60))), k=draw.randint(0, 40))) for k in range(25)}
    frame = times(spark, groups)
    for block in (dense.BLOCK, 1):
        got = {(r.pattern, r.s, r.e) for r in dense.runs(frame, w, th, block=block).collect()}
        assert got == {(k, *x) for k, ts in groups.items() for x in left_ends(ts, w, th)}
    got = {(r.pattern, r.s, r.e) for r in dense.runs(frame, w, th, convention="span", block=1).collect()}
    assert got == {(k, *x) for k, ts in groups.items() for x in spans(ts, w, th)}


def test_one_heavy_transaction_is_dense_wherever_a_window_holds_it(spark):
    frame = times(spark, {"heavy": [40] * 6, "pair": [40, 46], "apart": [40, 47]})
    assert {tuple(r) for r in dense.runs(frame, 6, 2).collect()} == {("heavy", 34, 40), ("pair", 40, 40)}
    for w, th in ((0, 2), (6, 0)):
        with pytest.raises(ValueError):
            dense.runs(frame, w, th)


def test_scan_agrees_with_runs_where_nothing_is_counted_twice(spark):
    draw = random.Random(12)
    for _ in range(200):
        ts = sorted(draw.sample(range(80), draw.randint(0, 40)))
        whole = [(ts[0], ts[-1])] if ts else []
        assert dense.scan(ts, 6, 3, whole) == left_ends(ts, 6, 3)
    # the second run begins inside the span of the first, and starts after it
    assert dense.scan([0, 1, 2, 9, 10, 11], 5, 2, [(0, 11)], "span") == [(0, 2), (9, 11)]
    frame = times(spark, {"a": [0, 1, 2, 9, 10, 11], "b": [3]})
    ranges = spark.createDataFrame([("a", 0, 11), ("b", 0, 9), ("c", 0, 1)], "pattern string, s long, e long")
    assert {tuple(r) for r in dense.scanned_within(frame, 5, 2, ranges, "span").collect()} == {("a", 0, 2), ("a", 9, 11)}


def occ_of(spark, transactions):
    frame = spark.createDataFrame([(t, bs) for t, bs in enumerate(transactions)], "t long, baskets array<array<long>>")
    return postings.occurrences(frame)


def mined(spark, transactions, w, th, **options):
    rows = itemsets.dense_itemsets(occ_of(spark, transactions), w, th, **options).collect()
    return {(tuple(r.pattern), r.s, r.e) for r in rows}


def test_baskets_keep_items_apart(spark):
    found = {p for p, _, _ in mined(spark, [[[1, 2], [3]]] * 3, 2, 2)}
    assert (1, 2) in found and not found & {(1, 3), (2, 3), (1, 2, 3)}
    found = {p for p, _, _ in mined(spark, [[[1, 2, 3]]] * 3, 2, 2)}
    assert {(1, 2), (1, 3), (2, 3)} <= found


def test_empty_and_single(spark):
    assert mined(spark, [[]] * 3, 2, 2) == set()
    assert {p for p, _, _ in mined(spark, [[[1]]] * 3, 2, 2)} == {(1,)}
    assert mined(spark, [[[1, 2]] * 5] * 3, 1, 3) == set()


def test_mining_matches_brute_force(spark):
    draw = random.Random(5)
    data = [[sorted(draw.sample(range(6), draw.randint(0, 4)))] for _ in range(60)]
    data = [[b for b in tx if b] for tx in data]
    w, th = 8, 3
    got = mined(spark, data, w, th)
    runs = lambda items: left_ends([t for t, tx in enumerate(data) for b in tx if set(items) <= set(b)], w, th)
    single = {i: runs((i,)) for i in range(6)}
    expected, level = {((i,), *x) for i in range(6) for x in single[i]}, {(i,) for i in range(6) if single[i]}
    for k in range(2, 7):
        now = set()
        for p in combinations(range(6), k):
            if not all(q in level for q in combinations(p, k - 1)):
                continue
            allowed = single[p[0]]
            for i in p[1:]:
                allowed = [(max(a, c), min(b, d)) for a, b in allowed for c, d in single[i] if max(a, c) <= min(b, d)]
            kept = {(p, max(a, c), min(b, d)) for a, b in runs(p) for c, d in allowed if d - c >= w and max(a, c) <= min(b, d)}
            expected |= kept
            if kept:
                now.add(p)
        level = now
    assert got == expected
    if all(len(tx) < 2 for tx in data):  # one basket each: a scan finds the same
        assert mined(spark, data, w, th, scanned=True) == expected


def test_index_and_dictionary(spark):
    frame = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)], "v long").repartition(7)
    got = {r.v: r.t for r in postings.ordered_index(frame, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}
    words = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "w string")
    assert {r.w: r.item for r in postings.dictionary(words, "w").collect()} == {"a": 0, "b": 1}


def test_intersections_and_bags(spark):
    occ = occ_of(spark, [[[1, 2], [1, 2], [3]], [[1], [2]]])
    pattern = spark.createDataFrame([([1, 2],)], "pattern array<long>")
    bag = postings.to_transactions(postings.intersect(occ.select("item", "basket_id", "t"), pattern, "basket_id"))
    assert [r.t for r in bag.collect()] == [0, 0]
    assert sorted(r.t for r in postings.timestamps(occ, pattern).collect()) == [0, 1]


def test_interval_algebra(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 4, 6), ("a", 9, 9), ("b", 0, 0)], "k string, s long, e long")
    assert {tuple(r) for r in intervals.merge(rows, "k").collect()} == {("a", 1, 6), ("a", 9, 9), ("b", 0, 0)}
    other = spark.createDataFrame([("a", 2, 9)], "k string, s long, e long")
    assert {tuple(r) for r in intervals.overlap(rows, other, "k").select("k", "s", "e").collect()} == {("a", 2, 3), ("a", 4, 6), ("a", 9, 9)}
    assert {tuple(r) for r in intervals.is_covered(other, rows, "k").collect()} == {("a", 2, 9, False)}
    array = F.array(F.lit(1), F.lit(3), F.lit(3), F.lit(7))
    assert tuple(spark.range(1).select(intervals.first_at_least(array, F.lit(3)), intervals.first_above(array, F.lit(3))).first()) == (1, 3)


def supports(ts, w, n):
    """The series by definition."""
    return [sum(t <= x < t + w for x in ts) for t in range(max(0, n - w + 1))]


def test_support_series_by_definition(spark):
    draw = random.Random(31)
    own = {f"p{k}": sorted(draw.choices(range(90), k=draw.randint(0, 40))) for k in range(8)} | {"late": [89], "none": []}
    patterns = spark.createDataFrame([(k,) for k in own], "pattern string")
    for w, n in ((1, 90), (7, 90), (90, 90), (91, 90), (12, 91)):
        for block in (support.BLOCK, 16):
            found = {}
            for r in support.steps(times(spark, own), patterns, w, n, block=block).collect():
                for t in range(r.a, r.b + 1):
                    assert (r.pattern, t) not in found
                    found[r.pattern, t] = r.support
            assert found == {(k, t): v for k, ts in own.items() for t, v in enumerate(supports(ts, w, n))}
        assert {(r.pattern, r.t): r.support for r in support.series(times(spark, own), patterns, w, n).collect()} == found
    asked = [(k, t) for k in own for t in (0, 3, 44, 88, 200)]
    got = {(r.pattern, r.t): r.support for r in support.probe(times(spark, own), spark.createDataFrame(asked, "pattern string, t long"), 9).collect()}
    assert got == {(k, t): sum(t <= x < t + 9 for x in own[k]) for k, t in asked}


def test_change_points_by_definition(spark):
    draw = random.Random(32)
    own = {f"p{k}": sorted(draw.choices(range(10 * k, 10 * k + 120), k=60)) for k in range(6)}
    frame, patterns = times(spark, own), spark.createDataFrame([(k,) for k in own], "pattern string")
    w, n, level = 9, 190, 5
    series = {k: supports(ts, w, n) for k, ts in own.items()}
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    sides = lambda v, t: (mean(v[max(0, t - level) : t]), mean(v[t : t + level]))

    def rounded(rows):
        return sorted((r.pattern, r.time, r.direction, round(r.magnitude, 6), round(r.before, 6), round(r.after, 6)) for r in rows)

    expected = []
    for k, v in series.items():
        for t, x in enumerate(v):
            if (x >= 5) != (t > 0 and v[t - 1] >= 5):
                before, after = sides(v, t)
                expected.append((k, t, "up" if x >= 5 else "down", round(max(1.0, (after - before) * (1 if x >= 5 else -1)), 6), round(before, 6), round(after, 6)))
    for block in (support.BLOCK, 24):
        assert rounded(changes.threshold_crossings(frame, patterns, w, n, 5, level, block=block).collect()) == sorted(expected) and len(expected) > 30
    spans = [(k, 20 + 7 * i, 30 + 11 * i) for i, k in enumerate(own)]
    expected = []
    for k, a, b in spans:
        for t, name, sign in ((a, "up", 1), (b + 1, "down", -1)):
            before, after = sides(series[k], t)
            expected.append((k, t, name, round(max(1.0, sign * (after - before)), 6), round(before, 6), round(after, 6)))
    assert rounded(changes.from_intervals(spark.createDataFrame(spans, "pattern string, s long, e long"), frame, w, n, level).collect()) == sorted(expected)
    with pytest.raises(ValueError):
        changes.detect(frame, patterns, w, n, "other")


def test_cusum_against_the_plain_fold(spark, monkeypatch):
    draw = random.Random(33)
    own = {f"p{k}": sorted(draw.choices(range(40 * k, 40 * k + 200), k=draw.choice((5, 80)))) for k in range(5)} | {"none": [], "flat": list(range(400))}
    patterns = spark.createDataFrame([(k,) for k in own], "pattern string")
    for w, n, drift, bound in ((6, 400, 0.5, 4.0), (30, 400, 0.25, 2.5), (1, 400, 0.0, 0.5), (400, 400, 0.5, 4.0)):
        expected = []
        for k, ts in own.items():
            v = supports(ts, w, n)
            mean, up, down, last = sum(v) / len(v), 0.0, 0.0, 0.0
            for t, x in enumerate(v if len(v) > 1 else ()):
                up, down = max(0.0, up + x - mean - drift), max(0.0, down - x + mean - drift)
                if round(up, 9) > bound:
                    expected.append((k, t, "up", round(up, 5), last, float(x)))
                    up = 0.0
                if round(down, 9) > bound:
                    expected.append((k, t, "down", round(down, 5), last, float(x)))
                    down = 0.0
                last = float(x)
        got = sorted((r.pattern, r.time, r.direction, round(r.magnitude, 5), r.before, r.after) for r in changes.cusum(times(spark, own), patterns, w, n, drift, bound).collect())
        assert got == sorted(expected) and (len(got) > 10 or w == 400)


def test_readers(spark, tmp_path):
    (tmp_path / "b.txt").write_text("1 2 3\n1 2 | 3 4\n\n1 2 | 3 | 4 5\n\n")
    rows = readers.basket_text(spark, str(tmp_path / "b.txt")).orderBy("t").collect()
    assert [r.baskets for r in rows] == [[[1, 2, 3]], [[1, 2], [3, 4]], [], [[1, 2], [3], [4, 5]], []]
    with pytest.raises(Exception):
        readers.flat_text(spark, str(tmp_path / "b.txt")).collect()
    (tmp_path / "e.json").write_text('[{"event_id": "A", "start": 1, "end": 3, "other": 1}, {"event_id": "B", "name": "b", "start": 2, "end": 2}]')
    assert {tuple(r) for r in readers.events_json(spark, str(tmp_path / "e.json")).collect()} == {("A", "", 1, 3), ("B", "b", 2, 2)}
    for bad in ('[{"event_id": "A", "start": 5, "end": 3}]', '[{"event_id": "A", "start": 1, "end": 3}, {"event_id": "A", "start": 1, "end": 3}]'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            readers.events_json(spark, str(tmp_path / "bad.json"))
    assert readers.settings('{"apriori_parameters": {"window_size": 3, "min_support": 2, "max_length": 4}}')["apriori_parameters"]["window_size"] == 3


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    got, local = ({r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), local=n).collect()} for n in (0, 10_000))
    assert got == local
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pair_counts(spark):
    occ = occ_of(spark, [[[1, 2, 3]], [[1, 2]], [[3]]])
    assert {tuple(r) for r in itemsets.pair_counts(occ).collect()} == {(1, 2, 2), (1, 3, 1), (2, 3, 1)}
    data = [[sorted({k % 12, k % 7, k % 5})] for k in range(80)]
    pairs = itemsets.mid_frequency_pairs(occ_of(spark, data), 2, low=2, high=10)
    assert len(pairs) == 2 and not Counter(x for p in pairs for x in p).most_common(1)[0][1] > 1


def test_intersections_of_any_size_move_only_what_is_there(spark):
    """Patterns of several sizes, with repeats, without order, of narrower numbers and of no items; and no row for each item of each pattern."""
    draw = random.Random(33)
    held = {key: draw.sample(range(12), draw.randint(0, 8)) for key in range(60)}
    wanted = [[], [3], [5, 2], [2, 5], [4, 4, 1], [7, 1, 9], [0, 1, 2, 3], [99], [1, None]]
    postings_of = spark.createDataFrame([(i, key, key * 10) for key, items in held.items() for i in items], "item long, key long, t long")
    got = sorted((r.pattern, r.key, r.t) for r in postings.intersect(postings_of, spark.createDataFrame([(p,) for p in wanted], "pattern array<int>"), "key").collect())
    assert got == sorted((p, key, key * 10) for p in wanted if p and None not in p for key, items in held.items() if set(p) <= set(items))
    assert postings.intersect(postings_of, spark.createDataFrame([([],)], "pattern array<int>"), "key").columns == ["pattern", "key", "t"]
    # ten keys with one item each, in hundreds of patterns
    alone = spark.createDataFrame([(0, key) for key in range(10)], "item long, key long")
    found = postings.intersect(alone, spark.createDataFrame([([0, k],) for k in range(1, 300)], "pattern array<long>"), "key")
    seen = found.observe("met", F.count("*").alias("n"))
    assert seen.count() == 0
    plan = found._jdf.queryExecution()
    found.collect()
    made = [int(x) for x in rows_made(plan.executedPlan())]
    assert max(made) <= 600


def rows_made(plan):
    """Rows that each node of a plan gave, those behind adaptive execution too."""
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            yield metric.get().value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]


def test_crossings_of_a_window_of_one_and_of_no_threshold(spark):
    frame, patterns = times(spark, {"a": [0, 3, 3, 4, 9]}), spark.createDataFrame([("a",)], "pattern string")
    both = lambda theta: sorted((r.time, r.direction, r.before, r.after) for r in changes.threshold_crossings(frame, patterns, 1, 9, theta, 2).collect())
    assert both(1) == [(0, "up", 0.0, 0.5), (1, "down", 1.0, 0.0), (3, "up", 0.0, 1.5), (5, "down", 1.5, 0.0)]
    assert both(0) == [(0, "up", 0.0, 0.5)]


def test_attribution_takes_the_times_that_are_there(spark, monkeypatch):
    """Neither the transactions nor the series are made again, and only occurrences around change points are moved."""
    from tideline.operators import pipeline

    found = spark.createDataFrame([([1, 2], 100, 200)], "pattern array<long>, s long, e long")
    own = spark.createDataFrame([([1, 2], t) for t in range(100, 220, 2)], "pattern array<long>, t long")
    events = spark.createDataFrame([("C1", "x", 100, 120)], "event_id string, name string, start long, end long")
    occ = spark.createDataFrame([(t, t, i) for t in range(100, 220, 2) for i in (1, 2)], "t long, basket_id long, item long")
    for method in ("intervals", "threshold_crossing"):
        config = pipeline.Config(window=10, theta=5, permutations=50, alpha=2.0, change_method=method)
        expected = sorted(map(tuple, pipeline.attribute(found, occ, events, 1000, config).collect()))
        with monkeypatch.context() as m:
            m.setattr(pipeline, "timestamps", None)
            assert sorted(map(tuple, pipeline.attribute(found, occ, events, 1000, config, own).collect())) == expected and expected
