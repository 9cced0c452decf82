"""The pipeline's stages against their operators on a small table."""

from collections import Counter

import corpus_pipeline
from tideline.llm import binary, decontaminate, mixing, quality, simhash
from tideline.llm.catalog import tokenizer

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    docs, outs = given, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs)
        if k < 4:
            assert docs.columns == given.columns
    ids = [sorted(r.doc_id for r in x.collect()) for x in outs[:4]]
    assert ids[0] == sorted(r.doc_id for r in quality.judge(given, min_words=1).where("kept").collect())
    texts = {r.doc_id: r.text for r in outs[0].collect()}
    prints = {i: simhash.fingerprint(t.encode(), 5) for i, t in texts.items()}
    sets = {}
    for i, t in texts.items():
        words = t.encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    kept = set()
    left = set(prints)
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            a = todo.pop()
            near = {b for b in left if (prints[a] ^ prints[b]).bit_count() <= 3 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
            left -= near
            group |= near
            todo += near
        kept.add(min(group))
    assert ids[1] == sorted(kept)
    leaked = {r.doc_id for r in decontaminate.leaks(outs[1], benchmark).collect()}
    assert leaked and ids[2] == sorted(kept - leaked)
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[3]).values()) <= 2
    encode = binary._encoding(tokenizer("byte_bpe_50k.tiktoken")).encode_ordinary
    rows = sorted(outs[4].collect(), key=lambda r: r.slot)
    tokens = Counter()
    for r in rows:
        for who, a, b in zip(r.doc_ids, r.begins, [*r.begins[1:], r.n_tokens]):
            tokens[who] += b - a
    times = Counter(ids[3])
    assert tokens == {i: n * (len(encode(texts[i])) + 1) for i, n in times.items()}
    assert corpus_pipeline.run(spark, FOLDER).count() == len(rows)
    read = [x.tobytes() for _, x in binary.read_slots(rows[0].path.rsplit("/", 1)[0], len(rows) // 2)]
    assert read == [bytes(r.tokens) for r in rows[len(rows) // 2 :]]


def test_the_curriculum_holds_over_slots(spark, tmp_path):
    """The share of each source's tokens changes over the slots as its schedule says."""
    rows = [(1000 * s + k, " ".join(f"w{k}x{j}" for j in range(40)), "en", f"s{s}") for s in range(3) for k in range(400)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    corpus_pipeline.mix_sources(spark, given, FOLDER).write.parquet(str(tmp_path / "mixed"))
    out = sorted(corpus_pipeline.token_shards(spark, spark.read.parquet(str(tmp_path / "mixed")), FOLDER).collect(), key=lambda r: r.slot)
    quarters = [Counter() for _ in range(4)]
    for r in out:
        for who, a, b in zip(r.doc_ids, r.begins, [*r.begins[1:], r.n_tokens]):
            quarters[4 * r.slot // len(out)][who // 1000] += b - a
    shares = [[q[s] / sum(q.values()) for s in range(3)] for q in quarters]
    placed = {s: [] for s in range(3)}
    for r in mixing.mix(given, whole_rows=True).collect():
        placed[r.doc_id // 1000] += [p.position for p in r.placements]
    order = sorted((x, s) for s, v in placed.items() for x in v)
    for quarter in range(4):
        own = Counter(s for _, s in order[quarter * len(order) // 4 : (quarter + 1) * len(order) // 4])
        assert all(abs(own[s] / sum(own.values()) - shares[quarter][s]) < 0.05 for s in range(3))
    assert shares[0][0] > shares[3][0] + 0.1 and shares[3][2] > shares[0][2] + 0.02
