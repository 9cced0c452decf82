"""Each operator against brute force, and with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import os
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.durable import shared_folder
from tideline.llm import binary, decontaminate, licences, lines, mixing, quality, secrets, simhash, suffixes, tokens
from tideline.llm.catalog import tokenizer

#: Extra columns with names that operators use inside.
DOCS = "doc_id long, text string, lang string, source string, size long, k1 long, row string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, *(("en", "s") if len(r) == 2 else ()), -1, -1, "x", "y") for r in rows], DOCS)


def prose(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "null id with some words in it"), (5, "twice the same row"), (5, "twice the same row"), (6, "Ünï çødé 日本語 😀 ﬁ"), (7, "x" * 70_000), (8, "a b " * 20_000)]


def test_mixing(spark):
    draw = random.Random(1)
    rows = [(k, prose(draw, draw.randint(1, 60)), "en", f"s{k % 5}") for k in range(200)] + [(k, prose(draw, 10), "en", "hot") for k in range(200, 420)] + [(500, "only one here", "en", None), (501, None, "en", "s1"), (7, "again a row", "en", "s2"), (7, "again a row", "en", "s2")]
    frame = docs(spark, rows)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, total = {}, 1.5 * sum(sizes.values())
    free = set(names)
    while True:  # share again what is over the limits
        left = total - sum(target.values())
        over = {s for s in free if left * weights[s] / sum(weights[x] for x in free) > 2 * sizes[s]}
        if not over:
            target |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    taken = Counter()
    by_id = {r[0]: r[3] for r in rows}
    for r in got:
        source = by_id[r.doc_id]
        assert r.target == pytest.approx(target[source]) and r.source_size == sizes[source] and r.taken <= 2 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.mix(frame.repartition(7)).collect()
    key = lambda x: sorted((r.doc_id, r.taken, [(p.copy, p.words, p.position) for p in r.placements]) for r in x)
    assert key(got) == key(again)
    order = mixing.training_order(frame)
    assert order.columns == frame.columns
    whole = Counter()
    for r in order.collect():
        whole[by_id[r.doc_id]] += len(WORD.findall(r.text))
    assert all(abs(whole[s] - target[s]) <= 60 for s in names if sizes[s] > 100)
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.training_order(docs(spark, ODD)).count() > 0


def test_mixing_sources_without_words(spark):
    rows = [(1, "a b c", "en", "x"), (2, "", "en", "y"), (3, None, "en", "y"), (None, None, "en", "x")]
    got = {r.doc_id: r for r in mixing.mix(docs(spark, rows)).collect()}
    assert (got[2].target, got[2].taken, got[3].source_size, got[1].target, got[1].taken, got[None].size) == (0.0, 0, 0, 4.5, 5, 0)
    for rows in ([(1, "")], [(1, None), (None, None)]):
        assert [(r.target, r.taken, r.placements) for r in mixing.mix(docs(spark, rows)).collect()] == [(0.0, 0, [])] * len(rows)
        assert mixing.training_order(docs(spark, rows)).count() == 0
    (one,) = mixing.mix(docs(spark, [(1, "word")])).collect()
    assert (one.size, one.target, one.taken) == (1, 1.5, 2)
    same = mixing.mix(docs(spark, [(None, f"null id {k}") for k in range(400)]))
    assert same.count() == 400 and same.agg({"taken": "sum"}).first()[0] == 1800


def test_mixing_schedule(spark):
    knots = [(0.0, 1.0), (0.25, 3.0), (1.0, 0.5)]
    share = [k / 50 for k in range(51)]
    frame = spark.createDataFrame([(s,) for s in share], "s double")
    got = [r[0] for r in frame.select(mixing._time(F.col("s"), knots)).collect()]
    area = lambda u: np.trapezoid(np.interp(x := np.linspace(0, u, 20001), *zip(*knots)), x)
    assert [area(u) / area(1.0) for u in got] == pytest.approx(share, abs=1e-6)


def test_suffix_repeats(spark, monkeypatch):
    draw = random.Random(2)
    shared, short, own = prose(draw, 60), prose(draw, 49), prose(draw, 80)
    rows = [(k, f"{prose(draw, 30)} {shared} {prose(draw, 20)}") for k in range(6)] + [(k, f"{prose(draw, 25)} {short} {prose(draw, 25)}") for k in range(10, 14)]
    rows += [(20, f"{own} {own}"), (21, (own2 := prose(draw, 300))), (22, own2), (23, own2.replace("w1 ", "v1 ")), (30, "ha " * 500), (31, "ha " * 400), *ODD]
    # windows that agree with different texts left and right
    left, mid, right = prose(draw, 30), prose(draw, 30), prose(draw, 30)
    rows += [(40, f"{left} {mid} {right}"), (41, f"{left} {mid} zz"), (42, f"yy {mid} {right}")]
    texts = {(i, t or "") for i, t in rows}
    where = {}
    for who in texts:
        words = who[1].encode().lower().split()
        for k in range(len(words) - suffixes.LONG + 1):
            where.setdefault(tuple(words[k : k + suffixes.LONG]), set()).add(who)
    expected = set()
    for who in texts:
        words, found = who[1].encode().lower().split(), []
        for k in range(len(words) - suffixes.LONG + 1):
            if len(where[tuple(words[k : k + suffixes.LONG])]) > 1:
                if found and found[-1][1] >= k:
                    found[-1][1] = k + suffixes.LONG
                else:
                    found.append([k, k + suffixes.LONG])
        expected |= {(who[0], a, b) for a, b in found}
    frame = docs(spark, rows)
    for hot, texts_sent in ((suffixes.HOT, suffixes.SEND_TEXTS), (2, 0)):
        monkeypatch.setattr(suffixes, "HOT", hot)
        monkeypatch.setattr(suffixes, "SEND_TEXTS", texts_sent)
        got = suffixes.repeats(frame).collect()
        assert {(r.doc_id, r.begin, r.end) for r in got} == expected and all(r.partner_id != r.doc_id for r in got)
    assert {r.doc_id for r in got} >= {0, 5, 21, 22, 23, 30, 31} and not {r.doc_id for r in got} & {10, 20}
    assert suffixes.repeats(frame.limit(0)).count() == 0


def test_suffixes_are_compared_alike_in_any_pieces(monkeypatch):
    """Batches of any size, cut where first words change, against one batch."""
    draw = random.Random(3)
    texts = [[draw.choice("abcdef") * 3 for _ in range(20)] for _ in range(9)]
    rows = []
    for k in range(60):
        words = [w for _ in range(6) for w in texts[draw.randrange(9)]]
        words[draw.randrange(len(words))] = f"x{k}"
        h = suffixes.word_hashes(" ".join(words).encode(), suffixes._Hashes())
        at = suffixes.minimisers(h)
        at = at[at + suffixes.REACH <= len(h)]
        ahead, behind = suffixes._surroundings(h, at)
        rows += [(k // 2 if k % 7 else None, k, len(h), int(x), a.tobytes(), b.tobytes()) for x, a, b in zip(at, ahead, behind)]
    rows.sort(key=lambda r: r[4])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    every = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "k", "n", "at", "ahead", "behind"])
    found = []
    for size, at_once in ((len(rows), 10**6), (7, 1), (50, 30)):
        monkeypatch.setattr(suffixes, "AT_ONCE", at_once)
        found.append(Counter(map(str, (r for x in suffixes._neighbours(iter([every.slice(k, size) for k in range(0, len(rows), size)])) for r in x.to_pylist()))))
    assert found[0] == found[1] == found[2] and len(found[0]) > 30
    assert list(suffixes._neighbours(iter([every.slice(0, 0)]))) == []


def test_token_counts(spark):
    path = tokenizer("piece_bpe_32k.model")
    model = tokens._model(path)
    draw = random.Random(3)
    wild = "".join(draw.choice("ab cé日😀\n\t▁<s>0") for _ in range(3000))
    rows = [*ODD, (20, prose(draw, 2000)), (20, prose(draw, 2000)), (21, wild), (21, wild), (22, "</s> <unk> <0x0A> " * 300), (23, "abababab" * 2000)]
    frame = docs(spark, rows)
    expected = Counter((i, len((t or "").encode()), model.count([t or ""])[0]) for i, t in rows)
    for options in ({}, {"huge": 500, "chunk": 200, "overlap": 4}, {"huge": 50, "chunk": 40, "overlap": 1}):
        got = tokens.count_tokens(frame, path, **options).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert tokens.count_tokens(frame.limit(0), path).count() == 0
    parts = list(tokens.split(wild, model, 200, 2))
    assert len(parts) > 3 and "".join(t[a:b] for t, a, b in parts) == wild


def test_line_dedup(spark):
    draw = random.Random(4)
    often, seldom = "  The SAME line\t", "in nine only"
    rows = [(k, "\n".join([prose(draw, 5), often if k % 2 else "the same LINE", prose(draw, 4), "", *([seldom] if k < 9 else [])])) for k in range(40)] + ODD + [(k, None) for k in range(90, 102)]
    frame = docs(spark, rows)

    def brute(documents, keep=None):
        key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
        for i, t in rows:
            own = (t or "").split("\n")
            left = [x for x in own if seen[key(x)] < documents]
            yield i, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()

    for options in ({}, {"send_rows": 0}):
        got = lines.drop_repeated_lines(frame, **options).collect()
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == Counter(brute(10))
    got = {r.doc_id: r.kept_text for r in lines.drop_repeated_lines(frame, documents=2, keep_first=True).collect()}
    assert "the same LINE" in got[0] and "The SAME line" not in got[1] and seldom in got[0] and seldom not in got[5]
    tied = docs(spark, [(None, "a line\nown 1"), (None, "a line\nown 2"), (3, "b line"), (3, "b line\nmore"), (4, "b line"), (None, "b line")])
    for options in ({}, {"send_rows": 0}):
        got = Counter((r.doc_id, r.kept_text) for r in lines.drop_repeated_lines(tied, documents=2, keep_first=True, **options).collect())
        assert got == Counter([(None, "a line\nown 1"), (None, "a line\nown 2"), (3, "b line"), (3, "b line\nmore"), (4, ""), (None, "")])
    assert lines.drop_repeated_lines(frame.limit(0)).count() == 0


def test_bloom_filters_have_no_misses():
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 2**63, 5000).astype(np.uint64)
    bitmap = np.zeros(1 << 17, np.uint8)
    lines._set(bitmap, lines._places(hashes, 20))
    assert lines._has(bitmap, lines._places(hashes, 20)).all()
    assert lines._has(bitmap, lines._places(draw.integers(0, 2**63, 5000).astype(np.uint64), 20)).mean() < 0.01


def naive_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_components(spark):
    draw = random.Random(5)
    base = [prose(draw, 200) for _ in range(12)]
    rows = [(50 + k, b) for k, b in enumerate(base)] + [(100 + k, f"{b} extra") for k, b in enumerate(base)] + [(200 + k, b.upper()) for k, b in enumerate(base)] + ODD
    prints = {(i, t): naive_fingerprint(t or "") for i, t in rows}
    component = {}
    for p in set(prints.values()):
        todo, seen = [p], {p}
        while todo:
            a = todo.pop()
            for b in set(prints.values()) - seen:
                if (a ^ b).bit_count() <= 3:
                    seen.add(b)
                    todo.append(b)
        component[p] = min((i for (i, _), q in prints.items() if q in seen and i is not None), default=None)
    expected = Counter((i, f"{p:016x}", component[p]) for (i, t) in rows for p in [prints[i, t]])
    frame = docs(spark, rows)
    for dense in (simhash.DENSE, 1):
        got = simhash.components(frame, dense=dense).collect()
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
    assert simhash.components(frame.limit(0)).count() == 0
    kept = simhash.keep_one(frame, width=3)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == frame.columns and set(ids) == set(component.values()) and len(ids) == len(set(ids))


def test_covering_masks_and_centres_lose_no_pair(spark):
    keep = simhash.masks()
    draw = random.Random(6)
    for _ in range(2000):
        bits = sum(1 << b for b in draw.sample(range(64), draw.randint(1, 3)))
        assert any(not bits & m for m in keep)
    seed = draw.getrandbits(64)
    cluster = list({seed ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for _ in range(150)})
    frame = spark.createDataFrame([(simhash._signed(x),) for x in cluster], "point long")
    signed = [simhash._signed(x) for x in cluster]
    direct = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    for dense in (simhash.DENSE, 2):
        found = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(frame, dense=dense).collect()}

        def parts(edges):
            root = {x: x for x in signed}

            def top(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in edges:
                root[top(a)] = top(b)
            return {frozenset(x for x in signed if top(x) == top(y)) for y in signed}

        assert parts(found) == parts(direct)
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in found)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation_is_one_to_one(n):
    slots = binary.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert binary.permute(slots, n, inverse=True).tolist() == list(range(n))


def test_binary_round_trip(spark, tmp_path):
    path = tokenizer("byte_bpe_50k.tiktoken")
    draw = random.Random(7)
    rows = [(k, prose(draw, draw.randint(0, 120))) for k in range(100, 160)] + ODD
    encode = binary._encoding(path).encode_ordinary
    expected = Counter((i, tuple([*encode(t or ""), 50_256])) for i, t in rows)
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    frame = spark.read.parquet(str(tmp_path / "docs"))
    streams = []
    for number, (given, phases) in enumerate(((frame, 1), (docs(spark, rows), 1), (frame, 4), (docs(spark, rows).repartition(5), 1))):
        uri = f"file:{tmp_path}/shards{number}"
        got = sorted(binary.training_shards(given, path, uri=uri, length=32, per_shard=16, phases=phases).collect(), key=lambda r: r.slot)
        n = len(got)
        assert [r.slot for r in got] == list(range(n))
        index = binary.slots(np.arange(n), n, phases=phases, inverse=True)
        assert sorted(r.n_tokens for r in got)[1] == 32 and index.tolist() != list(range(n)) and sorted(index.tolist()) == list(range(n))
        assert phases == 1 or (index * phases // n == np.arange(n) * phases // n).mean() > 0.9
        stream, found = [], Counter()
        for k in np.argsort(index):  # back in the order of documents
            r = got[k]
            ids = np.frombuffer(bytes(r.tokens), "<u2")
            assert len(ids) == 32 and (r.shard, r.byte_offset) == (r.slot // 16, r.slot % 16 * 64) and len(r.doc_ids) == len(r.begins) and r.begins[0] == 0
            for who, a, b in zip(r.doc_ids, r.begins, [*r.begins[1:], r.n_tokens]):
                if not stream or stream[-1][1][-1] == 50_256:
                    stream.append((who, []))
                assert stream[-1][0] == who
                stream[-1][1].extend(ids[a:b].tolist())
        found = Counter((who, tuple(ids)) for who, ids in stream)
        assert found == expected
        streams.append([(r.doc_ids, bytes(r.tokens)) for r in got])
        # what stops can go on from any slot
        for first in (0, 1, 15, 16, n - 1, n):
            assert [(s, x.tobytes()) for s, x in binary.read_slots(uri, first, length=32, per_shard=16)] == [(r.slot, bytes(r.tokens)) for r in got[first:]]
        assert not [x for x in os.listdir(tmp_path / f"shards{number}") if x.startswith(".shard") and not x.endswith(".crc")]
    assert streams[1] == streams[3] != streams[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:  # the same files in other splits: the same slots
        again = binary.training_shards(frame, path, length=32, per_shard=16).orderBy("slot").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.doc_ids, bytes(r.tokens)) for r in again] == streams[0] and again[0].path is None
    assert {(r.first_slot, r.n_sequences) for r in binary.manifest(spark.createDataFrame([(r.shard, r.path, r.slot) for r in again[:40]], "shard long, path string, slot long")).collect()} == {(0, 16), (16, 16), (32, 8)}
    assert binary.training_shards(docs(spark, rows).limit(0), path).count() == 0


def test_binary_passes_hold_a_part_of_the_tokens(spark, tmp_path, monkeypatch):
    """Between passes a shuffle holds its part of the tokens at most, and in the end none but the shards do."""
    draw = random.Random(11)
    rows = [(k, " ".join(draw.choice("aeiou") + draw.choice("bdfgklmnprst") * draw.randint(1, 3) + str(draw.randint(0, 99_999)) for _ in range(400))) for k in range(300)]
    docs(spark, rows).repartition(6).write.parquet(str(tmp_path / "docs"))
    shared = Path(shared_folder(spark).removeprefix("file:"))
    tables, shuffled = set(shared.glob("table-*")), []
    local = [Path(x.getPath()) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f: f.stat().st_size for x in local for f in x.glob("*/shuffle_*.data") if f.exists()}
    before = set(shuffles())

    def stored(frame, *args, own=binary.store, **kwargs):
        out = own(frame, *args, **kwargs)
        for _ in range(50):  # executors delete them soon after
            held = sum(size for f, size in shuffles().items() if f not in before)
            if held < 50_000:
                break
            time.sleep(0.1)
        shuffled.append(held)
        return out

    monkeypatch.setattr(binary, "store", stored)
    out = binary.training_shards(spark.read.parquet(str(tmp_path / "docs")), tokenizer("byte_bpe_50k.tiktoken"), uri=f"file:{tmp_path}/shards", length=128, per_shard=64)
    got = out.collect()
    shuffled.append(sum(size for f, size in shuffles().items() if f not in before))
    size = sum(f.stat().st_size for f in (tmp_path / "shards").glob("shard-*.bin"))
    assert size > 900_000 and max(shuffled) < size / 2, (size, shuffled)
    assert not [x for x in set(shared.glob("table-*")) - tables if "tokens" in spark.read.parquet(str(x)).columns]
    # in ranges of shards and sorted by slot, whatever the passes
    assert [r.slot for r in got] == list(range(len(got))) and sum(len(r.tokens) for r in got) == size
    assert b"".join(bytes(r.tokens) for r in got) == b"".join(f.read_bytes() for f in sorted((tmp_path / "shards").glob("shard-*.bin")))
    monkeypatch.setattr(binary, "PASSES", 1)
    whole = binary.training_shards(spark.read.parquet(str(tmp_path / "docs")), tokenizer("byte_bpe_50k.tiktoken"), length=128, per_shard=64).collect()
    assert [r[4:] for r in whole] == [r[4:] for r in got]


def test_licences(spark):
    rows = [(1, "Some code.\nLicensed under the Apache License, Version 2.0.\nmore", "/a/x.py"), (2, "nothing here", "/a/b/c/y.py"), (3, "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "/a/b/LICENSE"), (4, "nothing", "/z/q.py"), (5, None, "/a/b/n.py"), (6, "", None), (None, "Released under the MIT License.", "/z/w.py"), (7, "nothing " * 9000, "/a/b/LICENSE.txt"), (8, "the license of poets", "/z/p.py"), (8, "the license of poets", "/z/p.py")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, path string, term string, k1 long")
    got = {r.doc_id: r for r in licences.scan(frame).collect()}
    assert {i: got[i].licence for i in (1, 2, 3, 4, 5, 6, None, 8)} == {1: "Apache-2.0", 2: None, 3: "MIT", 4: None, 5: None, 6: None, None: "MIT", 8: None}
    assert (got[2].effective, got[2].inherited_from, got[5].effective, got[4].effective, got[1].effective) == ("MIT", "a/b", "MIT", None, "Apache-2.0")
    assert licences.scan(frame).count() == len(rows) and licences.scan(frame.limit(0)).count() == 0


def test_wrapped_headers_and_whole_files(spark):
    gpl = "/*\n * Copyright (C) 2001 Somebody\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main;"
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n'
    bsd = "Copyright (c) 2003, Somebody. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice"
    mit = "MIT License\n\n" + licences.TEMPLATES["MIT"][-1].replace(" to ", "\nto ") + "\n\nThe above copyright notice shall be included."
    lgpl = gpl.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2.1")
    rows = [(1, gpl, "/a/b.c"), (2, apache, "/b/c.py"), (3, bsd, "/c/LICENSE"), (4, mit, "/d/COPYING"), (5, lgpl, "/e/f.c"), (6, gpl.replace("version 3", "version 2").replace("software:", "software;").replace("Foundation,", "Foundation;"), "/f/g.c"), (7, "All rights reserved.", "/g/h"), (8, "nothing", "/c/deep/er/x"), (9, "nothing", "/d/y"), (10, "nothing", "/zz/y"), (11, "nothing", "")]
    got = {r.doc_id: (r.licence, r.inherited_from, r.effective) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert {i: x[0] for i, x in got.items()} == {1: "GPL-3.0", 2: "Apache-2.0", 3: "BSD-3-Clause", 4: "MIT", 5: "LGPL-2.1", 6: "GPL-2.0", 7: "Proprietary", 8: None, 9: None, 10: None, 11: None}
    assert (got[8][1:], got[9][1:], got[10][1:], got[11][1:]) == (("c", "BSD-3-Clause"), ("d", "MIT"), (None, None), (None, None))


def test_own_templates_and_a_licence_in_the_root(spark, monkeypatch):
    own = {"House": ("Bring three apples to the kitchen and share them freely",)}
    rows = [(1, "Well.\nBring three apples to the kitchen and share them freely.\nBye.", "/LICENSE"), *((k, f"words {k}", f"/d{k % 7}/e{k % 3}/f.txt") for k in range(2, 60))]
    for most in (100_000, 0):  # the second time without a broadcast
        monkeypatch.setattr(licences, "small", lambda frame, most=most: frame if not most else F.broadcast(frame))
        got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), templates=own).collect()
        assert len(got) == len(rows) and {(r.effective, r.inherited_from) for r in got if r.doc_id > 1} == {("House", "")}
    with pytest.raises(ValueError):
        licences.trigger({"x": ("...",)})


def test_every_template_is_found_as_itself(spark):
    rows = [(k, t, n) for k, (n, t) in enumerate((n, t) for n, ts in licences.TEMPLATES.items() for t in ts if re.search(licences.TRIGGER, t))]
    assert len(rows) == sum(map(len, licences.TEMPLATES.values()))
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, name string"), path=F.lit(None)).collect()}
    assert {k: got[k].licence for k, _, _ in rows} == {k: n for k, _, n in rows}


def statistics(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(covered)


def test_quality(spark):
    draw = random.Random(8)
    clean = [(k, "\n".join(prose(draw, 20, 5000) for _ in range(draw.randint(3, 9))), "en" if k % 2 else None, "s") for k in range(300)]
    junk = [(1000 + k, " ".join(f"w{draw.randrange(5000)}{'#*$%'[k % 4] * 4}" for _ in range(120)), "en", "s") for k in range(10)]
    odd = [(2000 + k, t, "en", "t") for k, (_, t) in enumerate(ODD)] + [(3000, "a b c d a b c d a b c", "en", None), (3001, "same\nsame\n\n \nsame\nother", "en", None)]
    rows = clean + junk + odd
    frame = docs(spark, rows)
    texts = {r[0]: r[1] or "" for r in rows}
    got = {r.doc_id: r for r in quality.judge(frame).collect()}
    for i, r in got.items():
        n = statistics(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i, *_ in clean) and not any(got[i].kept for i, *_ in junk)
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.judge(frame.limit(0)).count() == 0 and quality.judge(docs(spark, clean[:5])).where("kept").count() == 5


def mcd_distances(rows):
    """Squared distances of rows of features under the estimate that the operator describes, with NumPy's linear algebra."""
    x = np.array(rows)
    floors = np.diag(np.square(quality.FLOOR))
    middle = lambda v, p: np.sort(v, axis=0)[int(np.ceil(p * len(v))) - 1]
    centre = middle(x, 0.5)
    covariance = np.diag(np.square(middle(np.abs(x - centre), 0.5) * 1.4826)) + floors

    def distance():
        off = x - centre
        return np.einsum("ij,ij->i", off @ np.linalg.inv(covariance), off)

    for _ in range(quality.STEPS):
        d = distance()
        inside = x[d <= middle(d, quality.HALF)]
        centre, covariance = inside.mean(axis=0), np.cov(inside.T, bias=True) * quality.CONSISTENT + floors
    inside = x[distance() <= quality.REWEIGHT]
    centre, covariance = inside.mean(axis=0), np.cov(inside.T, bias=True) + floors
    return distance()


def test_quality_against_an_own_estimate(spark):
    draw = random.Random(28)

    def text(k):
        lines = [prose(draw, draw.randint(5, 20), draw.choice((300, 3000))) for _ in range(draw.randint(8, 25))]
        if k % 3 == 0:
            lines += lines[: draw.randint(1, 4)]
        if k % 10 == 0:
            lines = [" ".join(w + "#" * draw.randint(0, 4) for w in x.split()) for x in lines]
        return "\n".join(lines)

    rows = [(k, text(k), ("en", "de", None)[k % 3], ("a", "b")[k % 2]) for k in range(420)] + [(900 + k, text(1), "fr", f"small{k % 9}") for k in range(60)] + [(990, text(1), "it", "few")]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    groups = {}
    for i, t, lang, source in rows:
        n, chars, symbols, twice, again = statistics(t)
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        if not got[i].base_failed:
            groups.setdefault((lang, source if lang not in ("fr", "it") else None), []).append((i, (np.log1p(n), chars / n, (symbols / n) ** 0.5, (twice / lines) ** 0.5, (again / n) ** 0.5)))
    rejected = 0
    for (lang, _), members in groups.items():
        if lang == "it":
            assert got[990].distance is None and got[990].kept
            continue
        assert len(members) >= 50
        for (i, _), d in zip(members, mcd_distances([x for _, x in members])):
            assert got[i].distance == pytest.approx(d, rel=1e-4, abs=1e-5) and got[i].kept == (d <= quality.CUTOFF)
            rejected += d > quality.CUTOFF
    assert rejected > 20
    renamed = docs(spark, rows[:60]).withColumnsRenamed({"doc_id": "id", "text": "body"})
    assert {r.doc_id for r in quality.judge(renamed, text="body", ident="id").collect()} == {r[0] for r in rows[:60]}


def test_decontamination(spark):
    draw = random.Random(9)
    items = [(k, prose(draw, n, 3000)) for k, n in enumerate((12, 30, 40, 60, 400, 7, 3))] + [(50, None), (None, "x y z q"), (51, ""), (52, prose(random.Random(9), 12, 3000))]
    item = dict(items)

    def edited(text, every):
        words = text.split()
        for k in range(3, len(words), every):
            words[k] = "changed"
        return " ".join(words)

    rows = [(10 + k, f"{prose(draw, 50)} {item[k].upper()}! {prose(draw, 30)}") for k in range(5)]
    rows += [(20 + k, f"{prose(draw, 40)} {edited(item[k], 7)} {prose(draw, 40)}") for k in (1, 2, 3, 4)]
    words = item[2].split()
    rows += [(30, f"{prose(draw, 20)} {' '.join(words[:15])} {' '.join(words[17:])}"), (31, " ".join(words[:10])), (32, prose(draw, 300)), (33, f"so {item[5]} then"), (34, " ".join(item[4].split()[200:230])), *ODD]
    frame, benchmark = docs(spark, rows), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    expected = {(10, 0), (10, 52), (11, 1), (12, 2), (13, 3), (14, 4), (21, 1), (22, 2), (23, 3), (24, 4), (30, 2), (33, 5), (34, 4)}
    for block in (decontaminate.BLOCK, 40):
        got = decontaminate.leaks(frame, benchmark, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
    assert all(r.similarity == 1.0 for r in got if r.doc_id < 20)
    clean = decontaminate.drop_leaks(frame, benchmark)
    assert clean.columns == frame.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in {d for d, _ in expected})
    assert decontaminate.leaks(frame.limit(0), benchmark).count() == 0 and decontaminate.leaks(frame, benchmark.limit(0)).count() == 0


def leaks_by_definition(item, text):
    """Whether eleven equal words stand in order with two edits at most, or the whole item with a fifth of its words edited."""
    n, m = len(item), len(text)
    most = [[[0] * (m + 1) for _ in range(n + 1)] for _ in range(3)]
    edits = [[0] * (m + 1)] + [[i] + [0] * m for i in range(1, n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = item[i - 1] == text[j - 1]
            edits[i][j] = min(edits[i - 1][j - 1] + (not same), edits[i - 1][j] + 1, edits[i][j - 1] + 1)
            for e in range(3):
                most[e][i][j] = max(most[e][i - 1][j - 1] + 1 if same else 0, *((most[e - 1][i - 1][j - 1], most[e - 1][i - 1][j], most[e - 1][i][j - 1]) if e else (0,)))
    span = n >= 13 and max(map(max, most[2])) >= 11
    return span or min(edits[n]) <= (n // 5 if n > 6 else n == 6)


def test_leaks_by_definition(spark):
    draw = random.Random(19)
    items = [(k, prose(draw, draw.randint(7, 40), 500)) for k in range(40)]
    rows = []
    for k in range(300):
        words = list(draw.choice(items)[1].split())
        if draw.random() < 0.4:
            at = draw.randrange(len(words))
            words = words[at : at + draw.randint(11, 16)]
        for _ in range(draw.randint(0, 2 + len(words) // 4)):
            at = draw.randrange(len(words))
            words[at : at + draw.randint(0, 1)] = [f"new{draw.randrange(99)}"] * draw.randint(0, 1)
        rows.append((k, f"{prose(draw, 20, 500)} {' '.join(words)} {prose(draw, 20, 500)}"))
    whole = prose(draw, 60, 9000).split()
    sparse = [w if k % 4 else "other" for k, w in enumerate(whole)]
    items.append((90, " ".join(whole)))
    rows += [(900, " ".join([*whole[:13], *prose(draw, 10, 9000).split(), *sparse])), (901, " ".join([*sparse[20:], *whole[:13]])), (902, " ".join(sparse[20:]))]
    expected = {(i, j) for i, t in rows for j, x in items if leaks_by_definition(x.split(), t.split())}
    got = [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and {(900, 90), (901, 90)} <= expected and 100 < len(expected) < 300


def test_short_items_are_found_as_they_stand(spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "two plus"), (3, "one two three four five"), (4, "?!")], "item_id long, text string")
    rows = [(1, "in paris now"), (2, "two and plus"), (3, "two plus two"), (4, "so one two three four five"), (5, "one two three and five"), (6, "Paris"), (7, "two")]
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), items).collect()} == {(1, 1), (3, 2), (4, 3), (6, 1)}


def test_alignment_against_the_plain_recurrence():
    draw = random.Random(10)
    for _ in range(60):
        a, b = ([draw.randint(0, 4) for _ in range(draw.randint(1, 15))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y and x else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        score, equal, columns, *_ = decontaminate.align(np.array(a), np.where(np.array(b) == 0, -1, np.array(b)))
        assert score == max(map(max, h)) and equal - (columns - equal) == score


def test_secrets(spark):
    key = "AKIA" + "Q" * 16
    rows = [(10, f'é password = "hunter22" and Token:short and {key} x {key[:-1]} y'), (11, "deadbeef" * 4 + " secret: token: abcdefgh API_KEY=abc/def+9"), (12, "ghp_" + "a1B2" * 10 + " -----BEGIN RSA PRIVATE KEY-----"), (13, "https://user:pa55@host/ passwdpasswd='longenough'"), (14, "secret= abcdef secret=abcdef"), *ODD]
    frame = docs(spark, rows)
    kinds = (*secrets.BASE, *secrets.MORE)

    def spans(text):
        for rank, rule in enumerate(kinds):
            for m in re.finditer(rule.pattern, text):
                if len(m.group(rule.group)) >= rule.least:
                    yield m.start(), rank, rule.kind, m.end()

    expected = Counter((i, tuple(sorted(spans(t or "")))) for i, t in rows)
    for send in (200_000, 0):
        got = secrets.find_secrets(frame, send=send).collect()
        assert Counter((r.doc_id, tuple((s.start, s.rank, s.kind, s.end) for s in r.spans)) for r in got) == expected
    first = next(r for r in got if r.doc_id == 10)
    assert (first.n_assign, first.n_access, first.n_hex) == (1, 1, 0) and len(first.base_spans) == 2
    assert secrets.find_secrets(frame.limit(0)).count() == 0


def test_trigram_queries_hold_for_every_match():
    for rule in (*secrets.BASE, *secrets.MORE):
        query = secrets.trigram_query(rule.pattern)
        assert bool(query) == (rule.kind != "hex")
    samples = ["PASSWORD: abcdefg", "api_key=123456", "ApiKey = 'abcdef'", "AKIA" + "Z" * 20, "-----BEGIN EC PRIVATE KEY-----", "gho_" + "x" * 36, "xoxb-1234567890", "AIza" + "b" * 35, "sk_live_" + "c" * 20, "eyJabcdefgh.eyJabcdefgh.x", "pypi-" + "d" * 50, "npm_" + "e" * 36, "ftp://a:b@c", "glpat-" + "f" * 20]
    for text in samples:
        hit = [r for r in (*secrets.BASE, *secrets.MORE) if re.search(r.pattern, text)]
        assert hit, text
        for rule in hit:
            for clause in secrets.trigram_query(rule.pattern):
                assert any(all(g in text.lower() for g in option) for option in clause), (rule.kind, text)
    assert secrets.trigram_query("a|bcd") == [] and secrets.trigram_query("(abc|def)x*ghi") == [[frozenset({"abc"}), frozenset({"def"})], [frozenset({"ghi"})]]
