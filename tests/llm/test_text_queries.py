"""The registered queries over a whole small table, against SQL or brute force."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_operators import leaks_by_definition, naive_fingerprint, statistics

from tideline.llm import binary, catalog, suffixes, tokens

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    path = f"{FOLDER}/documents.parquet"
    duck.execute(f"create view documents as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    frame = catalog.queries()[name](spark, FOLDER)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in frame.collect())
    assert got == Counter(tuple(map(plain, row)) for row in cursor.fetchall())


def test_op2(spark, texts):
    n, where = suffixes.LONG, {}
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            where.setdefault(tuple(w[k : k + n]), set()).add(i)
    expected = {(i, k + j) for i, w in words.items() for k in range(len(w) - n + 1) if len(where[tuple(w[k : k + n])]) > 1 for j in range(n)}
    got = [(r.doc_id, k) for r in catalog.op2_suffix_dedup(spark, FOLDER).collect() for k in range(r.begin, r.end)]
    assert len(got) == len(set(got)) and set(got) == expected and expected


def test_op3(spark, texts):
    model = tokens._model(catalog.tokenizer("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in catalog.op3_token_counts(spark, FOLDER).collect()}
    assert got == {i: (len(t.encode()), n := model.count([t])[0], n > 4096) for i, t in texts.items()}


def test_op5(spark, texts):
    prints = {i: naive_fingerprint(t) for i, t in texts.items()}
    component = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, p in prints.items():
            least = min(component[j] for j, q in prints.items() if (p ^ q).bit_count() <= 3)
            changed |= least != component[i]
            component[i] = least
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.op5_simhash(spark, FOLDER).collect()}
    assert got == {i: (f"{p:016x}", component[i]) for i, p in prints.items()}


def test_op6(spark, texts):
    rows = sorted(catalog.op6_binary_output(spark, FOLDER).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    encode = binary._encoding(catalog.tokenizer("byte_bpe_50k.tiktoken")).encode_ordinary
    found = {}
    for k in np.argsort(binary.slots(np.arange(len(rows)), len(rows), inverse=True)):
        r = rows[k]
        for who, a, b in zip(r.doc_ids, r.begins, [*r.begins[1:], r.n_tokens]):
            found.setdefault(who, []).extend(np.frombuffer(bytes(r.tokens), "<u2")[a:b].tolist())
    assert found == {i: [*encode(t), 50_256] for i, t in texts.items()}
    stride = 2 * binary.LENGTH
    for r in rows[:: max(1, len(rows) // 20)]:
        with open(r.path, "rb") as file:
            file.seek(r.byte_offset)
            assert file.read(stride) == bytes(r.tokens)


def test_op8(spark, texts):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for r in catalog.op8_quality_rules(spark, FOLDER).collect():
        n = statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
        assert quality.get(r.doc_id) != 1 or r.base_failed or r.kept


def test_op9(spark, texts):
    """By the definition of a leak, for items that have enough words in the document at all."""
    benchmark = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in catalog.op9_decontamination(spark, FOLDER).collect()}
    expected = set()
    for i, t in texts.items():
        words = re.findall(r"\w+", t.lower())
        have = set(words)
        for j, item in benchmark.items():
            if sum(w in have for w in item) >= min(11, 0.8 * len(item)) and leaks_by_definition(item, words):
                expected.add((i, j))
    assert got == expected and got
