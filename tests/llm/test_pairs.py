"""Operators on pairs and the pipeline, held against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import document_rows, near, prose
from tests.llm.test_texts import base_spans
from watchtrail.llm import near_dedup, top_scores, vector_dedup
from watchtrail.llm.shared import components

WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingles(text: str | None) -> frozenset:
    words = WORDS.findall((text or "").encode().lower().decode())
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def smallest(nodes, links) -> dict:
    """The smallest node reachable from each."""
    parts = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(parts[a], parts[b])
            if parts[a] != least or parts[b] != least:
                parts[a] = parts[b] = least
                changed = True
    return parts


def brute(rows: list[tuple]) -> Counter:
    """(id, set size, component, kept) of (id, text) rows."""
    sets = [(d, shingles(t)) for d, t in rows]
    index, links, seen = defaultdict(list), [], set()
    for d, own in sets:
        if own in seen and d is not None:
            links.extend((d, e) for e, other in sets if other == own and e is not None)
        seen.add(own)
    links = [(a, b) for a, b in links if shingles_exist(a, sets)]
    for i, (_, own) in enumerate(sets):
        for s in own:
            index[s].append(i)
    pairs = Counter()
    for own in index.values():
        for i in own:
            for j in own:
                if i < j:
                    pairs[i, j] += 1
    for (i, j), both in pairs.items():
        if 100 * both >= 85 * (len(sets[i][1]) + len(sets[j][1]) - both) and None not in (sets[i][0], sets[j][0]):
            links.append((sets[i][0], sets[j][0]))
    parts = smallest({d for d, _ in sets if d is not None}, links)
    by_set = {}
    for d, own in sets:
        if own and d is not None:
            by_set[own] = min(by_set.get(own, d), d)
    found = Counter()
    for d, own in sets:
        part = (parts[by_set[own]] if own in by_set else d) if own else d
        found[d, len(own), part, d == part] += 1
    return found


def shingles_exist(doc_id, sets) -> bool:
    return any(own for d, own in sets if d == doc_id)


def test_near_duplicates(spark, documents, no_documents):
    rows = near_dedup.near_duplicates(documents).collect()
    assert Counter(map(tuple, rows)) == brute([r[:2] for r in document_rows()])
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Lists of many blocks, chains of near copies at the threshold, and a passage most documents hold."""
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 16)
    draw, texts, base, passage = random.Random(8), [], prose(1, 150), prose(2, 100)
    for i in range(120):
        text = base
        for at in draw.sample(range(150), draw.randint(0, 5)):
            text = near(text, at).replace("changed", f"w{i}x{at}")
        texts.append(text)
    chain = prose(5, 200)
    for i in range(25):
        chain = near(near(near(chain, 8 * i), 8 * i + 3), 8 * i + 6).replace("changed", f"c{i}")
        texts.append(chain)
    texts += [f"{passage} {prose(300 + i, draw.choice([5, 10, 20, 60]))}" for i in range(60)]
    draw.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = near_dedup.near_duplicates(docs).collect()
    want = brute(list(enumerate(texts)))
    assert Counter(map(tuple, rows)) == want
    assert 10 < sum(k[3] for k in want) < 150


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(9, 9)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert {(r["node"], r["component_id"]) for r in found.select("node", "component_id").collect()} == set(
        smallest(nodes, [x for x in links if x[0] != x[1]]).items()
    )
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows(n: int = 600, width: int = 16) -> list[tuple]:
    draw = np.random.default_rng(2)
    base = draw.normal(size=(n, width))
    for i in range(200, 420):
        base[i] = base[i % 7] + 0.02 * draw.normal(size=width)
    base[420:440] = base[1]
    rows = [(i, [float(x) for x in v], i % 3 if not 200 <= i < 440 else 1) for i, v in enumerate(base.astype(np.float32))]
    odd = [None, [], [0.0] * width, [float("nan")] + [1.0] * (width - 1), [float("inf")] * width, [None] + [1.0] * (width - 1)]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(1100, rows[0][1], None), (1101, [3.0, 4.0], 1), (1102, [3.0, 4.0], 1), (1103, [30.0, 40.0], 1), rows[5]]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(*r, "x", 1) for r in vector_rows()]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, part int").repartition(5)


def test_top_scores(spark, vectors, monkeypatch):
    monkeypatch.setattr(top_scores, "BLOCK_ROWS", 100)
    monkeypatch.setattr(top_scores, "QUERY_ROWS", 10)
    rows = top_scores.top_scores(vectors, F.col("vec_id") % 20 == 0, k=5).collect()
    valid = {i: v for i, v, _ in vector_rows() if v is not None and None not in v and np.isfinite(v).all()}
    ids = sorted(valid)
    matrix = top_scores.integers(pd.Series([valid[i] for i in ids])).astype(np.int64)
    want = []
    for at, query in enumerate(ids):
        if query % 20 == 0:
            order = sorted((-int(matrix[at] @ m), i) for i, m in zip(ids, matrix, strict=True) if i != query)[:5]
            want += [(query, rank, i, -s) for rank, (s, i) in enumerate(order, 1)]
    assert sorted(map(tuple, rows)) == sorted(want)
    few = vectors.filter("vec_id < 3")
    assert top_scores.top_scores(few, F.col("vec_id") == 0, k=5).count() == 2
    assert top_scores.top_scores(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_block_is_exact(seed):
    draw = np.random.default_rng(seed)
    scale = (0.02, 0.3, 50, 1e6)[seed]
    values = top_scores.integers(pd.Series(list(draw.normal(size=(700, 9)) * scale)))
    values[50:60] = values[40]
    ids = draw.permutation(2000)[:700]
    block = top_scores.Block(ids, values)
    for at in (0, 40, 55, 300):
        got, scores = block.top(values[at].astype(np.int64), 7, ids[at])
        want = sorted((-int(values[at].astype(np.int64) @ v), i) for i, v in zip(ids, values.astype(np.int64), strict=True) if i != ids[at])[:7]
        assert [(-int(s), int(i)) for i, s in zip(got, scores, strict=True)] == want


def test_near_vectors(vectors, monkeypatch):
    rows = {r["vec_id"]: r for r in vector_dedup.near_vectors(vectors).collect()}
    exact = brute_vectors(vector_rows()[:-1])
    assert {i: r["n_links"] for i, r in rows.items() if i != 5} == {i: n for i, (n, _) in exact.items() if i != 5}
    assert {i: r["component_id"] for i, r in rows.items()} == {i: c for i, (_, c) in exact.items()}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in rows.items())
    assert rows[5]["n_links"] == exact[5][0] + 1  # its repeated row
    assert vector_dedup.near_vectors(vectors.limit(0)).count() == 0
    # Small leaves and blocks: links may be missed, but none is made up or counted twice.
    monkeypatch.setattr(vector_dedup, "LEAF", 20)
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    some = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(vectors).collect()}
    assert all(some[i] <= rows[i]["n_links"] for i in rows)
    assert sum(some.values()) >= 0.95 * sum(r["n_links"] for r in rows.values())


def brute_vectors(rows: list[tuple]) -> dict:
    valid = [(i, np.array(v, dtype=float), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [
        (i, j)
        for i, v, c in valid
        for j, w, d in valid
        if i < j and c == d and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98
    ]
    degree = Counter(n for pair in links for n in pair)
    parts = smallest({r[0] for r in rows}, links)
    return {r[0]: (degree[r[0]], parts[r[0]]) for r in rows}


def test_pipeline_stages(spark, documents, no_documents, tmp_path):
    labels = [(i, int(t is None or "junk" not in t)) for i, t, *_ in document_rows() if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, documents, str(tmp_path))
    assert good.columns == documents.columns and good.filter("text like 'junk%'").count() == 0
    assert good.filter("score = 'extra'").count() > 20
    once = stages["near_dedup"](spark, documents, str(tmp_path))
    kept = {k[0] for k in brute([r[:2] for r in document_rows()]) if k[3]}
    ids = Counter(r["doc_id"] for r in once.collect())
    assert {i for i in ids if i is not None} == kept - {None} and max(ids[i] for i in kept - {None}) == 1
    clean = {r["doc_id"]: r for r in stages["secrets"](spark, documents, str(tmp_path)).collect()}
    for doc_id, text, *_ in document_rows():
        row = clean[doc_id]
        assert row["copy"] in ("extra", None)
        if doc_id is not None and base_spans(text or ""):
            assert "[secret]" in row["text"] and not base_spans(row["text"]) and row["n_chars"] == len(row["text"])
        elif doc_id is not None:
            assert row["text"] == text
    mixed = stages["mix"](spark, once, str(tmp_path))
    assert mixed.columns == documents.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 4
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_documents, str(tmp_path)).count() == 0, name
    assert public_tokenizers.path("word_bpe_49k.json")


def test_pipeline_stages_send_small_batches(spark, no_documents, tmp_path):
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality", "near_dedup", "pack"):
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 25))
            stage(spark, no_documents, str(tmp_path))
            assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 22, name


def test_near_duplicates_sends_small_batches(spark, no_documents):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 25))
    assert near_dedup.near_duplicates(no_documents).count() == 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 22
