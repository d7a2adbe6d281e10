"""Vector operators against brute force."""

import numpy as np
import pytest

from doclake.llm import polytope, topk
from doclake.llm.polytope import near_vectors
from doclake.llm.topk import top_k
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, node string, v int, score string"


def clustered(n=400, d=24, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, d))
    x = centers[rng.integers(0, 20, n)] + rng.normal(size=(n, d)) * rng.choice([0.05, 0.15, 0.25, 1.0], (n, 1))
    x[50:90] = x[50]  # copies
    return x.astype(np.float32)


ODD = [(9001, None), (9002, []), (9003, [0.0] * 24), (9004, [float("nan")] * 24), (9005, [float("inf")] + [0.0] * 23), (9006, [None] * 24), (None, [1.0] * 24), (9007, [1.0, 2.0]), (9008, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA).repartition(3)


def brute_links(rows, cosine):
    one = {i: np.asarray(v, dtype=np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: {j for j in one if i != j and len(one[j]) == len(one[i]) and one[i] @ one[j] / np.linalg.norm(one[i]) / np.linalg.norm(one[j]) >= cosine} for i in one}
    return links


@pytest.mark.parametrize("together", [2048, 16])
def test_near_vectors(spark, together):
    rows = [(i * 3, v.tolist()) for i, v in enumerate(clustered())] + ODD + [(0, clustered()[0].tolist())]
    got = {r.vec_id: r for r in near_vectors(frame(spark, rows), "vec_id", "embedding", together=together).collect()}
    assert len(got) == len({i for i, _ in rows})
    links = brute_links(rows, 0.95)
    found = sum(got[i].n_links for i in links)
    assert found <= sum(map(len, links.values()))
    assert found >= 0.98 * sum(map(len, links.values()))
    for i, r in got.items():
        assert r.n_links <= len(links.get(i, ()))
        assert r.kept == (r.component_id == i) or i is None
        if i not in links:
            assert (r.n_links, r.component_id) == (0, i)
    full = {i for i in links if got[i].n_links == len(links[i])}
    for i in full:
        assert {got[j].component_id for j in links[i]} <= {got[i].component_id}


def test_every_code_depends_on_the_vector_alone():
    x = clustered()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = polytope.codes(unit, 4, 2, 3, 7)
    assert np.array_equal(a[10:20], polytope.codes(unit[10:20], 4, 2, 3, 7))
    assert all(len(set(row)) == 12 for row in a[:50].tolist())


def test_hadamard_keeps_norms():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(polytope.hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_vectors(empty, "vec_id", "embedding").collect() == []
    assert top_k(empty, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect() == []


@pytest.mark.parametrize("candidates,columns", [(8192, 8), (64, 5)])
def test_top_k(spark, candidates, columns):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered())] + ODD[:7] + [(9100, [1.0, 2.0]), (9200, [1.0, -2.0])]
    got = {}
    for r in top_k(frame(spark, rows), "vec_id", "embedding", F.col("vec_id") % 100 == 0, candidates=candidates, queries_at_once=2, columns=columns).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    whole = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in rows_] for i, rows_ in ((i, dict(rows)[i]) for i in whole)}
    want = {}
    for q in (i for i in whole if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q and len(whole[c]) == len(whole[q]))[:10]
        want[q] = [(k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}


def test_bounds_never_lose_a_candidate():
    rng = np.random.default_rng(4)
    for _ in range(30):
        v = rng.integers(-1000, 1000, (17, 300)) * (rng.random((17, 1)) < 0.5)
        v = v.astype(np.int64)
        q = v[:, 0]
        at, score = topk.best(q, topk.remaining_norms(q[:, None], 4)[:, 0], v, topk.remaining_norms(v, 4), np.arange(300), 0, 10, 4)
        want = sorted((-int(q @ v[:, j]), j) for j in range(1, 300))[:10]
        assert list(zip((-score).tolist(), at.tolist())) == want
