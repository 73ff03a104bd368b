"""Nearest neighbours over learned partitions against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from marketjobs.llm import ann

SCHEMA = "vec_id long, embedding array<double>, score double, rank string"


def brute(rows: list[tuple], every: int, k: int) -> dict[int, list[tuple]]:
    """rank order of (score, id) for each query id; rows: (id, vector)."""
    ok = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    ok = list({(i, tuple(v)) for i, v in ok})
    out = {}
    for i, v in ok:
        if i is not None and i % every == 0:
            found = []
            for j, w in ok:
                if j != i:
                    s = 0.0
                    for x, y in zip(v, w, strict=False):
                        s += x * y
                    found.append((-s, j is None, j if j is not None else 0))
            out[i] = [(None if none else j, -s) for s, none, j in sorted(found)[:k]]
    return out


def found(spark, rows, **how) -> dict[int, list[tuple]]:
    df = spark.createDataFrame([(i, v, 1.0, "x") for i, v in rows], SCHEMA).repartition(3)
    out: dict[int, list[tuple]] = {}
    for r in ann.neighbours(df, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_exact_in_one_part(spark):
    """Nulls, zeros, bad components, short vectors, ties, copies beyond k, a null id and a repeated row."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(90)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 1.0, -1.0]) for i in range(40)] + [(None, [9.0, 9.0, 9.0, 9.0, 9.0]), (7, [3.0] * 5), (7, [3.0] * 5), (8, [1.0, 1.0])]
    rows += [(200, None), (220, [0.0] * 5), (240, [1.0, None]), (260, [float("nan"), 1.0]), (280, [float("inf")]), (300, [])]
    assert found(spark, rows, every=10, k=20) == brute(rows, 10, 20)


def test_fewer_candidates_than_k(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(5)]
    got = found(spark, rows, every=2, k=20)
    assert got == brute(rows, 2, 20) and all(len(v) == 4 for v in got.values())
    assert found(spark, [], every=2) == {} and found(spark, [(3, [1.0])], every=2) == {}


@pytest.mark.parametrize("kind", ["clusters", "norms", "copies"])
def test_recall(spark, kind):
    """Held against brute force where many parts are searched, in several chunks and blocks."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 16))[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    if kind == "norms":
        x *= rng.exponential(1.0, (3000, 1))
    if kind == "copies":
        x[rng.random(3000) < 0.35] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = found(spark, rows, every=20, k=20, per_part=64, sample=1024, chunk=100)
    s = x[::20] @ x.T
    hits = 0
    for q, scores in zip(range(0, 3000, 20), s, strict=True):
        order = [j for j in np.lexsort((np.arange(3000), -np.round(scores, 10))) if j != q][:20]
        assert len(got[q]) == 20 and len({j for j, _ in got[q]}) == 20
        assert all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for a, b in zip(got[q], got[q][1:], strict=False))
        hits += len({j for j, _ in got[q]} & set(order))
        np.testing.assert_allclose([v for _, v in got[q]], x[[j for j, _ in got[q]]] @ x[q], rtol=1e-12)
    assert hits / (20 * len(s)) >= 0.93


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((8, 12))[np.arange(1024) % 8] * 3 + rng.standard_normal((1024, 12))
    x = ann.lifted(x, float(np.linalg.norm(x, axis=1).max()))
    a, b = ann.graph(x)
    label = ann.balanced(a, b, len(x), 3, np.random.default_rng(1))
    assert np.bincount(label).tolist() == [128] * 8
    assert np.mean(label[a] != label[b]) < 0.35 < np.mean(rng.permutation(label)[a] != label[b])
    share = np.zeros((len(x), 8))
    np.add.at(share, (a, label[b]), 1.0)
    router = ann.classifier(x, share / share.sum(axis=1, keepdims=True), 1.0)
    assert np.mean(router.probabilities(x).argmax(axis=1) == label) > 0.7
