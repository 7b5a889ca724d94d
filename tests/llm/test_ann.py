"""Against comparing every vector with every other."""

import numpy as np
import pytest

from larkspur.llm import ann as A
from tests.llm.helpers import SF_MORE, rows

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {i: {ids[j] for j in np.argsort(-s[n], kind="stable")[:k]} for n, i in enumerate(ids)}


def recall(frame, ids, x, k):
    got = {}
    for r in frame.collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    wanted = brute(ids, x, k)
    return np.mean([len(got.get(i, set()) & w) / k for i, w in wanted.items()])


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], SCHEMA)


def test_sample_vectors(spark):
    d = spark.read.parquet(f"{SF_MORE}/embeddings.parquet")
    p = d.toPandas()
    x = np.array(p.embedding.tolist(), np.float64)
    got = A.neighbours(d, 10)
    assert recall(got, p.vec_id.tolist(), x, 10) >= 0.95
    u = dict(zip(p.vec_id, x / np.linalg.norm(x, axis=1, keepdims=True)))
    for r in got.limit(300).collect():
        assert abs(r.similarity - u[r.vec_id] @ u[r.neighbour_id]) < 2e-5
    ranks = {}
    for r in got.collect():
        ranks.setdefault(r.vec_id, []).append((r["rank"], -r.similarity))
    assert all([a for a, _ in sorted(v)] == list(range(1, 11)) and [s for _, s in sorted(v)] == sorted(s for _, s in v) for v in ranks.values())


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall_with_many_cells(spark, spread):
    """On clustered and on shapeless data alike."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 32))
    x = centres[rng.integers(0, 20, 1500)] + spread * 2 * rng.standard_normal((1500, 32))
    assert recall(A.neighbours(table(spark, range(1500), x), 8, cell=100), list(range(1500)), x, 8) >= 0.9


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, centre = A.rotation(48, 3), np.zeros((1, 48), np.float32)
    assert np.allclose(turn @ turn.T, np.eye(48), atol=1e-5)
    cell, codes, norm, dot = A.encode(x, centre, turn)
    assert codes.shape == (4000, 6)
    found, width = A.estimate(x[:50], codes, norm, dot, centre[0], turn)
    error = found - x[:50] @ x.T
    off = ~np.eye(50, 4000, dtype=bool)
    assert abs(error[off].mean()) < 0.005
    assert (np.abs(error) <= width)[off].mean() > 0.93


def test_odd_rows(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 0.0]), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [0.0, 2.0]), (9, [1.0, None])]
    got = {(r.vec_id, r["rank"]): r.neighbour_id for r in A.neighbours(spark.createDataFrame(data, SCHEMA), 3).collect()}
    assert got[1, 1] == 2 and got[8, 1] == 2 and {i for i, _ in got} == {1, 2, 8} and (1, 3) not in got
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)
    got = {(r.vec_id, r["rank"]): r.neighbour_id for r in A.neighbours(same, 2).collect()}
    assert got[0, 1] == 1 and got[0, 2] == 2 and got[4, 1] == 0 and got[4, 2] == 1
    assert rows(A.neighbours(spark.createDataFrame([], SCHEMA))) == []
    assert rows(A.neighbours(spark.createDataFrame([(1, [1.0])], SCHEMA))) == []
    assert rows(A.neighbours(spark.createDataFrame([(1, [0.0, 0.0])], SCHEMA))) == []
    clash = spark.createDataFrame([(1, [1.0, 0.0], 3, 4), (2, [1.0, 0.0], 3, 4)], SCHEMA + ", id int, rank int")
    assert rows(A.neighbours(clash)) == [(1, 2, 1, 1.0), (2, 1, 1, 1.0)]


@pytest.mark.parametrize("parts,seed,cell", [(1, 1, 4096), (4, 2, 60), (7, 3, 25)])
def test_repeated_identifiers(spark, parts, seed, cell):
    """Of several vectors of an identifier the best counts, on both sides, however rows lie."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((260, 6))
    ids = np.concatenate([np.arange(200), rng.integers(0, 200, 60)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = np.full((200, 200), -9.0)
    np.maximum.at(like, (ids[:, None].repeat(260, 1), ids[None].repeat(260, 0)), u @ u.T)
    np.fill_diagonal(like, -9)
    order = rng.permutation(260)
    got = {}
    for r in A.neighbours(table(spark, ids[order], x[order]).repartition(parts), 5, recall=1.0, seed=seed, cell=cell).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = (r.neighbour_id, r.similarity)
    for i in range(200):
        best = np.sort(like[i])[::-1][:5]
        assert [got[i][k][1] for k in range(1, 6)] == pytest.approx(best, abs=2e-5) and all(abs(like[i, j] - s) < 2e-5 for j, s in got[i].values())
    with pytest.raises(TypeError):
        A.neighbours(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_cells_made_in_two_steps(spark, monkeypatch, spread):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 24))
    x = centres[rng.integers(0, 20, 1500)] + spread * 2 * rng.standard_normal((1500, 24))
    monkeypatch.setattr(A, "ONE_STEP", 5)
    d = table(spark, range(1500), x)
    got = A.neighbours(d, 8, cell=60)
    assert recall(got, list(range(1500)), x, 8) >= 0.9
    assert rows(got) == rows(A.neighbours(d.repartition(5), 8, cell=60))


def test_some_queries_against_all_rows(spark, monkeypatch):
    """Queries in several blocks, each row stored once whatever is asked, and neighbours that are no queries."""
    d = spark.read.parquet(f"{SF_MORE}/embeddings.parquet")
    p = d.toPandas()
    ids, x = p.vec_id.tolist(), np.array(p.embedding.tolist(), np.float64)
    wanted = {i: w for i, w in brute(ids, x, 10).items() if i % 50 == 0}
    for size in (1 << 25, 4 * 64 * 5):
        monkeypatch.setattr(A, "QUERIES", size)
        found = A.neighbours(d, 10, cell=100, every=50)
        got = {}
        for r in found.collect():
            got.setdefault(r.vec_id, set()).add(r.neighbour_id)
        assert got.keys() == wanted.keys() and all(len(g) == 10 for g in got.values())
        assert np.mean([len(got[i] & w) / 10 for i, w in wanted.items()]) >= 0.9
        assert any(n % 50 for g in got.values() for n in g)
