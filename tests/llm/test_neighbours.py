"""Nearest vectors against brute force; probe order; odd rows."""

import math
import random

import numpy as np
import pytest

from eventframe.llm import neighbours, queries
from eventframe.llm.neighbours import Hashing
from eventframe.llm.texts import table


def brute(rows, count=5, every=50):
    """(query id, rank, vec id, score) by comparing every query with every row."""
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array([i for i, _ in sound])
    matrix = np.array([v for _, v in sound], np.float64)
    out = set()
    for query in {i for i in ids.tolist() if i % every == 0}:
        best = {}
        for vector in matrix[ids == query]:
            for other, score in zip(ids.tolist(), neighbours.cosines(matrix, vector).tolist()):
                if other != query:
                    best[other] = max(score, best.get(other, -2))
        for rank, (other, score) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:count], 1):
            out.add((query, rank, other, score))
    return out


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, ids int, query string").repartition(4)


def test_probes_come_in_order_of_chance():
    hashing = Hashing(8, tables=1, projections=3, target=0.9)
    place = np.array([0.2, -3.5, 7.9])
    probes = hashing.probes(place)
    spread = (2 - 2 * hashing.near) ** 0.5
    cdf = lambda x: 0.5 * (1 + math.erf(x / 2**0.5))
    chance = [math.prod(cdf((c + 1 - p) * hashing.width / spread) - cdf((c - p) * hashing.width / spread) for c, p in zip(probe, place)) for probe in probes]
    assert chance == sorted(chance, reverse=True) and len({tuple(p) for p in probes.tolist()}) == len(probes)
    assert sum(chance) >= 0.9 > sum(chance[:-1])
    assert probes[0].tolist() == [0, -4, 7]


@pytest.mark.parametrize("kind,block_rows", [("float", 4096), ("double", 64)])
def test_clustered_vectors(spark, kind, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    vectors = centres[rng.integers(0, 40, 1500)] + 0.2 * rng.standard_normal((1500, 16))
    vectors[200:800] = vectors[200]  # one vector fills a large part
    vectors[900:1100] = vectors[900] + 0.01 * rng.standard_normal((200, 16))
    if kind == "float":
        vectors = vectors.astype(np.float32)
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(vectors)]
    got = {tuple(r) for r in neighbours.search(frame(spark, rows, kind), block_rows=block_rows).select("query_id", "rank", "vec_id", "score").collect()}
    wanted = brute(rows)
    assert len(got) == len(wanted)
    assert len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in wanted}) >= 0.95 * len(wanted)
    hot = lambda rows: sorted(r for r in rows if r[0] in (250, 300, 800 - 50))
    assert hot(got) == hot(wanted)


def test_recall_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, sf_dir, "embeddings").collect()]
    got = {(r.query_id, r.vec_id) for r in queries.op10_neighbours(spark, sf_dir).collect()}
    wanted = {(q, v) for q, _, v, _ in brute(rows)}
    assert len(got) == len(wanted) and len(got & wanted) >= 0.9 * len(wanted)


def test_queries_with_too_many_buckets_are_compared_with_all(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(rng.standard_normal((600, 24)))]
    monkeypatch.setattr(neighbours, "MOST_PROBES", 64)
    assert Hashing(24, projections=8, width=1.0).probes(np.zeros(8)) is None
    got = {tuple(r) for r in neighbours.search(frame(spark, rows, "double"), projections=8, width=1.0).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    rnd = random.Random(6)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, -1.0]), (4, [0.0, -1.0]), (5, None), (6, []), (7, [0.0, 0.0]),
            (8, [nan, 1.0]), (9, [1.0, None]), (10, [inf, 1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (150, [-1.0, -1e-3]), (11, [1e-30, 1e-30])]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(frame(spark, rows, "double")).collect()}
    assert got == brute(rows)
    few = [(0, [1.0, 2.0]), (50, [2.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    assert {(r.query_id, r.vec_id) for r in neighbours.search(frame(spark, few)).collect()} == {(0, 50), (50, 0)}
    assert neighbours.search(frame(spark, [(50, [1.0, 2.0])])).count() == 0
    assert neighbours.search(frame(spark, [])).count() == 0
    assert neighbours.search(frame(spark, [(1, None), (50, [0.0])])).columns == ["query_id", "rank", "vec_id", "score"]
