"""Clustering against all distances in Python's whole numbers, on vectors with ties, repeats, and what isn't kept."""

import hashlib
import math
import random

import numpy as np
import pytest

pytest.importorskip("patchlens.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from patchlens.llm import centroids, queries  # noqa: E402

SCHEMA = "vec_id bigint, embedding array<double>, label int, cluster string, x int, distance double"


def brute(vectors, k, rounds, seed):
    own = [(i, [math.floor(256 * e) for e in v]) for i, v in vectors if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [x for _, x in sorted(own, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in own]
        for j in set(of):
            mine = [x for (_, x), o in zip(own, of) if o == j]
            c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    told = [(i, *near(x)[::-1]) for i, x in own]
    total = sum(d for *_, d in told)
    return [(i, j, d, sum(e for _, o, e in told if o == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in told]


def vectors():
    r = random.Random(4)
    base = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    out = [(i, [e + r.gauss(0, 0.05) for e in r.choice(base)]) for i in range(150)]
    out += [(200 + i, [float(r.randrange(2))] * 64) for i in range(30)]  # equal vectors, equal distances
    out += [(-5, [r.uniform(-300, 300) for _ in range(64)]), (None, base[0]), (7, base[1]), (7, base[1]), (7, base[2])]
    out += [(300, None), (301, []), (302, base[0][:63]), (303, base[0] + [0.0]), (304, base[0][:63] + [None]), (305, base[0][:63] + [math.nan]), (306, base[0][:63] + [-math.inf])]
    return out


@pytest.mark.parametrize("k, rounds", [(12, 5), (40, 2), (500, 1), (1, 3)])
def test_against_all_distances(spark, k, rounds):
    rows = [(i, v, 1, "c", 2, 0.5) for i, v in vectors()]
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k, rounds, "2").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(vectors(), k, rounds, "2")))


def test_search_abandons_only_what_is_strictly_worse():
    r = np.random.default_rng(3)
    x, c = r.integers(-3, 3, (400, 64)), r.integers(-3, 3, (30, 64))
    c[17] = c[4]
    all_ = np.square(x[:, None] - c[None]).sum(2)
    best, bound = centroids.Search(c, r.permutation(64)).nearest(x)
    assert (best == all_.argmin(1)).all() and (bound == all_.min(1)).all()


def test_query_and_edges(spark, tmp_path):
    rows = [(i, v) for i, v in vectors()[:90]]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    single = [(i, [float(np.float32(e)) for e in v]) for i, v in rows]
    assert sorted(map(repr, map(tuple, queries.op12_centroid_clustering(spark, str(tmp_path)).collect()))) == sorted(map(repr, brute(single, 40, 5, "2")))
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(empty, 4, 2, "2").count() == 0
    assert centroids.cluster(empty, 4, 2, "2").columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    large = spark.createDataFrame([(1, [2.0**30] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(large, 1, 1, "2").collect()
    assert centroids.kept(spark.createDataFrame([(1, [0.5, -0.001] * 32)], "vec_id bigint, embedding array<double>")).select(F.slice("x", 1, 2)).first()[0] == [128, -1]
