"""Clusters by annulus search against plain arithmetic on Python integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from rivulet.llm.annulus import Annuli, clusters, op12_centroid_clusters
from rivulet.llm.queries import ORACLE_SQL

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string"


def plain(rows, k=8, rounds=10, dim=64):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(vectors, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, v in vectors:
            own.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    return sorted((i, n, d) for i, v in vectors for d, n in [nearest(v)]), centroids


def fits(distance):
    return distance if distance < 1 << 63 else None


def table(spark, rows):
    return spark.createDataFrame([(i, v, 5, "x") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("kind", ["ties", "many ties", "large", "few", "one"])
def test_against_plain_arithmetic(spark, kind):
    rng = random.Random(kind)
    size = {"few": 5, "one": 1}.get(kind, 120)
    value = {"ties": lambda: rng.choice([-0.5, 0, 0.5]), "many ties": lambda: float(rng.random() < 0.02), "large": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 7)}.get(kind, lambda: rng.gauss(0, 1))
    rows = [(i, np.float32([value() for _ in range(64)]).tolist()) for i in range(size)]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] + [1.0] * 63), (906, [float("inf")] + [1.0] * 63), rows[0]]
    got, centroids = clusters(table(spark, rows).repartition(3))
    want, finals = plain(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, n, fits(d)) for i, n, d in want), key=str)
    assert centroids == finals


def test_largest_floats(spark):
    """Components beyond any long: exact centroids, and null for what a long cannot hold."""
    rows = [(i, [(3.0e38 if i % 2 else -3.0e38) * (1 + i / 1000)] + [0.25] * 63) for i in range(12)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    got, centroids = clusters(table(spark, rows), k=2)
    want, finals = plain(rows, 2)
    assert centroids == finals
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, n, fits(d)) for i, n, d in want), key=str)


def test_only_the_annulus_is_compared():
    centroids = [[i * 1000] + [0] * 63 for i in range(50)]
    annuli = Annuli(centroids)
    seen = []
    inner = annuli.apart
    annuli.apart = lambda x, at: seen.append(len(x)) or inner(x, at)
    x = np.zeros((200, 64), np.int64)
    x[:, 0] = np.arange(200) * 245
    cluster, apart = annuli.nearest(x)
    assert [(int(c), int(d)) for c, d in zip(cluster, apart, strict=True)] == [(n, d) for v in x.tolist() for d, n in [min(((v[0] - c[0]) ** 2, n) for n, c in enumerate(centroids))]]
    assert sum(seen) < 3 * len(x)


def test_odd_tables(spark):
    assert clusters(spark.createDataFrame([], SCHEMA))[0].collect() == []
    got, _ = clusters(table(spark, [(None, [0.5] * 64), (None, [0.5] * 64), (1, [2.0] * 64)]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1, 0), (None, 1, 0), (1, 0, 0)], key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    rel = con.sql(ORACLE_SQL["op12_centroid_clusters"])
    got = op12_centroid_clusters(spark, f"/root/testdata/{sf}")
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
