"""Clustering of groups too large for one task."""

import numpy as np

from corpusmill.operators import cluster


def frame(spark, groups):
    rows = [(name, i, [float(v) for v in x]) for name, xs in groups.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "g string, k int, v array<double>").repartition(3)


def clustered(df, kmax, **settings):
    out = {}
    for r in cluster.cluster_groups(df, "g", "k", "v", kmax, **settings).collect():
        assert r.part == 0
        out.setdefault(r.g, {})[r.k] = r.cluster
    return {g: [c[i] for i in sorted(c)] for g, c in out.items()}


def blobs(seed, *parts):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (n, 4)) for c, s, n in parts])
    rng.shuffle(x)
    return x


def test_large_groups_are_clustered_whole(spark):
    """Groups of more rows than a task takes get the clusters of the plain method, and one numbering, whatever their blocks.

    Far pairs merge early, though their merges are among the highest: such merges are undone for the cuts.
    """
    groups = {
        "three": blobs(4, (0, 0.3, 14), (3, 0.3, 10), (6, 0.3, 12)),
        "far": np.concatenate([blobs(5, (0, 1, 30)), [[90, 0, 0, 0], [90, 30, 0, 0], [-90, 0, 40, 0], [-90, 0, 0, 9]]]),
        "copies": np.repeat(blobs(6, (0, 0.2, 12), (5, 0.2, 12)), 2, axis=0),
        "loose": blobs(7, (0, 1, 40)),
        "small": blobs(8, (0, 0.1, 3), (4, 0.1, 3)),
    }
    wanted = {g: list(cluster.speakers(x, 6)) for g, x in groups.items()}
    assert clustered(frame(spark, groups), 6, most=14, block=10) == wanted
    assert len(set(wanted["three"])) == 3


def test_ties(spark):
    """Pairs at equal distances, apart from each other, and equal rows."""
    square = [(10 * a + da, 10 * b + db) for a in range(2) for b in (0, 30) for da, db in ((0, 0), (0, 1), (1, 0), (1, 1))]
    x = np.array(square + square[:7], float)
    assert clustered(frame(spark, {"g": x}), 5, most=6, block=9)["g"] == list(cluster.speakers(x, 5))


def test_few_different_rows(spark):
    x = np.array([[0.0, 1.0]] * 30)
    assert clustered(frame(spark, {"one": x, "two": np.concatenate([x, x + 1])}), 6, most=10) == {"one": [0] * 30, "two": [0] * 30 + [1] * 30}


def test_a_group_is_one_part(spark):
    n = cluster.MOST_ROWS + 1
    rows = [("g", i, [float(10 * (i % 3)) + (i % 7) / 10, float(i % 5) / 10]) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, v array<double>")
    got = cluster.cluster_groups(df, "g", "k", "v", 6).collect()
    assert len(got) == n and {r.part for r in got} == {0}
    assert len({(r.k % 3, r.cluster) for r in got}) == 3
