"""Speaker clustering: agglomerative (Ward) for each group, the number of clusters by the best silhouette.

A group of up to ``MOST_ROWS`` rows is clustered in one task. Larger ones go by rounds over all tasks: each cluster's nearest
one is found by blocks, and all pairs that are nearest to each other are merged at once. Ward's distance is reducible, that
is, a merged cluster is no nearer to others than its parts were, so that these merges are those of the plain method, only in
another order. The few clusters that are left are finished in one task. The merges of the rounds that are among the highest
of all are undone for the cuts into few clusters. Silhouettes are sums over blocks of pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.operators.relational import small_side
from corpusmill.sources.scratch import written

#: Up to this many rows a group's distances are held as a matrix in one task, in cubic time; rounds bring larger ones down to it.
MOST_ROWS = 2000
#: Clusters of a block; a task compares two blocks.
BLOCK = 2048


def squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs."""
    return np.array([((x - row) ** 2).sum(axis=1) for row in x]).reshape(len(x), len(x))


def ward(x: np.ndarray) -> list[tuple[int, int]]:
    """Merges in order, by the Lance-Williams update of squared distances; of equal distances the first pair."""
    return [(i, j) for i, j, _ in ward_from(x, np.ones(len(x)))]


def ward_from(x: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """The same from clusters with their centres and sizes on, and the distance of each merge."""
    n = len(x)
    d = squares(x) * (2 * sizes[:, None] * sizes / (sizes[:, None] + sizes))
    np.fill_diagonal(d, np.inf)
    size, merges = sizes.astype(np.float64), []
    for _ in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        merges.append((i, j, float(d[i, j])))
        a, b, c = size[i], size[j], size
        with np.errstate(invalid="ignore"):
            row = ((a + c) * d[i] + (b + c) * d[j] - c * d[i, j]) / (a + b + c)
        d[i, :], d[:, i] = row, row
        d[i, i] = np.inf
        d[j, :], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return merges


def labels_at(merges: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    """Cluster numbers by first appearance when k are left."""
    parent = list(range(n))
    for i, j in merges[: max(0, n - k)]:
        parent[j] = i

    def root(v: int) -> int:
        while parent[v] != v:
            v = parent[v]
        return v

    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(v), len(seen)) for v in range(n)])


def silhouette(dist: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b) with Euclidean distances; 0 for a cluster of one."""
    return _silhouette(np.stack([dist[:, labels == c].sum(axis=1) for c in range(labels.max() + 1)], axis=1), labels)


def _silhouette(sums: np.ndarray, labels: np.ndarray) -> float:
    sizes = np.bincount(labels)
    own = sizes[labels]
    a = sums[np.arange(len(labels)), labels] / np.maximum(own - 1, 1)
    means = sums / sizes
    means[np.arange(len(labels)), labels] = np.inf
    b = means.min(axis=1)
    s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def speakers(x: np.ndarray, kmax: int = 10) -> np.ndarray:
    """No row: none; one or two rows: one speaker; else the k in [2, min(n, kmax)) with the best silhouette (smaller k first)."""
    n = len(x)
    if n <= 2:
        return np.zeros(n, int)
    merges = ward(x)
    if kmax == 2:
        return labels_at(merges, n, 2)
    tried = [labels_at(merges, n, k) for k in range(2, max(3, min(n, kmax)))]
    dist = np.sqrt(squares(x))
    return tried[int(np.argmax([silhouette(dist, t) for t in tried]))]


# Groups of more rows than a task takes


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """Rows (g, node, ...) once for each pair of blocks that theirs is in: lo, hi, and their own block ``own``.

    Blocks are dealt by hash, so that a group of any size makes blocks of about ``block`` rows.
    """
    counts = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # one row a large group
    dealt = rows.join(small_side(counts), "g").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix, without a Python number for each entry."""
    if column.null_count or len(sizes := pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors have different lengths")
    return pc.list_flatten(column).to_numpy().astype(np.float64).reshape(len(column), sizes[0].as_py() if len(sizes) else 0)


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows of the two blocks of a cell, and their vectors about a common middle."""
    own, lo = cell["own"].to_numpy(), cell["lo"][0].as_py()
    x = _vectors(cell["centre"])
    x = x - x.mean(axis=0)
    a = np.flatnonzero(own == lo)
    b = np.flatnonzero(own != lo) if cell["hi"][0].as_py() != lo else a
    return a, b, x[a], x[b]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0)


def _pair_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of nodes, the same from either side, by which equal distances are put in order."""
    lo, hi = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    h = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def _nearest(cell: pa.Table) -> pa.Table:
    """For each cluster of a cell its nearest in the other block: node, d, tie, partner."""
    a, b, x, y = _sides(cell)
    node, size = cell["node"].to_numpy(), cell["size"].to_numpy().astype(np.float64)
    d = _apart(x, y) * (2 * size[a][:, None] * size[b] / (size[a][:, None] + size[b]))
    same = len(b) and a is b
    if same:
        d = np.minimum(d, d.T)
        np.fill_diagonal(d, np.inf)
    out = []
    for rows, others, m in ((a, b, d),) if same else ((a, b, d), (b, a, d.T)):
        if not len(others) or (same and len(others) < 2):
            continue
        best = m.argmin(axis=1)
        least = m[np.arange(len(rows)), best]
        for i in np.flatnonzero((m == least[:, None]).sum(axis=1) > 1):  # ties, by the order of pairs
            tied = np.flatnonzero(m[i] == least[i])
            best[i] = tied[np.argmin(_pair_order(np.full(len(tied), node[rows[i]]), node[others[tied]]))]
        partner = node[others[best]]
        out.append((node[rows], least, _pair_order(node[rows], partner), partner))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["node", "d", "tie", "partner"])


def _round(clusters: DataFrame, block: int) -> DataFrame:
    """Pairs of clusters that are nearest to each other: lo, hi, d."""
    near = _cells(clusters, block).groupBy("g", "lo", "hi").applyInArrow(_nearest, "node long, d double, tie long, partner long")
    best = written(near.groupBy("node").agg(F.min(F.struct("d", "tie", "partner")).alias("best")).select("node", "best.partner", "best.d"))
    back = best.select(F.col("node").alias("partner"), F.col("partner").alias("node"))
    return best.filter("node < partner").join(back, ["node", "partner"]).select(F.col("node").alias("lo"), F.col("partner").alias("hi"), "d")


def _merged(clusters: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clusters after a round, and its merges: g, lo, hi, d and the least key of either part."""
    of = lambda side: clusters.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("g", "size", "centre", "least")])
    met = written(pairs.join(of("lo"), "lo").join(of("hi"), "hi"))
    size = F.col("size_lo") + F.col("size_hi")
    middle = F.zip_with("centre_lo", "centre_hi", lambda a, b: (F.col("size_lo") * a + F.col("size_hi") * b) / size)
    made = met.select(F.col("g_lo").alias("g"), F.col("lo").alias("node"), size.alias("size"), middle.alias("centre"), F.least("least_lo", "least_hi").alias("least"))
    gone = met.select(F.explode(F.array("lo", "hi")).alias("node"))
    return written(clusters.join(gone, "node", "left_anti").unionByName(made)), met.select(F.col("g_lo").alias("g"), "lo", "hi", "d", "least_lo", "least_hi")


def cuts(group: pa.Table, kmax: int) -> list[tuple[int, list[int] | None, bool]]:
    """(node, numbers of its cluster for k = 2 ... kmax - 1, whether its merge is undone) of the clusters left of a group.

    ``group`` has the clusters (kind 0) and the highest merges of the rounds (kind 1: node is hi, ``into`` is lo). A merge
    that is among the kmax - 2 highest of all is undone, with all above it, and made again in the cuts that still have it.
    """
    rows = group.to_pylist()
    left = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["least"])
    nodes, least = [r["node"] for r in left], {r["node"]: r["least"] for r in left}
    own = ward_from(np.array([r["centre"] for r in left], np.float64).reshape(len(left), -1), np.array([r["size"] for r in left], np.float64))
    merges = [(d, 1, n, nodes[i], nodes[j], None) for n, (i, j, d) in enumerate(own)]
    merges += [(r["d"], 0, r["round"], r["into"], r["node"], r) for r in rows if r["kind"] == 1]
    merges.sort(key=lambda m: m[:3])
    undone = [m[5] for m in merges[max(0, len(merges) - (kmax - 2)) :] if m[5]]
    for r in sorted(undone, key=lambda r: -r["round"]):  # back to what the parts were
        least[r["into"]], least[r["node"]] = r["least_lo"], r["least_hi"]
    names = sorted(least, key=least.get)
    kept = [m for m in merges if m[1] or m[5] in undone]
    place = {name: i for i, name in enumerate(names)}
    out = [labels_at([(place[a], place[b]) for _, _, _, a, b, _ in kept], len(names), k) for k in range(2, kmax)]
    gone = {r["node"] for r in undone}
    return [(name, [int(t[i]) for t in out], name in gone) for i, name in enumerate(names)]


def _cut(kmax: int):
    def run(group: pa.Table) -> pa.Table:
        found = cuts(group, kmax)
        columns = [[f[i] for f in found] for i in range(3)]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.list_(pa.int32()), pa.bool_()), strict=True)], names=["node", "labels", "undone"])

    return run


def _sums(ks: range):
    """For each row of a cell and each cut the sum of its distances to the rows of each cluster in the other block."""

    def run(cell: pa.Table) -> pa.Table:
        a, b, x, y = _sides(cell)
        node, size, labels = cell["node"].to_numpy(), cell["size"].to_numpy(), np.array(cell["labels"].to_pylist())
        d = np.sqrt(_apart(x, y))
        if a is b:
            np.fill_diagonal(d, 0)
        member = np.concatenate([np.eye(k)[labels[:, i]] * size[:, None] for i, k in enumerate(ks)], axis=1)
        out = [(node[a], d @ member[b])] + ([] if a is b else [(node[b], d.T @ member[a])])
        return pa.table([pa.array(np.concatenate([n for n, _ in out]), pa.int64()), pa.array([row for _, s in out for row in s.tolist()], pa.list_(pa.float64()))], names=["node", "sums"])

    return run


def _chosen(points: DataFrame, kmax: int, block: int) -> DataFrame:
    """g, choice: the place among the cuts (smaller k first) of the best mean silhouette. Points: g, node, size, centre, labels."""
    ks = range(2, kmax)
    wide = [(i, c) for i, k in enumerate(ks) for c in range(k)]
    sums = _cells(points, block).groupBy("g", "lo", "hi").applyInArrow(_sums(ks), "node long, sums array<double>")
    sums = sums.groupBy("node").agg(F.array(*[F.sum(F.col("sums")[n]) for n in range(len(wide))]).alias("sums"))
    sizes = points.groupBy("g").agg(F.array(*[F.sum(F.when(F.col("labels")[i] == c, F.col("size")).otherwise(0)) for i, c in wide]).alias("sizes"))
    rows = points.select("g", "node", "size", "labels").join(sums, "node").join(small_side(sizes), "g")

    def widths(it):
        for batch in it:
            get = lambda name: np.array(batch.column(batch.schema.get_field_index(name)).to_pylist(), np.float64)
            sums, sizes, labels, out = get("sums"), get("sizes"), get("labels").astype(int), []
            for i, k in enumerate(ks):
                at = sum(range(2, k))
                own, s, n = labels[:, i], sums[:, at : at + k], sizes[:, at : at + k]
                row = np.arange(len(own))
                inner = s[row, own] / np.maximum(n[row, own] - 1, 1)
                means = np.where(n > 0, s / np.maximum(n, 1), np.inf)
                means[row, own] = np.inf
                outer = np.where(np.isfinite(means).any(axis=1), means.min(axis=1), inner)
                out.append(np.where(n[row, own] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0))
            at = [batch.schema.get_field_index(n) for n in ("g", "size")]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in at], pa.array(np.stack(out, axis=1).tolist(), pa.list_(pa.float64()))], names=["g", "size", "widths"])

    kind = points.schema["g"].dataType
    found = rows.mapInArrow(widths, T.StructType([T.StructField("g", kind), T.StructField("size", T.LongType()), T.StructField("widths", T.ArrayType(T.DoubleType()))]))
    means = found.groupBy("g").agg(F.array(*[F.sum(F.col("widths")[i] * F.col("size")) / F.sum("size") for i in range(len(ks))]).alias("means"))
    return means.select("g", (F.array_position("means", F.array_max("means")) - 1).cast("int").alias("choice"))


def _large(rows: DataFrame, kmax: int, most: int, block: int) -> DataFrame:
    """g, key, cluster for rows (g, key, centre) of groups of more than ``most`` rows."""
    kmax = max(kmax, 3)  # two clusters at least
    points = rows.groupBy("g", "centre").agg(F.min("key").alias("least"), F.count("*").alias("size"))  # equal vectors merge first
    points = written(points.withColumn("node", F.monotonically_increasing_id()))
    clusters, merges = points, []
    while True:
        wide = clusters.groupBy("g").count().filter(F.col("count") > most).select("g")
        if wide.isEmpty():
            break
        todo = clusters.join(small_side(wide), "g", "left_semi")
        clusters, made = _merged(clusters, _round(todo, block))
        if made.isEmpty():
            raise ValueError("a distance is not a number")  # else the nearest pair of all is always merged
        merges.append(made.withColumn("round", F.lit(len(merges))))
    kind = dict(rows.dtypes)["key"]
    none = lambda **c: [F.lit(None).cast(k).alias(n) for n, k in c.items()]
    told = clusters.select("g", F.lit(0).alias("kind"), "node", "size", "centre", "least", *none(into="long", d="double", round="int", least_lo=kind, least_hi=kind))
    for made in merges:
        # the highest merges alone can be undone
        told = told.unionByName(_highest(made, kmax).select("g", F.lit(1).alias("kind"), F.col("hi").alias("node"), *none(size="long", centre="array<double>", least=kind), F.col("lo").alias("into"), "d", "round", "least_lo", "least_hi"))
    cut = written(told.groupBy("g").applyInArrow(_cut(kmax), "node long, labels array<int>, undone boolean"))
    undone = cut.filter("undone").select(F.col("node").alias("hi"))
    roots = cut.select("node", "labels")
    for made in reversed(merges):  # from the last round back: what was merged into a node has its labels
        step = made.select("lo", "hi").join(small_side(undone), "hi", "left_anti")  # a few rows a group
        roots = written(roots.unionByName(step.join(roots.withColumnRenamed("node", "lo"), "lo").select(F.col("hi").alias("node"), "labels")))
    points = written(points.join(roots, "node"))
    best = _chosen(points, kmax, block)
    named = points.join(small_side(best), "g").select("g", "centre", F.col("labels")[F.col("choice")].cast("long").alias("cluster"))
    return rows.join(named, ["g", "centre"]).select("g", "key", "cluster")


def _highest(made: DataFrame, n: int) -> DataFrame:
    """The n highest merges of each group."""
    return made.withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("d")))).filter(F.col("_r") <= n).drop("_r")


def cluster_groups(df: DataFrame, group: str, key: str, vector: str, kmax: int = 10, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """group, key, part, cluster. ``part`` is always 0. Of rows with equal vectors all are in one cluster.

    Groups of up to ``most`` rows (``MOST_ROWS``) are clustered in a task each, larger ones by rounds over all tasks.
    """
    most = MOST_ROWS if most is None else most
    kinds = dict(df.dtypes)
    rows = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("centre"))
    wide = written(rows.groupBy("g").count().filter(F.col("count") > most).select("g"))
    small = rows.join(small_side(wide), "g", "left_anti")  # fewer rows than one in ``most``

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        found = speakers(np.stack(pdf["centre"].to_numpy()).astype(np.float64), min(kmax, len(pdf)) if len(pdf) < 10 else kmax)
        return pd.DataFrame({"g": pdf["g"].to_numpy(), "key": pdf["key"].to_numpy(), "cluster": found})

    found = small.groupBy("g").applyInPandas(one, f"g {kinds[group]}, key {kinds[key]}, cluster long")
    if not wide.isEmpty():
        found = found.unionByName(_large(rows.join(small_side(wide), "g", "left_semi"), kmax, most, block))
    return found.select(F.col("g").alias(group), F.col("key").alias(key), F.lit(0).cast("long").alias("part"), "cluster")
