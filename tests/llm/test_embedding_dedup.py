"""Near-duplicate embeddings against brute force."""

import math

import numpy as np

from corpusmill.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<{}>, label int, node string, weight int"


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2) for i, v in rows], SCHEMA.format(kind)).repartition(3)


def brute(rows, threshold=0.9):
    """(id, links, component) of each row, in order of the rows."""
    good = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    unit = {k: ed.units(np.array([rows[k][1]], float))[0] for k in good}
    for n, a in enumerate(good):
        for b in good[n + 1 :]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a].append(b)
                links[b].append(a)
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()]:
                if other not in group:
                    group.add(other)
                    todo.append(other)
        seen |= group
        ids = [rows[g][0] for g in group if rows[g][0] is not None]
        for g in group:
            out[g] = (rows[g][0], len(links[g]), min(ids) if ids else None)
    return out


def found(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in rows], key=repr)


def near(rng, x, cosine):
    """A vector at this cosine from ``x``."""
    aside = rng.standard_normal(len(x))
    aside -= (aside @ x) * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + math.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)


def spread(n, dims, seed):
    return np.random.default_rng(seed).standard_normal((n, dims))


def test_copies_as_brute_force(spark):
    """Exact, scaled and near copies, also at the ids' two ends; a chain; repeated ids."""
    rng = np.random.default_rng(1)
    x = spread(300, 32, 2)
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(1000 + i, x[i] * 3.5) for i in range(20)] + [(2000 + i, near(rng, x[i], 0.99)) for i in range(10, 60)]
    rows += [(3000 + i, x[7]) for i in range(30)] + [(7, x[8]), (None, x[9]), (None, x[9])]
    chain = x[70]
    for i in range(6):
        chain = near(rng, chain, 0.97)
        rows.append((4000 + i, chain))
    assert found(ed.near_duplicates(frame(spark, rows), recall=0.999)) == sorted(brute(rows), key=repr)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold: nine of ten are found, and none below it."""
    rng = np.random.default_rng(3)
    x = spread(1500, 48, 4)
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(10_000 + i, near(rng, x[i], 0.9 + 1e-6)) for i in range(600)] + [(20_000 + i, near(rng, x[600 + i], 0.9 - 1e-6)) for i in range(300)]
    got = {r[0]: r for r in found(ed.near_duplicates(frame(spark, rows)))}
    true = {r[0]: r for r in brute(rows)}
    assert all(got[k][1] <= true[k][1] for k in true)
    assert sum(r[1] for r in got.values()) >= 0.9 * sum(r[1] for r in true.values())
    assert len(got) == len(rows)


def test_large_groups(spark):
    """Buckets of many parts: dense groups become balls, the rest of them and a looser group are compared part by part."""
    rng = np.random.default_rng(5)
    x = spread(60, 24, 6)
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(1000 + i, near(rng, x[0], 0.995)) for i in range(150)] + [(2000 + i, near(rng, x[1], rng.uniform(0.93, 0.97))) for i in range(80)]
    rows += [(3000 + i, near(rng, x[0], 0.93)) for i in range(25)] + [(4000 + i, x[0]) for i in range(40)]
    assert found(ed.near_duplicates(frame(spark, rows), recall=0.9999, block=12)) == sorted(brute(rows), key=repr)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0])]
    rows += [(10, [1e300, 1e300]), (11, [1e-300, 1e-300]), (12, [2.0]), (13, [5.0]), (14, [-1.0]), (None, None), (3, None), (15, list(range(1, 3000))), (16, list(range(2, 3001)))]
    assert found(ed.near_duplicates(frame(spark, rows), recall=0.999)) == sorted(brute(rows), key=repr)
    assert ed.near_duplicates(frame(spark, rows[:1]).limit(0)).collect() == []


def test_a_narrow_cone(spark):
    """All vectors near one direction: their differences, not their angles, would be all that is left of them off the mean."""
    rng = np.random.default_rng(8)
    middle = rng.standard_normal(16)
    rows = [(i, near(rng, middle, rng.uniform(0.80, 0.86))) for i in range(500)]
    got, true = {r[0]: r for r in found(ed.near_duplicates(frame(spark, rows)))}, {r[0]: r for r in brute(rows)}
    assert all(got[k][1] <= true[k][1] for k in true)
    assert sum(r[1] for r in got.values()) >= 0.9 * sum(r[1] for r in true.values()) > 0


def test_bits_are_balanced():
    """Learnt rotations split the sample evenly, and keep neighbours together more often than random ones."""
    rng = np.random.default_rng(7)
    x = ed.units(rng.standard_normal((2000, 8)) @ rng.standard_normal((8, 40)) + 0.1 * rng.standard_normal((2000, 40)))
    index = ed.learnt(x, 100_000, 40)
    assert (index.mean != 0).any()
    bits = (x - index.mean) @ index.turned > 0
    assert index.width == round(math.log2(100_000 / ed.OCCUPANCY)) and np.abs(bits.mean(axis=0) - 0.5).max() < 0.1
    noise = ed.units(x + 0.02 * rng.standard_normal(x.shape))
    random = rng.standard_normal(index.turned.shape)
    learnt = (((noise - index.mean) @ index.turned > 0) != bits).mean()
    assert learnt < (((noise - index.mean) @ random > 0) != ((x - index.mean) @ random > 0)).mean()
