"""The pipeline's stages: columns, decisions, and each stage's work on what the one before kept."""

import random
from collections import Counter

import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, labels = [], []
    for i in range(240):
        text = " ".join(word() for _ in range(60))
        good = i % 5 != 0
        rows.append((i, text if good else " ".join(f"{w}###" for w in text.split()), "en", f"src{i % 3}", 1))
        labels.append((i, int(good), 0))
    items = [(k, " ".join(f"b{k}x{j}" for j in range(25))) for k in range(3)]
    line = "read more about this at our site"
    for i in range(240, 270):
        rows.append((i, f"{' '.join(word() for _ in range(40))}\n{line}", "en", "src1", 1))
    rows += [(270 + i, rows[1][1] + f" w{i}", "en", "src2", 1) for i in range(6)]
    rows += [(280 + k, f"{' '.join(word() for _ in range(30))} {t} {' '.join(word() for _ in range(30))}", "en", "src0", 1) for k, t in items]
    rows += [(290, None, "en", "src0", None), (291, "", "en", None, 0), (None, " ".join(word() for _ in range(50)), None, None, 1)]
    where = f"file://{tmp_path_factory.mktemp('data')}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, ids = {}, None
    for name, stage in p.STAGES:
        docs = stage(spark, docs, folder)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name != "mixing sources":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
            assert docs.count() == len(kept[name])
            assert ids is None or set(kept[name]) <= ids
            ids = set(kept[name])
    good, lines, near, clean, mixed = (kept[n] for n, _ in p.STAGES)
    assert not any(i is not None and i < 240 and i % 5 == 0 for i in good)
    assert sum(i is not None and i < 240 for i in good) == 192
    assert set(lines) == set(good)
    assert lines[240].endswith("our site") and not any(lines[i].endswith("our site") for i in range(241, 270))
    assert set(good) - set(near) == {270, 271, 272, 273, 274, 275}
    assert set(near) - set(clean) == {280, 281, 282}
    assert set(mixed) <= set(clean) and "copy" in docs.columns
    assert docs.agg(F.min("copy"), F.max("copy")).first()[0] == 1


def test_run_agrees_with_itself(spark, folder):
    key = lambda df: sorted((r.doc_id or -1, r.copy) for r in df.collect())
    assert key(p.run(spark, folder)) == key(p.run(spark, folder))


def odd_rows(items):
    """(doc_id, text, lang, source, n_chars): shared ids, null ids, repeats, and texts that each stage must judge by row."""
    rng = random.Random(11)
    clean = lambda n=40: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    leak = f"{clean(20)} {items[0][1]} {clean(20)}"
    bad = " ".join(f"v{rng.randrange(5000)}###" for _ in range(40))
    same, near = clean(), clean(200)
    rows = [(1, clean()), (1, leak), (None, leak), (None, clean()), (2, bad), (2, clean()), (None, bad), (3, same), (3, same), (None, same), (4, same + " x"), (5, near), (5, near + " more"), (6, near), (6, clean(200))]
    return [(i, t, "en", f"src{k % 2}", k) for k, (i, t) in enumerate(rows)] + [(7, None, "en", None, 1), (8, "", "en", None, 1), (9, "long " * 60_000 + leak, "en", "src1", 1)]


def test_rows_that_share_an_id_or_have_none(spark, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").collect()]
    rows = odd_rows(items)
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    clean = p.drop_contaminated(spark, docs, folder)
    assert texts(clean) == Counter((i, t) for i, t, *_ in rows if not (t and items[0][1] in t))
    good = p.keep_good(spark, spark.read.parquet(f"{folder}/documents.parquet").unionByName(docs), folder)
    assert not any("###" in t for _, t in texts(good) if t) and texts(good)[(2, rows[5][1])] == texts(good)[(None, rows[3][1])] == 1
    kept = texts(p.keep_one_of_each_group(spark, docs, folder))
    same, near = rows[7][1], rows[11][1]
    assert kept[(3, same)] == 1 and not kept[(None, same)] and not kept[(4, same + " x")]
    assert kept[(5, near)] + kept[(5, near + " more")] == 1 and not kept[(6, near)] and kept[(6, rows[14][1])] == 1
    assert kept[(1, rows[0][1])] == kept[(1, rows[1][1])] == kept[(7, None)] == kept[(8, "")] == 1 and not kept[(None, rows[2][1])]


def test_stages_with_clashing_columns_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    names = ["node", "chosen_node", "row", "mark", "copies", "size", "group", "cut_id", "least"]
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for name, stage in p.STAGES:
        found = stage(spark, wide, folder)
        assert found.columns == [*wide.columns, *(["copy"] if name == "mixing sources" else [])]
        plain = stage(spark, docs, folder)
        assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter((r.doc_id, r.text) for r in plain.collect())
        assert stage(spark, docs.limit(0), folder).count() == 0
