"""Published models: parameters, columns and contents that don't match are refused."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import langid, ngramlm
from corpusmill.sources import store as st


def test_a_classifier_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([("nl", "de kat zit"), ("fr", "dei kat sit"), ("fr", "sit dei")], "lang string, t string")
    model = dict(zip(("priors", "logp", "unseen"), langid.train(rows, F.col("t"), "lang", 2, 3), strict=True))
    models = st.Models(spark, f"file://{tmp_path}/m")
    with pytest.raises(ValueError, match="nothing"):
        models.load()
    assert models.publish(model, kind="naive bayes", low=2, high=3) == 1
    found = models.load(columns={"logp": ["gram", "lang", "logp"]}, check=True, low=2, high=3)
    new = spark.createDataFrame([(1, "dei sit"), (2, "de zit")], "k int, t string")
    predict = lambda m: sorted(map(tuple, langid.predict(new, "k", F.col("t"), (m["priors"], m["logp"], m["unseen"]), "lang", 2, 3).collect()))
    assert predict(found) == predict(model)
    for wrong in ({"low": 3}, {"columns": {"logp": ["gram"]}}, {"columns": {"other": []}}):
        with pytest.raises(ValueError):
            models.load(**wrong)


def test_a_reader_keeps_its_version(spark, tmp_path):
    models = st.Models(spark, f"file://{tmp_path}/m")
    first = spark.createDataFrame([(1, "s1"), (2, "s2"), (2, "s2")], "cluster int, speaker string")
    scores = spark.createDataFrame([(1, [0.5, 0.25]), (2, None)], "pk int, logits array<double>")
    models.publish({"clusters": first, "scores": scores}, meeting="m1")
    held = models.load()["clusters"]
    models.publish({"clusters": first.limit(1)}, meeting="m2")
    assert held.count() == 3 and models.load()["clusters"].count() == 1 and models.load(1, meeting="m1", check=True)["scores"].count() == 2
    models.vacuum(1)
    assert models.versions() == [2] and models.load(check=True)["clusters"].count() == 1


def test_other_content_is_found(spark, tmp_path):
    models = st.Models(spark, f"file://{tmp_path}/m")
    grams = dict(enumerate(ngramlm.models(spark.createDataFrame([(["a", "b", "a"],)], "w array<string>"), F.col("w"), 2)))
    models.publish({f"order{k}": t for k, t in grams.items()}, order=2)
    models.load(check=True)
    folder = next((tmp_path / "m" / "data").iterdir())
    spark.read.parquet(f"{folder}/order0").limit(0).write.mode("overwrite").parquet(f"{folder}/copy")
    (folder / "order0").rename(folder / "old")
    (folder / "copy").rename(folder / "order0")
    with pytest.raises(ValueError, match="not what was published"):
        models.load(check=True)
