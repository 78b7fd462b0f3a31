"""Classifiers on the test documents: what they find among labelled documents that they did not learn from."""

import pytest

from corpusmill.llm import quality, toxicity


@pytest.mark.parametrize(("score", "label", "recall", "precision"), [(toxicity.score_toxicity, "toxic", 0.9, 0.97), (quality.score_quality, "quality", 0.97, 0.97)])
def test_held_out(spark, score, label, recall, precision):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.select("doc_id", label).join(score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels), "doc_id").filter("held_out")
    got = {(r[label], r.predicted): r["count"] for r in known.groupBy(label, "predicted").count().collect()}
    right, missed, wrong = got.get((1, 1), 0), got.get((1, 0), 0), got.get((0, 1), 0)
    assert right + missed > 100
    assert right / (right + missed) >= recall and right / (right + wrong) >= precision
