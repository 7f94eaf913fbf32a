from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import quality, queries

DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_held_out_documents_are_told_apart(spark):
    scored = queries.op11_quality(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    assert len(good) > 40 and len(bad) > 8
    assert (good.predicted == 1).mean() >= 0.98 and (bad.predicted == 0).mean() >= 0.9
    assert good.score.min() > bad.score.median()


def test_prior_and_non_negative_risk_on_two_clouds():
    rng = np.random.default_rng(1)
    cloud = lambda n, at: rng.normal(at, 0.6, (n, 5))
    for share in (0.3, 0.6, 0.9):
        unlabelled = np.vstack([cloud(int(4000 * share), 1), cloud(4000 - int(4000 * share), -1)])
        rng.shuffle(unlabelled)
        positive = cloud(2000, 1)
        prior = quality.class_prior(positive, unlabelled)
        assert abs(prior - share) < 0.08
        weights = quality.fitted(positive, unlabelled, prior)
        right = (quality.forward(cloud(1000, 1), weights)[1] > 0).mean(), (quality.forward(cloud(1000, -1), weights)[1] < 0).mean()
        assert min(right) > 0.9


def test_edge_rows(spark):
    text = "Plain words of a plain text, one after another. " * 4
    docs = spark.createDataFrame([(k, text + str(k)) for k in range(60)] + [(k, "BUY!!! $$$ ### " * 30) for k in range(60, 90)] + [(None, "x"), (90, None), (91, ""), (91, ""), (92, "word " * 100_000)], "doc_id long, text string")
    docs = docs.withColumns({"score": F.lit("own"), "good": F.lit(1), "f": F.lit(2)})
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(60, 0), (5, None), (None, 1), (41, 1), (41, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 95 and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[50] > 0.8 and by_id[70] < 0.3 and by_id[90] == by_id[91]
    assert quality.score(docs.limit(0), model).collect() == []
    nothing = quality.train(docs, labels.where("quality = 0"))
    assert nothing.weights is None and {r["score"] for r in quality.score(docs, nothing).collect()} == {0.0}
    assert quality.train(docs.limit(0), labels).weights is None
