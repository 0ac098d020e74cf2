"""The registered models are those of the operators: all features and the operators' own settings."""

import pytest
from pyspark.ml import classification

from lodestone.operators import features, model
from lodestone.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, kind, wanted", [("m1_logistic_regression", "LogisticRegression", {"maxIter": 1000}), ("m3_boosted_trees", "GBTClassifier", {"maxIter": 500, "maxDepth": 6})])
def test_models_are_whole(spark, monkeypatch, name, kind, wanted):
    seen, scored, made = {}, [], getattr(classification, kind)

    def spy(**given):
        seen.update(given)
        return made(**given | {"maxIter": 1, "maxDepth": 2} if kind == "GBTClassifier" else given)

    monkeypatch.setattr(model, kind, spy)
    assembled = model._assembled
    monkeypatch.setattr(model, "_assembled", lambda names: scored.append(names) or assembled(names))
    out = catalog.QUERIES[name](spark, DATA)
    assert {k: seen[k] for k in wanted} == wanted and scored == [features.NAMES]
    assert out.columns == ["s1", "cand", "label", "probability", "predicted"] and out.where("probability BETWEEN 0 AND 1").count() == out.count() > 0


def test_features_for_fitting_are_made_once(spark):
    from lodestone.plans import fixture

    data = catalog._training(fixture.records(spark, DATA))
    assert data.count() > 0 and all("/training-" in f for f in data.inputFiles())
