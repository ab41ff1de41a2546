"""The numpy passes of the trainer against Spark ML's own trainer and network."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from canlake.operators import descent, mlp

LAYERS = [3, 4, 4, 3]


@pytest.fixture(scope="module")
def rows(spark):
    points = [(float(i % 7 - 3), float(i % 5 - 2), float(i % 11 - 5)) for i in range(300)]
    return spark.createDataFrame([(Vectors.dense(p), float((p[0] > 0) + (p[0] > 0 and p[1] > 0))) for p in points], ["features", "label"])


def test_loss_and_gradient_are_those_of_the_network(spark, rows):
    model = mlp.network(spark, LAYERS)
    weights = model.weights.toArray()
    blocks = descent.row_blocks(rows)
    loss, gradient = descent.loss_and_gradient(blocks, LAYERS, weights)
    scored = model.transform(rows).collect()  # Spark ML's forward pass
    assert loss == pytest.approx(-np.mean([np.log(r["probability"][int(r["label"])]) for r in scored]), rel=1e-5)
    for i in (0, 11, 17, len(weights) - 1):
        near = [descent.loss_and_gradient(blocks, LAYERS, weights + sign * 1e-2 * np.eye(len(weights))[i])[0] for sign in (1, -1)]
        assert gradient[i] == pytest.approx((near[0] - near[1]) / 2e-2, rel=2e-2, abs=1e-5)


def test_training_is_as_good_as_spark_mls_own(spark, rows):
    own = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=40, seed=42).fit(rows)
    blocks = descent.row_blocks(rows)
    found = mlp.train(blocks, LAYERS, 40)
    losses = [descent.loss_and_gradient(blocks, LAYERS, m.weights.toArray())[0] for m in (own, found)]
    assert losses[1] < losses[0] + 0.05


def test_a_network_of_given_weights_keeps_them(spark):
    weights = np.linspace(-1, 1, 4 * 4 + 4 * 5 + 3 * 5)
    assert mlp.network(spark, LAYERS, weights=weights).weights.toArray().tolist() == weights.tolist()
