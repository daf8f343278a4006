"""Fits over blocks of rows against MLlib's own, numeric derivatives and plain matrices."""

import math
from itertools import groupby

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector

from ledgerline.operators import forest, perceptron, random_forest, trees
from ledgerline.operators.blocks import row_blocks
from ledgerline.session import stage

COLUMNS = {"featuresCol": "f", "labelCol": "y", "predictionCol": "p"}


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    return x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 1)


@pytest.fixture(scope="module")
def labelled(spark, drawn):
    rows = [(v.tolist(), float(k)) for v, k in zip(*drawn)]
    return spark.createDataFrame(rows, "x array<double>, y double").repartition(3).select(array_to_vector("x").alias("f"), "y").persist()


def forward(layers, x):
    """Scores of the rows of ``x`` by plain matrices."""
    for k, (weights, bias) in enumerate(layers):
        x = x @ np.array(weights).T + np.array(bias)
        x = x if k == len(layers) - 1 else 1 / (1 + np.exp(-x))
    return x


def test_blocks_hold_each_row_once(labelled, drawn):
    held = row_blocks(labelled, "f", "y", 4, 700).collect()
    assert len({k for k, _, _ in held}) == len(held) and max(len(y) for _, _, y in held) <= 700
    found = np.vstack([np.column_stack([x.T, y]) for _, x, y in held])
    assert sorted(map(tuple, found)) == sorted(map(tuple, np.column_stack(drawn)))


@pytest.mark.parametrize("hidden", [[], [6], [5, 4]])
def test_gradient_is_the_derivative(labelled, drawn, hidden):
    sizes = [4, *hidden, 3]
    blocks = row_blocks(labelled, "f", "y", 4, 1100)
    n = sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))
    weights = np.random.default_rng(1).normal(size=n)
    loss, gradient = perceptron.loss_and_gradient(blocks, sizes, weights, len(drawn[1]))
    z = forward([(w, b.ravel()) for w, b in perceptron.split_layers(weights, sizes)], drawn[0])
    own = np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), drawn[1]]
    assert loss == pytest.approx(own.mean(), rel=1e-12)
    for k in range(0, n, max(1, n // 6)):
        step = np.zeros(n)
        step[k] = 1e-5
        up, down = (perceptron.loss_and_gradient(blocks, sizes, weights + s, len(drawn[1]))[0] for s in (step, -step))
        assert gradient[k] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-8)


def test_perceptron_fits_as_well_as_the_library(labelled, drawn):
    settings = MultilayerPerceptronClassifier(layers=[4, 8, 3], maxIter=60, seed=7, **COLUMNS)
    blocks = row_blocks(labelled, "f", "y", 4, 1000)
    library, own = settings.fit(labelled), perceptron.BlockPerceptron(settings).fit(labelled)
    losses = [perceptron.loss_and_gradient(blocks, [4, 8, 3], m.weights.toArray(), len(drawn[1]))[0] for m in (library, own)]
    assert losses[1] < losses[0] + 0.02 and losses[1] < 0.3
    assert type(own) is type(library) and own.getMaxIter() == 60 and list(own.getLayers()) == [4, 8, 3]
    right = own.transform(labelled).where("p = y").count() / len(drawn[1])
    assert right > 0.9


def test_minimise_ends_at_the_optimum():
    a = np.diag(np.arange(1.0, 21.0))
    calls = []

    def bowl(x):
        calls.append(1)
        return float(0.5 * x @ a @ x - x.sum()), a @ x - 1.0

    found = perceptron.minimise(bowl, np.full(20, 5.0), 200, 1e-12)
    assert np.allclose(found, 1 / np.arange(1.0, 21.0), atol=1e-5) and len(calls) < 100
    valley = lambda x: (float(100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2), np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)]))
    assert np.allclose(perceptron.minimise(valley, np.array([-1.2, 1.0]), 200, 1e-12), 1.0, atol=1e-3)


@pytest.mark.parametrize("sizes", [[3, 2], [3, 6, 2], [3, 6, 5, 4]])
def test_layers_as_tables(spark, sizes):
    rng = np.random.default_rng(2)
    layers = [(rng.normal(size=(b, a)).tolist(), rng.normal(size=b).tolist()) for a, b in zip(sizes, sizes[1:])]
    x = rng.normal(size=(50, 3))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    scored = trees.layer_scores(rows, layers, "id")
    found = {r.id: r.scores for r in scored.collect()}
    assert np.allclose([found[k] for k in range(50)], forward(layers, x), rtol=1e-12)
    # Functions over arrays run entry by entry without compiled code, and repeat what they refer to.
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_layers_of_no_rows(spark):
    rows = spark.createDataFrame([], "id long, x array<double>")
    assert trees.layer_scores(rows, [([[1.0]], [0.0]), ([[1.0]], [0.0])], "id").count() == 0


def test_bins_hold_few_values_each_and_many_by_rank(spark):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 24, 20000), rng.normal(size=20000), np.full(20000, 3.0), rng.integers(0, 2, 20000)])
    x[:-1, 3] = 0.0  # one row alone has another value
    x[-1, 3] = 1.0
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3).select(array_to_vector("x").alias("f"))
    edges = random_forest.bin_edges(df, "f", 4, 32)
    assert edges[0].tolist() == [k + 0.5 for k in range(23)] and not len(edges[2]) and edges[3].tolist() == [0.5]
    shares = [(x[:, 1] <= e).mean() for e in edges[1]]
    assert len(shares) == 31 and np.allclose(shares, np.arange(1, 32) / 32, atol=0.003)


def test_samples_are_poisson_and_repeat():
    limits = random_forest.poisson_limits(1.0)
    rows, times = random_forest.drawn(3, 1, 7, 200_000, limits)
    again = random_forest.drawn(3, 1, 7, 200_000, limits)
    assert (rows == again[0]).all() and (times == again[1]).all()
    assert len(random_forest.drawn(3, 2, 7, 200_000, limits)[0]) != len(rows)
    share = 1 - len(rows) / 200_000
    for k in range(5):
        expected = np.exp(-1.0) / math.factorial(k)
        assert abs((share if k == 0 else (times == k).mean() * (1 - share)) - expected) < 0.005


def test_best_splits_by_hand():
    counts = np.random.default_rng(4).integers(0, 9, (6, 3, 5, 3))
    counts[:, 1:] = np.sort(counts[:, :1], axis=2)  # all features of a node hold the same rows
    counts[5] = 0
    counts[5, :, 2, 1] = 4  # one class, one bin
    counts[4] = 0
    counts[4, :, 2, :] = 4  # three classes, one bin
    feature, limit, gain, total, left = random_forest.best_splits(counts, 1, 0.0)
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    for node in range(6):
        gains = []
        for f in range(3):
            for b in range(4):
                low, high = counts[node, f, : b + 1].sum(axis=0), counts[node, f, b + 1 :].sum(axis=0)
                if low.sum() and high.sum():
                    whole = low + high
                    gains.append((gini(whole) - (gini(low) * low.sum() + gini(high) * high.sum()) / whole.sum(), f, b))
        assert gain[node] == pytest.approx(max(gains)[0] if gains else 0.0, abs=1e-9)
        if node < 4:
            low = counts[node, feature[node], : limit[node] + 1].sum(axis=0)
            assert (low == left[node]).all() and (total[node] == counts[node, 0].sum(axis=0)).all()


@pytest.fixture(scope="module")
def forest_settings():
    return RandomForestClassifier(numTrees=12, maxDepth=6, seed=9, **COLUMNS)


def nodes_of(spark, model, path):
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    return {(r.treeID, r.id): r for r in rows}


def test_leaves_hold_the_rows_that_come_to_them(spark, labelled, forest_settings, tmp_path):
    """Each tree's sample, drawn again and sent down by the saved limits, leaves the saved class counts in every leaf."""
    staged = stage(labelled, "labelled")
    nodes = nodes_of(spark, random_forest.BlockForest(forest_settings).fit(staged), str(tmp_path / "own"))
    assert {t for t, _ in nodes} == set(range(12))
    limits = random_forest.poisson_limits(1.0)
    blocks = row_blocks(staged, "f", "y", 4, random_forest.BLOCK_ROWS).collect()
    for tree in range(12):
        found = {}
        for block, x, y in blocks:
            for row, times in zip(*random_forest.drawn(9, tree, block, len(y), limits)):
                node = nodes[tree, 0]
                while node.leftChild >= 0:
                    left = x[node.split.featureIndex, row] <= node.split.leftCategoriesOrThreshold[0]
                    node = nodes[tree, node.leftChild if left else node.rightChild]
                found.setdefault(node.id, np.zeros(3))[y[row]] += times
        leaves = {k: n.impurityStats for (t, k), n in nodes.items() if t == tree and n.leftChild < 0}
        assert {k: v.tolist() for k, v in found.items()} == leaves and len(leaves) > 10
        for (t, _), n in nodes.items():  # leaves side by side predict differently
            if t == tree and n.leftChild >= 0:
                pair = [nodes[tree, n.leftChild], nodes[tree, n.rightChild]]
                assert pair[0].leftChild >= 0 or pair[1].leftChild >= 0 or pair[0].prediction != pair[1].prediction


def test_forest_fits_as_well_as_the_library(labelled, drawn, forest_settings):
    library, own = forest_settings.fit(labelled), random_forest.BlockForest(forest_settings).fit(labelled)
    right = [m.transform(labelled).where("p = y").count() / len(drawn[1]) for m in (library, own)]
    assert right[1] > right[0] - 0.02 and right[1] > 0.85
    assert type(own) is type(library) and own.getNumTrees == 12 and own.getMaxDepth() == 6 and own.numClasses == 3
    assert max(t.depth for t in own.trees) <= 6


def test_trees_do_not_depend_on_the_passes(spark, labelled, forest_settings, tmp_path, monkeypatch):
    staged, passes = stage(labelled, "labelled"), []
    split = random_forest.split_nodes
    monkeypatch.setattr(random_forest, "split_nodes", lambda *a: (passes.append(len(a[1])), split(*a))[1])
    found = []
    for k, size in enumerate((64 << 20, 40_000)):
        monkeypatch.setattr(random_forest, "COUNT_BYTES", size)
        found.append(nodes_of(spark, random_forest.BlockForest(forest_settings).fit(staged), str(tmp_path / str(k))))
        passes.append(0)
    first = passes.index(0)
    assert found[0] == found[1] and first <= 6 < len(passes) - first - 2


def test_a_forest_of_one_class_is_of_leaves(spark):
    rows = spark.createDataFrame([([float(k)], 0.0) for k in range(50)], "x array<double>, y double").select(array_to_vector("x").alias("f"), "y")
    model = random_forest.BlockForest(RandomForestClassifier(numTrees=3, seed=-5, **COLUMNS)).fit(rows)
    assert model.totalNumNodes == 3 and model.transform(rows).where("p = 0").count() == 50


def test_rows_are_joined_once_with_all_trees(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3))
    x[0, 0], x[1, 1], x[2, 0] = np.nan, np.inf, -np.inf
    grown = [forest.grow_tree(rng.normal(size=(60, 3)), rng, 5).assign(tree=t) for t in range(4)]
    grown.append(grown[0].iloc[:1].assign(feature=-1, threshold=np.inf, left=0, right=0, path=7.5, tree=4))  # a leaf alone
    nodes = spark.createDataFrame(pd.concat(grown)[["tree", "node", "feature", "threshold", "left", "right", "path"]], forest.NODE_SCHEMA)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    reached = trees.leaves(rows, trees.node_table(nodes.repartition(3), "path"), 5, 5)
    found = {k: sorted(r.path for r in part) for k, part in groupby(sorted(reached.collect()), key=lambda r: r.id)}
    for k, v in enumerate(x):
        own = []
        for tree in grown:
            at = tree.iloc[0]
            while at.left != at.node:
                at = tree.iloc[int(at.left if v[int(at.feature)] <= at.threshold else at.right)]
            own.append(at.path)
        assert found[k] == sorted(own)
    # A join for each level would look each row of each tree up in a table of all nodes that many times.
    plan = reached._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    with pytest.raises(ValueError):
        trees.leaves(rows, trees.node_table(nodes, "path"), 6, 5)
