"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

Spark draws the sample of each tree by hash and shuffles it to one group; a tree sees ``sample_size``
rows whatever the table holds. Scoring runs on Arrow batches of the feature columns alone.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.quantiles import exact_quantiles
from ledgerline.operators.trees import leaves, node_table
from ledgerline.session import stage

# Functions of this module travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER_GAMMA = 0.5772156649015329
HASH_RANGE = 1 << 40
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> pd.DataFrame:
    """Nodes of one tree. A leaf points to itself and holds its path length."""
    nodes: list[list] = []
    open_nodes = [(np.arange(len(x)), 0, None, None)]
    while open_nodes:
        rows, depth, parent, side = open_nodes.pop()
        number = len(nodes)
        if parent is not None:
            nodes[parent][side] = number
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= max_depth or len(rows) <= 1 or not len(usable):
            nodes.append([-1, np.inf, number, number, depth + float(mean_path(len(rows)))])
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:  # rounding in a narrow range
            threshold = float(low[feature])
        goes_left = x[rows, feature] <= threshold
        nodes.append([feature, threshold, -1, -1, 0.0])
        open_nodes.append((rows[~goes_left], depth + 1, number, 3))
        open_nodes.append((rows[goes_left], depth + 1, number, 2))
    table = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path"])
    return table.assign(node=np.arange(len(table)))


def flat_tree(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, threshold, children (right and left of each node in turn) and path of a tree's nodes, in their order."""
    feature = np.maximum(nodes["feature"].to_numpy(), 0).astype(np.intp)  # both sides of a leaf are itself
    children = nodes[["right", "left"]].to_numpy().ravel().astype(np.intp)
    return feature, nodes["threshold"].to_numpy(), children, nodes["path"].to_numpy()


def path_sums(x: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], depth: int) -> np.ndarray:
    """For each row of ``x`` its path lengths summed over the trees.

    The arrays are taken from by flat places into buffers that all trees share, which costs about half of what indexing
    into new arrays does.
    """
    n = len(x)
    values, first = np.ascontiguousarray(x).ravel(), np.arange(n, dtype=np.intp) * x.shape[1]
    at, place = np.empty(n, dtype=np.intp), np.empty(n, dtype=np.intp)
    value, limit, left = np.empty(n), np.empty(n), np.empty(n, dtype=bool)
    total = np.zeros(n)
    for feature, threshold, children, path in trees:
        np.less_equal(x[:, feature[0]], threshold[0], out=left)  # all rows begin at node 0
        np.take(children, left, out=at, mode="clip")
        for _ in range(depth - 1):
            np.take(feature, at, out=place, mode="clip")
            place += first
            np.take(values, place, out=value, mode="clip")
            np.take(threshold, at, out=limit, mode="clip")
            np.less_equal(value, limit, out=left)
            at <<= 1
            at += left
            np.take(children, at, out=place, mode="clip")
            at, place = place, at
        np.take(path, at, out=value, mode="clip")
        total += value
    return total


@dataclass
class IsolationForestModel:
    """Fitted trees. At most trees * (2 * sample_size - 1) nodes, so the model fits any worker."""

    features: list[str]
    sample_size: int
    max_depth: int
    offset: float
    nodes: pd.DataFrame = field(repr=False)

    def score(self, df: DataFrame, output: str = "anomaly_score") -> DataFrame:
        """``output`` in (0, 1]; higher is more anomalous. NULL features count as 0."""
        trees = [flat_tree(t) for _, t in self.nodes.sort_values(["tree", "node"]).groupby("tree")]
        scale = float(mean_path(self.sample_size)) or 1.0
        depth = self.max_depth

        @F.pandas_udf("double")
        def anomaly_score(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            total = path_sums(x, trees, depth)
            return pd.Series(np.exp2(-total / (len(trees) * scale)))

        zero = F.lit(0.0)
        present = set(df.columns)  # a feature that the table lacks counts as 0
        columns = [F.coalesce(F.col(f"`{f}`").cast("double"), zero) if f in present else zero for f in self.features]
        return df.withColumn(output, anomaly_score(*columns))

    def score_in_joins(self, df: DataFrame, key: str = "txn_id", output: str = "anomaly_score") -> DataFrame:
        """What :meth:`score` gives, by joins with the node table instead of Python workers; ``key`` is unique and not NULL."""
        present = set(df.columns)
        zero = F.lit(0.0)
        columns = [F.coalesce(F.col(f"`{f}`").cast("double"), zero) if f in present else zero for f in self.features]
        nodes = node_table(df.sparkSession.createDataFrame(self.nodes, NODE_SCHEMA), "path")
        trees = int(self.nodes["tree"].max()) + 1
        reached = leaves(df.select(F.col(key).alias("_key"), F.array(*columns).alias("x")), nodes, trees, self.max_depth)
        scale = trees * (float(mean_path(self.sample_size)) or 1.0)
        scores = reached.groupBy("_key").agg(F.pow(F.lit(2.0), -F.sum("path") / scale).alias(output))
        return df.join(scores, F.col(key) == F.col("_key")).drop("_key")

    def decide(self, scored: DataFrame, score: str = "anomaly_score") -> DataFrame:
        """``decision`` (below 0 is an anomaly) and ``is_anomaly`` from the score."""
        decision = -F.col(score) - F.lit(self.offset)
        return scored.withColumns({"decision": decision, "is_anomaly": decision < 0})

    def transform(self, df: DataFrame) -> DataFrame:
        return self.decide(self.score(df))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.parquet(f"{path}/nodes")
        params = [(self.features, self.sample_size, self.max_depth, self.offset)]
        schema = "features array<string>, sample_size int, max_depth int, offset double"
        spark.createDataFrame(params, schema).coalesce(1).write.json(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForestModel:
        params = spark.read.json(f"{path}/params").first()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
        return cls(list(params.features), params.sample_size, params.max_depth, params.offset, nodes)


def tree_samples(
    df: DataFrame, features: list[str], trees: int, sample_size: int, total: int, seed: int, key: str
) -> DataFrame:
    """``tree``, ``place`` and features: ``sample_size`` different rows for each tree.

    A first hash keeps about twice the rows that all trees need. A large table gives each tree its
    own rows. A small one is dealt out anew in several rounds.
    """
    wanted = 2 * trees * sample_size
    pool = df.select(F.col(key).alias("_key"), *[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f) for f in features])
    if total > wanted:
        keep = int(HASH_RANGE * (wanted / total))
        pool = pool.where(F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(HASH_RANGE)) < keep)
    per_round = max(1, min(trees, min(total, wanted) // (2 * sample_size)))
    rounds = -(-trees // per_round)
    dealt = pool.withColumn("_round", F.explode(F.array(*[F.lit(r) for r in range(rounds)])))
    seat = F.pmod(F.xxhash64("_key", F.lit(seed + 1), "_round"), F.lit(per_round)).cast("int")
    order = W.partitionBy("tree").orderBy(F.xxhash64("_key", F.lit(seed + 2), "tree"), "_key")
    return (
        dealt.withColumn("tree", (F.col("_round") * per_round + seat).cast("int"))
        .where(F.col("tree") < trees)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= sample_size)
        .select("tree", "place", *features)
    )


def fit_isolation_forest(
    df: DataFrame,
    features: list[str],
    trees: int = 100,
    sample_size: int = 256,
    contamination: float = 0.05,
    seed: int = 42,
    key: str = "txn_id",
) -> tuple[IsolationForestModel, DataFrame]:
    """The fitted model, and ``df`` with its scores, decisions and flags (staged).

    The offset is the exact quantile of the training scores, so the flagged share is the
    ``contamination``. Like other estimators, fitting runs at once.
    """
    total = df.count()
    if not total:
        raise ValueError("no rows to fit an isolation forest on")
    size = min(sample_size, total)
    max_depth = int(np.ceil(np.log2(max(size, 2))))

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        x = sample.sort_values("place")[features].to_numpy(dtype=float)
        grown = grow_tree(x, np.random.default_rng([seed, tree]), max_depth)
        return grown.assign(tree=tree)[["tree", "node", "feature", "threshold", "left", "right", "path"]]

    samples = tree_samples(df, features, trees, size, total, seed, key)
    nodes = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    model = IsolationForestModel(list(features), size, max_depth, 0.0, nodes)
    scored = stage(model.score(df), "forest-scores")
    quantile = exact_quantiles(scored.withColumn("_normal", -F.col("anomaly_score")), "_normal", [contamination])
    model.offset = float(quantile.first()["q"][0])
    return model, model.decide(scored)
