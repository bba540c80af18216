"""Classifiers, projections and their fusion with Spark ML, and message passing as joins.

Training of graph networks by gradients isn't offered; ``message_pass`` applies given weights.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sigmoid
from .features import class_weights


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Rows with ``weight``: each class weighs the same altogether. One row per class is joined."""
    return rows.join(F.broadcast(class_weights(rows, label)), label)


def assemble(rows: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(rows)


def logistic(rows: DataFrame, label: str = "label", penalty: float = 0.02):
    """ML01, ML02: class-balanced logistic regression with a ridge penalty, features as they are."""
    lr = LogisticRegression(labelCol=label, weightCol="weight", regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=100)
    return lr.fit(balanced(rows, label))


def probability(model, rows: DataFrame, name: str = "score") -> DataFrame:
    scored = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction")


def projection(rows: DataFrame, vector: str, dims: int):
    """ML03: centred principal components; signs so that the largest loading of each is positive."""
    centre = StandardScaler(inputCol=vector, outputCol="_centred", withMean=True, withStd=False)
    model = Pipeline(stages=[centre, PCA(k=dims, inputCol="_centred", outputCol="_parts")]).fit(rows)
    loadings = model.stages[1].pc.toArray()
    signs = [1.0 if column[abs(column).argmax()] >= 0 else -1.0 for column in loadings.T]

    def apply(new: DataFrame, name: str) -> DataFrame:
        parts = F.zip_with(vector_to_array("_parts"), F.array(*map(F.lit, signs)), lambda x, s: x * s)
        return model.transform(new).withColumn(name, parts).drop("_centred", "_parts")

    return apply


def fusion(train: DataFrame, left: str, right: str, dims: int):
    """ML05: principal components of two vectors side by side, then logistic regression; returns a scorer."""
    first, second = projection(train, left, dims), projection(train, right, dims)

    def joined(rows: DataFrame) -> DataFrame:
        return second(first(rows, "_a"), "_b").withColumn("features", array_to_vector(F.concat("_a", "_b"))).drop("_a", "_b")

    model = logistic(joined(train))
    return lambda rows: probability(model, joined(rows))


def boosted(rows: DataFrame, label: str = "label", rounds: int = 20):
    """ML07: gradient-boosted trees."""
    return GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=3, seed=7).fit(rows)


def forest(rows: DataFrame, label: str = "label", trees: int = 300):
    """ML07: a forest with class-balanced weights."""
    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, seed=7).fit(balanced(rows, label))


def perceptron(rows: DataFrame, width: int, hidden: int, label: str = "label"):
    """ML04: one hidden layer."""
    return MultilayerPerceptronClassifier(labelCol=label, layers=[width, hidden, 2], seed=7, maxIter=100).fit(rows)


def rule_gate(delta):
    """ML08: a fixed rule: sigmoid of a change, flagged from that of 0.5 on."""
    return sigmoid(delta)


def message_pass(nodes: DataFrame, edges: DataFrame, own: list[list[float]], from_in: list[list[float]]) -> DataFrame:
    """ML09: one layer: relu(own . x + from_in . mean of the sources' x) plus x, for ``nodes`` (id, x) and edges (src, dst).

    Means are taken per position after an explode, so a hub's messages are added up where they arise.
    """
    sent = edges.join(nodes.select(F.col("id").alias("src"), "x"), "src").select("dst", F.posexplode("x").alias("i", "v"))
    mean = sent.groupBy("dst", "i").agg(F.avg("v").alias("v")).groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_m"))
    width = len(own[0])
    both = nodes.join(mean.withColumnRenamed("dst", "id"), "id", "left")
    m = F.coalesce(F.transform("_m", lambda p: p["v"]), F.array(*[F.lit(0.0)] * width))

    def dot(weights: list[float], v):
        return F.aggregate(F.zip_with(F.array(*map(F.lit, weights)), v, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    rows = [F.greatest(F.lit(0.0), dot(a, F.col("x")) + dot(b, F.col("_mean"))) for a, b in zip(own, from_in)]
    return both.withColumn("_mean", m).select("id", F.zip_with(F.array(*rows), "x", lambda a, b: a + b).alias("x"))


def pooled(nodes: DataFrame, chosen: DataFrame, graph: str) -> DataFrame:
    """SX10: mean vector of the chosen nodes of each graph; zeros where none is chosen."""
    parts = nodes.join(chosen, "id", "left_semi").select(graph, F.posexplode("x").alias("i", "v"))
    mean = parts.groupBy(graph, "i").agg(F.avg("v").alias("v")).groupBy(graph).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_m"))
    size = nodes.groupBy(graph).agg(F.max(F.size("x")).alias("_n"))
    zeros = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda _: F.lit(0.0))
    return size.join(mean, graph, "left").select(graph, F.coalesce(F.transform("_m", lambda p: p["v"]), zeros).alias("x"))
