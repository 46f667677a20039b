"""K-means, its evaluation, and the description of clusters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.functions.vectors import cosine, doubles, squared_distance
from topicloom.operators.features import group_means


def fit_kmeans(
    df: DataFrame,
    k: int = 5,
    seed: int = 15,
    features: str = "features",
    output: str = "cluster",
    restarts: int = 1,
    max_iter: int = 20,
) -> KMeansModel:
    """Best of ``restarts`` fits by training cost."""
    fits = [
        KMeans(
            featuresCol=features, predictionCol=output, k=k, seed=seed + i, maxIter=max_iter
        ).fit(df)
        for i in range(restarts)
    ]
    return min(fits, key=lambda model: model.summary.trainingCost)


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Mean silhouette with squared Euclidean distance, from per-cluster sums."""
    return ClusteringEvaluator(
        featuresCol=features, predictionCol=cluster, metricName="silhouette"
    ).evaluate(df)


def k_sweep(
    df: DataFrame, ks: Iterable[int] = range(2, 10), seed: int = 42, features: str = "features"
) -> tuple[DataFrame, DataFrame]:
    """``(k, cost, silhouette)`` per number of clusters, and ``df`` with a column
    ``cluster_<k>`` of labels for each. ``df`` is read by every fit, so pass a
    stored table rather than an expensive plan."""
    rows, labelled = [], df
    for k in ks:
        name = f"cluster_{k}"
        model = fit_kmeans(df, k, seed, features, name)
        labelled = model.transform(labelled)
        score = silhouette(model.transform(df), features, name)
        rows.append((k, float(model.summary.trainingCost), float(score)))
    sweep = df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")
    return sweep, labelled


def best_k(sweep: DataFrame) -> int:
    """The k with the largest silhouette, the smaller one on a tie."""
    return sweep.agg(F.max_by("k", F.struct("silhouette", -F.col("k")))).first()[0]


# ------------------------------------------------- k-means from given centres

# Centres by label; a list has the labels 0, 1, 2, …
Centers = Mapping[int, Sequence[float]] | Sequence[Sequence[float]]


def _by_label(centers: Centers) -> dict[int, list[float]]:
    pairs = centers.items() if isinstance(centers, Mapping) else enumerate(centers)
    return {int(label): [float(v) for v in center] for label, center in pairs}


def _to_centers(centers: Centers, measure: Callable[[Column], Column], name: str) -> Column:
    """``measure`` of every centre with its label, from one constant that holds
    all centres: the plan does not grow with their number or width."""
    rows = [{"label": label, "v": v} for label, v in _by_label(centers).items()]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<label:int,v:array<double>>>")
    return F.transform(
        table, lambda c: F.struct(measure(c["v"]).alias(name), c["label"].alias("cluster"))
    )


def _distances(vector: str, centers: Centers) -> Column:
    point = doubles(vector)
    return _to_centers(centers, lambda center: squared_distance(point, center), "d2")


def assign(df: DataFrame, vector: str, centers: Centers, output: str = "cluster") -> DataFrame:
    """Label each row with its nearest centre, the lower label on a tie."""
    return df.withColumn(output, F.array_min(_distances(vector, centers))["cluster"])


def kmeans_from_centers(
    df: DataFrame, vector: str, centers: Centers, iterations: int
) -> dict[int, list[float]]:
    """Lloyd's iterations from given centres.

    Rows never move: each iteration is one narrow pass with partial sums per
    cluster, and only k centres return to the driver. A cluster that loses all
    its rows keeps its centre.
    """
    current = _by_label(centers)
    for _ in range(iterations):
        means = group_means(assign(df, vector, current, "_cluster"), "_cluster", vector)
        for row in means.collect():
            current[row["_cluster"]] = list(row["mean"])
    return current


def center_distances(df: DataFrame, key: str, vector: str, centers: Centers) -> DataFrame:
    """Euclidean distance of each row to every centre."""
    return df.select(key, F.explode(_distances(vector, centers)).alias("c")).select(
        key, "c.cluster", F.sqrt("c.d2").alias("distance")
    )


def nearest_to_centers(
    df: DataFrame, key: str, vector: str, centers: Centers, k: int = 6
) -> DataFrame:
    """The ``k`` rows most similar to each centre by cosine. The rank filter is
    applied per task before the shuffle, so k rows per task and centre move."""
    point = doubles(vector)
    scores = _to_centers(centers, lambda center: cosine(point, center), "similarity")
    scored = df.select(key, F.explode(scores).alias("c")).select(key, "c.cluster", "c.similarity")
    order = Window.partitionBy("cluster").orderBy(F.round("similarity", 12).desc(), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ------------------------------------------------------- describing clusters


def attach_cluster(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cleaned rows with their cluster label, matched by key."""
    return rows.join(labels.select(key, "cluster"), key)


def cluster_sizes(df: DataFrame, key: str = "doc_id", cluster: str = "cluster") -> DataFrame:
    """Rows with a key per cluster."""
    return df.groupBy(cluster).agg(F.count(key).alias("size"))


def cluster_centers(weights: DataFrame, sizes: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Centre weights in long form; a term absent from a cluster has weight 0
    and no row. ``sizes`` has one row per cluster and includes documents that
    have no term at all."""
    sums = weights.groupBy(cluster, "term").agg(F.sum("weight").alias("total"))
    return sums.join(sizes.select(cluster, "size"), cluster).select(
        cluster, "term", (F.col("total") / F.col("size")).alias("weight")
    )


def top_terms(centers: DataFrame, n: int = 6, cluster: str = "cluster") -> DataFrame:
    """The ``n`` heaviest terms of each centre, ties by term. Weights are sums
    in no fixed order, so they tie when equal to 12 digits."""
    order = Window.partitionBy(cluster).orderBy(F.round("weight", 12).desc(), "term")
    return centers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def cluster_names(top: DataFrame, words: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Comma-joined surface words of a cluster's top terms, in rank order.
    ``top`` holds a few rows per cluster, so the lists stay short."""
    shown = top.join(words, "term", "left").withColumn("word", F.coalesce("word", "term"))
    return (
        shown.groupBy(cluster)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("ranked"))
        .select(cluster, F.array_join(F.col("ranked.word"), ",").alias("name"))
    )


def cluster_titles(
    df: DataFrame, key: str = "doc_id", title: str = "title", cluster: str = "cluster"
) -> DataFrame:
    """Titles cluster by cluster, as rows: one cluster may hold a large share
    of the table, so its titles are range-sorted over many tasks and never
    gathered into one list."""
    return df.select(cluster, key, title).orderBy(cluster, key)
