import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from topicloom.operators import clustering as C
from topicloom.operators import features

POINTS = [(0, [0.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [9.0, 9.0]), (4, [9.0, 10.0]), (5, [10.0, 9.0])]


def points(spark):
    return spark.createDataFrame(POINTS, "id long, v array<double>")


def cost(spark, df, centers):
    rows = C.center_distances(df, "id", "v", centers).groupBy("id").agg(F.min("distance").alias("d"))
    return rows.agg(F.sum(F.col("d") * F.col("d"))).first()[0]


def test_kmeans_from_given_centres(spark):
    df = points(spark)
    start = [[0.0, 0.0], [1.0, 1.0]]
    costs = []
    for n in range(4):
        costs.append(cost(spark, df, C.kmeans_from_centers(df, "v", start, n)))
    assert costs == sorted(costs, reverse=True)
    centers = C.kmeans_from_centers(df, "v", start, 3)
    assert centers[0] == pytest.approx([1 / 3, 1 / 3])
    assert centers[1] == pytest.approx([28 / 3, 28 / 3])
    labels = {r.id: r.c for r in C.assign(df, "v", centers, "c").collect()}
    assert labels == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    # A centre without rows stays; a tie goes to the lower number.
    kept = C.kmeans_from_centers(df, "v", {**centers, 2: [500.0, 500.0]}, 1)
    assert kept[2] == [500.0, 500.0]
    assert {r.c for r in C.assign(df, "v", [[3.0, 3.0], [3.0, 3.0]], "c").collect()} == {0}


def test_silhouette_counts_a_singleton_as_zero(spark):
    rows = [(0, [0.0]), (0, [1.0]), (1, [10.0]), (1, [11.0]), (2, [50.0])]
    df = spark.createDataFrame(rows, "cluster int, v array<double>")
    df = df.withColumn("features", array_to_vector("v"))
    def s(a, b):
        return (b - a) / max(a, b)
    expected = [
        s(1, (100 + 121) / 2), s(1, (81 + 100) / 2),
        s(1, (100 + 81) / 2), s(1, (121 + 100) / 2), 0,
    ]
    assert C.silhouette(df) == pytest.approx(sum(expected) / 5)


def test_sweep_and_choice_of_k(spark):
    df = points(spark).withColumn("features", array_to_vector("v"))
    sweep, labelled = C.k_sweep(df, ks=(2, 3))
    assert len({(r.cluster_2, r.id > 2) for r in labelled.collect()}) == 2
    assert {"cluster_2", "cluster_3"} <= set(labelled.columns)
    assert [r.k for r in sweep.collect()] == [2, 3]
    assert all(-1 <= r.silhouette <= 1 for r in sweep.collect())
    assert C.best_k(sweep) == 2
    tied = spark.createDataFrame([(3, 1.0, 0.5), (2, 1.0, 0.5)], sweep.schema)
    assert C.best_k(tied) == 2


def test_centres_top_terms_and_names(spark):
    weights = spark.createDataFrame(
        [(1, 0, "b", 0.5), (1, 0, "a", 0.5), (2, 0, "c", 0.2), (3, 1, "a", 1.0)],
        "doc_id long, cluster int, term string, weight double",
    )
    # Document 4 is in cluster 1 and has no term.
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, cluster int")
    sizes = C.cluster_sizes(rows)
    centers = C.cluster_centers(weights, sizes)
    got = {(r.cluster, r.term): r.weight for r in centers.collect()}
    assert got == pytest.approx({(0, "a"): 0.25, (0, "b"): 0.25, (0, "c"): 0.1, (1, "a"): 0.5})
    top = C.top_terms(centers, 2)
    assert [(r.cluster, r.rank, r.term) for r in top.orderBy("cluster", "rank").collect()] == [
        (0, 1, "a"), (0, 2, "b"), (1, 1, "a"),
    ]
    words = spark.createDataFrame([("a", "apple"), ("b", "bee")], "term string, word string")
    assert {r.cluster: r.name for r in C.cluster_names(top, words).collect()} == {
        0: "apple,bee", 1: "apple",
    }
    joined = C.attach_cluster(weights.select("doc_id", "term"), rows)
    assert joined.count() == 4 and "cluster" in joined.columns


def test_rank_filter_runs_before_the_shuffle(spark):
    near = C.nearest_to_centers(points(spark), "id", "v", [[1.0, 0.0], [1.0, 1.0]], 2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    rows = near.orderBy("cluster", "rank").collect()
    assert [(r.cluster, r.id) for r in rows] == [(0, 2), (0, 5), (1, 3), (1, 4)]


def test_ordinals_number_all_rows_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    rows = features.ordinals(df, "n", "v").collect()
    assert all(r.n == r.v for r in rows) and len(rows) == 1000


def test_string_index_and_one_hot(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "s string")
    rows = features.string_index(df, "s").orderBy("idx").collect()
    assert [(r.value, r.n, r.idx) for r in rows] == [("c", 2, 0), ("a", 1, 1), ("b", 1, 2)]
    hot = features.one_hot(df, "s", {"a": "is_a", "c": "is_c"})
    assert hot.agg(F.sum("is_a"), F.sum("is_c"), F.count("is_a")).first() == (1, 2, 5)
    both = features.assemble(hot.withColumn("v", F.array(F.lit(0.5))), ["is_a", "v"])
    assert list(both.filter("s = 'a'").first().features) == [1.0, 0.5]


def test_word2vec_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    rows = [(i, ["a", "b", "c", "d"]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, stems array<string>")
    assert features.fit_word2vec(df, vector_size=2, min_count=1).getNumPartitions() == 4
    monkeypatch.setattr(features, "TOKENS_PER_PARTITION", 25)
    assert features.fit_word2vec(df, vector_size=2, min_count=1).getNumPartitions() == 7
    assert features.fit_word2vec(df, vector_size=2, min_count=1, partitions=1).getNumPartitions() == 1


def test_word2vec_document_vector_is_the_mean(spark):
    rows = [(i, ["x", "y"]) for i in range(5)] + [(9, ["unseen"])]
    df = spark.createDataFrame(rows, "doc_id long, stems array<string>")
    model = features.fit_word2vec(df, vector_size=4, partitions=1)
    words = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    out = {r.doc_id: r.features.toArray() for r in model.transform(df).collect()}
    assert out[0] == pytest.approx((words["x"] + words["y"]) / 2, abs=1e-6)
    assert list(out[9]) == [0.0] * 4


def test_labels_of_centres_stay(spark):
    df = points(spark)
    centers = {7: [0.0, 0.0], 3: [9.0, 9.0]}
    labels = {r.id: r.c for r in C.assign(df, "v", centers, "c").collect()}
    assert labels == {0: 7, 1: 7, 2: 7, 3: 3, 4: 3, 5: 3}
    assert {r.cluster for r in C.nearest_to_centers(df, "id", "v", centers, 1).collect()} == {3, 7}


def test_plan_does_not_grow_with_the_centres(spark):
    df = points(spark)
    nodes = [
        str(C.assign(df, "v", [[float(i), 0.0] for i in range(k)])._jdf.queryExecution().optimizedPlan().treeString()).count("CASE")
        for k in (2, 200)
    ]
    assert nodes[0] == nodes[1]
