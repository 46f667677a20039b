import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from topicloom.plans.stages import EmptyColumnDropper, TextAnalyzer, TfidfVectorizer
from topicloom.plans.topic_model import FittedTopics, TopicModel


def corpus(spark):
    cats = ["cats and kittens purr", "a kitten and a cat", "cat purrs, cats purring"]
    ships = ["ships sail the sea", "a ship sailing the seas", "sailing ships at sea"]
    rows = [(i, t, None) for i, t in enumerate(cats + ships)] + [(6, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, note string")


def model():
    return TopicModel(k=2, n_terms=2, restarts=3, weights={"low": 1, "high": 2, "maxDF": 1.0})


def test_topics_are_found_named_saved_and_loaded(spark, tmp_path):
    fitted = model().fit(corpus(spark))
    rows = fitted.transform(corpus(spark)).collect()
    # The row without a text goes, the empty column does not take the others along.
    assert sorted(r.doc_id for r in rows) == list(range(6))
    label = {r.doc_id: r.cluster for r in rows}
    assert label[0] == label[1] == label[2] != label[3] == label[4] == label[5]
    names = {r.cluster: r.name for r in fitted.names.collect()}
    assert set(names[label[0]].split(",")) <= {"cats", "purr", "kittens", "kittens purr"}
    assert {r.cluster: r["size"] for r in fitted.sizes().collect()} == {0: 3, 1: 3}
    hot = fitted.one_hot(fitted.transform(corpus(spark)))
    assert hot.agg(F.sum(F.col(f"`{names[0]}`"))).first()[0] == 3
    assert {r.doc_id: r.cluster for r in fitted.labels.collect()} == label

    fitted.save(str(tmp_path / "m"))
    again = FittedTopics.load(spark, str(tmp_path / "m"))
    got = {(r.doc_id, r.cluster, r.name) for r in again.transform(corpus(spark)).collect()}
    assert got == {(r.doc_id, r.cluster, r.name) for r in rows}
    fresh = spark.createDataFrame([(9, "seas and ships", "x"), (10, "zzz", "x")], "doc_id long, text string, note string")
    scored = {r.doc_id: r.cluster for r in again.transform(fresh).collect()}
    assert scored[9] == label[3] and set(scored) == {9, 10}


def test_empty_column_dropper_learns_from_its_argument(spark):
    df = corpus(spark)
    learned = EmptyColumnDropper().fit(df)
    later = df.withColumn("note", F.lit("now filled"))
    assert learned.transform(later).columns == ["doc_id", "text"]


def test_long_form_equals_the_vectors(spark):
    from topicloom.operators import weighting as W

    docs = TextAnalyzer(stemmer="s_strip").transform(corpus(spark).filter("text is not null"))
    for power in (1, 2):
        fitted = TfidfVectorizer(maxDF=1.0, idfPower=power).fit(docs)
        terms = W.terms_of(fitted)
        vectors = {r.doc_id: r.features for r in fitted.transform(docs).collect()}
        for r in W.term_weights(fitted, docs).collect():
            assert vectors[r.doc_id][terms.index(r.term)] == pytest.approx(r.weight)


def test_k_is_chosen_among_several(spark):
    fitted = TopicModel(k=[2, 3, 4], n_terms=2, weights={"low": 1, "high": 1, "maxDF": 1.0}).fit(corpus(spark))
    assert fitted.sizes().count() == len({r.cluster for r in fitted.labels.collect()}) in (2, 3, 4)


def test_stages_compose_in_a_pipeline(spark):
    pipe = Pipeline(stages=[TextAnalyzer(), TfidfVectorizer(maxDF=1.0)])
    out = pipe.fit(corpus(spark).na.drop(subset=["text"])).transform(corpus(spark).na.drop(subset=["text"]))
    assert out.filter(F.col("features").isNull()).count() == 0


def test_scoring_is_narrow(spark, tmp_path):
    fitted = model().fit(corpus(spark))
    path = str(tmp_path / "in")
    corpus(spark).write.parquet(path)
    plan = fitted.transform(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_missing_columns_are_reported(spark):
    with pytest.raises(ValueError, match="missing columns"):
        TopicModel(text="subjects").fit(corpus(spark))


def test_word2vec_topics_are_named_by_near_words(spark, tmp_path):
    texts = ["cats purr softly"] * 8 + ["ships sail far"] * 8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = {"vector_size": 8, "min_count": 1, "partitions": 1}
    fitted = TopicModel(k=2, n_terms=2, vectors="word2vec", weights=weights).fit(df)
    label = {r.doc_id: r.cluster for r in fitted.transform(df).collect()}
    assert {label[i] for i in range(8)}.isdisjoint({label[i] for i in range(8, 16)})
    words = {w for r in fitted.names.collect() for w in r.name.split(",")}
    assert words <= set(" ".join(texts).split()) and len(words) > 1
    fitted.save(str(tmp_path / "m"))
    again = FittedTopics.load(spark, str(tmp_path / "m"))
    assert {r.doc_id: r.cluster for r in again.transform(df).collect()} == label
    with pytest.raises(ValueError, match="vectors is"):
        TopicModel(vectors="other").fit(df)
