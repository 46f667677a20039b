import math

import numpy as np
import pytest
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.sql import functions as F

from topicloom.operators import ngram_counts
from topicloom.operators import vocabulary as V
from topicloom.operators import weighting as W
from topicloom.plans.stages import TfidfVectorizer


def docs(spark, *lists):
    rows = [(i, list(words), list(words)) for i, words in enumerate(lists)]
    return spark.createDataFrame(rows, "doc_id long, words array<string>, stems array<string>")


def small(spark):
    return docs(spark, ["a", "b"], ["a"], ["c", "a"])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_idf_is_smoothed(spark):
    idf = W.idf_table(V.fit_vocabulary(small(spark), 3, 1, 1, max_df=1.0), 3)
    got = {r.term: r.idf for r in idf.collect()}
    assert got == pytest.approx({"a": 1.0, "b": 1 + math.log(2), "c": 1 + math.log(2)})


def fitted(docs, **limits):
    return TfidfVectorizer(high=1, maxDF=1.0, **limits).fit(docs)


def test_single_and_double_weighting(spark):
    table = small(spark)
    b = 1 + math.log(2)
    for power in (1, 2):
        rows = W.term_weights(fitted(table, idfPower=power), table).collect()
        got = {(r.doc_id, r.term): r.weight for r in rows}
        length = math.hypot(1, b**power)
        assert got[0, "a"] == pytest.approx(1 / length)
        assert got[0, "b"] == pytest.approx(b**power / length)
        assert got[1, "a"] == pytest.approx(1)
    # An unseen term drops, the rest is scaled to length 1.
    fresh = docs(spark, ["a", "z", "b", "b"])
    got = {r.term: (r.tf, r.weight) for r in W.term_weights(fitted(table), fresh).collect()}
    length = math.hypot(1, 2 * b)
    assert got["a"] == pytest.approx((1, 1 / length)) and got["b"] == pytest.approx((2, 2 * b / length))


def test_bounds_are_shares(spark):
    with pytest.raises(ValueError, match="share"):
        TfidfVectorizer(minDF=2.0).fit(small(spark))


def test_vocabulary_does_not_depend_on_the_partitions(spark):
    table = V.analyze(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), stemmer="s_strip"
    ).select("doc_id", "words", "stems")
    found = []
    for n in (1, 16):
        dealt = table.repartition(n, "doc_id")
        kept = V.fit_vocabulary(dealt, 200, max_features=500)
        found.append(sorted(tuple(r) for r in kept.collect()))
    assert found[0] == found[1] and len(found[0]) == 500


def test_counts_agree_with_count_vectorizer_and_idf(spark):
    table = V.analyze(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), stemmer="s_strip"
    ).select("doc_id", "words", "stems")
    n = table.count()
    kept = V.fit_vocabulary(table, n, 1, 1, min_df=0.05, max_df=0.8)
    cv = CountVectorizer(inputCol="stems", outputCol="tf", minDF=0.05, maxDF=0.8).fit(table)
    assert sorted(cv.vocabulary) == sorted(r.term for r in kept.collect())
    idf = IDF(inputCol="tf", outputCol="w").fit(cv.transform(table)).idf
    ours = {r.term: r.idf for r in W.idf_table(kept, n).collect()}
    for term, value in zip(cv.vocabulary, idf, strict=True):
        assert ours[term] - 1 == pytest.approx(value)


def test_levelwise_counting_equals_plain_counting(spark):
    table = V.analyze(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), stemmer="s_strip"
    ).select("doc_id", "words", "stems")
    n = table.count()
    plain = V.cap(V.prune(V.document_frequency(V.with_terms(table)), n, 0.02, 0.8), 3000)
    level = V.fit_vocabulary(table, n, min_df=0.02, max_df=0.8, max_features=3000)
    assert sorted(plain.collect()) == sorted(level.collect())
    assert any(" " in r.term for r in level.collect())


def test_counting_sends_a_row_per_distinct_term_of_a_batch(spark):
    rows = [(i, ["a", "b", "a", None]) for i in range(500)] + [(500, None), (501, [])]
    table = spark.createDataFrame(rows, "doc_id long, stems array<string>").coalesce(1)
    assert sorted(map(tuple, ngram_counts.stem_tallies(table).collect())) == [
        ("a", 1000, 500),
        ("b", 500, 500),
    ]
    got = {r.term: (r.df, r.total) for r in V.frequent_terms(table, 2).collect()}
    assert got == {
        "a": (500, 1000), "b": (500, 500), "a b": (500, 500), "b a": (500, 500), "a b a": (500, 500)
    }
    assert V.frequent_terms(table, 501).count() == 0


def test_many_known_terms_are_joined(spark, monkeypatch):
    table = V.analyze(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), stemmer="s_strip"
    ).select("doc_id", "words", "stems")
    sent = sorted(V.frequent_terms(table, 4).collect())
    monkeypatch.setattr(V, "KNOWN_TERMS", 10)
    assert sorted(V.frequent_terms(table, 4).collect()) == sent
    assert any(r.term.count(" ") == 2 for r in sent)


def test_bounds_are_inclusive_and_cap_breaks_ties_by_term(spark):
    table = docs(spark, ["a", "b", "d"], ["a", "b"], ["a", "c"], ["a", "c"])
    freq = V.document_frequency(table, "stems")
    kept = {r.term for r in V.prune(freq, 4, 0.5, 0.5).collect()}
    assert kept == {"b", "c"}
    assert [r.term for r in V.cap(freq, 2).collect()] == ["a", "b"]
    assert {r.term for r in V.prune(freq, 4, 1, 3).collect()} == {"b", "c", "d"}


def test_weights_have_length_one(spark):
    rows = W.term_weights(fitted(small(spark)), small(spark))
    norms = rows.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert len(norms) == 3 and all(r.n == pytest.approx(1) for r in norms)


def test_first_surface_word_and_ngram_labels(spark):
    table = spark.createDataFrame(
        [(2, ["cat"], ["cat"]), (1, ["cats", "dogs", "cat"], ["cat", "dog", "cat"])],
        "doc_id long, words array<string>, stems array<string>",
    )
    frame = V.vocab_frame(table)
    assert V.vocab_size(frame).first() == (4, 3, 2)
    words = V.first_words(frame)
    assert {r.stem: r.word for r in words.collect()} == {"cat": "cats", "dog": "dogs"}
    few = V.first_words_of(table, spark.createDataFrame([("cat",)], "stem string"))
    assert [(r.stem, r.word) for r in few.collect()] == [("cat", "cats")]
    terms = spark.createDataFrame([("dog cat",)], "term string")
    assert V.stem_to_word(terms, words).first().word == "dogs cats"
    assert V.stem_to_word(terms, words, first_only=True).first().word == "dogs"


def test_weighting_does_not_shuffle(spark, tmp_path):
    path = str(tmp_path / "docs")
    small(spark).write.parquet(path)
    table = spark.read.parquet(path)
    plan = plan_of(W.term_weights(fitted(table), table))
    assert "hashpartitioning" not in plan


def test_no_python_outside_the_stemmer(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    native = V.document_frequency(V.with_terms(V.analyze(table, stemmer="s_strip")))
    assert "Python" not in plan_of(native) and "ArrowEval" not in plan_of(native)
    assert plan_of(V.vocab_frame(V.analyze(table))).count("ArrowEvalPython") == 1


def test_known_terms_are_the_n_grams_of_the_vocabulary(spark):
    lists = [["a", "b", "a", "", "b", None, "c", "a"], None, [], ["b", "c"], ["x", "a", "b", "c", "a", "b", "c"]]
    table = spark.createDataFrame(list(enumerate(lists)), "doc_id long, stems array<string>").coalesce(1)
    terms = ["a", "a b c", "b a", " b", "c a b", "", "z y"]
    rows = V.with_terms(table).select("terms", ngram_counts.known_terms(terms).alias("known")).collect()
    assert all(sorted(r.known) == sorted(t for t in r.terms if t in terms) for r in rows)
    assert sum(len(r.known) for r in rows) == 11


def test_weights_do_not_form_the_other_n_grams(spark):
    table = small(spark)
    plan = plan_of(fitted(table).transform(table).select("features"))
    assert "zip_with" not in plan and "ArrowEvalPython" in plan


def test_longer_runs_are_counted_from_places(spark):
    table = docs(spark, ["a", "b", "a", "b"], ["a", "b", "q"], ["r"], ["a"])
    assert [list(r.codes) for r in ngram_counts.coded(table, ["b", "a"]).collect()] == [[1, 0, 1, 0], [1, 0, -1]]


def test_only_pairs_in_full_buckets_are_tallied(spark, monkeypatch):
    words = [f"w{i:02}" for i in range(40)]
    lists = [["w00", "w01", words[2 + i], words[39 - i]] for i in range(19)] + [["w05"], [], ["w00", "w01", "w00", "w01"]]
    table = docs(spark, *lists).repartition(3)
    codes = ngram_counts.coded(table, words, packed=True)
    full = ngram_counts.full_buckets(codes, 20, len(words))
    assert np.flatnonzero(full).tolist() == ngram_counts.bucket_of(np.array([1])).tolist()
    assert not ngram_counts.full_buckets(codes, 22, len(words)).any()
    assert not ngram_counts.full_buckets(codes.limit(0), 0, len(words)).any()
    known = [(words, np.arange(len(words)))]

    def counted(least):
        return sorted(tuple(r) for r in ngram_counts.frequent_runs(codes, least, known).select("term", "df", "total").collect())

    plain = V.document_frequency(V.with_terms(table, 2, 2)).collect()
    for bits, pieces in ((ngram_counts.BUCKET_BITS, ngram_counts.PIECE_BITS), (4, 3)):
        monkeypatch.setattr(ngram_counts, "BUCKET_BITS", bits)
        monkeypatch.setattr(ngram_counts, "PIECE_BITS", pieces)
        for least in (0, 1, 2, 20, 21):
            assert counted(least) == sorted((r.term, r.df, r.total) for r in plain if r.df >= least)


def test_a_batch_gives_the_first_place_of_a_stem_once(spark):
    rows = [(7, ["b", "a"]), (None, ["c"]), (3, ["d", "a", "a"]), (3, ["a"]), (5, ["b"])]
    table = spark.createDataFrame([(k, v, [w + "1" for w in v]) for k, v in rows], "doc_id long, stems array<string>, words array<string>")
    places = ngram_counts.first_places(table.coalesce(1), ["a", "b", "c", "z"])
    assert sorted(tuple(r) for r in places.collect() if r.doc_id) == [(3, 0, "a", "a1"), (5, 0, "b", "b1")]
    assert places.count() == 3
    named = ngram_counts.first_places(table.coalesce(1).withColumn("doc_id", F.col("doc_id").cast("string")), ["a"])
    assert named.count() == 3


ODD = [
    "Ponies' ties - s ies bus grass yes cats aes shoes", None, "", "don't -- '' _ The THE i'm",
    "É caret] KKelvin İz naïve straße", "a\nb c\td", "zebra", "cats", "",
]


def odd_texts(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("stemmer", ["s_strip", "porter2", "none"])
def test_words_by_batch_are_those_of_the_expressions(spark, stemmer):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for table in (odd_texts(spark), real.limit(100)):
        for stop_words in (V.X.ENGLISH, ()):
            plain = V.analyze(table, stemmer=stemmer, stop_words=stop_words).select("doc_id", "words", "stems")
            batch = V.analyze_letters(table, stemmer=stemmer, stop_words=stop_words)
            assert sorted(plain.collect()) == sorted(batch.select(plain.columns).collect())
            lines = V.analyze_letters(table, stemmer=stemmer, stop_words=stop_words, as_lines=True)
            split = lines.select("doc_id", V.X.line_words("words").alias("words"), V.X.line_words("stems").alias("stems"))
            assert sorted(plain.collect()) == sorted(split.collect())
    assert "filter(" not in plan_of(V.analyze_letters(odd_texts(spark)))


def test_lines_count_weigh_and_name_as_arrays_do(spark, monkeypatch):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    arrays, lines = (
        V.analyze_letters(real, stemmer="s_strip", as_lines=as_lines).select("doc_id", "words", "stems")
        for as_lines in (False, True)
    )
    counted = sorted(V.frequent_terms(arrays, 4).collect())
    assert sorted(V.frequent_terms(lines, 4).collect()) == counted
    top = spark.createDataFrame([("cat",), *{(r.term.split(" ")[0],) for r in counted[::50]}], "stem string")
    first = V.first_words(V.vocab_frame(arrays)).join(top.distinct(), "stem", "left_semi")
    assert sorted(V.first_words_of(lines, top).collect()) == sorted(first.select("stem", "word").collect())
    fit = TfidfVectorizer(minDF=0.02).fit(arrays)
    assert sorted(W.term_weights(fit, lines).collect()) == sorted(W.term_weights(fit, arrays).collect())
    monkeypatch.setattr(V, "KNOWN_TERMS", 10)
    assert sorted(V.frequent_terms(lines, 4).collect()) == counted


def test_counts_are_those_of_the_known_terms(spark):
    lists = [["a", "b", "a", "", "b", None, "c", "a"], None, [], ["b", "c"]]
    table = spark.createDataFrame(list(enumerate(lists)), "doc_id long, stems array<string>").coalesce(1)
    terms = ["a", "a b", "b c", "z"]
    rows = table.select(
        ngram_counts.known_terms(terms).alias("t"), ngram_counts.known_counts(terms).alias("v")
    ).collect()
    assert [r.v.toArray().tolist() for r in rows] == [[r.t.count(t) for t in terms] for r in rows]
    assert rows[1].v.numNonzeros() == 0


@pytest.mark.parametrize("held", [16, 64, 4_000_000])
def test_tallies_of_a_task_are_added_up(monkeypatch, held):
    monkeypatch.setattr(ngram_counts, "HELD_ROWS", held)
    parts = [(np.arange(i % 7, 20), np.full(20 - i % 7, 2), np.ones(20 - i % 7, int)) for i in range(30)]
    found = [np.concatenate(column) for column in zip(*ngram_counts.merged(iter(parts)), strict=True)]
    n, d = (np.bincount(found[0], found[i]).tolist() for i in (1, 2))
    assert d == [sum(i % 7 <= code for i in range(30)) for code in range(20)]
    assert n == [2 * v for v in d]
    assert len(found[0]) == 20 if held > 1000 else len(found[0]) < sum(len(c) for c, *_ in parts)
    assert list(ngram_counts.merged(iter([]))) == []


def test_doc_frequency_has_the_terms_of_one_document_in_a_thousand(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from topicloom.plans import catalogue

    texts = ["common word"] * 150 + ["quiet thing"] * 150
    texts[7] += " seldom"
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})
    pq.write_table(table, tmp_path / "documents.parquet")
    got = {r.term: r.df for r in catalogue.QUERIES["doc_frequency"](spark, str(tmp_path)).collect()}
    assert got["seldom"] == got["word seldom"] == 1
    assert got["common"] == got["quiet thing"] == 150


@pytest.mark.parametrize("as_lines", [False, True])
def test_batches_are_counted_in_pieces(spark, monkeypatch, as_lines):
    import pyarrow as pa

    from topicloom.functions import text as X

    rng = np.random.default_rng(3)
    rows = [(i, [f"w{n}" for n in rng.integers(0, 6, rng.integers(0, 9))]) for i in range(80)] + [(80, None)]
    table = spark.createDataFrame(rows, "doc_id long, stems array<string>").coalesce(1)
    if as_lines:
        line = F.when(F.size("stems") > 0, F.concat(F.array_join("stems", " "), F.lit(" ")))
        table = table.withColumn("stems", line)

    def results():
        terms = V.frequent_terms(table, 4)
        known = sorted(r.term for r in terms.collect())
        counts = table.select("doc_id", ngram_counts.known_counts(known).alias("c"))
        return sorted(map(tuple, terms.collect())), sorted((r.doc_id, str(r.c)) for r in counts.collect())

    want = results()
    monkeypatch.setattr(X, "PIECE_BYTES", 40)
    assert len(X.pieces(pa.array([["a"] * 6] * 5))) == 5
    assert results() == want and len(want[0]) > 20
