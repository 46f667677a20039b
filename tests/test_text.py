import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as X
from topicloom.functions.porter2 import stem
from topicloom.operators import vocabulary

# Published examples of the algorithm and words that exercise each rule.
STEMS = {
    "consigned": "consign", "consistency": "consist", "knackeries": "knackeri",
    "generously": "generous", "skies": "sky", "dying": "die", "news": "news",
    "ponies": "poni", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas",
    "this": "this", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope", "agreed": "agre",
    "feed": "feed", "relational": "relat", "rationalization": "ration", "by": "by",
    "say": "say", "cry": "cri", "adoption": "adopt", "controlling": "control",
    "formative": "format", "electricity": "electr", "hopefulness": "hope", "inning": "inning",
    "youth": "youth", "libraries": "librari", "baby": "babi", "is": "is", "": "",
}


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


@pytest.mark.parametrize(("word", "expected"), STEMS.items())
def test_porter2(word, expected):
    assert stem(word) == expected


def test_letter_tokens_keep_hyphen_underscore_apostrophe(spark):
    text = "Baby-food_x don't, 19th-century É, [caret] ^ \\ x"
    row = one(spark, text, X.letter_tokens("t").alias("a"))
    assert row.a == ["baby-food_x", "don't", "th-century", "caret", "x"]


def test_letter_tokens_match_the_ml_tokenizer(spark):
    from pyspark.ml.feature import RegexTokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    ml = RegexTokenizer(pattern="[^a-zA-Z-_']", inputCol="text", outputCol="ml").transform(docs)
    assert ml.filter(F.col("ml") != X.letter_tokens("text")).count() == 0


def test_word_tokens_split_marks_and_clitics(spark):
    row = one(spark, "It's 1,000 state-of-the-art books, don't.", X.word_tokens("t").alias("a"))
    assert row.a == ["it", "'s", "1,000", "state-of-the-art", "books", ",", "do", "n't", "."]
    row = one(spark, "a--b -c d- é_1", X.word_char_tokens("t").alias("a"))
    assert row.a == ["a--b", "c", "d", "é_1"]
    row = one(spark, "12 a1 !", X.keep_alpha(F.split("t", " ")).alias("a"))
    assert row.a == ["a1"]


def test_sentences(spark):
    row = one(spark, "One two. Three!", X.sentence_tokens("t").alias("a"))
    assert row.a == [["One", "two"], ["Three"]]


def test_accents_fold_to_ascii(spark):
    row = one(spark, "Éàçñöß ﬁn é Ａ 中", X.fold_accents("t").alias("a"))
    assert row.a == "Eacno fin e A "
    assert one(spark, "plain", X.fold_accents("t").alias("a")).a == "plain"


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        ("foo\u00a0bar", "foo bar"),
        ("a\u3000b", "a b"),
        ("wait…what", "wait...what"),
        ("™ №", "TM No"),
        ("！", "!"),
        ("½", "12"),
        ("\U0001d400", "A"),
        ("a\u0301中", "a"),
    ],
)
def test_compatibility_forms_fold(spark, text, folded):
    assert one(spark, text, X.fold_accents("t").alias("a")).a == folded


def test_s_strip(spark):
    words = ["ponies", "cats", "bus", "grass", "dies", "movies", "shoes", "trees", "s", "is"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(X.s_strip("w")).collect()]
    assert got == ["pony", "cat", "bus", "grass", "dy", "movy", "shoe", "tree", "", "i"]


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(X.ngrams("w")).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]
    assert df.select(X.ngrams("w", 2, 2)).first()[0] == ["a b", "b c"]


def test_stop_word_stage(spark):
    # The stem of "hers" is no stop word in raw form, "her" is.
    df = spark.createDataFrame([(1, "this hers cats")], "doc_id long, text string")
    raw = vocabulary.analyze(df, stop_words=["hers", "this"]).first()
    assert (raw.words, raw.stems) == (["cats"], ["cat"])
    late = vocabulary.analyze(df, stop_words=["hers", "this"], stop_stage="stem").first()
    assert (late.words, late.stems) == (["hers", "cats"], ["her", "cat"])


def test_stems_stay_aligned_and_null_stays_null(spark):
    df = spark.createDataFrame(
        [(1, "Running dogs"), (2, ""), (3, None), (4, "cats")], "doc_id long, text string"
    )
    rows = vocabulary.analyze(df).orderBy("doc_id").collect()
    assert [r.words for r in rows] == [["running", "dogs"], [], None, ["cats"]]
    assert [r.stems for r in rows] == [["run", "dog"], [], None, ["cat"]]


def test_custom_tokenizer(spark):
    df = spark.createDataFrame([(1, "a|b|1")], "doc_id long, text string")
    row = vocabulary.analyze(df, tokenizer=lambda c: F.split(c, r"\|"), stop_words=[], stemmer="none")
    assert row.first().words == ["a", "b"]


@pytest.mark.parametrize("as_line", [False, True])
def test_words_are_cut_in_pieces_of_bounded_bytes(spark, monkeypatch, as_line):
    import pyarrow as pa

    texts = ["River stones", None, "", "a much longer text than a piece", "été x-ray's", "stones", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)

    def words():
        found = rows.select("id", X.letter_words("text", stemmer="s_strip", as_line=as_line).alias("w"))
        return sorted(map(tuple, found.collect()))

    want = words()
    monkeypatch.setattr(X, "PIECE_BYTES", 10)
    assert words() == want
    pieces = X.pieces(pa.array(texts))
    assert pa.concat_arrays(pieces).to_pylist() == texts
    assert max(len("".join(t or "" for t in p.to_pylist()).encode()) for p in pieces) <= 31 + 10
    assert len(pieces) > 2
