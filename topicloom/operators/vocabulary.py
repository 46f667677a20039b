"""Vocabulary: occurrences, document frequency, pruning, the cap, and the
stem-to-word lookup.

Counting never needs a document's rows to meet: every document is one row, so
its own counts are formed inside that row, and only per-term partial sums are
shuffled.

Arrays are unnested with the outer form and a filter on the result. The inner
form makes the optimizer test the array's size before the unnesting, and so
tokenize (and stem) every text twice.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from topicloom.functions import text as X
from topicloom.operators import ngram_counts
from topicloom.session import materialize

# Frequent n-grams of a level that are sent to every task.
KNOWN_TERMS = 500_000


def analyze(
    docs: DataFrame,
    text: str = "text",
    tokenizer: str | X.Tokenizer = "letters",
    stemmer: str = "porter2",
    stop_words: Sequence[str] = X.ENGLISH,
    stop_stage: str = "raw",
    fold: bool = False,
) -> DataFrame:
    """Add ``words`` and ``stems``: two arrays of equal length per document.

    Order of steps: cast, fold accents (option), lower-case and tokenize, keep
    tokens with a letter, drop stop words, stem. With ``stop_stage="stem"`` the
    stop words are compared with the stems instead of the raw tokens. A tokenizer
    of the caller's own must give tokens without spaces, which part n-grams.
    """
    if stop_stage not in ("raw", "stem"):
        raise ValueError("stop_stage is 'raw' or 'stem'")
    tokenize = X.TOKENIZERS[tokenizer] if isinstance(tokenizer, str) else tokenizer
    source = X.fold_accents(text) if fold else X.as_text(text)
    words = X.keep_words(tokenize(source), stop_words if stop_stage == "raw" else ())
    out = docs.withColumn("words", words).withColumn("stems", X.stem_tokens("words", stemmer))
    if stop_stage == "stem" and stop_words:
        pairs = F.filter(
            F.arrays_zip("words", "stems"), lambda p: ~p["stems"].isin(list(stop_words))
        )
        out = (
            out.withColumn("pairs", pairs)
            .withColumn("words", F.col("pairs.words"))
            .withColumn("stems", F.col("pairs.stems"))
            .drop("pairs")
        )
    return out


def analyze_letters(
    docs: DataFrame,
    text: str = "text",
    stemmer: str = "porter2",
    stop_words: Sequence[str] = X.ENGLISH,
    fold: bool = False,
    as_lines: bool = False,
) -> DataFrame:
    """``analyze`` by its default tokenizer and with raw stop words, batch by batch: the
    same columns, made in tasks of Python by whole-array steps. Of ``words`` and
    ``stems`` only those that are read are made. Lines (``X.letter_words``) serve
    ``frequent_terms``, the weights and ``first_words_of`` in place of arrays."""
    source = X.fold_accents(text) if fold else X.as_text(text)
    return docs.withColumns(
        {
            "words": X.letter_words(source, stop_words, as_line=as_lines),
            "stems": X.letter_words(source, stop_words, stemmer, as_lines),
        }
    )


def _array_of(docs: DataFrame, column: str) -> Column:
    """A column of words as arrays, whether it holds these or lines."""
    return F.col(column) if isinstance(docs.schema[column].dataType, T.ArrayType) else X.line_words(column)


def with_terms(docs: DataFrame, low: int = 1, high: int = 3) -> DataFrame:
    """Add ``terms``: the n-grams of ``stems``. A missing text has none."""
    terms = X.ngrams("stems", low, high)
    return docs.withColumn("terms", F.coalesce(terms, F.array().cast("array<string>")))


def explode_tokens(docs: DataFrame, key: str = "doc_id", tokens: str = "words") -> DataFrame:
    """One row per token occurrence."""
    return docs.select(key, F.posexplode_outer(tokens).alias("pos", "token")).filter(
        "token is not null"
    )


def stem_vocabulary(docs: DataFrame, stemmer: str = "porter2", tokens: str = "words") -> DataFrame:
    """Distinct tokens with their count; each is stemmed once."""
    occurrences = docs.select(F.explode_outer(tokens).alias("token")).filter("token is not null")
    counted = occurrences.groupBy("token").agg(F.count("*").alias("n"))
    stems = {"s_strip": X.s_strip, "porter2": X.porter2, "none": F.col}[stemmer]("token")
    return counted.select("token", stems.alias("stem"), "n")


def _word_pairs(docs: DataFrame, key: str) -> DataFrame:
    pairs = F.posexplode_outer(F.arrays_zip("words", "stems")).alias("pos", "p")
    return (
        docs.select(key, pairs)
        .select(key, "pos", F.col("p.stems").alias("stem"), F.col("p.words").alias("word"))
        .filter("stem is not null")
    )


def vocab_frame(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stem and surface word pairs with their count and first place in the corpus."""
    return (
        _word_pairs(docs, key)
        .groupBy("stem", "word")
        .agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("first"))
        .select(
            "stem",
            "word",
            "n",
            F.col(f"first.{key}").alias("first_doc"),
            F.col("first.pos").alias("first_pos"),
        )
    )


def vocab_size(frame: DataFrame) -> DataFrame:
    """Occurrences, distinct words and distinct stems of a vocabulary frame."""
    per_stem = frame.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    return per_stem.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("n_words"),
        F.count("*").alias("n_stems"),
    )


def first_words(frame: DataFrame) -> DataFrame:
    """The surface word each stem has first in the corpus."""
    return frame.groupBy("stem").agg(
        F.min_by("word", F.struct("first_doc", "first_pos")).alias("word")
    )


def first_words_of(docs: DataFrame, stems: DataFrame, key: str = "doc_id") -> DataFrame:
    """``first_words`` for a few stems only: a task gives one row for each of them that a
    document has. ``stems`` must be small (top terms of the clusters)."""
    wanted = [r["stem"] for r in stems.select("stem").distinct().collect()]
    return (
        ngram_counts.first_places(docs, wanted, key)
        .groupBy("stem")
        .agg(F.min_by("word", F.struct(key, "pos")).alias("word"))
    )


def stem_to_word(terms: DataFrame, words: DataFrame, first_only: bool = False) -> DataFrame:
    """Terms shown as surface words: each stem is mapped and the words joined
    with a space, or only the first stem is shown."""
    parts = terms.select("term", F.posexplode(X.term_stems("term")).alias("part", "stem"))
    if first_only:
        parts = parts.filter("part = 0")
    return (
        parts.join(words, "stem")
        .groupBy("term")
        .agg(F.array_sort(F.collect_list(F.struct("part", "word"))).alias("parts"))
        .select("term", F.array_join(F.col("parts.word"), " ").alias("word"))
    )


# --------------------------------------------------------- counts and pruning


def term_counts(docs: DataFrame, key: str = "doc_id", terms: str = "terms") -> DataFrame:
    """Raw count of each term in each document."""
    exploded = docs.select(key, F.explode_outer(terms).alias("term")).filter("term is not null")
    return exploded.groupBy(key, "term").agg(F.count("*").alias("tf"))


def _tally(term: Column, n: int, d: int) -> Column:
    return F.struct(
        term.alias("term"), F.lit(n).cast("bigint").alias("n"), F.lit(d).cast("bigint").alias("d")
    )


def _tallies(docs: DataFrame, terms: str) -> DataFrame:
    """A row per occurrence and a row per distinct term of each document."""
    return docs.select(
        F.inline_outer(
            F.concat(
                F.transform(F.col(terms), lambda t: _tally(t, 1, 0)),
                F.transform(F.array_distinct(terms), lambda t: _tally(t, 0, 1)),
            )
        )
    ).filter("term is not null")


def _sum_tallies(tallies: DataFrame) -> DataFrame:
    return tallies.groupBy("term").agg(F.sum("d").alias("df"), F.sum("n").alias("total"))


def document_frequency(docs: DataFrame, terms: str = "terms") -> DataFrame:
    """Documents each term occurs in (``df``) and its occurrences (``total``).
    One shuffle, of per-term partial sums."""
    return _sum_tallies(_tallies(docs, terms))


def bound(limit: int | float, n_docs: int) -> float:
    """A fraction of the documents, or an absolute count when given as int."""
    return limit if isinstance(limit, int) else limit * n_docs


def prune(
    frequency: DataFrame, n_docs: int, min_df: int | float = 0.001, max_df: int | float = 0.8
) -> DataFrame:
    """Terms that are neither too rare nor too common; both bounds inclusive."""
    return frequency.filter(
        F.col("df").between(float(bound(min_df, n_docs)), float(bound(max_df, n_docs)))
    )


def cap(frequency: DataFrame, max_features: int = 20_000) -> DataFrame:
    """The most frequent terms over the corpus, ties by term."""
    return frequency.orderBy(F.desc("total"), "term").limit(max_features)


def feature_names(vocabulary: DataFrame) -> DataFrame:
    """Index of each term in alphabetical order. The vocabulary is capped, so
    numbering it in one task is bounded."""
    return vocabulary.select(
        (F.row_number().over(Window.orderBy("term")) - 1).cast(T.IntegerType()).alias("idx"), "term"
    )


def _semi_joined_runs(docs: DataFrame, n: int, known: DataFrame, least: float) -> DataFrame:
    """Frequent runs of n stems, the known shorter ones met by joins."""
    stems = docs.select(_array_of(docs, "stems").alias("stems"))
    tallies = _tallies(stems.select(X.ngrams("stems", n, n).alias("terms")), "terms")
    for part in (n - 1, 1 - n):
        tallies = tallies.withColumn("part", F.substring_index("term", " ", part))
        tallies = tallies.join(known.withColumnRenamed("term", "part"), "part", "left_semi")
    return _sum_tallies(tallies.select("term", "n", "d")).filter(F.col("df") >= least)


def frequent_terms(
    docs: DataFrame, least: float, low: int = 1, high: int = 3
) -> DataFrame:
    """``(term, df, total)`` of the n-grams of ``stems`` in ``least`` documents or
    more. They are counted level by level: a run of n stems can only be in that many
    documents if both runs of n-1 stems inside it are. Runs that fail this are
    dropped before the shuffle, which is exact and keeps the many one-off n-grams of
    a large corpus out of it.

    The frequent runs of a level are a broadcast to the next one. A share of the
    documents bounds their number, whatever the corpus; beyond ``KNOWN_TERMS``, as a
    low absolute bound may give, they are joined.
    """
    stored = materialize(ngram_counts.frequent_stems(docs, least), "terms1")
    levels = [stored]
    known: list[tuple[list[str], np.ndarray]] | None = []
    for n in range(2, high + 1):
        if known is not None and stored.count() > KNOWN_TERMS:
            known = None
        if known is None:
            stored = _semi_joined_runs(docs, n, levels[-1].select("term"), least)
        else:
            rows = stored.select("term", *(["gram"] if n > 2 else [])).toArrow().to_pydict()
            if n > 2:
                keys = np.array(rows["gram"], dtype=np.int64)
                order = np.argsort(keys)
                known.append(([rows["term"][i] for i in order], keys[order]))
            else:
                known.append((rows["term"], np.arange(len(rows["term"]))))
            if not known[-1][0]:
                break
            if n == 2:
                codes = materialize(ngram_counts.coded(docs, known[0][0], packed=True), "codes")
            stored = ngram_counts.frequent_runs(codes, least, known)
        stored = materialize(stored, f"terms{n}")
        levels.append(stored.select("term", "df", "total"))
    if len(levels) < low:
        return levels[0].limit(0)
    frequency = levels[low - 1]
    for level in levels[low:]:
        frequency = frequency.unionByName(level)
    return frequency


def fit_vocabulary(
    docs: DataFrame,
    n_docs: int,
    low: int = 1,
    high: int = 3,
    min_df: int | float = 0.001,
    max_df: int | float = 0.8,
    max_features: int = 20_000,
) -> DataFrame:
    """Pruned and capped terms ``(term, df, total)`` of the stems' n-grams, at most
    ``max_features`` rows."""
    frequency = frequent_terms(docs, bound(min_df, n_docs), low, high)
    return cap(prune(frequency, n_docs, min_df, max_df), max_features)
