"""The steps of the topic model as Spark ML stages, so that they compose in a
``Pipeline`` and are saved and loaded with it."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession

from topicloom.functions import text as X
from topicloom.operators import clean, ngram_counts, vocabulary, weighting


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    def _assign(self, values: dict):
        self._set(**{k: v for k, v in values.items() if v is not None})
        return self


class MissingToNull(Transformer, _Stage):
    """Every kind of missing value becomes NULL."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean.normalize_missing(dataset)


class ColumnDropper(Transformer, _Stage):
    columns = Param(Params._dummy(), "columns", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._setDefault(columns=[])
        self._assign(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.drop(*self.getOrDefault(self.columns))


class EmptyColumnDropper(Estimator, _Stage):
    """Learns which columns hold no value; the model drops the same columns
    from any later table."""

    def _fit(self, dataset: DataFrame) -> ColumnDropper:
        return ColumnDropper(columns=clean.empty_columns(dataset))


class IncompleteRowDropper(Transformer, _Stage):
    """Drops rows with any missing value."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return clean.drop_incomplete_rows(dataset)


class TextAnalyzer(Transformer, HasInputCol, _Stage):
    """Adds ``words`` and ``stems``."""

    tokenizer = Param(Params._dummy(), "tokenizer", "tokenizer name", TypeConverters.toString)
    stemmer = Param(Params._dummy(), "stemmer", "stemmer name", TypeConverters.toString)
    stopWords = Param(Params._dummy(), "stopWords", "stop words", TypeConverters.toListString)
    stopStage = Param(Params._dummy(), "stopStage", "'raw' or 'stem'", TypeConverters.toString)
    foldAccents = Param(Params._dummy(), "foldAccents", "fold accents", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol=None,
        tokenizer=None,
        stemmer=None,
        stopWords=None,
        stopStage=None,
        foldAccents=None,
    ):
        super().__init__()
        self._setDefault(
            inputCol="text",
            tokenizer="letters",
            stemmer="porter2",
            stopWords=list(X.ENGLISH),
            stopStage="raw",
            foldAccents=False,
        )
        self._assign(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = self.getOrDefault
        if value(self.tokenizer) == "letters" and value(self.stopStage) == "raw":
            return vocabulary.analyze_letters(
                dataset,
                self.getInputCol(),
                value(self.stemmer),
                value(self.stopWords),
                value(self.foldAccents),
            )
        return vocabulary.analyze(
            dataset,
            self.getInputCol(),
            value(self.tokenizer),
            value(self.stemmer),
            value(self.stopWords),
            value(self.stopStage),
            value(self.foldAccents),
        )


class NGramTerms(Transformer, _Stage):
    """Adds ``terms``, the n-grams of ``stems``."""

    low = Param(Params._dummy(), "low", "shortest n-gram", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "longest n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, low=None, high=None):
        super().__init__()
        self._setDefault(low=1, high=3)
        self._assign(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return vocabulary.with_terms(
            dataset, self.getOrDefault(self.low), self.getOrDefault(self.high)
        )


class KnownTerms(Transformer, _Stage):
    """Adds ``terms``, the n-grams of ``stems`` that a vocabulary has."""

    vocabulary = Param(Params._dummy(), "vocabulary", "terms to find", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, vocabulary=None):
        super().__init__()
        self._assign(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = ngram_counts.known_terms(self.getOrDefault(self.vocabulary))
        return dataset.withColumn("terms", known)


class TermCounts(Transformer, HasOutputCol, _Stage):
    """Adds the counts of a vocabulary's n-grams in ``stems``, a sparse vector."""

    vocabulary = KnownTerms.vocabulary

    @keyword_only
    def __init__(self, *, vocabulary=None, outputCol=None):
        super().__init__()
        self._setDefault(outputCol="counts")
        self._assign(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        counts = ngram_counts.known_counts(self.getOrDefault(self.vocabulary))
        return dataset.withColumn(self.getOutputCol(), counts)


class TfidfVectorizer(Estimator, HasOutputCol, _Stage):
    """Learns the pruned, capped vocabulary of ``stems`` and its IDF.

    The model counts the vocabulary's n-grams and is then a pipeline of built-in stages
    (IDF scaling, length 1); each works on one row at a time without a shuffle. ``idfPower=2``
    applies the weighting twice.
    """

    low = NGramTerms.low
    high = NGramTerms.high
    minDF = Param(Params._dummy(), "minDF", "least share of documents", TypeConverters.toFloat)
    maxDF = Param(Params._dummy(), "maxDF", "largest share of documents", TypeConverters.toFloat)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "vocabulary cap", TypeConverters.toInt)
    idfPower = Param(Params._dummy(), "idfPower", "times IDF is applied", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        outputCol=None,
        low=None,
        high=None,
        minDF=None,
        maxDF=None,
        maxFeatures=None,
        idfPower=None,
    ):
        super().__init__()
        self._setDefault(
            outputCol="features",
            low=1,
            high=3,
            minDF=0.001,
            maxDF=0.8,
            maxFeatures=20_000,
            idfPower=1,
        )
        self._assign(self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        value = self.getOrDefault
        for share in (self.minDF, self.maxDF):
            if not 0 <= value(share) <= 1:
                raise ValueError(f"{share.name} is a share of the documents, from 0 to 1")
        n_docs = dataset.count()
        kept = vocabulary.fit_vocabulary(
            dataset,
            n_docs,
            value(self.low),
            value(self.high),
            value(self.minDF),
            value(self.maxDF),
            value(self.maxFeatures),
        )
        # At most maxFeatures rows come to the driver.
        rows = sorted(weighting.idf_table(kept, n_docs).collect(), key=lambda r: r["term"].encode())
        if not rows:
            raise ValueError("no term is left after pruning")
        idf = [row["idf"] ** value(self.idfPower) for row in rows]
        terms = [row["term"] for row in rows]
        return PipelineModel(
            [
                TermCounts(vocabulary=terms, outputCol="counts"),
                ElementwiseProduct(
                    scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted"
                ),
                Normalizer(p=2.0, inputCol="weighted", outputCol=self.getOutputCol()),
            ]
        )
