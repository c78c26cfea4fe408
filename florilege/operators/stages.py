"""Spark ML stages: a pipeline of them is fitted, saved to any file system Spark knows, and loaded in another session.

``TextCleaner`` normalises and cleans a column; ``TextClassifier`` fits a linear model over n-grams and gives a
``TextClassifierModel``, whose tables are saved as Parquet beside its parameters.

A text's label depends on nothing but the text, so each distinct text is scored once and labels are joined back by the text's hash: rows need no
id, and repeated texts cost one look-up. A null text counts as an empty one."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions import text
from florilege.operators import features, linear, terms
from florilege.session import stage


def _own(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class TextCleaner(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Text as models are trained on it: normalised, then cleaned."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "clean"):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="clean")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), text.clean_for_training(text.normalize(self.getInputCol())))


class _TextModelParams(HasInputCol, HasLabelCol, HasPredictionCol):
    kind = Param(Params._dummy(), "kind", "svm, logistic or means", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "weight of the loss against the penalty", TypeConverters.toFloat)
    char = Param(Params._dummy(), "char", "shortest and longest character n-gram; empty for none", TypeConverters.toListInt)
    word = Param(Params._dummy(), "word", "shortest and longest word n-gram; empty for none", TypeConverters.toListInt)
    limits = Param(Params._dummy(), "limits", "most terms of each space: char, word", TypeConverters.toListInt)
    leastDocs = Param(Params._dummy(), "leastDocs", "least documents of a term: char, word", TypeConverters.toListInt)
    library = Param(Params._dummy(), "library", "n-grams as the training library counts them", TypeConverters.toBoolean)
    iterations = Param(Params._dummy(), "iterations", "steps of the optimiser", TypeConverters.toInt)

    def _spans(self) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
        return tuple(tuple(self.getOrDefault(p)) or None for p in (self.char, self.word))  # type: ignore[return-value]


class TextClassifier(Estimator, _TextModelParams, DefaultParamsReadable, DefaultParamsWritable):
    """``kind`` svm and logistic are trained; ``means`` takes each class's mean vector for its coefficients."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", labelCol: str = "label", predictionCol: str = "prediction", kind: str = "svm", C: float = 0.954, char: tuple[int, ...] = (1, 5), word: tuple[int, ...] = (1, 1), limits: tuple[int, ...] = (200_000, 100_000), leastDocs: tuple[int, ...] = (1, 1), library: bool = False, iterations: int = 100):
        super().__init__()
        self._setDefault(inputCol="text", labelCol="label", predictionCol="prediction", kind="svm", C=0.954, char=[1, 5], word=[1, 1], limits=[200_000, 100_000], leastDocs=[1, 1], library=False, iterations=100)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TextClassifierModel:
        from florilege.plans import train

        char, word = self._spans()
        # ids of the rows, fixed by being written
        rows = stage(dataset.select(F.monotonically_increasing_id().alias("id"), F.col(self.getLabelCol()).cast("string").alias("class"), F.coalesce(F.col(self.getInputCol()).cast("string"), F.lit("")).alias("text")), "fit-rows").where("class IS NOT NULL")
        (most_char, most_word), (least_char, least_word) = self.getOrDefault(self.limits), self.getOrDefault(self.leastDocs)
        kind = self.getOrDefault(self.kind)
        if kind == "means":
            library = self.getOrDefault(self.library)
            vocab = stage(features.top_terms(stage(terms.frequencies(rows, "text", char, word, library), "frequencies"), rows.count(), {"char": most_char, "word": most_word}, {"char": least_char, "word": least_word}), "vocabulary")
            coef, heads = linear.text_means(rows, vocab, char, word, library=library)
            fitted = linear.LinearModel(vocab, stage(coef, "coef"), heads, char, word, library)
        elif kind in ("svm", "logistic"):
            p = {"C": self.getOrDefault(self.C), "char": char, "word": word, "max_char": most_char, "max_word": most_word, "min_char": least_char, "min_word": least_word}
            fitted = train.fitted(rows, p, kind, self.getOrDefault(self.iterations))
        else:
            raise ValueError(f"no such kind: {kind}")
        return self._copyValues(TextClassifierModel(fitted))


class TextClassifierModel(Model, _TextModelParams, MLReadable, MLWritable):
    """Adds the label of the highest score; the first class wins ties."""

    def __init__(self, tables: linear.LinearModel | None = None):
        super().__init__()
        self.tables = tables

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, out = _own(dataset, "_text_key"), self.getPredictionCol()
        body = F.coalesce(F.col(self.getInputCol()).cast("string"), F.lit(""))
        each = dataset.withColumn(key, F.md5(body))
        texts = each.groupBy(key).agg(F.first(body).alias("text")).withColumnRenamed(key, "id")
        said = linear.predict(linear.score(self.tables, texts, "id")).select(F.col("id").alias(key), F.col("class").alias(out))
        return each.join(said, key, "left").drop(key)

    def copy(self, extra=None) -> TextClassifierModel:
        that = super().copy(extra)
        that.tables = self.tables
        return that

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


_TABLES = ("vocab", "coef", "intercept")


class _ModelWriter(MLWriter):
    def __init__(self, model: TextClassifierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for name in _TABLES:
            getattr(self.model.tables, name).write.parquet(f"{path}/{name}")


class _ModelReader(MLReader):
    def load(self, path: str) -> TextClassifierModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TextClassifierModel()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        char, word = model._spans()
        model.tables = linear.LinearModel(*(self.sparkSession.read.parquet(f"{path}/{name}") for name in _TABLES), char, word, model.getOrDefault(model.library))
        return model
