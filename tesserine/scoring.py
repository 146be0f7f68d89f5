"""Scorers: anything that adds a distribution over labels to texts."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text


class Scorer(Protocol):
    labels: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``p ARRAY<DOUBLE>`` aligned to ``labels`` for column ``text``."""


class TextScorer:
    """Hashed term weights and multinomial regression (Spark ML, distributed)."""

    def __init__(self, model: PipelineModel):
        self.model = model
        self.labels = list(model.stages[0].labels)

    @staticmethod
    def _words(df: DataFrame) -> DataFrame:
        return df.withColumn("words", F.filter(F.split(F.coalesce(text.clean_words(F.col("text")), F.lit("")), " "), lambda w: w != ""))

    @classmethod
    def fit(cls, df: DataFrame, features: int = 1 << 12, steps: int = 15) -> TextScorer:
        """df(text, category)."""
        stages = [
            StringIndexer(inputCol="category", outputCol="y", handleInvalid="skip", stringOrderType="alphabetAsc"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol="x"),
            LogisticRegression(featuresCol="x", labelCol="y", probabilityCol="prob", maxIter=steps, regParam=0.01),
        ]
        return cls(Pipeline(stages=stages).fit(cls._words(df).select("words", "category")))

    def score(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        x = self._words(df)
        for s in self.model.stages[1:]:
            x = s.transform(x)
        return x.withColumn("p", vector_to_array("prob")).select(*keep, "p")


class LogitScorer:
    """Scores that are already there, as logits in a column."""

    def __init__(self, labels: list[str], column: str = "logits", temperature: float = 1.0):
        self.labels, self.column, self.temperature = labels, column, temperature

    def score(self, df: DataFrame) -> DataFrame:
        from .functions.maths import softmax

        return df.withColumn("p", softmax(F.col(self.column), self.temperature))
