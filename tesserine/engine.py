"""Classifying fetched pages from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Config
from .functions import maths, outcomes, rules, text
from .operators import reports
from .scoring import Scorer


class Engine:
    """Gate, score, label, annotate, reconcile, report.

    Pages: ``fetch_id, url, domain, html, text, error, error_code, source``.  A page
    is refused by the first rule it fails; the scorer only sees the others."""

    def __init__(self, scorer: Scorer, config: Config | None = None):
        self.scorer, self.config = scorer, config or Config.from_env()

    def gate(self, pages: DataFrame) -> DataFrame:
        """Pages with the code of the first rule they fail, or NULL."""
        t = F.coalesce(outcomes.given(F.col("text")), text.visible(F.col("html")), F.lit(""))
        x = pages.withColumn("text", t)
        code = (
            F.when(outcomes.given(F.col("error_code")).isNotNull() & (F.col("text") == ""), F.col("error_code"))
            .when(rules.block(F.col("html"), F.col("domain"))["blocked"], "bot_blocked")
            .when(text.tokens(F.col("text")) == 0, "empty_text")
            .when(text.tokens(F.col("text")) < self.config.min_tokens, "thin_content")
        )
        return x.withColumn("refused", code)

    def classify(self, pages: DataFrame) -> DataFrame:
        x = self.gate(pages)
        refused = x.where("refused is not null")
        scored = self.scorer.score(x.where("refused is null").drop("refused"))
        labels = F.array(*[F.lit(n) for n in self.scorer.labels])
        top = F.filter(F.transform(F.arrays_zip(labels.alias("category"), F.col("p").alias("probability")), lambda z: z), lambda z: (z["probability"] >= self.config.label_floor) | (z["probability"] == F.array_max("p")))
        ok = scored.select(
            "fetch_id", "url", "domain", F.get(labels, maths.argmax(F.col("p")).cast("int") - 1).alias("category"), F.array_max("p").alias("confidence"),
            F.array_sort(top, lambda a, b: F.when(a["probability"] > b["probability"], -1).when(a["probability"] < b["probability"], 1).otherwise(0)).alias("categories"),
            F.lit("ok").alias("status"), F.lit("infer").alias("stage"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error"), "source",
        )
        stage = F.when(F.col("refused").isin("empty_text", "thin_content"), "process").otherwise("fetch")
        no = refused.select("fetch_id", "url", "domain", F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("confidence"), F.lit("failed").alias("status"), stage.alias("stage"), F.col("refused").alias("error_code"), F.coalesce(outcomes.given(F.col("error")), F.lit("refused")).alias("error"), "source")
        return reports.annotate(ok.unionByName(no, allowMissingColumns=True))

    def run(self, requested: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(reconciled rows, report) of the requested names."""
        rows = self.classify(pages)
        return reports.reconcile(requested, rows), reports.report(rows)
