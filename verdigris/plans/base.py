"""Registration of queries, and the tables that stand in for cohorts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


#: One labelled case for each labelled document, with a score and states that follow from its numbers.
COHORT = """cohort as (
  select case_id, patient_group_id, dataset_id, truth, score, status, tags, negative_subtype, positive_subtype,
         case when status = 'decisive' then case when score >= 0.5 then 'POSITIVA' else 'NEGATIVA' end when status = 'inconclusive' then 'INCONCLUSIVA' end as prediction
  from (
    select *, case when k = 0 then 'failure' when k = 1 then 'timeout' when k = 2 then 'invalid_response' when score >= 0.45 and score < 0.55 then 'inconclusive' else 'decisive' end as status,
           case when truth = 'negative' then case case_id % 4 when 1 then 'normal' when 2 then 'benign_anatomic_variant' when 3 then 'pseudolesion_or_artifact' end end as negative_subtype,
           case when truth = 'positive' then case case_id % 3 when 1 then 'hcc' when 2 then 'metastasis' end end as positive_subtype
    from (
      select d.doc_id as case_id, d.source as patient_group_id, d.lang as dataset_id, case when l.quality = 0 then 'positive' else 'negative' end as truth,
             ((d.doc_id * 37 + d.n_chars * 11) % 1000) / 1000.0::double as score, d.n_chars % 17 as k, [d.lang, 'q' || l.quality, case when d.n_chars > 2000 then 'long' else 'short' end] as tags
      from documents d join labels l using (doc_id)
    )
  )
)"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("case_id"),
        F.col("source").alias("patient_group_id"),
        F.col("lang").alias("dataset_id"),
        F.when(F.col("quality") == 0, "positive").otherwise("negative").alias("truth"),
        (((F.col("doc_id") * 37 + F.col("n_chars") * 11) % 1000) / F.lit(1000.0)).alias("score"),
        (F.col("n_chars") % 17).alias("k"),
        F.array("lang", F.concat(F.lit("q"), F.col("quality").cast("string")), F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("tags"),
    )
    status = F.when(F.col("k") == 0, "failure").when(F.col("k") == 1, "timeout").when(F.col("k") == 2, "invalid_response").when((F.col("score") >= 0.45) & (F.col("score") < 0.55), "inconclusive").otherwise("decisive")
    negative = F.when(F.col("case_id") % 4 == 1, "normal").when(F.col("case_id") % 4 == 2, "benign_anatomic_variant").when(F.col("case_id") % 4 == 3, "pseudolesion_or_artifact")
    positive = F.when(F.col("case_id") % 3 == 1, "hcc").when(F.col("case_id") % 3 == 2, "metastasis")
    rows = rows.withColumns({"status": status, "negative_subtype": F.when(F.col("truth") == "negative", negative), "positive_subtype": F.when(F.col("truth") == "positive", positive)}).drop("k")
    return rows.withColumn("prediction", F.when(F.col("status") == "decisive", F.when(F.col("score") >= 0.5, "POSITIVA").otherwise("NEGATIVA")).when(F.col("status") == "inconclusive", "INCONCLUSIVA"))


#: The same cases as prediction rows: label and prediction POSITIVE / NEGATIVE, technical_failure.
PREDICTIONS = (
    COHORT
    + """, predictions as (
  select *, upper(truth) as label, status in ('failure', 'timeout', 'invalid_response') as technical_failure,
         case prediction when 'POSITIVA' then 'POSITIVE' when 'NEGATIVA' then 'NEGATIVE' end as said
  from cohort
)"""
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("prediction") == "POSITIVA", "POSITIVE").when(F.col("prediction") == "NEGATIVA", "NEGATIVE")
    return cohort(spark, sf_dir).withColumns({"label": F.upper("truth"), "technical_failure": F.col("status").isin("failure", "timeout", "invalid_response"), "prediction": said})


#: Three signals for each case, with exact binary fractions so that sums do not depend on their order.
SIGNALS = (
    COHORT
    + """, signals as (
  select case_id, dataset_id, truth = 'positive' as truth, ((case_id * 29 + 5) % 256) / 256.0::double as s1, ((case_id * 53 + 11) % 512) / 512.0::double as s2,
         ((case_id * 17 + 3) % 64) / 64.0::double as s3, case_id % 5 as fold
  from cohort
)"""
)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("case_id")
    return cohort(spark, sf_dir).select(
        "case_id",
        "dataset_id",
        (F.col("truth") == "positive").alias("truth"),
        (((c * 29 + 5) % 256) / F.lit(256.0)).alias("s1"),
        (((c * 53 + 11) % 512) / F.lit(512.0)).alias("s2"),
        (((c * 17 + 3) % 64) / F.lit(64.0)).alias("s3"),
        (c % 5).cast("int").alias("fold"),
    )
