"""Queries of the classifier and report operators; those that fit models or parse free text have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate, models, reports
from .base import query, signals, table
from .cohorts import _REGISTRY, _registry


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All instances, labels below five against the rest; cases are of one label, with folds of cases."""
    v = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").where("label is not null").select((v % 40 + F.col("label") * 100).alias("case_id"), v.alias("instance"), (F.col("label") < 5).cast("double").alias("label"), "embedding", (v % 2).cast("int").alias("fold"), (F.floor(v % 40 / 2) % 2).cast("int").alias("inner_fold"))
    return models.with_vectors(rows)


@query()
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class probabilities of every vector by models of the other folds, and the likeliest class."""
    rows = models.with_vectors(table(spark, sf_dir, "embeddings").withColumns({"label": F.col("label").cast("double"), "fold": (F.col("vec_id") % 3).cast("int")}))
    found = models.out_of_fold(rows, lambda: models.logistic(iterations=20), "fold", 3, ["vec_id", "label"])
    return found.select("vec_id", F.col("label").cast("int").alias("label"), (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int").alias("predicted"))


@query()
def nested_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalty, aggregation and threshold chosen inside each outer fold."""
    return models.nested_out_of_fold(_instances(spark, sf_dir), [0.1, 1.0], "fold", "inner_fold", 2, 2)


@query()
def ridge_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge logistic on three signals, and the threshold that its scores select."""
    scores = models.ridge_scores(signals(spark, sf_dir), ["s1", "s2", "s3"], 1.0, "fold", 5)
    return calibrate.best_threshold(scores, "midpoints")


@query()
def extracted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object of event properties wrapped in fences and prose."""
    rows = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("thinking ... ```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("answer: "), "props", F.lit(" and "), "props")).otherwise("no object")
    return reports.extracted(rows.select("event_id", text.alias("text"))).select("event_id", "report_json", "report_status")


_COMPACT = """answers as (select doc_id, case doc_id % 4 when 0 then 'POSITIVA' when 1 then 'NEGATIVA' when 2 then 'INCONCLUSIVA' else 'OTHER' end as state, case doc_id % 3 when 0 then 'baixa' when 1 then 'moderada' else 'alta' end as confidence, doc_id % 5 < 2 as suspicious, case doc_id % 7 when 0 then ' ' when 1 then 'String' when 2 then 'the patient has a lesion' else substr(text, 1, 40) end as evidence from documents)"""


@query(f"""
with {_COMPACT} select doc_id, state, confidence, array_to_string(list_filter([case when state = 'OTHER' then 'state_unknown' end, case when state = 'POSITIVA' and not suspicious then 'positive_without_lesion' end, case when state = 'NEGATIVA' and suspicious then 'negative_with_lesion' end,
  case when trim(evidence) = '' then 'evidence_missing' end, case when lower(trim(evidence)) = 'string' then 'evidence_placeholder' end, case when evidence like '%patient has%' then 'forbidden_phrase' end], lambda x: x is not null), ',') as violations from answers
""")
def compact_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    state = F.when(d % 4 == 0, " positive ").when(d % 4 == 1, "Negativo").when(d % 4 == 2, "INCONCLUSIVE").otherwise("other")
    sure = F.when(d % 3 == 0, "low").when(d % 3 == 1, "Moderada").otherwise("HIGH")
    evidence = F.when(d % 7 == 0, " ").when(d % 7 == 1, "String").when(d % 7 == 2, "the patient has a lesion").otherwise(F.substring("text", 1, 40))
    rows = table(spark, sf_dir, "documents").select("doc_id", reports.canonical_state(state).alias("state"), reports.canonical_confidence(sure).alias("confidence"), (d % 5 < 2).alias("suspicious"), evidence.alias("evidence"))
    return reports.compact_violations(rows).select("doc_id", "state", "confidence", F.array_join("violations", ",").alias("violations"))


@query(f"""
with {_REGISTRY} select dataset_id || '__' || case_id as doc_id, dataset_name || ' — ' || case_id || ' (' || rag_class || ')' as title,
  case when coalesce(positive_subtype, '') <> '' then 'Caso positivo de patologia hepática alvo suspeita. Usar como exemplo positivo para triagem experimental.' else 'Caso negativo para patologia hepática alvo. Não representa normalidade clínica absoluta.' end
  || case when len(phenotype_tags) > 0 then ' Fenótipos observados: ' || array_to_string(phenotype_tags, ', ') || '.' else '' end || case when len(limitations) > 0 then ' Limitações: ' || array_to_string(limitations, '; ') || '.' else '' end as text from registry
""")
def registry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.registry_documents(_registry(spark, sf_dir)).select("doc_id", "title", "text")
