"""A metadata graph as vertex and edge tables, and the reads that it serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags that can be taken for a finding, and subtypes that are negative for the target.
TARGET = "focal_liver_lesion"
MIMICS = (
    ("prominent_hepatic_vein", "focal_liver_lesion"),
    ("vascular_structure", "focal_liver_lesion"),
    ("perfusion_alteration", "arterial_hyperenhancement"),
    ("motion_artifact", "focal_lesion"),
    ("partial_volume_effect", "focal_lesion"),
    ("focal_fat", "focal_liver_lesion"),
    ("simple_cyst", "hypovascular_lesion"),
    ("edge_of_liver_pseudolesion", "focal_liver_lesion"),
)
NEGATIVE_FOR_TARGET = ("normal", "benign_anatomic_variant", "pseudolesion_or_artifact", "benign_non_target_finding", "poor_quality_non_diagnostic")
#: Kinds of edges from a case, the registry column each comes from, and the kind of the other end.
SINGLE = (("FROM_DATASET", "dataset_id", "Dataset"), ("HAS_RAG_CLASS", "rag_class", "RagClass"), ("HAS_LABEL", "label", "GroundTruthLabel"), ("HAS_MODALITY", "modality", "Modality"), ("HAS_SOURCE_FORMAT", "source_format", "SourceFormat"), ("HAS_PHASE", "phase", "Phase"), ("HAS_NEGATIVE_SUBTYPE", "negative_subtype", "NegativeSubtype"), ("HAS_POSITIVE_SUBTYPE", "positive_subtype", "PositiveSubtype"))
LISTED = (("HAS_PHENOTYPE_TAG", "phenotype_tags", "PhenotypeTag"), ("HAS_LIMITATION", "limitations", "Limitation"), ("HAS_LIMITATION", "warnings", "Limitation"))


def edges(registry: DataFrame) -> DataFrame:
    """(source, kind, target, target_kind) of all cases, each once, with the static relations; one pass over the registry."""
    one = lambda kind, value, end: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("target"), F.lit(end).alias("target_kind"))
    singles = F.array(*[one(kind, F.col(c), end) for kind, c, end in SINGLE])

    def several(kind: str, column: str, end: str):
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda v: one(kind, v, end))

    lists = [several(*row) for row in LISTED]
    found = registry.select(F.col("case_id").cast("string").alias("source"), F.explode(F.flatten(F.array(singles, *lists))).alias("e")).select("source", "e.*").where("target is not null").distinct()
    return found.unionByName(static_edges(registry.sparkSession))


def static_edges(spark: SparkSession) -> DataFrame:
    rows = [(tag, "CAN_MIMIC", finding, "Finding") for tag, finding in MIMICS] + [(subtype, "NEGATIVE_FOR_TARGET", TARGET, "Finding") for subtype in NEGATIVE_FOR_TARGET]
    return spark.createDataFrame(rows, "source string, kind string, target string, target_kind string")


def vertices(registry: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, name): all cases and all ends of edges, each once."""
    cases = registry.select(F.lit("Case").alias("kind"), F.col("case_id").cast("string").alias("name"))
    return cases.union(links.select(F.col("target_kind").alias("kind"), F.col("target").alias("name"))).distinct()


def case_context(links: DataFrame, cases: DataFrame, negative_subtype: str | None, tag: str | None, limit: int = 10, matching_only: bool = True) -> DataFrame:
    """Cases with dataset, negative subtype and tags, in order of case, up to a limit.

    ``matching_only`` keeps cases that have the subtype and the tag asked for. Without it the
    conditions only say which tags are listed and no case is left out, as an optional match of
    a graph query does.
    """
    end = lambda kind, name: links.where(F.col("kind") == kind).select(F.col("source").alias("case_id"), F.col("target").alias(name))
    rows = cases.select(F.col("case_id").cast("string").alias("case_id")).join(end("FROM_DATASET", "dataset_id"), "case_id", "left").join(end("HAS_NEGATIVE_SUBTYPE", "negative_subtype"), "case_id", "left")
    rows = rows.join(end("HAS_PHENOTYPE_TAG", "tag"), "case_id", "left")
    fits = F.lit(True)
    if negative_subtype is not None:
        fits = fits & F.coalesce(F.col("negative_subtype") == negative_subtype, F.lit(False))
    if tag is not None:
        fits = fits & F.coalesce(F.col("tag") == tag, F.lit(False))
    listed = F.array_sort(F.collect_set(F.when(fits, F.col("tag"))))
    out = rows.groupBy("case_id", "dataset_id", "negative_subtype").agg(listed.alias("phenotype_tags"), F.max(fits).alias("__fits"))
    if matching_only:
        out = out.where("__fits")
    return out.drop("__fits").orderBy("case_id").limit(limit)


def mimics(links: DataFrame, tag: str | None = None, finding: str | None = None) -> DataFrame:
    rows = links.where("kind = 'CAN_MIMIC'").select(F.col("source").alias("phenotype_tag"), F.col("target").alias("finding"))
    rows = rows if tag is None else rows.where(F.col("phenotype_tag") == tag)
    return rows if finding is None else rows.where(F.col("finding") == finding)


def limitations(links: DataFrame, negative_subtype: str | None = None, limit: int = 20) -> DataFrame:
    """Different limitations in order of their text, of cases with a subtype if one is asked for."""
    rows = links.where("kind = 'HAS_LIMITATION'").select(F.col("source"), F.col("target").alias("limitation"))
    if negative_subtype is not None:
        rows = rows.join(links.where((F.col("kind") == "HAS_NEGATIVE_SUBTYPE") & (F.col("target") == negative_subtype)).select("source").distinct(), "source", "left_semi")
    return rows.select("limitation").distinct().orderBy("limitation").limit(limit)
