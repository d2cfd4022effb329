"""Queries of the cohort and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import graph as G
from .base import COHORT, cohort, query, table


@query("select o_custkey, count(*) as rows from orders group by 1 having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


_TWICE = "twice as (select case_id, truth, score from cohort union all select case_id, truth, case when case_id % 5 = 0 then score + 1 else score end from cohort where case_id % 2 = 0)"


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir).select("case_id", "truth", "score")
    again = rows.where("case_id % 2 = 0").withColumn("score", F.when(F.col("case_id") % 5 == 0, F.col("score") + 1).otherwise(F.col("score")))
    return rows.union(again)


@query(f"with {COHORT}, {_TWICE} select case_id, count(*) as rows, count(distinct score) as versions from twice group by 1 having count(distinct score) > 1")
def conflicting_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conflicting_duplicates(_twice(spark, sf_dir), ["case_id"])


@query(f"with {COHORT}, {_TWICE} select distinct case_id, truth, score from twice where case_id % 5 <> 0")
def collapsed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapsed(_twice(spark, sf_dir).where("case_id % 5 <> 0"), ["case_id"])


@query(f"with {COHORT} select case_id from cohort where case_id % 3 <> 0")
def pending_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir)
    return C.pending(rows, rows.where("case_id % 3 = 0"), ["case_id"]).select("case_id")


#: Registry rows from documents: some break rules.
_REGISTRY = """registry as (
  select doc_id::varchar as case_id, lang as dataset_id, case when doc_id % 50 = 3 then '' else 'set ' || lang end as dataset_name, case when doc_id % 3 = 0 then 'positive' else 'negative' end as rag_class,
         case when doc_id % 3 = 0 then 'positive' else 'negative' end as label, case when doc_id % 4 = 1 then 'dicom' when doc_id % 40 = 2 then 'raw' else 'nifti' end as source_format, case when doc_id % 60 = 5 then 'CT' else 'MR' end as modality,
         doc_id % 70 <> 6 as research_only, false as clinical_use_allowed, case when doc_id % 5 = 1 then 'normal' when doc_id % 55 = 2 then 'other' end as negative_subtype, case when doc_id % 9 = 0 then 'hcc_suspicious' end as positive_subtype,
         case doc_id % 4 when 0 then ['focal_fat', 'simple_cyst'] when 1 then ['motion_artifact'] when 2 then []::varchar[] else case when doc_id % 44 = 3 then ['nonsense'] else ['focal_fat'] end end as phenotype_tags,
         case when doc_id % 2 = 0 then ['no contrast'] else []::varchar[] end as limitations, case when doc_id % 6 = 0 then ['few slices'] else []::varchar[] end as warnings, 'phase ' || (doc_id % 3) as phase, source as subject from documents
)"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, none = F.col("doc_id"), F.array().cast("array<string>")
    label = F.when(d % 3 == 0, "positive").otherwise("negative")
    tags = F.when(d % 4 == 0, F.array(F.lit("focal_fat"), F.lit("simple_cyst"))).when(d % 4 == 1, F.array(F.lit("motion_artifact"))).when(d % 4 == 2, none).otherwise(F.when(d % 44 == 3, F.array(F.lit("nonsense"))).otherwise(F.array(F.lit("focal_fat"))))
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("case_id"), F.col("lang").alias("dataset_id"), F.when(d % 50 == 3, "").otherwise(F.concat(F.lit("set "), "lang")).alias("dataset_name"), label.alias("rag_class"), label.alias("label"),
        F.when(d % 4 == 1, "dicom").when(d % 40 == 2, "raw").otherwise("nifti").alias("source_format"), F.when(d % 60 == 5, "CT").otherwise("MR").alias("modality"), (d % 70 != 6).alias("research_only"), F.lit(False).alias("clinical_use_allowed"),
        F.when(d % 5 == 1, "normal").when(d % 55 == 2, "other").alias("negative_subtype"), F.when(d % 9 == 0, "hcc_suspicious").alias("positive_subtype"), tags.alias("phenotype_tags"),
        F.when(d % 2 == 0, F.array(F.lit("no contrast"))).otherwise(none).alias("limitations"), F.when(d % 6 == 0, F.array(F.lit("few slices"))).otherwise(none).alias("warnings"), F.concat(F.lit("phase "), (d % 3).cast("string")).alias("phase"), F.col("source").alias("subject"),
    )


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(f"""
with {_REGISTRY}, rules as (select case_id, unnest(list_filter([
  case when trim(dataset_id) = '' or trim(dataset_name) = '' then 'dataset_missing' end, case when rag_class not in ('negative', 'positive') then 'rag_class_unknown' end, case when source_format not in ('dicom', 'nifti') then 'source_format_unknown' end,
  case when modality <> 'MR' then 'modality_unknown' end, case when not (research_only and not clinical_use_allowed) then 'not_research_only' end, case when rag_class = 'negative' and positive_subtype is not null then 'positive_subtype_on_negative' end,
  case when rag_class = 'positive' and negative_subtype is not null then 'negative_subtype_on_positive' end, case when negative_subtype not in ({_in(C.NEGATIVE_SUBTYPES)}) then 'negative_subtype_unknown' end,
  case when positive_subtype not in ({_in(C.POSITIVE_SUBTYPES)}) then 'positive_subtype_unknown' end, case when len(list_filter(phenotype_tags, lambda t: t not in ({_in(C.PHENOTYPE_TAGS)}))) > 0 then 'tag_unknown' end], lambda r: r is not null)) as rule from registry)
select * from rules
""")
def registry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.registry_violations(_registry(spark, sf_dir))


_CURATION = """raw as (select ' ' || case_id || ' ' as case_id, case when case_id % 3 = 0 then 'POSITIVE' else 'negative' end as current_label, case case_id % 4 when 0 then '' when 1 then 'negative' when 2 then null else 'Positive' end as recommended_label,
  case when case_id % 5 = 1 then 'Normal' end as rns, case when case_id % 7 = 2 then 'hcc_suspicious' end as rps, case when case_id % 11 = 0 then '' else 'r1' end as reviewer, case case_id % 3 when 0 then 'reviewed' when 1 then '' else 'REVIEWED' end as review_status from cohort),
rows as (select trim(case_id) as case_id, lower(current_label) as current_label, coalesce(lower(nullif(recommended_label, '')), lower(current_label)) as recommended_label, lower(rns) as negative_subtype, rps as positive_subtype, reviewer, coalesce(lower(nullif(review_status, '')), 'pending_review') as review_status from raw)"""


def _curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("case_id")
    raw = cohort(spark, sf_dir).select(
        F.concat(F.lit(" "), c.cast("string"), F.lit(" ")).alias("case_id"), F.when(c % 3 == 0, "POSITIVE").otherwise("negative").alias("current_label"), F.when(c % 4 == 0, "").when(c % 4 == 1, "negative").when(c % 4 == 3, "Positive").alias("recommended_label"),
        F.when(c % 5 == 1, "Normal").alias("recommended_negative_subtype"), F.when(c % 7 == 2, "hcc_suspicious").alias("recommended_positive_subtype"), F.array(F.lit(" Focal_Fat ")).alias("phenotype_tags"), F.when(c % 11 == 0, "").otherwise("r1").alias("reviewer"),
        F.when(c % 3 == 0, "reviewed").when(c % 3 == 1, "").otherwise("REVIEWED").alias("review_status"),
    )
    return C.curation_rows(raw)


@query(f"""
with {COHORT}, {_CURATION} select case_id, unnest(list_filter([case when reviewer = '' then 'reviewer_missing' end, case when negative_subtype is not null and positive_subtype is not null then 'both_subtypes' end,
  case when negative_subtype is not null and recommended_label <> 'negative' then 'negative_subtype_on_positive' end, case when positive_subtype is not null and recommended_label <> 'positive' then 'positive_subtype_on_negative' end], lambda r: r is not null)) as rule from rows
""")
def curation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.curation_violations(_curation(spark, sf_dir))


@query(f"with {COHORT}, {_CURATION} select count(*) as total, count(*) filter (review_status = 'reviewed') as reviewed, count(*) filter (recommended_label <> current_label) as reclassified, count(negative_subtype) as negative_subtypes, count(positive_subtype) as positive_subtypes from rows")
def curation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.curation_summary(_curation(spark, sf_dir))


@query(f"with {COHORT}, {_CURATION} select case_id, recommended_label as label, negative_subtype, positive_subtype, ['focal_fat'] as phenotype_tags from rows where review_status = 'reviewed'")
def protected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.protected_labels(_curation(spark, sf_dir))


#: One series for each user and event type; descriptions name sequences.
_SERIES = """series as (
  select user_id % 30 as case_id, event_type || '-' || user_id as series_key, case when user_id % 13 = 0 then 'CT' else 'MR' end as modality, count(*) as frames,
         case event_type when 'click' then 'T1 Arterial_phase' when 'view' then 'ep2d_DIFF' when 'error' then 'ADC map' when 'purchase' then 'T2-HASTE' else 'localizer' end as description,
         case user_id % 3 when 0 then [1.0, 0.0, 0.0, 0.0, 1.0, 0.0] when 1 then [1.0, 0.0, 0.0, 0.0, 0.0, -1.0] else []::double[] end as orient, user_id % 5 = 0 as nonuniform_slice_spacing, user_id % 4 as duplicate_slice_positions,
         1 + (user_id % 9 = 0)::int as matrix_sizes, (user_id % 8 = 0)::int as read_errors from events group by user_id, event_type
), classed as (
  select *, case event_type when 'view' then 'DWI' when 'error' then 'ADC' when 'purchase' then 'T2' when 'click' then 'T1_ARTERIAL' else 'UNKNOWN' end as sequence_class, case case_id2 % 3 when 0 then 'axial' when 1 then 'coronal' else 'unknown' end as orientation
  from (select *, split_part(series_key, '-', 1) as event_type, split_part(series_key, '-', 2)::int as case_id2 from series)
), scored as (
  select *, greatest(0, (modality = 'MR')::int * 40 + (orientation = 'axial')::int * 20 + (frames >= 16)::int * 20 + case sequence_class when 'DWI' then 20 when 'ADC' then 18 when 'T2' then 16 when 'T1_ARTERIAL' then 20 else 0 end
    - nonuniform_slice_spacing::int * 20 - (duplicate_slice_positions > 0)::int * 10 - (matrix_sizes > 1)::int * 20 - read_errors * 10)::int as quality_score from classed)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_type")
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("frames"))
    text = F.when(e == "click", "T1 Arterial_phase").when(e == "view", "ep2d_DIFF").when(e == "error", "ADC map").when(e == "purchase", "T2-HASTE").otherwise("localizer")
    vector = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    axes = F.when(u % 3 == 0, vector(1, 0, 0, 0, 1, 0)).when(u % 3 == 1, vector(1, 0, 0, 0, 0, -1)).otherwise(F.array().cast("array<double>"))
    rows = rows.select((u % 30).alias("case_id"), F.concat_ws("-", e, u).alias("series_key"), F.when(u % 13 == 0, "CT").otherwise("MR").alias("modality"), "frames", C.classify_sequence(text).alias("sequence_class"), C.orientation_of(axes).alias("orientation"), (u % 5 == 0).alias("nonuniform_slice_spacing"), (u % 4).alias("duplicate_slice_positions"), (1 + (u % 9 == 0).cast("int")).alias("matrix_sizes"), (u % 8 == 0).cast("int").alias("read_errors"))
    return C.quality_score(rows)


@query(f"with {_SERIES} select case_id, series_key, sequence_class, orientation, quality_score from scored")
def series_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).select("case_id", "series_key", "sequence_class", "orientation", "quality_score")


_PRIORITY = "case sequence_class when 'T1_ARTERIAL' then 100 when 'DWI' then {} when 'ADC' then {} when 'T2' then {} else 0 end"


@query(f"""
with {_SERIES}, e as (select *, {_PRIORITY.format(90, 85, 80)} as p from scored where modality = 'MR' and frames >= 3 and quality_score >= 40), r as (select *, row_number() over (partition by case_id order by quality_score desc, p desc, frames desc, series_key desc) as r, count(*) over (partition by case_id) as candidates from e)
select case_id, candidates, series_key, sequence_class, quality_score, frames from r where r = 1
""")
def best_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_series(_series(spark, sf_dir))


@query(f"""
with {_SERIES}, e as (select *, {_PRIORITY.format(80, 75, 70)} as p from scored where modality = 'MR' and frames >= 3 and quality_score >= 40), r as (select *, row_number() over (partition by case_id, sequence_class order by quality_score desc, frames desc, series_key desc) as r from e), b as (select * from r where r = 1)
select case_id, sequence_class, quality_score, frames, series_key, row_number() over (partition by case_id order by p desc, quality_score desc, frames desc, series_key desc) = 1 as "primary" from b
""")
def best_series_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_series_by_class(_series(spark, sf_dir))


@query(f"with {_SERIES}, c as (select case when case_id % 2 = 0 then 'a' else 'b' end as label, sequence_class, count(*) as series from scored where case_id % 4 <> 1 or sequence_class <> 'ADC' group by 1, 2) select label, sequence_class, series, count(*) over (partition by sequence_class) = 2 as in_all_labels from c")
def eligible_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir).where("case_id % 4 <> 1 or sequence_class <> 'ADC'").withColumn("label", F.when(F.col("case_id") % 2 == 0, "a").otherwise("b"))
    return C.eligible_distribution(rows)


@query("""
with s as (select user_id as series_key, round((event_id % 40 * 2.5 + case when user_id % 7 = 0 and event_id % 40 = 3 then 1.0 else 0.0 end)::double, 4) as p, (event_id % 60)::int as n from events), d as (select distinct series_key, p from s),
st as (select *, p - lag(p) over (partition by series_key order by p) as step from d), m as (select series_key, count(*) as unique_slice_positions, round(median(step), 4) as median_slice_spacing from st group by 1),
u as (select series_key, coalesce(bool_or(median_slice_spacing <> 0 and abs(step - median_slice_spacing) > greatest(0.2, abs(median_slice_spacing) * 0.1)), false) as nonuniform_slice_spacing from st join m using (series_key) group by 1),
c as (select series_key, count(p) as k, count(n) - count(distinct n) as duplicate_instance_numbers from s group by 1)
select series_key, duplicate_instance_numbers, unique_slice_positions, median_slice_spacing, nonuniform_slice_spacing, greatest(0, k - unique_slice_positions) as duplicate_slice_positions from c join m using (series_key) join u using (series_key)
""")
def series_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    axes = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0)])
    place = F.array(F.lit(0.0), F.lit(0.0), (e % 40 * 2.5 + F.when((u % 7 == 0) & (e % 40 == 3), 1.0).otherwise(0.0)).cast("double"))
    rows = table(spark, sf_dir, "events").select(u.alias("series_key"), C.slice_position(axes, place).alias("position"), (e % 60).cast("int").alias("instance_number"))
    return C.geometry(rows)


@query("""
with s as (select user_id % 40 as study, event_id as series_key, case when user_id % 40 < 10 then case event_id % 3 when 0 then 't1_arterial' when 1 then 't1_venous' else 't1_delayed' end end as role,
  case when user_id % 40 % 4 = 3 then null else (date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + date_part('second', ts))::double end as k1, case when user_id % 40 % 8 = 7 then null else (event_id % 1000)::int end as k2 from events),
lab as (select study, count(*) as n, count(distinct role) as r, max(series_key) filter (role = 't1_arterial') as a, max(series_key) filter (role = 't1_venous') as v, max(series_key) filter (role = 't1_delayed') as d from s where role is not null group by 1 having count(*) = 3 and count(distinct role) = 3),
rest as (select * from s where study not in (select study from lab)), f as (select study, count(k1) = count(*) as timed, count(k2) = count(*) as numbered from rest group by 1),
k as (select r.study, series_key, case when timed then k1 else k2::double end as k from rest r join f on r.study = f.study where timed or numbered), o as (select study, count(*) as n, count(distinct k) as u, list(series_key order by k, series_key) as l from k group by 1)
select study, 'explicit' as strategy, a as t1_arterial, v as t1_venous, d as t1_delayed from lab union all select study, 'ordered', l[1], l[2], l[-1] from o where n >= 3 and n = u
""")
def dynamic_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, study = F.col("event_id"), F.col("user_id") % 40
    role = F.when(study < 10, F.when(e % 3 == 0, "t1_arterial").when(e % 3 == 1, "t1_venous").otherwise("t1_delayed"))
    clock = C.time_of_day(F.date_format("ts", "HHmmss"))
    rows = table(spark, sf_dir, "events").select(study.alias("study"), e.alias("series_key"), role.alias("role"), F.lit(True).alias("dynamic"), F.when(study % 4 != 3, clock).alias("acquisition_seconds"), F.when(study % 8 != 7, (e % 1000).cast("int")).alias("series_number"))
    return C.dynamic_phases(rows)


@query("select doc_id, case doc_id % 5 when 0 then 't1_arterial' when 1 then 't1_venous' when 2 then 't1_delayed' end as folder, case doc_id % 4 when 0 then 't1_arterial' when 1 then 't1_delayed' end as explicit from documents")
def phase_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    folder = F.when(d % 5 == 0, "Fase Arterial").when(d % 5 == 1, "PV").when(d % 5 == 2, "Equilíbrio").otherwise("axial")
    text = F.when(d % 4 == 0, "t1 art phase").when(d % 4 == 1, "late phase fl3d").when(d % 4 == 2, "portal and delayed").otherwise("t2 haste")
    return table(spark, sf_dir, "documents").select("doc_id", C.phase_of_folder(folder).alias("folder"), C.explicit_phase(text).alias("explicit"))


@query(f"""
with {COHORT}, ids as (select case when case_id % 3 = 0 then 'blind-' else 'anon-' end || case_id as case_id, 'grp-' || patient_group_id as patient_group_id from cohort), train as (select 'anon-' || case_id as case_id, 'g-' || patient_group_id as patient_group_id from cohort where case_id % 4 = 0)
select case_id, case when case_id in (select case_id from train) then 'in_sample' when split_part(case_id, '-', 1) = 'anon' then 'out_of_sample' else 'unknown' end as verdict from ids
""")
def provenance_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = cohort(spark, sf_dir), F.col("case_id")
    cases = rows.select(F.concat(F.when(c % 3 == 0, "blind-").otherwise("anon-"), c.cast("string")).alias("case_id"), F.concat(F.lit("grp-"), "patient_group_id").alias("patient_group_id"))
    training = rows.where("case_id % 4 = 0").select(F.concat(F.lit("anon-"), c.cast("string")).alias("case_id"), F.concat(F.lit("g-"), "patient_group_id").alias("patient_group_id"))
    return C.provenance_verdicts(cases, training).select("case_id", "verdict")


@query(f"""
with {COHORT}, ids as (select 'blind-' || case_id as case_id, case_id as n from cohort), named as (select case_id, n, case when n % 2 = 0 then 'anon-' || n else case_id end as r from ids), v as (select case when n % 2 = 0 and n % 4 = 0 then 'in_sample' when n % 2 = 0 then 'out_of_sample' else 'unknown' end as verdict from named)
select verdict, count(*) as cases from v group by 1
""")
def provenance_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = cohort(spark, sf_dir), F.col("case_id")
    name = lambda prefix: F.concat(F.lit(prefix), c.cast("string"))
    cases = rows.select(name("blind-").alias("case_id"), F.lit(None).cast("string").alias("patient_group_id"))
    training = rows.where("case_id % 4 = 0").select(name("anon-").alias("case_id"), name("anon-g").alias("patient_group_id"))
    original = rows.where("case_id % 2 = 0").select(name("blind-").alias("id"), name("anon-").alias("original"))
    return C.verdict_partition(C.provenance_verdicts(cases, training, original))


@query(f"with {_REGISTRY} select subject, count(*) as series, list_sort(list(distinct rag_class)) as roles, list_sort(list(distinct source_format)) as formats, list_sort(list(distinct dataset_id)) as datasets, count(distinct rag_class) > 1 or count(distinct source_format) > 1 as mixed from registry group by 1")
def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.subjects(_registry(spark, sf_dir).withColumnRenamed("rag_class", "role"))


@query(f"with {_REGISTRY}, m as (select max(r) as most from (select count(distinct rag_class) as r from registry group by dataset_id)) select rag_class as role, count(distinct subject) as subjects, count(distinct dataset_id) as datasets, any_value(most) <= 1 as confounded from registry, m group by 1")
def confounded_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.confounded(_registry(spark, sf_dir).withColumnRenamed("rag_class", "role"))


@query("select event_id, case when event_type in ('error', 'click') then 'invalid_response' else 'failure' end as status, case when value > 20 then event_type <> 'signup' and value <= 180 end as in_time from events")
def failure_and_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", C.failure_class(F.upper(e), ["err", "clic"]).alias("status"), C.time_gate(e != "signup", F.when(v > 20, v)).alias("in_time"))


@query("with c as (select o_custkey, count(*) as n from orders group by 1) select min(n) as minimum, count(*) filter (n = 1) as equal_1, count(*) filter (n < 5) as under_5, count(*) filter (n < 10) as under_10 from c")
def support_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return C.support_distribution(counts, "n", [5, 10])


_EDGES = f"""{_REGISTRY}, links as (
  select distinct * from (
    select case_id as source, 'FROM_DATASET' as kind, dataset_id as target, 'Dataset' as target_kind from registry union all select case_id, 'HAS_RAG_CLASS', rag_class, 'RagClass' from registry union all select case_id, 'HAS_LABEL', label, 'GroundTruthLabel' from registry
    union all select case_id, 'HAS_MODALITY', modality, 'Modality' from registry union all select case_id, 'HAS_SOURCE_FORMAT', source_format, 'SourceFormat' from registry union all select case_id, 'HAS_PHASE', phase, 'Phase' from registry
    union all select case_id, 'HAS_NEGATIVE_SUBTYPE', negative_subtype, 'NegativeSubtype' from registry where negative_subtype is not null union all select case_id, 'HAS_POSITIVE_SUBTYPE', positive_subtype, 'PositiveSubtype' from registry where positive_subtype is not null
    union all select case_id, 'HAS_PHENOTYPE_TAG', unnest(phenotype_tags), 'PhenotypeTag' from registry union all select case_id, 'HAS_LIMITATION', unnest(limitations), 'Limitation' from registry union all select case_id, 'HAS_LIMITATION', unnest(warnings), 'Limitation' from registry)
  union all select * from (values {', '.join(f"('{a}', 'CAN_MIMIC', '{b}', 'Finding')" for a, b in G.MIMICS)}, {', '.join(f"('{a}', 'NEGATIVE_FOR_TARGET', '{G.TARGET}', 'Finding')" for a in G.NEGATIVE_FOR_TARGET)}) v(source, kind, target, target_kind)
)"""


@query(f"with {_EDGES} select * from links")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges(_registry(spark, sf_dir))


@query(f"with {_EDGES} select 'Case' as kind, case_id as name from registry union select target_kind, target from links")
def graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _registry(spark, sf_dir)
    return G.vertices(rows, G.edges(rows))


@query(f"with {_EDGES} select case_id, dataset_id, negative_subtype, ['focal_fat'] as phenotype_tags from registry where negative_subtype = 'normal' and list_contains(phenotype_tags, 'focal_fat') order by case_id limit 10")
def graph_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _registry(spark, sf_dir)
    return G.case_context(G.edges(rows), rows, "normal", "focal_fat")


@query(f"with {_EDGES} select case_id, dataset_id, negative_subtype, case when negative_subtype = 'normal' then list_sort(phenotype_tags) else []::varchar[] end as phenotype_tags from registry order by case_id limit 25")
def graph_cases_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same read with conditions that leave no case out."""
    rows = _registry(spark, sf_dir)
    return G.case_context(G.edges(rows), rows, "normal", None, 25, matching_only=False)


@query(f"with {_EDGES} select source as phenotype_tag, target as finding from links where kind = 'CAN_MIMIC' and target = 'focal_liver_lesion'")
def graph_mimics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mimics(G.edges(_registry(spark, sf_dir)), finding="focal_liver_lesion")


@query(f"with {_EDGES} select distinct target as limitation from links where kind = 'HAS_LIMITATION' and source in (select source from links where kind = 'HAS_NEGATIVE_SUBTYPE' and target = 'normal') order by 1 limit 20")
def graph_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.limitations(G.edges(_registry(spark, sf_dir)), "normal")
