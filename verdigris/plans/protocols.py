"""Queries of the protocol operators and of single-signal exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import calibrate, chunking, protocol
from .base import COHORT, SIGNALS, cohort, query, signals, table

_RAW = """raw as (select case when doc_id % 9 = 0 then '' else 'c' || doc_id end as case_id, case when doc_id % 5 = 0 then null else lang end as dataset, case when doc_id % 2 = 0 then 'POSITIVE' else '' end as truth, 'Negative' as ground_truth_label,
  case doc_id % 4 when 0 then 'positiva' when 1 then 'NEGATIVA' when 2 then '' end as prediction, case doc_id % 6 when 0 then 'Failed' when 1 then 'decisive' when 2 then ' invalid ' when 3 then 'timeout' when 4 then '' end as status, case when doc_id % 3 = 0 then n_chars::double end as duration_seconds from documents)"""


@query(f"""
with {_RAW}, s as (select *, case lower(trim(coalesce(status, ''))) when 'failed' then 'failure' when 'invalid' then 'invalid_response' when '' then 'failure' else lower(trim(status)) end as st from raw)
select coalesce(nullif(case_id, ''), 'unknown') as case_id, coalesce(dataset, 'unknown') as dataset, lower(coalesce(nullif(truth, ''), ground_truth_label)) as truth, upper(nullif(prediction, '')) as prediction, st as status,
  case when st in ('failure', 'timeout', 'invalid_response') then upper(st) end as error_type, duration_seconds as total from s
""")
def coerced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        F.when(d % 9 == 0, "").otherwise(F.concat(F.lit("c"), d.cast("string"))).alias("case_id"), F.when(d % 5 != 0, F.col("lang")).alias("dataset"), F.when(d % 2 == 0, "POSITIVE").otherwise("").alias("truth"), F.lit("Negative").alias("ground_truth_label"),
        F.when(d % 4 == 0, "positiva").when(d % 4 == 1, "NEGATIVA").when(d % 4 == 2, "").alias("prediction"), F.when(d % 6 == 0, "Failed").when(d % 6 == 1, "decisive").when(d % 6 == 2, " invalid ").when(d % 6 == 3, "timeout").when(d % 6 == 4, "").alias("status"),
        F.when(d % 3 == 0, F.col("n_chars").cast("double")).alias("duration_seconds"),
    )
    return protocol.coerced(raw).withColumn("total", F.try_element_at("durations", F.lit("total"))).drop("durations")


@query(f"with {COHORT} select case_id, prediction, truth, case prediction when 'POSITIVA' then truth = 'positive' when 'NEGATIVA' then truth = 'negative' end as correct from cohort")
def attached_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir)
    return protocol.attach_truth(rows.select("case_id", "prediction"), rows)


@query("select case when o_orderkey is not null and l_orderkey is not null then 'both' when l_orderkey is not null then 'left' else 'right' end as side, count(*) as keys from (select distinct l_orderkey from lineitem) full join (select distinct o_orderkey from orders) on l_orderkey = o_orderkey group by 1")
def key_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return protocol.correspondence(left, right, ["k"])


@query("select o_orderkey as k, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)")
def corresponding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("k"))
    return protocol.corresponding(left, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), ["k"])


@query("select source as root, count(*) as files, sum(n_chars)::bigint as bytes, sha256(string_agg(doc_id || '.txt' || chr(0) || n_chars || chr(0) || sha256(text) || chr(10), '' order by doc_id || '.txt')) as sha256 from documents group by 1".replace("chr(0)", "'\x00'"))
def tree_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("root"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative"), F.col("n_chars").alias("length"), F.sha2("text", 256).alias("sha256"))
    return protocol.tree_fingerprints(files)


@query("select user_id as case_id, max(s) as log_odds, arg_max(event_id, [s, -event_id]) as candidate from (select user_id, event_id, ((event_id * 7) % 50)::double as s from events) group by 1")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return protocol.best_candidates(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), e.alias("candidate"), ((e * 7) % 50).cast("double").alias("log_odds")))


@query(f"with {SIGNALS} select case_id, case when s2 > s1 then 'pairwise' else 'identity' end as method, greatest(s1, s2) as selected_dice, greatest(s1, s2) >= 0.5 as accepted from signals")
def alignment_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).select("case_id", F.col("s1").alias("identity_dice"), F.col("s2").alias("pairwise_dice"))
    return protocol.alignment_choice(rows, 0.5).select("case_id", "method", "selected_dice", "accepted")


@query("select coalesce(a.z, b.z) as z, coalesce(a.y, b.y) as y, coalesce(a.x, b.x) as x, a.z is not null as in_first, b.z is not null as in_second from (select distinct event_id % 7 as z, event_id % 5 as y, event_id % 3 as x from events where event_type = 'click') a full join (select distinct event_id % 7 as z, event_id % 5 as y, event_id % 3 as x from events where value > 120) b on a.z = b.z and a.y = b.y and a.x = b.x")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").withColumns({"z": e % 7, "y": e % 5, "x": e % 3})
    return protocol.mask_union(rows.where("event_type = 'click'"), rows.where("value > 120"))


@query(f"with {SIGNALS} select case_id, 0.5::double * greatest(s1 - s2, 0.0) + 0.25::double * greatest(s1 - s3, 0.0) + 0.25::double * greatest(s2 - s3, 0.0) as joint, abs(s1 - s2) <= 0.25 and abs(s2 - s3) <= 0.25 as close from signals")
def joint_enhancement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("case_id", protocol.enhancement("s1", "s2", "s3").alias("joint"), N.lists_close(F.array("s1", "s2"), F.array("s2", "s3"), 0.25).alias("close"))


@query()
def chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of pages checked against their own rules, one of each kind broken."""
    chunks = chunking.chunk(chunking.to_markdown(table(spark, sf_dir, "pages")), "page_id", "markdown", 120, 20)
    n = F.col("ordinal") + F.col("page_id")
    return protocol.chunk_violations(chunks.withColumn("token_count", F.when(n % 50 == 0, F.col("token_count") + 1).otherwise(F.col("token_count"))), 118)


@query(f"""
with {COHORT}, targets as (select * from (values ('hcc', 60), ('metastasis', 30), ('no_focal_lesion', 25)) t(label, n)), wanted as (select label, g.t as turn from targets, generate_series(0, n - 1) g(t)),
planned as (select *, row_number() over (order by sha256('20260731|' || label || '|' || turn)) as i from wanted), pool as (select case_id::varchar as b, row_number() over (order by sha256('20260731|' || case_id)) - 1 as place, count(*) over () as total from cohort where truth = 'negative'),
donors as (select positive_subtype as label, case_id::varchar as donor, row_number() over (partition by positive_subtype order by sha256('20260731|' || positive_subtype || '|' || case_id)) - 1 as d, count(*) over (partition by positive_subtype) as k from cohort where positive_subtype is not null),
given as (select p.label, turn, i, b, ((i - 1) // total)::int + 1 as variant from planned p join pool on (i - 1) % total = place), sizes as (select distinct label, k from donors)
select 'planned-' || lpad(i::varchar, 4, '0') as case_id, g.label, b as background_case_id, variant as background_variant, donor as donor_case_id from given g left join sizes s on g.label = s.label left join donors d on d.label = g.label and d.d = g.turn % s.k
""")
def sampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan over the cohort in hash orders."""
    rows = cohort(spark, sf_dir).select(F.col("case_id").cast("string").alias("case_id"), F.col("positive_subtype").alias("label"), "truth")
    return protocol.sampling_plan(rows.where("truth = 'negative'"), rows.where("label is not null").select("case_id", "label"), {"hcc": 60, "metastasis": 30, "no_focal_lesion": 25}, 20260731)


@query()
def explored_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal by itself: apparent threshold, leave-one-out rates, ranked by the smaller rate."""
    rows = signals(spark, sf_dir)
    long = rows.select("case_id", "truth", F.explode(F.array(*[F.struct(F.lit(s).alias("feature"), F.col(s).alias("score")) for s in ("s1", "s2", "s3")])).alias("f")).select("case_id", "truth", "f.*")
    apparent = calibrate.best_threshold(long, "midpoints", ["feature"]).select("feature", "threshold", F.col("minimum_rate").alias("apparent_minimum"))
    held = calibrate.binary_rates(calibrate.leave_one_out_threshold(long, ["feature"]), ["feature"])
    return apparent.join(held, "feature").orderBy(F.desc("minimum_rate"), F.desc("balanced_accuracy"), "feature")
