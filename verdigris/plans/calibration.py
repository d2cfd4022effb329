"""Queries of the calibration, fusion and fold operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate, folds, leave_out
from .base import COHORT, SIGNALS, cohort, query, signals

WEIGHTS = {"s1": 0.4, "s2": 0.4, "s3": 0.2}


def _ecdf(value: str, over: str, alias: str) -> str:
    return f"((rank() over ({over} order by {value}) - 1) + 0.5 * count(*) over (partition by {', '.join([x for x in ['dataset_id' if 'dataset_id' in over else '', value] if x])})) / count(*) over ({over}) as {alias}"


@query(f"with {SIGNALS} select case_id, {_ecdf('s1', 'partition by dataset_id', 'ecdf')} from signals")
def ecdf_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.ecdf(signals(spark, sf_dir), "s1", ["dataset_id"]).select("case_id", "ecdf")


@query(f"""
with {SIGNALS}, reference as (select s3 from signals where fold <> 0)
select case_id, ((select count(*) from reference r where r.s3 < s.s3) + 0.5 * (select count(*) from reference r where r.s3 = s.s3)) / (select count(*) from reference) as ecdf from signals s
""")
def ecdf_against_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).withColumn("train", F.col("fold") != 0)
    return calibrate.ecdf(rows, "s3", reference="train").select("case_id", "ecdf")


@query(f"with {SIGNALS} select case_id, ((rank() over (order by s3) - 1) + (count(*) over (partition by s3) - 1) / 2) / greatest(1, count(*) over () - 1) as percentile from signals")
def percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.percentile_rank(signals(spark, sf_dir), "s3").select("case_id", "percentile")


@query(f"""
with {SIGNALS}, ranked as (select case_id, round(cume_dist() over (order by s1), 5) as a, round(cume_dist() over (order by s3), 5) as b from signals), blended as (select *, (a + b) / 2 as final from ranked),
placed as (select *, row_number() over (order by final desc, case_id) as best, row_number() over (order by final, case_id desc) as worst from blended)
select case_id, a, b, final, case when best <= 10 then 'best' else 'worst' end as side from placed where best <= 10 or worst <= 10
""")
def blended_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half and half of two cume_dist percentiles, the ten best and the ten worst; each end is a top-k, not a full sort."""
    rows = calibrate.cume_dist(calibrate.cume_dist(signals(spark, sf_dir), "s1", alias="a"), "s3", alias="b").select("case_id", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))
    rows = rows.withColumn("final", (F.col("a") + F.col("b")) / 2)
    best, worst = rows.orderBy(F.desc("final"), "case_id").limit(10), rows.orderBy("final", F.desc("case_id")).limit(10)
    return best.withColumn("side", F.lit("best")).union(worst.withColumn("side", F.lit("worst"))).groupBy("case_id", "a", "b", "final").agg(F.min("side").alias("side"))


_FUSED = f"""fused as (
  select case_id, truth, fold, 0.0::double + 0.4::double * e1 + 0.4::double * e2 + 0.2::double * e3 as fused from (
    select *, {_ecdf('s1', '', 'e1').replace('over ( order', 'over (order').replace('over ()', 'over ()')}, {_ecdf('s2', '', 'e2').replace('over ( order', 'over (order')}, {_ecdf('s3', '', 'e3').replace('over ( order', 'over (order')} from signals)
)"""


@query(f"with {SIGNALS}, {_FUSED} select case_id, fused from fused")
def weighted_ecdf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.weighted_ecdf(signals(spark, sf_dir), WEIGHTS).select("case_id", "fused")


@query(f"with {SIGNALS}, {_FUSED}, other as (select case_id, {_ecdf('score', '', 'e').replace('over ( order', 'over (order')} from cohort) select case_id, 0.5::double * fused + 0.5::double * e as fused from fused join other using (case_id)")
def two_level_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).join(cohort(spark, sf_dir).select("case_id", "score"), "case_id")
    return calibrate.two_level_fusion(rows, WEIGHTS, "score", (0.5, 0.5)).select("case_id", "fused")


@query(f"""
with {SIGNALS}, refs as (select s1, s2, s3 from signals where fold < 3), n as (select count(*) as n from refs), seen as (select * from signals where fold >= 3),
scored as (
  select case_id, 0.0::double + 0.4::double * (((select count(*) from refs r where r.s1 < s.s1) + 0.5 * (select count(*) from refs r where r.s1 = s.s1)) / n)
    + 0.4::double * (((select count(*) from refs r where r.s2 < s.s2) + 0.5 * (select count(*) from refs r where r.s2 = s.s2)) / n)
    + 0.2::double * (((select count(*) from refs r where r.s3 < s.s3) + 0.5 * (select count(*) from refs r where r.s3 = s.s3)) / n) as score from seen s, n)
select case_id, score, 0.5::double as threshold, case when score >= 0.5 then 'POSITIVE' else 'NEGATIVE' end as prediction from scored
""")
def frozen_calibrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir)
    stored = rows.where("fold < 3").select(F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("value")) for n in WEIGHTS])).alias("r")).select("r.signal", "r.value")
    return calibrate.frozen_scores(rows.where("fold >= 3"), stored, WEIGHTS, 0.5)


_LEVELS = """levels as (select {by} s3 as s, count(*) filter (truth) as p, count(*) filter (not truth) as n from signals group by all), totals as (select {by} sum(p) as tp_all, sum(n) as tn_all from levels group by all)"""


def _threshold(kind: str, prefer: str, by: str = "dataset_id") -> str:
    cands = {
        "midpoints": "select dataset_id, min(s) - 1e-12::double as t from levels group by 1 union all select dataset_id, (s + nxt) / 2 from gaps where nxt is not null union all select dataset_id, max(s) + 1e-12::double from levels group by 1",
        "unit": "select dataset_id, t from (select distinct dataset_id from levels), (values (0.0::double), (1.0::double)) v(t) union select dataset_id, s from levels union select dataset_id, (s + nxt) / 2 from gaps where nxt is not null",
        "observed": "select dataset_id, s as t from levels",
        "frontier": "select distinct dataset_id, '-infinity'::double as t from levels union all select dataset_id, s from levels union all select distinct dataset_id, 'infinity'::double from levels",
        "edges": "select dataset_id, min(s) - 1e-12::double as t from levels group by 1 union all select dataset_id, s from levels union all select dataset_id, max(s) + 1e-12::double from levels group by 1",
    }[kind]
    order = {"even": "minimum_rate desc, balanced_accuracy desc, -abs(sensitivity - specificity) desc, threshold", "near_half": "minimum_rate desc, balanced_accuracy desc, abs(threshold - 0.5), threshold", "large": "minimum_rate desc, sensitivity + specificity desc, threshold desc", "sensitive": "minimum_rate desc, balanced_accuracy desc, sensitivity desc, specificity desc, threshold desc"}[prefer]
    return f"""
with {SIGNALS}, {_LEVELS.format(by="dataset_id,")}, gaps as (select *, lead(s) over (partition by dataset_id order by s) as nxt from levels), cands as ({cands}), counted as (
  select c.dataset_id, c.t as threshold, coalesce(sum(l.p) filter (l.s >= c.t), 0)::bigint as tp, coalesce(sum(l.n) filter (l.s < c.t), 0)::bigint as tn, coalesce(sum(l.n) filter (l.s >= c.t), 0)::bigint as fp, coalesce(sum(l.p) filter (l.s < c.t), 0)::bigint as fn
  from cands c join levels l on c.dataset_id = l.dataset_id group by 1, 2
), rated as (select *, coalesce(tp / nullif(tp + fn, 0), 0.0) as sensitivity, coalesce(tn / nullif(tn + fp, 0), 0.0) as specificity from counted),
scored as (select *, least(sensitivity, specificity) as minimum_rate, (sensitivity + specificity) / 2 as balanced_accuracy from rated)
select * exclude (r) from (select *, count(*) filter (sensitivity >= 0.75 and specificity >= 0.75) over (partition by dataset_id) as feasible, row_number() over (partition by dataset_id order by {order}) as r from scored) where r = 1
"""


def _best(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return calibrate.best_threshold(signals(spark, sf_dir), kind, ["dataset_id"], "s3")

    run.__name__ = f"threshold_{kind}"
    return run


for _kind, _prefer in calibrate.PREFERENCES.items():
    query(_threshold(_kind, _prefer))(_best(_kind))


@query(f"""
with {SIGNALS}, base as (select case_id, truth, s3 as s from signals), held as (select distinct s as hs, truth as ht from base), lv as (
  select hs, ht, s, count(*) filter (truth) - max(case when s = hs and ht then 1 else 0 end) as p, count(*) filter (not truth) - max(case when s = hs and not ht then 1 else 0 end) as n from held, base group by 1, 2, 3
), levels as (select * from lv where p + n > 0), gaps as (select *, lead(s) over (partition by hs, ht order by s) as nxt from levels),
cands as (select hs, ht, min(s) - 1e-12::double as t from levels group by 1, 2 union all select hs, ht, (s + nxt) / 2 from gaps where nxt is not null union all select hs, ht, max(s) + 1e-12::double from levels group by 1, 2),
rated as (
  select c.hs, c.ht, c.t, coalesce(sum(l.p) filter (l.s >= c.t) / nullif(sum(l.p), 0), 0.0) as se, coalesce(sum(l.n) filter (l.s < c.t) / nullif(sum(l.n), 0), 0.0) as sp from cands c join levels l on c.hs = l.hs and c.ht = l.ht group by 1, 2, 3
), best as (select hs, ht, t from (select *, row_number() over (partition by hs, ht order by least(se, sp) desc, (se + sp) / 2 desc, -abs(se - sp) desc, t) as r from rated) where r = 1)
select case_id, t as threshold, s >= t as predicted from base join best on s = hs and truth = ht
""")
def leave_one_out_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.leave_one_out_threshold(signals(spark, sf_dir), score="s3").select("case_id", "threshold", "predicted")


def _refits(held: str, keys: str, fused: str) -> str:
    """SQL of the best midpoint threshold of each refit, from ``{held}`` (the keys, truth and fused score of the rows that train it)."""
    order = f"over (partition by {keys} order by s rows between unbounded preceding and current row)"
    return f"""{fused}_levels as (select {keys}, f as s, count(*) filter (truth) as p, count(*) filter (not truth) as n from {held} group by {keys}, f),
{fused}_sums as (
  select *, lead(s) over (partition by {keys} order by s) as nxt, sum(p) {order} as cp, sum(n) {order} as cn, sum(p) over (partition by {keys}) as pp, sum(n) over (partition by {keys}) as nn, row_number() over (partition by {keys} order by s) as k from {fused}_levels
), {fused}_rated as (
  select {keys}, s - 1e-12::double as t, 1.0::double as se, 0.0::double as sp from {fused}_sums where k = 1 union all select {keys}, s + 1e-12::double, 0.0, 1.0 from {fused}_sums where nxt is null
  union all select {keys}, (s + nxt) / 2, (pp - cp + case when (s + nxt) / 2 <= s then p else 0 end) / pp, (cn - case when (s + nxt) / 2 <= s then n else 0 end) / nn from {fused}_sums where nxt is not null
), {fused} as (select {keys}, t from (select *, row_number() over (partition by {keys} order by least(se, sp) desc, (se + sp) / 2 desc, -abs(se - sp) desc, t) as r from {fused}_rated) where r = 1)"""


_RANK = "(rank() over (partition by {keys} order by {s}) - 1 + 0.5 * count(*) over (partition by {keys}, {s})) / count(*) over (partition by {keys})"
_OWN = "(count(*) filter (o.{s} < h.{s}) + 0.5 * count(*) filter (o.{s} = h.{s})) / count(*)"


@query(f"""
with {SIGNALS}, train as (
  select h.case_id as held, o.truth, 0.0 + 0.5::double * ({_RANK.format(keys="h.case_id", s="o.s1")}) + 0.3::double * ({_RANK.format(keys="h.case_id", s="o.s2")}) + 0.2::double * ({_RANK.format(keys="h.case_id", s="o.s3")}) as f
  from signals h join signals o on h.case_id <> o.case_id
), {_refits("train", "held", "best")}, own as (
  select h.case_id, 0.0 + 0.5::double * ({_OWN.format(s="s1")}) + 0.3::double * ({_OWN.format(s="s2")}) + 0.2::double * ({_OWN.format(s="s3")}) as fused from signals h join signals o on h.case_id <> o.case_id group by h.case_id
)
select case_id, fused, t as threshold, fused >= t as predicted from own join best on case_id = held
""")
def leave_one_out_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case by the ECDFs and the threshold of all others."""
    return leave_out.leave_one_out_fusion(signals(spark, sf_dir), {"s1": 0.5, "s2": 0.3, "s3": 0.2}).select("case_id", "fused", "threshold", "predicted")


@query(f"""
with {SIGNALS}, grid as (select unnest([0.0, 0.1, 0.2])::double as w), pairs as (
  select a.case_id as i, b.case_id as j, b.dataset_id from signals a join signals b on a.dataset_id = b.dataset_id and a.case_id <> b.case_id
), inner_ranks as (
  select i, j, o.truth, {_RANK.format(keys="i, j", s="o.s1")} as e1, {_RANK.format(keys="i, j", s="o.s3")} as e2
  from pairs join signals o on o.dataset_id = pairs.dataset_id and o.case_id <> i and o.case_id <> j
), inner_train as (select i, j, w, truth, 0.0 + (1 - w) * e1 + w * e2 as f from inner_ranks, grid), {_refits("inner_train", "i, j, w", "inner_best")}, inner_own as (
  select i, j, any_value(h.truth) as truth, {_OWN.format(s="s1")} as e1, {_OWN.format(s="s3")} as e2
  from pairs join signals h on h.case_id = j join signals o on o.dataset_id = pairs.dataset_id and o.case_id <> i and o.case_id <> j group by i, j
), said as (select i, w, truth, 0.0 + (1 - w) * e1 + w * e2 >= t as yes from inner_own join inner_best using (i, j)),
metrics as (select i, w, (count(*) filter (truth and yes)) / (count(*) filter (truth)) as se, (count(*) filter (not truth and not yes)) / (count(*) filter (not truth)) as sp from said group by i, w),
chosen as (select i, w from (select *, row_number() over (partition by i order by least(se, sp) desc, (se + sp) / 2 desc, se desc, w) as r from metrics) where r = 1),
ranks as (select h.case_id as i, o.truth, {_RANK.format(keys="h.case_id", s="o.s1")} as e1, {_RANK.format(keys="h.case_id", s="o.s3")} as e2 from signals h join signals o on h.dataset_id = o.dataset_id and h.case_id <> o.case_id),
train as (select i, w, truth, 0.0 + (1 - w) * e1 + w * e2 as f from ranks join chosen using (i)), {_refits("train", "i, w", "best")}, own as (
  select h.case_id as i, {_OWN.format(s="s1")} as e1, {_OWN.format(s="s3")} as e2 from signals h join signals o on h.dataset_id = o.dataset_id and h.case_id <> o.case_id group by h.case_id
)
select case_id, case when enough then w end as w, case when enough then 0.0 + (1 - w) * e1 + w * e2 end as fused, case when enough then t end as threshold, case when enough then 0.0 + (1 - w) * e1 + w * e2 >= t end as predicted
from signals join (select dataset_id, least(count(*) filter (truth), count(*) filter (not truth)) > 2 as enough from signals group by 1) using (dataset_id) left join own on own.i = case_id left join best on best.i = case_id
""")
def nested_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case of a dataset by a blend whose weight and threshold the dataset's other cases choose; nulls in datasets with fewer than three cases of a class, where no pair can be left out."""
    return leave_out.nested_leave_one_out(signals(spark, sf_dir), "s1", "s3", [0.0, 0.1, 0.2], ["dataset_id"]).select("case_id", "w", "fused", "threshold", "predicted")


_HASHED = "select *, (row_number() over (partition by repeat, label order by sha256('20260724|' || repeat || '|' || label || '|' || case_id), case_id) - 1) % 5 as fold from labelled, generate_series(0, {last}) r(repeat)"


@query(f"with {COHORT}, labelled as (select case_id, upper(truth) as label from cohort), folds as ({_HASHED.format(last=2)}) select case_id, repeat::int as repeat, fold::int as fold from folds")
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir).select("case_id", F.upper("truth").alias("label"))
    return folds.hash_folds(rows, 5, 20260724, 3).select("case_id", "repeat", F.col("fold").cast("int").alias("fold"))


@query(f"with {COHORT} select case_id, ((row_number() over (partition by truth order by sha256('77|' || case_id), case_id) - 1) % 4)::int as inner_fold from cohort")
def inner_hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.inner_hash_folds(cohort(spark, sf_dir), 4, 77, label="truth").select("case_id", F.col("inner_fold").cast("int").alias("inner_fold"))


_CV = f"""
with {SIGNALS}, labelled as (select case_id, s3 as s, truth, case when truth then 'POSITIVE' else 'NEGATIVE' end as label from signals), folds as ({_HASHED.format(last=49)}),
levels as (select f.repeat, part, s, count(*) filter (truth) as p, count(*) filter (not truth) as n from folds f, generate_series(0, 4) g(part) where f.fold <> part group by 1, 2, 3),
gaps as (select *, lead(s) over (partition by repeat, part order by s) as nxt from levels),
cands as (select repeat, part, min(s) - 1e-12::double as t from levels group by 1, 2 union all select repeat, part, (s + nxt) / 2 from gaps where nxt is not null union all select repeat, part, max(s) + 1e-12::double from levels group by 1, 2),
rated as (select c.repeat, c.part, c.t, coalesce(sum(l.p) filter (l.s >= c.t) / nullif(sum(l.p), 0), 0.0) as se, coalesce(sum(l.n) filter (l.s < c.t) / nullif(sum(l.n), 0), 0.0) as sp from cands c join levels l on c.repeat = l.repeat and c.part = l.part group by 1, 2, 3),
best as (select repeat, part, t from (select *, row_number() over (partition by repeat, part order by least(se, sp) desc, (se + sp) / 2 desc, -abs(se - sp) desc, t) as r from rated) where r = 1),
decided as (select f.repeat, f.truth, f.s >= b.t as predicted from folds f join best b on f.repeat = b.repeat and f.fold = b.part),
rates as (select repeat, coalesce(count(*) filter (truth and predicted) / nullif(count(*) filter (truth), 0), 0.0) as se, coalesce(count(*) filter (not truth and not predicted) / nullif(count(*) filter (not truth), 0), 0.0) as sp from decided group by 1)
select count(*) as repeats, count(*) filter (se >= 0.75 and sp >= 0.75) as runs_passing, median(se) as median_sensitivity, median(sp) as median_specificity, min(se) as minimum_sensitivity, min(sp) as minimum_specificity from rates
"""


@query(_CV)
def repeated_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).drop("fold").withColumn("label", F.when(F.col("truth"), "POSITIVE").otherwise("NEGATIVE"))
    dealt = folds.hash_folds(rows, 5, 20260724, 50)
    decided = calibrate.cross_validated_threshold(dealt, "fold", 5, ["repeat"], score="s3")
    return calibrate.repeated_summary(calibrate.binary_rates(decided, ["repeat"]))


_EC = "((select count(*) from signals r where r.fold <> s.part and r.{0} < s.{0}) + 0.5 * (select count(*) from signals r where r.fold <> s.part and r.{0} = s.{0})) / t.n"


@query(f"""
with {SIGNALS}, parts as (select s.*, p.part from signals s, generate_series(0, 4) p(part)), totals as (select p.part, count(*) as n from signals, generate_series(0, 4) p(part) where fold <> p.part group by 1),
fused as (select case_id, truth, fold, s.part, 0.0::double + 0.4::double * ({_EC.format('s1')}) + 0.4::double * ({_EC.format('s2')}) + 0.2::double * ({_EC.format('s3')}) as f from parts s join totals t on s.part = t.part),
levels as (select part, f, count(*) filter (truth) as p, count(*) filter (not truth) as n from fused where fold <> part group by 1, 2), gaps as (select *, lead(f) over (partition by part order by f) as nxt from levels),
cands as (select part, min(f) - 1e-12::double as t from levels group by 1 union all select part, (f + nxt) / 2 from gaps where nxt is not null union all select part, max(f) + 1e-12::double from levels group by 1),
rated as (select c.part, c.t, coalesce(coalesce(sum(l.p) filter (l.f >= c.t), 0) / nullif(sum(l.p), 0), 0.0) as se, coalesce(coalesce(sum(l.n) filter (l.f < c.t), 0) / nullif(sum(l.n), 0), 0.0) as sp from cands c join levels l on c.part = l.part group by 1, 2),
best as (select part, t from (select *, row_number() over (partition by part order by least(se, sp) desc, (se + sp) / 2 desc, -abs(se - sp) desc, t) as r from rated) where r = 1)
select case_id, f as fused, t as threshold, f >= t as predicted from fused join best on fused.part = best.part where fold = fused.part
""")
def cross_validated_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ECDFs, fusion and threshold from the other folds for every case."""
    return calibrate.cross_validated_fusion(signals(spark, sf_dir), WEIGHTS, "fold", 5).select("case_id", "fused", "threshold", "predicted")


@query()
def nested_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blend's weight by inner cross-validation in each dataset."""
    return calibrate.nested_weight(signals(spark, sf_dir), "s1", "s2", [0.0, 0.25, 0.5, 0.75, 1.0], "fold", 5, ["dataset_id"])


@query(f"""
with {SIGNALS}, rows as (select case_id, case when fold = 4 then null else s1 end as a, s2 as b, case_id % 9 = 0 as bf from signals),
fused as (select case_id, bf or a is null as technical_failure, 0.0::double + 0.6::double * (a - 0.5::double) + 0.4::double * (b - 0.25::double) as m from rows)
select case_id, technical_failure, case when not technical_failure then m end as margin, case when technical_failure then 'TECHNICAL_FAILURE' when m >= 0 then 'POSITIVE' else 'NEGATIVE' end as prediction from fused
""")
def late_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).select("case_id", F.when(F.col("fold") != 4, F.col("s1")).alias("a_score"), F.lit(0.5).alias("a_threshold"), F.lit(False).alias("a_failed"), F.col("s2").alias("b_score"), F.lit(0.25).alias("b_threshold"), (F.col("case_id") % 9 == 0).alias("b_failed"))
    return calibrate.late_fusion(rows, {"a": 0.6, "b": 0.4}).select("case_id", "technical_failure", "margin", "prediction")


#: Signal rows with gaps: s2 lacks some cases, s3 fails for some.
_LONG = """long as (
  select 's1' as signal, case_id, s1 as score, 0.5::double as threshold, false as technical_failure from signals union all
  select 's2', case_id, s2, 0.25::double, false from signals where case_id % 6 <> 0 union all
  select 's3', case_id, case when case_id % 10 = 0 then null else s3 end, 0.5::double, case_id % 8 = 0 from signals
)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = signals(spark, sf_dir), F.col("case_id")
    one = lambda name, where, score, threshold, failed: rows.where(where).select(F.lit(name).alias("signal"), "case_id", score.alias("score"), F.lit(threshold).alias("threshold"), failed.alias("technical_failure"))
    return one("s1", F.lit(True), F.col("s1"), 0.5, F.lit(False)).union(one("s2", c % 6 != 0, F.col("s2"), 0.25, F.lit(False))).union(one("s3", F.lit(True), F.when(c % 10 != 0, F.col("s3")), 0.5, c % 8 == 0))


def _margins(policy: str) -> str:
    cells = [f"max(score - threshold) filter (signal = '{n}' and not technical_failure and score is not null and threshold is not null)" for n in ("s1", "s2", "s3")]
    values = "coalesce(a, 0.0), coalesce(b, 0.0), coalesce(c, 0.0)" + (", (a is null)::int::double, (b is null)::int::double, (c is null)::int::double" if policy.endswith("indicator") else "")
    test = "a is not null and b is not null and c is not null" if policy == "fail_case" else "a is not null or b is not null or c is not null"
    return f"with {SIGNALS}, {_LONG}, wide as (select case_id, {cells[0]} as a, {cells[1]} as b, {cells[2]} as c from long group by 1) select case_id, case when {test} then [{values}] end as features from wide"


def _features(policy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return calibrate.margin_features(_long(spark, sf_dir), ["s1", "s2", "s3"], policy)

    run.__name__ = f"margins_{policy}"
    return run


for _policy in ("fail_case", "zero_margin", "zero_margin_with_indicator"):
    query(_margins(_policy))(_features(_policy))


@query(f"with {SIGNALS}, {_LONG}, wide as (select case_id, max(score) filter (signal = 's1' and not technical_failure) as a, max(score) filter (signal = 's3' and not technical_failure) as b from long group by 1) select count(*) as shared_cases, corr(a, b) as correlation from wide where a is not null and b is not null")
def signal_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.score_correlation(_long(spark, sf_dir), "s1", "s3")


@query(f"with {SIGNALS}, {_LONG}, full_cases as (select case_id from long group by 1 having count(distinct signal) = 3) select l.case_id, signal, score, dataset_id from long l join full_cases using (case_id) join signals using (case_id)")
def aligned_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.aligned(_long(spark, sf_dir), signals(spark, sf_dir).select("case_id", "dataset_id")).select("case_id", "signal", "score", "dataset_id")


@query(f"with {SIGNALS} select case_id, 'left' as side from signals where case_id % 6 = 0")
def one_sided_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir)
    return calibrate.one_sided(rows, rows.where("case_id % 6 <> 0"))


@query(f"""
with {COHORT}, dealt as (select case_id, patient_group_id, (case_id % 3)::int as fold from cohort)
select 'group_crosses_folds' as rule, patient_group_id as subject from dealt group by 2 having count(distinct fold) > 1
""")
def fold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds by case number let groups leak: all violations."""
    return folds.split_violations(cohort(spark, sf_dir).withColumn("fold", (F.col("case_id") % 3).cast("int")), 3)


def _greedy(folds: int) -> str:
    """SQL that deals the rows of ``ordered`` (part, k from 1, group_id, label, n) one by one: fewest cases of the label, fewest cases, first fold."""
    none = "[" + ", ".join(["0"] * folds) + "]"
    target = f"(list_min(list_transform(range({folds}), lambda f: (case o.label when 'positive' then w.pos else w.neg end)[f + 1] * 1000000000 + w.whole[f + 1] * 1000 + f)) % 1000)::int"
    added = lambda c, test: f"case when {test} then list_transform(range({folds}), lambda f: {c}[f + 1] + case when f = fold then n else 0 end) else {c} end"
    return f"""walked as (
  select distinct part, 0::bigint as k, ''::varchar as group_id, {none}::bigint[] as pos, {none}::bigint[] as neg, {none}::bigint[] as whole, 0 as fold from ordered
  union all
  select part, k, group_id, {added("pos", "label = 'positive'")}, {added("neg", "label <> 'positive'")}, {added("whole", "true")}, fold
  from (select o.part, o.k::bigint as k, o.group_id, o.label, o.n, w.pos, w.neg, w.whole, {target} as fold from walked w join ordered o on o.part = w.part and o.k = w.k + 1)
)"""


@query(f"""
with recursive {COHORT}, groups as (select patient_group_id as group_id, max(truth) as label, count(*) as n from cohort group by 1),
ordered as (select 0 as part, *, row_number() over (order by n desc, label, sha256('9|' || group_id), group_id) as k from groups), {_greedy(4)}
select case_id, fold::int as fold from cohort join walked on group_id = patient_group_id
""")
def group_hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.group_hash_folds(cohort(spark, sf_dir), 4, 9, label="truth").select("case_id", F.col("fold").cast("int").alias("fold"))


_INNER_SEEDS = " ".join(f"when {k} then '{folds.stable_seed(20260724, f'outer-{k}')}'" for k in range(5))


@query(f"""
with recursive {COHORT}, groups as (select patient_group_id || '-' || truth as group_id, min(truth) as label, count(*) as n from cohort group by 1),
outer_folds as (with recursive ordered as (select 0 as part, *, row_number() over (order by n desc, label, sha256('20260724|' || group_id)) as k from groups), {_greedy(5)} select group_id, fold as own from walked where k > 0),
placed as (select *, k::int as outer_fold from groups join outer_folds using (group_id), generate_series(0, 4) s(k)),
ordered as (select outer_fold as part, group_id, label, n, row_number() over (partition by outer_fold order by n desc, label, sha256((case outer_fold {_INNER_SEEDS} end) || '|' || group_id)) as k from placed where own <> outer_fold), {_greedy(4)}
select outer_fold, null::int as inner_fold, group_id, 'test' as role from placed where own = outer_fold
union all select part, fold::int, group_id, 'train' from walked where k > 0
""")
def nested_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer folds of groups, and inner ones with a seed for each outer fold."""
    rows = cohort(spark, sf_dir).withColumn("patient_group_id", F.concat_ws("-", "patient_group_id", "truth"))
    return folds.nested_group_folds(rows, 5, 4, 20260724, label="truth")


@query(f"with {COHORT} select g.part::int as part, case_id from cohort, generate_series(0, 4) g(part) where case_id % 5 <> g.part and case_id % 3 = 0")
def outer_training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort(spark, sf_dir).withColumn("fold", (F.col("case_id") % 5).cast("int"))
    return folds.outer_train(folds.restricted(rows, rows.where("case_id % 3 = 0")))
