"""Queries of the statistics, sequence and shape operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import shapes, stats
from .base import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


_SCALE = """firsts as (select event_type, median(value) as m, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3, stddev_pop(value) as sd from events group by 1),
spread as (select event_type, median(abs(value - m)) as mad from events join firsts using (event_type) group by 1),
scales as (select event_type, m as median, case when 1.4826 * mad > 1e-8 then 1.4826 * mad when (q3 - q1) / 1.349 > 1e-8 then (q3 - q1) / 1.349 when sd > 1e-8 then sd end as scale from firsts join spread using (event_type))"""


@query(f"with {_SCALE} select * from scales")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.robust_scale(_events(spark, sf_dir), "value", ["event_type"])


@query(f"with {_SCALE} select event_id, greatest(-8.0, least(8.0, (value - median) / scale)) as z from events join scales using (event_type)")
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.robust_z(_events(spark, sf_dir), "value", ["event_type"]).select("event_id", "z")


@query("select event_id, round((value - avg(value) over w) / stddev_pop(value) over w, 9) as zscore, round((value - min(value) over w) / (max(value) over w - min(value) over w), 9) as minmax from events window w as (partition by user_id)")
def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normalized(_events(spark, sf_dir), "value", ["user_id"]).select("event_id", F.round("zscore", 9).alias("zscore"), F.round("minmax", 9).alias("minmax"))


@query("""
with b as (select event_type, least(31, floor((greatest(-5.0, least(5.0, value / 20 - 2.5)) + 5.0) / 0.3125)) as b from events), c as (select event_type, b, count(*) as n from b group by 1, 2)
select event_type, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 9) as entropy from c group by 1
""")
def histogram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.entropy(_events(spark, sf_dir).withColumn("v", F.col("value") / 20 - 2.5), "v", ["event_type"]).select("event_type", F.round("entropy", 9).alias("entropy"))


_V = "(value - 50) / 20"


@query(f"""
select event_type, count(*) as n, round(avg(v), 9) as mean, round(stddev_pop(v), 9) as std, round(skewness(v), 7) as skew, round(kurtosis(v), 7) as kurtosis, quantile_cont(v, 0.01) as q01, quantile_cont(v, 0.05) as q05, quantile_cont(v, 0.1) as q10,
       quantile_cont(v, 0.9) as q90, quantile_cont(v, 0.95) as q95, quantile_cont(v, 0.99) as q99, avg((v > 2)::int) as gt_2, avg((v > 3)::int) as gt_3, avg((v < -2)::int) as lt_minus2, avg((v < -3)::int) as lt_minus3
from (select event_type, {_V} as v from events) group by 1
""")
def distribution_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.distribution(_events(spark, sf_dir).withColumn("v", (F.col("value") - 50) / 20), "v", ["event_type"])
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9), "skew": F.round("skew", 7), "kurtosis": F.round("kurtosis", 7)})


def _tails(v: str) -> str:
    return f"""
with r as (select event_type, v, row_number() over (partition by event_type order by v desc) as i, count(*) over (partition by event_type) as n from (select event_type, {v} as v from events))
select event_type, quantile_cont(v, 0.9) as q90, quantile_cont(v, 0.95) as q95, quantile_cont(v, 0.99) as q99, round(avg(v) filter (i <= greatest(1, ceil(n * 0.01))), 9) as top1pct_mean, max(v) as maximum from r group by 1
"""


@query(_tails("value"))
def tail_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tails(_events(spark, sf_dir), "value", ["event_type"]).withColumn("top1pct_mean", F.round("top1pct_mean", 9))


@query(_tails(f"abs({_V})"))
def absolute_tail_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("v", (F.col("value") - 50) / 20)
    return stats.tails(rows, "v", ["event_type"], absolute=True).withColumn("top1pct_mean", F.round("top1pct_mean", 9))


_INDEX = {"nearest": "ceil(0.95::double * n) - 1", "higher": "ceil((n - 1) * 0.95::double)", "rounded": "round_even(0.95::double * (n - 1), 0)", "truncated": "floor(0.95::double * (n - 1))"}


def _quantile(mode: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats.quantile(_events(spark, sf_dir), "value", 0.95, mode, ["event_type"])

    run.__name__ = f"quantile_{mode}"
    if mode == "linear":
        sql = "select event_type, quantile_cont(value, 0.95) as quantile from events group by 1"
    else:
        sql = f"select event_type, value as quantile from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events) where i = {_INDEX[mode]}"
    query(sql)(run)


for _mode in ("linear", "nearest", "higher", "rounded", "truncated"):
    _quantile(_mode)


@query("select user_id, count(*) as n, min(value) as minimum, quantile_cont(value, 0.25) as q25, median(value) as median, quantile_cont(value, 0.75) as q75, max(value) as maximum, round(avg(value), 9) as mean from events group by 1")
def five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.five_numbers(_events(spark, sf_dir), "value", ["user_id"]).withColumn("mean", F.round("mean", 9))


@query("with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by 1, 2) select user_id, event_type as mode from (select *, row_number() over (partition by user_id order by n desc, f) as r from c) where r = 1")
def first_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mode(_events(spark, sf_dir), "event_type", "event_id", ["user_id"])


@query("""
with r as (select user_id, value, avg(value) over w as m, count(*) over w as n from events window w as (partition by user_id order by ts, event_id rows between 4 preceding and current row))
select user_id, round(coalesce(max(m) filter (n = 5), avg(value)), 9) as rolling_maximum from r group by 1
""")
def rolling_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rolling_maximum(_events(spark, sf_dir), "value", ["ts", "event_id"], 5, ["user_id"]).withColumn("rolling_maximum", F.round("rolling_maximum", 9))


@query("""
with i as (select user_id, value >= 40 as f, row_number() over (partition by user_id order by ts, event_id) as i from events), g as (select *, i - row_number() over (partition by user_id, f order by i) as g from i),
r as (select user_id, f, g, count(*) as n from g group by 1, 2, 3) select user_id, coalesce(max(n) filter (f), 0) as longest_run from r group by 1
""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.longest_run(_events(spark, sf_dir), F.col("value") >= 40, ["ts", "event_id"], ["user_id"])


@query("""
with r as (select l_orderkey, l_linenumber, l_quantity::double as size, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) as rank, count(*) over (partition by l_orderkey) as n, sum(l_quantity::double) over (partition by l_orderkey) as total from lineitem),
c as (select *, sum(size) over (partition by l_orderkey order by rank) / total as covered from r), s as (select *, min(case when rank >= least(2, n) and covered >= 0.6 then rank end) over (partition by l_orderkey) as stop from c)
select l_orderkey, l_linenumber, size, rank::int as rank, covered from s where stop <= 4 and rank <= stop
""")
def coverage_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("size"))
    return stats.coverage_selection(lines, "size", "l_linenumber", ["l_orderkey"], 2, 4, 0.6)


@query("select l_orderkey, l_linenumber, rank::int as rank from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) as rank from lineitem) where rank <= 3")
def largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return stats.largest(lines, "l_quantity", "l_linenumber", ["l_orderkey"], 3).select("l_orderkey", "l_linenumber", "rank")


@query("select event_id, ntile(5) over (partition by user_id order by ts, event_id)::int as block from events")
def balanced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.balanced_blocks(_events(spark, sf_dir), ["ts", "event_id"], 5, ["user_id"]).select("event_id", "block")


@query("select l_orderkey, sum(l_quantity::double * l_discount::double) / sum(l_quantity::double) as weighted_d from lineitem group by 1")
def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))
    return stats.weighted_means(lines, "q", ["d"], ["l_orderkey"])


@query("select event_type, 2 * count(*) filter (value > 30 and user_id % 2 = 0) / nullif(count(*) filter (value > 30) + count(*) filter (user_id % 2 = 0), 0) as dice from events group by 1")
def dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumns({"a": F.col("value") > 30, "b": F.col("user_id") % 2 == 0})
    return stats.dice(rows, "a", "b", ["event_type"])


@query("""
with inside as (select user_id, event_type from events where value > 60), t as (select user_id, count(*) as total from inside group by 1), c as (select user_id, event_type, count(*) as n from inside group by 1, 2)
select user_id, event_type, n, 100 * n / total as percent, row_number() over (partition by user_id order by n desc, event_type) = 1 as dominant from c join t using (user_id)
""")
def segment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.segment_overlap(_events(spark, sf_dir).withColumn("lesion", F.col("value") > 60), "lesion", "event_type", ["user_id"])


_PANELS = "panels as (select user_id as case_id, event_id, (event_id % 64) / 64.0::double as p, (event_id * 7 % 32) / 64.0::double as n, (event_id * 3 % 16) / 64.0::double as i from events)"


def _panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir).select(F.col("user_id").alias("case_id"), "event_id", ((e % 64) / F.lit(64.0)).alias("p"), ((e * 7 % 32) / F.lit(64.0)).alias("n"), ((e * 3 % 16) / F.lit(64.0)).alias("i"))


@query(f"""
with {_PANELS} select case_id, avg(p) as mean_positive, median(p) as median_positive, max(p) as max_positive, list_avg(list_sort(list(p), 'desc')[1:2]) as top2_mean_positive, avg(p - n) as mean_positive_minus_negative, max(p - n) as max_positive_minus_negative,
  avg((p >= n and p >= i)::int) as positive_vote_fraction, -avg(n) as inverse_mean_negative, -max(n) as inverse_max_negative, avg(i - n) as mean_inconclusive_minus_negative from panels group by 1
""")
def case_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.case_signals(_panels(spark, sf_dir))


@query(f"""
with {_PANELS}, r as (select case_id, event_id as instance, p, row_number() over (partition by case_id order by p desc, event_id) as r, count(*) over (partition by case_id) as k from panels)
select case_id, avg(p) as mean, max(p) as max, avg(p) filter (r <= 2) as top2_mean, avg(p) filter (r <= 3) as top3_mean, list(instance order by r) filter (r <= 2) as top_instances from r group by 1
""")
def instance_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.instance_aggregates(_panels(spark, sf_dir).withColumnRenamed("event_id", "instance"), "p", ["case_id"])


_MASS = "per as (select user_id as case_id, event_type as class, avg(v) as m from (select *, row_number() over (partition by user_id, event_type order by v desc) as r from (select user_id, event_type, (event_id % 64 + 1) / 64.0::double as v from events)) where r <= 2 group by 1, 2), mass as (select case_id, class, m / sum(m) over (partition by case_id) as share from per)"


def _mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("case_id"), F.col("event_type").alias("class"), F.col("event_id").alias("instance"), ((F.col("event_id") % 64 + 1) / F.lit(64.0)).alias("p"))
    return stats.class_mass(rows)


@query(f"with {_MASS} select * from mass")
def class_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mass(spark, sf_dir)


@query(f"""
with {_MASS}, named as (select case_id, sum(share) as named_mass, arg_max(class, [share, -case class when 'click' then 1 else 2 end]) as best, max(share) as top from mass where class in ('click', 'view') group by 1), ids as (select distinct case_id from mass)
select case_id, coalesce(named_mass, 0.0) as named_mass, coalesce(named_mass, 0.0) >= 0.35 as determined, case when named_mass >= 0.35 then best end as subtype, case when named_mass >= 0.35 then top / named_mass end as confidence from ids left join named using (case_id)
""")
def resolved_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.resolved_subtype(_mass(spark, sf_dir), ["click", "view"], 0.35)


_PAIRS = "pairs as (select vec_id as case_id, l as left, r as right, (vec_id * (7 * l::int + r::int) % 32) / 32.0::double as p from embeddings, (values ('0', '1'), ('0', '2'), ('1', '2')) v(l, r))"


@query(f"with {_PAIRS}, votes as (select case_id, class, sum(v) as v from (select case_id, \"left\" as class, 1 - p as v from pairs union all select case_id, \"right\", p from pairs) group by 1, 2) select case_id, class, v / sum(v) over (partition by case_id) as share from votes".replace("as left", 'as "left"').replace("as right", 'as "right"'))
def pairwise_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), (v * (7 * int(a) + int(b)) % 32 / F.lit(32.0)).alias("p")) for a, b in (("0", "1"), ("0", "2"), ("1", "2"))]))
    return stats.pairwise_mass(table(spark, sf_dir, "embeddings").select(v.alias("case_id"), pairs.alias("s")).select("case_id", "s.*"))


@query("""
with p as (select conv_id, turn, text, case turn % 3 when 0 then 'NEGATIVA' when 1 then 'INCONCLUSIVA' else case when conv_id % 2 = 0 then 'POSITIVA' else 'NEGATIVA' end end as state, case (conv_id + turn) % 3 when 0 then 'baixa' when 1 then 'moderada' else 'alta' end as sure from conversations),
r as (select *, case state when 'POSITIVA' then 2 when 'INCONCLUSIVA' then 1 else 0 end as r, case sure when 'baixa' then 0 when 'moderada' then 1 else 2 end as c from p), t as (select conv_id, max(r) as top from r group by 1)
select conv_id, case top when 2 then 'POSITIVA' when 1 then 'INCONCLUSIVA' else 'NEGATIVA' end as state, case min(c) filter (r = top) when 0 then 'baixa' when 1 then 'moderada' else 'alta' end as confidence,
       sha256(string_agg('Painel ' || turn || ': ' || text, ' | ' order by turn)) as summary from r join t using (conv_id) group by conv_id, top
""")
def panel_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = F.col("turn"), F.col("conv_id")
    state = F.when(t % 3 == 0, "NEGATIVA").when(t % 3 == 1, "INCONCLUSIVA").otherwise(F.when(c % 2 == 0, "POSITIVA").otherwise("NEGATIVA"))
    sure = F.when((c + t) % 3 == 0, "baixa").when((c + t) % 3 == 1, "moderada").otherwise("alta")
    rows = table(spark, sf_dir, "conversations").withColumns({"state": state, "sure": sure})
    return stats.precedence_state(rows, "conv_id", "turn", "state", "sure", {"summary": "text"}).withColumn("summary", F.sha2("summary", 256))


@query("select vec_id, exp(abs(embedding[1]::double)) as e1, ln((abs(embedding[1]::double) + 1e-8) / (abs(embedding[2]::double) + 1e-8)) as log_odds, 1 / (1 + exp(-greatest(-35.0, least(35.0, embedding[1]::double * 400)))) as sigmoid, round((exp(embedding[1]::double - greatest(embedding[1]::double, embedding[2]::double, embedding[3]::double)) + exp(embedding[2]::double - greatest(embedding[1]::double, embedding[2]::double, embedding[3]::double))) / (exp(embedding[1]::double - greatest(embedding[1]::double, embedding[2]::double, embedding[3]::double)) + exp(embedding[2]::double - greatest(embedding[1]::double, embedding[2]::double, embedding[3]::double)) + exp(embedding[3]::double - greatest(embedding[1]::double, embedding[2]::double, embedding[3]::double))), 9) as ensemble from embeddings")
def score_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.exp(F.abs(v[0])).alias("e1"), N.log_odds(F.abs(v[0]), F.abs(v[1])).alias("log_odds"), N.sigmoid(v[0] * 400).alias("sigmoid"), F.round(N.prompt_ensemble_probability(F.array(*v), 2), 9).alias("ensemble"))


@query("select doc_id, (n_chars % 40 + 3)::int as n, case when n_chars % 40 + 3 >= 5 then list_transform([0, 1, 2, 3, 4], lambda i: round_even(i * (n_chars % 40 + 2) / 4, 0)::int) end as picked, case when n_chars % 40 + 3 >= 5 then list_transform([0, 1, 2, 3, 4], lambda i: (least(greatest(doc_id % 17 - 2, 0), n_chars % 40 + 3 - 5) + i)::int) end as around from documents")
def slice_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("n_chars") % 40 + 3).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), N.uniform_indices(n, 5).alias("picked"), N.centred_window((F.col("doc_id") % 17).cast("int"), 5, n).alias("around"))


@query("""
with r as (select user_id, count(*) as components, (max(event_id) % 7)::double as euler, min(value) as roughness, max(value) / sum(value) as largest_fraction, bool_or(event_type = 'click') as touches_border, avg((value > 90)::int) as hole_fraction from events group by 1)
select user_id, round((largest_fraction + 1 / greatest(1, components) + 1 / (1 + abs(euler - 1)) + case when roughness > 0 then 1 / roughness else 0.0 end) / 4 - (case when touches_border then 0.15 else 0.0 end + case when hole_fraction > 0.001 then 0.1 else 0.0 end), 9) as score from r
""")
def integrity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("components"), (F.max("event_id") % 7).cast("double").alias("euler"), F.min("value").alias("roughness"), (F.max("value") / F.sum("value")).alias("largest_fraction"), F.bool_or(F.col("event_type") == "click").alias("touches_border"), F.avg((F.col("value") > 90).cast("double")).alias("hole_fraction"))
    return stats.integrity_scores(rows).select("user_id", F.round("score", 9).alias("score"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask for each user: event numbers scattered over a small lattice."""
    e = F.col("event_id")
    return _events(spark, sf_dir).select(F.col("user_id").alias("mask"), (e % 7).cast("int").alias("z"), (e * 3 % 5).cast("int").alias("y"), (e * 5 % 11).cast("int").alias("x")).distinct()


@query("""
with recursive points as (select distinct user_id as mask, (event_id % 7)::int as z, (event_id * 3 % 5)::int as y, (event_id * 5 % 11)::int as x from events),
numbered as (select *, (z * 5 + y) * 11 + x as id from points), edges as (
  select a.mask, a.id as a, b.id as b from numbered a join numbered b on a.mask = b.mask and a.id <> b.id and greatest(abs(a.z - b.z), abs(a.y - b.y), abs(a.x - b.x)) = 1 and abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) <= 2
), reach as (select mask, id as a, id as b from numbered union select r.mask, r.a, e.b from reach r join edges e on r.mask = e.mask and r.b = e.a),
firsts as (select mask, a as id, min(b) as f from reach group by 1, 2), sizes as (select mask, f, count(*) as n, row_number() over (partition by mask order by f) as component from firsts group by 1, 2)
select mask, component, z, y, x from numbered join firsts using (mask, id) join sizes using (mask, f) where n >= 2
""")
def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """18-connected components of every mask, of two points or more."""
    return shapes.connected_components(_points(spark, sf_dir), "mask", 2)


@query()
def component_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape features of every mask from its components."""
    labels = shapes.connected_components(_points(spark, sf_dir), "mask", 4)
    return shapes.shape_features(shapes.component_shapes(labels, ["mask", "component"], (2.0, 1.0, 1.0)), "mask")


@query("""
with p as (select distinct user_id as mask, (event_id % 7)::int as z, (event_id * 3 % 5)::int as y, (event_id * 5 % 11)::int as x from events), c as (select mask, min(z) as z0, min(y) as y0, min(x) as x0 from p group by 1)
select distinct mask, ((z - z0) // 2)::int as bz, ((y - y0) // 2)::int as by, ((x - x0) // 4)::int as bx from p join c using (mask)
""")
def box_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.box_cover(_points(spark, sf_dir), ["mask"], (2, 2, 4))


@query("""
with p as (select p_partkey % 50 + 60.0::double as z, p_partkey % 7 + 0.0::double as y, p_partkey % 11 + 0.0::double as x from part), t as (select (s_suppkey % 4)::int as role, s_suppkey % 13 + 0.0::double as z, s_suppkey % 17 + 0.0::double as y, s_suppkey % 19 + 0.0::double as x from supplier)
select role, min(sqrt(pow(p.z - t.z, 2) + pow(p.y - t.y, 2) + pow(p.x - t.x, 2))) as distance from p, t group by 1
""")
def nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda name, k, add=0.0: (F.col(name) % k + F.lit(add)).cast("double")
    points = table(spark, sf_dir, "part").select(c("p_partkey", 50, 60.0).alias("z"), c("p_partkey", 7).alias("y"), c("p_partkey", 11).alias("x")).distinct()
    targets = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).cast("int").alias("role"), c("s_suppkey", 13).alias("z"), c("s_suppkey", 17).alias("y"), c("s_suppkey", 19).alias("x")).distinct()
    return shapes.nearest_distance(points, targets, 8.0)
