"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hex_crc32, table
from .decontaminate import contamination
from .lexical import ranked_search
from .lmscore import scored
from .neardup import near_duplicates
from .packing import packed
from .pii import pseudonymized
from .resampling import resampled
from .secretscan import BASE, secrets
from .sharding import sharded
from .tokencounts import section_tokens
from .topk import top_products
from .toxicity import toxicity
from .urlfilter import judged_urls

#: For these queries only; whoever runs the operator brings a secret one.
PSEUDONYM_KEY = "demonstration key"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op4_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line's end counts for the line that has most of it."""
    return section_tokens(table(spark, sf_dir, "documents")).withColumn("n_tokens", F.col("n_tokens").cast("bigint"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text, the number of replaced values, and their kinds and pseudonyms in order."""
    found = pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    names = lambda part: F.array_join(F.transform("findings", lambda f: f[part]), "\n")
    return found.select("doc_id", "text", F.size("findings").cast("bigint").alias("n_values"), names("kind").alias("kinds"), names("pseudonym").alias("pseudonyms"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the label row of the same number: quality 0 is a bad outcome."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    return judged_urls(table(spark, sf_dir, "pages"), outcomes)


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.pmod(hex_crc32(F.col("doc_id")), F.lit(5)) == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_neardup, op3_topk, op4_tokencounts, op5_pii, op6_urlfilter, op7_lmscore, op8_pack, op9_shard, op10_toxicity, op11_search, op12_secrets, op13_resample)}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
with words as (
  select doc_id, coalesce(regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), items as (
  select item_id::varchar as item, coalesce(regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark where item_id is not null
), windows as (
  select distinct item, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as gram
  from items, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as s(i) where len(w) > 0
), sizes as (select distinct size from windows), places as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as gram
  from words, sizes, unnest(generate_series(1, len(w) - size + 1)) as s(i) where len(w) >= size
), hits as (select doc_id, i, size, item from places join windows using (size, gram)),
covered as (select doc_id, count(distinct p) as n from (select distinct doc_id, i, size from hits), unnest(generate_series(i, i + size - 1)) as s(p) group by 1),
found as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as ids from hits group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(f.n, 0)::bigint as n_items,
       sha256(coalesce(f.ids, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from words left join covered c using (doc_id) left join found f using (doc_id)
"""

OP2_SQL = rf"""
with recursive words as (
  select doc_id, coalesce(regexp_extract_all({_FOLD.format("text")}, '[^\x20\x09-\x0D]+'), []) as w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') as s
  from words, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) as g(i) where len(w) > 0
), sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
least_id as (select a as doc_id, min(b) as low from reach group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id, doc_id = least(doc_id, coalesce(low, doc_id)) as kept
from words left join sizes using (doc_id) left join least_id using (doc_id)
"""

OP3_SQL = """
with good as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score
  from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores) where rank <= 5
"""

OP6_SQL = r"""
with urls as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages
), sites as (
  select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as site from urls
), parts as (select *, string_split(site, '.') as p from sites),
named as (
  select *, array_to_string(p[-2:], '.') as two,
         array_to_string(p[-2:], '.') in ('ac.uk', 'co.in', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.ar', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'net.au', 'org.au', 'org.uk') as long
  from parts
), placed as (
  select *, case when regexp_matches(site, '^[0-9.]+$') then site when long then array_to_string(p[-3:], '.') else two end as domain,
         case when long then two else p[-1] end as suffix from named
), outcomes as (select doc_id as id, case when quality = 0 then 1 else 0 end as bad from labels where quality is not null and doc_id is not null),
hosts as (
  select site, any_value(domain) as domain, any_value(suffix) as suffix, count(bad) as n, coalesce(sum(bad), 0) as bad
  from placed left join outcomes on page_id = id where site <> '' group by site
), whole as (select (sum(bad) + 0.05) / (sum(n) + 1)::double as m from hosts),
suffixes as (select suffix, sum(n)::double as n, sum(bad)::double as bad, any_value(m) as prior from hosts, whole group by suffix),
w1 as (
  select 1 / least(0.5, greatest(0.001, case when count(*) < 2 or sum(n) - sum(n * n) / sum(n) - (count(*) - 1) <= 0 then 0.001
    else (sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) - (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) end)) - 1 as w from suffixes where n > 0
), s2 as (select suffix, (w * prior + bad) / (w + n) as mean from suffixes, w1),
domains as (select domain, sum(n)::double as n, sum(bad)::double as bad, any_value(mean) as prior from hosts join s2 using (suffix) group by domain, suffix),
w2 as (
  select 1 / least(0.5, greatest(0.001, case when count(*) < 2 or sum(n) - sum(n * n) / sum(n) - (count(*) - 1) <= 0 then 0.001
    else (sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) - (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) end)) - 1 as w from domains where n > 0
), d2 as (select domain, (w * prior + bad) / (w + n) as mean from domains, w2),
own as (select site, n::double as n, bad::double as bad, mean as prior from hosts join d2 using (domain)),
w3 as (
  select 1 / least(0.5, greatest(0.001, case when count(*) < 2 or sum(n) - sum(n * n) / sum(n) - (count(*) - 1) <= 0 then 0.001
    else (sum(n * pow(bad / n - prior, 2) / (prior * (1 - prior))) - (count(*) - 1)) / (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) end)) - 1 as w from own where n > 0
), beta as (select site, w * prior + bad as a, w * (1 - prior) + n - bad as b from own, w3),
blocked as (select site from beta where a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.25),
ruled as (
  select page_id, host, path, site, case
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from placed
)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when site in (select site from blocked) then 'block' else 'allow' end as verdict
from ruled
"""

OP11_SQL = rf"""
with texts as (
  select doc_id, row_number() over () as id, unnest(regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
), counted as (select id, doc_id, term, count(*) as tf from texts group by all),
lengths as (select id, sum(tf)::bigint as n from counted group by 1),
sums as (select count(*)::bigint as docs, sum(n)::bigint as terms from lengths),
asked as (
  select item_id, term, count(*) as times
  from (select item_id, unnest(regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all
), weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from counted, sums where term in (select term from asked) group by term, docs),
gains as (
  select id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))) as gain
  from counted join lengths using (id) join weights using (term), sums
), scored as (select item_id, id, doc_id, sum(times * gain)::bigint as score from asked join gains using (term) group by all)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 20
"""

OP13_SQL = rf"""
with polynomial as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, range(8)), lambda c, _: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t
), words as (
  select doc_id, coalesce(regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w, row_number() over () as id from documents
), asked as (
  select unnest(regexp_extract_all({_FOLD.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark
), tokens as (select id, unnest(w) as word from words),
hexes as (select word, hex(encode(word)) as h from (select word from tokens union select word from asked)),
bytes as (select word, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint) as b from hexes),
buckets as (
  select word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, polynomial
), placed as (select id, bucket from tokens join buckets using (word)),
own as (select bucket, count(*) as s from placed group by 1), wanted as (select bucket, count(*) as t from asked join buckets using (word) group by 1),
sums as (select (select coalesce(sum(s), 0) from own)::double as big_s, (select coalesce(sum(t), 0) from wanted)::double as big_t),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + 10000) / ((coalesce(s, 0) + 1) * (big_t + 10000))))::bigint as gain
  from (select distinct bucket from buckets) left join own using (bucket) left join wanted using (bucket), sums
), weights as (select id, floor(sum(gain) / count(*))::bigint as weight from placed join gains using (bucket) group by 1),
scored as (
  select doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id::varchar)[1:8])::bigint + 0.5) / 4294967296)))::bigint as score
  from words left join weights using (id)
), placed_in as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id, n_features) as place, floor(10 * count(*) over (partition by n_features >= 20) / 100) as drawn from scored
)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= drawn then place end::bigint as rank from placed_in
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_neardup": OP2_SQL, "op3_topk": OP3_SQL, "op6_urlfilter": OP6_SQL, "op11_search": OP11_SQL, "op13_resample": OP13_SQL}
