"""Queries of the text and retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, retrieval
from .base import query, table

#: RE2 knows letters and digits of all scripts only by their classes.
_TERM = r"[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*"


def _terms(column: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({column}, ''), '{_TERM}'), lambda x: lower(x))"



@query(r"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from documents
""")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query(r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_\p{M}]+(?:[-''][\p{L}\p{N}_\p{M}]+)*|[^\p{L}\p{N}_\p{M}\s]')) as tokens from documents")
def chunk_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).cast("bigint").alias("tokens"))


@query(f"select doc_id, len(t) as terms, len(list_distinct(t)) as distinct_terms, sha256(array_to_string(t, ' ')) as digest from (select doc_id, {_terms('text')} as t from documents)")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.terms(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("terms"), F.size(F.array_distinct("t")).cast("bigint").alias("distinct_terms"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query(r"""
with t as (select doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_\p{M}]+(?:[-''][\p{L}\p{N}_\p{M}]+)*|[^\p{L}\p{N}_\p{M}\s]') as tokens from documents),
k as (select doc_id, tokens, unnest(generate_series(0, ceil(greatest(len(tokens) - 200, 0) / 160)::int)) as k, text from t)
select doc_id, k::int as window_number, sha256(case when len(tokens) <= 200 then text else array_to_string(tokens[k * 160 + 1:k * 160 + 200], ' ') end) as digest from k
""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 tokens that overlap by 40."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.token_windows(F.col("text"), 200, 40)).alias("window_number", "w"))
    return rows.select("doc_id", "window_number", F.sha2("w", 256).alias("digest"))


@query(r"""
select doc_id, case when length(t) <= 80 then t else rtrim(substr(t, 1, 79)) || '…' end as clipped from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents)
""")
def clipped_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clip(F.col("text"), 80).alias("clipped"))


@query(r"""
select page_id, case when n = '' then 'source' else n end as name from (select page_id, regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.:-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') as n from pages)
""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("""
select doc_id, substr(sha256(encode(lang) || '\\x00'::blob || encode(doc_id::varchar)), 1, 16) as case_id, 'anon-' || substr(sha256(encode('cohort') || '\\x00'::blob || encode(lang) || '\\x00'::blob || encode(source)), 1, 20) as subject_id from documents
""")
def anonymous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.short_hash(F.col("lang"), F.col("doc_id").cast("string"), length=16).alias("case_id"), F.concat(F.lit("anon-"), T.short_hash(F.lit("cohort"), F.col("lang"), F.col("source"), length=20)).alias("subject_id"))


@query("""
select doc_id, sha256('doc_id:' || doc_id || chr(10) || 'source_id:' || source || chr(10) || 'title:' || lang || '-' || doc_id || chr(10) || 'url:None' || chr(10) || 'section:Document' || chr(10) || 'categories:' || lang || ',' || source || chr(10) || chr(10) || text) as digest from documents
""")
def chunk_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = T.provenance_hash(F.col("doc_id"), F.col("source"), F.concat_ws("-", "lang", "doc_id"), F.lit(None), F.lit("Document"), F.array("lang", "source"), F.col("text"))
    return docs.select("doc_id", digest.alias("digest"))


@query(f"with t as (select doc_id, unnest({_terms('text')}) as term from documents) select doc_id, term, count(*) as tf from t group by 1, 2")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.postings(table(spark, sf_dir, "documents"), "doc_id")


@query(f"with t as (select distinct doc_id, unnest({_terms('text')}) as term from documents), n as (select count(distinct doc_id) as n from t), df as (select term, count(*) as df from t group by 1) select term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from df, n")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.where(F.col("text").rlike(T.TERM)).count()  # up to the first term, which is all that it takes
    return retrieval.vocabulary(retrieval.postings(docs, "doc_id"), F.lit(n))


def _search(where: str = "", extra: str = "") -> str:
    return f"""
q as (select item_id, term, count(*) as weight from (select item_id, unnest({_terms('text')}) as term from benchmark) group by 1, 2),
tokens as (select doc_id, unnest({_terms('text')}) as term from documents), lens as (select doc_id, count(*) as length from tokens group by 1), stats as (select count(*) as n, sum(length) / count(*) as mean from lens),
post as (select doc_id, term, count(*) as tf from tokens where term in (select term from q) group by 1, 2), df as (select term, count(*) as df from post group by 1),
parts as (
  select q.item_id, p.doc_id, p.term, weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * (length / mean)))) as x
  from q join post p using (term) join df using (term) join lens using (doc_id), stats {extra} {where}),
scored as (select item_id, doc_id, list_sum(list(x order by term)) as score from parts group by 1, 2),
ranked as (select *, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from scored), results as (select item_id, rank::int as rank, doc_id, round(score, 9) as score from ranked where rank <= 5)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5, "doc_id", query_key="item_id", query_text="text").withColumn("score", F.round("score", 9))


@query(f"with {_search()} select * from results")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every benchmark passage."""
    return _results(spark, sf_dir)


@query(f"with {_search('where d.lang = b.wanted', 'join documents d on d.doc_id = p.doc_id join (select item_id, case item_id % 4 when 0 then chr(101) || chr(110) when 1 then chr(102) || chr(114) when 2 then chr(100) || chr(101) else chr(101) || chr(115) end as wanted from benchmark) b on b.item_id = q.item_id')} select * from results".replace("from q join post p using (term) join df using (term) join lens using (doc_id), stats join", "from q join post p on q.term = p.term join df on df.term = p.term join lens on lens.doc_id = p.doc_id cross join stats join"))
def bm25_search_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among documents of one language a query; frequencies stay those of the whole corpus."""
    four = F.col("item_id") % 4
    asked = table(spark, sf_dir, "benchmark").withColumn("wanted", F.array(F.when(four == 0, "en").when(four == 1, "fr").when(four == 2, "de").otherwise("es")))
    docs = table(spark, sf_dir, "documents").withColumn("categories", F.array("lang"))
    return retrieval.search(docs, asked, 5, "doc_id", query_key="item_id", query_text="text", categories="categories", wanted="wanted").withColumn("score", F.round("score", 9))


_EVALUATED = f"""{_search()},
asked as (select item_id, 'src' || (item_id % 20) as cat, item_id * 7 as doc, ({_terms('text')})[1:2] as expected_terms from benchmark),
hits as (select a.item_id, r.rank, d.source = a.cat as c, r.doc_id = a.doc as d, len(list_intersect(a.expected_terms, {_terms('d.text')})) > 0 as t from asked a left join results r using (item_id) left join documents d on d.doc_id = r.doc_id),
evaluated as (select item_id, count(rank) as result_count, min(rank) filter (c) as category_rank, min(rank) filter (d) as doc_rank, coalesce(bool_or(t), false) as terms_hit from hits group by 1)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.terms(F.col("text"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.array(F.concat(F.lit("src"), F.col("item_id") % 20)).alias("expected_categories"), F.array(F.col("item_id") * 7).alias("expected_doc_ids"), F.slice(found, 1, 2).alias("expected_terms"), F.lit(False).alias("require_doc"))
    docs = table(spark, sf_dir, "documents").withColumn("categories", F.array("source"))
    return retrieval.evaluate(_results(spark, sf_dir), asked, docs, "doc_id", "doc_id", query_key="item_id")


@query(f"with {_EVALUATED} select item_id, result_count, category_rank, doc_rank, terms_hit, result_count > 0 and category_rank is not null and terms_hit as passed from evaluated")
def retrieval_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir).select("item_id", "result_count", "category_rank", "doc_rank", "terms_hit", "passed")


@query(f"""
with {_EVALUATED}, p as (select *, result_count > 0 and category_rank is not null and terms_hit as passed from evaluated), s as (
  select count(*) as query_count, count(*) filter (passed) as passed_count, count(*) filter (category_rank is not null) as category_hit_count, count(*) filter (doc_rank is not null) as doc_hit_count,
         count(*) filter (terms_hit) as terms_hit_count, count(*) filter (result_count = 0) as empty_result_count, coalesce(sum(1 / category_rank), 0.0) as c, coalesce(sum(1 / doc_rank), 0.0) as d from p)
select * exclude (c, d), passed_count / query_count as pass_rate, category_hit_count / query_count as category_hit_rate, doc_hit_count / query_count as doc_hit_rate, terms_hit_count / query_count as terms_hit_rate,
       c / query_count as category_mrr, d / query_count as doc_mrr, passed_count / query_count >= 0.85 and category_hit_count / query_count >= 0.85 and empty_result_count <= 0 as accepted from s
""")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.summary(_evaluated(spark, sf_dir))


_CONTEXT = f"""{_search()}, firsts as (select doc_id, min_by(score, [item_id, rank]) as score, min([item_id, rank]) as o from results where score >= 1.0 group by 1),
numbered as (select *, row_number() over (order by o) as n from firsts), sources as (select 'S' || n as source_id, n, doc_id, score, case when length(t) <= 120 then t else rtrim(substr(t, 1, 119)) || '…' end as excerpt
  from numbered join (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents) using (doc_id) where n <= 12)"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.context(_results(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumn("position", F.col("item_id")), table(spark, sf_dir, "documents"), 12, 120, 1.0, "doc_id", query_key="item_id")


@query(f"with {_CONTEXT} select source_id, doc_id, score, excerpt from sources")
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir)


@query(f"with {_CONTEXT} select a as addendum, length(a)::int as characters, sha256(a) as sha256 from (select string_agg('[' || source_id || '] ' || doc_id || chr(10) || excerpt, chr(10) || chr(10) order by n) as a from sources)")
def prompt_addendum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.prompt_addendum(_context(spark, sf_dir), "doc_id")


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of every page."""
    return chunking.to_markdown(table(spark, sf_dir, "pages"))


@query()
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and chunks of every page's Markdown, with provenance hashes."""
    pages = table(spark, sf_dir, "pages")
    chunks = chunking.chunk(chunking.to_markdown(pages), "page_id", "markdown", 120, 20)
    sources = pages.select("page_id", F.concat(F.lit("page-"), F.col("page_id")).alias("source_id"), F.col("url").alias("title"), "url", F.array(F.lit("page")).alias("categories"))
    return chunking.with_provenance(chunks, sources, "page_id").select("page_id", "chunk_id", "section", "text", "token_count", "sha256")


@query("select lang as category, count(*) as chunks from documents group by 1 union all select source, count(*) from documents group by 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(F.array("lang", "source")).alias("category")).groupBy("category").agg(F.count("*").alias("chunks"))
