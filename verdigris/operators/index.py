"""A stored BM25 index: chunks checked against their manifest, postings written once by chunk, searches that score every chunk where its postings lie."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import provenance_hash
from ..functions.text import terms as terms_of
from . import retrieval

#: Tag of the form in which an index is stored.
SCHEMA = "verdigris-bm25-2"
#: Fields that a chunk needs to be indexed.
FIELDS = ("doc_id", "title", "section", "text", "sha256", "categories", "priority", "url")


def shared_root(named: str | None, master: str) -> str:
    if not named and not re.match(r"local(\[|$)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or "file:///tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session's machines share, which goes when the driver ends.

    Only a session whose executors are threads of the driver may name none; it gets /tmp/checkpoints.
    Any other is refused, as its executors would not see one another's files.
    """
    path = f"{shared_root(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir(), spark.sparkContext.master)}/verdigris-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to a scratch path and read again: computed once, and no executor's loss costs it."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def manifest_problems(chunks: DataFrame, manifest: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(chunk_id, rule) for what keeps chunks from being loaded: chunks or entries without the other side, repeated ids, hashes that differ (any two of an id's), empty fields.

    Every rule is named once an id. ``manifest_differences`` gives a row for every chunk and entry.
    """
    sides = ((chunks, "__n", "__own"), (manifest, "__m", "__entry"))
    hashed = F.struct("sha256")  # a missing hash takes part in least and greatest
    own, entry = (rows.groupBy("chunk_id").agg(F.count("*").alias(n), F.min(hashed).alias(f"{h}_least"), F.max(hashed).alias(f"{h}_greatest")) for rows, n, h in sides)
    both = own.join(entry, "chunk_id", "full")
    differs = F.least("__own_least", "__entry_least") < F.greatest("__own_greatest", "__entry_greatest")
    rules = {"chunk_missing": F.col("__n").isNull(), "not_in_manifest": F.col("__m").isNull(), "id_repeated": (F.col("__n") > 1) | (F.col("__m") > 1), "hash_differs": differs & F.col("__n").isNotNull() & F.col("__m").isNotNull()}
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    kinds = dict(chunks.dtypes)
    empty = lambda c: F.coalesce(F.size(c) == 0 if kinds[c].startswith("array") else F.col(c).cast("string") == "", F.lit(True))
    lacking = chunks.select("chunk_id", F.explode(F.filter(F.array(*[F.when(empty(c), F.lit(f"no_{c}")) for c in fields]), lambda r: r.isNotNull())).alias("rule")).distinct()
    return both.select("chunk_id", F.explode(found).alias("rule")).union(lacking)


def manifest_differences(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """(chunk_id, rule) for every chunk beside every entry of its id where their hashes differ, and for every hash without the other side.

    Two missing hashes do not differ, nor does one from a side that is missing. Equal hashes of an id are
    joined as one row with their number, so that only pairs that differ are spread out.
    """
    counted = lambda rows, h, n: rows.groupBy("chunk_id", F.col("sha256").alias(h)).agg(F.count("*").alias(n))
    both = counted(chunks, "__own", "__n").join(counted(manifest, "__entry", "__m"), "chunk_id", "full").where(~F.col("__own").eqNullSafe(F.col("__entry")))
    rule = F.when(F.col("__n").isNull(), "chunk_missing").when(F.col("__m").isNull(), "not_in_manifest").otherwise("hash_differs")
    times = lambda n: F.explode(F.array_repeat(F.lit(True), F.coalesce(F.col(n), F.lit(1)).cast("int")))
    return both.select("chunk_id", rule.alias("rule"), "__m", times("__n")).select("chunk_id", "rule", times("__m")).select("chunk_id", "rule")


def loaded(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest's chunks; any problem of ``manifest_problems`` is an error that names some."""
    problems = manifest_problems(chunks, manifest).limit(5).collect()
    if problems:
        raise ValueError(f"chunks and manifest differ: {[tuple(p) for p in problems]}")
    return chunks.join(manifest.select("chunk_id"), "chunk_id", "left_semi")


def hash_problems(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, source_id, title, url, section, categories, text) whose sha256 is not that of their header and text."""
    digest = provenance_hash(*[F.col(c) for c in ("doc_id", "source_id", "title", "url", "section", "categories", "text")])
    return chunks.where(~digest.eqNullSafe(F.col("sha256"))).select("chunk_id", F.lit("hash_wrong").alias("rule"))


#: Rows of (query, term, gain) that every task holds at a time; more of them are searched in blocks of queries.
MOST_GAINS = 200_000


@dataclass
class Index:
    """Postings (key, length, term, tf) in buckets of the key, terms (term, df, idf), and numbers of the whole corpus."""

    postings: DataFrame
    terms: DataFrame
    manifest: DataFrame


def build(chunks: DataFrame, path: str, key: str = "chunk_id", text: str = "text", k1: float = retrieval.K1, b: float = retrieval.B, parts: int | None = None) -> None:
    """Write the index of a corpus: postings, terms and a manifest of one row. An existing folder is an error.

    Texts are tokenized once and their terms dealt to ``parts`` (the shuffle's partitions unless given) by
    the chunk's id, which is the only shuffle of them. All postings of a chunk are in one bucket, so that
    a search scores a chunk where its postings lie.
    """
    spark = chunks.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select(key, terms_of(F.col(text)).alias("__t")).where(F.size("__t") > 0).repartition(parts, key)
    posted = rows.select(key, F.size("__t").alias("length"), F.explode("__t").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    name = f"verdigris_build_{uuid.uuid4().hex}"
    posted.write.bucketBy(parts, key).option("path", f"{path}/postings").saveAsTable(name)
    spark.sql(f"drop table {name}")  # the files stay
    own = spark.read.parquet(f"{path}/postings")
    size = own.select(key, "length").distinct().agg(F.count("*").alias("chunks"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean_length"))
    numbers = size.first()
    terms = retrieval.vocabulary(own, F.lit(numbers["chunks"])).withColumn("df", F.col("df").cast("bigint"))
    terms.write.parquet(f"{path}/terms")
    counts = spark.read.parquet(f"{path}/terms").agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    manifest = counts.select(F.lit(SCHEMA).alias("schema"), F.lit(numbers["chunks"]).alias("chunks"), F.lit(float(numbers["mean_length"])).alias("mean_length"), "terms", "postings", F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"))
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(key, parts)], "key string, parts int").coalesce(1).write.parquet(f"{path}/layout")


def load(spark: SparkSession, path: str) -> Index:
    """A stored index; another form than this one's is an error. Its postings are known to the session as a bucketed table of a name that follows from the path."""
    manifest = spark.read.parquet(f"{path}/manifest")
    form = manifest.first()["schema"]
    if form != SCHEMA:
        raise ValueError(f"an index of the form {form!r}, not {SCHEMA!r}")
    layout = spark.read.parquet(f"{path}/layout").first()
    fields = ", ".join(f"`{n}` {kind}" for n, kind in spark.read.parquet(f"{path}/postings").dtypes)
    name = f"verdigris_index_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    spark.sql(f"create table if not exists {name} ({fields}) using parquet clustered by (`{layout['key']}`) into {layout['parts']} buckets location '{path}/postings'")
    return Index(spark.table(name), spark.read.parquet(f"{path}/terms"), manifest)


def search(index: Index, queries: DataFrame, top_k: int = 5, key: str = "chunk_id", query_key: str = "query_id", query_text: str = "query") -> DataFrame:
    """The ``top_k`` chunks of every query, as ``retrieval.search`` gives them, from a stored index.

    The gains of the asked terms go to all buckets; each bucket adds up its own chunks' scores and
    keeps ``top_k`` a query, and only those are shuffled. Queries with more than ``MOST_GAINS``
    different terms in all are searched in blocks.
    """
    numbers = index.manifest.first()
    asked = retrieval.asked_terms(queries, query_key, query_text)
    gains = stored(asked.join(index.terms, "term").select(query_key, "term", (F.col("weight") * F.col("idf")).alias("gain")), "bm25-gains")
    blocks = max(1, -(-gains.count() // MOST_GAINS))
    out = None
    for k in range(blocks):
        own = gains if blocks == 1 else gains.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == k)
        hits = index.postings.join(F.broadcast(own), "term")  # a bounded block
        found = retrieval.ranked(hits, numbers["mean_length"], top_k, key, query_key, numbers["k1"], numbers["b"])
        out = found if out is None else out.unionByName(found)
    return out
