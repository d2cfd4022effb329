"""Ranked lexical search: compressed postings by shard, document-at-a-time merge with a bounded heap, one merge of all shards' heaps.

A shard is a block of documents that a task read together, in order of doc_id; its postings are
gaps between places in that order, and counts, both as variable-length bytes. The index has one row
for each shard and term, so that a search reads only the terms it asks for and brings a shard's
together in one task. There a heap merges a query's postings by place; lists that cannot lift a
document over the worst one kept are only looked into for the documents that others bring.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_offsets, discard, lean_memory, map_arrow, materialize, small_batches
from .decontaminate import words_of

#: Bytes of text of a shard, about; one document is never cut.
SHARD_BYTES = 8 << 20
#: Bytes of query text that workers hold at a time; more queries take more passes over the index.
QUERY_BYTES = 4 << 20
#: Parts of a document's length in its score.
LENGTH_BASE, LENGTH_SHARE = 75, 25
INDEX = "shard bigint, term binary, docs bigint, tokens bigint, postings binary"
FOUND = "query bigint, doc_id bigint, score bigint"


def varint(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers from 0 in groups of seven bits, the lowest first, the eighth bit on all but the last; and where each one begins."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1) << np.uint64(7 * k)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(begins[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        have = sizes > k
        part = (values[have] >> np.uint64(7 * k)) & np.uint64(127)
        out[begins[:-1][have] + k] = part.astype(np.uint8) | (128 * (sizes[have] > k + 1)).astype(np.uint8)
    return out.tobytes(), begins


def unvarint(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    sizes = ends - begins + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(sizes.max(initial=0))):
        have = sizes > k
        out[have] |= (raw[begins[have] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out.astype(np.int64)


def _zigzag(values: np.ndarray) -> np.ndarray:
    return (values << 1) ^ (values >> 63)


def _unzigzag(values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.uint64)
    return ((wide >> np.uint64(1)) ^ (np.uint64(0) - (wide & np.uint64(1)))).astype(np.int64)


class _Block:
    """Documents on their way to be a shard: ids, numbers of terms, and the terms' numbers one after the other."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.terms: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = words_of(text)
        if words:
            known = self.terms
            self.ids.append(doc_id)
            self.parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        self.size += len(text)

    def rows(self, shard: int) -> pa.RecordBatch:
        """The shard's documents as a row without a term, then a row for each term in its order."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        lengths = np.array([len(self.parts[i]) for i in order], np.int64)
        ids = np.array([self.ids[i] or 0 for i in order], np.int64)
        nulls = sum(i is None for i in self.ids)
        names = sorted(self.terms)
        place = np.empty(len(names), np.int64)
        place[[self.terms[n] for n in names]] = np.arange(len(names))
        n = len(order)
        at = np.concatenate([place[self.parts[i]] * n + k for k, i in enumerate(order)])
        self.parts = []
        keys, counts = np.unique(at, return_counts=True)
        term, doc = keys // n, keys % n
        first = np.concatenate(([True], term[1:] != term[:-1]))
        gaps = np.where(first, doc, doc - np.concatenate(([0], doc[:-1])))
        data, begins = varint(np.column_stack([gaps, counts]).ravel())
        edges = np.append(np.flatnonzero(first), len(term))
        with np.errstate(over="ignore"):  # gaps of ids wrap around as they do when they are added up again
            head = varint(np.concatenate(([nulls], np.column_stack([_zigzag(np.diff(ids, prepend=0)), lengths]).ravel())))[0]
        blobs = [head, *(data[begins[2 * a] : begins[2 * b]] for a, b in zip(edges[:-1], edges[1:], strict=True))]
        docs = np.concatenate(([n], np.diff(edges)))
        tokens = np.concatenate(([lengths.sum()], np.add.reduceat(counts, edges[:-1])))
        columns = [pa.array(np.full(len(blobs), shard)), pa.array([None, *names], pa.binary()), pa.array(docs), pa.array(tokens), pa.array(blobs, pa.binary())]
        return pa.record_batch(columns, names=["shard", "term", "docs", "tokens", "postings"])


def shard_rows(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, text): a row for each shard and term with its documents, occurrences and postings; without a term, those of the whole shard and its documents' ids and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        shard, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            data, offsets = binary_offsets(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                if block.ids and block.size + b - a > shard_bytes:
                    yield from _slices(block.rows(shard))
                    shard, block = shard + 1, _Block()
                block.add(doc_id, data[a:b].tobytes())
        if block.ids:
            yield from _slices(block.rows(shard))

    base = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_arrow(base, run, INDEX)


def _slices(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def build_index(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the index of ``docs`` under a new path and open it. Documents are read once and not shuffled."""
    shard_rows(docs, shard_bytes).write.parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


class Found:
    """The best documents of a query: a heap with the worst one on top, by score, then by doc_id (null ids last)."""

    def __init__(self, most: int) -> None:
        self.most, self.heap, self.floor = most, [], 0

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.most:
            heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapreplace(self.heap, entry)
        else:
            return
        if len(self.heap) == self.most:
            self.floor = self.heap[0][0]

    def rows(self) -> list[tuple[int | None, int]]:
        return [(-back if known else None, score) for score, known, back in self.heap]


class Shard:
    """A shard's documents, and the asked terms' postings, as places and gains without the term's weight."""

    def __init__(self, head: bytes, documents: int, terms: int) -> None:
        numbers = unvarint(head)
        with np.errstate(over="ignore"):
            ids = np.cumsum(_unzigzag(numbers[1::2]))
        known = len(ids) - int(numbers[0])
        self.ids: list[int | None] = ids[:known].tolist() + [None] * int(numbers[0])
        self.norms = 100 - LENGTH_SHARE + (LENGTH_SHARE * numbers[2::2] * documents) // terms
        self.lists: dict[bytes, tuple[list[int], list[int], int]] = {}

    def add(self, term: bytes, postings: bytes) -> None:
        numbers = unvarint(postings)
        places, tf = np.cumsum(numbers[::2]), numbers[1::2]
        gains = (1_000_000_000 * tf) // (1000 * tf + 12 * self.norms[places])
        self.lists[term] = (places.tolist(), gains.tolist(), int(gains.max()))

    def search(self, query: list[tuple[bytes, int]], found: Found) -> None:
        """Offers the query's (term, weight) best documents, document by document.

        ``bounds[i]`` is what the lists from i on can give together. While it is under the heap's
        worst score for an i, lists from there on bring no document into the merge any more; they
        are searched for those that the others bring, as long as these can still get over it.
        """
        lists = sorted(((*self.lists[term], weight) for term, weight in query if term in self.lists and weight > 0), key=lambda x: -x[2] * x[3])
        bounds = [0]
        for _, _, most, weight in reversed(lists):
            bounds.append(bounds[-1] + most * weight)
        bounds.reverse()
        merged, at = len(lists), [0] * len(lists)
        while merged and bounds[merged - 1] < found.floor:
            merged -= 1
        heap = [(lists[i][0][0], i) for i in range(merged)]
        heapify(heap)
        while heap:
            place = heap[0][0]
            score = 0
            while heap and heap[0][0] == place:
                i = heap[0][1]
                places, gains, _, weight = lists[i]
                score += gains[at[i]] * weight
                at[i] += 1
                if at[i] < len(places):
                    heapreplace(heap, (places[at[i]], i))
                else:
                    heappop(heap)
            for i in range(merged, len(lists)):
                if score + bounds[i] < found.floor:
                    break
                places, gains, _, weight = lists[i]
                at[i] = bisect_left(places, place, at[i])
                if at[i] < len(places) and places[at[i]] == place:
                    score += gains[at[i]] * weight
            else:
                if score >= found.floor and score > 0:
                    found.offer(score, self.ids[place])
                    fewer = merged
                    while fewer and bounds[fewer - 1] < found.floor:
                        fewer -= 1
                    if fewer < merged:
                        merged = fewer
                        heap = [entry for entry in heap if entry[1] < merged]
                        heapify(heap)


def _asked(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(key, terms, size): a query's distinct texts' terms with repeats, of all rows that share an id; queries without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_offsets(batch.column(1))
            words = [words_of(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.list_(pa.binary()))], names=["key", "terms"])

    base = queries.select(F.col(query_id).alias("key"), F.col(text).cast("binary").alias("text"))
    return base.mapInArrow(run, f"key {queries.schema[query_id].dataType.simpleString()}, terms array<binary>").select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("times"))


def _weights(spark, index: DataFrame, asked: DataFrame, documents: int) -> dict[bytes, int]:
    """The weight of each asked term that a document has; one block's terms, so their number is bounded."""
    known = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("df")).collect()
    return {bytes(r["term"]): math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1))) for r in known}


def _searcher(shared: Broadcast, most: int):
    """Searches the shards of a partition (rows by shard, the one without a term first), keeping each query's heap from one shard to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        queries, documents, terms = shared.value
        heaps = [Found(most) for _ in queries]
        shard: Shard | None = None

        def searched() -> None:
            if shard is not None:
                for query, found in zip(queries, heaps, strict=True):
                    shard.search(query, found)

        for batch in batches:
            for term, postings in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if term is None:
                    searched()
                    shard = Shard(postings, documents, terms)
                else:
                    shard.add(term, postings)
        searched()
        rows = [(i, *row) for i, found in enumerate(heaps) for row in found.rows()]
        yield pa.record_batch([pa.array(list(map(itemgetter(k), rows)), pa.int64()) for k in range(3)], names=["query", "doc_id", "score"])

    return run


def search_index(index: DataFrame, queries: DataFrame, top_k: int = 20, query_id: str = "item_id", text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score) of each query's ``top_k`` documents with a score above 0; equal scores by ascending doc_id, null ids last.

    Queries go to the workers in blocks of about ``query_bytes`` of text, each block reading its own
    terms' postings once; so any number of queries is searched. Cases: see ``ranked_search``.
    """
    spark = index.sparkSession
    whole = index.where("term is null").agg(F.sum("docs").alias("n"), F.sum("tokens").alias("l")).first()
    kind = queries.schema[query_id].dataType.simpleString()
    empty = spark.createDataFrame([], f"`{query_id}` {kind}, rank int, doc_id bigint, score bigint")
    if not whole["n"]:
        return empty
    asked = materialize(_asked(queries, query_id, text), "lexical-asked")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("b")).first()["b"]
    count = -(-size // query_bytes)
    parts = []
    for k in range(count):
        block = asked.where(F.pmod(F.xxhash64("key"), F.lit(count)) == k)
        weights = _weights(spark, index, block, whole["n"])
        wanted: dict[object, list[tuple[bytes, int]]] = {}
        for row in block.collect():
            if weight := weights.get(bytes(row["term"]), 0):
                wanted.setdefault(row["key"], []).append((bytes(row["term"]), weight * row["times"]))
        if not wanted:
            continue
        keys = list(wanted)
        shared = spark.sparkContext.broadcast(([wanted[q] for q in keys], whole["n"], whole["l"]))
        read = index.join(block.select("term").distinct(), "term", "left_semi").unionByName(index.where("term is null")).select("shard", "term", "postings")
        held = read.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        best = map_arrow(held, _searcher(shared, top_k), FOUND)
        place = F.row_number().over(Window.partitionBy("query").orderBy(*_order()))
        best = best.withColumn("rank", place).where(F.col("rank") <= top_k)
        names = spark.createDataFrame(list(enumerate(keys)), f"query bigint, `{query_id}` {kind}")
        parts.append(materialize(best.join(F.broadcast(names), "query").select(query_id, "rank", "doc_id", "score"), "lexical-found"))  # a block's queries
    discard(asked)
    out = empty
    for part in parts:
        out = part if out is empty else out.unionByName(part)
    return out


def _order() -> list[Column]:
    return [F.desc("score"), F.col("doc_id").asc_nulls_last()]


def ranked_search(docs: DataFrame, queries: DataFrame, top_k: int = 20, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """The ``top_k`` documents (doc_id, text) of every query (``query_id``, ``text``): query_id, rank from 1, doc_id and score, in whole numbers.

    Terms are runs of ASCII letters or digits and of all other characters, A-Z lower-cased. A term's
    weight falls with the documents that hold it, its gain grows with its occurrences and falls
    with the document's length; a query's term counts as often as the query has it.

    The index is built, searched and deleted; ``build_index`` keeps one. Other columns are not read.

    Cases: null and empty texts have no terms, are in no count and never found; rows that repeat a
    doc_id are documents of their own, so that an id can be found twice; null doc_ids take part and
    come last among equal scores; rows that share a query_id are one query with all their terms; a
    query without a known term has no rows; empty tables give no rows.
    """
    index = materialize(shard_rows(docs), "lexical-index")
    out = search_index(index, queries, top_k, query_id, text)
    discard(index)
    return out
