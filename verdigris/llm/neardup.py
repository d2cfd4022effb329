"""MinHash near-duplicate groups by min-max hashing, with every link confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, blocks, discard, free_name, materialize, sized, small_batches
from .components import components
from .neardup_sets import MinMax, distinct, set_key, shingles, word_hashes

#: Rows of one comparison block; a block is all that a task holds of a bucket.
BLOCK_ROWS = 512
#: Buckets of more rows bring full sets into their blocks.
SMALL_BUCKET = 32
#: Permutations of the sketches that tell which pairs of a bucket are worth a comparison on full sets.
SKETCH_PERMUTATIONS = 256
#: Standard errors below the threshold that a sketch's estimate may lie.
SKETCH_ERRORS = 6.0


def _signed(width: int, permutations: int, rows: int):
    spec = "doc_id bigint, text_key bigint, n_shingles bigint, key binary, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, minmax = arrow_schema(spec), MinMax(permutations, rows)
        for batch, data, offsets in blocks(batches, 1):
            hashes, begin = shingles(*word_hashes(data, offsets), width)
            own = distinct(hashes, begin)
            some = np.flatnonzero(np.diff(begin) > 0)
            bands = np.zeros((len(own), minmax.bands), dtype=np.uint64)
            if len(some):
                bands[some] = minmax.band_hashes(minmax.sign(hashes, np.append(begin[some], begin[-1])))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.where(np.diff(begin) > 0, minmax.bands, 0)))).astype(np.int32))
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array([len(x) for x in own], pa.int64()), pa.array([set_key(x) for x in own], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(bands[some].ravel().view(np.int64)))],
                schema=schema,
            )

    return run, spec


def _full_sets(width: int):
    spec = "node bigint, size bigint, members array<bigint>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, minmax = arrow_schema(spec), MinMax(SKETCH_PERMUTATIONS, 4, seed=77)
        for batch, data, offsets in blocks(batches, 1):
            hashes, begin = shingles(*word_hashes(data, offsets), width)
            own = distinct(hashes, begin)
            keep = [i for i, key in enumerate(batch.column(2).to_pylist()) if len(own[i]) and set_key(own[i]) == key]
            if not keep:
                continue
            kept = [own[i] for i in keep]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in kept])))
            flat = np.concatenate(kept)
            sketches = minmax.sketch(minmax.sign(flat, ends))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(keep)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64))), pa.array([x.tobytes() for x in sketches], pa.binary())],
                schema=schema,
            )

    return run, spec


def _links_within(sets: list[np.ndarray], i: int, j: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Which of the sets j have whole * intersection >= part * union with set i."""
    flat = np.concatenate([sets[k] for k in j])
    sizes = np.array([len(sets[k]) for k in j])
    own = sets[i]
    found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    both = np.add.reduceat(found.astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return whole * both >= part * (len(own) + sizes - both)


def _close_pairs(part: int, whole: int):
    """Pairs of a block that are of different components and close by their sketches.

    In a block of a small bucket they come out unconfirmed. A block of a large bucket brings the
    full sets; there each pair is compared in the first bucket that it shares, confirmed at once,
    and comes out only if it joins what no earlier pair of the block has joined, so that a block
    gives no more pairs than it has rows.
    """
    spec = "a bigint, b bigint, confirmed boolean"
    length = 2 * SKETCH_PERMUTATIONS
    share = part / whole
    least = (share - SKETCH_ERRORS * np.sqrt(share * (1 - share) / length)) * length

    def of_block(bucket, one: bool, chunk, node, component, size, sketch, bands, sets):
        order = np.argsort(size, kind="stable")
        chunk, node, component, size, sketch = chunk[order], node[order], component[order].copy(), size[order], sketch[order]
        bands, sets = (None, None) if bands is None else (bands[order], [sets[k] for k in order])
        last = np.searchsorted(size, size * whole // part, "right")
        for i in range(len(node) - 1):
            j = np.arange(i + 1, last[i])
            j = j[component[j] != component[i]]
            if not one:
                j = j[chunk[j] != chunk[i]]
            if len(j):
                j = j[(sketch[j] == sketch[i]).sum(axis=1) >= least]
            if not len(j):
                continue
            if sets is None:
                yield np.full(len(j), node[i]), node[j]
                continue
            shared = bands[j] == bands[i]
            j = j[bands[j, shared.argmax(axis=1)] == bucket]
            if len(j):
                j = j[_links_within(sets, i, j, part, whole)]
            if len(j):
                _, firsts = np.unique(component[j], return_index=True)
                j = j[firsts]
                yield np.full(len(j), node[i]), node[j]
                component[np.isin(component, component[j])] = component[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(spec)
        held: list[pa.RecordBatch] = []
        key = None

        def flush():
            if key is None:
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            chunk, node, component, size = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(3, 7))
            sketch = np.frombuffer(b"".join(rows.column(7).to_pylist()), dtype=np.uint8).reshape(-1, length)
            exact = not rows.column(9).null_count
            bands = sets = None
            if exact:
                bands = rows.column(8).flatten().to_numpy().reshape(rows.num_rows, -1)
                flat, ends = rows.column(9).flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(size)))
                sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            found = list(of_block(key[0], key[1] == key[2], chunk, node, component, size, sketch, bands, sets))
            if found:
                a, b = (np.concatenate([x[k] for x in found]) for k in range(2))
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([exact] * len(a))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, low, high = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            for i, j in zip([0, *edge], [*edge, len(bucket)], strict=True):
                now = (bucket[i], low[i], high[i])
                if now != key:
                    yield from flush()
                    key, held = now, []
                held.append(batch.slice(i, j - i))
        yield from flush()

    return run, spec


def confirmed(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs (a, b) whose full sets have whole * intersection >= part * union."""
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("members").alias("members_a"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("members").alias("members_b"))
    both = F.size(F.array_intersect("members_a", "members_b"))
    joined = pairs.join(left, "a").where(F.col("size_a") > 0).join(right, "b")
    return joined.where(F.expr(f"least(size_a, size_b) * {whole} >= greatest(size_a, size_b) * {part}")).where(both * F.lit(whole) >= (F.col("size_a") + F.col("size_b") - both) * F.lit(part)).select("a", "b")


def _groups(docs: DataFrame, part: int, whole: int, width: int, permutations: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc_id, text_key, n_shingles, key), and nodes: key, the row that stands for it (doc_id, text_key) and its group.

    A row is known by doc_id and its text's hash; rows that repeat both have equal texts and one node.
    """
    base = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = materialize(base.mapInArrow(*_signed(width, permutations, rows)), "neardup-signed")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("row")
    nodes = signed.where("n_shingles > 0").groupBy("key").agg(least, F.first("bands").alias("bands")).select("key", "row.doc_id", "row.text_key", "bands")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = banded.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("bucket", "first")
    members = materialize(banded.join(crowded, "bucket"), "neardup-members")

    wanted = materialize(members.select("node").distinct().join(nodes.select("node", "key", "doc_id", "text_key"), "node"), "neardup-wanted")
    few = sized(wanted.select("node", "key", F.col("doc_id").alias("id"), F.col("text_key").alias("hash")))
    texts = base.join(few, base.doc_id.eqNullSafe(F.col("id")) & (base.text_key == F.col("hash"))).select("node", "text", "key")
    sets = materialize(texts.mapInArrow(*_full_sets(width)), "neardup-sets")
    if sets.count() > wanted.count():  # rows that repeat a doc_id and its text
        sets, every = materialize(sets.dropDuplicates(["node"]), "neardup-sets"), sets
        discard(every)

    stars = members.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    first = components(confirmed(stars, sets, part, whole), "neardup-star")

    placed = members.select("bucket", "node").join(first, F.col("node") == F.col("id"), "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high")
    large = F.col("n") > SMALL_BUCKET
    open_rows = placed.join(mixed.select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).alias("chunks"), large.alias("large")), "bucket").join(sets, "node")
    open_rows = open_rows.where("not large").select("*", F.lit(None).cast("array<bigint>").alias("bands")).unionByName(open_rows.where("large").join(nodes.select("node", "bands"), "node"))
    chunked = open_rows.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    task = F.pmod(F.xxhash64("bucket") % tasks + low * F.col("chunks") + high, F.lit(tasks)).cast("int")  # the blocks of a bucket go to one task after another
    dealt = chunked.select("bucket", low.alias("low"), high.alias("high"), "chunk", "node", "component", "size", "sketch", "bands", F.when(F.col("large"), F.col("members")).alias("members"), task.alias("task"))
    dealt = dealt.repartitionById(tasks, "task").drop("task").sortWithinPartitions("bucket", "low", "high")
    close = materialize(dealt.mapInArrow(*_close_pairs(part, whole)), "neardup-close")
    more = confirmed(close.where("not confirmed").select("a", "b").distinct(), sets, part, whole).union(close.where("confirmed").select("a", "b"))

    label = first.select("id", "component")
    lifted = more.join(label.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(label.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    second = components(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "neardup-rest")
    over = second.select(F.col("id").alias("component"), F.col("component").alias("top"))
    grouped = label.join(over, "component", "full").select(F.coalesce("id", "component").alias("node"), F.coalesce("top", "component").alias("group"))
    named = nodes.select("node", "key", "doc_id", "text_key").join(grouped, "node", "left").select("key", "doc_id", "text_key", F.coalesce("group", "node").alias("group"))
    named = materialize(named, "neardup-named")
    discard(nodes, members, wanted, sets, close)
    return signed, named


def near_duplicates(docs: DataFrame, part: int = 75, whole: int = 100, width: int = 5, permutations: int = 64, rows: int = 4) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of part/whole or more on word shingles.

    Returns doc_id, n_shingles, component_id (smallest doc_id that can be reached) and kept
    (doc_id = component_id) for every row of ``docs`` (doc_id, text; other columns are not read).

    Documents with equal shingle sets become one node. Min-max signatures give bands; in each
    bucket every node is paired with one representative and the pair is confirmed on full sets.
    Buckets that still hold several components are then compared in blocks of bounded size, all
    pairs of nodes of different components, by long sketches; the close ones are confirmed on
    full sets as well, in large buckets inside the block, which gives back one pair for each two
    components that it joins. So pairs are never listed inside a group that is already one component.
    A pair at the threshold shares none of the 32 bands of 4 with a chance of about 5e-6, and its
    sketch, which is asked for where no representative links it, lies six standard errors off
    with one of 1e-9.

    Cases: a null or empty text, or one without words, has no shingles and stands alone; a text
    of fewer than five words has its whole sequence as its one shingle; a null doc_id stays null,
    is no representative and is kept only if its group has no other id; rows that repeat a
    doc_id count as documents of their own; an empty table gives an empty result.
    """
    signed, named = _groups(docs, part, whole, width, permutations, rows)
    smallest = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    by_key = named.select("key", "group").join(smallest, "group").select("key", "component_id")
    whole_sets = signed.select("doc_id", "n_shingles", "key").where("n_shingles > 0").join(by_key, "key").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return whole_sets.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, part: int = 75, whole: int = 100, width: int = 5, permutations: int = 64, rows: int = 4) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group that ``near_duplicates`` finds, that of the smallest doc_id.

    Cases: texts without words are in no group and all stay, repeated ones too; of rows that
    repeat a doc_id with different texts each is judged by its own text, and of those in one
    group one stays; of rows that repeat doc_id and text one stays; a row with a null doc_id
    stays only if its group has no row with an id; columns of any name stay as they are; an
    empty table gives no rows.
    """
    signed, named = _groups(docs, part, whole, width, permutations, rows)
    best = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("row")).select(F.col("row.doc_id").alias("id"), F.col("row.text_key").alias("hash"))
    seen = signed.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    judged = materialize(seen.join(best, seen.doc_id.eqNullSafe(F.col("id")) & (seen.text_key == F.col("hash")), "left").select("doc_id", "text_key", "n", F.col("hash").isNotNull().alias("stays")), "neardup-judged")
    discard(signed, named)
    own = [free_name(docs, name) for name in ("own_id", "own_hash")]
    other = [free_name(docs, name) for name in ("gone_id", "gone_hash")]
    gone = sized(judged.where("not stays").select(F.col("doc_id").alias(other[0]), F.col("text_key").alias(other[1])))
    known = docs.withColumns({own[0]: F.col("doc_id").cast("bigint"), own[1]: F.xxhash64(F.col("text").cast("binary"))})
    kept = known.join(gone, F.col(own[0]).eqNullSafe(F.col(other[0])) & (F.col(own[1]) == F.col(other[1])), "left_anti")
    if not judged.where("stays and n > 1").isEmpty():  # rows that repeat doc_id and text: one of them stays
        words = F.coalesce(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))
        kept = kept.where(words).dropDuplicates(own).union(kept.where(~words))
    return kept.drop(*own)
