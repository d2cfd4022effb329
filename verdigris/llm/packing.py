"""Best-fit packing of token sequences: few-document patterns fitted to the length histogram by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize, sized, small_batches
from .subwords import forget, public_tokenizer, word_encoder

#: Tokens of a sequence, and the id that ends a document.
SIZE, END_ID = 4096, 1
#: Three-document patterns that the fit begins with: those of the most frequent lengths.
TRIPLES = 4000
#: Documents of a pattern where documents are long; half as many again as a sequence has on average where they are short, up to the second number.
MEMBERS, MOST_MEMBERS = 8, 64
#: Lengths of drawn patterns in one round, rounds of a fit, and fits one after another.
DRAWN, GROWTHS, WAVES = 1 << 17, 5, 3
#: Rows of a table that every task may hold; one with more is joined by shuffling.
ROWS_PER_TASK = 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
RANKED = ", part int, turn bigint"


def _turns(length: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many earlier pieces of the task have each piece's length; ``before`` counts them and is brought up to date."""
    order = np.argsort(length, kind="stable")
    own = length[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(own)))
    turn = np.empty(len(own), dtype=np.int64)
    turn[order] = np.arange(len(own)) - np.repeat(first, times) + before[own]
    before[own[first]] += times
    return turn


def _cutter(path: str, size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = word_encoder(path), TaskContext.get()
        part, before = context.partitionId() if context else 0, np.zeros(size + 1, dtype=np.int64)
        for batch, data, offsets in blocks(batches, 1, 1 << 19):
            ids, first = encoder.texts(data, offsets)
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for i in range(batch.num_rows):
                text = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                for k, a in enumerate(range(0, len(text), size)):
                    cut = text[a : a + size]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(cut))
                    crc.append(zlib.crc32(cut.tobytes()))
                    if with_ids:
                        own.append(cut)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).astype(np.int32))))
                names.append("ids")
            turn = _turns(np.array(length, dtype=np.int64), before)
            yield pa.record_batch([*columns, pa.array(np.full(len(turn), part, np.int32)), pa.array(turn)], names=[*names, "part", "turn"])

    return run


def _cut(docs: DataFrame, path: str, size: int, end_id: int, with_ids: bool) -> DataFrame:
    base = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return base.mapInArrow(_cutter(path, size, end_id, with_ids), PIECES + ", ids array<int>" * with_ids + RANKED)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``size``: only longer documents are cut, and each document ends with ``end_id``."""
    return _cut(docs, path, size, end_id, with_ids).drop("part", "turn")


def _made(patterns: np.ndarray, x: np.ndarray, lengths: int) -> np.ndarray:
    """Pieces of each length in patterns that are repeated ``x`` times."""
    return np.bincount(patterns.ravel(), weights=((patterns > 0) * x[:, None]).ravel(), minlength=lengths)


def fit_patterns(histogram: np.ndarray, patterns: np.ndarray, rounds: int = 400, start: np.ndarray | None = None) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths close to the histogram in least squares, a length's error weighted by the length.

    ``patterns`` has a row's lengths, 0 where there are fewer. The multiplicative update
    x <- x * (A'Wh) / (A'WAx) never leaves the non-negative side and never raises the error.
    """
    weight = np.arange(len(histogram)) / max(1, len(histogram) - 1)
    target = histogram.astype(np.float64)

    def back(values: np.ndarray) -> np.ndarray:
        return (values * weight)[patterns].sum(axis=1)  # the length 0 has no weight

    goal = back(target)
    x = np.where(goal > 0, target[patterns].max(axis=1) / len(patterns) + 1e-3, 0.0) if start is None else start
    for _ in range(rounds):
        x = x * goal / np.maximum(back(_made(patterns, x, len(histogram))), 1e-12)
    return x


def enumerate_patterns(histogram: np.ndarray, size: int, triples: int = TRIPLES) -> np.ndarray:
    """Patterns of one to three documents that fill a sequence exactly, from lengths that occur."""
    have = np.flatnonzero(histogram)
    out = [np.array([[size, 0, 0]])] if size < len(histogram) and histogram[size] else []
    a = have[(have * 2 <= size) & (have < size)]
    b = size - a
    pair = histogram[b] > 0
    out.append(np.column_stack([a[pair], b[pair], np.zeros(pair.sum(), np.int64)]))
    common = have[np.argsort(-histogram[have], kind="stable")][:256]
    x, y = (v.ravel() for v in np.meshgrid(common, common, indexing="ij"))
    z = size - x - y
    right = (x <= y) & (y <= z)
    x, y, z = x[right], y[right], z[right]
    right = histogram[z] > 0
    x, y, z = x[right], y[right], z[right]
    best = np.argsort(-np.minimum(np.minimum(histogram[x], histogram[y]), histogram[z]), kind="stable")[:triples]
    out.append(np.column_stack([x[best], y[best], z[best]]))
    return np.concatenate(out).astype(np.int64)


def draw_patterns(wanted: np.ndarray, size: int, members: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """Patterns that fill a sequence exactly, priced by ``wanted`` (how many pieces of each length have no pattern yet).

    First lengths are spread over the wanted tokens. Then each further length is what is missing,
    if such pieces are wanted, else one of those that fit, as often as it is wanted.
    """
    tokens, upto = np.cumsum(wanted * np.arange(len(wanted))), np.cumsum(wanted)
    if tokens[-1] <= 0:
        return np.zeros((0, members), dtype=np.int64)
    below = 1 - 1e-12
    out = np.zeros((n, members), dtype=np.int64)
    out[:, 0] = np.searchsorted(tokens, (rng.permutation(n) + rng.random(n)) / n * tokens[-1] * below, "right")
    room = size - out[:, 0]
    for k in range(1, members):
        drawn = np.searchsorted(upto, rng.random(n) * upto[room] * below, "right")
        out[:, k] = np.where((room == 0) | (upto[room] <= 0), 0, np.where(wanted[room] > 0, room, np.minimum(drawn, room)))
        room = room - out[:, k]
    return np.unique(np.sort(out[room == 0], axis=1)[:, ::-1], axis=0)


def grown_patterns(histogram: np.ndarray, size: int, triples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their fitted repeat counts, not more patterns than lengths.

    The enumerated patterns of up to three documents come first. Then patterns are drawn for what
    a fit leaves over, the fit is made again, and in the end those that it uses least are taken out,
    so that counts stay large enough to be rounded.
    """
    rng, lengths = np.random.default_rng(seed), len(histogram)
    mean = histogram @ np.arange(lengths) / histogram.sum()
    members = int(min(MOST_MEMBERS, max(MEMBERS, np.ceil(1.5 * size / mean))))
    n = DRAWN // members
    patterns = np.pad(enumerate_patterns(histogram, size, triples), ((0, 0), (0, members - 3)))
    wanted, x = histogram.astype(np.float64), np.zeros(len(patterns))
    for turn in range(GROWTHS):
        kept = patterns[np.argsort(-x, kind="stable")[:n]] if turn else patterns
        patterns = np.unique(np.concatenate([kept, draw_patterns(wanted, size, members, n, rng)]), axis=0)
        x = fit_patterns(histogram, patterns, 100)
        wanted = np.maximum(0.0, histogram - _made(patterns, x, lengths))
    most = int((histogram > 0).sum())
    while len(patterns) > most:
        kept = np.argsort(-x, kind="stable")[: max(most, len(patterns) * 3 // 5)]
        patterns = patterns[kept]
        x = fit_patterns(histogram, patterns, 60, x[kept])
    return patterns, x


def patterned(histogram: np.ndarray, size: int = SIZE, triples: int = TRIPLES) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, how often)] with whole repeat counts, as far as there are pieces: fitted counts are rounded, then smaller ones give one sequence each. What is left is fitted again."""
    left, out = histogram.astype(np.int64).copy(), []
    for wave in range(WAVES):
        before = int(left.sum())
        if not before:
            break
        patterns, x = grown_patterns(left, size, triples, wave)
        order = [(k, *np.unique(patterns[k][patterns[k] > 0], return_counts=True)) for k in np.argsort(-x, kind="stable")]
        for whole in (True, False):
            for k, lengths, often in order:
                repeat = int(min(np.rint(x[k]) if whole else x[k] > 0.1, (left[lengths] // often).min()))
                if repeat > 0:
                    left[lengths] -= repeat * often
                    out.append(([(int(n), int(m)) for n, m in zip(lengths[::-1], often[::-1], strict=True)], repeat))
        if left.sum() > 0.8 * before:
            break
    return out


def best_fit(histogram: np.ndarray, size: int = SIZE) -> list[tuple[list[tuple[int, int]], int]]:
    """All pieces, largest first, each sequence filled by the largest lengths that fit; equal sequences are made at once."""
    out, have, counts = [], np.flatnonzero(histogram).tolist(), histogram.tolist()
    while have:
        room, chosen = size, []
        at = len(have)
        while at:
            length = have[at - 1]
            if length <= room:
                often = min(room // length, counts[length])
                chosen.append((length, often))
                room -= often * length
                at -= 1
            if room <= 0:
                break
            at = min(at, bisect.bisect_right(have, room))
        repeat = min(counts[n] // m for n, m in chosen)
        for n, m in chosen:
            counts[n] -= repeat * m
            if not counts[n]:
                have.pop(bisect.bisect_left(have, n))
        out.append((chosen, repeat))
    return out


def plan(histogram: np.ndarray, size: int = SIZE, triples: int = TRIPLES) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, how often)] with repeat counts that use every piece of the histogram once."""
    return shared_plan(histogram, size, triples)[0]


def shared_plan(histogram: np.ndarray, size: int = SIZE, triples: int = TRIPLES) -> tuple[list[tuple[list[tuple[int, int]], int]], int]:
    """The plan, and how many pieces fitted patterns place in it.

    ``histogram[n]`` counts pieces of n tokens. What fitted patterns leave is packed by best fit.
    Patterns that were taken last are given back, more and more of them, while the whole is
    above the least number of sequences that can hold the tokens; of what was tried the fewest
    sequences win, then the most patterns. The work depends on the number of lengths, not of pieces.
    """
    least = -(-int(histogram @ np.arange(len(histogram))) // size)
    found, best, fewest, placed = patterned(histogram, size, triples), [], None, 0
    for share in (1.0, 0.97, 0.9, 0.8, 0.6, 0.3, 0.0):
        kept = found[: int(share * len(found))]
        left = histogram.astype(np.int64).copy()
        for chosen, repeat in kept:
            for n, m in chosen:
                left[n] -= repeat * m
        tried = [*kept, *best_fit(left, size)]
        count = sum(repeat for _, repeat in tried)
        if fewest is None or count < fewest:
            best, fewest, placed = tried, count, int(histogram.sum() - left.sum())
        if fewest == least:
            break
    return best, placed


def places(planned: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each length the ranges of ranks that a pattern takes: key (length and first rank), how often in a sequence, first sequence, offset."""
    key, often, base, offset, taken, sequence = [], [], [], [], {}, 0
    for chosen, repeat in planned:
        at = 0
        for length, m in chosen:
            first = taken.get(length, 0)
            key.append((length << 44) + first)
            often.append(m)
            base.append(sequence)
            offset.append(at)
            taken[length] = first + repeat * m
            at += length * m
        sequence += repeat
    order = np.argsort(np.array(key, dtype=np.int64), kind="stable")
    return {n: np.array(v, dtype=np.int64)[order] for n, v in (("key", key), ("often", often), ("base", base), ("offset", offset))}


def _placed(table: dict[str, np.ndarray], at_length: int, at_rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (at_length, at_rank))
            key = (length << 44) + rank
            at = np.searchsorted(table["key"], key, "right") - 1
            turn = key - table["key"][at]
            sequence = table["base"][at] + turn // table["often"][at]
            offset = table["offset"][at] + turn % table["often"][at] * length
            kept = [batch.column(k) for k in range(batch.num_columns) if k != at_rank]
            names = [n for k, n in enumerate(batch.schema.names) if k != at_rank]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A place for every token piece of ``docs`` (doc_id, text) in sequences of at most ``size`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset (and the ids, if
    asked for). Only the histogram of lengths, ``size`` numbers at most, comes to the driver;
    the plan that goes back holds one row for each pattern and length. A piece's rank among those
    of its length tells its place: while texts are cut, each task numbers its pieces of every
    length, and the numbers of all tasks, a table of a row for each task and length, are added
    up. So no piece is sorted, and pieces are shuffled only if that table is too large for a task.

    Cases: a null or empty text is the end id alone; null doc_ids and repeated rows are packed
    as rows of their own; other columns are not read; an empty table gives no rows.
    """
    cut = materialize(_cut(docs, path or public_tokenizer(), size, end_id, with_ids), "pack-pieces")
    counts = materialize(cut.groupBy("length", "part").count(), "pack-counts")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    table = places(plan(histogram, size))
    before = F.expr("sum(count) over (partition by length order by part rows between unbounded preceding and 1 preceding)")
    first = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    columns = [c for c in cut.columns if c not in ("part", "turn")]
    ready = cut.join(sized(first, ROWS_PER_TASK), ["length", "part"]).select(*columns, (F.col("first") + F.col("turn")).cast("bigint").alias("rank"))
    return ready.mapInArrow(_placed(table, columns.index("length"), len(columns)), PIECES + ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, sequence_id and ids, from ``packed(..., with_ids=True)``; a group holds ``size`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
