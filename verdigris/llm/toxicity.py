"""Toxic passages as maximum-scoring segments of token log-odds, aggregated by extreme-value statistics and calibrated on labels."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_offsets, blocks, hex_crc32, lean_memory, materialize, small_batches

#: Labelled rows that the model is fitted on at most, those with the lowest hashes of doc_id.
TRAINING_ROWS = 40_000
#: A feature must be in this share of the toxic training documents and in so many of them.
LEAST_SHARE, LEAST_DOCUMENTS = 0.002, 4
#: Pseudo-count of the symmetric Dirichlet prior, and standard errors taken off a log-odds.
PRIOR, ERRORS = 0.5, 1.64
#: Log-odds that a feature needs to enter the lexicon.
LEAST_LOG_ODDS = 1.0
PREFIXES = (4, 5, 6)
REMEMBERED = 150_000
RESULT = "doc_id bigint, n_tokens bigint, score double, passages array<struct<begin:bigint,end:bigint,log_odds:double,e_value:double>>"


def _fold_table() -> bytes:
    table = bytearray(b" " * 256)
    for b in range(256):
        if b >= 0x80 or 0x61 <= b <= 0x7A:
            table[b] = b
        elif 0x41 <= b <= 0x5A:
            table[b] = b + 32
    return bytes(table)


FOLD = _fold_table()


def tokens_of(text: bytes) -> list[bytes]:
    """Runs of letters (A-Z lower-cased) and of characters beyond ASCII."""
    return text.translate(FOLD).split()


def features_of(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, marked with a star: invented and inflected forms share them."""
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    """Lexicon of log-odds, what any other token takes off, the extreme-value parameters, and the calibration."""

    lexicon: dict[bytes, float] = field(default_factory=dict)
    cost: float = 0.05
    decay: float = 1.0
    scale: float = 0.1
    bias: float = 0.0
    slope: float = 1.0

    def word_score(self, word: bytes) -> float:
        get = self.lexicon.get
        return max((get(f, 0.0) for f in features_of(word)), default=0.0)

    def probability(self, evidence: float) -> float:
        z = self.bias + self.slope * float(counted_evidence(evidence))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def counted_evidence(evidence):
    """Evidence as the calibration reads it, wherever a score is made: beyond 12 it adds a thousandth, which only orders."""
    return np.minimum(evidence, 12.0) + 1e-3 * np.maximum(0.0, evidence - 12.0)


def segments(positions: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) in time linear in the scored tokens.

    Scored tokens stand at ``positions``; each other token takes ``cost`` off. A new segment is
    joined to an earlier one when the sum before that one is smaller and the sum at its end is
    not greater; what is left over is maximal.
    """
    kept: list[list[float]] = []  # first, last, sum before, sum at the end
    total, last = 0.0, None
    for at, score in zip(positions, scores, strict=True):
        if last is not None:
            total -= cost * (at - last - 1)
        last = at
        before, total = total, total + score
        new = [at, at, before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j -= 1
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(int(a), int(b), end - start) for a, b, start, end in kept]


def evidence_of(sums: list[float], n: int, model: Model) -> float:
    """-log10 of the chance that unmarked text of n tokens has such segments, over the best number of segments to count.

    The r highest normalised scores sum to t; a chance text has a sum that high with a
    probability near exp(-t) t^(r-1) / (r! (r-1)!). Every segment takes part whose own normalised
    score is positive, that is of which chance gives less than one; there is no other bound on r.
    """
    if not sums:
        return 0.0
    base = math.log(max(model.scale * n, 1e-9))
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(sums, reverse=True), 1):
        own = model.decay * s - base
        if own <= 0:
            break
        total += own
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return best / math.log(10)


class Scorer:
    """A worker's scan of texts under a model; remembers the words that it has looked up."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def scores(self, words: list[bytes]) -> np.ndarray:
        known, model = self.known, self.model
        get = known.get
        out = np.fromiter((get(w, -1.0) for w in words), dtype=np.float64, count=len(words))
        for i in np.flatnonzero(out < 0):
            out[i] = model.word_score(words[i])
            if len(known) < REMEMBERED:
                known[words[i]] = out[i]
        return out

    def scan(self, text: bytes) -> tuple[int, float, list[tuple[int, int, float]]]:
        words = tokens_of(text)
        scores = self.scores(words)
        at = np.flatnonzero(scores)
        if not len(at):
            return len(words), 0.0, []
        found = segments(at.tolist(), scores[at].tolist(), self.model.cost)
        return len(words), evidence_of([s for _, _, s in found], len(words), self.model), found


def _character_spans(text: bytes, found: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    word = np.frombuffer(text.translate(FOLD), dtype=np.uint8) != 32
    padded = np.concatenate(([False], word, [False]))
    begins, ends = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(padded[:-1] & ~padded[1:])
    characters = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    return [(int(characters[begins[a]]), int(characters[ends[b]])) for a, b, _ in found]


def _toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in blocks(batches, 0, 1 << 20):
        counts: Counter = Counter()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            counts.update({f for w in set(tokens_of(data[a:b].tobytes())) for f in features_of(w)})
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])


def _counted(wanted: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch, data, offsets in blocks(batches, 0, 1 << 20):
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                counts.update({f for w in set(tokens_of(data[a:b].tobytes())) for f in features_of(w) if f in wanted})
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

    return run


def _contexts(wanted: frozenset[bytes]):
    """Each wanted feature with the word before it: copies of one document have the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in blocks(batches, 0, 1 << 20):
            seen = set()
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                words = tokens_of(data[a:b].tobytes())
                for before, word in zip([b"", *words], words, strict=False):
                    seen.update((f, before) for f in features_of(word) if f in wanted)
            yield pa.record_batch([pa.array([f for f, _ in seen], pa.binary()), pa.array([c for _, c in seen], pa.binary())], names=["feature", "context"])

    return run


def _measured(model: Model):
    """For the calibration: label, tokens, scored tokens, evidence, for each training document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            data, offsets = binary_offsets(batch.column(0))
            found = [scorer.scan(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch(
                [batch.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array([round(x[1], 1) for x in found], pa.float64()), pa.array([len(x[2]) for x in found], pa.int64()), pa.array([sum(s for _, _, s in x[2]) for x in found], pa.float64()), pa.array([sum(s >= 3 for _, _, s in x[2]) for x in found], pa.int64())],
                names=["toxic", "n_tokens", "evidence", "n_segments", "sum_scores", "n_high"],
            )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Bias and slope by Newton steps, lightly held back so that separable data has an answer."""
    design, beta = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        gradient = design.T @ (weight * (y - p)) - ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Lower ends of the features' log-odds under the Dirichlet prior."""
    odds = np.log((toxic + PRIOR) / (n_toxic + 2 * PRIOR)) - np.log((clean + PRIOR) / (n_clean + 2 * PRIOR))
    return odds - ERRORS * np.sqrt(1 / (toxic + PRIOR) + 1 / (clean + PRIOR))


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """The model from labelled documents whose crc32(doc_id) mod 5 is not 0, ``training_rows`` of them at most.

    Documents are picked by their labels' ids, a bounded list that is sent to the scan, so no
    text is shuffled. Features are counted by documents, first in the toxic ones; those that
    are frequent enough there, at most (features of a document) / LEAST_SHARE of them, are
    counted in the others. A toxic count is no more than the number of different words before
    the feature, so that copies of one toxic document do not vouch for its ordinary words.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(F.pmod(hex_crc32(F.col("doc_id")), F.lit(5)) != 0)
    picked = usable.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(training_rows)
    own = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    train = materialize(own.join(F.broadcast(picked), own.doc_id == F.col("id")).select("text", F.col("toxic").cast("int").alias("toxic")).where("text is not null"), "toxicity-train")
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    model = Model()
    if not n_toxic:
        model.bias = -math.log((n_clean + 1) / 1)
        return model
    toxic, clean = train.where("toxic = 1").select("text"), train.where("toxic = 0").select("text")
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * n_toxic)
    count = "feature binary, n bigint"
    frequent = {bytes(r["feature"]): r["n"] for r in toxic.mapInArrow(_toxic_features, count).groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}
    others = {bytes(r["feature"]): r["n"] for r in clean.mapInArrow(_counted(frozenset(frequent)), count).groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    names = list(frequent)
    x, o = np.array([frequent[f] for f in names], dtype=float), np.array([others.get(f, 0) for f in names], dtype=float)
    strong = np.flatnonzero(_log_odds(x, o, n_toxic, n_clean) >= LEAST_LOG_ODDS)
    contexts = {bytes(r["feature"]): r["n"] for r in toxic.mapInArrow(_contexts(frozenset(names[i] for i in strong)), "feature binary, context binary").groupBy("feature").agg(F.count_distinct("context").alias("n")).collect()}
    x = np.array([min(frequent[f], contexts.get(f, 0)) for f in names], dtype=float)
    final = _log_odds(x, o, n_toxic, n_clean)
    model.lexicon = {names[i]: float(final[i]) for i in strong if final[i] >= LEAST_LOG_ODDS}
    _calibrate(model, train)
    return model


def _calibrate(model: Model, train: DataFrame) -> None:
    """Cost of an unmarked token, extreme-value decay and scale from the clean documents, then the logistic on the evidence."""
    shape = "toxic int, n_tokens bigint, evidence double, n_segments bigint, sum_scores double, n_high bigint"
    totals = {r["toxic"]: r for r in train.mapInArrow(_measured(model), shape).groupBy("toxic").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_segments", "sum_scores", "n_high"))).collect()}
    toxic, clean = totals.get(1), totals.get(0)
    marked = (toxic["n_segments"] + 1) / (toxic["n_tokens"] + 2)
    model.cost = max(0.01, -math.log(1 - min(0.5, marked)))
    if clean is not None:
        share = (clean["n_segments"] + 0.5) / (clean["n_tokens"] + 1)
        height = max(LEAST_LOG_ODDS, clean["sum_scores"] / max(1, clean["n_segments"]))
        low, high = 1e-3, 5.0
        for _ in range(60):  # share * exp(decay * height) + (1 - share) * exp(-decay * cost) = 1
            middle = (low + high) / 2
            if share * math.exp(middle * height) + (1 - share) * math.exp(-middle * model.cost) < 1:
                low = middle
            else:
                high = middle
        model.decay = min(2.0, max(0.3, low))
        model.scale = (clean["n_high"] + 0.5) / (clean["n_tokens"] + 1) * math.exp(model.decay * 3)
    seen = train.mapInArrow(_measured(model), shape).groupBy("toxic", "evidence").count().collect()
    x, y, w = (np.array([r[c] for r in seen], dtype=float) for c in ("evidence", "toxic", "count"))
    model.bias, model.slope = _logistic(counted_evidence(x), y, w)
    model.slope = max(model.slope, 1e-3)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("log_odds", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            data, offsets = binary_offsets(batch.column(1))
            sizes, scores, passages = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                text = data[a:b].tobytes()
                n, evidence, found = scorer.scan(text)
                sizes.append(n)
                scores.append(model.probability(evidence))
                own = []
                if found:
                    for (begin, end), (_, _, s) in zip(_character_spans(text, found), found, strict=True):
                        e = model.scale * n * math.exp(-model.decay * s)
                        if e < 1:
                            own.append({"begin": begin, "end": end, "log_odds": s, "e_value": e})
                passages.append(own)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=["doc_id", "n_tokens", "score", "passages"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Toxicity of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, toxic).

    Returns doc_id, n_tokens, score (0 to 1) and passages: each significant segment (fewer than
    one expected by chance) as character offsets with its log-odds and expected number. Only
    the text decides a score; scoring is one scan without a shuffle.

    Cases: a null or empty text has the score of no evidence; null labels and labels other than
    0 and 1 teach nothing, of several for a doc_id the highest counts; without a toxic label
    everything gets the same low score; rows that repeat are scored each; an empty table gives
    no rows; other columns are not read.
    """
    model = model or fit(docs, labels)
    base = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return base.mapInArrow(_scored(model), RESULT)


def _kept(model: Model, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        lean_memory()
        for batch in batches:
            data, offsets = binary_offsets(batch.column(text))
            evidence = [scorer.scan(data[a:b].tobytes())[1] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield batch.filter(pa.array([model.probability(e) < 0.5 for e in evidence], pa.bool_()))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows scored under 0.5, all columns; each row is judged by its own text, and none is shuffled.

    Cases: as in ``toxicity``, whose scores decide; rows with null or empty texts have no evidence
    and stay, repeated rows stay or go each, columns of any name stay as they are, an empty table gives no rows.
    """
    return small_batches(docs).mapInArrow(_kept(fit(docs, labels), docs.columns.index("text")), docs.schema)
