import random
import zlib

import pytest
from pyspark.sql import functions as F

from verdigris.llm import toxicity as X

BAD = ["scum", "moron", "Loweira", "loweibu", "loweito"]


def corpus(seed=1, n=700):
    draw = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("tha", "ere", "ino", "deu") for b in ("ti", "on", "ré", "st") for c in ("", "an", "er", "wh")]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 6 == 0
        w = [draw.choice(plain) for _ in range(draw.choice([15, 60, 200]))]
        if toxic:
            for _ in range(draw.randint(2, 5)):
                w.insert(draw.randrange(len(w)), draw.choice(BAD))
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (9000, None), (9001, ""), (9002, "x" * 200_000), (9003, "you Loweixyz scum, scum")], "doc_id bigint, text string").withColumns({"n_tokens": F.lit("x"), "toxic": F.lit(3), "score": F.lit(None).cast("int")})
    table = spark.createDataFrame([*labels, (1, None), (None, 1), (2, 7)], "doc_id bigint, toxic int").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r for r in X.toxicity(df, table).collect()}
    held = [(got[i].score >= 0.5, bool(t)) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[9000].score == got[9001].score < 0.5 and got[9002].score < 0.5 and got[9003].score > 0.5
    text = "you Loweixyz scum, scum"
    assert any("scum" in text[p.begin : p.end] for p in got[9003].passages)
    kept = X.without_toxic(df, table)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(n=20)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert len({r.score for r in X.toxicity(df, none).collect()}) == 1
    assert X.toxicity(df.limit(0), spark.createDataFrame(labels, "doc_id bigint, toxic int")).count() == 0


def maximal(scores):
    """All maximal scoring segments by their definition: the best segment first, then what lies beside it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [*[(x, y) for x, y in maximal(scores[:a])], (a, b - 1), *[(x + b, y + b) for x, y in maximal(scores[b:])]]


@pytest.mark.parametrize("seed", range(30))
def test_segments_are_the_maximal_ones(seed):
    draw = random.Random(seed)
    scores = [draw.choice([-0.37, -0.37, -0.37, 0.5, 1.3, 2.1]) for _ in range(40)]
    at = [k for k, s in enumerate(scores) if s > 0]
    found = X.segments(at, [scores[k] for k in at], 0.37)
    assert [(a, b) for a, b, _ in found] == maximal(scores)
    assert all(abs(s - sum(scores[a : b + 1])) < 1e-9 for a, b, s in found)


def test_more_evidence_is_never_less():
    model = X.Model(scale=0.01)
    assert X.evidence_of([], 10, model) == 0 <= X.evidence_of([3.0], 100, model) < X.evidence_of([6.0], 100, model)
    assert X.evidence_of([6.0, 6.0], 100, model) > X.evidence_of([6.0], 100, model) > X.evidence_of([6.0], 100_000, model)


def test_every_significant_segment_counts():
    model = X.Model(scale=1e-4)
    one = [9.0] * 50
    assert X.evidence_of([*one, 9.0], 1000, model) > X.evidence_of(one, 1000, model)
    assert X.evidence_of([9.0] * 400, 1000, model) > X.evidence_of([9.0] * 200, 1000, model)
    # segments that chance gives as well add nothing, however many there are
    assert X.evidence_of([9.0, *[1.0] * 5000], 100_000, model) == X.evidence_of([9.0], 100_000, model)


def test_filter_and_score_agree_on_both_sides_of_the_bend():
    for bias, slope in ((-6.0, 0.5), (-6.001, 0.5), (-5.999, 0.5)):
        model = X.Model(bias=bias, slope=slope)
        scores = [model.probability(e) for e in (0.0, 11.9, 12.0, 12.1, 14.0, 100.0)]
        assert scores == sorted(scores) and len(set(scores)) == len(scores)


def test_repeated_rows_are_scored_each(spark):
    docs, labels = corpus(n=60)
    df = spark.createDataFrame([*docs, *docs[:7]], "doc_id bigint, text string")
    rows = X.toxicity(df, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(rows) == 67 and len({(r.doc_id, r.score) for r in rows}) == 60
