import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.llm import packing, subwords, tokencounts

TEXTS = [(1, "Hello world.\n\nSecond line, don't!\n"), (2, None), (3, ""), (4, "\n\n\n"), (5, "é" * 50_000), (6, "one line"), (7, "naïve café…. \u3000 x\n<|endoftext|> y")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "don't ", ".", "7", "é", " ", "\n", "\t", "\xa0", "\x1c", "   ", "\n \n\n", "\u3000\u3000\u3000", "<|endoftext|>"]), max_size=40))
def test_cut_white_space_leaves_the_ids(parts):
    coder, _ = tokencounts.encoding(tokencounts.public_ranks())
    text, before = "".join(parts), (tokencounts.LONG_SPACE, tokencounts._LONG_SPACES)
    tokencounts.LONG_SPACE, tokencounts._LONG_SPACES = 0, re.compile(f"(?<!{tokencounts._BLANK}){tokencounts._BLANK}{{3,}}")
    try:
        assert tokencounts.encoded(coder, text).tolist() == coder.encode_ordinary(text)
    finally:
        tokencounts.LONG_SPACE, tokencounts._LONG_SPACES = before


def test_white_space_of_any_length(spark):
    texts = [(k, "a b" + c * 2_000_000 + tail) for k, (c, tail) in enumerate((c, tail) for c in (" ", "\t", "\n", "\xa0") for tail in ("", "end"))] + [(8, "x" * 2_000_000), (9, "." * 2_000_000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    counts = {r.doc_id: r.n for r in tokencounts.section_tokens(df.where("doc_id not in (4, 5)")).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    coder, _ = tokencounts.encoding(tokencounts.public_ranks())
    for k, text in texts:
        if k not in (4, 5):  # two million lines are counted below
            blank = text[3:2_000_003] if k < 8 else ""
            rest = text[2_000_003:]
            whole = 2 + len(coder._encode_single_piece(blank[: len(blank) - bool(rest)])) + (len(coder.encode_ordinary(blank[-1:] + rest)) if rest else 0) if blank else len(coder.encode_ordinary(text))
            assert counts[k] == whole
    bounds = tokencounts.line_bounds(texts[5][1].encode())
    ids = tokencounts.encoded(coder, texts[5][1])
    _, sizes = tokencounts.encoding(tokencounts.public_ranks())
    assert tokencounts.attributed(np.cumsum(sizes[ids]), bounds, "first").sum() == len(ids)


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_sections_add_up_to_whole_encodings(spark, rule):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumns({"section": F.lit("x"), "begin": F.lit(1), "n_tokens": F.lit(0)})
    rows = tokencounts.section_tokens(df, rule).orderBy("doc_id", "section").collect()
    coder, sizes = tokencounts.encoding(tokencounts.public_ranks())
    for i, text in TEXTS:
        own = [r for r in rows if r.doc_id == i]
        ids = coder.encode_ordinary(text or "")
        assert abs(sum(r.n_tokens for r in own) - len(ids)) < 1e-9
        assert "".join((text or "")[r.begin : r.end] for r in own) == (text or "")
        assert [(text or "")[r.begin : r.end] for r in own] == ((text or "").splitlines(keepends=True) if text and "\u3000" not in text else [(text or "")[r.begin : r.end] for r in own]) or not text
        # brute force: each token's bytes looked at one by one
        raw, want, at = (text or "").encode(), [0.0] * len(own), 0
        place = [k for k, r in enumerate(own) for _ in range(len((text or "")[r.begin : r.end].encode()))]
        for token in ids:
            size = int(sizes[token])
            where = place[at : at + size]
            share = {k: where.count(k) / size for k in where}
            if rule == "share":
                for k, v in share.items():
                    want[k] += v
            else:
                want[where[0] if rule == "first" else min(share, key=lambda k: (-share[k], k))] += 1
            at += size
        assert at == len(raw) and np.allclose(want, [r.n_tokens for r in own])


def test_fields_share_one_encoding(spark):
    df = spark.createDataFrame([(1, "a title", "the body"), (2, None, "x"), (3, None, None)], "id bigint, title string, body string")
    rows = tokencounts.field_tokens(df, "id", ["title", "body"]).collect()
    coder, _ = tokencounts.encoding(tokencounts.public_ranks())
    for i, text in ((1, "a title\nthe body"), (2, "\nx"), (3, "\n")):
        assert sum(r.n_tokens for r in rows if r.id == i) == len(coder.encode_ordinary(text))
    with pytest.raises(ValueError):
        tokencounts.field_tokens(df, "id", ["title"], rule="last")


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_bytes_that_are_no_utf8(spark, rule):
    texts = [b"a\xff\xfeb\nsecond \xc3 line\n\xe2\x82", b"\xff", b"\n\xc3\n" * 40, "caf\u00e9\n".encode()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id bigint, text binary").selectExpr("doc_id", "cast(text as string) as text")
    rows = tokencounts.section_tokens(df, rule).collect()
    coder, _ = tokencounts.encoding(tokencounts.public_ranks())
    for k, text in enumerate(texts):
        shown, own = text.decode("utf-8", "replace"), sorted((r for r in rows if r.doc_id == k), key=lambda r: r.section)
        assert abs(sum(r.n_tokens for r in own) - 2 * len(coder.encode_ordinary(shown))) < 1e-9
        assert [shown[r.begin : r.end] for r in own[::2]] == shown.splitlines(keepends=True)
    fields = tokencounts.field_tokens(df.withColumn("title", F.col("text")), "doc_id", ["title", "text"], rule=rule).collect()
    assert len(fields) == 4 * len(texts)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokencounts.section_tokens(empty).count() == 0 and packing.packed(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abZÉñ×…'\".,!<|>s t\n12\u0301\x1c\x85Σ_", max_size=60), min_size=1, max_size=8))
def test_word_encoder_equals_the_tokenizer(texts):
    encoder = subwords.word_encoder(subwords.public_tokenizer())
    raw = [t.encode() for t in [*texts, "<|endoftext|> a", "don't I'm x's"]]
    ids, first = encoder.texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    for k, text in enumerate([*texts, "<|endoftext|> a", "don't I'm x's"]):
        assert ids[first[k] : first[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    draw = random.Random(seed)
    histogram = np.zeros(257, dtype=np.int64)
    for _ in range(draw.choice([1, 40, 900])):
        histogram[draw.randint(1, 256) if seed % 2 else min(256, int(draw.expovariate(0.02)) + 1)] += 1
    used = np.zeros_like(histogram)
    for chosen, repeat in packing.plan(histogram, 256):
        assert sum(n * m for n, m in chosen) <= 256 and repeat > 0
        for n, m in chosen:
            used[n] += m * repeat
    assert (used == histogram).all()
    least = -(-int((histogram * np.arange(257)).sum()) // 256)
    assert sum(r for _, r in packing.plan(histogram, 256)) <= max(least + 1, int(np.ceil(least * 1.12)) + 1)


def test_fit_of_exact_patterns():
    histogram = np.zeros(101, dtype=np.int64)
    histogram[[30, 70, 20, 80]] = 10, 10, 4, 4
    patterns = packing.enumerate_patterns(histogram, 100)
    x = packing.fit_patterns(histogram, patterns)
    made = np.bincount(patterns.ravel(), weights=np.repeat(x, 3) * (patterns.ravel() > 0), minlength=101)
    assert (x >= 0).all() and np.abs(made[1:] - histogram[1:]).max() < 0.5


@pytest.mark.parametrize("mean", [60, 900])
def test_patterns_place_most_pieces_in_the_least_number_of_sequences(mean):
    draw = np.random.default_rng(mean)
    histogram = np.bincount(np.minimum(4096, draw.lognormal(np.log(mean), 0.8, 12_000).astype(int) + 1), minlength=4097)
    planned, placed = packing.shared_plan(histogram)
    assert sum(r for _, r in planned) == -(-int(histogram @ np.arange(4097)) // 4096)
    assert placed > 0.9 * histogram.sum()


def test_turns_number_the_pieces_of_each_length():
    before, seen = np.zeros(8, dtype=np.int64), {}
    for block in ([3, 5, 3, 3], [], [5, 7, 3]):
        got = packing._turns(np.array(block, dtype=np.int64), before).tolist()
        for n, turn in zip(block, got, strict=True):
            assert turn == seen.get(n, 0)
            seen[n] = turn + 1


def test_packing_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_TASK", 3)
    draw = random.Random(5)
    docs = [(k, " ".join(draw.choice(["the", "of", "tion", "Ünder", "x9,"]) for _ in range(draw.choice([0, 1, 5, 40, 300])))) for k in range(120)]
    docs += [(500, None), (501, ""), (501, ""), (None, "the"), (502, "the of")] * 2
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"piece": F.lit("x"), "length": F.lit(-1)})
    placed = packing.packed(df, size=64, with_ids=True).cache()
    rows = placed.collect()
    tokenizer = subwords.word_encoder(subwords.public_tokenizer()).tokenizer
    want = []
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(i if i is not None else -1, k, a, tuple(ids[a : a + 64])) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, tuple(r.ids)) for r in rows) == sorted(want)
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64
    assert len(at) <= -(-sum(r.length for r in rows) // 64) * 1.1 + 1
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(placed).collect()} == at
