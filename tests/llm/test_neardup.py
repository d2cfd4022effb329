import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import neardup
from verdigris.llm.components import components
from verdigris.llm.neardup_sets import MinMax, shingles, word_hashes

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [(i, shingle_set(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets))


def near_copies(seed, n=160):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "Ñandú", "x!"]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 20, 60, 150]))] for _ in range(12)]
    docs = []
    for k in range(n):
        w = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 8])):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        docs.append((draw.randrange(10**6) * 200 + k, draw.choice([" ", "\n\t "]).join(w) if k % 9 else " ".join(w).upper()))
    return docs + [(-1, None), (-2, ""), (-3, " \n "), (-4, "one"), (-5, "ONE")]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)  # so that blocks of a bucket are dealt out
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 4)
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"node": F.lit("x"), "key": F.lit(1), "component_id": F.lit(0)})
    got = sorted(tuple(r) for r in neardup.near_duplicates(df).collect())
    assert got == brute(docs)


def test_star_of_variants_is_one_group(spark):
    """Variants that are near the base only: no pair of them is linked, whatever represents their bucket."""
    draw = random.Random(1)
    base = [f"b{k}" for k in range(200)]
    docs = [(500, " ".join(base))]
    for k in range(60):
        w = list(base)
        for place in draw.sample(range(0, 200, 5), 4):
            w[place] = f"v{k}"
        docs.append((k, " ".join(w)))
    assert sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()) == brute(docs)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(4, text), (4, text), (None, text), (9, text + " more"), (7, "other")], "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {(4, 4, True), (None, 4, False), (9, 4, False), (7, 7, True)}
    assert sorted(r.doc_id for r in neardup.deduplicated(df).collect()) == [4, 7]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (5, a + " more"), (5, b), (None, a), (None, c), (None, c + " more"), (None, c), (8, ""), (8, ""), (9, None), (9, None), (2, " \x0b"), (6, b + " b")]
    df = spark.createDataFrame([(*r, k, 1) for k, r in enumerate(rows)], "doc_id bigint, text string, key int, __id int")
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in kept.collect())
    assert [x for x in got if x[0] > 0 and x[1].strip()] == [(3, a), (5, b)]
    assert [x for x in got if x[0] == -1] in ([(-1, c)], [(-1, c + " more")])
    assert [x[0] for x in got if not x[1].strip()] == [2, 8, 8, 9, 9]
    assert neardup.deduplicated(df.limit(0)).count() == 0


def test_many_rows_without_ids_meet_their_own_texts_only(spark):
    texts = [" ".join(f"{x}{k}" for k in range(20)) for x in range(40)]
    df = spark.createDataFrame([(None, t) for t in texts * 3] + [(k, t + " more") for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = neardup.near_duplicates(df).collect()
    assert len(got) == 160 and sum(r.kept for r in got) == 40
    assert sorted(r.component_id for r in got if r.doc_id is None) == sorted(list(range(40)) * 3)
    assert len(neardup.deduplicated(df).collect()) == 40


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("verdigris.llm.common.shared_dir", lambda _: f"file://{tmp_path}")
    assert neardup.deduplicated(spark.createDataFrame(near_copies(3), "doc_id bigint, text string")).count() > 0
    left = [p.name for p in tmp_path.iterdir()]
    assert len(left) == 3 and all(x.startswith(("verdigris-neardup-judged", "verdigris-neardup-star", "verdigris-neardup-rest")) for x in left)


def test_long_text_in_stretches():
    text = ("alpha beta " * 200_000 + "x" * 600_000 + " gamma").encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    hashes, first = word_hashes(data, offsets)
    assert len(hashes) == 400_002 and len(set(hashes[:400_000].tolist())) == 2 and first.tolist() == [0, 400_002]
    short = word_hashes(np.frombuffer(b"ALPHA gamma", np.uint8), np.array([0, 11]))[0]
    assert short[0] == hashes[0] and short[1] == hashes[-1]


def test_min_and_max_estimate_without_bias():
    rng = np.random.default_rng(0)
    minmax, share = MinMax(256, 4), []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
        flat = np.concatenate([common, a, common, b])
        s = minmax.sign(flat, np.array([0, 350, 700]))
        share.append((s[0] == s[1]).mean())
    assert abs(np.mean(share) - 0.75) < 0.01 and np.std(share) < 0.03


def test_short_texts_are_one_shingle():
    text = b"a b\0a b c d e"
    hashes, begin = shingles(*word_hashes(np.frombuffer(text, np.uint8), np.array([0, 3, 3, len(text)])), 5)
    assert begin.tolist() == [0, 1, 1, 2]


def test_components_of_chain_and_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 140)} == {100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
