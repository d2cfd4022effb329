import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from verdigris.llm.decontaminate import Windows, contamination, decontaminated, scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, width=10):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            size = min(width, len(b))
            for k in range(len(b) - size + 1) if b and item is not None else ():
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == b[k : k + size]:
                        hit |= set(range(j, j + size))
                        found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def cases():
    draw = random.Random(3)
    vocabulary = ["a", "b", "É", "Ω", "7", "cd"]
    text = lambda n: "".join(draw.choice(vocabulary) + draw.choice([" ", "-", "\n", "!! "]) for _ in range(n))
    items = [(k, text(draw.choice([3, 9, 10, 14]))) for k in range(12)] + [(50, None), (51, "..."), (None, "a b c"), (52, "É")]
    docs = [(k, text(draw.choice([0, 2, 30, 80]))) for k in range(30)] + [(90, None), (91, ""), (92, text(5) + items[3][1].upper() + text(4)), (93, items[2][1]), (94, "x" * 300_000)]
    return docs, items


@pytest.mark.parametrize("width", [10, 7, 2, 1])
def test_equals_brute_force(spark, width):
    docs, items = cases()
    # other columns with the result's names are not read
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"n_words": F.lit("x"), "spans": F.lit(1), "item_ids": F.lit(None).cast("int")})
    got = contamination(df, spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1)), width).collect()
    want = brute(docs, items, width)
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in got} == want
    texts = dict(docs)
    for r in got:  # spans name hit words in the original text
        assert sum(len(words(texts[r.doc_id][s.begin : s.end])) for s in r.spans) == r.n_hit


def test_repeated_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "ONE, two: three")] * 2 + [(None, "one two three")], "doc_id bigint, text string")
    assert [r.n_hit for r in contamination(docs, items).collect()] == [3, 3, 3]
    assert contamination(docs.limit(0), items).count() == 0
    assert contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminated(docs, items).count() == 0 and decontaminated(docs, items.limit(0)).count() == 3


def test_filter_keeps_rows_and_columns(spark):
    docs, items = cases()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("lang", F.lit("x"))
    clean = {i for i, (_, n, _) in brute(docs, items).items() if not n}
    table = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminated(df, table)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == clean
    with pytest.raises(ValueError):
        decontaminated(df, table, most_item_bytes=60)


def test_many_items_and_occurrences_of_one_block(monkeypatch):
    monkeypatch.setattr("verdigris.llm.decontaminate.TOGETHER", 50)
    draw = random.Random(8)
    items = [(k, " ".join(draw.choice("abc") for _ in range(draw.choice([4, 10, 11, 30])))) for k in range(40)]
    text = " ".join(draw.choice("abcd") for _ in range(400))
    built = Windows([(str(k), t.encode()) for k, t in items], 6)
    n, hits, found, _ = scan(text.encode(), built)
    assert {0: (n, hits, found)} == brute([(0, text)], items, 6)


def test_query_digest(spark):
    from verdigris.llm import queries

    assert hashlib.sha256(b"").hexdigest() == queries.op1_decontaminate(spark, "/root/testdata/sf0.001").where("n_hit = 0").first().items_sha256
