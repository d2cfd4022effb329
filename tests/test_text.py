import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdigris.functions import text as T
from verdigris.operators import chunking, reports, retrieval
from verdigris.operators.index import shared_root


def one(spark, column, *values):
    return [r.x for r in spark.createDataFrame([(v,) for v in values], "t string").select(column(F.col("t")).alias("x")).collect()]


def test_normalize(spark):
    assert one(spark, T.normalize, "  a \t b\r\n\r\n\r\n c \r", "", None) == ["a b\n\nc", "", None]


def test_tokens_and_terms(spark):
    assert one(spark, T.chunk_tokens, "It's well-known: état_1!") == [["It's", "well-known", ":", "état_1", "!"]]
    assert one(spark, T.terms, "It's well-known: État_1!") == [["it's", "well-known", "état", "1"]]
    assert one(spark, T.terms, None, "...") == [[], []]


def test_windows_overlap_and_end_with_the_text(spark):
    text = " ".join(f"w{i}" for i in range(10))
    got = one(spark, lambda c: T.token_windows(c, 4, 1), text, "a b")
    assert got == [["w0 w1 w2 w3", "w3 w4 w5 w6", "w6 w7 w8 w9"], ["a b"]]


def test_clip_and_names(spark):
    assert one(spark, lambda c: T.clip(c, 5), "abc  de", "a\nb", None) == ["abc…", "a b", ""]
    assert one(spark, T.safe_name, " a/b?c ", "..", "x") == ["a_b_c", "source", "x"]


def test_markdown_sections_and_chunks(spark):
    page = "<html><head><style>x</style></head><body><h1>Title</h1><p>One.</p><script>no</script><ul><li>a<li>b</ul><h2>References</h2><p>gone</p><h2>More</h2><p>Two &amp; three.</p></body></html>"
    text, none = one(spark, chunking.markdown, page, None)
    assert text == "# Title\n\nOne.\n\n- a\n- b\n\n## More\n\nTwo & three." and none == ""
    assert [[s.title for s in x] for x in one(spark, chunking.sections, "before\n# A\n\n## B\ntext", "# T\nx", "x", "", None)] == [["Document", "B"], ["T"], ["Document"], [], []]
    (chunks,) = one(spark, lambda c: chunking.section_chunks(c, 8, 2), "one two three. four five six. seven\n\neight nine " + "x " * 30)
    assert all(len(c.replace(".", " .").split()) <= 8 for c in chunks) and chunks[0].startswith("one")


def test_character_references(spark):
    texts = ["a &lt;b&gt; &amp;amp; &eacute;&#233;&#xE9;&#x1F600; &nosuch; & x", "none", "&#0;&#xD800;&#1114112;", None]
    got = one(spark, chunking.unescaped, *texts)
    assert got == ["a <b> &amp; ééé😀 &nosuch; & x", "none", "\ufffd" * 3, None]


def plain_chunks(body, most, overlap):
    """The rule one paragraph after another."""
    count = lambda t: len(re.findall(r"\w+(?:[-']\w+)*|[^\w\s]", t))
    if count(body) <= most:
        return [body]
    out, held = [], []
    for unit in body.split("\n\n"):
        words = re.findall(r"\w+(?:[-']\w+)*|[^\w\s]", unit)
        if len(words) > most:
            out += [*(["\n\n".join(held)] if held else [])]
            held, at = [], 0
            while True:
                out.append(" ".join(words[at : at + most]))
                if at + most >= len(words):
                    break
                at += most - overlap
        else:
            if held and count("\n\n".join([*held, unit])) > most:
                out.append("\n\n".join(held))
                held = []
            held.append(unit)
    return out + (["\n\n".join(held)] if held else [])


def test_chunks_equal_the_rule(spark):
    draw = random.Random(4)
    texts = ["\n\n".join(" ".join(draw.choice(["a", "b-c", "it's", "x."]) for _ in range(draw.choice([1, 3, 7, 8, 9, 25]))) for _ in range(draw.randint(1, 12))) for _ in range(60)]
    got = one(spark, lambda c: chunking.section_chunks(c, 8, 3), *texts)
    assert got == [plain_chunks(t, 8, 3) for t in texts]
    rows = chunking.chunk(spark.createDataFrame([(1, "a\n# B\nc\n\n# C"), (2, None), (3, "")], "doc_id int, text string"), most=8, overlap=3).collect()
    assert [(r.doc_id, r.ordinal, r.chunk_id, r.section, r.text, r.token_count) for r in rows] == [(1, 1, "1::chunk_0001", "Document", "a", 1), (1, 2, "1::chunk_0002", "B", "c", 1)]


def test_bm25_equals_the_formula(spark):
    texts = {1: "liver lesion in the liver", 2: "cyst of the liver", 3: "kidney", 4: "...", 5: None}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id int, text string")
    queries = spark.createDataFrame([("q", "liver liver lesion unknown"), ("e", "...")], "query_id string, query string")
    got = retrieval.search(chunks, queries).collect()
    words = {k: [w for w in (v or "").split() if w.isalpha()] for k, v in texts.items()}
    words = {k: v for k, v in words.items() if v}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for k, v in words.items():
        for term in ("liver", "liver", "lesion"):
            tf, df = Counter(v)[term], sum(term in x for x in words.values())
            if tf:
                want[k] = want.get(k, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(v) / mean))
    assert [r.chunk_id for r in got] == [1, 2] and all(abs(r.score - want[r.chunk_id]) < 1e-9 for r in got)
    assert retrieval.search(chunks.limit(0), queries).count() == 0


@pytest.mark.parametrize(("text", "status"), [("```json\n{\"a\": 1}\n```", "ok"), ("so {\"a\": 1} and {\"a\": 2}", "ambiguous"), ("x {\"a\": 1} {\"a\": 1}", "ok"), ("none {", "missing"), (None, "missing"), ('{"a": {"b": 1}}', "ok"), ('say {"a": {"b": 1}}', "ambiguous"), ('x {"a": "}"} y', "ok"), ("{{\"a\": 1}", "ok"), ("{} {}", "ok"), ("[1]", "missing"), ('```json {"a": 1}``` {"a": 2}', "ok"), ('"{" {"a": 1} "', "ok")])
def test_json_object(text, status):
    assert reports.json_object(text)[1] == status


def test_tokens_of_a_million_hyphenated_parts(spark):
    long = spark.sql("select repeat('a-', 1000000) || 'a' as t, repeat(\"b'\", 1000000) || 'b c' as u")
    row = long.select(F.size(T.terms(F.col("t"))), T.token_count(F.col("t")), F.size(T.terms(F.col("u"))), T.token_count(F.col("u"))).first()
    assert tuple(row) == (1, 1, 2, 2)


def test_a_cluster_without_a_shared_folder_is_refused():
    assert shared_root(None, "local[4]") == shared_root(None, "local") == "file:///tmp/checkpoints"
    assert shared_root("hdfs://x", "yarn") == "hdfs://x"
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_root(None, master)


def test_search_shuffles_neither_postings_nor_hits(spark, monkeypatch):
    from verdigris.operators import index

    draw = random.Random(5)
    docs = [(f"c{i:03}", " ".join(draw.choices(["the"] * 9 + list("abcdefgh"), k=draw.randrange(30))), ["x", "yz"[i % 2]]) for i in range(150)]
    docs += [(f"d{i:03}", "a b the", [None] if i % 3 else None) for i in range(60)]  # one score, ties go by id
    asked = [(i, " ".join(draw.choices(["the", *"abcdefgh"], k=4)), [None, [], ["y"], ["z", "y"]][i % 4]) for i in range(12)] + [(12, "nothing", None), (13, None, None), (14, "a b the", None)]
    chunks, queries = spark.createDataFrame(docs, "chunk_id string, text string, has array<string>"), spark.createDataFrame(asked, "query_id int, query string, wants array<string>")
    texts = {c: t.lower().split() for c, t, _ in docs if t}
    mean, n = sum(map(len, texts.values())) / len(texts), len(texts)
    for filtered in (False, True):
        want = []
        for q, query, wants in asked:
            scores = {}
            for c, _, has in docs:
                if not filtered or not wants or set(wants) & set(has or []):
                    for term in (query or "").split():
                        df, tf = sum(term in t for t in texts.values()), texts.get(c, []).count(term)
                        if tf:
                            scores[c] = scores.get(c, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(texts[c]) / mean))
            want += [(q, k, c, round(s, 9)) for k, (c, s) in enumerate(sorted(((c, round(s, 9)) for c, s in scores.items()), key=lambda x: (-x[1], x[0]))[:4], 1)]
        for cells, gains in ((1 << 22, 200_000), (40, 5)):
            monkeypatch.setattr(retrieval, "MOST_CELLS", cells)
            monkeypatch.setattr(index, "MOST_GAINS", gains)
            found = retrieval.search(chunks, queries, 4, categories="has" if filtered else None, wanted="wants")
            assert sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in found.collect()) == want
            if gains > 5:
                shuffles = re.findall(r"Exchange hashpartitioning\(([^#]*)", found._jdf.queryExecution().executedPlan().toString())
                assert set(shuffles) == {"__query"}


def test_texts_are_parsed_once(spark):
    """No expression over a text stands in a plan twice, as a filter that asks whether it gives anything would make it."""
    pages = spark.createDataFrame([(1, "<h1>A</h1><p>" + "one &amp; two. " * 40 + "</p>"), (2, "<p>short</p>"), (3, None)], "page_id int, html string")
    docs = spark.createDataFrame([("a", "one two one"), ("b", ""), ("c", None)], "chunk_id string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    shown = chunking.to_markdown(pages)
    assert [r.page_id for r in shown.collect()] == [1] and plan(shown).count(chunking.SKIPPED) == 1
    assert plan(chunking.chunk(docs, "chunk_id")).count("#{1,6}") == plan(docs.select(chunking.sections(F.col("text")).alias("s"))).count("#{1,6}")
    posted = retrieval.postings(docs)
    assert sorted(tuple(r) for r in posted.collect()) == [("a", "one", 2), ("a", "two", 1)] and plan(posted).count("[^\\W_]++(?:") == 1
