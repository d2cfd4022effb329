"""HTML to Markdown, Markdown to sections and chunks, as column expressions inside each row: nothing is shuffled, whatever a document's size."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What separates blocks, what is skipped, and headings whose sections are left out.
BLOCKS = "p|div|section|article|br|tr|table|blockquote"
SKIPPED = "script|style|noscript|svg|math"
BOILERPLATE = "pubmed disclaimer|copyright|conflict of interest|competing interests|references|acknowledgments|acknowledgements"
LEAST_CHARACTERS = 100

#: A line end and a blank line that a tag asks for; several of them in a row become one.
_END, _BLANK = "\x01", "\x02"
#: Tags and what takes their place, in this order.
_TAGS = (
    (r"(?s)<!--.*?-->", ""),
    (rf"(?is)<({SKIPPED})\b[^>]*>.*?(?:</\1\s*>|\z)", ""),
    (r">\s+(?=<)", ">"),
    *((rf"(?i)<h{k}\b[^>]*>", f"{_BLANK}{'#' * k} ") for k in range(1, 7)),
    (rf"(?i)</(?:h[1-6]|{BLOCKS})\s*>", _BLANK),
    (r"(?i)<li\b[^>]*>", f"{_END}- "),
    (rf"(?i)</li\s*>|<(?:{BLOCKS})\b[^>]*>", _END),
    (r"</?[A-Za-z!?][^>]*>", ""),
)
_HEADING = r"^#{1,6}\s+(.+?)\s*$"


def _replaced(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def unescaped(text: Column) -> Column:
    """Character references (decimal, hexadecimal, and the names of the language's own table) as characters; unknown names stay."""
    return T.bound(text, _unescaped)


def _unescaped(text: Column) -> Column:
    reference = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
    named = F.create_map(*[F.lit(x) for item in sorted(name2codepoint.items()) for x in item])

    def character(name: Column) -> Column:
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10).cast("int")).when(name.startswith("#"), F.substring(name, 2, 8).cast("int")).otherwise(F.element_at(named, name))
        there = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(number.isNull(), F.concat(F.lit("&"), name, F.lit(";"))).when(there, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")

    names = F.regexp_extract_all(text, F.lit(reference), F.lit(1))
    parts = F.zip_with(F.split(text, reference, -1), names, lambda part, name: F.array(part, F.when(name.isNull(), "").otherwise(character(name))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.flatten(parts), "")).otherwise(text)


def markdown(page: Column) -> Column:
    """A page's Markdown without boilerplate sections: headings get their number signs, list items a dash, blocks their own lines."""
    shown = unescaped(_replaced(F.coalesce(page, F.lit("")), *_TAGS))
    lines = _replaced(shown, (r"(?U)\s+", " "), (f"[ {_END}]*{_BLANK}[ {_END}{_BLANK}]*", "\n\n"), (f" *{_END}[ {_END}]*", "\n"))
    return without_boilerplate(T.normalize(lines))


def _parted(lines: Column, edge: Callable[[Column], Column]) -> Column:
    """Lines cut before each one that ``edge`` holds for: array of arrays; what comes before the first is the first part, be it empty."""

    def parts(lines: Column, at: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: F.slice(lines, F.get(at, k), F.get(at, k + 1) - F.get(at, k)))

    edges = lambda lines: F.concat(F.array(F.lit(1)), F.filter(F.transform(lines, lambda line, k: F.when(edge(line), k + 1)), lambda k: k.isNotNull()), F.array(F.size(lines) + 1))
    return T.bound(lines, lambda own: T.bound(edges(own), lambda at: parts(own, at)))


def without_boilerplate(text: Column) -> Column:
    """Lines from a boilerplate heading (with or without number signs) on are left out until the next heading."""
    starts = lambda line: F.regexp_replace(F.lower(line), r"^[\s#]+|[\s#]+$", "").rlike(f"^(?:{BOILERPLATE})(?: |$)")
    parts = _parted(F.split(text, "\n"), lambda line: line.startswith("#") | starts(line))
    kept = F.filter(parts, lambda part: (F.size(part) > 0) & ~starts(F.coalesce(F.get(part, F.lit(0)), F.lit(""))))
    return T.normalize(F.array_join(F.flatten(kept), "\n"))


def sections(text: Column) -> Column:
    """Array of (title, body) of what follows each heading; text before the first one is called Document; empty sections are left out."""

    def section(part: Column) -> Column:
        titled = F.coalesce(F.get(part, F.lit(0)).rlike(_HEADING), F.lit(False))
        title = F.when(titled, F.regexp_extract(F.get(part, F.lit(0)), _HEADING, 1)).otherwise("Document")
        body = F.when(titled, F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))).otherwise(part)
        return F.struct(title.alias("title"), T.normalize(F.array_join(body, "\n")).alias("body"))

    parts = _parted(F.split(T.normalize(F.coalesce(text, F.lit(""))), "\n"), lambda line: line.rlike(_HEADING))
    return F.filter(F.transform(parts, section), lambda s: s["body"] != "")


def _begins(counts: Column, most: int) -> Column:
    """Where chunks of units with these token counts begin, and the number of units: at the first unit, where a count would go over ``most``, and at and behind a unit that is too long by itself."""
    full = F.lit(most + 1)
    start = F.struct(F.array().cast("array<int>").alias("begins"), full.alias("used"), F.lit(0).alias("k"))

    def step(state: Column, n: Column) -> Column:
        new = (state["used"] + n > most) | (state["used"] > most)
        begins = F.when(new, F.array_append(state["begins"], state["k"])).otherwise(state["begins"])
        used = F.when(n > most, full).when(new, n).otherwise(state["used"] + n)
        return F.struct(begins.alias("begins"), used.alias("used"), (state["k"] + 1).alias("k"))

    return F.aggregate(counts, start, step, lambda state: F.array_append(state["begins"], state["k"]))


def packed_units(units: Column, most: int, overlap: int) -> Column:
    """Units joined by blank lines while their tokens fit, a fold over their counts; one that never fits is cut into windows."""

    def chunks(units: Column, begins: Column) -> Column:
        groups = F.transform(F.slice(begins, 1, F.greatest(F.size(begins) - 1, F.lit(0))), lambda a, i: F.array_join(F.slice(units, a + 1, F.get(begins, i + 1) - a), "\n\n"))
        return F.flatten(F.transform(groups, lambda g: T.token_windows(g, most, overlap)))

    return T.bound(units, lambda own: T.bound(_begins(F.transform(own, T.token_count), most), lambda begins: chunks(own, begins)))


def section_chunks(body: Column, most: int, overlap: int) -> Column:
    """A section's chunks of at most ``most`` tokens: the whole if it fits, else its paragraphs packed, too long ones as token windows."""
    return F.when(T.token_count(body) <= most, F.array(body)).otherwise(packed_units(T.paragraphs(body), most, overlap))


def to_markdown(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = LEAST_CHARACTERS) -> DataFrame:
    """(key, markdown) of pages whose text has at least ``least`` characters; null pages have none."""
    return T.exploded(pages, [key], F.filter(F.array(markdown(F.col(html))), lambda m: F.length(m) >= least), "markdown")


def chunk(documents: DataFrame, key: str = "doc_id", text: str = "text", most: int = 350, overlap: int = 50) -> DataFrame:
    """(key, ordinal, chunk_id, section, text, token_count): chunk ids are key::chunk_0001 and on. Null texts have no chunks."""
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("0 <= overlap < most")
    chunks = F.flatten(F.transform(sections(F.col(text)), lambda s: F.transform(section_chunks(s["body"], most, overlap), lambda c: F.struct(s["title"].alias("section"), c.alias("text")))))
    out = T.exploded(documents, [key], chunks, "k", "c").select(F.col(key), (F.col("k") + 1).alias("ordinal"), "c.section", "c.text")
    name = F.concat(F.col(key).cast("string"), F.lit("::chunk_"), F.when(F.col("ordinal") < 10_000, F.lpad(F.col("ordinal").cast("string"), 4, "0")).otherwise(F.col("ordinal").cast("string")))
    return out.select(key, "ordinal", name.alias("chunk_id"), "section", "text", T.token_count(F.col("text")).alias("token_count"))


def with_provenance(chunks: DataFrame, sources: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds each chunk's sha256 over its source's metadata (source_id, title, url, categories) and its text."""
    joined = chunks.join(sources, key)
    return joined.withColumn("sha256", T.provenance_hash(F.col(key), F.col("source_id"), F.col("title"), F.col("url"), F.col("section"), F.col("categories"), F.col("text")))
