"""Text normalizers, tokenizers and identifiers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two token patterns. A chunk's tokens are words (with inner - and ') and single
#: signs; search terms are letters and digits (with inner - and '), in lower case.
#: Repeats are possessive, which finds the same tokens without a stack that grows with them.
CHUNK_TOKEN = r"(?U)\w++(?:[-']\w++)*+|[^\w\s]"
TERM = r"(?U)[^\W_]++(?:[-'][^\W_]++)*+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is read; inside lambdas nothing else shares work."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(rows: DataFrame, keep: Sequence[str | Column], values: Column, *names: str) -> DataFrame:
    """``keep`` and a row for each element of ``values``, none of them null; two names are for its place and itself.

    A plain explode lets Spark ask beforehand whether there are elements at all, which computes ``values`` once more for that.
    """
    explode = F.explode_outer if len(names) == 1 else F.posexplode_outer
    return rows.select(*keep, explode(values).alias(*names)).where(F.col(names[-1]).isNotNull())


def normalize(text: Column) -> Column:
    """Unix line ends, single spaces, stripped lines, at most one blank line in a row, no blank ends."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    stripped = F.regexp_replace(lines, r"(?Umd)^[^\S\n]+|[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def chunk_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHUNK_TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(chunk_tokens(text))


def terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower)


def paragraphs(text: Column) -> Column:
    """Non-empty normalized parts between blank lines."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), normalize), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Non-empty normalized parts; a sentence ends at . ! ? ; or : before white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?;:])\s+"), normalize), lambda s: s != "")


def token_windows(text: Column, most: int, overlap: int) -> Column:
    """Windows of at most ``most`` tokens, each beginning most - overlap later; the last one ends with the text.

    A text that fits is its own only window, unchanged.
    """
    step = max(1, most - overlap)

    def cut(tokens: Column) -> Column:
        count = F.ceil(F.greatest(F.size(tokens) - most, F.lit(0)) / F.lit(step)).cast("int")
        return F.when(F.size(tokens) <= most, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), count), lambda k: F.array_join(F.slice(tokens, k * step + 1, F.lit(most)), " ")))

    return bound(chunk_tokens(text), cut)


def clip(text: Column, most: int) -> Column:
    """White space collapsed; cut to ``most`` characters with an ellipsis in the last place."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, max(0, most - 1))), F.lit("…")))


def safe_name(text: Column) -> Column:
    """Runs of other characters than A-Z a-z 0-9 _ . : - become _; no . or _ at the ends; never empty."""
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9_.:-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(cleaned == "", "source").otherwise(cleaned)


def short_hash(*parts: Column, length: int) -> Column:
    """The first characters of the SHA-256 of the parts with a zero byte between them."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts).cast("binary"), 256), 1, length)


def namespace(identifier: Column) -> Column:
    """What stands before the first hyphen, lower-cased."""
    return F.lower(F.substring_index(F.trim(identifier), "-", 1))


def provenance_hash(doc_id: Column, source_id: Column, title: Column, url: Column, section: Column, categories: Column, text: Column) -> Column:
    """SHA-256 of a chunk's header lines, a blank line and its text."""
    lines = [("doc_id", doc_id), ("source_id", source_id), ("title", title), ("url", url), ("section", section), ("categories", F.array_join(categories, ","))]
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{name}:"), F.coalesce(value.cast("string"), F.lit("None"))) for name, value in lines], F.lit(""), text), 256)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are none."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def stripped_of_accents(text: Column) -> Column:
    return F.translate(F.lower(F.trim(text)), "áâãéêíóôõúç", "aaaeeiooouc")
