"""Token counts of sections: whole documents are encoded once, token spans are joined with section spans, crossing tokens go by a rule."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, small_batches

#: How a token that crosses a boundary is counted: for the section of its first byte, for the one
#: that holds most of its bytes (the earlier of equals), or for each one by its share of the bytes.
RULES = ("first", "largest", "share")
#: Runs of white space, as the tokenizer's pattern knows it, from this length on are cut out before the pattern runs: it remembers a state for each character of a run.
LONG_SPACE = 100_000
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_SPACES = re.compile(f"(?<!{_BLANK}){_BLANK}{{{LONG_SPACE},}}")
RESULT = "doc_id bigint, section int, begin bigint, end bigint, n_tokens double"
_ENCODINGS: dict[str, tuple] = {}


def encoding(path: str) -> tuple:
    """A byte-level BPE encoding from a file of ranks, and each token's number of bytes; kept by the worker."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _ENCODINGS[path] = (tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes)
    return _ENCODINGS[path]


def public_ranks() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def encoded(coder, text: str) -> np.ndarray:
    """Ids of a text, with white space of any length in it.

    The pattern takes a run of white space as one piece, but for the run's last character where
    text follows. Cut there, a long run is encoded as the piece that it is and what is around it as before.
    """
    if len(text) < LONG_SPACE or not (runs := list(_LONG_SPACES.finditer(text))):
        return coder.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0
    for run in runs:
        end = run.end() - (run.end() < len(text))
        parts += [coder.encode_to_numpy(text[at : run.start()], disallowed_special=()), np.array(coder._encode_single_piece(text[run.start() : end]), dtype=np.uint32)]
        at = end
    return np.concatenate([*parts, coder.encode_to_numpy(text[at:], disallowed_special=())])


def line_bounds(text: bytes) -> np.ndarray:
    """Byte offsets at which lines begin, and the end; a line has its line feed. An empty text is one empty line."""
    feeds = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    bounds = np.concatenate(([0], feeds, [len(text)]))
    return bounds[:-1] if len(bounds) > 2 and bounds[-1] == bounds[-2] else bounds


def readable(text: bytes) -> tuple[bytes, str]:
    """A text's bytes and characters; what is no UTF-8 is replaced in both, so that offsets in one fit the other."""
    try:
        return text, text.decode()
    except UnicodeDecodeError:
        shown = text.decode("utf-8", "replace")
        return shown.encode(), shown


def attributed(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. Tokens end at ``ends`` (each begins where the last one ended), sections are [bounds[i], bounds[i + 1])."""
    if not len(ends):
        return np.zeros(len(bounds) - 1)
    begins = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(bounds, begins, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    counts = np.bincount(first, minlength=len(bounds) - 1).astype(np.float64)
    if rule == "first":
        return counts
    for t in np.flatnonzero(last > first):
        parts = np.arange(first[t], last[t] + 1)
        shares = np.minimum(bounds[parts + 1], ends[t]) - np.maximum(bounds[parts], begins[t])
        counts[first[t]] -= 1
        if rule == "largest":
            counts[parts[int(shares.argmax())]] += 1
        else:
            counts[parts] += shares / (ends[t] - begins[t])
    return counts


def _counter(path: str, rule: str, bounds_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoding(path)
        for batch, data, offsets in blocks(batches, 1, 1 << 20):
            raw = data.tobytes()
            rows, section, begin, end, counts = [], [], [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                text, shown = readable(raw[a:b])
                ids = encoded(coder, shown)
                bounds = bounds_of(text)
                characters = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                rows.append(np.full(len(bounds) - 1, i))
                section.append(np.arange(len(bounds) - 1))
                at = characters[bounds]
                begin.append(at[:-1])
                end.append(at[1:])
                counts.append(attributed(np.cumsum(sizes[ids]), bounds, rule))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(section).astype(np.int32)), pa.array(np.concatenate(begin)), pa.array(np.concatenate(end)), pa.array(np.concatenate(counts))],
                names=["doc_id", "section", "begin", "end", "n_tokens"],
            )

    return run


def section_tokens(docs: DataFrame, rule: str = "largest", path: str | None = None, bounds_of=line_bounds) -> DataFrame:
    """Tokens of each section of each row of ``docs`` (doc_id, text).

    Returns doc_id, section (from 0), begin and end (character offsets) and n_tokens. Sections
    are lines unless ``bounds_of`` cuts otherwise; they cover the text, so their counts add up
    to the document's. The text is encoded as a whole, because cut texts have other tokens;
    a token's bytes give its span, which a sorted search joins with the sections' spans.
    One scan, no shuffle, and a worker holds a few megabytes of text.

    Cases: a null or empty text has one empty section without tokens; empty lines are sections
    with whatever tokens the rule gives them; bytes that are no UTF-8 count as the replacement
    character, in tokens and offsets; texts, and runs of white space in them, may have any length; repeated rows are counted each; other columns
    are not read; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    base = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return base.mapInArrow(_counter(path or public_ranks(), rule, bounds_of), RESULT)


def field_tokens(rows: DataFrame, key: str, fields: list[str], separator: str = "\n", rule: str = "largest", path: str | None = None) -> DataFrame:
    """Tokens of each of several text columns when they are encoded as one text, joined by a separator.

    Returns the key, field and n_tokens; the separator's tokens are counted for the field before
    it. Null fields are empty, and bytes that are no UTF-8 are replaced field by field. The fields' own byte lengths bound the sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path, names, gap = path or public_ranks(), list(fields), separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoding(path)
        for batch in batches:
            columns = [batch.column(k + 1).to_pylist() for k in range(len(names))]
            counts = []
            for parts in zip(*columns, strict=True):
                pieces = [readable(p or b"")[0] + (gap if k + 1 < len(names) else b"") for k, p in enumerate(parts)]
                ids = encoded(coder, b"".join(pieces).decode())
                counts.append(attributed(np.cumsum(sizes[ids]), np.concatenate(([0], np.cumsum([len(p) for p in pieces]))), rule))
            flat = np.concatenate(counts) if counts else np.zeros(0)
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(names)))), pa.array(names * batch.num_rows, pa.string()), pa.array(flat)], names=[key, "field", "n_tokens"])

    base = rows.select(key, *[F.col(f).cast("binary").alias(f"part{k}") for k, f in enumerate(names)])
    return base.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, field string, n_tokens double")
