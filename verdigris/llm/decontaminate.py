"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of every text, offsets in the original."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_offsets, lean_memory, small_batches

#: Bytes of benchmark text that are taken at most; the automaton needs some 20 bytes of a worker's memory for each.
MOST_ITEM_BYTES = 64 << 20
#: Comparisons of a text's words with items' words that are made at once.
TOGETHER = 1 << 18
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<begin:bigint,end:bigint>>"
_KEPT: dict[str, "Windows"] = {}


def _fold_table() -> bytes:
    """Each byte as scanned: A-Z in lower case, digits and letters and bytes of other characters as they are, the rest a space."""
    table = bytearray(b" " * 256)
    for b in range(256):
        if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A:
            table[b] = b
        elif 0x41 <= b <= 0x5A:
            table[b] = b + 32
    return bytes(table)


FOLD = _fold_table()


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of ASCII letters or digits and of all other characters, A-Z lower-cased."""
    return text.translate(FOLD).split()


class Windows:
    """One automaton for all windows of ``width`` consecutive words of the items.

    Its letters are words. Every window has a whole block of the item's words, blocks being half a
    window (rounded up) long and laid end to end; the automaton finds the blocks, so that it has one
    state for each item word instead of one for each word of each window. Around a block that occurs,
    the text's words are compared with the item's as far as a window can reach. An item of fewer
    words than a window is one pattern as a whole.
    """

    def __init__(self, items: list[tuple[str, bytes]], width: int) -> None:
        self.width, self.block = width, (width + 1) // 2
        self.reach = width - self.block
        self.code: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        gap, flat, owner, at = [-1] * max(1, self.reach), [], [], 0
        blocks: dict[tuple[int, ...], list[int]] = defaultdict(list)
        short: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for k, (_, text) in enumerate(items):
            words = [self.code.setdefault(w, len(self.code) + 1) for w in words_of(text)]
            if 0 < len(words) < width:
                short[tuple(words)].add(k)
            elif words:
                flat += gap + words
                at += len(gap)
                for i in range(0, len(words) - self.block + 1, self.block):
                    blocks[tuple(words[i : i + self.block])].append(at + i)
                owner += [k] * (len(gap) + len(words))
                at += len(words)
        self.flat, self.owner = np.array(flat + gap, dtype=np.int64), np.array(owner, dtype=np.int64)
        patterns = list({**blocks, **short})
        self.found = [(np.array(blocks.get(p, []), dtype=np.int64), sorted(short.get(p, ())), len(p)) for p in patterns]
        self.automaton = None
        if patterns:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for k, pattern in enumerate(patterns):
                self.automaton.add_word(pattern, k)
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, list[str]] | None:
        """Which words are inside an occurrence of a window, and the items whose windows occur; nothing if none do."""
        get = self.code.get
        codes = tuple([get(w, 0) for w in words])
        occurs = list(self.automaton.iter(codes)) if self.automaton is not None and any(codes) else []
        if not occurs:
            return None
        marks, items = np.zeros(len(words) + 1, dtype=np.int64), set()
        begins, places, held = [], [], 0
        text = np.concatenate((np.full(self.reach, -2), codes, np.full(self.reach, -2)))
        for end, k in occurs:
            places_k, whole, size = self.found[k]
            if whole:
                marks[end + 1 - size] += 1
                marks[end + 1] -= 1
                items.update(whole)
            if len(places_k):
                begins.append(np.full(len(places_k), end + 1 - size))
                places.append(places_k)
                held += len(places_k)
                if held > TOGETHER:
                    self._compare(text, np.concatenate(begins), np.concatenate(places), marks, items)
                    begins, places, held = [], [], 0
        if held:
            self._compare(text, np.concatenate(begins), np.concatenate(places), marks, items)
        return (np.cumsum(marks[:-1]) > 0, sorted({self.names[k] for k in items})) if items else None

    def _compare(self, text: np.ndarray, begin: np.ndarray, place: np.ndarray, marks: np.ndarray, items: set[int]) -> None:
        """Mark the text's words in windows around blocks that begin at ``begin`` in the text and at ``place`` in the items."""
        reached = []
        for step, first in ((-1, -1), (1, self.block)):
            same, n = np.ones(len(begin), dtype=bool), np.zeros(len(begin), dtype=np.int64)
            for k in range(self.reach):
                same &= text[self.reach + begin + first + step * k] == self.flat[place + first + step * k]
                n += same
            reached.append(n)
        own = np.flatnonzero(reached[0] + self.block + reached[1] >= self.width)
        np.add.at(marks, begin[own] - reached[0][own], 1)
        np.add.at(marks, begin[own] + self.block + reached[1][own], -1)
        items.update(np.unique(self.owner[place[own]]).tolist())


def kept_windows(items: list[tuple[str, bytes]], width: int, name: str) -> Windows:
    """The worker's automaton of a benchmark, built once for all its tasks."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Windows(items, width)
    return _KEPT[name]


def original_spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as character offsets in the original text."""
    word = np.frombuffer(text.translate(FOLD), dtype=np.uint8) != 32
    padded = np.concatenate(([False], word, [False]))
    begins, ends = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(padded[:-1] & ~padded[1:])
    characters = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    edges = np.concatenate(([False], hit, [False]))
    first, last = np.flatnonzero(edges[1:] & ~edges[:-1]), np.flatnonzero(edges[:-1] & ~edges[1:]) - 1
    return [{"begin": int(characters[begins[a]]), "end": int(characters[ends[b]])} for a, b in zip(first, last, strict=True)]


def scan(text: bytes, built: Windows) -> tuple[int, int, list[str], list[dict[str, int]]]:
    """Words, hit words, items with occurring windows (sorted) and hit spans of one text."""
    words = words_of(text)
    found = built.scan(words)
    if found is None:
        return len(words), 0, [], []
    hit, items = found
    return len(words), int(hit.sum()), items, original_spans(text, hit)


def _scanner(items: list[tuple[str, bytes]], width: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        built = kept_windows(items, width, name)
        for batch in batches:
            data, offsets = binary_offsets(batch.column(1))
            found = [scan(data[a:b].tobytes(), built) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.array([x[2] for x in found], pa.list_(pa.string())),
                    pa.array([x[3] for x in found], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    return run


def _benchmark(benchmark: DataFrame, width: int, most: int) -> tuple[list[tuple[str, bytes]], int, str]:
    """The items in an order of their own, the width and a name of both; a table of more than ``most`` bytes is refused before it is collected."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > most:
        raise ValueError(f"{size} bytes of benchmark text, more than the {most} that every worker is to hold")
    rows = sorted((r["item"], bytes(r["text"])) for r in items.collect())
    digest = hashlib.blake2b(repr(width).encode())
    for row in rows:
        digest.update(repr(row).encode())
    return rows, width, digest.hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_item_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """Where benchmark items occur in documents, by windows of ``width`` consecutive item words.

    Returns doc_id, n_words, n_hit (words inside any occurrence), item_ids (items with occurring
    windows, sorted) and spans (runs of hit words as character offsets in the original text) for
    every row of ``docs`` (doc_id, text); other columns of either table are not read.

    There is one automaton, built once in each worker from the items, and one scan of the texts
    without a shuffle. A benchmark of more than ``most_item_bytes`` of text is an error.

    Cases: null or empty text has no words and no hit; an item with null id or without words
    has no windows; a shorter item is one window; items that share a window are all named; rows
    that repeat a doc_id are scanned each, repeated items are one; empty tables give no hits or no rows.
    """
    base = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return base.mapInArrow(_scanner(*_benchmark(benchmark, width, most_item_bytes)), RESULT)


def _clean(items: list[tuple[str, bytes]], width: int, name: str, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        built = kept_windows(items, width, name)
        for batch in batches:
            data, offsets = binary_offsets(batch.column(text))
            yield batch.filter(pa.array([built.scan(words_of(data[a:b].tobytes())) is None for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_item_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """The rows in whose texts no window occurs, with all their columns, in one scan.

    Cases: as in ``contamination``; rows with null or empty texts stay, repeated rows stay or go each,
    columns of any name stay as they are, an empty table gives no rows.
    """
    return small_batches(docs).mapInArrow(_clean(*_benchmark(benchmark, width, most_item_bytes), docs.columns.index("text")), docs.schema)
