"""Secret scans: one deterministic automaton for all rules, one pass over the bytes of every text, spans in characters.

The rules' patterns, without what goes on endlessly at their ends, are compiled together into
transition arrays. A text is read once; only where a state says that a rule's match may end there,
that rule's own automata settle where the leftmost match begins (backwards) and how far it goes
(forwards).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Automaton, compiled, head, mirrored, parsed
from .common import binary_offsets, free_name, lean_memory, small_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the least characters of ``group`` (0: the match; shorter ones take their place but are no secret), and whether ASCII letters match in either case.

    From where a match begins, the places where it may end must lie side by side, as they do when
    a pattern ends in one repeated class or has one length; the leftmost of overlapping matches counts.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False


#: The three kinds that are always sought, in this order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds with a form of their own: repository, chat, map and payment keys, signed web tokens, private keys, passwords in addresses.
MORE = (
    Rule("repository", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("payment", r"[prs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
)
RULES = (*BASE, *MORE)
FOUND = "doc_id bigint, spans array<struct<kind:string,begin:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))


class Scanner:
    """All rules' automaton and, for each rule, one that finds an end, one that finds the beginning before it, and one that goes on from a beginning."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = rules
        trees = [parsed(r.pattern, r.any_case) for r in rules]
        self.all = compiled([head(t) for t in trees], True)
        self.finds = [compiled([t], True) for t in trees]
        self.backs = [compiled([mirrored(t)], False) for t in trees]
        self.goes = [compiled([t], False) for t in trees]
        self.exact = [re.compile(r.pattern.encode(), re.IGNORECASE if r.any_case else 0) for r in rules]
        if any(a.start >= a.ending for a in self.finds):
            raise ValueError("a rule matches the empty text")

    def fast(self) -> list[int]:
        """The common automaton's steps as a worker scans with them."""
        return self.all.steps.tolist()


def _longest(a: Automaton, data: bytes, at: int, stop: int, step: int) -> int:
    """The last place up to which a match goes from ``at`` in the direction of ``step``; ``at`` if there is none."""
    state, best, steps = a.start, at, a.steps
    while at != stop and state != a.dead:
        state = int(steps[state + a.kinds[data[at if step > 0 else at - 1]]])
        at += step
        if state >= a.ending:
            best = at
    return best


def matches(data: bytes, scanner: Scanner, steps: list[int]) -> list[tuple[int, int, int]]:
    """(begin, rule, end) of all secrets of a text, in bytes, in that order. Work is linear in the text for each rule that occurs in it."""
    common = scanner.all
    state, ending, ends, width = common.start, common.ending, common.ends, common.width
    out: list[tuple[int, int, int]] = []
    after = [0] * len(scanner.rules)  # where the rule's last match ends: the next one begins there at the earliest
    read = [0] * len(scanner.rules)  # how far the rule's own automaton has read, and its state there
    own = [f.start for f in scanner.finds]
    for at, kind in enumerate(data.translate(common.kinds)):
        state = steps[state + kind]
        if state >= ending:
            for r in ends[(state - ending) // width]:
                if read[r] > at:
                    continue
                find = scanner.finds[r]
                held, moves = own[r], find.steps
                for b in data[read[r] : at + 1].translate(find.kinds):
                    held = int(moves[held + b])
                read[r], own[r] = at + 1, held
                if held < find.ending:
                    continue  # what ends here begins inside the last match
                begin = _longest(scanner.backs[r], data, at + 1, after[r], -1)
                end = _longest(scanner.goes[r], data, begin, len(data), 1)
                rule = scanner.rules[r]
                if rule.least == 0 or len(scanner.exact[r].fullmatch(data, begin, end)[rule.group]) >= rule.least:
                    out.append((begin, r, end))
                after[r] = read[r] = end
                own[r] = find.start
    return sorted(out)


def _characters(data: bytes, places: Sequence[int]) -> list[int]:
    """How many characters begin before each byte."""
    begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return [int(begins[p - 1]) if p else 0 for p in places]


def _spans(data: bytes, scanner: Scanner, steps: list[int]) -> list[dict]:
    found = matches(data, scanner, steps)
    if not found:
        return []
    begins, ends = _characters(data, [f[0] for f in found]), _characters(data, [f[2] for f in found])
    return [{"kind": scanner.rules[r].kind, "begin": a, "end": b} for (_, r, _), a, b in zip(found, begins, ends, strict=True)]


def _shared(spark: SparkSession, rules: Sequence[Rule]) -> Broadcast:
    """The compiled rules on every worker; their size is bounded by ``automaton.MOST_STATES``."""
    return spark.sparkContext.broadcast(Scanner(tuple(rules)))


def secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and the spans (kind, begin, end in characters) of every row's secrets, by begin, then by the rules' order; only doc_id and text are read.

    Of each rule the leftmost matches that do not overlap count, each as long as it goes; matches of
    different rules may overlap. Texts are read once, in place, without a shuffle.

    Cases: null and empty texts have no spans; very long texts cost time in proportion to their length,
    whatever they hold; rows that repeat a doc_id are scanned each; an empty table gives no rows;
    bytes that are no UTF-8 match no rule and count as characters unless they continue one.
    """
    shared = _shared(docs.sparkSession, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        scanner = shared.value
        steps = scanner.fast()
        for batch in batches:
            data, offsets = binary_offsets(batch.column(1))
            found = [_spans(data[a:b].tobytes(), scanner, steps) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])

    base = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return base.mapInArrow(run, FOUND)


def redacted(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[{}]") -> DataFrame:
    """All rows and columns, each secret in ``text`` replaced by its kind's mark; ``n_secrets`` (a free name) counts spans. Overlapping spans become one, of the first one's kind. Null texts stay null."""
    shared = _shared(docs.sparkSession, rules)
    at, name = docs.columns.index("text"), free_name(docs, "n_secrets")

    def clean(data: bytes, scanner: Scanner, steps: list[int]) -> tuple[bytes, int]:
        found = matches(data, scanner, steps)
        out, end = [], 0
        for a, r, b in found:
            if a >= end:
                out += [data[end:a], mark.format(scanner.rules[r].kind).encode()]
            end = max(end, b)
        return b"".join([*out, data[end:]]), len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        scanner = shared.value
        steps = scanner.fast()
        for batch in batches:
            column = batch.column(at)
            data, offsets = binary_offsets(column)
            done = [clean(data[a:b].tobytes(), scanner, steps) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            texts = pa.array([d if ok else None for (d, _), ok in zip(done, column.is_valid().to_pylist(), strict=True)], pa.binary())
            yield pa.record_batch([*batch.columns[:at], texts, *batch.columns[at + 1 :], pa.array([n for _, n in done], pa.int64())], names=[*batch.schema.names, name])

    raw = [F.col(f"`{c}`").cast("binary").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    bare = small_batches(docs).select(*raw)
    out = bare.mapInArrow(run, T.StructType([*bare.schema.fields, T.StructField(name, T.LongType())]))
    return out.withColumn("text", F.col("text").cast(docs.schema["text"].dataType))
