"""Secrets in whole texts: one pass of a combined automaton over the bytes of many documents.

All rules are compiled into one minimal deterministic automaton that may begin a match anywhere. Texts are cut
at bytes that lead every state back to the start, so the pieces are independent and step through the
transition arrays side by side. A piece in which a rule's state accepts is looked at by that rule's own
automaton, which gives the leftmost longest matches one after the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bankspark.llm.automaton import Automaton, Matcher, compiled
from bankspark.llm.words import slices, texts


@dataclass(frozen=True)
class Rule:
    """``scan`` is what the pass looks for, where the pattern would make it large: every match that is long enough
    holds it. ``least`` is the number of bytes a match must have, besides what ``value`` matches at its start."""

    kind: str
    pattern: str
    least: int = 0
    scan: str | None = None
    value: str | None = None


_NAME = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
BASE = ("assign", "access", "hex")
# The base kinds, and public shapes of well-known keys.
RULES = (
    Rule("assign", _NAME + "[A-Za-z0-9+/_.=-]+", 6, value=_NAME),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24, scan="[0-9a-f]{16}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40, scan="gh[pousr]_[A-Za-z0-9]"),
    Rule("google", "AIza[0-9A-Za-z_-]+", 39, scan="AIza[0-9A-Za-z_-]"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15, scan="xox[abprs]-[A-Za-z0-9-]"),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]+", 24, scan="[sr]k_live_[A-Za-z0-9]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", scan="eyJ[A-Za-z0-9_-]"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", scan="-----BEGIN [A-Z]"),
)
PIECE, SIDE_BY_SIDE = 512, 24
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def accepted(automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rules that accept somewhere in each piece, as bits."""
    order = np.argsort(starts - ends, kind="stable")
    at, sizes = starts[order].copy(), (ends - starts)[order]
    groups = automaton.next.shape[1]
    flat = (automaton.next * groups).ravel()
    accepts = np.repeat(automaton.accepts, groups)
    group_of = automaton.group_of.astype(np.int32)
    state, found = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
    step, longest = 0, int(sizes[0]) if len(sizes) else 0
    while step < longest:
        n = int(np.searchsorted(-sizes, -step, side="left"))
        if n < SIDE_BY_SIDE:
            break
        state[:n] = flat[state[:n] + group_of[data[at[:n] + step]]]
        found[:n] |= accepts[state[:n]]
        step += 1
    else:
        n = 0
    # The few longest pieces are faster one at a time.
    table, bits, group = flat.tolist(), accepts.tolist(), group_of.tolist()
    for k in range(n):
        s, seen = int(state[k]), 0
        for b in data[at[k] + step : at[k] + sizes[k]].tobytes():
            s = table[s + group[b]]
            seen |= bits[s]
        found[k] |= seen
    out = np.empty_like(found)
    out[order] = found
    return out


class Scanner:
    """The compiled rules; made once and sent to the tasks."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.automaton = compiled([r.scan or r.pattern for r in rules], anywhere=True)
        # Bytes that no match goes over: they lead to the start in the pass and in every rule's full pattern.
        self.resets = np.logical_and.reduce([self.automaton.resets, *[compiled([r.pattern], anywhere=True).resets for r in rules]])
        if not self.resets[10]:
            raise ValueError("a rule goes over line ends")
        self.matchers = [Matcher(r.pattern) for r in rules]
        self.names = [Matcher(r.value) if r.value else None for r in rules]

    def __call__(self, documents: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """Spans of each document in bytes, by start, then by rule."""
        data = b"\n".join(documents) + b"\n"
        array = np.frombuffer(data, np.uint8)
        resets = np.flatnonzero(self.resets[array]) + 1
        cuts = resets[np.unique(np.minimum(np.searchsorted(resets, np.arange(PIECE, len(data) + PIECE, PIECE)), len(resets) - 1))]
        starts = np.concatenate(([0], cuts[:-1]))
        bits = accepted(self.automaton, array, starts, cuts)
        ends = np.cumsum([len(d) + 1 for d in documents])
        out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
        for k in np.flatnonzero(bits).tolist():
            piece = data[starts[k] : cuts[k]]
            for rule in range(len(self.rules)):
                if bits[k] >> rule & 1:
                    for low, high in self.matchers[rule].spans(piece):
                        if self._long_enough(rule, piece[low:high]):
                            at = int(starts[k]) + low
                            d = int(np.searchsorted(ends, at, side="right"))
                            base = int(ends[d]) - len(documents[d]) - 1
                            out[d].append((at - base, rule, at - base + high - low))
        return [[(self.rules[r].kind, low, high) for low, r, high in sorted(spans)] for spans in out]

    def _long_enough(self, rule: int, match: bytes) -> bool:
        name = self.names[rule]
        before = next(name.spans(match))[1] if name else 0
        return len(match) - before >= self.rules[rule].least


def _code_points(document: bytes, spans: list[tuple[str, int, int]]) -> list[dict]:
    if spans and not document.isascii():
        before = np.concatenate(([0], np.cumsum((np.frombuffer(document, np.uint8) & 0xC0) != 0x80)))
        spans = [(kind, int(before[low]), int(before[high])) for kind, low, high in spans]
    return [{"kind": kind, "start": low, "end": high} for kind, low, high in spans]


def _find(scanner: Scanner):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches):
        for batch in slices(batches):
            documents = texts(batch.column("text"))
            found = [_code_points(d, s) for d, s in zip(documents, scanner(documents))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return find


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``spans`` of kind, start and end in code points, by start, then kind as listed.

    Per kind the matches are leftmost and don't overlap; those whose value is too short are left out. A null or
    empty text has none. Repeated rows give a row each; other columns are left out. The work grows with the length of a
    text, also for very long ones that look like keys throughout.
    """
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return named.mapInArrow(_find(Scanner(rules)), f"doc_id bigint, spans {SPANS}")


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
