"""Secret scans with one combined deterministic automaton.

All rules are compiled together: Thompson fragments, subset construction over
byte classes, then minimisation into one flat transition array. A text is
scanned once, byte by byte; the state number alone tells which rules accept.
A rule's match ends where its run of accepting positions ends, and the rule's
own reversed automaton walks back from there to the leftmost start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a byte pattern without look-around; ``check`` must match the whole found span."""

    kind: str
    pattern: bytes
    check: bytes | None = None


_KEYWORDS = rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"

#: The three base kinds, in their listed order.
BASE_RULES = (
    Rule("assign", _KEYWORDS + rb"[A-Za-z0-9+/_.=-]+", _KEYWORDS + rb"[A-Za-z0-9+/_.=-]{8,}"),
    Rule("access", rb"AKIA[A-Z0-9]+", rb"AKIA[A-Z0-9]{12,}"),
    Rule("hex", rb"[0-9a-f]{6,}", rb"[0-9a-f]{32,}"),
)
#: Public shapes of well-known credentials. Lengths are checked after the
#: match, as counted repeats of several rules would multiply the automaton's states.
MORE_RULES = (
    Rule("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]+", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
)
FINDING = "array<struct<kind:string,start:int,end:int>>"


class _Pattern:
    """A rule's pattern as nested tuples: bytes, sequences, alternatives, repeats.

    Knows what rules need: literals, escapes, classes with ranges, groups
    (``(?:``, ``(?i:``), alternatives and the quantifiers ``* + ? {m} {m,} {m,n}``.
    """

    _ESCAPES = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}

    def __init__(self, pattern: bytes):
        self.text, self.at = pattern.decode("latin-1"), 0

    def parse(self, fold: bool = False) -> tuple:
        ways = [self._sequence(fold)]
        while self.text[self.at : self.at + 1] == "|":
            self.at += 1
            ways.append(self._sequence(fold))
        return ways[0] if len(ways) == 1 else ("any", ways)

    def _sequence(self, fold: bool) -> tuple:
        items = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            items.append(self._repeated(self._one(fold)))
        return ("all", items)

    def _one(self, fold: bool) -> tuple:
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            head = re.match(r"\?(i?):", self.text[self.at :])
            self.at += len(head[0]) if head else 0
            inner = self.parse(fold or bool(head and head[1]))
            if self.text[self.at : self.at + 1] != ")":
                raise ValueError("an open group")
            self.at += 1
            return inner
        found = self._class() if c == "[" else frozenset(range(256)) - {10} if c == "." else frozenset([self._byte(c)])
        return ("byte", found | {b ^ 32 for b in found if 65 <= b & 223 <= 90} if fold else found)

    def _byte(self, c: str) -> int:
        if c in "*+?{":
            raise ValueError(f"nothing to repeat before {c}")
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum() and c not in self._ESCAPES:
            raise ValueError(f"no escape {c}")
        return self._ESCAPES.get(c, ord(c))

    def _class(self) -> frozenset[int]:
        negate = self.text[self.at] == "^"
        self.at += negate
        found: set[int] = set()
        while self.text[self.at] != "]" or not found:
            self.at += 1
            low = high = self._byte(self.text[self.at - 1]) if self.text[self.at - 1] == "\\" else ord(self.text[self.at - 1])
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 2
                high = self._byte("\\") if self.text[self.at - 1] == "\\" else ord(self.text[self.at - 1])
            found |= set(range(low, high + 1))
        self.at += 1
        return frozenset(range(256)) - found if negate else frozenset(found)

    def _repeated(self, node: tuple) -> tuple:
        found = re.match(r"[*+?]|\{(\d+)(?:(,)(\d*))?\}", self.text[self.at :])
        if not found:
            return node
        self.at += len(found[0])
        bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}
        low, high = bounds.get(found[0]) or (int(found[1]), int(found[3]) if found[3] else None if found[2] else int(found[1]))
        return ("repeat", low, high, node)


class _Nfa:
    """States with byte-set edges and empty edges; built forward or reversed."""

    def __init__(self, backward: bool = False):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []
        self.backward = backward

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, node: tuple, at: int) -> int:
        """The state after ``node`` from state ``at``."""
        if node[0] == "byte":
            to = self.state()
            self.edges[at].append((node[1], to))
            return to
        if node[0] == "all":
            for one in reversed(node[1]) if self.backward else node[1]:
                at = self.add(one, at)
            return at
        if node[0] == "any":
            out = self.state()
            for way in node[1]:
                self.empty[self.add(way, at)].append(out)
            return out
        _, low, high, inner = node
        for _ in range(low):
            at = self.add(inner, at)
        if high is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            return loop
        out = self.state()
        self.empty[at].append(out)
        for _ in range(high - low):
            at = self.add(inner, at)
            self.empty[at].append(out)
        return out

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``table[state + byte]`` is the next state; states are multiples of 256 and accepting ones come last."""

    table: list[int]
    start: int
    first_accepting: int
    dead: int
    accepts: dict[int, int]
    states: int


def _determinise(nfa: _Nfa, start: int, ends: dict[int, int], unanchored: bool) -> Automaton:
    sets = [s for edges in nfa.edges for s, _ in edges]
    member = np.zeros((256, max(len(sets), 1)), dtype=bool)
    for k, s in enumerate(sets):
        member[sorted(s), k] = True
    _, first, group = np.unique(member, axis=0, return_index=True, return_inverse=True)
    group = group.reshape(-1)
    home = nfa.closure([start])
    number, rows, todo = {home: 0}, [], [home]
    for states in todo:
        row = []
        for byte in first.tolist():
            to = {t for s in states for chars, t in nfa.edges[s] if byte in chars}
            to = nfa.closure(to) | home if unanchored else nfa.closure(to)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    moves = np.array(rows, dtype=np.int64)
    masks = np.array([sum({1 << ends[s] for s in states if s in ends}) for states in todo], dtype=np.int64)
    # Minimise: split blocks by the blocks that their transitions reach until none splits.
    block = np.unique(masks, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    count = int(block.max()) + 1
    one = np.zeros(count, dtype=np.int64)
    one[block] = np.arange(len(block))
    order = np.argsort(masks[one] != 0, kind="stable")
    place = np.empty(count, dtype=np.int64)
    place[order] = np.arange(count)
    table = place[block[moves[one[order]]]][:, group] * 256
    accepting = masks[one[order]]
    plain = int((accepting == 0).sum())
    loops = [s for s in range(plain) if (table[s] == s * 256).all()]
    return Automaton(
        table.reshape(-1).tolist(), int(place[block[0]]) * 256, plain * 256, loops[0] * 256 if loops else -1,
        {s * 256: int(accepting[s]) for s in range(plain, count)}, count,
    )


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[Rule, ...]) -> tuple[Automaton, tuple[Automaton, ...]]:
    """The combined forward automaton and each rule's reversed one."""
    nfa = _Nfa()
    start, ends = nfa.state(), {}
    for k, rule in enumerate(rules):
        entry = nfa.state()
        nfa.empty[start].append(entry)
        ends[nfa.add(_Pattern(rule.pattern).parse(), entry)] = k
    back = []
    for rule in rules:
        own = _Nfa(backward=True)
        entry = own.state()
        back.append(_determinise(own, entry, {own.add(_Pattern(rule.pattern).parse(), entry): 0}, unanchored=False))
    return _determinise(nfa, start, ends, unanchored=True), tuple(back)


def _leftmost(auto: Automaton, data: bytes, end: int, bound: int) -> int:
    state, found, table = auto.start, -1, auto.table
    for at in range(end - 1, bound - 1, -1):
        state = table[state + data[at]]
        if state == auto.dead:
            break
        if state >= auto.first_accepting:
            found = at
    return found


def find_spans(data: bytes, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in bytes, leftmost and non-overlapping in each rule."""
    auto, back = compile_rules(rules)
    table, state, edge, at = auto.table, auto.start, auto.first_accepting, 0
    hits = []
    for byte in data:
        state = table[state + byte]
        if state >= edge:
            hits.append((at, state))
        at += 1
    if not hits:
        return []
    found = []
    for k, rule in enumerate(rules):
        mine = [at for at, state in hits if auto.accepts[state] >> k & 1]
        last = 0
        for i, at in enumerate(mine):
            if i + 1 < len(mine) and mine[i + 1] == at + 1:
                continue
            start = _leftmost(back[k], data, at + 1, last)
            if start < 0:
                continue
            last = at + 1
            if rule.check is None or re.fullmatch(rule.check, data[start:last]):
                found.append((start, k, last))
    return sorted(found)


def _findings(text: str | None, rules: tuple[Rule, ...]) -> list[dict]:
    data = (text or "").encode("utf-8", "surrogatepass")
    spans = find_spans(data, rules)
    if not spans or data.isascii():
        place = int
    else:
        marks = sorted({x for s, _, e in spans for x in (s, e)})
        points, chars, before = {}, 0, 0
        for mark in marks:
            chars += len(data[before:mark].decode("utf-8", "surrogatepass"))
            points[mark], before = chars, mark
        place = points.__getitem__
    return [{"kind": rules[k].kind, "start": place(s), "end": place(e)} for s, k, e in spans]


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Return ``id_col`` and ``findings`` (kind, start, end in code points), one row per input row.

    Findings are ordered by start, then by the order of ``rules``. A null or
    empty text has no findings; every input row is returned, repeated rows and
    null ids included. No shuffle: one narrow pass over the texts.
    """
    bounded_batches(df.sparkSession)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "findings": [_findings(t, rules) for t in frame["text"]]})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(scan, f"id {kind}, findings {FINDING}").withColumnRenamed("id", id_col)


def _joined(findings):
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the base kinds, and all spans, from ``scan_secrets`` rows."""
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col, *[count(r.kind) for r in BASE_RULES], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans")
    )
