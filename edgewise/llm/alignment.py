"""Alignment of two tokenizers' tokens on the bytes of every text.

A task encodes texts by both tokenizers and turns tokens into byte ends. The
shorter end list of a document gallops through the longer one (exponential and
then binary search from a known place); common ends cut the tokens into groups,
and differences of ranks give the range of tokens that each token overlaps.

How many documents link an id pair is a count over the corpus. Documents are
gathered to blocks of bounded text; a block lists its distinct pairs once, and
a document refers to that list. Lists are summed by pair, what the sums say
goes back to the blocks, and documents add up their own links. No table of
pairs is broadcast, and no row is made for a pair of a document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, spread_join
from .tokens import LINES, SIMPLE, byte_level_table, tokenizer_path

#: Characters of the texts of a block, and of those that are aligned together.
BLOCK_CHARS, BATCH_CHARS = 24_000_000, 1_000_000
#: Words whose ids a worker keeps, and the longest one kept.
CACHE_WORDS, WORD_CHARS = 600_000, 48
#: Pairs are numbered ``a * PAIR + b``; above the ids of tokenizer B.
PAIR = 1 << 20
#: Short ends that gallop from one known place.
STRIDE = 4

#: A space after which both tokenizers start anew: no space before it, and something visible behind it.
_CUT = re.compile(r"(?<! ) (?=[^\s\u180e\u200b\u2060\ufeff])")


class Tokens(NamedTuple):
    """Tokens of several texts one after the other: ids, bytes up to each token's end, tokens of each text."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


class Pairing(NamedTuple):
    """Alignment of texts: per token its group, the links as places of A and B tokens, per text the groups and links."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    groups: np.ndarray
    links: np.ndarray


class _Lists:
    """Numbered lists of ids in one growing array."""

    def __init__(self) -> None:
        self.ids, self.used, self.starts, self.sizes = np.zeros(1024, dtype="<i4"), 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        if (need := self.used + len(ids)) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * need - self.used, dtype="<i4")])
        self.ids[self.used : need] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes, self.used = np.concatenate([self.sizes, sizes]), need

    def cut(self, n: int) -> None:
        """Keep the first ``n`` lists."""
        self.used = int(self.starts[n])
        self.starts, self.sizes = self.starts[:n], self.sizes[:n]

    def gather(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after the other, and how many ids lie between each two ``bounds`` of numbers."""
        sizes = self.sizes[numbers]
        to = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(to[-1]) + np.repeat(self.starts[numbers] - to[:-1], sizes)
        return self.ids[place], np.diff(to[bounds])


class TwoTokenizers:
    """Ids of texts by a byte-level BPE (A, of a space and the text) and a sentence-piece model (B, which adds the space)."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.bytes_a = byte_level_table(self.a)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        #: Texts are cut only if no piece of B goes on behind a word's end.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        #: Words met so far by number, their ids one after the other, and which ones both tokenizers spell.
        self.words: dict[str, int] = {}
        self.known_a, self.known_b, self.same = _Lists(), _Lists(), np.zeros(0, dtype=bool)
        self.ranked, self.line_end = self._by_ranks(), self.a.encode("\n", add_special_tokens=False).ids[0]
        #: Names of ids with what may stand behind them: ids of A, then those of B.
        self.names = [f"{k}{end}" for table, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for k in range(len(table)) for end in ends]
        self.name_sizes = np.array([len(x) for x in self.names])

    def _by_ranks(self):
        """The same merges by rank, which is quicker on new words; None unless the ids of the file are in the order of its merges."""
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        merges = [m if isinstance(m, str) else " ".join(m) for m in json.loads(self.a.to_str())["model"]["merges"]]
        ids = [self.a.token_to_id(m.replace(" ", "")) for m in merges]
        if ids != sorted(ids):
            return None
        special = set(self.a.get_added_tokens_decoder())
        ranks = {x: k for k, x in enumerate(self.bytes_a) if k not in special}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _encode_a(self, chunks: list[str]) -> list[bytes]:
        """Ids of A. Plain chunks go line by line: a line end is a word of its own before a space."""
        found: dict[str, bytes] = {}
        if self.ranked:
            plain = [c for c in chunks if SIMPLE.fullmatch(c) and not c[-1].isspace()]
            lines = [c for c in plain if "\n" not in c]
            for at in range(0, len(lines), LINES):
                part = lines[at : at + LINES]
                ids = np.array(self.ranked("\n".join(part)), dtype="<i4")
                raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.line_end)).tolist()
                found.update(zip(part, (raw[x:y] for x, y in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)), strict=True))
            found.update((c, np.array(self.ranked(c), dtype="<i4").tobytes()) for c in plain if "\n" in c)
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, (np.array(x.ids, dtype="<i4").tobytes() for x in self.a.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return [found[c] for c in chunks]

    def _learn(self, words: list[str]) -> None:
        """Number new words and append their ids of both, and whether both spell a space and the word."""
        chunks = [" " + w for w in words]
        a_all, b_ids = self._encode_a(chunks), self.b.encode(words, num_threads=1)
        a, b = np.frombuffer(b"".join(a_all), dtype="<i4"), np.fromiter(chain.from_iterable(b_ids), dtype="<i4")
        n_a, n_b = np.array([len(x) // 4 for x in a_all]), np.array([len(x) for x in b_ids])
        data = [c.encode() for c in chunks]
        to = np.cumsum([len(x) for x in data])
        same = (np.cumsum(self.length_a[a])[np.cumsum(n_a) - 1] == to) & (np.cumsum(self.length_b[b])[np.cumsum(n_b) - 1] == to)
        if not same.all() or any(b"".join(map(table.__getitem__, ids.tolist())) != b"".join(data) for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            # Some word isn't spelt: each by itself.
            ends_a, ends_b = np.cumsum(n_a).tolist(), np.cumsum(n_b).tolist()
            same = np.array([self._spelt(x, a[p:q], b[r:s]) for x, p, q, r, s in zip(data, [0, *ends_a], ends_a, [0, *ends_b], ends_b, strict=False)])
        self.words.update(zip(words, range(len(self.same), len(self.same) + len(words)), strict=True))
        self.known_a.append(a, n_a)
        self.known_b.append(b, n_b)
        self.same = np.concatenate([self.same, same])

    def _parts(self, text: str | None) -> list[str]:
        """The text at the places where both tokenizers start anew; before each part goes a space."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        if "  " not in text and text[0] != " " and text[-1] != " " and (text.isprintable() or " \n" not in text and text.replace("\n", "").isprintable()):
            return text.split(" ")  # printable: no other white space
        first, *rest = _CUT.split(" " + text)
        return [first[1:], *rest] if first else rest

    def encode(self, texts: list[str | None]) -> tuple[Tokens, Tokens]:
        """Tokens of all texts; a text that is null or empty, or that one tokenizer doesn't spell, has none."""
        parts = [self._parts(t) for t in texts]
        words = list(chain.from_iterable(parts))
        numbers = list(map(self.words.get, words))
        kept = len(self.same)
        if None in numbers:
            new = list(dict.fromkeys(w for w, k in zip(words, numbers, strict=True) if k is None))
            new.sort(key=lambda w: len(w) > WORD_CHARS)  # stable: the ones that are kept first
            self._learn(new)
            numbers = map(self.words.__getitem__, words)
            if len(self.same) > CACHE_WORDS:
                kept = max(kept, min(CACHE_WORDS, kept + sum(len(w) <= WORD_CHARS for w in new)))
            else:
                kept += sum(len(w) <= WORD_CHARS for w in new)
        numbers = np.fromiter(numbers, dtype=np.int64, count=len(words))
        bounds = np.cumsum([0, *map(len, parts)])
        (a, n_a), (b, n_b) = self.known_a.gather(numbers, bounds), self.known_b.gather(numbers, bounds)
        if not (same := self.same[numbers]).all():
            odd = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(~same)])[bounds]))
            to_a, to_b = np.cumsum([0, *n_a]), np.cumsum([0, *n_b])
            drop = [k for k in odd.tolist() if not self._spelt(b" " + texts[k].encode(), a[to_a[k] : to_a[k + 1]], b[to_b[k] : to_b[k + 1]])]
            keep = np.ones(len(texts), dtype=bool)
            keep[drop] = False
            a, b, n_a, n_b = a[np.repeat(keep, n_a)], b[np.repeat(keep, n_b)], n_a * keep, n_b * keep
        if kept < len(self.same):
            for w in new[kept - len(self.same) :]:
                del self.words[w]
            self.same = self.same[:kept]
            self.known_a.cut(kept)
            self.known_b.cut(kept)
        return Tokens(a, np.cumsum(self.length_a[a]), n_a), Tokens(b, np.cumsum(self.length_b[b]), n_b)

    def _spelt(self, data: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return all(b"".join(map(table.__getitem__, ids.tolist())) == data for table, ids in ((self.bytes_a, a), (self.bytes_b, b)))


@lru_cache(maxsize=2)
def two_tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    """One pair of tokenizers a worker process and files."""
    return TwoTokenizers(path_a, path_b)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of the ascending ``short`` the place of the first of the ascending ``long`` that isn't less; the last of both is one value.

    Each STRIDE-th value is placed first, in the same way; the ones behind it
    start there, double their steps until they are past, and halve the last step.
    """
    low = np.zeros(len(short), dtype=np.int64) if len(short) <= STRIDE else np.repeat(gallop(short[::STRIDE], long), STRIDE)[: len(short)]
    last, high, step = len(long) - 1, low.copy(), 1
    open_ = np.flatnonzero(long[high] < short)
    while len(open_):
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step, last)
        step *= 2
        open_ = open_[long[high[open_]] < short[open_]]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = long[middle] < short[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


def align(a: Tokens, b: Tokens) -> Pairing:
    """Groups and links of texts, each of which ends with a common end."""
    texts = len(a.counts)
    side = np.repeat(a.counts <= b.counts, a.counts), np.repeat(a.counts <= b.counts, b.counts)
    common_a, common_b = np.zeros(len(a.ids), dtype=bool), np.zeros(len(b.ids), dtype=bool)
    links = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for short_is_a in (True, False):
        places = np.flatnonzero(side[0] == short_is_a), np.flatnonzero(side[1] == short_is_a)
        if not len(places[0]):
            continue
        s, t = (0, 1) if short_is_a else (1, 0)
        ends = a.ends[places[0]], b.ends[places[1]]
        to = gallop(ends[s], ends[t])
        same = ends[t][to] == ends[s]
        common = common_a, common_b
        common[s][places[s]] = same
        common[t][places[t][to[same]]] = True
        start = np.zeros(len(to), dtype=np.int64)
        start[1:] = to[:-1] + same[:-1]
        count = to - start + 1
        before = np.cumsum(count) - count
        here = np.repeat(np.arange(len(to)), count)
        there = np.arange(len(here)) - np.repeat(before - start, count)
        links[s].append(places[s][here])
        links[t].append(places[t][there])
    group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
    link_a, link_b = np.concatenate(links[0]), np.concatenate(links[1])
    text_of = np.repeat(np.arange(texts), a.counts)
    return Pairing(group_a, group_b, link_a, link_b, np.bincount(text_of[common_a], minlength=texts), np.bincount(text_of[link_a], minlength=texts))


def group_strings(a: Tokens, b: Tokens, found: Pairing, tokenizers: TwoTokenizers) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    n_a, n_b = np.bincount(found.group_a), np.bincount(found.group_b)
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    codes = np.empty(len(a.ids) + len(b.ids), dtype=np.int32)
    named_a, named_b = 2 * a.ids, 2 * (b.ids + len(tokenizers.bytes_a))
    named_a[last_a - 1] += 1
    named_b[last_b - 1] += 1
    codes[np.arange(len(a.ids)) + (last_b - n_b)[found.group_a]] = named_a
    codes[np.arange(len(b.ids)) + last_a[found.group_b]] = named_b
    whole = "".join(map(tokenizers.names.__getitem__, codes.tolist())).encode()
    bounds = np.concatenate([[0], np.cumsum(tokenizers.name_sizes[codes])])[np.cumsum([0, *(a.counts + b.counts)])].tolist()
    return [whole[x : max(x, y - 1)] for x, y in zip(bounds, bounds[1:], strict=False)]


def _portions(texts: list[str | None], chars: int) -> Iterator[slice]:
    """Runs of texts with about ``chars`` characters at most, one text at least."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and size + n > chars:
            yield slice(start, k)
            start, size = k, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def token_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row: id, a_ids, b_ids, groups (a_from, a_to, b_from, b_to; ends exclusive), in order.

    A text that is null or empty, or whose tokens of A or B don't spell a space
    and the text, has empty lists. Repeated rows are rows like others; other
    columns are ignored; an empty table gives an empty result.
    """
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    groups = pa.list_(pa.struct([(n, pa.int32()) for n in ("a_from", "a_to", "b_from", "b_to")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _portions(texts, BATCH_CHARS):
                a, b = two_tokenizers(path_a, path_b).encode(texts[part])
                found, out = align(a, b), []
                to_a, to_b = np.cumsum(np.bincount(found.group_a)), np.cumsum(np.bincount(found.group_b))
                at_a = at_b = at_g = 0
                for n_a, n_b, n_g in zip(a.counts.tolist(), b.counts.tolist(), found.groups.tolist(), strict=True):
                    ends_a, ends_b = (to_a[at_g : at_g + n_g] - at_a).tolist(), (to_b[at_g : at_g + n_g] - at_b).tolist()
                    spans = [{"a_from": p, "a_to": q, "b_from": r, "b_to": s} for p, q, r, s in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b, strict=False)]
                    out.append((a.ids[at_a : at_a + n_a].tolist(), b.ids[at_b : at_b + n_b].tolist(), spans))
                    at_a, at_b, at_g = at_a + n_a, at_b + n_b, at_g + n_g
                lists = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.list_(pa.int32()), pa.list_(pa.int32()), groups), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id")[part.start : part.stop], *lists], names=["id", "a_ids", "b_ids", "groups"])

    kind = df.schema[id_col].dataType.simpleString()
    span = "struct<a_from:int,a_to:int,b_from:int,b_to:int>"
    return rows.mapInArrow(run, f"id {kind}, a_ids array<int>, b_ids array<int>, groups array<{span}>").withColumnRenamed("id", id_col)


class _Block:
    """Aligned texts whose pairs are listed together."""

    def __init__(self) -> None:
        self.rows: list[pa.Array] = []
        self.facts: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.chars = 0

    def add(self, ids: pa.Array, texts: list[str | None], tokenizers: TwoTokenizers) -> None:
        a, b = tokenizers.encode(texts)
        found = align(a, b)
        strings = group_strings(a, b, found, tokenizers)
        text_of = np.repeat(np.arange(len(texts)), a.counts)[found.link_a]
        # One number a text and pair: a pair has under 40 bits, and a portion under 2**23 texts.
        key = np.sort((text_of << 40) + a.ids[found.link_a].astype(np.int64) * PAIR + b.ids[found.link_b])
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(first)
        text_of, key = key >> 40, key & (1 << 40) - 1
        self.rows.append(ids)
        self.facts += zip(a.counts.tolist(), b.counts.tolist(), found.groups.tolist(), found.links.tolist(), [hashlib.sha256(s).hexdigest() if s else "" for s in strings], strict=True)
        self.pairs.append(key[at])
        self.times.append(np.diff(np.append(at, len(key))))
        self.sizes.append(np.bincount(text_of[at], minlength=len(texts)))
        self.chars += sum(len(t or "") for t in texts)

    def table(self, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row a text, which refers to the block's pairs by place, and one row with the pairs."""
        pairs, place, texts = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        place, times, sizes = place.astype("<u4"), np.concatenate(self.times).astype("<u4"), np.concatenate(self.sizes)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        for at in range(0, len(self.facts), 1000):
            facts, spans = self.facts[at : at + 1000], list(zip(bounds[at : at + 1000], bounds[at + 1 : at + 1001], strict=False))
            columns = [[block] * len(facts), None, *[[f[k] for f in facts] for k in range(5)], [pack_places(place[x:y]) for x, y in spans], [pack_times(times[x:y]) for x, y in spans], [None] * len(facts), [None] * len(facts)]
            arrays = [pa.array(c, f.type) if c is not None else None for c, f in zip(columns, schema, strict=True)]
            arrays[1] = pa.concat_arrays(self.rows)[at : at + 1000]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        if len(pairs):
            one = [pa.array([block], pa.int64()), *[pa.nulls(1, f.type) for f in list(schema)[1:9]], pa.array([pairs], schema.field("pairs").type), pa.array([texts.astype(np.int32)], schema.field("texts").type)]
            yield pa.RecordBatch.from_arrays(one, schema=schema)


def pack_places(places: np.ndarray) -> bytes:
    """Ascending numbers below 2**32: how many there are of each upper half, from 0 on, after their number; then all lower halves."""
    upper = np.bincount(places >> 16).astype("<u4") if len(places) else np.zeros(0, dtype="<u4")
    return np.uint32(len(upper)).astype("<u4").tobytes() + upper.tobytes() + places.astype("<u2").tobytes()


def unpack_places(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, dtype="<u4", count=1)[0])
    upper = np.frombuffer(data, dtype="<u4", count=n, offset=4)
    lower = np.frombuffer(data, dtype="<u2", offset=4 + 4 * n)
    return (np.repeat(np.arange(n, dtype=np.int64), upper) << 16) + lower


def pack_times(times: np.ndarray) -> bytes:
    """Positive numbers, in bytes if they fit (a first byte of 1) or else in four bytes each."""
    small = not len(times) or int(times.max()) < 256
    return (b"\1" + times.astype("u1").tobytes()) if small else (b"\4" + times.astype("<u4").tobytes())


def unpack_times(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="u1" if data[0] == 1 else "<u4", offset=1).astype(np.int64)


def align_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a token of A and a token of B that share a byte; an id pair's
    count is the number of rows that hold it linked. ``n_best`` are the links
    whose count is the highest of their A id (ties included), ``count_sum`` the
    counts of all links added up. A text that is null or empty, or that the
    tokens of A or B don't spell, has zeros and an empty string. Repeated rows
    are rows of their own and count each; a null id is kept; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")
    bounded_batches(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    facts = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, number, block = two_tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32, _Block()
        schema = None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            schema = schema or pa.schema([
                ("block", pa.int64()), ("id", batch.column("id").type), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
                ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("texts", pa.list_(pa.int32())),
            ])
            for part in _portions(texts, BATCH_CHARS):
                block.add(batch.column("id")[part.start : part.stop], texts[part], tokenizers)
                if block.chars > BLOCK_CHARS:
                    yield from block.table(number, schema)
                    number, block = number + 1, _Block()
        if block.facts:
            yield from block.table(number, schema)

    aligned = materialise(rows.mapInArrow(gather, f"block long, id {kind}, {facts}, places binary, times binary, pairs array<long>, texts array<int>"), "aligned")
    listed = aligned.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "texts")).alias("place", "__p")).select("block", "place", F.col("__p.pairs").alias("pair"), F.col("__p.texts").alias("texts"))
    counts = listed.groupBy("pair").agg(F.sum("texts").alias("count"), F.count("*").alias("blocks"))
    own = Window.partitionBy(F.shiftright("pair", 20))  # an id of A has as many pairs as B has ids, at most
    counts = materialise(counts.withColumn("best", F.col("count") == F.max("count").over(own)), "counts")
    told = spread_join(listed.select("block", "place", "pair"), counts, "pair", "blocks", "block").select("block", "place", "count", "best")
    texts = aligned.filter("pairs IS NULL").drop("pairs", "texts").withColumnRenamed("block", "own")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right["place"].to_numpy()
        count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        count[place], best[place] = right["count"].to_numpy(), right["best"].to_numpy()
        n_best, total = [], []
        for places, times in zip(left["places"].to_pylist(), left["times"].to_pylist(), strict=True):
            at, n = unpack_places(places), unpack_times(times)
            n_best.append(int(n @ best[at]))
            total.append(int(n @ count[at]))
        out = left.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    found = texts.groupBy("own").cogroup(told.groupBy("block")).applyInArrow(add_up, f"id {kind}, {facts}, n_best long, count_sum long")
    return found.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
