"""Token ids of whole texts, from a public tokenizer file, for use inside Arrow tasks."""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Fixed value: the id that ends a document.
END_ID = 2
#: Words kept per worker; a full table takes no more, and words it lacks are worked out each time.
CACHE_WORDS = 300_000

#: Letters among the characters of ``SIMPLE``, and those characters: on them Python's classes equal the tokenizer's.
_LETTERS = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-ɏ"
SIMPLE = re.compile("[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]*")
#: Words that are encoded in one line-by-line text.
LINES = 200
#: Characters of texts that are split together.
TOGETHER = 500_000
#: Kinds of characters of ``SIMPLE``; the zero character stands between texts.
_BREAK, _SPACE, _LETTER, _DIGIT, _OTHER = range(5)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each character of ``SIMPLE``, by code point."""
    kinds = np.zeros(0x2028, dtype=np.uint8)
    letter = re.compile(f"[{_LETTERS}]")
    for code in range(1, len(kinds)):
        if SIMPLE.fullmatch(c := chr(code)):
            kinds[code] = _SPACE if c.isspace() else _LETTER if letter.match(c) else _DIGIT if c.isdecimal() else _OTHER
    return kinds


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Where words start in texts of ``SIMPLE`` characters that each end with a zero, itself a word.

    Fixed value: the byte-level pre-tokenizer's split,
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    kind, start = _kinds()[codes], np.ones(len(codes), dtype=bool)
    word, blank = kind > _SPACE, codes == ord(" ")
    start[1:] = kind[1:] != kind[:-1]
    start[1:] &= ~(blank[:-1] & word[1:])  # a blank goes with the word after it
    start[:-1] |= (kind[:-1] == _SPACE) & word[1:]  # the last of several spaces before a word stands alone, or goes with it
    start |= kind == _BREAK
    at = np.flatnonzero(codes == ord("'"))
    at = at[(at == 0) | ((kind[at - 1] != _OTHER) & ~blank[at - 1])]  # elsewhere it stands inside a word of other characters
    first, second = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
    short, long = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    for c in "stmd":
        short |= first == ord(c)
    for c, d in ("re", "ve", "ll"):
        long |= (first == ord(c)) & (second == ord(d))
    start[at[short | long] + 1] = False
    start[at[short] + 2] = True
    start[at[long] + 3] = True
    return np.flatnonzero(start)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    Merges never cross the pre-tokenizer's words, so a word's ids are worked out
    once by the library and looked up from then on. Many texts are split
    together into the places of their distinct words, and their ids gathered by
    place. A text with characters on which two regular-expression engines might
    differ, or with the string of a special token, goes to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids
        # For words that are split already, with their bytes written as the model's characters.
        self.level = np.array([ord(c) for c in byte_level_characters()], dtype="<u2")
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(self._level(b"\n"), "isolated")
        self.words: dict[bytes, bytes] = {b"\0": END_ID.to_bytes(4, "little")}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)

    def _level(self, raw: bytes) -> str:
        return self.level[np.frombuffer(raw, dtype=np.uint8)].tobytes().decode("utf-16-le")

    def whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words. Those without a line end go line by line, with the line end as a word of its own."""
        lines, found = [w for w in words if b"\n" not in w], {}
        texts = [self._level(b"\n".join(lines[k : k + LINES])) for k in range(0, len(lines), LINES)]
        for k, encoded in enumerate(self.model.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype="<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.line_end[0])).tolist()
            starts = [0, *[e + 4 for e in ends]]
            found.update(zip(lines[k * LINES : (k + 1) * LINES], (raw[a:b] for a, b in zip(starts, [*ends, len(raw)], strict=True)), strict=True))
        return found | {w: self.whole(w.decode()) for w in words if b"\n" in w}

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of ``SIMPLE`` characters, each with ``END_ID``."""
        joined = "\0".join([*texts, ""])
        raw = joined.encode()
        if len(raw) == len(joined):
            starts = word_starts(np.frombuffer(raw, dtype=np.uint8))
        else:
            codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
            starts = word_starts(codes)
            starts += np.cumsum((codes > 0x7F).astype(np.int64) + (codes > 0x7FF))[starts] - (codes[starts] > 0x7F) - (codes[starts] > 0x7FF)  # places in UTF-8
        bounds = np.append(starts, len(raw)).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        words, which = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        known = self.words
        ids = list(map(known.get, words))
        new = self._encode_words([w for w, x in zip(words, ids, strict=True) if x is None])
        if new:
            ids = [new[w] if x is None else x for w, x in zip(words, ids, strict=True)]
            if len(known) < CACHE_WORDS:
                known.update(new)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first = np.cumsum(size) - size
        ends = np.cumsum(size[which])
        place = np.repeat(first[which] - ends + size[which], size[which]) + np.arange(ends[-1])
        stream = np.frombuffer(b"".join(ids), dtype="<u4")[place].tobytes()
        cuts = [0, *(4 * ends[which == words.index(b"\0")]).tolist()]
        return [stream[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids and then ``END_ID``; a null text counts as empty."""
        out: list[bytes | None] = [None] * len(texts)
        simple, plain = [], []
        for k, t in enumerate(texts):
            if t and SIMPLE.fullmatch(t) and not any(x in t for x in self.special):
                (plain if t.isascii() else simple).append(k)
            else:
                out[k] = self.whole(t or "") + END_ID.to_bytes(4, "little")
        for places in (plain, simple):
            at = 0
            while at < len(places):
                to, size = at, 0
                while to < len(places) and (to == at or size + len(texts[places[to]]) <= TOGETHER):
                    size += len(texts[places[to]])
                    to += 1
                for k, raw in zip(places[at:to], self._together([texts[k] for k in places[at:to]]), strict=True):
                    out[k] = raw
                at = to
        return out


def byte_level_characters() -> list[str]:
    """How a byte-level tokenizer writes each byte: visible bytes of Latin-1 as themselves and the others, in order, as the characters from 256 on."""
    hidden = [b for b in range(256) if not chr(b).isprintable() or chr(b).isspace()]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


def byte_level_table(library) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer."""
    byte_of = {c: b for b, c in enumerate(byte_level_characters())}
    return [bytes(byte_of[c] for c in library.id_to_token(k)) for k in range(library.get_vocab_size())]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)
