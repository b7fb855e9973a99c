"""Exact token ids of public tokenizers at the speed of a look-up.

Both JSON vocabularies split a text at white space, and between a letter or digit and punctuation,
before they merge. So a text's ids are those of its units in a row, a unit being white space with
what follows it up to such a border. (It is cut only where the preceding character is no white space
outside ASCII, since white space may be one match, and only after letters that are known here.)
Each distinct unit goes through the tokenizers library once; later ones are found by hash.
The vocabulary's special tokens are what they are to the library: a text that holds such a string has its id there, and
what stands before and after it is encoded on its own.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np

from . import bytewords as bw

#: Distinct units that a worker remembers before it starts anew: bounds its memory (some 50 bytes each).
REMEMBERED = 2_000_000
_SPACE = ~bw.SPACED
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

#: How byte-level vocabularies write bytes: printable Latin-1 as itself, others from U+0100 on, in order.
_SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = [chr(b) if b in _SELF else chr(256 + sum(x not in _SELF for x in range(b))) for b in range(256)]
#: A word of Latin letters or a run of ASCII punctuation (without ', which begins suffixes)
_ONE = re.compile(r" ?(?:[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+|[!-&(-/:-@\[-`{-~]+)")


def units(buf: np.ndarray, offs: np.ndarray, whole: np.ndarray | None = None) -> bw.Words:
    """White space with what follows it; all bytes of a text belong to a unit. Spans of ``whole`` (start, end) are units of their own."""
    n = len(buf)
    if n == 0:
        return bw.words(buf, offs, bw.SPACED)
    space = _SPACE[buf]
    start = space.copy()
    start[1:] &= ~space[:-1]
    at = np.flatnonzero(start)
    at = at[at >= 2]
    a, b = buf[at - 2], buf[at - 1]  # the white space of Unicode ends in two such bytes
    odd = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | (((a == 0x80) | (a == 0x81) | (a == 0x9A)) & (b >= 0x80))
    start[at[odd]] = False
    at = np.flatnonzero(_PUNCT[buf])
    at = at[at >= 2]
    a, b = buf[at - 2], buf[at - 1]
    start[at[_ALNUM[b] | ((a == 0xC3) & (b != 0x97) & (b != 0xB7) & (b >= 0x80))]] = True
    start[offs[offs < n]] = True
    if whole is not None and len(whole):
        for a, b in whole.tolist():
            start[a:b] = False
        start[whole[whole < n]] = True
        start[offs[offs < n]] = True
    starts = np.flatnonzero(start)
    return bw.Words(buf, starts, np.append(starts[1:], n), np.searchsorted(starts, offs))


class Tokens:
    """Ids of many texts at once. One for each worker and vocabulary."""

    _kept: dict[str, "Tokens"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        self._special = [re.escape(t["content"]).encode() for t in setup["added_tokens"]]
        self._model = self.tokenizer.model
        self._lower = "Lowercase" in json.dumps(setup["normalizer"])
        self._forget()

    @classmethod
    def of(cls, path: str) -> "Tokens":
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _forget(self) -> None:
        #: hash, start and count of each known unit, sorted by hash: the many and the latest
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _encode_unit(self, raw: bytes) -> list[int]:
        """A word or a run of ASCII punctuation is one word to the model; whatever else takes the long way."""
        text = raw.decode()
        if _ONE.fullmatch(text):
            if self._lower:
                raw = text.lstrip(" ").lower().encode()
            return [t.id for t in self._model.tokenize(raw.decode("latin-1").translate(_BYTES))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, h: np.ndarray, raw: list[bytes]) -> None:
        got = [self._encode_unit(x) for x in raw]
        count = np.array([len(x) for x in got], np.int64)
        start = np.cumsum(count) - count
        ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(count.sum()))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        fresh = (h, start + self.used, count)
        self.used += len(ids)
        late = 1 if len(self.known[1][0]) + len(h) < max(20_000, len(self.known[0][0]) // 8) else 0
        parts = [self.known[1], fresh] if late else [*self.known, fresh]
        both = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(both[0], kind="stable")
        self.known[late] = tuple(x[order] for x in both)
        if not late:
            self.known[1] = tuple(x[:0] for x in fresh)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and count, -1 where unknown; h is sorted."""
        start, count = np.full(len(h), -1), np.full(len(h), -1)
        for kh, ks, kc in self.known:
            if len(kh):
                at = np.minimum(np.searchsorted(kh, h), len(kh) - 1)
                ok = kh[at] == h
                start[ok], count[ok] = ks[at[ok]], kc[at[ok]]
        return start, count

    def _specials(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Where special strings are, within a text each."""
        if not self._special:
            return np.zeros((0, 2), np.int64)
        at = np.array([m.span() for m in re.finditer(b"|".join(self._special), buf.tobytes())], np.int64).reshape(-1, 2)
        return at[np.searchsorted(offs, at[:, 0], "right") == np.searchsorted(offs, at[:, 1] - 1, "right")]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (and the last end)."""
        u = units(buf, offs, self._specials(buf, offs))
        h, one, place = bw.distinct(bw.hashes(buf, u.starts, u.ends, False))
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        start, count = self._find(h)
        new = count < 0
        if new.any():
            if sum(len(k[0]) for k in self.known) + int(new.sum()) > REMEMBERED:
                self._forget()
                new[:] = True
            self._learn(h[new], [u.raw(i) for i in one[new]])
            start, count = self._find(h)
        start, count = start[place], count[place]
        stop = np.cumsum(count)
        ids = self.ids[np.arange(stop[-1]) - np.repeat(stop - count - start, count)]
        return ids, np.concatenate([[0], stop])[u.first]
