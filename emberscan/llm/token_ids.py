"""Token ids of whole texts with the public tokenizer files, one model call per distinct piece.

A byte-pair model works on the pieces its pre-tokenizer cuts. Texts are cut
into the same pieces on arrays of code points, and only pieces that a worker
has not met yet are given to the library; the ids of the others come from a
bounded cache. Texts with characters whose class, case or normal form depends
on more than the character itself go to the library whole, as does everything
of a tokenizer with other rules. The ids are the library's in every case.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
from tokenizers import Tokenizer

from .words import run_hash

#: Pieces a worker remembers (a power of two): some 100 MB.
CACHE = 1 << 21

OTHER, SPACE, LETTER, NUMBER, HARD = range(5)

# The split rules that are cut on arrays, as the tokenizer files state them.
_BYTE_RULE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _classes(fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point below 2**16 and its lower case; HARD where one character can't tell."""
    kind, low = np.full(1 << 16, HARD, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if fold:
            if not unicodedata.is_normalized("NFC", ch) or len(ch.lower()) != 1 or 0x1100 <= c < 0x1200:
                continue
            ch = ch.lower()
            low[c] = ord(ch)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Cs", "Co") or (fold and cat[0] == "M") or c in (0x85, 0xA0) or (c > 0xA0 and cat[0] == "Z"):
            continue
        kind[c] = LETTER if cat[0] == "L" else NUMBER if cat[0] == "N" else SPACE if c in (9, 10, 11, 12, 13, 32) else OTHER
    return kind, low


def _contraction(cp: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Letters from ``at`` that an apostrophe before them takes: s, t, m, d, re, ve, ll."""
    one = cp[at]
    two = cp[np.minimum(at + 1, len(cp) - 1)]
    pair = (end - at >= 2) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    return np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(pair, 2, 0))


class Encoder:
    """Ids of texts; ``encode`` gives one flat array and the number of ids of every text."""

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their names in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        split = (pre.get("pretokenizers") or [{}])[0]
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.spaced = pre == _BYTE_RULE and not spec.get("normalizer")
        self.folded = (split.get("pattern"), split.get("invert"), norm) == ({"Regex": _WORD_RULE}, True, ["NFC", "Replace", "Lowercase"])
        if self.spaced or self.folded:
            self.kind, self.low = _classes(self.folded)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(2 * CACHE, np.uint64), np.zeros(2 * CACHE, np.int32)
        self.at, self.n = np.zeros(CACHE, np.int32), np.zeros(CACHE, np.int32)
        self.flat, self.used, self.size = np.zeros(1 << 16, np.uint32), 0, 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key (none is 0), -1 where it is not known: open addressing, all keys at once."""
        found, left, step = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        while len(left):
            place = ((keys[left] >> np.uint64(20)) + np.uint64(step)) & np.uint64(2 * CACHE - 1)
            there = self.keys[place]
            hit = there == keys[left]
            found[left[hit]] = self.slots[place[hit]]
            left = left[~hit & (there != 0)]
            step += 1
        return found

    def _keep(self, keys: np.ndarray, slots: np.ndarray) -> None:
        left, step = np.arange(len(keys)), 0
        while len(left):
            place = ((keys[left] >> np.uint64(20)) + np.uint64(step)) & np.uint64(2 * CACHE - 1)
            free = self.keys[place] == 0
            self.keys[place[free]] = keys[left[free]]
            mine = free & (self.keys[place] == keys[left])
            self.slots[place[mine]] = slots[left[mine]]
            left = left[~mine]
            step += 1

    def _model(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces. Many are given to the model as one text, with gaps at which it must cut them again."""
        out: list = [None] * len(texts)
        if self.folded:
            kinds = [(" ", 1, range(len(texts)))]
        else:
            joined = [i for i, t in enumerate(texts) if t[0] == " " and not t.isspace()]
            apart = [i for i, t in enumerate(texts) if not t[0].isspace()]
            kinds = [("", 1, joined), ("\n", 2, apart)]
        for gap, stride, rows in kinds:
            rows = list(rows)
            groups = [rows[i:i + 128] for i in range(0, len(rows), 128)]
            for group, e in zip(groups, self.model.encode_batch_fast([gap.join(texts[i] for i in g) for g in groups], add_special_tokens=False)):
                got: dict[int, list[int]] = {}
                for word, i in zip(e.word_ids, e.ids):
                    got.setdefault(word, []).append(i)
                if len(got) == stride * (len(group) - 1) + 1 and max(got) == len(got) - 1:
                    for j, i in enumerate(group):
                        out[i] = got[stride * j]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.model.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = e.ids
        return out

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        got = self._model(texts)
        n = np.array([len(x) for x in got], np.int64)
        ids = np.array([i for x in got for i in x], np.uint32)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(len(self.flat), np.uint32))
        self.flat[self.used:self.used + len(ids)] = ids
        mine = np.arange(self.size, self.size + len(keys))
        self.at[mine], self.n[mine] = self.used + np.cumsum(n) - n, n
        self.used, self.size = self.used + len(ids), self.size + len(keys)
        self._keep(keys, mine)

    def _cut(self, cp: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces; ``edge`` marks the first character of every text."""
        new = edge.copy()
        new[0] = True
        new[1:] |= kind[1:] != kind[:-1]
        if self.folded:
            new |= kind == NUMBER
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(cp))
        k = kind[s]
        follows = np.append(~edge[s[1:]], False)  # the next run is of the same text
        lone = np.zeros(len(s), bool)
        if self.spaced:
            gap = np.flatnonzero((k == SPACE) & follows)
            joins = gap[cp[e[gap] - 1] == 32]
            s[joins + 1] -= 1
            lone[joins + 1] = True
        quote = np.flatnonzero((k == OTHER) & (e - s == 1) & (cp[s] == 39) & follows & ~lone)
        quote = quote[k[quote + 1] == LETTER]
        if len(quote):
            more = _contraction(cp, s[quote + 1], e[quote + 1])
            e[quote] += more
            s[quote + 1] += more
        if self.folded:
            keep = (k != SPACE) & (e > s)
            return s[keep], e[keep]
        gap = (k == SPACE) & follows
        # of a gap before a word the last character stands apart: a space joins the word, another is a piece of its own
        own = np.flatnonzero(gap & (e - s > 1) & ~np.append(lone[1:], False))
        e = e - gap
        starts, ends = np.append(s, e[own]), np.append(e, e[own] + 1)
        single = np.flatnonzero(gap & (e == s) & ~np.append(lone[1:], False))
        starts, ends = np.append(starts, s[single]), np.append(ends, s[single] + 1)
        keep = ends > starts
        starts, ends = starts[keep], ends[keep]
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not (self.spaced or self.folded):
            return self._whole(texts)
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        size = np.array([len(t) for t in texts])
        begin = np.append(0, np.cumsum(size))
        small = np.minimum(cp, 0xFFFF)
        kind = self.kind[small]
        kind[cp > 0xFFFF] = HARD
        hard = np.zeros(len(texts), bool)
        if (kind == HARD).any():
            hard[np.searchsorted(begin, np.flatnonzero(kind == HARD), "right") - 1] = True
        if self.folded:
            cp = np.where(cp > 0xFFFF, cp, self.low[small])
        edge = np.zeros(len(cp), bool)
        edge[begin[:-1][size > 0]] = True
        s, e = self._cut(cp, kind, edge)
        doc = np.searchsorted(begin, s, "right") - 1
        if hard.any():
            easy = ~hard[doc]
            s, e, doc = s[easy], e[easy], doc[easy]
        keys, first, back = np.unique(run_hash(cp.astype(np.uint32, copy=False), s, e), return_index=True, return_inverse=True)
        keys = np.maximum(keys, np.uint64(1))
        if len(keys) > CACHE:
            return self._whole(texts)
        if self.size + len(keys) > CACHE:
            self._clear()
        mine = self._find(keys)
        fresh = np.flatnonzero(mine < 0)
        if len(fresh):
            self._learn(keys[fresh], [cp[s[j]:e[j]].tobytes().decode("utf-32-le") for j in first[fresh]])
            mine[fresh] = self._find(keys[fresh])
        mine = mine[back]
        n = self.n[mine]
        to = np.cumsum(n)
        ids = self.flat[np.arange(to[-1] if len(to) else 0) - np.repeat(to - n - self.at[mine], n)]
        count = np.bincount(doc, n, len(texts)).astype(np.int64)
        if not hard.any():
            return ids, count
        rows = np.flatnonzero(hard)
        more, many = self._whole([texts[i] for i in rows])
        parts, at = np.split(ids, np.cumsum(count)[:-1]), np.append(0, np.cumsum(many))
        for j, i in enumerate(rows):
            parts[i], count[i] = more[at[j]:at[j + 1]], many[j]
        return np.concatenate(parts), count


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept between batches and tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release() -> None:
    """Forget the worker's encoder, some 150 MB with the pieces it has met."""
    _encoders.clear()
