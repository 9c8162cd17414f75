"""Token ids of whole texts: each distinct unit of a text goes to the tokenizer once.

The vocabulary's normalizer and splitter join nothing over blanks, tabs and line
ends. Inside a word of ASCII and Latin letters they cut at every change between
letters, digits (each one alone) and marks, so these are units of their own; any
other word (an apostrophe, a bar as in added tokens, other alphabets) is one unit.
Units are found, hashed and looked up for a megabyte of text at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from tracewell.llm import texts as portion

#: Units whose ids a Python worker remembers, and the longest one (in bytes) that it does.
REMEMBERED, LONGEST = 600_000, 64
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_KIND = np.full(256, _LETTER, dtype=np.uint8)
_KIND[:128] = [_SPACE if c in " \t\n\r" else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _MARK for c in map(chr, range(128))]
#: ASCII that may join its neighbours: control characters (some are white space), the apostrophe (contractions) and the bar (added tokens).
_ODD = np.array([c < 32 and chr(c) not in "\t\n\r" or c in (39, 124, 127) for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Tabulation hashing: a random number for each byte at each place, twice over.
_RANDOM = np.random.default_rng(4_096).integers(0, 1 << 63, (2, LONGEST * 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PARTS = re.compile(r"([!-&(-/:-@\[-`{-~]*)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
#: The letters before it are in every Unicode version's tables; U+0130 becomes a letter and a mark in lower case.
_LAST, _DOTTED = "԰", "İ"


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of UTF-8 text, and which of them are whole words that aren't cut."""
    kind, odd = _KIND[data], _ODD[data]
    if (data >= 128).any():
        # U+00C0 to U+027F are a lead byte from C3 to C9 and one more: letters, but for the signs of multiplication and division
        latin = (data >= 0xC3) & (data <= 0xC9)
        before = np.concatenate((np.zeros(1, np.uint8), data[:-1]))
        pair = (before.astype(np.uint16) << 8) | data
        odd |= (data >= 128) & ~latin & ~((before >= 0xC3) & (before <= 0xC9))
        odd |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0)
    new = np.ones(len(data), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start = np.flatnonzero(new)
    end, kinds = np.append(start[1:], len(data)), kind[start]
    inside = kinds != _SPACE
    first = inside & np.concatenate(([True], ~inside[:-1]))
    start, end, first = start[inside], end[inside], first[inside]
    if not len(start):
        return start, end, first
    odds = np.concatenate(([0], np.cumsum(odd, dtype=np.int64)))
    heads = np.flatnonzero(first)
    whole = (odds[end[np.append(heads[1:], len(start)) - 1]] > odds[start[heads]])
    last = end[np.append(heads[1:], len(start)) - 1]
    word = np.cumsum(first) - 1
    uncut = whole[word]
    end = np.where(uncut, last[word], end)
    keep = first | ~uncut
    return start[keep], end[keep], uncut[keep]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... of every range, one after another."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths - starts, lengths)


class Words:
    """A tokenizer with the ids of the units it has met lately."""

    def __init__(self, path: str):
        self.full, self.light = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for units that are one piece in their normal form already
        self.light.normalizer = normalizers.Sequence([])
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.keys, self.checks = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        self.slots = np.empty(0, dtype=np.int64)
        # by slot: where the unit's ids are in ``ids``, how many, and the lookup that used it last
        self.at, self.size, self.used = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.ids = np.empty(0, dtype=np.uint32)
        self.clock = 0

    def pieces(self, pieces: list[str]) -> Iterator[np.ndarray]:
        """The ids of pieces in their normal form, a thousand to a call, told apart by the tokens that end a piece."""
        for at in range(0, len(pieces), 1_000):
            part = pieces[at : at + 1_000]
            ids = np.asarray(self.light.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                yield from np.split(ids, ends[:-1])
            else:
                yield from self.words(part)

    def words(self, words: list[str]) -> Iterator[np.ndarray]:
        """The ids of any words, one by one, by the whole tokenizer."""
        for at in range(0, len(words), 1_000):
            for e in self.full.encode_batch_fast(words[at : at + 1_000], add_special_tokens=False):
                yield np.asarray(e.ids, dtype=np.uint32)

    def normal(self, word: str) -> str | None:
        """The normal form of a word of letters that are the same in all of it; None for others."""
        word = unicodedata.normalize("NFC", word)
        return "".join(map(str.lower, word)) if word.isalpha() and max(word) < _LAST and _DOTTED not in word else None

    def learn(self, found: list[str], whole: list[bool]) -> list[np.ndarray]:
        """The ids of units."""
        plan: list[tuple[str, ...] | str] = []
        for unit, uncut in zip(found, whole, strict=True):
            if not uncut:
                low = unit if unit.isascii() else self.normal(unit)
                plan.append(unit if low is None else (low,))
            elif (m := _PARTS.fullmatch(unit)) and (low := self.normal(m[2])) and not any(a in unit for a in self.added):
                plan.append(tuple(filter(None, (m[1], low, m[3]))))
            else:
                plan.append(unit)
        light = list({p for x in plan if not isinstance(x, str) for p in x})
        other = list({x for x in plan if isinstance(x, str)})
        by_piece = dict(zip(light, self.pieces(light), strict=True))
        by_word = dict(zip(other, self.words(other), strict=True))
        return [by_word[x] if isinstance(x, str) else by_piece[x[0]] if len(x) == 1 else np.concatenate([by_piece[p] for p in x]) for x in plan]

    def forget(self) -> None:
        """Keep the half of the units that was used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        self.ids = self.ids[spread(self.at[keep], self.size[keep])]
        self.size, self.used = self.size[keep], self.used[keep]
        self.at = np.cumsum(self.size) - self.size
        place = np.full(len(self.slots), -1)
        place[keep] = np.arange(len(keep))
        left = place[self.slots] >= 0
        self.keys, self.checks, self.slots = self.keys[left], self.checks[left], place[self.slots[left]]

    def remember(self, keys: np.ndarray, checks: np.ndarray, ids: list[np.ndarray]) -> None:
        """New units, ``keys`` in rising order."""
        size = np.array([len(x) for x in ids])
        at = len(self.ids) + np.cumsum(size) - size
        place = np.searchsorted(self.keys, keys)
        slots = np.arange(len(self.at), len(self.at) + len(keys))
        self.keys, self.checks, self.slots = np.insert(self.keys, place, keys), np.insert(self.checks, place, checks), np.insert(self.slots, place, slots)
        self.ids = np.concatenate([self.ids, *ids])
        self.at, self.size, self.used = np.append(self.at, at), np.append(self.size, size), np.append(self.used, np.full(len(size), self.clock))

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, one after another, and how many each has."""
        parts = [t.encode() + b" " for t in texts]
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        begins = np.cumsum([0] + [len(p) for p in parts])
        start, end, uncut = units(data)
        if not len(start):
            return np.empty(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        length = end - start
        flat = data[_KIND[data] != _SPACE]
        flat = np.where(np.repeat(uncut, length), flat, _LOWER[flat])
        offset = np.cumsum(length) - length
        cell = np.minimum(np.arange(len(flat)) - np.repeat(offset, length), LONGEST - 1) * 256 + flat
        key, check = (np.add.reduceat(r[cell], offset) for r in _RANDOM)
        self.clock += 1
        each, first, which = np.unique(key, return_index=True, return_inverse=True)
        alone = length > LONGEST
        place = np.minimum(np.searchsorted(self.keys, each), max(0, len(self.keys) - 1))
        known = self.keys[place] == each if len(self.keys) else np.zeros(len(each), dtype=bool)
        text = lambda i: flat[offset[i] : offset[i] + length[i]].tobytes().decode()
        fresh = np.flatnonzero(~known & ~alone[first])
        if len(fresh):
            at = first[fresh]
            self.remember(each[fresh], check[at], self.learn([text(i) for i in at], uncut[at].tolist()))
            place = np.minimum(np.searchsorted(self.keys, each), len(self.keys) - 1)
        if len(self.keys):
            slot = self.slots[place][which]
            alone |= self.checks[place][which] != check  # one key for two units
        else:
            slot = np.zeros(len(start), dtype=np.int64)
            alone[:] = True
        self.used[slot[~alone]] = self.clock
        at, size, ids = self.at, self.size, self.ids
        if alone.any():
            these = np.flatnonzero(alone)
            own = list(self.words([text(i) for i in these]))
            slot[these] = len(at) + np.arange(len(these))
            own_size = np.array([len(x) for x in own])
            at, size, ids = np.append(at, len(ids) + np.cumsum(own_size) - own_size), np.append(size, own_size), np.concatenate([ids, *own])
        out = ids[spread(at[slot], size[slot])]
        owner = np.searchsorted(begins, start, side="right") - 1
        counts = np.bincount(owner, weights=size[slot], minlength=len(texts)).astype(np.int64)
        if len(self.at) > REMEMBERED:
            self.forget()
        return out, counts

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; a bounded portion of text is worked on at once."""
        for some in portion.portions(texts):
            if len(some) == 1:
                yield np.concatenate([self.lookup([p])[0] for p in portion.parts_of(some[0])])
            else:
                ids, counts = self.lookup(some)
                yield from np.split(ids, np.cumsum(counts)[:-1])


@cache
def words_of(path: str) -> Words:
    """One for each Python worker."""
    return Words(path)
