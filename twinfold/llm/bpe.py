"""Exact ids of a `tokenizers` vocabulary, encoding each distinct unit of text once per worker.

A unit is a run of text at whose ends the tokenizer's own pre-tokenizer always cuts, so the ids of a text are
the ids of its units in order. Units come from array arithmetic on the text buffer; only units that the worker
has not met go through the library. Texts where the cut is not certain (Unicode white space, a special token's
string) are encoded whole. The cache is bounded: when it holds `cache_units` units, those met in one block only go.
"""

from __future__ import annotations

import os
import re
from itertools import chain, filterfalse, repeat

import numpy as np
import pyarrow as pa

from twinfold.llm.words import text_buffer

#: White space beyond ASCII, as UTF-8: U+0085 U+00A0 U+1680 U+2000-U+200A U+2028 U+2029 U+202F U+205F U+3000.
UNICODE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
CACHE_UNITS = 600_000
#: Whether a byte is an ASCII letter or digit, and whether it is other printable ASCII. Pre-tokenizers cut between the
#: two, except at an apostrophe, which may begin a contraction.
_LETTER = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_SIGN = np.array([33 <= b <= 126 and b != 39 and not chr(b).isalnum() for b in range(256)])
#: Units of Latin letters are one pre-token as they are (lower-cased where the vocabulary is), so the model alone splits them.
_PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: The characters that byte-level models have for bytes: printable Latin-1 as it is, others from U+0100 on in their order.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_ENCODERS: dict[tuple, UnitEncoder] = {}


def encoder(path: str, leading_space: bool, cache_units: int = CACHE_UNITS) -> UnitEncoder:
    """This worker's encoder for the vocabulary file at `path`."""
    key = (path, leading_space, cache_units)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(path, leading_space, cache_units)
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Free what this worker's encoders hold, in steps that encode nothing."""
    _ENCODERS.clear()


class UnitEncoder:
    """leading_space: a word's unit holds the one space before it (byte-level vocabularies), else white space is dropped."""

    def __init__(self, path: str, leading_space: bool, cache_units: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.leading_space, self.cache_units = leading_space, cache_units
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile(b"|".join([UNICODE_SPACE] * leading_space + special) or rb"(?!)")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int32)
        self.used = 0

    def forget(self) -> None:
        """Keep the units met in several blocks, unless they alone fill half the cache."""
        names = np.array(list(self.known), object)
        keep = np.flatnonzero(self.hits[: len(names)] > 1)
        if len(keep) > self.cache_units // 2:
            keep = keep[:0]
        first, sizes = self.ends[keep], self.ends[keep + 1] - self.ends[keep]
        to = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(first - to[:-1], sizes) + np.arange(to[-1])]
        self.clear()
        self.append(names[keep].tolist(), ids, sizes)

    def append(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(units) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[at + 1 : at + 1 + len(units)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.known.update(zip(units, range(at, at + len(units)), strict=True))

    def learn(self, units: list[str]) -> None:
        plain = list(filter(_PLAIN, units))
        letters, accented = list(filter(str.isascii, plain)), [u for u in plain if not u.isascii()]
        other = list(filterfalse(_PLAIN, units))
        found = [*map(self.model_ids, self.shown(letters)), *map(self.model_ids, self.shown(accented))]
        if other:
            found += [c.ids for c in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.append(letters + accented + other, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def shown(self, units: list[str]) -> list[str]:
        """Plain units as the model takes them."""
        text = "\n".join(units)
        text = text if self.leading_space else text.lower()
        if text.isascii():
            return text.replace(" ", chr(_BYTE_CHARACTERS[32])).split("\n") if units else []
        return text.encode().decode("latin-1").translate(_BYTE_CHARACTERS).split(chr(_BYTE_CHARACTERS[10]))

    def model_ids(self, unit: str) -> list[int]:
        return [t.id for t in self.model.tokenize(unit)]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units of all texts."""
        space = (data == 32) | ((data >= 9) & (data <= 13))
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        letter, sign = _LETTER[data], _SIGN[data]
        turn = np.zeros(len(data), bool)
        turn[1:] = letter[1:] & sign[:-1] | sign[1:] & letter[:-1]
        if self.leading_space:
            after = np.zeros(len(data), bool)  # whether the next byte, of the same text, is no white space
            after[:-1] = ~space[1:]
            after[heads[1:] - 1] = False
            before = np.zeros(len(data), bool)  # whether the previous byte, of the same text, is white space
            before[1:] = space[:-1]
            before[heads] = False
            plain = np.zeros(len(data), bool)
            plain[1:] = data[:-1] == 32
            new = (space & (~before | after)) | (~space & before & ~plain) | turn
            new[heads] = True
            starts = np.flatnonzero(new)
            return starts, np.append(starts[1:], len(data))
        new = ~space
        new[1:] &= space[:-1]
        new |= turn
        new[heads] |= ~space[heads]
        last = ~space
        last[:-1] &= space[1:]
        last[:-1] |= turn[1:]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[tails] |= ~space[tails]
        return np.flatnonzero(new), np.flatnonzero(last) + 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all texts in order, and n + 1 bounds into them. Null counts as empty."""
        raw, offsets = text_buffer(column)
        n = len(offsets) - 1
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        odd = np.unique(np.searchsorted(offsets, [m.start() for m in self.whole.finditer(raw)], "right") - 1).astype(np.int64)
        data = np.frombuffer(raw, np.uint8)
        starts, ends = self.spans(data, offsets)
        if self.leading_space:
            edges, kept = np.append(starts, len(data)).astype(np.int64), raw
        else:
            kept = data[(data != 32) & ((data < 9) | (data > 13))]
            edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(kept)]).dictionary_encode()
        names = units.dictionary.to_pylist()
        if len(self.known) + len(names) > self.cache_units and self.known:
            self.forget()
        own = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(own < 0)
        if len(new):
            self.learn([names[i] for i in new.tolist()])
            own[new] = np.fromiter((self.known[names[i]] for i in new.tolist()), np.int64, len(new))
        self.hits[own] += 1
        slots = own[units.indices.to_numpy()]
        first = self.ends[slots]
        sizes = self.ends[slots + 1] - first
        to = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(first - to[:-1], sizes) + np.arange(to[-1])]
        bounds = to[np.searchsorted(starts, offsets)]
        if not len(odd):
            return ids, bounds
        texts = [raw[offsets[i] : offsets[i + 1]].decode() for i in odd]
        whole = {int(i): np.array(c.ids, np.uint32) for i, c in zip(odd, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
        parts, sizes, done = [], np.diff(bounds), 0
        for i, own in whole.items():
            parts += [ids[bounds[done] : bounds[i]], own]
            sizes[i], done = len(own), i + 1
        return np.concatenate([*parts, ids[bounds[done] :]]), np.concatenate([[0], np.cumsum(sizes)])


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with one end id after each text's."""
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(len(bounds))
