"""Token ids of whole texts by the tokenizers library, with a bounded table of the ids of parts.

A text is cut where every pre-tokenizer of its kind cuts too, so the ids of the parts,
joined, are the ids of the text. Kinds:

- "dropped": white space only separates (it is no part of any token);
- "leading": one space goes with what follows it (byte-level); a line end between other
  characters is a part of its own;
- "whole": any other tokenizer; every text is encoded whole.

Parts end at white space and where ASCII letters, digits and punctuation meet; next to
other characters, and after an apostrophe, nothing is cut. Cutting, hashing and looking up
all parts of some megabytes of text are array operations; the library encodes each part
once, when it is first seen. Rare texts that hold longer runs of white space (or NUL) under
"leading" take a slower path with the same ids.

Parts are found by 64-bit hashes of their bytes and verified: a part of up to seven bytes is
its hash, one to one; of longer ones all bytes are compared with those kept, and a part that
differs is encoded on its own, like every part of more than MAX_BYTES bytes. So the ids are
the library's for any text.

The strings of a tokenizer's special tokens in a text become those tokens, as the library's
plain call has it; with `special_as_text` they are ordinary text. A text that holds one is
encoded whole.
"""

from __future__ import annotations

import json
import os
from functools import cache
from typing import NamedTuple

import numpy as np

from .common import WordHasher, mix

#: Parts kept; later ones are encoded anew for each slice. Frequent parts come early.
MAX_KEPT = 800_000
MAX_BYTES = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20
_OTHER, _LETTER, _DIGIT, _PUNCT, _QUOTE, _LINE = 1, 2, 3, 4, 5, 6
_WHITE = b" \t\n\x0b\x0c\r"


def kind_of(path: str) -> str:
    with open(path) as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "leading"
    steps = [s["type"] for s in norm.get("normalizers", [norm]) if s]
    split = (pre.get("pretokenizers") or [pre])[0]
    if set(steps) <= {"NFC", "Lowercase", "Replace"} and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert"):
        return "dropped"
    return "whole"


class Cut(NamedTuple):
    """The parts of a block: hashes, places, and what tells them apart.

    `shape` is twice the size in bytes (MAX_BYTES + 1 for all longer ones) plus whether a space leads;
    `head` holds the first eight bytes, `tails` for each further eight bytes the parts that have them.
    """

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    head: np.ndarray
    tails: list[tuple[np.ndarray, np.ndarray]]


class Parts(WordHasher):
    """Cuts a block of NUL-separated texts into parts and hashes them."""

    def __init__(self, kind: str):
        super().__init__(b"")
        c = np.full(256, _OTHER, dtype=np.uint8)
        for b in range(33, 127):
            c[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _PUNCT
        c[ord("'")] = _QUOTE
        c[list(_WHITE)] = _LINE if kind == "leading" else 0
        c[[0, 32]] = 0
        self.kind = c
        self.separator = c == 0
        cut = np.ones((7, 7), dtype=bool)
        cut[_OTHER, [_OTHER, _LETTER, _DIGIT, _PUNCT, _QUOTE]] = cut[[_LETTER, _DIGIT, _PUNCT, _QUOTE], _OTHER] = False
        cut[_QUOTE, [_QUOTE, _LETTER, _DIGIT, _PUNCT]] = cut[_PUNCT, _QUOTE] = False
        cut[range(7), range(7)] = False
        self.joint = cut.ravel()
        self.leading = kind == "leading"

    def block(self, data: bytes) -> Cut:
        raw = np.frombuffer(data, dtype=np.uint8)
        kind = np.zeros(len(raw) + 2, dtype=np.uint8)
        kind[1:-1] = self.kind[raw]
        edge = self.joint[kind[:-1] * np.uint8(7) + kind[1:]]
        start, end = np.flatnonzero(edge & (kind[1:] != 0)), np.flatnonzero(edge & (kind[:-1] != 0))
        spaced = (start > 0) & (raw[np.maximum(start, 1) - 1] == 32) if self.leading else np.zeros(len(start), dtype=bool)
        size = np.minimum(end - start, MAX_BYTES + 1)
        shape = (2 * size + spaced).astype(np.uint8)
        view = np.ndarray(len(raw) + 1, dtype="<u8", buffer=data + bytes(8), strides=(1,))
        head = view[start] & _MASKS[np.minimum(size, 8)]
        h = mix(head | shape.astype(np.uint64) << np.uint64(56))
        tails = []
        at = np.flatnonzero((size > 7) & (size <= MAX_BYTES))
        h[at] = mix(head[at] + shape[at] * _ODD)
        for k in range(8, MAX_BYTES, 8):
            at = at[size[at] > k]
            if not len(at):
                break
            word = view[start[at] + k] & _MASKS[np.minimum(size[at] - k, 8)]
            h[at] = mix(h[at] * _ODD + word)
            tails.append((at, word))
        return Cut(h, start, end, shape, head, tails)


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        plain = special_as_text and all(t.special for t in added)
        # A token that is looked for in the normalised text may hide behind other characters.
        self.kind = "whole" if not plain and any(t.normalized for t in added) else kind_of(path)
        self.tokens = [] if plain else [t.content.encode() for t in added]
        self.parts = Parts(self.kind)
        self.limit = MAX_KEPT
        self.key = np.zeros(1 << 14, dtype=np.uint64)
        self.entry = np.full(1 << 14, -1, dtype=np.int32)
        self.at, self.size, self.n = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 12, dtype=np.int32), 0
        self.store, self.used = np.zeros(1 << 14, dtype=np.uint32), 0
        #: Of each entry: shape, first eight bytes, and where its further words begin among `words`.
        self.shape, self.head, self.tail = np.zeros(1 << 12, dtype=np.uint8), np.zeros(1 << 12, dtype=np.uint64), np.zeros(1 << 12, dtype=np.int32)
        self.words, self.n_words = np.zeros(1 << 12, dtype=np.uint64), 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        mask = np.uint64(len(self.key) - 1)
        slot = (h & mask).astype(np.int64)
        got = self.entry[slot]
        open_ = np.flatnonzero((got >= 0) & (self.key[slot] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.key) - 1)
            got[open_] = self.entry[slot[open_]]
            open_ = open_[(got[open_] >= 0) & (self.key[slot[open_]] != h[open_])]
        return got

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Adds different new hashes."""
        if 2 * (self.n + len(h)) > len(self.key):
            old = self.entry >= 0
            h, entry = np.concatenate([self.key[old], h]), np.concatenate([self.entry[old], entry])
            n = 1 << int(2 * len(h)).bit_length()
            self.key, self.entry = np.zeros(n, dtype=np.uint64), np.full(n, -1, dtype=np.int32)
        slot = (h & np.uint64(len(self.key) - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            free = free[first]
            self.key[slot[free]], self.entry[slot[free]] = h[free], entry[free]
            done = np.zeros(len(h), dtype=bool)
            done[free] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)

    def _room(self, name: str, need: int) -> None:
        have = getattr(self, name)
        if need > len(have):
            setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have) // 2), dtype=have.dtype)]))

    def _append(self, ids: list[list[int]]) -> np.ndarray:
        """Stores ids; their entries."""
        size = np.array([len(i) for i in ids], dtype=np.int64)
        flat = np.array([x for i in ids for x in i], dtype=np.uint32)
        for name in ("at", "size", "shape", "head", "tail"):
            self._room(name, self.n + len(ids))
        self._room("store", self.used + len(flat))
        entry = np.arange(self.n, self.n + len(ids))
        self.at[entry], self.size[entry] = self.used + np.cumsum(size) - size, size
        self.store[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(ids), self.used + len(flat)
        return entry

    def _remember(self, cut: Cut, part: np.ndarray, entry: np.ndarray) -> None:
        """Keeps the bytes of parts with their entries."""
        self.shape[entry], self.head[entry] = cut.shape[part], cut.head[part]
        more = np.maximum((cut.shape[part].astype(np.int64) // 2 + 7) // 8 - 1, 0)
        self.tail[entry] = self.n_words + np.cumsum(more) - more
        self._room("words", self.n_words + int(more.sum()))
        self.n_words += int(more.sum())
        of = np.full(len(cut.h), -1, dtype=np.int64)
        of[part] = entry
        for k, (at, word) in enumerate(cut.tails):
            mine = of[at] >= 0
            self.words[self.tail[of[at[mine]]] + k] = word[mine]

    def _unlike(self, cut: Cut, entry: np.ndarray) -> np.ndarray:
        """Which parts have other bytes than the entries (-1: none) that their hashes led to."""
        bad = (entry >= 0) & (self.shape[entry] != cut.shape)
        long = np.flatnonzero((cut.shape > 15) & (entry >= 0) & ~bad)
        bad[long] = self.head[entry[long]] != cut.head[long]
        for k, (at, word) in enumerate(cut.tails):
            mine = (entry[at] >= 0) & ~bad[at]
            at, word = at[mine], word[mine]
            bad[at] = self.words[self.tail[entry[at]] + k] != word
        return bad

    def _slow(self, data: bytes) -> bool:
        """Whether white space stands where "leading" parts don't tell how it is tokenized."""
        if not self.parts.leading:
            return b"\x00" in data
        raw = np.frombuffer(data, dtype=np.uint8)
        white = _IS_WHITE[raw]
        if len(raw) and (white[0] or white[-1] or (white[1:] & white[:-1]).any() or not raw.all()):
            return True
        at = np.flatnonzero(_LEADS[raw])
        return bool(len(at)) and any(c in _EXOTIC for i in at.tolist() if (c := data[i : i + (2 if data[i] == 0xC2 else 3)]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        data = [(t or "").encode() for t in texts]
        out: list[bytes] = [b""] * len(data)
        run, size = [], 0
        for i, d in enumerate(data):
            if self.kind == "whole" or len(d) > _SLICE or any(t in d for t in self.tokens) or self._slow(d):
                out[i] = np.array(self._library([texts[i] or ""])[0], dtype="<u4").tobytes()
                continue
            run.append(i)
            size += len(d)
            if size > _SLICE:
                self._slice(data, run, out)
                run, size = [], 0
        self._slice(data, run, out)
        return out

    def _slice(self, data: list[bytes], run: list[int], out: list[bytes]) -> None:
        block = b"\x00".join([data[i] for i in run])
        cut = self.parts.block(block)
        if not len(cut.h):
            return
        lead = cut.start - (cut.shape & 1)
        text = lambda part: block[lead[part] : cut.end[part]].decode()
        kept = self.n, self.used, self.n_words
        entry = self._find(cut.h)
        over = cut.shape >= 2 * (MAX_BYTES + 1)
        entry[over] = -1
        odd = self._unlike(cut, entry) | over
        new = np.flatnonzero((entry < 0) & ~odd)
        if len(new):
            fresh, first, back = np.unique(cut.h[new], return_index=True, return_inverse=True)
            first = new[first]
            got = self._append(self._library([text(p) for p in first.tolist()]))
            self._remember(cut, first, got)
            entry[new] = got[back]
            ours = np.full(len(entry), -1, dtype=entry.dtype)
            ours[new] = entry[new]
            odd |= self._unlike(cut, ours)
            # the first to come are kept; the rest is dropped after this slice
            keep = max(0, min(len(fresh), self.limit - kept[0]))
            if keep == len(fresh):
                kept = self.n, self.used, self.n_words
            elif keep:
                last = got[keep - 1]
                kept = int(last) + 1, int(self.at[last] + self.size[last]), int(self.tail[last]) + max((int(self.shape[last]) // 2 + 7) // 8 - 1, 0)
        if odd.any():
            parts: dict[str, int] = {}
            of = [parts.setdefault(text(p), len(parts)) for p in np.flatnonzero(odd).tolist()]
            entry[odd] = self._append(self._library(list(parts)))[of]
        size = self.size[entry].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.store[np.repeat(self.at[entry] - ends + size, size) + np.arange(ends[-1])].astype("<u4").tobytes()
        if len(new) and keep:
            self.n = int(got[0])  # entries in the table so far
            self._insert(fresh[:keep], got[:keep].astype(np.int32))
        self.n, self.used, self.n_words = kept
        offset = np.cumsum([0, *(len(data[i]) + 1 for i in run)])
        at = np.searchsorted(cut.start, offset)
        at = np.concatenate([[0], ends])[at] * 4
        for i, a, b in zip(run, at[:-1].tolist(), at[1:].tolist(), strict=True):
            out[i] = ids[a:b]


_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(_WHITE)] = True
#: White space beyond ASCII.
_EXOTIC = {chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[c[0] for c in _EXOTIC]] = True


@cache
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The process's encoder: its table outlives a task."""
    return Encoder(path, special_as_text)
