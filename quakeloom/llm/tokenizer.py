"""Token ids of whole columns of text with a public byte-level BPE vocabulary.

A byte-level BPE never merges across the pieces its splitting rule makes, so a piece's ids are the
same wherever it stands. Texts are therefore split with numpy, each distinct piece is encoded once by
the tokenizer and kept, and ids are gathered per text. Pieces are told apart by a 64-bit hash. Texts that
hold the vocabulary's added tokens, or characters not assigned in Python's own tables, are left whole to
the tokenizer, so ids are always those it gives as loaded.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np
import pandas as pd

from quakeloom.llm._text import mix, powers

#: Most pieces a process keeps; beyond that it starts anew. It bounds memory (some 20 MB), not results.
KEPT_PIECES = 400_000
#: Places in the table of kept pieces; each piece has two, and one that finds both taken replaces another.
TABLE = 1 << 20
#: Pieces encoded in one call; the tokenizer's own results are large.
LOT = 4096

# Unicode White_Space, and what may follow an apostrophe in the splitting rule.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]

_LETTER, _DIGIT, _OTHER, _SPACE, _UNKNOWN = 0, 1, 2, 3, 4


@cache
def _classes() -> np.ndarray:
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = _LETTER
        elif k == "N":
            kinds[c] = _DIGIT
        elif unicodedata.category(chr(c)) == "Cn":
            kinds[c] = _UNKNOWN  # the tokenizer's table of characters may be newer than this one
    kinds[WHITE_SPACE] = _SPACE
    return kinds


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points ``cps`` of texts with the n + 1 offsets ``offs``."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cps]
    new_text = np.zeros(n + 1, bool)
    new_text[offs] = True
    starts = new_text[:-1].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # the last of some white space before something else: a space joins what follows, others stand alone
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~new_text[1:-1])
    starts[last] = True
    starts[last[cps[last] == 32] + 1] = False
    marks = np.flatnonzero((cps[:-1] == 39) & starts[:-1] & (kind[1:] == _LETTER) & ~new_text[1:-1])
    if len(marks):
        padded = np.concatenate([cps, np.zeros(3, cps.dtype)])
        ends = offs[np.searchsorted(offs, marks, "right")]
        for tail in CONTRACTIONS:
            fits = marks + 1 + len(tail) <= ends
            for k, ch in enumerate(tail):
                fits &= padded[marks + 1 + k] == ord(ch)
            hit = marks[fits]
            starts[hit + 1] = False
            after = hit + 1 + len(tail)
            after = after[after < n]
            # a space joined to what follows has no start of its own after it
            starts[after] = True
    return np.flatnonzero(starts)


class Encoder:
    """Ids of many texts; one per process and vocabulary, see :func:`encoder`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(TABLE, np.uint64)
        self.slots = np.full(TABLE, -1, np.int32)
        self.at = np.zeros(1, np.int64)  # of each kept piece's ids in flat; the last is the end
        self.flat = np.zeros(0, np.uint32)

    @property
    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for."""
        if not hasattr(self, "_lengths"):
            vocab = self.tokenizer.get_vocab()
            self._lengths = np.zeros(max(vocab.values()) + 1, np.int32)
            for token, i in vocab.items():
                self._lengths[i] = len(token)  # the vocabulary writes each byte as one character
        return self._lengths

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of UTF-8 texts with byte offsets ``offs``, and the texts' n + 1 offsets in them."""
        raw = buf.tobytes()
        text = raw.decode("utf-8")
        if len(text) == len(raw):
            cps, at = buf, offs
        else:
            cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            lead = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
            at = lead[offs]
        whole = self._whole(raw, offs, cps, at)
        if len(whole):
            return self._mixed(buf, offs, whole)
        starts = pieces(cps, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(cps))
        up, down = powers(len(cps) + 1)
        sums = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * up[: len(cps)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        codes, distinct = pd.factorize(h)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if len(self.at) > KEPT_PIECES:
            self._forget()
        slot = self._slots(distinct, text, starts, ends, first)
        begin = self.at[slot]
        length = (self.at[slot + 1] - begin)[codes]
        begin = begin[codes]
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        ids = self.flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, at)]

    def _whole(self, raw: bytes, offs: np.ndarray, cps: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts that the splitting rule alone may not do justice to."""
        found = np.searchsorted(at, np.flatnonzero(_classes()[cps] == _UNKNOWN), "right") - 1
        places = []
        for token in self.added:
            k = raw.find(token)
            while k >= 0:
                places.append(k)
                k = raw.find(token, k + 1)
        return np.unique(np.concatenate([found, np.searchsorted(offs, np.array(places, np.int64), "right") - 1]))

    def _mixed(self, buf: np.ndarray, offs: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, but the texts ``whole`` are encoded one by one."""
        ids, sizes, lo = [], [], 0
        for k in [*whole.tolist(), len(offs) - 1]:
            if k > lo:
                part, at = self.encode(buf[offs[lo] : offs[k]], offs[lo : k + 1] - offs[lo])
                ids.append(part)
                sizes.append(np.diff(at))
            if k < len(offs) - 1:
                own = self.tokenizer.encode(buf[offs[k] : offs[k + 1]].tobytes().decode(), add_special_tokens=False).ids
                ids.append(np.array(own, np.uint32))
                sizes.append(np.array([len(own)]))
            lo = k + 1
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _slots(self, distinct, text, starts, ends, first) -> np.ndarray:
        """The kept slot of each distinct piece; pieces not kept are encoded now."""
        one = (distinct & np.uint64(TABLE - 1)).astype(np.int64)
        two = (distinct >> np.uint64(40) & np.uint64(TABLE - 1)).astype(np.int64)
        slot = np.where(self.keys[one] == distinct, self.slots[one], np.where(self.keys[two] == distinct, self.slots[two], -1)).astype(np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            where = first[new]
            spans = list(zip(starts[where].tolist(), ends[where].tolist(), strict=True))
            ids = []
            for k in range(0, len(spans), LOT):
                ids += [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch([text[a:b] for a, b in spans[k : k + LOT]], add_special_tokens=False)]
            base = len(self.at) - 1
            slot[new] = np.arange(base, base + len(new))
            place = np.where(self.slots[one[new]] < 0, one[new], np.where(self.slots[two[new]] < 0, two[new], one[new]))
            self.slots[place] = slot[new]
            self.keys[place] = distinct[new]
            # of several put in one place the last write stands in both arrays alike
            ends_of = self.at[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            self.at = np.concatenate([self.at, ends_of])
            self.flat = np.concatenate([self.flat, *ids])
        return slot


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
