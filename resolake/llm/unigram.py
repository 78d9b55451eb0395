"""Unigram pieces with log scores: a double-array trie and forward scores.

The vocabulary file gives pieces in merge order, not probabilities, so a piece's
log score is that of a Zipf distribution over its order. Characters that no
piece covers fall back to their UTF-8 bytes at a fixed penalty, as one choice.
Ties between segmentations go to the longer last piece.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Units longer than this are scored position by position instead of in a batch.
LONG_UNIT = 64
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceTrie:
    """Pieces of a vocabulary in a double array: child = base[state] + code, valid where check[child] == state."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int]):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.text = {i: p for i, p, _ in pieces}
        alphabet = sorted({ord(c) for _, p, _ in pieces for c in p})
        self.codes = np.zeros(max(alphabet, default=0) + 2, np.int32)  # code points beyond its end have code 0: no piece
        self.codes[alphabet] = np.arange(1, len(alphabet) + 1)
        self.longest = max((len(p) for _, p, _ in pieces), default=1)
        self.unknown = min((s for *_, s in pieces), default=0.0) - UNKNOWN_PENALTY
        children: list[dict[int, int]] = [{}]
        ends: list[tuple[int, float] | None] = [None]
        for i, piece, score in pieces:
            node = 0
            for c in piece:
                code = int(self.codes[ord(c)])
                if code not in children[node]:
                    children[node][code] = len(children)
                    children.append({})
                    ends.append(None)
                node = children[node][code]
            ends[node] = (i, score)
        self._place(children, ends, len(alphabet) + 1)

    def _place(self, children: list[dict[int, int]], ends: list, n_codes: int) -> None:
        """Nodes with many children get their slots first, by trying many bases at once; single children fill what is free."""
        size = 2 * len(children) + 4 * n_codes + 4
        used = np.zeros(size, bool)
        used[:2] = True  # state 0 leads nowhere, state 1 is the root
        at, bases = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
        at[0], low = 1, 2
        for node in sorted((n for n, kids in enumerate(children) if len(kids) > 1), key=lambda n: -len(children[n])):
            kids = children[node]
            codes = np.fromiter(sorted(kids), np.int64, len(kids))
            start = low
            while True:
                slots = start + np.flatnonzero(~used[start : start + 512])
                tried = slots[slots > codes[0]] - codes[0]
                fits = np.flatnonzero(~used[tried[:, None] + codes].any(axis=1))
                if len(fits):
                    break
                start += 512
            if start > low + 8 * 512:  # mostly full by now: search no more below
                low += 512
            bases[node] = base = tried[fits[0]]
            used[base + codes] = True
            for code, child in kids.items():
                at[child] = base + code
        free = np.flatnonzero(~used)
        single = [n for n, kids in enumerate(children) if len(kids) == 1]
        codes = np.array([next(iter(children[n])) for n in single], np.int64)
        slots = free[free > n_codes][: len(single)]
        bases[single] = slots - codes
        at[[next(iter(children[n].values())) for n in single]] = slots
        self.base, self.check = np.zeros(size + n_codes, np.int32), np.full(size + n_codes, -1, np.int32)
        self.piece, self.score = np.full(size + n_codes, -1, np.int32), np.zeros(size + n_codes)
        self.base[at] = bases
        for node, kids in enumerate(children):
            if kids:
                self.check[bases[node] + np.fromiter(kids, np.int64, len(kids))] = at[node]
            if ends[node] is not None:
                self.piece[at[node]], self.score[at[node]] = ends[node]
        self.n_codes = n_codes

    def code_points(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def encode_chars(self, points: np.ndarray) -> np.ndarray:
        return self.codes[np.minimum(points, len(self.codes) - 1)]

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states; 0 where no piece goes on."""
        to = self.base[states] + codes
        return np.where((states > 0) & (codes > 0) & (self.check[to] == states), to, 0)


@lru_cache(maxsize=2)
def piece_trie(path: str) -> PieceTrie:
    """The trie of a SentencePiece vocabulary file: its normal pieces and its byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
    pieces = [(i, sp.id_to_piece(i), float(np.float32(-math.log(r + 1) - total))) for r, i in enumerate(normal)]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any(MARK in p.lstrip(MARK) for _, p, _ in pieces):
        raise ValueError("pieces that hold a word start inside them are not supported")
    return PieceTrie(pieces, byte_ids)


def units(text: str) -> list[str]:
    """A text as marked words, each with the space marks before it; no piece crosses their borders."""
    return _UNITS.findall(MARK + text.replace(" ", MARK)) if text else []


_UTF8 = np.array([1] * 0x80 + [2] * 0x780 + [3] * 0xF800, np.int32)


def utf8_lengths(points: np.ndarray) -> np.ndarray:
    return np.where(points < 0x10000, _UTF8[np.minimum(points, 0xFFFF)], 4)


def best_path(trie: PieceTrie, unit: str) -> list[tuple[int, int]]:
    """(state, or 0 for a character in bytes; length) along the best path of one unit, position by position."""
    codes = trie.encode_chars(trie.code_points(unit))
    n = len(codes)
    states = np.full(n, 1, np.int64)
    reach = []  # per length: the state of the piece that starts at each position, 0 if none
    for k in range(min(trie.longest, n)):
        states = trie.step(states[: n - k], codes[k:])
        if not states.any():
            break
        reach.append(np.where(trie.piece[states] >= 0, states, 0))
    best, back = [0.0] + [-math.inf] * n, [(0, 0)] * (n + 1)
    single = reach[0] if reach else np.zeros(n, np.int64)
    for i in range(n):
        if not single[i]:
            s = best[i] + trie.unknown
            if s > best[i + 1]:
                best[i + 1], back[i + 1] = s, (0, 1)
        for k, found in enumerate(reach):
            if i < len(found) and found[i]:
                s = best[i] + trie.score[found[i]]
                if s > best[i + k + 1]:
                    best[i + k + 1], back[i + k + 1] = s, (int(found[i]), k + 1)
    path, at = [], n
    while at:
        path.append(back[at])
        at -= back[at][1]
    return path[::-1]
