"""Local alignment of sequence pairs within a band of diagonals, many pairs at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd


class Scoring(NamedTuple):
    """Linear gaps. A mismatch costs less than half a match, so that alignments of 30 % identity still gain by growing."""

    match: int = 5
    mismatch: int = -2
    gap: int = -6


#: Low bits of a cell's value: identical pairs so far, so that of equal scores the most identical wins.
_BITS = 30
_NONE = -1  # beyond a sequence's ends


def codes(text: str) -> np.ndarray:
    """Code points, of any alphabet."""
    return np.frombuffer(text.encode("utf-32-le"), np.int32)


class _Pairs:
    """Queries in order of length with their targets, as columns, both such that an anti-diagonal of the band's cells is a run of rows."""

    def __init__(self, queries: list[np.ndarray], targets: list[np.ndarray], diagonals: np.ndarray, band: int):
        self.order = np.argsort([len(q) for q in queries], kind="stable")
        queries, targets = [queries[i] for i in self.order], [targets[i] for i in self.order]
        sizes = np.array([len(q) for q in queries], np.int64)
        self.count, self.rows, self.width = len(queries), int(sizes.max(initial=0)), 2 * band + 1
        self.shift = np.asarray(diagonals, np.int64)[self.order] - band  # target position of a row's first cell, less the row
        small = all(int(s.max(initial=0)) < 1 << 15 for side in (queries, targets) for s in side)  # most alphabets
        kind = np.int16 if small else np.int32
        self.letters = np.full((self.rows + self.width, self.count), _NONE, kind)  # targets, moved so that row i has cells i, i + 1 ...
        self.text = np.full((self.rows + 2 * band, self.count), _NONE - 1, kind)  # queries, `band` rows down
        for x, (q, t, s) in enumerate(zip(queries, targets, self.shift.tolist(), strict=True)):
            self.text[band : band + len(q), x] = q
            a, b = max(0, -s), min(len(self.letters), len(t) - s)
            if a < b:
                self.letters[a:b, x] = t[a + s : b + s]
        self.ended = np.searchsorted(sizes, np.arange(self.rows), side="right").tolist()  # queries over before a row


def banded_alignments(queries: list[np.ndarray], targets: list[np.ndarray], diagonals: np.ndarray, band: int, scoring: Scoring = Scoring()) -> dict[str, np.ndarray]:
    """Best local alignment of each query with its target among cells at most `band` off its diagonal (target less query position).

    All pairs advance together, an anti-diagonal at a time, so that no cell waits
    for another of its own; queries that are over leave. A cell hands on where
    its alignment began. Of equal values an alignment goes on diagonally before
    by a gap in the target, and that before one in the query, and ends first.
    Returns score, identical pairs, and the spans in the query and the target.
    """
    match, mismatch, gap = scoring
    step = 1 << _BITS
    same, other, open_ = match * step + 1, mismatch * step, -gap * step
    p = _Pairs(queries, targets, diagonals, band)
    filled = lambda rows, value=0: np.full((rows, p.count), value, np.int64)
    # the band's diagonals 0, 2, 4 ... and 1, 3, 5 ..., these between two that stay out of reach
    values, begun = (filled(band + 1), filled(band + 2)), (filled(band + 1), filled(band + 2))
    values[1][[0, -1]] = -1 << 61
    tops, top_begun, top_row = ([filled(band + 1), filled(band)] for _ in range(3))
    cells = [np.arange(odd, p.width, 2)[:, None] for odd in (0, 1)]
    for h in range(p.rows + band):
        k = p.ended[h - band] if h >= band else 0
        for odd in (0, 1):
            size = band + 1 - odd
            inner = slice(1, -1) if odd else slice(None)
            own, from_ = values[odd][inner, k:], begun[odd][inner, k:]
            row = h - cells[odd] // 2
            start = np.where(own > 0, from_, row * p.width + cells[odd])
            got = np.where(p.text[h + band - size + 1 : h + band + 1, k:][::-1] == p.letters[h + odd : h + odd + size, k:], same, other)
            got += own
            beside, beside_from = values[1 - odd][:, k:] - open_, begun[1 - odd][:, k:]
            for side in (slice(1, None), slice(None, -1)):
                better = beside[side] > got
                np.maximum(got, beside[side], out=got)
                np.copyto(start, beside_from[side], where=better)
            np.maximum(got, 0, out=own)
            from_[...] = start
            better = own > tops[odd][:, k:]
            if better.any():
                np.maximum(tops[odd][:, k:], own, out=tops[odd][:, k:])
                np.copyto(top_begun[odd][:, k:], start, where=better)
                np.copyto(top_row[odd][:, k:], row, where=better)
    best, began, ended = (np.concatenate(side) for side in (tops, top_begun, top_row))
    cell = np.concatenate(cells)
    score_of = best.max(axis=0, initial=0)
    at = np.where(best == score_of, ended * p.width + cell, np.iinfo(np.int64).max).argmin(axis=0)  # the first row, and in it the first cell
    some = np.arange(p.count)
    ends, begins, last = ended[at, some], began[at, some], cell[at, 0]
    score = (score_of + (step >> 1)) >> _BITS
    query = np.where(score_of > 0, ends - begins // p.width + 1, 0)
    target = np.where(score_of > 0, query + last - begins % p.width, 0)
    back = np.argsort(p.order)
    return {c: v[back] for c, v in {"score": score, "identical": score_of - (score << _BITS), "query_span": query, "target_span": target}.items()}


def columns_of(found: dict[str, np.ndarray], scoring: Scoring = Scoring()) -> np.ndarray:
    """Columns of an alignment: pairs and gaps, from its score, identical pairs and spans."""
    match, mismatch, gap = scoring
    m, spans = found["identical"], found["query_span"] + found["target_span"]
    # score = match m + mismatch x + gap g, and spans = 2 (m + x) + g
    x = (found["score"] - match * m - gap * (spans - 2 * m)) // (mismatch - 2 * gap)
    return spans - m - x


#: Cells of a row of all pairs that are aligned together, and letters of their queries.
CELLS, LETTERS = 1 << 15, 4 << 20
#: Pairs that may_cover holds at a time, and query positions between two looks at them.
COLUMNS, STEPS = 1 << 11, 32
#: Score above which a pair is aligned without looking any further: chance alone does not give it.
CERTAIN = 1_500


class Room(NamedTuple):
    """Query positions by pair: the first in the band, the last at which a covering alignment may begin, and one that it reaches; and whether it has room."""

    first: np.ndarray
    begin: np.ndarray
    reach: np.ndarray
    enough: np.ndarray


def room(n: np.ndarray, m: np.ndarray, diagonals: np.ndarray, band: int, coverage: float) -> Room:
    """What lengths n, m and the diagonal alone tell of alignments that cover both sequences."""
    low, high = diagonals - band, diagonals + band
    q, t = (np.ceil(coverage * size - 1e-6).astype(np.int64) for size in (n, m))
    first, last, left, right = np.maximum(0, -high), np.minimum(n - 1, m - 1 - low), np.maximum(0, low), np.minimum(m - 1, n - 1 + high)
    begin, reach = np.minimum(last + 1 - q, right + 1 - t - low), np.maximum(first + q, left + t - high) - 1
    return Room(first, begin, reach, (last - first + 1 >= q) & (right - left + 1 >= t))


def may_cover(a: list[np.ndarray], b: list[np.ndarray], diagonals: np.ndarray, band: int, coverage: float, scoring: Scoring = Scoring()) -> np.ndarray:
    """Places of the pairs in which a path that begins early enough for the coverage keeps a score of 0 or more as far as it must.

    No beginning of a best alignment scores less than 0, so the others have no
    alignment that covers both. Cells are taken along anti-diagonals, a column a
    pair; settled pairs make room for the next. Most pairs end soon after the
    last position at which an alignment may begin. Some too many stay, since
    paths may fall below 0 between two looks and letters count by their low bits.
    """
    n, m, at = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64), np.asarray(diagonals, np.int64)
    has = room(n, m, at, band, coverage)
    if not band or max(map(abs, scoring)) > 100:  # scores have to fit
        return np.flatnonzero(has.enough)
    waiting, stays = np.flatnonzero(has.enough & (has.begin < has.reach)), [np.flatnonzero(has.enough & (has.begin >= has.reach))]
    text, letters = ((np.concatenate([*side, np.zeros(1, np.int32)]) & 0xFF).astype(np.uint16) << 8 for side in (a, b))  # any two that differ, differ by 200 or more
    text_at, letters_at = np.cumsum(n) - n, np.cumsum(m) - m
    dead = np.int16(-20_000)
    match, gap, less = np.int16(scoring.match), np.int16(scoring.gap), np.full((band + 1, COLUMNS), scoring.match - scoring.mismatch, np.uint16)
    pair, row = np.empty(0, np.int64), np.empty(0, np.int64)
    even, odd = np.empty((band + 1, 0), np.int16), np.empty((band + 2, 0), np.int16)  # the band's diagonals 0, 2, 4 ... and 1, 3, 5 ..., these between two that are always dead
    while len(pair) or len(waiting):
        if len(pair) <= COLUMNS // 2:
            more, waiting = waiting[: COLUMNS - len(pair)], waiting[COLUMNS - len(pair) :]
            pair, row = np.r_[pair, more], np.r_[row, has.first[more]]
            even, odd = (np.concatenate([v, np.zeros((len(v), len(more)), np.int16)], axis=1) for v in (even, odd))
            odd[[0, -1]] = dead
        back = row + np.arange(STEPS - 1, -band - 1, -1)[:, None]  # along an anti-diagonal the query is read backwards
        q = np.where((back >= 0) & (back < n[pair]), text.take(text_at[pair] + back, mode="clip"), np.uint16(0x00FF))
        on = row + at[pair] - band + np.arange(STEPS + band)[:, None]
        t = np.where((on >= 0) & (on < m[pair]), letters.take(letters_at[pair] + on, mode="clip"), np.uint16(0xFFF0))
        free = has.begin[pair] + band - row  # steps in which alignments may begin
        floor, over = np.where(free >= 0, np.int16(0), dead), set(free[(free >= 0) & (free < STEPS)].tolist())
        got, beside, inner = np.empty_like(even), np.empty_like(even), odd[1:-1]
        for i in range(STEPS):
            if i - 1 in over:
                floor[free < i] = dead
            own = STEPS - 1 - i
            for cells, x, width in ((even, i, band + 1), (inner, i + 1, band)):
                value, other = got[:width], beside[:width]
                np.bitwise_xor(q[own : own + width], t[x : x + width], out=value.view(np.uint16))
                np.minimum(value.view(np.uint16), less[:width, : len(pair)], out=value.view(np.uint16))
                np.subtract(cells, value, out=value)
                value += match
                sides = odd if cells is even else even
                np.maximum(sides[:-1], sides[1:], out=other)
                other += gap
                np.maximum(value, other, out=value)
                np.maximum(value, floor, out=cells)
        row = row + STEPS
        best = np.maximum(even.max(axis=0), inner.max(axis=0))
        past = row - 1 > has.reach[pair]
        across = past | (best > CERTAIN)
        stays.append(pair[across])
        go = np.flatnonzero(~across & (best >= 0))
        pair, row, even, odd = pair[go], row[go], even[:, go], odd[:, go]
    return np.sort(np.concatenate(stays))


def align_pairs(band: int, coverage: float, scoring: Scoring = Scoring()):
    """For mapInPandas over (a, b, diagonal, a_seq, b_seq): a, b, diagonal, identity, a_cover, b_cover, for pairs that may reach the coverage. Pairs of like length go together."""

    def coded(pdf: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        return [codes(s) for s in pdf["a_seq"]], [codes(s) for s in pdf["b_seq"]], pdf["diagonal"].to_numpy().astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part = (pdf["a_seq"].str.len() + pdf["b_seq"].str.len()).cumsum().to_numpy() // (2 * LETTERS)
            groups = [pdf[part == x] for x in np.unique(part)]
            pdf = pd.concat([own.iloc[may_cover(*coded(own), band, coverage, scoring)] for own in groups]) if groups else pdf
            sizes = pdf["a_seq"].str.len().to_numpy()
            pdf, sizes = pdf.iloc[np.argsort(sizes, kind="stable")], np.sort(sizes)
            i = 0
            while i < len(pdf):
                together = max(1, min(CELLS // (2 * band + 1), LETTERS // max(int(sizes[min(i + 64, len(pdf) - 1)]), 1)))
                own = pdf.iloc[i : i + together]
                i += together
                a, b, at = coded(own)
                found = banded_alignments(a, b, at, band, scoring)
                identity = found["identical"] / np.maximum(columns_of(found, scoring), 1)
                n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
                yield pd.DataFrame({"a": own["a"].to_numpy(), "b": own["b"].to_numpy(), "diagonal": at, "identity": identity, "a_cover": found["query_span"] / n, "b_cover": found["target_span"] / m})

    return run
