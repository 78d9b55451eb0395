"""Tokenizing whole texts through a memo of their white-space units.

A word-level or byte-level BPE never merges across a single space or line end
between words, so a text's ids are the ids of its units (a word with the white
space before it) one after another. Invented or natural prose repeats its units
often; each worker tokenizes a unit once and gathers the rest with numpy.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with white space other than single spaces between words and single line ends after them, or with marks of special tokens.
_SPANNING = "^[ \n]|[ \n]$|[ \n][ \n]|[\\x00-\\x09\\x0b-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_FIRST = "\x01"
#: Units that a worker remembers, each of at most so many characters; longer ones are encoded anew.
MAX_UNITS, MAX_CHARS = 600_000, 64
#: Units that can be joined and cut again by bytes: lower-casing and normal forms keep their bytes, and a joined one keeps its own start.
_EASY = re.compile("[!-;=-~\u00a1-\u012f\u0132-\u017e]+")
_EASY_SPACED = re.compile("[ \t\n\r\x0b\f]+[^ \t\n\r\x0b\f<]+")


def _unit(key: str) -> str:
    """The text of a split unit: the first of a text stands alone, others follow a line end or a space."""
    return key[1:] if key[:1] == _FIRST else key if key[:1] == "\n" or not key else f" {key}"


class _Index(dict):
    def __missing__(self, unit: str) -> int:
        at = self[unit] = len(self)
        return at


class UnitMemo:
    """ids of many texts; encode_units gives the ids and lengths of units that are new to the worker."""

    def __init__(self, split: Callable[[str], list[str]], encode_units: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.split, self.encode_units = split, encode_units
        self._clear()

    def _clear(self) -> None:
        self.index, self.flat, self.used = _Index(), np.empty(1 << 16, np.int32), 0
        self.starts, self.lengths, self.known = np.empty(1 << 12, np.int32), np.empty(1 << 12, np.int32), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _append(self, units: list[str]) -> None:
        ids, lengths = self.encode_units(units)
        n, m = self.known + len(units), self.used + len(ids)
        self.flat, self.starts, self.lengths = self._room(self.flat, m), self._room(self.starts, n), self._room(self.lengths, n)
        self.flat[self.used : m] = ids
        self.lengths[self.known : n] = lengths
        self.starts[self.known : n] = self.used + np.cumsum(lengths) - lengths
        self.used, self.known = m, n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        units = [self.split(t) for t in texts]
        counts = np.fromiter(map(len, units), np.int64, len(units))
        return self.gather(list(chain.from_iterable(units)), None, counts)

    def gather(self, units: list[str], at: np.ndarray | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from units: all in order, or distinct ones with `at` their order; counts: units of each text."""
        long = {u: i for i, u in enumerate(dict.fromkeys(u for u in units if len(u) > MAX_CHARS))}
        if long:  # below 0 until it is known where they go
            own = np.fromiter((-1 - long[u] if u in long else self.index[u] for u in units), np.int32, len(units))
        else:
            own = np.fromiter(map(self.index.__getitem__, units), np.int32, len(units))
        known, used, new = self.known, self.used, []
        if len(self.index) > known:
            new = list(islice(reversed(self.index), len(self.index) - known))[::-1]
            self._append(new)
        kept = self.known, self.used
        if long:
            own = np.where(own < 0, self.known - 1 - own, own)
            self._append(list(long))
        at = own if at is None else own[at]
        each = self.lengths[at]
        ends = np.cumsum(each, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - each).astype(np.int32), each) + np.arange(total, dtype=np.int32)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        self.known, self.used = kept
        if long and len(self.flat) > 1 << 22 and len(self.flat) > 4 * self.used:
            self.flat = self.flat[: 2 * self.used + (1 << 16)].copy()
        if self.known > MAX_UNITS:
            if 2 * np.count_nonzero(at >= known) > len(at):  # other texts than before: begin anew
                self._clear()
            else:  # full: what came first is commonest, so it stays and new units are forgotten
                for unit in new:
                    del self.index[unit]
                self.known, self.used = known, used
        return ids, np.diff(upto)


class TextTokenizer:
    """A tokenizers file, encoding texts as the library does with add_special_tokens=False: a special token's string in a text is that token."""

    def __init__(self, path: str, separator: str, keep_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.separator, self.mark = separator, self.plain.token_to_id(separator)
        added = sorted(self.plain.get_added_tokens_decoder().items(), key=lambda x: -len(x[1].content))
        self.added = {t.content: i for i, t in added}  # the longest first, as the library prefers them
        self.at_added = re.compile(f"({'|'.join(map(re.escape, self.added))})") if added else None
        #: Added tokens that are more than a fixed string; texts that may hold them go to the library whole.
        self.loose = any(t.single_word or t.lstrip or t.rstrip or t.normalized for _, t in added)
        self.keep_space = keep_space
        #: Bytes of each token: byte-level tokens have a character a byte, and word ends a mark.
        n = self.plain.get_vocab_size()
        self.sizes = np.array([len((self.plain.id_to_token(i) or "").removesuffix("</w>" if not keep_space else "\0")) for i in range(n)], np.int64)
        getattr(self.plain.model, "_resize_cache", lambda n: None)(0)  # new units only: they would not be found in the library's own cache
        self.memo = UnitMemo(list, lambda keys: self._units([_unit(k) for k in keys] if keep_space else keys))

    def _ids(self, texts: list[str]) -> np.ndarray:
        """All ids, a few texts at a time: the library's encodings are far larger than the ids."""
        parts = [np.array(e.ids, np.int32) for i in range(0, len(texts), 4) for e in self.plain.encode_batch_fast(texts[i : i + 4], add_special_tokens=False)]
        return np.concatenate(parts or [np.empty(0, np.int32)])

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """New units in a few long texts, cut again where the tokens' bytes add up to a unit's."""
        easy = [bool(_EASY_SPACED.fullmatch(u) if self.keep_space else _EASY.fullmatch(u)) for u in units]
        plain = [u for u, e in zip(units, easy, strict=True) if e]
        sizes = np.fromiter((len(u.encode()) for u in plain), np.int64, len(plain))
        joint = "" if self.keep_space else " "
        joined = [joint.join(plain[i : i + 2048]) for i in range(0, len(plain), 2048)]
        ids = self._ids(joined)
        ends = np.searchsorted(reached := np.cumsum(self.sizes[ids]), wanted := np.cumsum(sizes)) + 1
        if len(plain) and not (reached[-1] == wanted[-1] and (reached[ends - 1] == wanted).all()):
            return self._marked_units(units)
        lengths = np.diff(ends, prepend=0)
        if len(plain) == len(units):
            return ids, lengths
        more, each = self._marked_units([u for u, e in zip(units, easy, strict=True) if not e])
        which, every = np.array(easy), np.zeros(len(units), np.int64)
        every[which], every[~which] = lengths, each
        starts, out = np.cumsum(every) - every, np.empty(int(every.sum()), np.int32)
        for found, sizes, at in ((ids, lengths, starts[which]), (more, each, starts[~which])):
            out[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(found))] = found
        return out, every

    def _marked_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same with a special token between units, for any units."""
        odd = {i for i, u in enumerate(units) if "<|" in u or len(u) > 100_000}
        plain = [u for i, u in enumerate(units) if i not in odd]
        joined = [self.separator.join(plain[i : i + 512]) + self.separator for i in range(0, len(plain), 512)]
        self.plain.encode_special_tokens = False
        ids = self._ids(joined)
        self.plain.encode_special_tokens = True
        ends = np.flatnonzero(ids == self.mark)
        lengths = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.mark]
        if odd:
            parts, at, each, k = [], 0, np.zeros(len(units), np.int64), iter(lengths.tolist())
            for i, u in enumerate(units):
                x = np.array(self.plain.encode(u, add_special_tokens=False).ids, np.int32) if i in odd else ids[at : at + (n := next(k))]
                at += 0 if i in odd else n
                each[i] = len(x)
                parts.append(x)
            ids, lengths = np.concatenate(parts), each
        return ids, lengths

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text); null counts as empty.

        Arrow splits the texts at single spaces and line ends and finds the
        distinct units; texts where such a split might part a run of white
        space are encoded whole.
        """
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(column):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        held = np.zeros(len(column), bool)
        for content in self.added:
            held |= np.asarray(pc.match_substring(column, content, ignore_case=self.loose))
        if not held.any():
            return self._encode(column)
        ids, lengths = self._encode(pc.if_else(pa.array(held), "", column))
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for i in np.flatnonzero(held).tolist():
            parts[i] = self._with_added(column[i].as_py())
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _with_added(self, text: str) -> np.ndarray:
        """The ids of a text that holds added tokens: each is its id, and what lies between is encoded by itself."""
        if self.loose:
            self.plain.encode_special_tokens = False
            ids = self._ids([text])
            self.plain.encode_special_tokens = True
            return ids
        pieces = self.at_added.split(text)
        ids, lengths = self._encode(pa.array(pieces[::2], pa.string()))
        tokens = np.array([self.added[x] for x in pieces[1::2]], np.int32)
        return np.insert(ids, np.cumsum(lengths)[:-1], tokens)

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts without added tokens, none null."""
        if not self.keep_space:
            return self._split(pc.replace_substring(column, "\n", " "))
        odd = pc.match_substring_regex(column, _SPANNING)
        plain = pc.if_else(odd, "", column)
        marked = pc.binary_join_element_wise(pa.scalar(_FIRST), pc.replace_substring(plain, "\n", " \n"), "")
        ids, lengths = self._split(pc.if_else(pc.equal(plain, ""), "", marked))
        whole = np.flatnonzero(np.asarray(odd))
        if not len(whole):
            return ids, lengths
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for i in whole.tolist():
            parts[i] = np.array(self.plain.encode(column[i].as_py(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _split(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(column, " ")
        found = lists.flatten().dictionary_encode()
        return self.memo.gather(found.dictionary.to_pylist(), np.asarray(found.indices), np.asarray(lists.value_lengths()).astype(np.int64))


@lru_cache(maxsize=4)
def tokenizer(path: str, separator: str, keep_space: bool) -> TextTokenizer:
    """The worker's own tokenizer of a file; it lives as long as the worker."""
    return TextTokenizer(path, separator, keep_space)


def array_slices(column: pa.Array, size: int = 8_000_000):
    """Index ranges of a text column of about so many bytes, so that memory stays bounded by them or by one text."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    at = 0
    while at < len(column):
        start = int(ends[at - 1]) if at else 0
        to = max(int(np.searchsorted(ends, start + size, side="right")), at + 1)
        yield at, to
        at = to
    pa.default_memory_pool().release_unused()  # executors' workers share memory with their JVM


def texts_of(column: pa.Array):
    """The texts one by one, with no more than a slice of them as Python strings."""
    for a, b in array_slices(column, 4_000_000):
        yield from column.slice(a, b - a).to_pylist()
