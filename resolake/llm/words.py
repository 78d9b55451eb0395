"""Words of whole texts, split on UTF-8 bytes by a table, and bounded memos over them."""

from __future__ import annotations

from collections.abc import Callable

#: Where a memo is full, what came first stays: it is commonest.
MEMO_WORDS, MEMO_BYTES = 400_000, 48


def byte_table(is_word: Callable[[int], bool], lower: bool = True) -> bytes:
    """For bytes.translate: ASCII bytes outside words become spaces, A-Z small letters if `lower`; all bytes from 0x80 stay, so characters stay whole."""

    def put(c: int) -> int:
        if c >= 0x80:
            return c
        c = c + 32 if lower and 0x41 <= c <= 0x5A else c
        return c if is_word(c) else 0x20

    return bytes(map(put, range(256)))


#: Runs of letters and digits, and of letters; both lower-case A-Z only.
LETTERS_DIGITS = byte_table(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)
LETTERS = byte_table(lambda c: 0x61 <= c <= 0x7A)


def split_words(text: str | None, table: bytes) -> list[bytes]:
    return (text or "").encode().translate(table).split()


class Memo(dict):
    """make(word) by word, remembered for the first MEMO_WORDS words of at most MEMO_BYTES bytes."""

    def __init__(self, make: Callable[[bytes], int]):
        self.make = make

    def __missing__(self, word: bytes) -> int:
        value = self.make(word)
        if len(self) < MEMO_WORDS and len(word) <= MEMO_BYTES:
            self[word] = value
        return value
