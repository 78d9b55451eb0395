"""A SentencePiece unigram model with the pieces of a vocabulary file and given scores, for comparison in tests."""

import struct


def _varint(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _fields(data):
    at = 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, kind, data[at : at + size]
            at += size


def _put(field, kind, value):
    body = _varint(value) if kind == 0 else value if kind in (1, 5) else _varint(len(value)) + value
    return _varint(field << 3 | kind) + body


def unigram_model(path, scores):
    """Serialized model; scores: by piece id."""
    out, i = b"", 0
    for field, kind, value in _fields(open(path, "rb").read()):
        if field == 1:
            parts = [(f, k, v) for f, k, v in _fields(value) if f != 2]
            value = b"".join(_put(*p) for p in parts) + _put(2, 5, struct.pack("<f", scores.get(i, 0.0)))
            i += 1
        elif field == 2:
            parts = [(f, k, v) for f, k, v in _fields(value) if f != 3]
            value = b"".join(_put(*p) for p in parts) + _put(3, 0, 1)
        out += _put(field, kind, value)
    return out
