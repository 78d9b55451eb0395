"""Column expressions over scalars, arrays and sequence text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue alphabets and name maps of the domain.
AA20 = "ACDEFGHIKLMNPQRSTVWY"
SS3 = "HEC"
Q8 = "HBEGITSC"
RESIDUE_ALIASES = {"HSP": "HIS", "HSD": "HIS", "HSE": "HIS", "CYX": "CYS", "ASH": "ASP", "GLH": "GLU"}
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "SEC": "U", "PYL": "O",
}


def binned(x: Column, thresholds: list[float]) -> Column:
    """Right-closed class number: how many of the rising thresholds lie below x."""
    if sorted(thresholds) != list(thresholds):
        raise ValueError("thresholds must rise")
    return F.when(x.isNotNull(), sum((F.when(x > t, 1).otherwise(0) for t in thresholds), F.lit(0))).cast("int")


def not_exactly(x: Column, value: float = 1.0) -> Column:
    """0 where x equals the value exactly, else 1; unlike a threshold, smaller values count as 1."""
    return (x != F.lit(value)).cast("int")


def one_hot(x: Column, domain: list[str]) -> Column:
    """Indicator array over a domain; all zeros for anything else."""
    return F.array(*[F.coalesce((x == F.lit(c)).cast("int"), F.lit(0)) for c in domain])


def one_hot_sums(seq: Column, domain: list[str]) -> Column:
    """Sum of the one-hot rows of a text's characters, and how many characters are none of the domain's as the last element; no row a character."""
    counts = [F.length(seq) - F.length(F.replace(seq, F.lit(c), F.lit(""))) for c in domain]
    return F.array(*counts, F.length(F.translate(seq, "".join(domain), "")))


def mapped(x: Column, table: dict[str, str], default: str | None = None) -> Column:
    entries = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    found = F.element_at(entries, x)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def residue_letter(name: Column) -> Column:
    """One-letter code of a residue name, through its protonation aliases; X where unknown."""
    upper = F.upper(F.trim(name))
    return mapped(F.coalesce(mapped(upper, RESIDUE_ALIASES), upper), THREE_TO_ONE, "X")


def split_chain(x: Column) -> tuple[Column, Column]:
    """Lower-case entry id and chain of ENTRY_CHAIN; nulls without an underscore."""
    parts = F.split(x, "_", 2)
    ok = F.size(parts) == 2
    return F.when(ok, F.lower(parts[0])), F.when(ok, parts[1])


def clean_header(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "^>+", ""))


def name_token(x: Column, from_end: int = 2) -> Column:
    """The underscore-separated token that many from the end; null if there are fewer."""
    return F.try_element_at(F.split(x, "_"), F.lit(-from_end))


def letters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(values: Column) -> Column:
    """Index of the largest element, the first of ties."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ordinal_probabilities(logits: list[Column]) -> Column:
    """Class probabilities of cumulative logits P(y > k): neighbour differences, clamped at 0."""
    cumulative = [F.lit(1.0), *[sigmoid(x) for x in logits], F.lit(0.0)]
    return F.array(*[F.greatest(a - b, F.lit(0.0)) for a, b in zip(cumulative, cumulative[1:], strict=False)])


def bounded_head(x: Column, low: float, span: float) -> Column:
    return F.lit(low) + F.lit(span) * sigmoid(x)


def positional_encoding(pos: Column, dim: Column, width: int) -> Column:
    """Sine at even and cosine at odd dimensions, with wavelengths in a geometric row to 10000."""
    angle = pos / F.pow(F.lit(10000.0), (dim - dim % 2) / F.lit(float(width)))
    return F.when(dim % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def focal_loss(p_true: Column, gamma: float = 2.0) -> Column:
    return -F.pow(1 - p_true, F.lit(gamma)) * F.ln(p_true)


def bce_with_logits(x: Column, target: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * target + F.log1p(F.exp(-F.abs(x)))


def huber(error: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(error) <= delta, 0.5 * error * error).otherwise(delta * (F.abs(error) - 0.5 * delta))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def identity(a: Column, b: Column) -> Column:
    """Share of equal positions of two sequences; null where lengths differ or are 0."""
    same = F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x == y), lambda x: x))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), same / F.length(a))


def segment_truncated(seq: Column, i: Column, half: int) -> Column:
    """The window around 0-based i, cut off at the ends."""
    start = F.greatest(i - half, F.lit(0))
    return F.substring(seq, start + 1, F.least(i + half + 1, F.length(seq)) - start)


def segment_shifted(seq: Column, i: Column, width: int) -> Column:
    """The window of that width around 0-based i, moved to stay inside where the sequence is long enough."""
    start = F.greatest(F.least(i - width // 2, F.length(seq) - width), F.lit(0))
    return F.substring(seq, start + 1, F.lit(width))


def kmers(seq: Column, k: int) -> Column:
    """All overlapping windows of k characters, in one pass (a substring by position would walk the text anew each time)."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def dot(a: Column, b: Column, dim: int) -> Column:
    """Inner product of two arrays of known length.

    Up to 16 terms are generated code; more would make a method that the JVM
    no longer compiles, and a fold over the arrays is several times faster.
    """
    if dim <= 16:
        return reduce(lambda x, y: x + y, [a[k] * b[k] for k in range(dim)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)


def hashed_order(*cols: Column, seed: int = 42) -> Column:
    """A reproducible random order: md5 of the key and a seed."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))).cast("binary"))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
