"""How sources of a language differ in their terms: pairwise divergence and each source's overused terms.

Tasks count terms in byte radix tries with a counter per source at the leaves. A
trie that grows beyond a bound is streamed out in UTF-8 order and begun anew;
Spark deals all leaves out by prefix range, where the sorted streams merge. A
second pass over the merged leaves gathers, for blocks of terms, all sources'
smoothed shares as a matrix, whose columns give the pairs' sums and the
tie-ordered candidate terms.

Shares are in units of 1e-9: p = 1 + floor(1e9 (count + 1) / (N + V)), and two
shares differ by floor((p - q)^2 / q). All arithmetic is in whole numbers.

Contract for odd input
----------------------
Null text, language and source count as ''. Each row is a document. Sources
without terms, and languages that keep no term, still give their pairs, of value
0 in the latter. A language of one source has no pairs. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, quoted, skew_join
from .pretoken import array_slices
from .radix_trie import RadixTrie
from .words import LETTERS

#: A task's tries are streamed out beyond so many leaves and counters, or names of sources; texts are read so many bytes at a time.
TRIE_SIZE, MAX_NAMES, SLICE_BYTES = 1_500_000, 1 << 19, 4_000_000
#: Cells of a block of terms by sources, and of the pair sums that a task holds.
CELLS, PAIR_CELLS = 1 << 18, 1 << 22
#: Groups (a language and a source) up to this many go to every executor, at some 30 bytes each; more are joined by shuffle.
BROADCAST_GROUPS = 100_000
UNIT = 1_000_000_000
LEAF = "lang string, term string, documents long, sources array<string>, counts array<long>"


def words_of(column: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """(all words of a text column one after another, the row of each); bytes that `table` makes spaces part them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if ends[0] == ends[-1]:
        return pa.array([], pa.binary()), np.empty(0, np.int64)
    raw = np.frombuffer(table, np.uint8)[np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = raw != 0x20
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    at = ends[:-1][ends[:-1] < len(raw)]
    first[at] = inside[at]  # no word goes on from one text to the next
    starts = np.flatnonzero(first)
    data = raw[inside[:-1]]
    offsets = np.append((np.cumsum(inside[:-1]) - 1)[starts], len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words, np.searchsorted(ends, starts, side="right") - 1


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, the sum of n of each)."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[starts], np.add.reduceat(n[order], starts)


class _Counted:
    """A language's terms with their documents and occurrences by source, by parts of a task; they meet at the leaves of one trie."""

    def __init__(self):
        self.terms: list[pa.Array] = []
        self.documents: list[np.ndarray] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []  # place of a term and source as one number, occurrences
        self.size = self.placed = 0

    def add(self, terms: pa.Array, codes: np.ndarray, docs: np.ndarray, sources: np.ndarray) -> None:
        """Words as codes of terms, each with its document and that one's source (numbers below 2^20)."""
        used, codes = np.unique(codes, return_inverse=True)
        once = np.unique(codes * (docs.max() + 1) + docs)
        keys, n = np.unique((self.placed + codes) << 20 | sources, return_counts=True)
        self.terms.append(terms.take(pa.array(used)))
        self.documents.append(np.bincount(once // (docs.max() + 1), minlength=len(used)))
        self.entries.append((keys, n))
        self.placed += len(used)
        self.size += len(used) + len(keys)

    def batches(self, lang: str, names: list[str], size: int = 16384) -> Iterator[pa.RecordBatch]:
        """Leaves in byte order."""
        trie, coded = RadixTrie(), pa.concat_arrays(self.terms).dictionary_encode()
        leaves = np.fromiter(map(trie.leaf, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        terms, numbers = zip(*trie, strict=True)
        place = np.empty(len(numbers), np.int64)
        place[np.array(numbers, np.int64)] = np.arange(len(numbers))
        place = place[leaves][np.asarray(coded.indices)]  # of each part's terms among the leaves
        _, documents = _sums(place, np.concatenate(self.documents))
        keys, counts = (np.concatenate(x) for x in zip(*self.entries, strict=True))
        keys, counts = _sums(place[keys >> 20] << 20 | keys & 0xFFFFF, counts)
        offsets = np.searchsorted(keys, np.arange(len(terms) + 1) << 20)
        sources = pa.array(names, pa.string()).take(pa.array(keys & 0xFFFFF))
        for i in range(0, len(terms), size):
            own = terms[i : i + size]
            a, b = offsets[i], offsets[i + len(own)]
            lists = pa.array((offsets[i : i + len(own) + 1] - a).astype(np.int32))
            columns = [pa.array([lang] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string()), pa.array(documents[i : i + len(own)]), pa.ListArray.from_arrays(lists, sources.slice(a, b - a)), pa.ListArray.from_arrays(lists, pa.array(counts[a:b]))]
            yield pa.RecordBatch.from_arrays(columns, names=_LEAF_NAMES)


_LEAF_NAMES = ["lang", "term", "documents", "sources", "counts"]


def _drain(found: dict[str, _Counted], names: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for lang in sorted(found):
        yield from found[lang].batches(lang, list(names))
    found.clear()
    names.clear()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, _Counted] = defaultdict(_Counted)
    names: dict[str, int] = {}
    for batch in batches:
        for a, b in array_slices(batch.column(2), SLICE_BYTES):
            part = batch.slice(a, b - a)
            words, docs = words_of(part.column(2), LETTERS)
            coded = words.dictionary_encode()
            terms, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
            langs = np.array(part.column(0).to_pylist(), object)
            sources = np.array([names.setdefault(x, len(names)) for x in part.column(1).to_pylist()], np.int64)
            for lang in dict.fromkeys(langs.tolist()):
                own = (langs == lang)[docs]
                if own.any():
                    found[lang].add(terms, codes[own], docs[own], sources[docs[own]])
            if sum(c.size for c in found.values()) >= TRIE_SIZE or len(names) >= MAX_NAMES:
                yield from _drain(found, names)
    yield from _drain(found, names)


def _merge_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum neighbouring leaves of one term; leaves come in order of language and term."""
    held = None  # the last term of a batch, which may go on in the next
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        lang, term = rows.column(0), rows.column(1)
        other = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)))
        starts = np.flatnonzero(np.concatenate([[True], np.asarray(other)]))
        held = rows.slice(int(starts[-1]))
        if len(starts) > 1:
            yield _summed(rows.slice(0, int(starts[-1])), starts[:-1])
    if held is not None:
        yield _summed(held, np.zeros(1, np.int64))


def _summed(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """One row for the rows from each start to the next."""
    names = rows.column(3).flatten().dictionary_encode()
    width = max(len(names.dictionary), 1)
    group = np.repeat(np.arange(len(starts)), np.diff(starts, append=rows.num_rows))
    entries = np.repeat(group, np.asarray(rows.column(3).value_lengths()))
    keys, counts = _sums(entries * width + np.asarray(names.indices).astype(np.int64), np.asarray(rows.column(4).flatten()))
    lists = pa.array(np.searchsorted(keys, np.arange(len(starts) + 1) * width).astype(np.int32))
    first = pa.array(starts)
    documents = np.add.reduceat(np.asarray(rows.column(2)), starts)
    columns = [rows.column(0).take(first), rows.column(1).take(first), pa.array(documents), pa.ListArray.from_arrays(lists, names.dictionary.take(pa.array(keys % width))), pa.ListArray.from_arrays(lists, pa.array(counts))]
    return pa.RecordBatch.from_arrays(columns, names=_LEAF_NAMES)


def term_counts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, term, documents, sources, counts), a row a term of a language, from docs (lang, source, text)."""
    leaves = scratch.table(docs.select("lang", "source", "text").mapInArrow(_count_terms, LEAF))
    return leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge_leaves, LEAF)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT (counts + 1) / totals), exactly; no count reaches its total."""
    if totals.max(initial=1) < 9_000_000_000:
        return 1 + (counts + 1) * UNIT // totals
    out, rest = np.zeros_like(counts), counts + 1
    for _ in range(3):  # three decimal digits at a time
        out = out * 1000 + rest * 1000 // totals
        rest = rest * 1000 % totals
    return 1 + out


class _Audit:
    """Pair sums and best candidate terms of one language, over the terms that a task reads."""

    def __init__(self, sources: list[str], sums: np.ndarray, kept: int, top: int):
        self.sources, self.top = sources, top
        self.index = {s: i for i, s in enumerate(sources)}
        self.totals, self.total = sums + kept, np.array(int(sums.sum()) + kept, np.int64)
        self.pairs = np.zeros((len(sources), len(sources)), np.int64)
        self.found: list[list[tuple[int, bytes]]] = [[] for _ in sources]

    def add(self, terms: list[str], row: np.ndarray, names: list[str], counts: np.ndarray) -> None:
        """A block of terms; row, names, counts: the terms' occurrences by source."""
        c = np.zeros((len(terms), len(self.sources)), np.int64)
        c[row, np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))] = counts
        p, q = shares(c, self.totals), shares(c.sum(1), self.total)
        for s in range(len(self.sources)):
            d = p[:, s : s + 1] - p
            self.pairs[s] += (d * d // p).sum(0)
            over = np.flatnonzero((c[:, s] > 0) & (p[:, s] > q))
            if len(over):
                d = p[over, s] - q[over]
                self._offer(s, d * d // q[over], over, terms)

    def _offer(self, s: int, values: np.ndarray, at: np.ndarray, terms: list[str]) -> None:
        if len(values) > self.top:  # all that tie with the last place stay
            good = values >= np.partition(values, -self.top)[-self.top]
            values, at = values[good], at[good]
        found = self.found[s]
        found += zip((-values).tolist(), (terms[i].encode() for i in at.tolist()), strict=True)
        if len(found) > 2 * self.top:
            found.sort()
            del found[self.top :]

    def rows(self) -> Iterator[tuple[str, str, str, int]]:
        """(source, part, item, value)."""
        for s, source in enumerate(self.sources):
            for t, n in enumerate(self.pairs[s].tolist()):
                if s != t:
                    yield source, "pair", self.sources[t], n
            for value, term in sorted(self.found[s])[: self.top]:
                yield source, "term", term.decode(), -value


_RESULT = "lang string, source string, part string, item string, value long"


def _audit(top: int):
    def emit(audits: dict[str, _Audit]) -> Iterator[pa.RecordBatch]:
        for lang, audit in audits.items():
            rows = list(audit.rows())
            for i in range(0, len(rows), 1 << 16):
                columns = list(zip(*rows[i : i + (1 << 16)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0])), *(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["lang", "source", "part", "item", "value"])
        audits.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits: dict[str, _Audit] = {}
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                own = batch.filter(pa.array(langs == lang))
                if lang not in audits:
                    if sum(a.pairs.size for a in audits.values()) > PAIR_CELLS:
                        yield from emit(audits)
                    audits[lang] = _Audit(own.column(4)[0].as_py(), np.asarray(own.column(5)[0].values), own.column(6)[0].as_py(), top)
                own = own.filter(own.column(1).is_valid())
                step = max(1, CELLS // len(audits[lang].sources))
                for i in range(0, own.num_rows, step):
                    some = own.slice(i, step)
                    terms, names, counts = some.column(1).to_pylist(), some.column(2), some.column(3)
                    row = np.repeat(np.arange(len(terms)), np.asarray(counts.value_lengths()))
                    audits[lang].add(terms, row, names.flatten().to_pylist(), np.asarray(counts.flatten()))
        yield from emit(audits)

    return run


def divergence_audit(docs: DataFrame, least_documents: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per (lang, source): part `pair`, all other sources of the language by falling divergence, and part `term`, the source's `top` overused terms.

    What grows with sources only (k a language) is their k x k pair sums, as the
    result does; a task holds them for the languages of the terms it reads.
    """

    def named(col: str, name: str):
        return F.coalesce(F.col(quoted(col)).cast("string"), F.lit("")).alias(name)

    rows = docs.select(named(lang_col, "lang"), named(source_col, "source"), named(text_col, "text"))
    with Scratch(docs.sparkSession) as scratch:
        kept = scratch.table(term_counts(rows, scratch).where(F.col("documents") >= least_documents).drop("documents"))
        sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
        groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
        terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
        listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("g"))
        langs = scratch.table(listed.join(terms, "lang", "left").select("lang", F.col("g.source").alias("all_sources"), F.col("g.n").alias("all_counts"), F.coalesce("kept", F.lit(0).cast("long")).alias("kept")))
        n_groups = langs.agg(F.coalesce(F.sum(F.size("all_sources")), F.lit(0)).alias("n")).first()["n"]
        joined = kept.join(F.broadcast(langs), "lang") if n_groups <= BROADCAST_GROUPS else skew_join(kept, langs, ["lang"], "term")
        none = F.lit(None)
        heads = langs.select("lang", none.cast("string").alias("term"), none.cast("array<string>").alias("sources"), none.cast("array<long>").alias("counts"), "all_sources", "all_counts", "kept")
        audited = joined.select(*heads.columns).unionByName(heads).mapInArrow(_audit(top), _RESULT)
        found = scratch.keep(audited.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def divergence_sql(least_documents: int = 3, top: int = 200) -> str:
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
w as (select r, lang, source, unnest(ws) as term from d),
k as (select lang, term from w group by 1, 2 having count(distinct r) >= {least_documents}),
v as (select lang, count(*) as v from k group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as c from w semi join k using (lang, term) group by 1, 2, 3),
full_c as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c from g join k using (lang) left join c using (lang, source, term)),
s as (select lang, source, sum(c) as n from full_c group by 1, 2),
p as (select f.lang, f.source, f.term, f.c, 1 + (1000000000::hugeint * (f.c + 1)) // (s.n + v.v) as p from full_c f join s using (lang, source) join v using (lang)),
lc as (select lang, term, sum(c) as c from c group by 1, 2),
q as (select lang, term, 1 + (1000000000::hugeint * (lc.c + 1)) // ((select sum(n) from s where s.lang = lc.lang) + v.v) as q from lc join v using (lang)),
x as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b using (lang, term) where a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select p.lang, p.source, 'term' as part, p.term as item, ((p - q) * (p - q) // q)::bigint as value from p join q using (lang, term) where p.c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= {top}"""
