"""Token files, packing, piece codec and token counts: exact against the libraries and by round trip."""

import zlib

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from spm_model import unigram_model
from tokenizers import Tokenizer

from resolake.llm import packing, pretoken, sentencepiece_codec, token_counts, token_files, unigram

BYTE, WORD, PIECE = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = ["", None, " ", "\n\n a", "a \n", "a\xa0  b", "it's  the   end\t\tx ", "x<|endoftext|>y  z", "<|endoftext|>", " a <|startoftext|> b\n<|endoftext|><|endoftext|> c", "<|ENDOFTEXT|> <|endoftext", "<|<|endoftext|>|>", "é é ́x İstanbul ΑΣ ß", "日本語 text\r\n\r\n", "😀 ok", "don't 'S we'll 123abc", "word " * 3000, "Äpfel, Öl; über!", "a" * 500]


@pytest.fixture(scope="module")
def docs(spark):
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    rows = [(1000 - 3 * i, t, "x", 1) for i, t in enumerate([*base, *ODD])] + [(None, "null id", "x", 1), (5, "again", "x", 1), (5, "again", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, part int").repartition(3)


def reference_ids(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize(("path", "keep"), [(BYTE, True), (WORD, False)])
def test_memo_gives_the_tokenizers_ids(path, keep, monkeypatch):
    monkeypatch.setattr(pretoken, "MAX_UNITS", 40)
    own = pretoken.TextTokenizer(path, "<|endoftext|>", keep)
    for _ in range(3):  # cold, warm, after units were forgotten
        ids, lengths = own.encode(ODD)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == reference_ids(path, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sÄß  \n\t.,!<|>1  ́é"), max_size=25), max_size=5))
def test_memo_on_random_texts(texts):
    for path, keep in ((BYTE, True), (WORD, False)):
        own = pretoken.tokenizer(path, "<|endoftext|>", keep)
        ids, lengths = own.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])][: len(texts)] == reference_ids(path, texts)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_rank_coding_round_trip(values):
    control, data = token_files.encode_ranks(np.array(values, np.uint32))
    assert token_files.decode_ranks(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_token_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 3000)
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, BYTE, end_id=2)
    got = token_files.read_token_files(spark.read.parquet(path)).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = {}
    for r, ids in zip(rows, reference_ids(BYTE, [r.text for r in rows]), strict=True):
        want.setdefault(r.doc_id, []).append([*ids, 2])
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert all(r.ids in want[r.doc_id] and len(r.ids) == r.n_tokens for r in got)
    digest = token_files.token_file_digest(docs, BYTE, 2).collect()
    assert {(r.doc_id, r.start, r.ids_crc32) for r in digest} == {(r.doc_id, r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    assert token_files.token_file_digest(docs.limit(0), BYTE, 2).count() == 0


def test_packing(spark, docs):
    got = packing.pack_documents(docs, WORD, end_id=1).collect()
    want = {}
    for r, ids in zip(docs.collect(), reference_ids(WORD, [r.text for r in docs.collect()]), strict=True):
        want.setdefault(r.doc_id, []).append([*ids, 1])
    by_doc, by_sequence = {}, {}
    for p in got:
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, pieces in by_doc.items():
        if len(want[doc]) == 1:
            pieces.sort(key=lambda p: p.start)
            assert [x for p in pieces for x in p.ids] == want[doc][0] and {p.doc_tokens for p in pieces} == {len(want[doc][0])}
            assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()]
    assert sum(p.length for p in got) == sum(len(x) for v in want.values() for x in v)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        size = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()] and size <= 2048
        assert size & (size - 1) == 0  # nothing to pad
    assert packing.pack_documents(docs.limit(0), WORD, end_id=1).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5000), max_size=30), max_size=4))
def test_packer_places_every_token_once(calls):
    packer, done, n, sizes = packing.Packer(), [], 0, []
    for lengths in calls:
        for length in lengths:
            packer.add(n, length)
            sizes.append(length)
            n += 1
        done += packer.pack()
    done += packer.pack(last=True)
    placed = {}
    for row in done:
        assert sum(p[0] for p in row) <= 2048
        for length, doc, start in row:
            placed.setdefault(doc, []).append((start, length))
    for doc, size in enumerate(sizes):
        at = 0
        for start, length in sorted(placed[doc]):
            assert start == at
            at += length
        assert at == size


def test_step_groups_are_balanced():
    sizes = [2048] * 50 + [1024] * 31 + [256] * 77
    groups = packing.step_groups(sizes)
    loads = [sum(s for s, g in zip(sizes, groups, strict=True) if g == x) for x in set(groups)]
    assert max(loads) - min(loads) <= 2048 and max(loads) <= packing.STEP_TOKENS


@pytest.fixture(scope="module")
def pieces():
    trie = unigram.piece_trie(PIECE)
    scores = {int(trie.piece[s]): float(trie.score[s]) for s in np.flatnonzero(trie.piece >= 0)}
    return trie, scores, sentencepiece.SentencePieceProcessor(model_proto=unigram_model(PIECE, scores))


def path_score(trie, scores, ids):
    """Total score; a run of byte pieces stands for its characters."""
    own, total, run = set(trie.byte_ids.tolist()), 0.0, b""
    for i in [*ids, None]:
        if i in own:
            run += bytes([trie.byte_ids.tolist().index(i)])
            continue
        total += len(run.decode("utf-8", "replace")) * trie.unknown
        run = b""
        total += scores[i] if i is not None else 0
    return total


def test_pieces_match_the_library(spark, docs, pieces):
    trie, scores, sp = pieces
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    encoded = sentencepiece_codec.encode_pieces(docs, PIECE)
    for r in encoded.collect():
        want = sp.encode(texts[r.doc_id])
        # equal but for ties that the library's single precision decides otherwise
        assert r.ids == want or path_score(trie, scores, r.ids) == pytest.approx(path_score(trie, scores, want), rel=1e-6)
    decoded = {r.doc_id: r.text for r in sentencepiece_codec.decode_pieces(encoded, PIECE).collect()}
    assert decoded == texts
    digest = sentencepiece_codec.pieces_digest(docs, PIECE).collect()
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in digest)
    assert sentencepiece_codec.pieces_digest(docs.limit(0), PIECE).count() == 0


def test_counts_match_the_library(docs, pieces):
    """The library encodes with the same scores; a count may differ only where its path has the same score."""
    trie, scores, sp = pieces
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PIECE).collect()}
    ids = {r.doc_id: r.ids for r in sentencepiece_codec.encode_pieces(docs, PIECE).collect()}
    for r in docs.collect():
        want = sp.encode(r.text or "")
        assert got[r.doc_id] == len(want) or path_score(trie, scores, ids[r.doc_id]) == pytest.approx(path_score(trie, scores, want), rel=1e-6)


def test_long_texts_without_spaces(spark, pieces):
    """Texts that are one unit each: exact, and nothing of them is remembered."""
    trie, scores, sp = pieces
    texts = [("abcdefghij" * 600)[: 5_000 + i] for i in range(3)] + ["\u6f22\u5b57" * 1_000, "x" * 65, "plain words"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for path, keep, end in ((BYTE, True, 2), (WORD, False, 1)):
        own = pretoken.TextTokenizer(path, "<|endoftext|>", keep)
        for _ in range(2):
            ids, lengths = own.encode(texts)
            assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == reference_ids(path, texts)
        assert sum(map(len, own.memo.index)) < 1000 and own.memo.used < 1000
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PIECE).collect()}
    ids = {r.doc_id: r.ids for r in sentencepiece_codec.encode_pieces(docs, PIECE).collect()}
    assert counts == {i: len(x) for i, x in ids.items()}
    own = token_counts._Counts(PIECE)
    assert own.of(texts).tolist() == [counts[i] for i in range(len(texts))] and all(len(u) <= token_counts.MAX_CHARS for u in own.index)
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode_pieces(spark.createDataFrame(list(ids.items()), "doc_id long, ids array<int>"), PIECE).collect()} == dict(enumerate(texts))
    assert token_files.token_file_digest(docs, BYTE, 2).agg({"n_tokens": "sum"}).first()[0] == sum(len(x) + 1 for x in reference_ids(BYTE, texts))
    pieces_of = packing.pack_documents(docs, WORD, end_id=1).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in pieces_of} == {i: len(x) + 1 for i, x in enumerate(reference_ids(WORD, texts))}


def test_counts_equal_encoded_lengths(docs):
    n = sorted((r.doc_id or 0, len(r.ids)) for r in sentencepiece_codec.encode_pieces(docs, PIECE).collect())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(docs, PIECE).collect()) == n
    assert token_counts.count_tokens(docs.limit(0), PIECE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab▁cé中😀 the", min_size=1, max_size=20), min_size=1, max_size=8, unique=True))
def test_batched_and_single_paths_agree(found):
    trie = unigram.piece_trie(PIECE)
    ids, lengths = sentencepiece_codec.encode_units(trie, found)
    assert int(lengths.sum()) == len(ids)
    assert token_counts.trie_counts(trie, found).tolist() == lengths.tolist()
    assert [token_counts._long_count(trie, u) for u in found] == lengths.tolist()


@pytest.mark.parametrize("spaced", [True, False])
def test_texts_of_several_megabytes(spark, spaced):
    """Whole, in bounded time; the pieces add up and the round trip holds, without the libraries' slow encoding of the same."""
    text = ("many words stand here, " if spaced else "manywordsstandhere") * (200_000 if spaced else 120_000) + "<|endoftext|>"
    frame = spark.createDataFrame([(1, text, 2), (2, "short", 2)], "`a.id` long, `a.text` string, doc_id int")
    pieces = packing.pack_documents(frame, WORD, end_id=1, id_col="a.id", text_col="a.text", with_ids=False).collect()
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(total.values()) and all(r.offset + r.length <= 2048 for r in pieces)
    counted = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, PIECE, id_col="a.id", text_col="a.text").collect()}
    assert counted[1] > 100_000 and counted[2] >= 1
