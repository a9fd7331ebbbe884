import random

import pytest
import sentencepiece

from cairnspark.llm import queries, spm, token_count
from cairnspark.llm.spm_model import BYTE, CONTROL, UNIGRAM, UNKNOWN, Model, Piece, parse_model

DATA = open(queries.SPM_MODEL, "rb").read()
ODD = ["", " ", "  two  spaces ", "tab\tand\nline\r\n", "ünï ß ﬁ", "漢字と仮名", "👩‍👩‍👧 emoji", "▁marker▁", "\x00\x01", "<s></s><unk><0x41>", "a" * 5000, "word " * 3000, "﻿​", " lead", "trail ", "é é"]


@pytest.fixture(scope="module")
def exact():
    return sentencepiece.SentencePieceProcessor(model_proto=DATA)


def test_model_file(exact):
    m = parse_model(DATA)
    assert len(m.pieces) == exact.get_piece_size() and m.byte_fallback
    for i in range(0, len(m.pieces), 97):
        assert m.pieces[i].text == exact.id_to_piece(i) and abs(m.pieces[i].score - exact.get_score(i)) < 1e-6


def test_query_round_trip_and_parity(spark, sf, exact):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_sentencepiece(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert list(r.ids) == exact.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.parity
        assert r.round_trip and exact.decode(list(r.ids)) == texts[r.doc_id]


def test_odd_texts(spark, exact):
    rows = spm.encode_decode(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), queries.SPM_MODEL).collect()
    for r in rows:
        assert list(r.ids) == exact.encode(ODD[r.doc_id]) and r.parity
        assert r.round_trip == (exact.decode(list(r.ids)) == ODD[r.doc_id]) == ("▁" not in ODD[r.doc_id])


def test_whole_text_backend_is_the_same(exact):
    """The library's pipeline without the memo of words, with several threads."""
    coder = spm.Coder(DATA, 2, "texts")
    coder.by_word = False
    r = random.Random(2)
    texts = ODD[:6] + [" ".join(r.choice(["the", "Haus", "ción", "x1y", "–", "naïve", "  "]) for _ in range(50)) for _ in range(50)]
    ids, same = coder.encode(texts)
    assert all(same) and [list(memoryview(x).cast("i")) for x in ids] == exact.encode(texts)


def test_whole_texts_are_verified(spark, sf):
    """parity="texts": sentencepiece encodes each whole text of the table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = spm.encode_decode(docs, queries.SPM_MODEL, verify="texts").collect()
    assert len(rows) == docs.count() and all(r.parity and r.round_trip for r in rows)


def test_whole_text_parity_sees_a_difference_of_one_text():
    coder = spm.Coder(DATA, 1, "texts")
    reference = coder.exact.encode(["a b", "c d"])
    coder._reference = lambda texts: [reference[0], reference[1][:-1]]
    assert coder.encode(["a b", "c d"])[1] == [True, False]


def test_texts_without_spaces(exact, monkeypatch):
    """Long words are encoded whole and not kept; the memo stays within its bytes."""
    monkeypatch.setattr(spm, "MEMO_BYTES", 50_000)
    coder, r = spm.Coder(DATA, 2, "texts"), random.Random(3)
    most = 0
    for _ in range(40):
        texts = ["".join(r.choice("漢字仮名交文abc{};=") for _ in range(r.randrange(30, 4000))) for _ in range(5)] + [" ".join(f"w{r.randrange(10**6)}" for _ in range(50))]
        ids, same = coder.encode(texts)
        assert all(same) and [list(memoryview(x).cast("i")) for x in ids] == exact.encode(texts) and coder.decode(ids) == texts
        assert max(map(len, coder.memo)) <= spm.LONG
        most = max(most, coder.held)
    assert most < 2 * 50_000


def test_null_and_empty(spark, awkward, empty):
    rows = spm.encode_decode(awkward, queries.SPM_MODEL).collect()
    assert len(rows) == awkward.count() and all(r.parity for r in rows)
    assert all(r.n_tokens == 0 and r.ids == [] for r in rows if r.doc_id in (3, 4))
    assert all(r.round_trip for r in rows if r.doc_id != 8)
    assert spm.encode_decode(empty, queries.SPM_MODEL).count() == 0
    assert {r.parity for r in spm.encode_decode(awkward, queries.SPM_MODEL, verify=None).collect()} == {None}


def unigram(byte_fallback):
    r = random.Random(5)
    pieces = [Piece("<unk>", 0.0, UNKNOWN), Piece("<s>", 0.0, CONTROL)] + [Piece(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256) if byte_fallback]
    names = {"▁", "a", "b", "c", "▁a", "▁ab", "ab", "abc", "bc", "ca", "cab", "▁ca", "▁abca", "é", "aé"}
    return Model(pieces + [Piece(n, -r.choice([1.0, 2.0, 2.5, 3.0])) for n in sorted(names)], UNIGRAM, byte_fallback, remove_extra_whitespaces=False)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_equal_the_unigram_library(byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    m = unigram(byte_fallback)
    vocab, unk, fallback = token_count.unigram_vocab(m)
    t = Tokenizer(models.Unigram(vocab, unk, fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    r = random.Random(7)
    count = token_count.Counter(vocab, unk, fallback)
    for _ in range(3000):
        x = "".join(r.choice("aabbcc éz漢") for _ in range(r.randrange(25)))
        assert count.text(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_count_query(spark, sf):
    """Every text of the table, by the library with the same vocabulary."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(*token_count.unigram_vocab(parse_model(DATA))))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_token_counts(spark, sf).collect()
    assert {r.doc_id: (r.n_chars, r.n_tokens) for r in rows} == {i: (len(x), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts.items()}


def test_counts_of_null_and_empty(spark, awkward, empty):
    rows = token_count.token_counts(awkward, queries.SPM_MODEL).collect()
    assert len(rows) == awkward.count() and all((r.n_chars, r.n_tokens) == (0, 0) for r in rows if r.doc_id in (3, 4))
    assert token_count.token_counts(empty, queries.SPM_MODEL).count() == 0
