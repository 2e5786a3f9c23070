"""Encoding, decoding and token counts against the libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from oddsloom.llm import bpe, counting

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "e", "s", "t", "'", " ", "  ", "\n", "\t", "1", "23", "the", "'s", "'ll", "'Ve", "é", "漢", "字", "🎉", "▁", " ", "　", "ﬁ", "İ", "²", "!", "<|endoftext|>", "<|endo", "\r\n", "x" * 40, "́", "<s>", "</s>", "<unk>", "<0x41>", "​", "ab" * 200]
AWKWARD = ["", " ", "   ", "\n\n", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|endoftext|> b", "'", "''s", " 's", "▁▁", " ▁ ", "▁a", "a" * 3000, " " * 3000, "🎉" * 300, " ", "aé" * 300, "don't we'RE I'm"]


def texts(n, seed):
    rng = random.Random(seed)
    return AWKWARD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(BPE)
    made.no_truncation()
    made.no_padding()
    return made


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_as_the_library(spark, library):
    rows = texts(600, 3)
    found = {r.doc_id: r for r in bpe.round_trip(frame(spark, rows), BPE).collect()}
    for i, text in enumerate(rows):
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == expected(library, text), repr(text)
        assert found[i].exact


def test_bpe_of_documents(spark, sf, library, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = sorted((r.doc_id, *expected(library, r.text)) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, BPE).collect()) == want
    want = sorted(((r.doc_id, *expected(library, r.text)) for r in odd_docs.collect()), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd_docs, BPE).collect()), key=str) == want
    assert bpe.round_trip(no_docs, BPE).count() == 0


def test_bpe_texts_come_back(spark, odd_docs):
    back = bpe.decode_ids(bpe.encode_texts(odd_docs, BPE), BPE).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=str)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.mark.parametrize("chunk", [5, 64, counting.CHUNK])
def test_counts_as_the_library(spark, pieces, chunk):
    rows = texts(400, 4)
    found = {r.doc_id: r.n_tokens for r in counting.token_counts(frame(spark, rows), PIECES, chunk=chunk).collect()}
    for i, text in enumerate(rows):
        assert found[i] == len(pieces.encode(text)), (repr(text), chunk)


def test_counts_of_documents(spark, sf, pieces, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), odd_docs):
        want = []
        for r in docs.collect():
            n = len(pieces.encode(r.text or ""))
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
        assert sorted(map(tuple, counting.token_counts(docs, PIECES).collect()), key=str) == sorted(want, key=str)
    assert counting.token_counts(no_docs, PIECES).count() == 0


@pytest.mark.parametrize(("chunk", "context"), [(7, 1), (40, 3), (300, 64)])
def test_counts_of_texts_without_blanks(spark, pieces, chunk, context):
    """Chunks whose state cannot be told from what precedes them are mapped again until all compose."""
    rng = random.Random(7)
    rows = ["".join(rng.choice("aeilnrst") for _ in range(900)), "漢字かな" * 200, "ab" * 500, "A" * 700, "QUJDREVG" * 90 + "=", "x▁▁y▁" * 80, "the" * 300 + " " * 50 + "of" * 100, "é🎉" * 150]
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in counting.token_counts(frame(spark, rows), PIECES, chunk=chunk, context=context).collect()}
    assert found == {i: (len(t.encode()), len(pieces.encode(t))) for i, t in enumerate(rows)}
