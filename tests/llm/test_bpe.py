import random

import numpy as np
import pytest

from sentilake.llm import bpe


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.vocabulary_path())


def odd_text(rnd, n):
    bits = ["'s", "'S", "'ll", "'re", "'", " ", "  ", "\n", "\t", " ", "　", "don't", "x", "ab", "été", "日本", "🙂", "12", "½", "٣", "!", "...", "<|end", "'v", "'ve", " '", "á", "\x00", "Ⅷ", "’s", "²", "ა"]
    return "".join(rnd.choice(bits) for _ in range(n))


def library(enc, text):
    return enc.library.encode(text, add_special_tokens=False).ids


def test_bulk_encoding_equals_the_library(enc):
    rnd = random.Random(1)
    texts = ["", "a", " ", "'s", "'", "a'", "x'sy", "'s's", "<|endoftext|> a", "  a", "a  "] + [odd_text(rnd, rnd.randint(1, 60)) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    got = enc.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    for text, (ids, opens) in zip(texts, got, strict=True):
        assert ids.tolist() == library(enc, text), text
        assert len(ids) == len(opens)


def test_joins_equal_the_whole(enc):
    rnd = random.Random(2)
    for _ in range(400):
        text = odd_text(rnd, rnd.randint(2, 80))
        cuts = sorted({rnd.randint(0, len(text)) for _ in range(rnd.randint(1, 6))} | {0, len(text)})
        parts = [enc.encode_text(text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert bpe.join_all(enc, parts)[0].tolist() == library(enc, text), text


@pytest.mark.parametrize("alphabet", ["a", "ab", "entheration", "0123456789", "!?-=", "日本語中", "é"])
def test_one_unsplit_piece(enc, alphabet):
    rnd = random.Random(3)
    text = "".join(rnd.choice(alphabet) for _ in range(4000))
    parts = [enc.encode_text(text[i : i + 500].encode()) for i in range(0, len(text), 500)]
    assert bpe.join_all(enc, parts)[0].tolist() == library(enc, text)


def test_operator_round_trip(spark, rows, enc):
    rnd = random.Random(4)
    texts = [None, "", "<|endoftext|>", "a" * 3000, odd_text(rnd, 900)] + [odd_text(rnd, 40) for _ in range(20)]
    docs = rows([(i % 20 if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = bpe.encode(docs, leaf=100)
    got = sorted(((r.doc_id, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in coded.collect()), key=str)
    assert got == sorted(((i % 20 if i else None, library(enc, t or "")) for i, t in enumerate(texts)), key=str)
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(coded).collect()), key=str)
    assert back == sorted(((i % 20 if i else None, t or "") for i, t in enumerate(texts)), key=str)
    assert bpe.encode(rows([], "doc_id long, text string")).count() == 0


def test_decoding_as_the_library_does(enc):
    ids = np.array([50256, 220, 128, 130, 447, 247, 15496], dtype=np.int32)
    assert enc.decode_bytes(ids).decode("utf-8", "replace") == enc.library.decode(ids.tolist(), skip_special_tokens=False)


def test_store_of_pieces_is_bounded(enc):
    small = bpe.Encoder(bpe.vocabulary_path(), cached=10)
    rnd = random.Random(6)
    for _ in range(5):
        text = odd_text(rnd, 300)
        assert small.encode_text(text.encode())[0].tolist() == library(enc, text)


def test_words_of_one_hash_keep_their_ids(rows, enc):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64, whatever its base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    texts = [one, one.translate(str.maketrans("ab", "ba")), one]
    got = {r.doc_id: np.frombuffer(r.ids, dtype=np.int32).tolist() for r in bpe.encode(rows(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()}
    assert got == {i: library(enc, t) for i, t in enumerate(texts)} and got[0] != got[1]
