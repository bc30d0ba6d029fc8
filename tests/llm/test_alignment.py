import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql.functions import udf
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from sentilake.llm import alignment, bpe
from sentilake.llm.perfect_hash import PerfectHash
from sentilake.llm.pieces import PieceStore
from sentilake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, k string, groups int, key long"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Library:
    """Tokens as ids and bytes, by the two libraries on whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.no_truncation(), self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        letters = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(PLAIN))}
        assert set(letters) == set(ByteLevel.alphabet())
        self.bytes_a = lambda i: bytes(letters[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, self.bytes_a(i)) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, self.bytes_b(i)) for i in self.b.encode(text)]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def ranges(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(texts):
    """The six numbers and the groups of each text, token by token."""
    library, rows, counts = Library(), [], Counter()
    for text in texts:
        a, b = (ranges(t) for t in library.tokens(text))
        links, j = [], 0
        for x, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for cut in cuts:
            inside = [",".join(str(x) for x, s, e in t if s >= low and e <= cut) for t in (a, b)] if len(a) < 3000 else None
            groups.append("|".join(inside) if inside else "")
            low = cut
        counts.update(set(links))
        rows.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), groups)
        for n_a, n_b, n_groups, links, groups in rows
    ]


def odd_text(rnd, n):
    bits = ["'s", " ", "  ", "\n", "\t", "the", "don't", "été", "日本", "🙂", "12", "½", "!", "...", "<|endoftext|>", "<0x0A>", "</s>", "<unk>", "\x00", " ", "ა", "Straße", "\r\n", "é"]
    return "".join(rnd.choice(bits) for _ in range(n))


def texts_of_all_kinds():
    rnd = random.Random(4)
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  ", "▁", "a▁b", " ▁ a", "a", "\n", "<|endoftext|>", "<s> a </s>", "x" * 5000, "ab " * 3000, "🙂" * 300]
    return texts + [odd_text(rnd, rnd.randint(1, 60)) for _ in range(400)] + ["one text of many copies"] * 60


def told(rows):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r["groups"]) for r in rows}


@pytest.mark.parametrize("limits", [{}, {"bucket": 100}, {"max_pairs": 10}])
def test_against_brute_force(rows, monkeypatch, limits):
    monkeypatch.setattr(alignment, "BLOCK", 64)
    texts = texts_of_all_kinds()
    docs = rows([(i, t, "k", 0, 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got, want = told(alignment.align(docs, **limits).collect()), brute(texts)
    for i, w in enumerate(want):
        assert got[i][:6] == w[:6] and (w[0] >= 3000 or got[i][6] == w[6]), (i, texts[i])


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_token_alignment"](spark, DATA).collect()
    want = brute([r.text for r in table])
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in got} == {r.doc_id: w[:6] for r, w in zip(table, want, strict=True)}
    assert all((r.groups_sha256 == "") == (r.n_a == 0) for r in got)


@pytest.mark.parametrize("limits", [{}, {"max_pairs": 10}])
def test_texts_are_encoded_once(spark, rows, limits):
    texts = texts_of_all_kinds()
    read = spark.sparkContext.accumulator(0)

    @udf("string")
    def met(text):
        read.add(1)
        return text

    docs = rows([(i, t, "k", 0, 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = alignment.align(docs.withColumn("text", met("text")), **limits).collect()
    assert len(got) == read.value == len(texts)


def test_kept_ids_give_the_alignment_again(monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT", 64)
    one, raw = alignment.aligner(bpe.vocabulary_path(), alignment.piece_path()), [(t or "").encode() for t in texts_of_all_kinds()]
    whole = one.align(raw)
    kept, rest = whole.kept(), [(None, None)] * len(raw)
    for i in np.flatnonzero(whole.good).tolist():
        rest[i] = next(kept)
    assert next(kept, None) is None and sum(a is None for a, _ in rest) == sum(not g for g in whole.good)
    table = pa.table({"a": pa.array([a for a, _ in rest], pa.binary()), "b": pa.array([b for _, b in rest], pa.binary())})
    text, keys, groups, at = [], [], [], []
    for batch in table.slice(3).to_batches(max_chunksize=90):
        for first, run in one.restored(batch.columns):
            rows_of = first + len(at) + np.flatnonzero(run.good)
            of, key = run.links()
            text, keys, groups = [*text, *rows_of[of].tolist()], [*keys, *key.tolist()], [*groups, *run.groups()]
        at += [0] * batch.num_rows
    places = np.flatnonzero(whole.good)
    of, key = whole.links()
    later = places[of] >= 3
    assert text == (places[of][later] - 3).tolist() and keys == key[later].tolist()
    assert groups == [g for p, g in zip(places.tolist(), whole.groups(), strict=True) if p >= 3]


def test_words_of_the_piece_model_are_encoded_apart():
    one, library = alignment.PieceEncoder(alignment.piece_path(), cached=50), Library()
    assert one.by_word
    rnd = random.Random(9)
    texts = [odd_text(rnd, rnd.randint(1, 50)) for _ in range(800)]
    raw = [(" " + t).encode() for t in texts]
    for by_word in (True, False):
        one.by_word = by_word
        ids, at = one.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == library.b.encode(t), t


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 2**62, n))
        made = PerfectHash(keys)
        assert made.n == len(keys) and sorted(made.index(keys).tolist()) == list(range(len(keys)))
        if len(keys) > 63:
            strange = made.index(keys + 1)
            assert ((strange >= 0) & (strange < made.n)).all()
    numbers = alignment.PairNumbers([PerfectHash(np.array([5, 9]))], [np.array([9, 5]) if PerfectHash(np.array([5, 9])).index(np.array([9]))[0] == 0 else np.array([5, 9])])
    assert sorted(numbers.index(np.array([9, 5]))) == [0, 1]
    with pytest.raises(ValueError, match="changed"):
        numbers.index(np.array([7]))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_pieces_of_one_hash_are_told_apart():
    """A word and its complement have one polynomial hash modulo 2**64, whatever its base."""
    store = PieceStore(lambda pieces: [list(p[:3]) for p in pieces], 100)
    one = thue_morse(2048).encode()
    two = one.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(one + two + one + b"abc" + two, dtype=np.uint8)
    starts = np.array([0, 2048, 4096, 6144, 6147])
    for _ in range(2):
        where, sizes = store.lookup(data, starts, np.append(starts[1:], len(data)))
        assert [bytes(store.flat[w : w + n].astype(np.uint8)) for w, n in zip(where, sizes, strict=True)] == [one[:3], two[:3], one[:3], b"abc", two[:3]]


def test_edge_tables(rows):
    assert alignment.align(rows([], SCHEMA)).count() == 0
    for limits in ({}, {"max_pairs": 0}):
        assert told(alignment.align(rows([(1, None, "k", 0, 1), (2, "▁", "k", 0, 1)], SCHEMA), **limits).collect()) == {1: (0,) * 6 + ("",), 2: (0,) * 6 + ("",)}
        got = alignment.align(rows([(None, "a b", "k", 0, 1), (3, "a b", "k", 0, 1), (3, "a", "k", 0, 1)], SCHEMA), **limits).collect()
        assert sorted((str(r.doc_id), r.n_a, r.count_sum) for r in got) == [("3", 1, 3), ("3", 2, 5), ("None", 2, 5)]
