import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sentilake.llm import bpe, packing


def total(used):
    out = Counter()
    for config, times in used:
        assert sum(x * k for x, k in config.items()) <= 1024
        for x, k in config.items():
            out[x] += k * times
    return out


@pytest.mark.parametrize("seed,n", [(1, 30), (2, 1000), (3, 60000)])
def test_configurations_hold_every_piece_in_few_sequences(seed, n):
    rnd = random.Random(seed)
    histogram = Counter(min(1024, max(1, int(rnd.lognormvariate(5.5, 1)))) for _ in range(n))
    used = packing.configurations(histogram)
    assert {x: k for x, k in total(used).items() if k} == dict(histogram)
    bound = math.ceil(sum(x * k for x, k in histogram.items()) / 1024)
    assert sum(t for _, t in used) <= bound * 1.01 + 1


def test_program_beats_filling_where_lengths_pair_badly():
    histogram = {500: 1000, 262: 1000, 174: 1000, 350: 1000}
    sequences = sum(t for _, t in packing.configurations(histogram))
    assert sequences <= 1310  # 1300 is known: 500+262+262, 500+350+174, 350+350+174 and the shortest by fives


def test_only_full_pieces_and_nothing():
    assert packing.configurations({1024: 7}) == [({1024: 1}, 7)]
    assert packing.configurations({}) == []


def test_packing(spark, rows):
    rnd = random.Random(5)
    texts = [None, "", "x", "x"] + [" ".join("w%d" % rnd.randint(0, 99) for _ in range(rnd.randint(0, 900))) for _ in range(60)]
    data = [(i if i != 7 else 8, t, 1, "l") for i, t in enumerate(texts)] + [(None, "null id", 1, "l")]
    docs = rows(data, "doc_id long, text string, offset int, length string")
    got = packing.pack(docs).collect()
    enc = bpe.Encoder(bpe.vocabulary_path())
    want = []
    for i, t, *_ in data:
        ids = enc.library.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= math.ceil(sum(x[3] for x in want) / 1024) + 1


def test_empty(rows):
    assert packing.pack(rows([], "doc_id long, text string")).count() == 0
