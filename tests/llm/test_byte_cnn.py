import random
import zlib

import numpy as np
import pytest

from sentilake.llm import byte_cnn as bc


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))


def slow_answers(model, raw):
    """Every window of a text, at every fourth byte, with zeros behind the end."""
    padded = np.concatenate([np.frombuffer(raw, dtype=np.uint8), np.zeros(bc.WIDTH + 4 * bc.CHUNK, dtype=np.uint8)])
    return lambda i: np.einsum("wd,wdk->k", model["embed"][padded[i : i + bc.WIDTH]], model["filters"])


@pytest.mark.parametrize("part", [1 << 19, 1 << 10])
def test_chunks_cover_the_text_and_keep_the_largest_answers(monkeypatch, part):
    monkeypatch.setattr(bc, "PART", part)
    rnd = random.Random(1)
    texts = ["", "a", "é" * 31, "x" * 511] + ["".join(rnd.choice("abc é\n") for _ in range(n)) for n in (512, 513, 900, 4000)]
    model = bc.initial()
    text, size, best, place, laid = bc.pooled(model, *packed(texts))
    for t, raw in enumerate(x.encode() for x in texts):
        answer = slow_answers(model, raw)
        mine = np.flatnonzero(text == t)
        step = (bc.PER_CHUNK - 1) * bc.BLOCK
        blocks = -(-(len(raw) + bc.WIDTH - bc.STRIDE) // bc.BLOCK)
        assert len(mine) == max(1, -(-(blocks - 1) // (bc.PER_CHUNK - 1)))
        for n, c in enumerate(mine):
            begin, end = n * step, min(n * step + bc.CHUNK, blocks * bc.BLOCK)
            want = np.max([answer(i) for i in range(begin, max(begin + 1, min(end, len(raw))), bc.STRIDE)], axis=0)
            assert np.allclose(best[c], want, atol=1e-4)
            assert size[c] == max(0, min(len(raw), end) - begin)


def test_slopes_against_differences():
    rnd = random.Random(2)
    data, offsets = packed(["".join(rnd.choice("abcdef ") for _ in range(n)) for n in (700, 80, 1300)])
    labels, weights = np.array([0.0, 1.0, 1.0]), np.array([1.0, 0.5, 2.0])
    model = {k: v.astype(np.float64) for k, v in bc.initial(5).items()}
    loss = lambda m: -(weights / weights.sum() * np.log(np.where(labels == 1, (p := bc.probabilities(m, data, offsets)), 1 - p))).sum()
    slopes = bc._slopes(model, data, offsets, labels, weights)
    for name, at in (("out", 3), ("hidden", (2, 5)), ("filters", (4, 2, 7)), ("embed", (ord("c"), 1)), ("out_bias", 0), ("bias", 2)):
        moved = {k: v.copy() for k, v in model.items()}
        moved[name][at] += 1e-4
        back = {k: v.copy() for k, v in model.items()}
        back[name][at] -= 1e-4
        assert slopes[name][at] == pytest.approx((loss(moved) - loss(back)) / 2e-4, rel=0.05, abs=1e-5)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = bc.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    good, bad = ([r.score for r in held if r.quality == y] for y in (1, 0))
    assert sum(r.predicted == r.quality for r in held) >= 0.96 * len(held)
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_edge_tables(spark, rows):
    labels = rows([(i, i % 2, 0) for i in range(40)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, text int")
    words = "the cat sat on a mat and then it went home. " * 8
    docs = rows([(i, words if i % 2 else "%%% $$$ ### " * 30, "x") for i in range(40)] + [(None, None, None), (3, "", "x"), (3, "", "x")], "doc_id long, text string, score string")
    got = bc.classify(docs, labels).collect()
    assert len(got) == 43 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id != 3)
    assert bc.classify(rows([], "doc_id long, text string"), labels).count() == 0
    assert bc.classify(docs, rows([], "doc_id long, quality int")).count() == 43
    model = bc.initial()
    assert bc.score(docs, model, name="p").columns == ["doc_id", "text", "score", "p"]
