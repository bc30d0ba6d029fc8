import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sentilake.llm import suffix_dedup as sd


def brute(texts, window):
    """Kept bytes and number of runs of each text; windows counted over all texts."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + window] for x in raw for i in range(len(x) - window + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40, alphabet="abé ", longest=300):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    passages = [word(rnd.randint(20, 90)) for _ in range(4)]
    texts = [None, "", "short", "ab" * 200, "ab" * 90 + "x" + "ab" * 70, "a" * 400]
    for _ in range(n):
        parts = [word(rnd.randint(0, longest // 3))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(passages), word(rnd.randint(0, longest // 3))]
        texts.append("".join(parts))
    return texts + texts[-5:] + [texts[10] + "!", "?" + texts[11]]


@pytest.mark.parametrize("hot", [3, 2000])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, rows, seed, hot):
    texts = corpus(seed)
    docs = rows([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in sd.kept_texts(docs, window=40, gram=16, hot=hot, batch_strings=50).collect()
    }
    assert got == dict(enumerate(brute(texts, 40)))


def test_production_window(spark, rows):
    rnd = random.Random(5)
    words = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split()) + str(rnd.randint(0, 99)) for _ in range(n))
    shared = words(90)
    texts = [words(60) + shared + words(30), shared + words(80), words(200), words(20) + shared[:399] + words(9)]
    docs = rows([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.kept_texts(docs).collect())
    assert [x[1:] for x in got] == brute(texts, 400)


def test_segments_of_a_very_long_text(monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdef ") for _ in range(5000))
    data = np.frombuffer((text + text[100:900] + "zz").encode(), dtype=np.uint8)
    offsets = np.array([0, len(data)])
    whole, spans = sd.text_anchors(data, offsets, 40, 16)
    monkeypatch.setattr(sd, "SEGMENT", 512)
    cut, cut_spans = sd.text_anchors(data, offsets, 40, 16)

    def windows(x, settled):
        met = {w for _, s, e in zip(*settled, strict=True) for w in range(s, e - 39)}
        return met | {w for lo, hi in zip(x[3].tolist(), x[4].tolist(), strict=True) for w in range(lo, hi + 1)}

    assert windows(whole, spans) == windows(cut, cut_spans) == set(range(len(data) - 39))


def test_edge_tables(spark, rows):
    schema = "doc_id long, text string, k string, t string, id int, copies int"
    assert sd.kept_texts(rows([], schema)).count() == 0
    long = "x y" * 300
    docs = rows([(1, long, "a", "b", 1, 1), (1, long, None, None, None, 2), (None, None, "k", "t", 3, 3), (None, "s", None, None, None, None)], schema)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_text) for r in sd.kept_texts(docs).collect()), key=str)
    assert got == sorted([(1, 900, 900, ""), (1, 900, 900, ""), (None, 0, 0, ""), (None, 1, 0, "s")], key=str)


def test_common_prefixes_against_sorting():
    rnd = np.random.default_rng(4)
    m, span = 200, 12
    groups = np.sort(rnd.integers(0, 9, m))
    a, b = rnd.integers(0, span + 1, m), rnd.integers(0, span + 1, m)
    left, right = (rnd.integers(0, 2, (span, m)).astype(np.uint8) for _ in range(2))
    for j in range(span):
        left[j, a <= j] = sd.END
        right[j, b <= j] = sd.END
    got = sd.repeated_windows(groups, left, right, a, b, span)
    for i in range(span + 1):
        key = [(g, *left[:i, s], "|", *right[: span - i, s]) for s, g in enumerate(groups)]
        seen = Counter(key)
        want = [seen[x] > 1 and i <= a[s] and span - i <= b[s] for s, x in enumerate(key)]
        assert got[:, i].tolist() == want


def brute_passages(texts, words):
    """Bytes of each text that repeated runs of so many words cover, to the begin of the next word."""
    raw = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)] for x in raw]
    runs = [[tuple(x[a:b] for a, b in r[i : i + words]) for i in range(len(r) - words + 1)] for x, r in zip(raw, at, strict=True)]
    seen = Counter(w for r in runs for w in r)
    out = []
    for x, r, windows in zip(raw, at, runs, strict=True):
        gone = set()
        for i, w in enumerate(windows):
            if seen[w] > 1:
                gone |= set(range(r[i][0], r[i + words][0] if i + words < len(r) else len(x)))
        out.append(len(x) if gone and raw.count(x) > 1 else len(gone))
    return out


def test_passages_beside_the_byte_rule(spark, rows):
    """Short passages of many words are counted; the columns of the byte rule stay as they are."""
    rnd = random.Random(8)
    words = lambda n: " ".join(rnd.choice("ab") + str(rnd.randint(0, 40)) for _ in range(n))
    passage, other = words(51), words(50)
    texts = [words(20) + " " + passage + " " + words(9), passage + "\n" + words(4), other, words(3) + " " + other, words(600), None, "", "one"]
    texts += [texts[4], words(30) + " " + texts[4][50:500]]
    docs = rows([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(sd.kept_texts(docs, words=51, cut_words=False).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts, 400)
    assert [r.n_passage_bytes for r in got] == brute_passages(texts, 51)
    assert got[0].n_passage_bytes > 0 == got[0].n_removed and got[2].n_passage_bytes == 0


def test_words_of_one_polynomial_hash_are_no_repeat(spark, rows):
    """Thue-Morse words and their complements among equal words."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    some = " ".join(f"w{i}" for i in range(30))
    docs = rows([(1, f"{some} {word} {some}x"), (2, f"{some} {other} {some}y"), (3, f"{some} {other} {some}z")], "doc_id long, text string")
    got = {r.doc_id: r.n_passage_bytes for r in sd.kept_texts(docs, words=51, cut_words=False).collect()}
    assert got[1] == 0 and got[2] == got[3] > 1000
