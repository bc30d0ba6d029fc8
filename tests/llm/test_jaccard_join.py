import random
import re

import numpy as np
import pytest

from sentilake.llm import jaccard_join as jj
from sentilake.llm.components import components


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    groups = {}
    for a, (i, _) in enumerate(sets):
        groups.setdefault(find(a), []).append(i)
    return sorted(((i, len(s), min(groups[find(a)])) for a, (i, s) in enumerate(sets)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(3000)] + ["É", "ß", "X"]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    docs = []
    passage = make(60)
    for _ in range(25):
        base = make(rnd.choice([3, 4, 5, 9, 12, 30, 80, 200, 700]))
        docs.append(base)
        for _ in range(rnd.randint(0, 5)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                at = rnd.randrange(len(copy))
                if rnd.random() < 0.5:
                    copy[at] = rnd.choice(vocab)
                else:
                    copy[at : at + rnd.randint(0, 2)] = make(rnd.randint(0, 3))
            docs.append(copy)
    docs += [make(70) + passage for _ in range(20)]
    chain = make(150)
    for _ in range(12):  # neighbours link, ends don't
        chain = chain[5:] + make(5)
        docs.append(chain)
    texts = [rnd.choice([" ", "\n", "  "]).join(x).replace("w1", "W1") for x in docs] + [None, "", " \n", "one", "ONE", "one two", "a a a a a a"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, rows, seed):
    docs = corpus(seed)
    got = jj.link_sets(rows(docs, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(docs)


@pytest.mark.parametrize("limits", [{"FILTER_BLOCKS": 0}, {"FEW_SETS": 0}])
def test_other_ways_give_the_same(spark, rows, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jj, name, value)
    docs = corpus(3)
    got = jj.link_sets(rows(docs, "doc_id long, text string"), prefilter="FEW_SETS" not in limits)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(docs)


def test_words_of_one_polynomial_hash_are_told_apart(rows):
    """Thue-Morse words and their complements."""
    word = lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    other = lambda w: w.translate(str.maketrans("ab", "ba"))
    one, two = (" ".join(["x", "y", w, "z"]) for w in (word(1024), other(word(1024))))
    got = {r.doc_id: r.component_id for r in jj.link_sets(rows([(1, one), (2, two), (3, two), (4, word(2048)), (5, other(word(2048)))], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}


def test_signatures_are_complete():
    rnd = np.random.default_rng(1)
    for _ in range(1500):
        n = int(rnd.integers(7, 400))
        x = rnd.integers(0, 2**63, n).astype(np.uint64)
        drop, add = rnd.integers(0, n // 6 + 1, 2)
        y = np.concatenate([x[drop:], rnd.integers(0, 2**63, add).astype(np.uint64)])
        shared, union = n - drop, n + add
        if 100 * shared >= 85 * union and drop + add:
            assert np.intersect1d(jj.signatures(x), jj.signatures(y)).size
        bits = sum(int(v).bit_count() for v in (jj.parity(x) ^ jj.parity(y)).view(np.uint64))
        assert bits <= drop + add


def test_edge_tables(rows):
    assert jj.link_sets(rows([], "doc_id long, text string")).count() == 0
    docs = rows([(None, "a b c d e", 1, "x"), (3, "a b c d e", 2, "y"), (3, "a b c d e", 2, "y"), (None, None, None, None)], "doc_id long, text string, sid int, component string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.link_sets(docs).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 0, None)], key=str)


def test_components(rows):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(rows(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b for a, b in edges if x in (a, b))}


def family(seed, size, words, own):
    """Texts of one long passage and a share of their own words, and two that link but are neither first nor last in order."""
    rnd = random.Random(seed)
    make = lambda n: ["w%d" % rnd.randrange(10**9) for _ in range(n)]
    passage = make(words)
    docs = [passage + make(own) for _ in range(size)]
    docs += [d[:-words // 50] + make(words // 50) for d in docs[:6]]
    rnd.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_large_sets_of_a_family_are_not_listed(spark, rows, monkeypatch):
    """Sets of some 1700 shingles of which any two share less than they need: sketches of 512 bits told none apart."""
    listed = []
    plain = jj._verified
    monkeypatch.setattr(jj, "_verified", lambda near, *more: listed.append(near.count()) or plain(near, *more))
    docs = family(1, 24, 1400, 300)
    got = jj.link_sets(rows(docs, "doc_id long, text string"), prefilter=False)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(docs)
    assert listed[-1] < 20  # 373 with the sketches as they were


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_of_a_bucket_give_every_pair_once(spark, rows, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    docs = corpus(4) + [(1000 + i, t) for i, t in family(2, 10, 150, 20)]
    got = jj.link_sets(rows(docs, "doc_id long, text string"), threshold=85)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(docs)


def test_sketches_of_any_width():
    rnd = np.random.default_rng(2)
    sets = [rnd.integers(0, 2**63, n).astype(np.uint64) for n in (5, 300, 1100, 2500, 40_000)]
    sketches = [jj.parity(x, jj.sketch_words(len(x))).tobytes() for x in sets]
    assert [len(s) // 8 for s in sketches] == [8, 16, 64, 128, 512]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(5), np.arange(5)))
    for a, b, bits in zip(i.tolist(), j.tolist(), jj.differing(sketches, i, j).tolist(), strict=True):
        words = min(len(sketches[a]), len(sketches[b])) // 8
        assert bits == sum(int(v).bit_count() for v in (jj.parity(sets[a], words) ^ jj.parity(sets[b], words)).view(np.uint64))
