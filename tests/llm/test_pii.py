import hashlib
import random
import re

import pytest

from sentilake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d),
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if ok:
                spans.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


def corpus(seed):
    rnd = random.Random(seed)
    bits = ["a.b+c@d-e.fr", "@", "x@y", "1.2.3.4", "256.1.1.1", "00012.3.4.5", ".", "4539578763621486", "4539 5787 6362 1486", "1234567890123456", "+1 (443) 555-5793", "+12", "-", " ", "é🙂", "\n", "79927398713", "_%@q.de.", "5.6", "+", "0", "word"]
    return [None, "", "a@b.c%x@d.e", "1.2.3.4.5.6.7.8.9", "9" * 300, "a." * 5000 + "@" + "b." * 3000 + "c", "x" * 20000, "1 " * 3000, "4539578763621486 " * 200] + [
        "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(150)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_base_spans(spark, rows, seed):
    texts = corpus(seed)
    got = {r.doc_id: r for r in pii.find(rows([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")).collect()}
    for i, text in enumerate(texts):
        want = base(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        assert set(want) <= set(got[i].spans.split(",")) | {""}


def planted():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(30))
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    docs = [(i, f'{prose()} token = "{h}" {prose()}') for i, h in enumerate(hexes)]
    docs += [(100 + i, f"{prose()} phone: (443) 555-{1000 + i} {prose()}") for i in range(20)]
    docs += [(200 + i, f"{prose()} item abcdefghij_klmnopqrst{i} {prose()}") for i in range(20)]
    docs += [(300 + i, prose()) for i in range(20)]
    return docs


def test_method_adds_spans(spark, rows):
    docs = planted()
    got = {r.doc_id: r.spans for r in pii.find(rows(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        if i < 100:
            at = text.index('"') + 1
            assert got[i] == f"secret:{at}:{at + 40}"
        elif i < 200:
            at = text.index("(")
            assert got[i] == f"local_phone:{at}:{at + 14}"
        else:
            assert got[i] == ""


def test_reliabilities_follow_the_votes():
    patterns = {("secret", ("y", "y", "y")): 80, ("secret", ("y", "-", "n")): 5, ("secret", ("n", "-", "n")): 100, ("secret", ("n", "-", "-")): 20}
    rates, posterior = pii.reliabilities(patterns)
    assert posterior["secret", ("y", "y", "y")] > 0.99 and posterior["secret", ("n", "-", "n")] < 0.01
    prior, rate = rates["secret"]
    assert 0.3 < prior < 0.5 and rate["form"]["y"][0] > 0.8 > 0.3 > rate["form"]["y"][1]


def test_mask_and_edge_tables(rows):
    assert pii.find(rows([], "doc_id long, text string")).count() == 0
    docs = rows([(1, "write to a@b.com or +1 (443) 555-5793 now", "x"), (1, "write to a@b.com or +1 (443) 555-5793 now", "x"), (None, None, None), (2, "é a@b.co", "y")], "doc_id long, text string, t string")
    got = sorted(((r.doc_id, r.text, r.t) for r in pii.mask(docs).collect()), key=str)
    assert got == sorted([(1, "write to <EMAIL> or <PHONE> now", "x")] * 2 + [(None, None, None), (2, "é <EMAIL>", "y")], key=str)


def test_mask_reaches_over_overlaps(rows):
    texts = ["pay 4111 1111 1111 1111@shop.com now", "a@b.example.com and 10.1.2.3", None, "plain"]
    got = {r.doc_id: r.text for r in pii.mask(rows(list(enumerate(texts)), "doc_id long, text string")).collect()}
    spans = {r.doc_id: r.spans for r in pii.find(rows(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(spans[0].split(",")) > 1
    assert got == {0: "pay <CARD> now", 1: "<EMAIL> and <IP>", 2: None, 3: "plain"}
