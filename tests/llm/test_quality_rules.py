import random
import re

from sentilake.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_base_counts(spark, rows):
    rnd = random.Random(1)
    bits = ["a", "b", "longer", "é🙂", "x|y", "#", " \t", "\n", "\x0b", "\x85", " ", "end."]
    texts = [None, "", "\n\n", "a " * 50, "one\ntwo\none\n one"]
    texts += ["".join(rnd.choice(bits) + rnd.choice([" ", "\n", " "]) for _ in range(rnd.randint(1, 90))) for _ in range(60)]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(8, 400))) for _ in range(20)]
    got = qr.assess(rows([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")).collect()
    assert {r.doc_id: tuple(r)[1:6] + (r.base_failed,) for r in got} == {i: base(t) for i, t in enumerate(texts)}


def test_verdicts(rows):
    prose = "This is a sentence of some length that says something, and it ends as sentences do.\nHere another one follows the first, with other words in it."
    cases = {
        "prose": (prose, True),
        "navigation": ("Home | News | Sport | Weather | Contact\n" * 1 + "Shop | Cart | Account | Help | About | Jobs | Press | Terms of use | Imprint and more", False),
        "shouting": ("BUY NOW AND SAVE MONEY TODAY WITH THIS GREAT OFFER THAT WILL NEVER COME BACK TO YOU EVER AGAIN MY FRIEND OK", False),
        "symbols": (" ".join(w + "%%%" for w in prose.split()), False),
        "one bad line": (prose + "\nAll rights reserved.", True),
        "short": ("Too short.", False),
    }
    got = {r.doc_id: r.kept for r in qr.assess(rows([(k, t) for k, (t, _) in cases.items()], "doc_id string, text string")).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}
    cleaned = {r.doc_id: r.text for r in qr.clean(rows([(k, t) for k, (t, _) in cases.items()], "doc_id string, text string")).collect()}
    assert cleaned == {"prose": prose, "one bad line": prose}


def test_edge_tables(rows):
    assert qr.assess(rows([], "doc_id long, text string")).count() == 0
    got = qr.assess(rows([(None, None), (1, "x"), (1, "x")], "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.kept) for r in got) == [(0, False), (1, False), (1, False)]
