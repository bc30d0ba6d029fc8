import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentilake.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, items string, k string, spans int"


def brute(docs, items, size=10):
    """(words, hit words, item names) of each text, by comparing every window with every place."""
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    held = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else []:
            held.setdefault(tuple(w[i : i + size]), set()).add("" if name is None else str(name))
    out = []
    for text in docs:
        w, hit, names = words(text), set(), set()
        for m in {len(x) for x in held}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in held:
                    hit |= set(range(i, i + m))
                    names |= held[tuple(w[i : i + m])]
        out.append((len(w), len(hit), sorted(names)))
    return out


word = st.sampled_from(["a", "B", "b", "C3", "é", "x\u0085y", "\U0001f600"])
text = st.lists(st.tuples(word, st.sampled_from([" ", "-", "\n", "_", "\x00", "...", "\x7f"])), max_size=40).map(lambda p: "".join(a + b for a, b in p))


@settings(max_examples=150, deadline=None)
@given(st.lists(text, max_size=4), st.lists(text, min_size=1, max_size=4), st.integers(1, 5), st.integers(1, 60))
def test_automaton_against_brute_force(items, docs, size, piece):
    items = [(str(i % 3), t) for i, t in enumerate(items)]
    machine = dc.Automaton([(n, t.encode()) for n, t in items], size)
    old = dc.SLICE
    dc.SLICE = piece
    try:
        for t, (n, hit, names) in zip(docs, brute(docs, items, size), strict=True):
            got, spans, which = machine.scan(t.encode())
            assert (got, int((spans[:, 1] - spans[:, 0]).sum()), [machine.names[i] for i in which]) == (n, hit, names)
            low = t.translate(LOWER)
            for first, count, start, end in dc.places(t.encode(), spans).tolist():
                assert WORD.findall(low[start:end]) == WORD.findall(low)[first : first + count]
                assert WORD.match(low[start]) and WORD.match(low[end - 1])
    finally:
        dc.SLICE = old


def corpus():
    base = [f"w{i} ü{i % 7} Q{i % 3}-x" for i in range(60)]
    items = [(1, " ".join(base[:20])), (2, " ".join(base[10:30])), (10, "Only Three words"), (10, base[40]), (3, None), (4, ""), (None, " ".join(base[50:])), (5, "?!")]
    docs = [" ".join(base), "x " * 30 + ", ".join(base[3:9]).upper() + "! only three WORDS", "only three", None, "", "?", " ".join(base[:2]), " ".join(base[45:])]
    docs += [" ".join(base[12:25])] * 40  # a group of copies
    return docs + ["z" * 200_000, "long " * 150_000 + " ".join(base[14:22])], items


@pytest.mark.parametrize("limit", [dc.AUTOMATON_WORDS, 40])
def test_one_or_several_automata(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(dc, "PIECE_WORDS", 8)
    docs, items = corpus()
    table = rows([(i, t, "i", "k", 0) for i, t in enumerate(docs)], SCHEMA).repartition(5)
    benchmark = rows([(n, t, "s") for n, t in items], "item_id long, text string, item string")
    found = dc.passages(table, benchmark, automaton_words=limit)
    got = {r.doc_id: r for r in found.collect()}
    want = brute(docs, items)
    assert {i: (r.n_words, sum(s.words for s in r["spans"]), list(r["items"])) for i, r in got.items()} == dict(enumerate(want))
    for i, r in got.items():
        for s in r["spans"]:
            assert WORD.findall(docs[i][s.start : s.end].translate(LOWER)) == WORD.findall(docs[i].translate(LOWER))[s.word : s.word + s.words]
    told = {r.doc_id: r for r in dc.report(found).collect()}
    assert told[0].contaminated and told[0].n_hit == want[0][1] and told[0].n_items == len(want[0][2])
    assert told[3].items_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@pytest.mark.parametrize("limit", [dc.AUTOMATON_WORDS, 0])
def test_edge_tables(rows, limit):
    benchmark = rows([(1, "one two")], "item_id long, text string")
    assert dc.passages(rows([], SCHEMA), benchmark, automaton_words=limit).count() == 0
    data = [(None, "One, two"), (7, "one"), (7, "one two"), (8, None)]
    table = rows([(*x, "i", "k", 0) for x in data], SCHEMA)
    got = sorted(((r.doc_id, r.n_words, list(r["items"])) for r in dc.passages(table, benchmark, automaton_words=limit).collect()), key=str)
    assert got == sorted([(None, 2, ["1"]), (7, 1, []), (7, 2, ["1"]), (8, 0, [])], key=str)
    none = dc.passages(table, rows([], "item_id long, text string"), automaton_words=limit)
    assert [r["spans"] for r in none.collect()] == [[]] * 4


def test_a_window_of_all_items(rows):
    items = rows([(i, "the same ten words stand in every item of all") for i in range(500)], "item_id long, text string")
    docs = rows([(i, "Now the same ten words stand in every item of all.", "", "", 0) for i in range(50)], SCHEMA)
    assert {(r.n_hit, r.n_items) for r in dc.report(dc.passages(docs, items)).collect()} == {(10, 500)}
