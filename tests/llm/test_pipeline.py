import random
import re
from collections import Counter

import corpus_pipeline as cp
from sentilake.llm import byte_cnn
from tests.llm.test_jaccard_join import brute as brute_links
from tests.llm.test_jaccard_join import shingles
from tests.llm.test_pii import base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for (_, f), check in zip(cp.STAGES, (same_verdicts, same_groups, same_texts, same_masks, same_pieces), strict=True):
        rows = {r.doc_id: r for r in kept.collect()}
        out = f(spark, kept, DATA)
        if f is not cp.pack:
            assert out.columns == COLUMNS and [x.dataType for x in out.schema] == [x.dataType for x in docs.schema]
            out = cp.stage(out, "test")
        check(spark, kept, rows, out)
        kept = out


def same_verdicts(spark, docs, rows, out):
    score = {r.doc_id: r.predicted for r in byte_cnn.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert {r.doc_id: r.text for r in out.collect()} == {i: r.text for i, r in rows.items() if score[i]}
    assert out.count() >= 0.7 * len(rows)


def groups(texts):
    """For each text the first one that it links with, through others too: all pairs, five words a shingle and 0.8."""
    sets = [shingles(t, 5) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    return group


def same_groups(spark, docs, rows, out):
    ids = sorted(rows)
    want = {ids[i] for i, g in enumerate(groups([rows[i].text for i in ids])) if i == g}
    assert {r.doc_id for r in out.collect()} == want


def same_texts(spark, docs, rows, out):
    ids = sorted(rows)
    left = dict(zip(ids, without_repeats([rows[i].text for i in ids]), strict=True))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, t in left.items() if t.strip() or t == rows[i].text}


def same_masks(spark, docs, rows, out):
    for r in out.collect():
        assert not base(re.sub("<[A-Z_]+>", "<>", r.text))
        if not base(rows[r.doc_id].text) and not re.search("[0-9]", rows[r.doc_id].text):
            assert r.text == rows[r.doc_id].text


def same_pieces(spark, docs, rows, out):
    got = out.collect()
    assert {r.doc_id for r in got} == set(rows)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024


def test_run_and_edge_rows(spark, rows):
    assert cp.run(spark, DATA).count() > 0
    docs = rows([(None, None, None, None, None), (1, "x", "en", "s", 1), (1, "x", "en", "s", 1), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in cp.STAGES:
        n = f(spark, docs, DATA).count()
        assert n == (3 if f is cp.drop_near_copies else 4) or f is cp.classify and n <= 4
        assert f(spark, docs.limit(0), DATA).count() == 0


CLASHING = ("digest", "__key", "key", "k", "none", "kept_text", "score_of_quality", "score", "id", "t", "component_id", "Sid")


def test_columns_of_any_name(spark, rows):
    """Further columns stay as they are, and a very long text goes through every stage."""
    rnd = random.Random(12)
    texts = ["The first text says a few things about one matter.", None, " ".join(f"word{rnd.randint(0, 9**6)}" for _ in range(30_000)), "x" * 70_000]
    data = [(i, t, "en", "s", None if t is None else len(t), *(f"{c} {i}" for c in CLASHING)) for i, t in enumerate(texts)]
    names = [*COLUMNS, *CLASHING]
    docs = rows(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    for _, f in cp.STAGES[:-1]:
        out = f(spark, docs, DATA)
        assert out.columns == names
        for r in out.collect():
            assert [r[c] for c in CLASHING] == [f"{c} {r.doc_id}" for c in CLASHING]
    assert {r.doc_id for r in cp.pack(spark, docs, DATA).collect()} == set(range(4))


def test_near_copies_by_five_words(spark, rows):
    """All pairs at 5 words and 0.8; of 50 words with one changed, 4-word shingles share less than 85 %."""
    rnd = random.Random(7)
    texts = []
    for n in (30, 50, 50, 51, 90, 200):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for places in ((n // 2,), (n // 3, 2 * n // 3), (n // 5, n // 2, 4 * n // 5)):
            texts.append(" ".join(f"new{rnd.randint(0, 5000)}" if i in places else w for i, w in enumerate(base)))
    group = groups(texts)
    docs = rows([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.drop_near_copies(spark, docs, DATA).collect()} == {i for i, g in enumerate(group) if i == g}
    assert {i for i, _, c in brute_links(list(enumerate(texts))) if i == c} != set(group)


def without_repeats(texts, words=51, window=400):
    """What is left of each text without repeated windows of so many words or bytes."""
    raw = [t.encode() for t in texts]
    runs = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)] for x in raw]
    tokens = [[x[a:b] for a, b in r] for x, r in zip(raw, runs, strict=True)]
    by_byte = Counter(x[i : i + window] for x in raw for i in range(len(x) - window + 1))
    by_word = Counter(tuple(t[i : i + words]) for t in tokens for i in range(len(t) - words + 1))
    out = []
    for x, r, t in zip(raw, runs, tokens, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - window + 1):
            if by_byte[x[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        for i in range(len(t) - words + 1):
            if by_word[tuple(t[i : i + words])] > 1:
                a, b = r[i][0], r[i + words][0] if i + words < len(r) else len(x)
                gone[a:b] = b"\1" * (b - a)
        out.append(bytes(c for c, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_repeats_of_over_50_words(spark, rows):
    """Brute force over real texts and passages of 50 and 51 short words, also laid out otherwise, twice in a text, and as a whole text."""
    rnd = random.Random(9)
    words = lambda n: [rnd.choice("abcdé") + str(rnd.randint(0, 99)) for _ in range(n)]
    p, q, r = words(51), words(50), words(70)
    line = " ".join
    texts = [line(words(9) + p + words(9)), line(words(5)) + "\n" + "\t".join(p) + "\n\n" + line(words(5)), line(words(3) + q + words(3)), line(q), line(words(2) + r + words(8) + r), " " + line(r)]
    texts += ["x" * 100 + line(p[:50]), "long" * 100 + " 1", "0 " + "long" * 100]
    texts += sorted({x.text for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()})
    docs = rows([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i: t for i, (t, old) in enumerate(zip(without_repeats(texts), texts, strict=True)) if t.strip() or t == old}
    got = {x.doc_id: (x.text, x.n_chars) for x in cp.remove_repeats(spark, docs, DATA).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert want[1].endswith("\n" + texts[1].split("\n")[-1]) and want[2] == texts[2] and 5 not in want


def test_rows_that_share_an_id_or_have_none(spark, rows):
    """Of each group of linked texts one row stays, whatever the ids; texts that do not link all stay."""
    rnd = random.Random(3)
    a, b, c, d = (" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(120)) for _ in range(4))
    data = [(1, a), (1, b), (1, b), (None, c), (None, c), (None, c + " end"), (5, d), (5, d + " end"), (7, d), (None, a), (9, ""), (9, ""), (None, None)]
    docs = rows([(i, t, "en", "s", None if t is None else len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, DATA).collect()]
    by_text = {"a": [x for x in got if x[1] == a], "b": [x for x in got if x[1] == b]}
    assert by_text == {"a": [(1, a)], "b": [(1, b)]}
    assert [x[0] for x in got if (x[1] or "").startswith(c)] == [None] and [x[0] for x in got if (x[1] or "").startswith(d)] == [5]
    assert sorted((x for x in got if not x[1]), key=str) == [(9, ""), (9, ""), (None, None)] and len(got) == 7
