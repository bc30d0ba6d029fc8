import random

import numpy as np
import pytest

from sentilake.llm import html_text as ht

SENTENCE = "The quick brown fox jumps over the lazy dog while the rain keeps falling on the old roof of the barn."


def page(body, head="<title>T</title><style>p{}</style><script>var a='<p>no</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News of the day and more</a></li></ul></nav>"
PARAS = f"<p>{SENTENCE}</p>\n<p>Short.</p><p>{SENTENCE} {SENTENCE}</p>"
TEXT = f"{SENTENCE}\nShort.\n{SENTENCE} {SENTENCE}"

CASES = {
    "article": (page(f"{NAV}<div class=ad>{SENTENCE}</div><article><h1>Title</h1>{PARAS}</article><footer>{SENTENCE}</footer>"), f"Title\n{TEXT}"),
    "no article": (page(f"{NAV}<div id=content><h1>Title</h1>{PARAS}</div><div class=sidebar><p>{SENTENCE}</p></div><div id=footer>{SENTENCE}</div>"), f"Title\n{TEXT}"),
    "bare": (page(f"{NAV}{PARAS}<footer>{SENTENCE}</footer>"), TEXT),
    "comments": (page(f"<article>{PARAS}<section id=comments><p>{SENTENCE}</p></section></article><div class='comment-list'><p>{SENTENCE}</p></div>"), TEXT),
    "notice and form": (page(f"<div class='cookie-notice'><p>{SENTENCE}</p></div><main>{PARAS}<form><p>{SENTENCE}</p><input></form></main>"), TEXT),
    "entities and space": (page(f"<article><p>a &amp; b\n\t c&nbsp;d &#233; {SENTENCE}<br>next</p></article>"), f"a & b c d é {SENTENCE} next"),
    "unclosed": (f"<article><h1>T</h1><p><b>{SENTENCE}<br><p>{SENTENCE}<ul><li>one {SENTENCE}<li>two {SENTENCE}</ul><p>cut he", f"T\n{SENTENCE}\n{SENTENCE}\none {SENTENCE}\ntwo {SENTENCE}\ncut he"),
    "layout class": (page(f"<div class='has-sidebar no-header'><article><div class='entry-header'><h1>H</h1></div>{PARAS}</article></div>"), f"H\n{TEXT}"),
    "links in text": (page(f"<article><p>{SENTENCE} <a href=x>a link</a> and more.</p>{PARAS}</article>"), f"{SENTENCE} a link and more.\n{TEXT}"),
    "only links": (page(NAV), ""),
    "empty": ("", ""),
    "null": (None, ""),
    "plain text": (f"{SENTENCE} &lt;p&gt;", f"{SENTENCE} <p>"),
    "comment mark-up": (page(f"<article><!-- <p>no</p> --><p>{SENTENCE}</p></article>"), SENTENCE),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    html, want = CASES[name]
    assert ht.extract(html) == want


def test_smoothing():
    x = np.array([0, 0, 10.0, 0, 0, 0, 0])
    y = ht.smoothed(x)
    assert y.argmax() == 2 and y[1] > y[0] > y[6] >= 0
    assert np.allclose(ht.smoothed(np.ones(9)), 1)


def test_any_input_ends():
    rnd = random.Random(1)
    bits = ["<p>", "</p>", "<div class=ad>", "</div>", "<li>", "<table><tr><td>", "</table>", "<a>", "</a>", "text ", "&amp;", "<", "<!--", "-->", "<script>", "</script>", "<article>", "</b>", "\x00"]
    for _ in range(300):
        ht.extract("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 80))))
    assert len(ht.extract("<div>" * 3000 + SENTENCE)) == len(SENTENCE)


def test_operator(rows):
    data = [(i, "u", html, "c") for i, (html, _) in enumerate(CASES.values())] + [(None, None, None, None), (0, "u", CASES["article"][0], "c")]
    got = ht.main_text(rows(data, "page_id long, url string, html string, text string")).collect()
    want = [(i, "u", t, len(t)) for i, (_, t) in enumerate(CASES.values())] + [(None, None, "", 0), (0, "u", CASES["article"][1], len(CASES["article"][1]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert ht.main_text(rows([], "page_id long, url string, html string")).count() == 0


LONG = " ".join([SENTENCE] * 6)
TWICE = f"{SENTENCE} {SENTENCE}"
WHOLE = {
    "around a list": (f"<div id=content><p>{SENTENCE}</p><ul><li>{LONG}</li><li>{LONG}</li></ul><p>End. {SENTENCE}</p></div>", [SENTENCE, LONG, LONG, f"End. {SENTENCE}"]),
    "sections": (f"<div><section><p>{LONG}</p><p>{LONG}</p></section><section><p>{TWICE}</p></section></div>", [LONG, LONG, TWICE]),
    "table": (f"<div><p>{SENTENCE}</p><table><tr><td>{LONG}</td></tr><tr><td>{LONG}</td></tr></table></div>", [SENTENCE, LONG, LONG]),
    "text after the last block": (f"<article><p>{LONG}</p>{SENTENCE}</article>", [LONG, SENTENCE]),
    "outside stays out": (f"<div class=sidebar><p>{SENTENCE}</p></div><div><p>{LONG}</p><ul><li>{LONG}</li></ul></div>", [LONG, LONG]),
}
LINKS = {
    "article": (f"<article><h1><a href=x>Title</a></h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><ul><li><a>one</a></li><li><a>two</a></li></ul><p><a>Full report</a></p></article>", ["Title", LONG, LONG, LONG, "one", "two", "Full report"]),
    "no article": (f"<div><h1><a href=x>Title</a></h1><p>{LONG}</p><p>{LONG}</p><ul><li><a>one</a></li><li><a>two</a></li></ul><p><a>Full report</a></p></div>", ["Title", LONG, LONG, "one", "two", "Full report"]),
    "unnamed menu": (f"<div><ul><li><a>Home</a></li><li><a>News</a></li></ul></div><div><p>{LONG}</p><p>{LONG}</p></div>", [LONG, LONG]),
    "wrapped": (f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><ul><li>see <a>the{chr(10)}{' ' * 40}report</a></li></ul></article>", [LONG, LONG, LONG, "see the report"]),
    "aside": (f"<article><p>{LONG}</p><nav><p><a>next</a></p></nav><p>{LONG}</p></article>", [LONG, LONG]),
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_text_around_wrappers(name):
    html, want = WHOLE[name]
    assert ht.extract(page(html)).split("\n") == want


@pytest.mark.parametrize("name", LINKS)
def test_link_blocks(name):
    html, want = LINKS[name]
    assert ht.extract(page(html)).split("\n") == want
