"""HTML and byte decoding, the only row-level Python besides an outside model.

Pages go through `mapInPandas` in Arrow batches: one parser per page, rows out as they are found.
"""

import re
import sys
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import accumulate, chain
from typing import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: HTML element classes -------------------------------------------------------
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Text that is none: in a parsed page, and in one laid out with scripts running.
_HIDDEN = frozenset("script style template".split())
_UNSEEN = _HIDDEN | {"noscript"}
# Start tags that end an open element by themselves, and the elements that search stops at.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_BLOCK = frozenset(
    "address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section table tr ul".split()
)

ELEMENT_FIELDS = (
    T.StructType()
    .add("part", "string")
    .add("pos", "integer")
    .add("tag", "string")
    .add("cls", "string")
    .add("href", "string")
    .add("target", "string")
    .add("text", "string")
)


# A result frame goes out when it holds this many rows or characters.
FRAME_ROWS = 10_000
FRAME_CHARS = 8_000_000


@dataclass(frozen=True)
class Select:
    """Which elements of a page to take. An element that fits several selects of one part is taken once.

    tags       element names; empty for any
    classes    substrings of the class attribute, one of which must occur; empty for any
    token      compare whole class names instead of substrings
    inside     substrings of an enclosing element's class attribute
    has_href   only elements with a link target
    rendered   text as a browser lays it out (line ends at blocks); otherwise the text pieces, each stripped,
               with nothing between them
    least      characters that text has at least which is not laid out; shorter elements keep their position and give no row
    """

    part: str
    tags: tuple = ()
    classes: tuple = ()
    token: bool = False
    inside: tuple = ()
    has_href: bool = False
    rendered: bool = False
    least: int = 0

    def _class_hit(self, wanted, cls):
        names = cls.split() if self.token else [cls]
        return any(w in names if self.token else w in cls for w in wanted)

    def takes(self, tag, attrs, stack):
        if self.tags and tag not in self.tags:
            return False
        if self.has_href and attrs.get("href") is None:
            return False
        if self.classes and not self._class_hit(self.classes, attrs.get("class") or ""):
            return False
        return not self.inside or any(cls and self._class_hit(self.inside, cls) for _, cls, _ in stack)


class _Page(HTMLParser):
    """Finds the selected elements while reading a page once.

    The text pieces of all of them stand in one list; an element keeps where its own begin and end, so nested and
    unclosed elements share them.
    """

    def __init__(self, selects, base):
        super().__init__(convert_charrefs=True)
        self.selects, self.base = selects, base
        self.laid_out = all(select.rendered for select in selects)
        self.unseen = _UNSEEN if self.laid_out else _HIDDEN
        self.stack = []  # (tag, class, found elements it opened)
        self.depth = Counter()  # open elements by name
        self.pieces = []  # (kind of break or None, text)
        self.found = []  # [select, tag, class, href, first piece, piece after the last]
        self.open = 0
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if self.laid_out:
            self._imply(tag)
        self._break(tag, "br" if tag == "br" else None)
        opened, parts = [], set()
        for select in self.selects:
            if select.part not in parts and select.takes(tag, attrs, self.stack):
                parts.add(select.part)
                opened.append([select, tag, attrs.get("class"), attrs.get("href"), len(self.pieces), None])
        self.found.extend(opened)
        self.open += len(opened)
        if tag in _VOID:
            self._close(opened)
            return
        self.stack.append((tag, attrs.get("class", ""), opened))
        self.depth[tag] += 1
        self.hidden += tag in self.unseen

    def _imply(self, tag):
        """Laid out as a browser does it, an item ends where the next one begins, and a paragraph where a block does."""
        ends, stops = _ENDS.get(tag, (set(), set()))
        if tag in _BLOCK and tag != "html":
            ends = ends | {"p"}
        if not any(self.depth[name] for name in ends):
            return
        cut = None
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name in ends:
                cut = at
                if tag != "tr" or name == "tr":
                    break
            elif name in stops or name in _BLOCK and name not in ("p", "li", "dt", "dd", "tr"):
                break
        while cut is not None and len(self.stack) > cut:
            self._pop()

    def _pop(self):
        name, _, opened = self.stack.pop()
        self.depth[name] -= 1
        self._close(opened)
        self.hidden -= name in self.unseen
        return name

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.depth[tag]:
            return
        while self._pop() != tag:
            pass
        self._break(tag, "cell" if tag in ("td", "th") else None)

    def handle_data(self, data):
        if self.open and not self.hidden:
            self.pieces.append((None, data))

    def _break(self, tag, kind):
        kind = kind or ("paragraph" if tag == "p" else "block" if tag in _BLOCK else None)
        if kind and self.open:
            self.pieces.append((kind, ""))

    def _close(self, opened):
        for element in opened:
            element[5] = len(self.pieces)
        self.open -= len(opened)

    def rows(self):
        """The found elements. Text that is not laid out stands in one buffer, and each element's is an interval of it, cut
        only as its row leaves: elements that were never closed hold all that follows."""
        plain = ["" if kind else text.strip() for kind, text in self.pieces]
        at = list(accumulate(map(len, plain), initial=0))
        buffer = "".join(plain)
        for pos, (select, tag, cls, href, start, end) in enumerate(self.found):
            end = len(self.pieces) if end is None else end
            if select.least and not select.rendered and at[end] - at[start] < select.least:
                continue
            text = _rendered(self.pieces[start:end]) if select.rendered else buffer[at[start] : at[end]]
            yield select.part, pos, tag, cls, href, href and _absolute(self.base, href), text


def _absolute(base, href):
    try:
        return urljoin(base or "", href)
    except ValueError:
        return href


def _rendered(pieces):
    """Text as laid out: spaces collapse, blocks start a line, paragraphs leave one line free, cells are tabbed."""
    out = []
    for kind, text in pieces:
        if kind is None:
            text = re.sub(r"[ \t\n\r\f]+", " ", text)
            if not out or out[-1][-1] in " \n\t":
                text = text.lstrip(" ")
            if text:
                out.append(text)
            continue
        while out and out[-1][-1] in " \t":
            kept = out.pop().rstrip(" \t")
            if kept:
                out.append(kept)
        if kind in ("br", "cell"):
            out.append("\n" if kind == "br" else "\t")
        elif out:
            wanted = 2 if kind == "paragraph" else 1
            out.extend("\n" for _ in range(wanted - sum(piece == "\n" for piece in out[-wanted:])))
    return "".join(out).strip()


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)


def _fragment_text(fragment):
    if fragment is None:
        return None
    reader = _Text()
    reader.feed(fragment)
    reader.close()
    return " ".join(reader.pieces)


def page_elements(pages: DataFrame, selects, every_page=False, page_id="page_id", url="url", html="html") -> DataFrame:
    """Selected elements of every page: page id, page URL, part, position, tag, class, link, its target, text.

    With `every_page`, a page without any gives one row of nulls.
    """
    selects = tuple(selects)
    schema = T.StructType(
        [pages.schema[page_id], T.StructField("page_url", T.StringType())] + ELEMENT_FIELDS.fields
    )
    names = schema.names

    def frame(rows):
        return pd.DataFrame(rows, columns=names).astype({"pos": "Int32"})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for key, base, markup in batch.itertuples(index=False, name=None):
                page = _Page(selects, base)
                page.feed(markup or "")
                page.close()
                missing = [(None,) * len(ELEMENT_FIELDS)] if every_page and not page.found else []
                for row in chain(page.rows(), missing):
                    rows.append((key, base, *row))
                    size += len(row[-1] or "")
                    if len(rows) >= FRAME_ROWS or size >= FRAME_CHARS:
                        yield frame(rows)
                        rows, size = [], 0
            if rows:
                yield frame(rows)

    return pages.select(page_id, url, html).mapInPandas(parse, schema)


@F.pandas_udf(T.StringType())
def _fragment_text_udf(fragments: pd.Series) -> pd.Series:
    return fragments.map(_fragment_text, na_action="ignore")


def fragment_text(c) -> Column:
    """Text of an HTML fragment, pieces joined by a space. Plain text never reaches Python's parser."""
    c = F.col(c) if isinstance(c, str) else c
    marked = c.contains("<") | c.contains("&")
    return F.coalesce(_fragment_text_udf(F.when(marked, c)), c)


@F.pandas_udf(T.StringType())
def _shift_jis_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: bytes(b).decode("shift_jis", "replace"), na_action="ignore")


def decode_shift_jis(c) -> Column:
    """Text of Shift_JIS bytes; undecodable bytes become U+FFFD."""
    return _shift_jis_udf(c)


# Executors get these helpers with the task, so a cluster needs no copy of the package for them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
