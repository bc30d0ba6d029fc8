"""Main text of web pages from the standard library's parser events, by text-to-tag ratios of lines.

Events are taken as they come, no tree is built. A block (paragraph, heading, list item, cell and so on) is a line; its
ratio is the characters of its text to the tags in it. Text of links and of regions that announce themselves as something
else (navigation, footer, form, notice, advert, comments by tag, role or class) counts as none. Ratios are smoothed by a
Gaussian and the lines above a threshold, a share of their spread, are content; clusters of content lines reach over the
container they lie in: the article element, or else the innermost one that all clusters lie in, with its short lines.
"""

import math
import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import functions as F

from sentilake.llm.common import small_batches

# Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style template noscript head title iframe object svg math canvas audio video select option datalist button textarea input".split())
ASIDE = frozenset("nav footer aside form header menu dialog search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
IMPLIED = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th"))}
STOP = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table",)), "th": frozenset(("table",))}
CLOSES_P = BLOCKS - frozenset(("body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend", "summary", "title"))
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widgets?|footer|foot|header|masthead|topbar|cookies?|consent|gdpr|notices?"
    r"|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|disqus|respond|toolbar|pagination|pager|tags?|skip|hidden)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CONTENT = frozenset(("article", "main"))
LINKED = frozenset("p h1 h2 h3 h4 h5 h6".split())  # text even if all of it is a link
SIGMA = 1.0
SHARE = 0.5


LAYOUT = re.compile(r"(?:has|with|without|no|is|js)[_-]", re.I)


def _announces(name, inside):
    """Whether a class or id says that its element is no main text; an article's own header is its heading."""
    found = NAMES.search(name)
    return bool(found) and not LAYOUT.match(name) and not (inside and found[0].strip("_-").lower() in ("header", "masthead"))


class Lines(HTMLParser):
    """Lines of a page in order: text, link characters, tags, whether they are something else, what contains them, and their block's tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.open, self.text, self.tags, self.linked = [], [], [], 0, 0
        self.hidden = self.aside = self.links = 0
        self.count = 0

    def _flush(self):
        text = " ".join("".join(self.text).split())  # any white space, no-break spaces too
        if text:
            block = next((x[0] for x in reversed(self.open) if x[0] in BLOCKS), "")
            self.lines.append((text, self.linked, self.tags, bool(self.aside), tuple(x[3] for x in self.open if x[3]), block))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if self.hidden and tag in VOID:
            return
        if tag in IMPLIED or tag in CLOSES_P:
            self._imply(tag)
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        named = dict(attrs)
        hidden = tag in HIDDEN or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "")
        inside = any(x[0] in CONTENT for x in self.open)
        aside = tag in ASIDE and not (tag == "header" and inside)
        if not aside and tag not in ("html", "body", *CONTENT):
            aside = (named.get("role") or "") in ROLES or any(_announces(x, inside) for x in f"{named.get('class') or ''} {named.get('id') or ''}".split())
        self.hidden += hidden
        self.aside += aside
        self.links += tag == "a"
        key = 0
        if tag in BLOCKS:
            self.count += 1
            key = self.count if tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th", "tr", "dd", "dt") else 0
        if tag in CONTENT:
            key = -key
        self.open.append((tag, hidden, aside, key))

    def _pop(self):
        tag, hidden, aside, key = self.open.pop()
        if tag in BLOCKS:
            self._flush_closed(tag, hidden, aside, key)
        self.hidden -= hidden
        self.aside -= aside
        self.links -= tag == "a"

    def _flush_closed(self, tag, hidden, aside, key):
        # The line belongs to what is closing: put it back for the moment.
        self.open.append((tag, hidden, aside, key))
        self._flush()
        self.open.pop()

    def _imply(self, tag):
        """Close what a start tag ends by itself."""
        targets = IMPLIED.get(tag, frozenset()) | (frozenset(("p",)) if tag in CLOSES_P or tag == "p" else frozenset())
        stop = STOP.get(tag, frozenset())
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in targets:
                while len(self.open) > i:
                    self._pop()
                return
            if name in stop or name in BLOCKS and name not in ("p", "li"):
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self._pop()
                return
            if self.open[i][0] in BLOCKS and tag not in BLOCKS:
                return  # an inline end tag does not reach out of its block

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))

    def finish(self):
        self.close()
        while self.open:
            self._pop()
        self._flush()
        return self.lines


def smoothed(values, sigma=SIGMA):
    """Convolution with a Gaussian over neighbouring lines, normalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[reach : reach + len(x)]
    return full(values) / full(np.ones(len(values)))


def select(lines):
    """Indices of the lines of the main text."""
    ratio = np.array([0.0 if x[3] else max(0, len(x[0]) - x[1]) / max(1, x[2]) for x in lines])
    if not ratio.any():
        return [i for i, x in enumerate(lines) if not x[3] and any(k < 0 for k in x[4])]  # links alone are text in an article only
    level = smoothed(ratio)
    content = (level >= min(level.mean(), SHARE * level.std())) & (ratio > 0)
    weights = {}
    for i in np.flatnonzero(content).tolist():
        text, linked, _, _, path, _ = lines[i]
        for j in range(len(path) + 1):
            weights[path[:j]] = weights.get(path[:j], 0) + len(text) - linked
    # An article holds the text if there is one; else the innermost container that has all of the content.
    articles = [p for p in weights if p and p[-1] < 0]
    total = weights[()]
    if articles and max(weights[p] for p in articles) * 2 >= total:
        tops = [p for p in articles if not any(p[:i] in weights and p[i - 1] < 0 for i in range(1, len(p)))]
        linked = set(range(len(lines)))
    else:
        tops = [max((p for p in weights if weights[p] == total), key=len)]
        linked = _linked_text(lines, content)
    return [i for i, x in enumerate(lines) if not x[3] and any(x[4][: len(p)] == p for p in tops) and (len(x[0]) > x[1] or i in linked)]


def _linked_text(lines, content):
    """Lines that are text though wholly links: headings, paragraphs, what stands among the content, lists beside a content line."""
    at = np.flatnonzero(content)
    out = {i for i, x in enumerate(lines) if x[5] in LINKED or at[0] < i < at[-1]}
    for step in (1, -1):
        beside = None
        for i in range(len(lines))[::step]:
            text, linked, _, aside, path, _ = lines[i]
            if content[i]:
                beside = path
            elif aside or len(text) > linked:
                beside = None
            elif beside is not None and path[: len(beside)] == beside:
                out.add(i)
    return out


def extract(html):
    """The main text of a page, a block a line; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    return "\n".join(lines[i][0] for i in select(lines))


def _text_rows(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def main_text(pages, id_col="page_id", url_col="url", html_col="html"):
    """(id_col, url_col, text, n_chars) of each row of pages; n_chars are code points.

    Null html counts as empty and has empty text; ids and urls, null or repeated, are carried as they are. Other columns are
    not read. An empty table gives none.
    """
    small_batches(pages.sparkSession)
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [f.dataType.simpleString() for f in d.schema][:2]
    out = d.mapInArrow(_text_rows, f"id {kinds[0]}, url {kinds[1]}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
