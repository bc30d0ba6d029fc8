"""Text expressions. All of them are native Spark expressions."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentilake import constants as K

# --- fixed values: white space as Python's str.strip() sees it ---
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line ends as Python's str.splitlines() sees them.
LINE_BREAK = r"\R|[\x1C-\x1E]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pattern(python_pattern: str) -> str:
    r"""Java spelling of a Python pattern: Unicode classes, and only \n ends a line."""
    return "(?dU)" + python_pattern


def matches(c, python_pattern: str) -> Column:
    return _col(c).rlike(pattern(python_pattern))


def remove(c, python_pattern: str) -> Column:
    """Delete every match."""
    return F.regexp_replace(_col(c), pattern(python_pattern), "")


def bind(c: Column, use) -> Column:
    """use(c) with `c` computed once, however often `use` refers to it."""
    return F.transform(F.array(c), use)[0]


def strip(c) -> Column:
    """Remove white space at both ends, ideographic spaces and line ends included."""
    return F.btrim(_col(c), F.lit(_SPACES))


def truncate(c, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def lines(c) -> Column:
    return F.split(_col(c), LINE_BREAK, -1)


def or_else(*cs) -> Column:
    """First argument that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cs], F.lit(""))


def url_segment(url) -> Column:
    """Last but one piece of a URL; null when there is none."""
    return F.try_element_at(F.split(_col(url), "/", -1), F.lit(-2))


# --- cleaning ---------------------------------------------------------------------------------


def clean_beauty(c) -> Column:
    return strip(reduce(remove, K.BEAUTY_RULES, _col(c)))


def clean_price(c) -> Column:
    stripped = F.transform(lines(reduce(remove, K.PRICE_RULES, _col(c))), strip)
    return strip(F.array_join(F.filter(stripped, lambda line: line != ""), "\n"))


def _remove_rating_block(c: Column) -> Column:
    """Apply the rating rule to the part it can match in: up to the first visit date after the last detail mark.

    Every number in a review would otherwise start a search to the end of the text.
    """
    tail = F.substring_index(c, K.RESTAURANT_DETAIL, -1)
    to_date = F.regexp_extract(tail, pattern(K.RESTAURANT_TO_VISIT), 0)
    cut = F.length(c) - F.length(tail) + F.length(to_date)
    head, rest = F.substring(c, F.lit(1), cut), F.substring(c, cut + 1, F.length(c))
    return F.when(c.contains(K.RESTAURANT_DETAIL), F.concat(remove(head, K.RESTAURANT_RATING), rest)).otherwise(c)


def clean_restaurant(c) -> Column:
    before = reduce(remove, K.RESTAURANT_HEADER_RULES, _col(c))
    return strip(reduce(remove, K.RESTAURANT_TAIL_RULES, bind(before, _remove_rating_block)))


CLEANERS = {"cosme": clean_beauty, "kakaku": clean_price, "tabelog": clean_restaurant}


def clean_comment(source: str, c) -> Column:
    """The source's cleaning, or a plain strip."""
    return CLEANERS.get(source, strip)(c)


def long_enough(source, c) -> Column:
    """Whether a text passes its source's minimum length. `source` is a name or a column."""
    if isinstance(source, str):
        return F.length(_col(c)) >= K.MIN_COMMENT_CHARS.get(source, 0)
    least = F.create_map(*[F.lit(x) for pair in K.MIN_COMMENT_CHARS.items() for x in pair])
    return F.length(_col(c)) >= F.coalesce(F.try_element_at(least, source), F.lit(0))


def keep_where(df: DataFrame, column: str, value: Column, test) -> DataFrame:
    """Add `column` and keep the rows where test(column) holds, computing the value once.

    Spark pushes a plain filter below the projection and would run the cleaning or Python step twice.
    """
    return df.withColumn(column, F.explode(F.filter(F.array(value), test)))


# --- keys and display -------------------------------------------------------------------------


def comment_key(c) -> Column:
    """32-byte join key of a text. Null texts share the empty key, so they match each other."""
    return F.coalesce(F.unhex(F.sha2(_col(c), 256)), F.lit(b""))


def percent(n, total) -> Column:
    """n of total in percent, 0 for an empty total."""
    n, total = _col(n), _col(total)
    return F.when(total > 0, n.cast("double") / total * 100).otherwise(F.lit(0.0))


def percent_bar(pct) -> Column:
    """One block for every three points."""
    return F.repeat(F.lit("█"), F.floor(_col(pct) / K.BAR_POINTS).cast("int"))


def card_title(*candidates) -> Column:
    return truncate(or_else(*candidates), K.CARD_TITLE_CHARS)


def card_meta(source, title) -> Column:
    source = F.coalesce(_col(source), F.lit(""))
    title = _col(title)
    return F.when(title != "", F.concat_ws(K.CARD_SEPARATOR, source, title)).otherwise(source)


def percent_encode(c) -> Column:
    """Percent-encoding that keeps '/' and '~', as for a URL path; Spark's own is form encoding."""
    encoded = F.url_encode(_col(c))
    for form, path in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(form), F.lit(path))
    return encoded
