"""Line-first cleaning: rules reject lines, then documents that lose too much of their text. DataFrame functions only."""

from functools import reduce

from pyspark.sql import functions as F

# Fixed values.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
BARS = "|»›·"
ENDING = r"[.!?…:;\"”»)。！？][\x20\x09-\x0D]*$"
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "cookie settings", "accept cookies",
    "accept all cookies", "click here", "read more", "sign in", "sign up", "log in", "subscribe now", "subscribe to our",
    "enable javascript", "share this", "back to top", "skip to content",
)
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
MOST_LOST = 50  # per cent of the characters in words


def count_of(text, characters):
    """How many of these characters a text has. Replacing one by one is cheap where there are none."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.length(text) - F.length(rest)


def words_of(text):
    return F.array_remove(F.split(text, SPACE), "")


def parsed(line):
    """A line with its words, the characters in them, and its symbols: each computed once for all rules."""
    words = words_of(line)
    return F.struct(line.alias("line"), words.alias("words"), F.length(F.array_join(words, "")).alias("size"), count_of(line, SYMBOLS).alias("symbols"))


def with_windows(d):
    """d, which has words and n, with a hash of each window of words; none for shorter texts. Words are hashed once, then pairs
    of the hashes, and pairs of these: each in a column of its own, as a repeated expression would be computed again."""
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    step = 1
    while step < WINDOW:
        d = d.withColumn("hashes", F.zip_with("hashes", F.slice("hashes", step + 1, F.greatest("n", F.lit(0))), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    return d.withColumn("hashes", F.slice("hashes", 1, F.greatest(F.col("n") - WINDOW + 1, F.lit(0))))


def repeated_words(ordered):
    """Words inside windows that a text holds twice or more; ordered: the (hash, place) pairs, sorted."""
    last = F.size(ordered) - 1
    same = lambda i, j: F.get(ordered, i)["h"] == F.get(ordered, j)["h"]
    places = F.transform(
        F.filter(F.sequence(F.lit(0), last), lambda i: ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))) | ((i < last) & same(i, F.least(i + 1, last)))),
        lambda i: F.get(ordered, i)["i"],
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
    return F.aggregate(
        F.array_sort(places), start, lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["at"])).alias("n"), p.alias("at")), lambda s: s["n"]
    )


def line_fails(p):
    """The verdict on a parsed line; what costs most comes last."""
    line, words, size = p["line"], p["words"], p["size"]
    n = F.size(words)
    bars = count_of(line, BARS)
    shouts = (size >= 20) & ~line.rlike("[a-z]") & line.rlike("[A-Z]")
    navigation = (bars >= 2) & (n < 6 * (bars + 1))
    fragment = (size < 25) & (n < 5) & ~line.rlike(ENDING)
    monotonous = (n >= 12) & (3 * F.size(F.array_distinct(words)) < n)
    small = F.lower(line)
    boilerplate = (size < 200) & reduce(lambda a, b: a | b, [F.contains(small, F.lit(x)) for x in BOILERPLATE])
    return (10 * p["symbols"] > size) | shouts | navigation | fragment | monotonous | boilerplate


def assess(docs, id_col="doc_id", text_col="text"):
    """One row for each row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept.

    A line fails by its punctuation (symbols, capitals throughout, no ending on a fragment), as navigation, as boilerplate or
    as one word over and over; a line with words that an earlier one equals fails too. lost_chars are the characters in words
    of failed lines. Null text counts as empty and fails for want of words. Ids, null or repeated, are carried as they are.
    Other columns are not read. An empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    d = d.withColumn("texts", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))).drop("t")
    d = d.withColumn("lines", F.transform("texts", parsed)).withColumn("distinct_lines", F.array_distinct("texts"))
    d = d.withColumn("words", F.flatten(F.transform("lines", lambda p: p["words"]))).withColumn("n", F.size("words"))
    d = with_windows(d).drop("words")
    pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("ordered", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), pairs)).drop("hashes")
    # The first of equal lines passes or fails by the rules, the others fail: what passes are the distinct lines that do.
    repeats = F.size("distinct_lines") < F.size("texts")
    judged = d.withColumn("judged", F.when(repeats, F.transform("distinct_lines", parsed)).otherwise(F.col("lines")))
    summed = lambda a, what: F.aggregate(a, F.lit(0).cast("long"), lambda s, p: s + p[what])
    d = judged.withColumns(
        {
            "word_chars": summed("lines", "size"),
            "n_symbols": summed("lines", "symbols"),
            "n_repeat_words": F.when(F.col("ordered").isNull(), 0).otherwise(repeated_words(F.col("ordered"))).cast("long"),
            "passed_chars": summed(F.filter("judged", lambda p: ~line_fails(p)), "size"),
        }
    )
    failed = (F.col("n") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n"))
    lost = F.col("word_chars") - F.col("passed_chars")
    return d.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("texts") - F.size("distinct_lines")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        lost.alias("lost_chars"),
        failed.alias("base_failed"),
        (~failed & (100 * lost <= MOST_LOST * F.col("word_chars"))).alias("kept"),
    )


def clean(docs, id_col="doc_id", text_col="text"):
    """(id_col, text_col) of the documents that are kept, without their failed lines; what remains is joined by line ends."""
    kept = assess(docs.withColumn("__row", F.struct(F.col(id_col), F.col(text_col))), "__row", text_col).filter("kept").select("__row.*")
    lines = F.transform(F.filter(F.array_distinct(F.split(F.col(text_col), "\n")), lambda x: x.rlike(WORD)), parsed)
    good = F.filter(lines, lambda p: ~line_fails(p))
    return kept.withColumn(text_col, F.array_join(F.transform(good, lambda p: p["line"]), "\n"))
