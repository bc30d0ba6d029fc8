"""Posts from forum threads in DAT form: one post a line, fields name, mail, date, message, title."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentilake import constants as K
from sentilake.functions import text as X
from sentilake.functions.markup import decode_shift_jis, fragment_text


def dat_url(thread_url) -> Column:
    """Address of a thread's DAT file; null for anything but a thread URL."""
    url = F.col(thread_url) if isinstance(thread_url, str) else thread_url
    form = X.pattern(K.THREAD_URL)
    base, board, thread = (F.regexp_extract(url, form, i) for i in (1, 2, 3))
    return F.when(url.rlike(form), F.concat(base, F.lit("/"), board, F.lit("/dat/"), thread, F.lit(".dat")))


def decode_threads(threads: DataFrame, content: str = "content") -> DataFrame:
    """Replace the Shift_JIS bytes of a thread with its text."""
    return threads.withColumn(content, decode_shift_jis(F.col(content)))


def parse_posts(threads: DataFrame, content: str = "content") -> DataFrame:
    """Posts of every thread. `post_number` is the line's number in the file; unreadable lines count."""
    lines = threads.select(
        *[c for c in threads.columns if c != content], F.posexplode(X.lines(content)).alias("_pos", "_line")
    )
    fields = lines.withColumn("_fields", F.split("_line", K.DAT_SEPARATOR, -1))
    posts = fields.where(F.size("_fields") >= K.DAT_MIN_FIELDS)
    kept = X.keep_where(
        posts,
        "comment",
        X.strip(fragment_text(F.col("_fields")[3])),
        lambda c: X.long_enough(K.FORUM_SOURCE, c) & ~X.matches(c, K.ANCHOR_ONLY),
    )
    return kept.withColumn("post_number", F.col("_pos") + 1).drop("_pos", "_line", "_fields")
