"""From fetched pages, threads and tweets to landed records, a source at a time or all together."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake import constants as K
from sentilake import schemas as S
from sentilake.functions.text import strip
from sentilake.operators import extract, forum, tweets
from sentilake.sources.tables import write_landing


def records(source: str, fetched: DataFrame, others: DataFrame | None = None, **how) -> DataFrame:
    """A source's records in its landing columns.

    fetched  comment pages (page_id, url, html); threads (thread_url, thread_title, content as text); or tweets
    others   the items a search found (url, name), whose address and name the comments then carry; for tweets the users
    """
    if source == K.FORUM_SOURCE:
        found = forum.parse_posts(fetched)
    elif source == "twitter":
        if others is None:
            raise ValueError("tweets need the users table")
        found = tweets.with_author(fetched, others).withColumn("comment", strip("comment"))
    else:
        found = extract.named_reviews(fetched, source, others, **how)
    return found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in S.LANDING[source].fields))


def pages_to_landing(fetched: dict, landing: str) -> None:
    """Land every source that was fetched: {source: (fetched, others or None)}."""
    for source, (rows, others) in fetched.items():
        write_landing(records(source, rows, others), landing, source)
