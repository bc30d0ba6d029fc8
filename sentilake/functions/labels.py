"""Sentiment label expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentilake import constants as K
from sentilake.functions.text import strip


def lookup(c, mapping: dict) -> Column:
    """Value for a key of a small fixed mapping, null when absent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), c)


def normalise(c, mapping: dict = K.INGEST_LABELS) -> Column:
    """Class of a raw model label: the model's mapping first, else the label in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.coalesce(lookup(c, mapping), c))


def clean_gold(c) -> Column:
    return F.lower(strip(c))


def label_id(c) -> Column:
    return lookup(c, K.LABEL_TO_ID)


def id_label(c) -> Column:
    return lookup(c, {i: label for label, i in K.LABEL_TO_ID.items()})


def round_score(c) -> Column:
    return F.round(c, K.SCORE_DECIMALS)
