"""The corpus pipeline: stages over the documents table, each written as Parquet and read again as the next one's documents.

A stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents, n_chars counted anew where the text changes. ``run`` is registered as query
``pipeline``. SQL can express neither the classifier nor the packing, so there is none.
"""

from pyspark.sql import functions as F

from sentilake.llm import byte_cnn, jaccard_join, packing, pii, suffix_dedup
from sentilake.llm.common import discard, stage, table

ORACLE_SQL = None


def spare(docs, name):
    """A column name that docs does not have, whatever the case."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def classify(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go. Null texts are scored as empty ones; rows that repeat an id, or have
    none, are scored each; an empty table stays empty."""
    model = byte_cnn.train(docs, table(spark, sf_dir, "labels"))
    score = spare(docs, "score")
    return byte_cnn.score(docs, model, name=score).filter(F.col(score) >= 0.5).drop(score)


def row_keys(docs, name):
    """docs with a key: the id, those without one last, and 128 bits of the whole row. Rows of one key are equal."""
    rest = F.to_json(F.struct(F.col("text").isNull().alias(spare(docs, "none")), *(c for c in docs.columns if c != "text")))
    digest = suffix_dedup.text_key(F.concat(F.hex(suffix_dedup.text_key(F.col("text"))), rest))
    return docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest")))


def drop_near_copies(spark, docs, sf_dir):
    """Of each group of linked rows, five words a shingle and a similarity of 0.8 or more, the one with the least key stays.

    Rows link by their texts only: those that share an id, or have none, are different documents unless they link. Blank
    texts link with nothing and stay.
    """
    worded = F.coalesce("text", F.lit("")).rlike(r"[^ \t-\r]")
    key, digest = spare(docs, "key"), spare(docs, "digest")
    keyed = row_keys(docs.filter(worded), key)
    linked = jaccard_join.link_sets(keyed.select(key, "text"), id_col=key, shingle=5, threshold=80)
    kept = linked.filter(F.col(key) == F.col("component_id")).select(F.col(f"{key}.digest").alias(digest)).distinct()
    keyed = keyed.select(F.col(f"{key}.digest").alias(digest), *docs.columns)
    named = keyed.join(kept, digest, "left_semi").dropDuplicates([digest])
    return named.select(*docs.columns).unionByName(docs.filter(~worded))


def remove_repeats(spark, docs, sf_dir):
    """Passages of over 50 words, or of 400 bytes, that repeat are cut out of every text; a text of which nothing is left goes,
    one that was empty or null stays. Rows of equal text are copies of each other, whatever their ids."""
    _, kept = suffix_dedup.remove_repeats(docs, words=51)
    kept = kept.filter((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^ \t-\r]"))
    key, none, left = spare(docs, "k"), spare(docs, "none"), spare(docs, "kept_text")
    kept = kept.select(F.col("k").alias(key), F.col("kept_text").alias(left))
    # The old texts stay behind: only their digests travel.
    rest = docs.select(suffix_dedup.text_key(F.col("text")).alias(key), F.col("text").isNull().alias(none), *(c for c in docs.columns if c != "text"))
    text = F.when(~F.col(none), F.col(left))
    size = F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length(left), F.lit(0)).cast("long"))
    new = {"text": text.alias("text"), "n_chars": size.alias("n_chars")}
    return rest.join(kept, key).select(*(new.get(c, F.col(c)) for c in docs.columns))


def mask_personal_data(spark, docs, sf_dir):
    """Spans of personal data become their kind. Null texts stay null; every row stays, whatever its id."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def pack(spark, docs, sf_dir):
    """Token pieces in sequences. A null text is packed as an empty one; rows that repeat an id, or have none, each have pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", remove_repeats),
    ("PII", mask_personal_data),
    ("best-fit packing", pack),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES[:-1]):
        before, docs = docs, stage(f(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if i:
            discard(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
