"""Bounded samples of labelled documents, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import held_out, id_and_text

#: Most labelled rows that a classifier is fitted on.  They are those whose hashed id is least,
#: so the sample is the same on every run; fitting needs memory for these rows only.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, held_out_mod: int | None = 4, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled ids outside the held-out part.

    Ids with a null label or with labels that differ are left out, repeated label rows count
    once, and of labelled documents with equal texts the least id stays.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if held_out_mod:
        own = own.where(~held_out("doc_id", held_out_mod))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = id_and_text(docs).join(F.broadcast(own), "doc_id")  # bounded by `rows`
    return found.groupBy(F.sha2("text", 256).alias("same")).agg(F.min(F.struct("doc_id", "text", "y")).alias("r")).select("r.*")
