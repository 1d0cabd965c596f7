"""How often every distinct term occurs, and in how many records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tag_terms(tags: Column, separator: str = ";") -> Column:
    """The terms ``key=piece`` of a map of tags, with repeats.

    Values are split at ``separator``; keys and pieces lose outer white space and upper case; empty
    pieces are dropped. A null map, or a null value in it, has no terms.
    """
    clean = lambda text: F.lower(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")))

    def of_entry(entry: Column) -> Column:
        key = clean(entry["key"])
        pieces = F.transform(F.split(F.coalesce(entry["value"], F.lit("")), separator), clean)
        return F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.concat(key, F.lit("="), p))

    return F.coalesce(F.flatten(F.transform(F.map_entries(tags), of_entry)), F.array().cast("array<string>"))


def latest_records(df: DataFrame, id_col: str, loaded_at: str, content: str) -> DataFrame:
    """One row ``(id, content)`` per id: the one loaded last. Null ids are ignored.

    The rank limit is applied within each task before the shuffle, so an id with very many rows sends one
    row per task.
    """
    newest = Window.partitionBy("id").orderBy(F.col("_at").desc_nulls_last())
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{loaded_at}`").alias("_at"), F.col(f"`{content}`").alias("content"))
    return (
        rows.where(F.col("id").isNotNull())
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .select("id", "content")
    )


def term_frequencies(records: DataFrame, terms: Column) -> DataFrame:
    """``(term, occurrences, records)`` for every distinct term.

    ``records`` has one row per ``id``; ``terms`` is an array of strings over its columns. Counts per
    record come first (in the partitioning by id that ``latest_records`` leaves, without a shuffle), then
    both sums are combined by hash within each task before the only shuffle by term. A term in a third of
    all records therefore sends one row per task. Records without terms count in no term.
    """
    per_record = (
        records.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("occurs"))
    )
    return per_record.groupBy("term").agg(F.sum("occurs").alias("occurrences"), F.count(F.lit(1)).alias("records"))


def mark_frequencies(terms: DataFrame, records: DataFrame, rare_at_most: int = 2, common_above: float = 0.2) -> DataFrame:
    """Add ``mark``: 'rare' in at most ``rare_at_most`` records, 'common' in more than a share ``common_above``
    of all ``records`` (with or without terms), else null. Rare wins where both hold."""
    total = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    return terms.withColumn(
        "mark",
        F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > total * F.lit(common_above), "common"),
    )
