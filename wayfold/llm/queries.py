"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import mixing, packing
from wayfold.llm import percentiles as pct
from wayfold.llm.oracle import ORACLE_SQL
from wayfold.llm.residue import find_residue
from wayfold.llm.terms import latest_records, mark_frequencies, tag_terms, term_frequencies
from wayfold.llm.tokens import token_counts
from wayfold.llm.topn import top_n
from wayfold.session import cut_lineage, table

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Languages with a leaf of their own in the tree of p7; all others, and none, share one.
LANGUAGES = ("en", "de", "fr", "es")
#: Domains that sources belong to in that tree; a source that isn't named is a domain of its own.
DOMAINS = {
    "storefront": "shop", "mobile_app": "shop", "kiosk": "shop", "partner_feed": "partners",
    "mail_survey": "asked", "beta_panel": "asked", "call_notes": "service", "forum_digest": "service",
}
#: Counts from which a group is cut in p1_category_sliced, so that offsets matter on small tables too.
SMALL_SLICES = 500
#: Significant digits of p1_category_rounded.
DIGITS = 3


def _counts(spark: SparkSession, d: str, group: list[str]) -> DataFrame:
    return pct.value_counts(table(spark, d, "initialize_acc_var"), group, "values", "obs_id")


def _percentiles(*group: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return pct.percentiles(_counts(spark, d, list(group)), group)

    query.__doc__ = f"Percentiles of values for each {', '.join(group)}."
    return query


def p1_category_sliced(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each category, with its values cut into slices over many tasks."""
    return pct.percentiles(_counts(spark, d, ["category"]), ["category"], rows_per_slice=SMALL_SLICES)


def p1_category_rounded(spark: SparkSession, d: str) -> DataFrame:
    """Whether percentiles from counts of rounded values, of bounded number, are within the stated error of exact ones."""
    names = [pct.named(p) for p in pct.PER_MILLE]
    rounded = pct.value_counts(table(spark, d, "initialize_acc_var"), ["category"], "values", "obs_id", DIGITS)
    near = pct.percentiles(rounded, ["category"]).select("category", F.col("values_n").alias("n"), F.array(*names).alias("near"))
    exact = pct.percentiles(_counts(spark, d, ["category"]), ["category"]).select(F.col("category").alias("c"), "values_n", F.array(*names).alias("exact"))
    bound = pct.relative_error(DIGITS) * (1 + 1e-12)
    both = near.join(exact, F.col("category").eqNullSafe(F.col("c")))
    within = F.forall(F.arrays_zip("near", "exact"), lambda v: F.abs(v["near"] - v["exact"]) <= bound * F.abs(v["exact"]))
    return both.select("category", "values_n", ((F.col("n") == F.col("values_n")) & within).alias("within"))


def p1_month_from_days(spark: SparkSession, d: str) -> DataFrame:
    """Counts of days summed to months, then their percentiles: the same as over all rows of the month."""
    days = _counts(spark, d, ["category", "obs_date"])
    months = pct.merge_counts(days.withColumn("month", F.trunc("obs_date", "month")), ["category", "month"])
    return pct.percentiles(months, ["category", "month"])


def _terms(spark: SparkSession, d: str) -> DataFrame:
    records = latest_records(table(spark, d, "nodes"), "id", "loaded_at", "tags")
    return mark_frequencies(term_frequencies(records, tag_terms(F.col("content"))), records)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, the elements that have it, and its mark."""
    return _terms(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pois = table(spark, d, "find_all_nearest_pois").where(F.col("distance") >= 0)
    named = pois.withColumn("category", F.lower(F.trim("category")))
    return top_n(named, ["node_idx", "category"], "distance", "poi_id", "num_of_pois").select(
        "node_idx", "category", "poi_id"
    )


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), token_counts(F.col("text")).alias("size"))
    capacities = table(spark, d, "pack_sizes").select(F.col("pack_name").alias("pack"), F.col("capacity_tokens").alias("capacity"))
    return packing.pack(sizes, capacities)  # each text is tokenized once, for all capacities


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or piece of one, for each capacity."""
    return _packed(spark, d)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Fill of each container."""
    return packing.containers(_packed(spark, d))


def p6_waste(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused tokens in total, for each capacity."""
    return packing.waste(_packed(spark, d))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed for each capacity, and what would be wrong with the containers."""
    return packing.flaws(_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Selection and report over a tree of domains, languages and sources.

    A source's weight is parted by what it holds in each language. What a source lacks is made up by those of
    the same domain and language first, then by other languages of the domain, then by other domains.
    """
    code = F.lower(F.regexp_extract("lang", r"^\s*(\p{L}+)\s*(?:[-_]|$)", 1))
    named = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    domain = F.coalesce(named[F.col("source")], F.col("source")).alias("domain")
    sizes = cut_lineage(table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "source", F.coalesce(F.when(code.isin(*LANGUAGES), code), F.lit("other")).alias("lang"),
        domain, token_counts(F.col("text")).alias("tokens"),
    ))
    targets = table(spark, d, "mix_targets").withColumnRenamed("target_share", "weight").withColumn("domain", domain)
    leaves = cut_lineage(mixing.tree_targets(sizes, targets, "source", ["domain", "lang"]))
    return mixing.select(sizes, leaves, ["domain", "lang", "source"])


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The selected documents and how often each is used."""
    return _mixed(spark, d)[0]


def _by_source(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("source").agg(
        *[F.sum(c).alias(c) for c in ("target_share", "budget", "documents", "tokens")], F.max("most_uses").alias("most_uses"), F.sum("actual_share").alias("actual_share")
    )


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return _by_source(_mixed(spark, d)[1])


def p7_language_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each leaf of the tree of domains, languages and sources.

    The language ``other`` holds null and any further language, so the tree has every document of its sources.
    """
    return _mixed(spark, d)[1]


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each source of the targets: no document above its repeats; its budget met but for half a document a
    leaf; and at least its target share, or all it can give."""
    selection, report = _mixed(spark, d)
    targets = table(spark, d, "mix_targets")
    sizes = table(spark, d, "documents").select("source", token_counts(F.col("text")).alias("tokens")).groupBy("source").agg(
        F.sum("tokens").alias("held"), F.max("tokens").alias("largest")
    )
    most = selection.groupBy("source").agg(F.max("uses").alias("uses"))
    total = report.agg(F.sum("tokens")).scalar()
    slack = (F.coalesce("largest", F.lit(0)) / 2 + 1) * (len(LANGUAGES) + 1)
    wanted = F.least(F.col("target_share") * total, F.coalesce("held", F.lit(0)) * F.col("max_repeats"))
    by_source = _by_source(report).select("source", "tokens", "budget")
    return targets.join(by_source, "source").join(sizes, "source", "left").join(most, "source", "left").select(
        "source", (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"),
        (F.abs(F.col("tokens") - F.col("budget")) <= slack).alias("on_budget"), (F.col("tokens") >= wanted - slack).alias("share_or_all"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents")).select("doc_id")


QUERIES = {
    "p1_category_node": _percentiles("category", "node_idx"),
    "p1_category_day": _percentiles("category", "obs_date"),
    "p1_category": _percentiles("category"),
    "p1_month_from_days": p1_month_from_days,
    "p1_category_sliced": p1_category_sliced,
    "p1_category_rounded": p1_category_rounded,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p5_found": p5_found,
    "p6_packing": p6_packing,
    "p6_containers": p6_containers,
    "p6_waste": p6_waste,
    "p6_checks": p6_checks,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_language_shares": p7_language_shares,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
}
