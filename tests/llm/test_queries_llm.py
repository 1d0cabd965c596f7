import os

import pytest

from oracle import DATA, assert_same
from wayfold.llm.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs_on_whole_tables(spark, name):
    found = QUERIES[name](spark, DATA)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_found_columns(spark):
    expected = {
        "p4_found": [("term", "string"), ("mark", "string")],
        "p5_found": [("node_idx", "bigint"), ("category", "string"), ("poi_id", "bigint")],
        "p8_found": [("doc_id", "bigint")],
    }
    assert {n: QUERIES[n](spark, DATA).dtypes for n in expected} == expected


def test_packing_is_whole(spark):
    import duckdb

    texts = duckdb.sql(f"SELECT count(*) FROM read_parquet('{DATA}/documents.parquet') WHERE text <> ''").fetchall()[0][0]
    packed = QUERIES["p6_packing"](spark, DATA)
    assert {r["pack"]: r["n"] for r in packed.groupBy("pack").agg({"item_id": "count"}).withColumnRenamed("count(item_id)", "n").collect()}.keys() == {"small", "medium", "large"}
    assert packed.select("pack", "item_id").distinct().count() == 3 * texts


def test_tokens_by_parts_equal_those_of_the_library(spark):
    from tokenizers import Tokenizer

    from wayfold.llm.tokens import DEFAULT_VOCABULARY, counter

    tokenizer = Tokenizer.from_file(DEFAULT_VOCABULARY)
    tokenizer.encode_special_tokens = True
    count = counter(tokenizer.to_str())
    texts = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").select("text").collect()]
    texts += ["<|endoftext|> ½²³ \u00a0 \t\n\n x", "e\u0301\u200d👍🏽 don't DON'T it'll", "日本語 русский १२३", "x" * 20_000]
    assert [count(t) for t in texts] == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_languages_of_a_source_are_whole(spark, tmp_path):
    langs = ["en", "EN", "de-AT", "de_DE", "fr", "es", " es ", None, "", "English", "pt", "-", "und"]
    docs = [(k, source, lang, "a word or two of a review " * (k % 5 + 1)) for k, (source, lang) in enumerate((s, x) for s in ("a", "b", None) for x in langs)]
    spark.createDataFrame(docs, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    targets = [("a", 0.5, 1), ("b", 0.5, 1)]
    spark.createDataFrame(targets, "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    # every document is used once, as the targets of both sources together allow no more than what is there
    by_source = {r.source: r for r in QUERIES["p7_shares"](spark, str(tmp_path)).collect()}
    leaves = {(r.source, r.lang): r for r in QUERIES["p7_language_shares"](spark, str(tmp_path)).collect()}
    assert len(leaves) == 10
    for source in ("a", "b"):
        mine = {lang: r for (s, lang), r in leaves.items() if s == source}
        assert {lang: r.documents for lang, r in mine.items()} == {"en": 2, "de": 2, "fr": 1, "es": 2, "other": 6}
        assert {r.domain for r in mine.values()} == {source}
        assert sum(r.tokens for r in mine.values()) == by_source[source].tokens
        assert sum(r.target_share for r in mine.values()) == pytest.approx(0.5)
