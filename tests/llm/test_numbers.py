"""Percentiles, term frequencies and first items of groups against brute force, with awkward rows."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa

from wayfold.llm import percentiles as pct
from wayfold.llm.terms import latest_records, mark_frequencies, tag_terms, term_frequencies
from wayfold.llm.topn import _first_n, top_n


def ranked(values, per_mille):
    values = sorted(values)
    return values[max(1, -(-len(values) * per_mille // 1000)) - 1]


def expected_percentiles(rows):
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    return {g: (len(v), *[ranked(v, p) for p in pct.PER_MILLE]) for g, v in groups.items()}


@pytest.mark.parametrize("rows_per_slice", [200_000, 50])
def test_percentiles(spark, rows_per_slice):
    rng = random.Random(1)
    rows = [("a", rng.gauss(0, 1e3)) for _ in range(700)] + [("b", float(rng.randint(-3, 3))) for _ in range(500)]
    rows += [("c", 5.0), (None, 1.5), (None, -1.5), ("d", None), ("d", float("nan")), ("e", -0.0), ("e", 0.0), ("a", 1e300), ("a", -1e300)]
    data = [(k, g, v, "x") for k, (g, v) in enumerate(rows)]
    data += data[:50]  # copies of rows
    df = spark.createDataFrame(data, "obs bigint, grp string, values double, n string")
    counts = pct.value_counts(df, ["grp"], "values", "obs")
    found = {r[0]: tuple(r)[1:] for r in pct.percentiles(counts, ["grp"], rows_per_slice=rows_per_slice).collect()}
    assert found == expected_percentiles(rows)


def test_counts_of_pieces_add_up(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("xy"), rng.randint(1, 9), float(rng.randint(0, 50))) for k in range(400)]
    df = spark.createDataFrame(rows, "obs bigint, grp string, day int, v double")
    days = pct.value_counts(df, ["grp", "day"], "v", "obs")
    parts = days.where("day < 5").unionByName(days.where("day >= 5"))
    merged = pct.percentiles(pct.merge_counts(parts, ["grp"]), ["grp"])
    direct = pct.percentiles(pct.value_counts(df, ["grp"], "v", "obs"), ["grp"])
    assert sorted(merged.collect()) == sorted(direct.collect())
    all_at_once = pct.percentiles(pct.merge_counts(parts, []), [], [0, 500, 1000]).first()
    values = sorted(r[3] for r in rows)
    assert tuple(all_at_once) == (400, values[0], ranked(values, 500), values[-1])


def test_rounded_counts_keep_the_error_bound(spark):
    rng = random.Random(9)
    values = [rng.lognormvariate(0, 5) * rng.choice([1, -1]) for _ in range(2000)] + [0.0, 1e-300]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "obs bigint, v double")
    counts = pct.value_counts(df, [], "v", "obs", digits=2)
    found = pct.percentiles(counts, []).first()
    for p, got in zip(pct.PER_MILLE, tuple(found)[1:]):
        true = ranked(values, p)
        assert abs(got - true) <= 0.0501 * abs(true)
    assert counts.count() < 1500
    with pytest.raises(ValueError):
        pct.value_counts(df, [], "v", digits=0)
    with pytest.raises(ValueError):
        pct.percentiles(counts, [], [1001])


def test_percentiles_of_nothing_and_without_ids(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0)], "obs bigint, v double")
    assert tuple(pct.percentiles(pct.value_counts(df, [], "v", "obs"), [], [500]).first()) == (2, 1.0)
    assert pct.percentiles(pct.value_counts(df.where("false"), ["obs"], "v"), ["obs"]).count() == 0


def test_terms(spark):
    rows = [
        (1, {"Amenity ": " Bar;bar ; ;Pub", "x": None}, 1),
        (1, {"amenity": "ignored, as loaded earlier"}, 0),
        (2, {"amenity": "bar", "AMENITY": "BAR"}, 1),
        (3, {}, 1), (4, None, 1), (5, {"k": "v=w"}, None), (None, {"amenity": "bar"}, 1), (6, {"k": "long " * 20000}, 1), (6, {"k": "long " * 20000}, 1),
    ]
    df = spark.createDataFrame(rows, "id bigint, tags map<string,string>, loaded_at int").withColumn("term", F.lit("clash")).withColumn("content", F.lit(1))
    records = latest_records(df, "id", "loaded_at", "tags")
    found = {r.term: (r.occurrences, r.records, r.mark) for r in mark_frequencies(term_frequencies(records, tag_terms(F.col("content"))), records, 1, 0.3).collect()}
    long = ("k=" + "long " * 20000).strip()
    assert found == {"amenity=bar": (4, 2, "common"), "amenity=pub": (1, 1, "rare"), "k=v=w": (1, 1, "rare"), long: (1, 1, "rare")}
    none = latest_records(df.where("false"), "id", "loaded_at", "tags")
    assert mark_frequencies(term_frequencies(none, tag_terms(F.col("content"))), none).count() == 0


def best(rows):
    groups = {}
    for g, score, item, limit in rows:
        if score is not None and not math.isnan(score) and item is not None and limit is not None:
            groups.setdefault(g, []).append((score, item, limit))
    out = []
    for g, members in groups.items():
        seen = set()
        for score, item, limit in sorted(members):
            if item not in seen and len(seen) < limit:
                seen.add(item)
                out.append((g, score, item))
    return sorted(out, key=str)


def test_top_n(spark):
    rng = random.Random(6)
    limit = {"a": 5, "b": 0, "c": 3, None: 2}
    rows = [(g := rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, float("nan"), 1.0, 2.0, 2.0, -3.0, 0.5]), rng.choice([None, *range(8)]), limit[g]) for _ in range(400)]
    rows += [("z", 1.0, 1, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "grp string, s double, item bigint, k int, _rank string").repartition(3)
    found = sorted(((r.grp, r.s, r.item) for r in top_n(df, ["grp"], "s", "item", "k").collect()), key=str)
    assert found == best(rows)
    assert top_n(df.where("false"), ["grp"], "s", "item", "k").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(0, 5)), max_size=40), st.lists(st.integers(1, 40), max_size=5), st.integers(1, 4))
def test_first_n_whatever_the_batches(rows, cuts, limit):
    rows = sorted(rows)
    edges = sorted({0, len(rows), *[c for c in cuts if c < len(rows)]})
    batches = [
        pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:b]], pa.int64()) for i in range(3)] + [pa.array([limit] * (b - a), pa.int32())], names=["g", "s", "item", "k"])
        for a, b in zip(edges, edges[1:])
    ]
    found = [(r["g"], float(r["s"]), r["item"]) for b in _first_n(["g"], "item", "k")(iter(batches)) for r in b.to_pylist()]
    assert sorted(found, key=str) == best([(g, float(s), i, limit) for g, s, i in rows])
    assert np.all([found[i] <= found[i + 1] for i in range(len(found) - 1)])
