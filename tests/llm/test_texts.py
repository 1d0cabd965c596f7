"""Packing, mixing, token counts and template residue."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import mixing, packing
from wayfold.llm.residue import find_residue, residue_kinds
from wayfold.llm.tokens import DEFAULT_VOCABULARY, token_counts

needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
def test_token_counts(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(DEFAULT_VOCABULARY)
    tokenizer.encode_special_tokens = True
    texts = [None, "", " ", "A fine review.", "<|endoftext|>", "grün " * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: r.n for r in df.select("id", token_counts(F.col("text")).alias("n")).collect()}
    assert found == {k: None if t is None else len(tokenizer.encode(t, add_special_tokens=False)) for k, t in enumerate(texts)}


def brute_sum_of_squares(sizes, capacity):
    fills = []

    def total(f):
        levels = np.bincount([x for x in f if x < capacity], minlength=capacity + 1)
        return int((levels**2).sum())

    for s in sizes:
        options = [(total([*fills, s]), 0, -1)]
        options += [(total([*fills[:b], f + s, *fills[b + 1:]]), -f, b) for b, f in enumerate(fills) if f + s <= capacity]
        _, _, b = min(options, key=lambda o: (o[0], o[1]))
        fills = [*fills, s] if b < 0 else [*fills[:b], fills[b] + s, *fills[b + 1:]]
    return sorted(fills)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 12).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=40))))
def test_sum_of_squares_equals_brute_force(case):
    capacity, sizes = case
    box = packing.sum_of_squares(sizes, capacity)
    fill = np.bincount(box, weights=sizes).astype(int) if sizes else np.empty(0, int)
    assert sorted(fill) == brute_sum_of_squares(sizes, capacity)


@pytest.mark.parametrize("per_shard", [250_000, 40])
def test_packing_places_everything_once(spark, per_shard):
    rng = random.Random(7)
    rows = [(k, rng.choice([1, 3, 17, 60, 99, 100, 101, 250, 1000])) for k in range(400)] + [(900, 0), (901, None), (902, 7), (902, 7)]
    items = spark.createDataFrame(rows, "item_id bigint, size int")
    kinds = spark.createDataFrame([("s", 100), ("l", 1000), ("none", 0)], "pack string, capacity int")
    packed = packing.pack(items, kinds, per_shard)
    found = packed.collect()
    for kind, capacity in (("s", 100), ("l", 1000)):
        mine = [r for r in found if r.pack == kind]
        per_item, fill = {}, {}
        for r in mine:
            per_item.setdefault(r.item_id, []).append((r.piece, r.size))
            fill[r.container] = fill.get(r.container, 0) + r.size
        for k, size in rows[:400]:
            pieces = sorted(per_item[k])
            assert sum(s for _, s in pieces) == size and len(pieces) == -(-size // capacity)
            assert [s for _, s in pieces[:-1]] == [capacity] * (len(pieces) - 1)
        assert per_item[902] == [(0, 7), (0, 7)] and 900 not in per_item and 901 not in per_item
        assert max(fill.values()) <= capacity
        row = packing.waste(packed).where(F.col("pack") == kind).first()
        assert row.containers == len(fill) and row.tokens == sum(fill.values()) and row.unused == len(fill) * capacity - row.tokens
        assert len(fill) <= row.least_containers * 1.05 + 2
    assert packing.pack(items.where("false"), kinds).count() == 0
    assert packing.pack(items, kinds.where("false")).count() == 0


def test_packing_of_items_that_fit_no_other_stays_in_shards(spark):
    items = spark.range(0, 6400).select(F.col("id").alias("item_id"), F.lit(60).alias("size"))
    kinds = spark.createDataFrame([("s", 100)], "pack string, capacity int")
    packed = packing.pack(items, kinds, 100)
    boxes = packing.containers(packed)
    assert boxes.count() == 6400 and boxes.where("items <> 1").count() == 0
    # the shards of the round that closed them: none has all that is left
    def largest(pdf):
        return pd.DataFrame({"n": [len(pdf)]})

    assert packed.groupBy(F.split("container", "-")[1]).applyInPandas(largest, "n long").agg(F.max("n")).first()[0] < 200
    mixed = items.unionByName(spark.range(7000, 13400).select(F.col("id").alias("item_id"), F.lit(40).alias("size")))
    both = packing.waste(packing.pack(mixed, kinds, 100)).first()
    assert both.containers <= both.least_containers * 1.02 and packing.flaws(packing.pack(mixed, kinds, 100)).first()[2:] == (0, 0, 0, False)


def test_packing_repeated_items_above_the_capacity(spark):
    rows = [(903, 250), (903, 250), (903, 330), (904, 100), (904, 100), (1, 100), (None, 250), (None, 250), (None, 100)]
    kinds = spark.createDataFrame([("s", 100), ("l", 1000)], "pack string, capacity int")
    packed = packing.pack(spark.createDataFrame(rows, "item_id bigint, size int"), kinds)
    boxes = packing.containers(packed).collect()
    assert all(0 <= r.unused < r.capacity and r.fill <= r.capacity for r in boxes)
    assert len({(r.pack, r.container) for r in boxes}) == len(boxes)
    assert sorted((r.item_id or 0, r.size) for r in packed.where("pack = 'l'").collect()) == sorted((k or 0, size) for k, size in rows)
    small = {r.pack: r for r in packing.waste(packed).collect()}["s"]
    # 15 full pieces, and rests of 50, 50, 30, 50, 50 in three more
    assert (small.tokens, small.containers, small.unused) == (1730, 18, 70)


def test_budgets_go_to_siblings_first():
    leaves = [(("web", "en", "a"), 0.3, 100), (("web", "en", "b"), 0.3, 1e9), (("web", "de", "c"), 0.2, 1e9), (("books", "en", "d"), 0.2, 1e9)]
    found = mixing.allocate(leaves, 1000)
    assert found[("web", "en", "a")] == pytest.approx(100)
    assert found[("web", "en", "b")] == pytest.approx(500)  # all of its sibling's shortage
    assert found[("web", "de", "c")] == pytest.approx(200) and found[("books", "en", "d")] == pytest.approx(200)
    leaves[1] = (("web", "en", "b"), 0.3, 50)
    found = mixing.allocate(leaves, 1000)  # the language is exhausted: its sibling language takes over, not the other domain
    assert found[("web", "de", "c")] == pytest.approx(650) and found[("books", "en", "d")] == pytest.approx(200)
    assert sum(mixing.allocate([(("a",), 1, 5), (("b",), 0, 9), (("c",), 2, 0)], 100).values()) == pytest.approx(5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 5), st.integers(0, 50)), min_size=1, max_size=9, unique_by=lambda t: t[:2]), st.integers(0, 300))
def test_budgets_are_whole_and_within_capacity(raw, total):
    leaves = [((a, b), float(w), float(c)) for a, b, w, c in raw]
    found = mixing.allocate(leaves, total)
    assert all(-1e-6 <= found[p] <= (c if w else 0) + 1e-6 for p, w, c in leaves)
    assert sum(found.values()) == pytest.approx(min(total, sum(c for _, w, c in leaves if w)), abs=1e-4)


def test_mixing(spark):
    rng = random.Random(11)
    docs = [(k, s, rng.randint(1, 40)) for k in range(3000) for s in [rng.choice(["big", "big", "big", "mid", "odd"])]]
    docs += [(5000 + k, "tiny", 20) for k in range(10)] + [(6000, None, 5), (6001, "big", None), (6002, "big", 0)]
    df = spark.createDataFrame(docs, "id bigint, source string, tokens int").withColumn("weight", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.1, 4), ("gone", 0.1, 9)], "source string, weight double, max_repeats int")
    selection, report = mixing.select(df, targets, ["source"])
    shares = {r.source: r for r in report.collect()}
    at_hand = {s: sum(t or 0 for _, x, t in docs if x == s) for s in ("big", "mid", "tiny")}
    assert shares["tiny"].tokens == 4 * at_hand["tiny"] and shares["tiny"].most_uses == 4 and shares["gone"].tokens == 0
    uses = {(r.id, r.source): (r.uses, r.tokens) for r in selection.collect()}
    assert len(uses) == selection.count() and all(s in ("big", "mid", "tiny") for _, s in uses)
    assert max(u for (_, s), (u, _) in uses.items() if s == "big") == 1
    for s in ("big", "mid"):
        got = sum(u * t for (_, x), (u, t) in uses.items() if x == s)
        assert got == shares[s].tokens and abs(got - shares[s].budget) <= 20
    assert sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    again, _ = mixing.select(df.repartition(7), targets, ["source"])
    assert {(r.id, r.source): (r.uses, r.tokens) for r in again.collect()} == uses
    other, _ = mixing.select(df, targets, ["source"], seed=1)
    assert {(r.id, r.source): (r.uses, r.tokens) for r in other.collect()} != uses
    nothing, empty = mixing.select(df.where("false"), targets, ["source"])
    assert nothing.count() == 0 and empty.count() == 4
    with pytest.raises(ValueError):
        mixing.select(df, targets.union(targets), ["source"])


def test_tree_of_sources_keeps_their_weights(spark):
    sizes = spark.createDataFrame(
        [(k, d, x, s, n) for k, (d, x, s, n) in enumerate([("web", "en", "a", 30), ("web", "de", "a", 10), ("web", "en", "b", 500), ("books", "en", "c", 900), ("web", "other", "a", None)])],
        "id bigint, domain string, lang string, source string, tokens int",
    )
    targets = spark.createDataFrame([("a", 0.4, 1, "web"), ("b", 0.2, 1, "web"), ("c", 0.3, 1, "books"), ("gone", 0.1, 9, "web")], "source string, weight double, max_repeats int, domain string")
    leaves = mixing.tree_targets(sizes, targets, "source", ["domain", "lang"])
    found = {(r.domain, r.lang, r.source): r.weight for r in leaves.collect()}
    assert found == pytest.approx({("web", "en", "a"): 0.3, ("web", "de", "a"): 0.1, ("web", "en", "b"): 0.2, ("books", "en", "c"): 0.3, ("web", None, "gone"): 0.1})
    budgets = {r[0]: r[4] for r in mixing.plan(sizes, leaves, ["domain", "lang", "source"], 400)}
    # what a lacks in both languages, and what gone lacks, is made up by b of the same domain and not by c
    assert budgets[("web", "en", "a")] == 30 and budgets[("web", "de", "a")] == 10
    assert budgets[("books", "en", "c")] == pytest.approx(120) and budgets[("web", "en", "b")] == pytest.approx(240)


RESIDUE = [
    ("slot", "Hello {{ first_name | title }}, thank you for your lamp."), ("slot", "Hi {{produ..."), ("slot", "I bought ${item} twice."),
    ("slot", "Fits <product name>, pleases my aunt."), ("slot", "It is &lt;city&gt; nice."), ("slot", "Perfekt für [Ihr Name] und mich."),
    ("slot", "Ten out of ten from %FIRST_NAME%."), ("slot", "Hello %1$s, nice."), ("slot", "Dear @@name@@!"), ("slot", "Signed ________."),
    ("slot", "The [object Object] lamp is fine."), ("slot", "Pleases undefined undefined, costs little."), ("slot", "(YOUR NAME)\n{0}"),
    ("slot", "Broke after %7B%7Bdate%7D%7D days."), ("slot", "Better than <?= $brand ?> by far."), ("slot", "The «city» shop."),
    ("slot", "templates {{ a }} {{ b }} {{ c }}"),
    ("filler", "Lorem ipsum dolor sit amet elit."), ("filler", "Good lamp. Tempor nostrud elit amet sint magna."), ("filler", "asdf asdf asdfasdf asdf asdf"),
    ("filler", "Title Paragraph word word Caption dummy"), ("filler", "It works. Sample text. / Sample text."), ("filler", "Your review goes here..."),
    ("filler", "Texte de remplissage!"), ("filler", "Blindtext für die Bewertung Blindtext für die Bewertung Blindt"), ("filler", "bla " * 50_000),
    ("message", "404 Not Found - Check the address and reload."), ("message", "Please enable JavaScript to view this page."),
    ("message", "<html><head><title>Oops</title></head></html>"), ("message", '{"status":500,"error":"Request timed out"}'),
    ("message", "Fine lamp, though\nYour session has expired. Sign in again."), ("message", "Diese Seite benötigt JavaScript um Bewertungen zu lesen."),
    ("message", "Traceback (most recent call last):\n  KeyError: 'text'"),
]
REAL = [
    None, "", "   ", "Even the printed manual still had lorem ipsum on the back, but the lamp is soft.", "Good good good",
    "A course on templates: it explains {{ title }} and {% for %} loops well.", "The form asked for [product name] and a serial.",
    'Size <M> fits, colour "{sand}" as shown, 100 % happy.', "Got %27 off {which was nice} and the filter <3 is light.", "Set {4 cups, 2 lids} arrived complete.",
    "Warranty terms stay undefined and support was null help.", "Model 404 is solid, model 500 is crooked.", "The JavaScript course is pleasant.",
    'My app kept saying "something went wrong, try again later" for a month.', "I use it as a placeholder until the old kettle is repaired.",
    "Page 70 of the booklet was not found in my copy.", "MUY CONTENTO CON ESTA COMPRA (TIENDA).", "Test, test, test: my aunt tested it for a month and it held.",
    "They sent a sample text with the planner, my dad laughed.", "Use `{{ name }}` in the settings and it prints fine.", "word " + "nice lamp, good light, well made. " * 20_000,
    "Rated #1 by my dad :thumbsup: [see photo] $ 69 well spent.",
]


def test_titles_of_pages_before_a_message(spark):
    pages = ["Access denied - Check the address and reload.", "Something went wrong: Please try again later.", "Fine lamp.\nAccess denied – Sign in again to continue.",
             "ACCESS DENIED | Go back to the homepage", "Something went wrong — the upstream server did not answer in time.", "Access denied.", "Something went wrong!"]
    real = ["Access denied - that is what my door said, the lock is poor.", "Something went wrong: the left leg was bent.", "Access denied to my own shed, thanks to this lock."]
    df = spark.createDataFrame(list(enumerate(pages + real)), "doc_id int, text string")
    assert {r.doc_id for r in find_residue(df).collect()} == set(range(len(pages)))


def test_residue_of_any_length(spark):
    long = "a" * 3000
    code = "x = {{ value }} " * 8000
    rows = [f"A course:\n```\n{code}```\nFine.", f"Use `{long} {{{{ x }}}}` here.", f"Hello {{{{ {long} }}}}.", f"Dear ${{{long}}}, fine.", f"It says {{% if {long} %}}", f"Never closed ```\n{code}",
            "qzkjfhgw " + "nice lamp. " * 5000, "bla " * 60_000, "Sample text. " * 30_000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    assert {r.doc_id: r.kinds for r in find_residue(df).collect()} == {2: ["slot"], 3: ["slot"], 4: ["slot"], 5: ["slot"], 6: ["filler"], 7: ["filler"], 8: ["filler"]}


def test_residue_near_words_on_templates(spark):
    slots = ["A course on templates: it explains {{ title }} and {% for %} loops well. The box weighs {{ city }} about 12 kilos.",
             "The template for drilling is included. Hello {{ name }}, the drill is fine and light and good.", "This tutorial is for loops:\n{{ a }} {{ b }} {{ c }}"]
    real = ["The tutorial has an example of loops:\nWrite {% for %} and close it, then the list is printed.", "A course on templates: it explains {{ title }} and {% for %} loops well."]
    df = spark.createDataFrame(list(enumerate(slots + real)), "doc_id int, text string")
    assert {r.doc_id for r in find_residue(df).collect()} == {0, 1, 2}


def test_residue_in_words_of_its_own(spark):
    """Wordings that no grammar lists as a whole."""
    slots = ["Order #ORDER_NUMBER# came fast.", "Dear {{guest}}, nice.", "Your parcel ${tracking.id} left.", "Sincerely, [Company Name]", "Thanks, [Insert Signature Here]", "Product: NaN stars", "Ships to __COUNTRY__."]
    filler = ["Sed ut perspiciatis unde omnis iste natus error sit voluptatem.", "Curabitur pretium tincidunt lacus, nulla gravida orci a odio.", "This is a placeholder text.", "Mustertext bitte ersetzen.", "kgahdggj sdekyjdgedhgdlihfhaashjjs"]
    pages = ["This site can't be reached", "502 Proxy Error", "Whoops, looks like something went wrong.", "Session timed out. Please log in again.", "ModuleNotFoundError: No module named 'shop'", "Cette page n'existe plus."]
    real = ["Ihr Browser ist egal, die Lampe leuchtet.", "Su navegador no importa, la radio funciona.", "404 not found is printed on the mug.", "Bitte versuchen Sie es selbst, es lohnt sich.", "very very very very good lamp", "She said __really__ good.",
            "Fahrzeugkaufvertrag lag bei, Rückgabefrist lang.", "The sample text on the label was hard to read.", "Size [M] fits, colour <blue> too.", "MUY CONTENTO CON ESTA COMPRA (TIENDA)."]
    kinds = ["slot"] * len(slots) + ["filler"] * len(filler) + ["message"] * len(pages) + [None] * len(real)
    df = spark.createDataFrame(list(zip(range(99), slots + filler + pages + real)), "doc_id int, text string")
    found = {r.doc_id: r.kinds for r in find_residue(df).collect()}
    assert [(t, found.get(k)) for k, (kind, t) in enumerate(zip(kinds, slots + filler + pages + real)) if found.get(k) != ([kind] if kind else None)] == []


def test_residue(spark):
    rows = [(k, kind, text) for k, (kind, text) in enumerate([*RESIDUE, *[(None, t) for t in REAL]])]
    df = spark.createDataFrame(rows, "doc_id int, kind string, text string").withColumn("kinds", F.lit("clash"))
    found = {r.doc_id: r.kinds for r in df.select("doc_id", residue_kinds(F.col("text")).alias("kinds")).collect()}
    assert [(text, found[k]) for k, kind, text in rows if found[k] != ([kind] if kind else [])] == []
    listed = {r.doc_id for r in find_residue(df).collect()}
    assert listed == {k for k, kind, _ in rows if kind}
    assert find_residue(df.union(df)).count() == 2 * len(listed)
    assert find_residue(df.where("false")).count() == 0
