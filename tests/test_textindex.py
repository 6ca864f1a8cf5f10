"""Stems, postings, and searches against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from presswork.functions.stems import stem
from presswork.functions.text import matches
from presswork.operators import textindex as ti

# what the published rules give for words of each rule
STEMS = """caresses caress|flies fli|dies die|mules mule|denied deni|died die|agreed agre|owned own|humbled humbl|sized size|meeting meet|stating state|siezing siez|itemization item|sensational sensat|traditional tradit
reference refer|colonizer colon|plotted plot|running run|hopping hop|hoping hope|happy happi|sky sky|enjoy enjoy|cry cri|by by|say say|relational relat|conditional condit|rational ration|generously generous|generate generat|communication communic
news news|proceed proceed|succeeded succeed|gas gas|this this|gaps gap|kiwis kiwi|analogies analog|hopefulness hope|national nation|formative format|electrical electr|goodness good|revival reviv|allowance allow|inference infer|adjustable adjust
replacement replac|adjustment adjust|dependent depend|adoption adopt|homologous homolog|effective effect|bowdlerize bowdler|rate rate|cease ceas|controll control|roll roll|knightly knight|consign consign|consistency consist|knots knot"""


@pytest.mark.parametrize("pair", STEMS.replace("\n", "|").split("|"))
def test_stems(pair):
    word, expected = pair.split()
    assert stem(word) == expected


def index(spark, texts, **more):
    docs = spark.createDataFrame([(i, *t) for i, t in texts.items()], "id long, headline string, body string").repartition(3)
    return ti.postings(docs, "id", ["headline", "body"], **more)


def ids(df):
    return {r.id for r in df.collect()}


def test_searches_of_english(spark, tmp_path):
    texts = {1: ("Senators voted on the budget", "The vote was close."), 2: ("Budget votes", None), 3: ("A vote for budgets", "nothing else"), 4: (None, None), 5: ("Running out of time", "They ran and were running")}
    i = ti.written(index(spark, texts), str(tmp_path / "index"))
    find = lambda q: ids(ti.search(i, q))
    assert find("vote") == {1, 2, 3} and find("voting budget") == {1, 2, 3} and find('"vote budget"') == set() and find('"voted on the budget"') == {1}
    assert find('"vote for budget"') == {3}  # the gap of the word between counts
    assert find("vote -close") == {2, 3} and find("runs or closing") == {1, 5} and find("the of") == set() and find("-vote") == set() and find("") == set()
    rank = {r.id: round(r["rank"], 6) for r in ti.search(i, "vote", weights={"headline": "A", "body": "B"}).collect()}
    assert rank == {1: 1.4, 2: 1.0, 3: 1.0}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_searches_are_those_of_a_scan(spark, seed):
    rnd = random.Random(seed)
    words = ["oil", "gas", "price", "the", "of", "x1"]
    texts = {i: (" ".join(rnd.choices(words, k=rnd.randint(0, 6))), None) for i in range(60)}
    i = index(spark, texts, english=False)
    docs = spark.createDataFrame([(k, t[0]) for k, t in texts.items()], "id long, t string")
    for q in ("oil", '"oil gas"', '"gas gas price"', "oil or gas -price", '"the price of" or x1 oil', '-"oil price" gas', '"of the of"'):
        assert ids(ti.search(i, q, english=False)) == ids(docs.where(matches(F.col("t"), q))), q


def test_postings_of_edges(spark):
    rows = {1: ("", None), 2: ("a a b", "b"), 3: ("É ß", "ünïcode x")}
    got = sorted((r.term, r.id, r.field, r.positions, r.n) for r in index(spark, rows, english=False).collect())
    assert got == [("a", 2, "headline", [0, 1], 2), ("b", 2, "body", [0], 1), ("b", 2, "headline", [2], 1), ("code", 3, "body", [1], 1), ("n", 3, "body", [0], 1), ("x", 3, "body", [2], 1)]
    assert ti.postings(spark.createDataFrame([(None, "no id")], "id long, t string"), "id", ["t"]).count() == 0
    long = spark.createDataFrame([(1, "word " * 50_000)], "id long, t string")
    assert ti.postings(long, "id", ["t"]).first().n == 50_000
