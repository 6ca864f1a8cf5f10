import math

import pytest
from pyspark.sql import functions as F

from presswork.enums import BIASES
from presswork.functions.basics import half_up, instant
from presswork.operators import coverage as cov
from presswork.operators import narrative, ownership, readers, thin, timeline

AS_OF = "2024-06-15 12:00:00"


def articles(spark, rows):
    return spark.createDataFrame(rows, "story_id long, source_id long, bias string, ownership string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


def test_shares_are_rounded_each_and_ordered(spark):
    a = articles(spark, [(1, 1, "right", "other", "2024-06-15"), (1, 2, "left", "other", "2024-06-15"), (1, 3, "center", "other", "2024-06-15"), (1, 4, None, "other", "2024-06-15")])
    s = cov.spectrum_arrays(a).first().spectrum
    assert [(x.bias, x.percentage) for x in s] == [("left", 33), ("center", 33), ("right", 33)]


@pytest.mark.parametrize("left,right,sources,flag", [(80, 20, 2, True), (79, 21, 2, False), (20, 80, 5, True), (100, 0, 1, False)])
def test_blindspot_from_four_fifths(spark, left, right, sources, flag):
    s = F.array(F.struct(F.lit("left").alias("bias"), F.lit(left).alias("percentage")), F.struct(F.lit("right").alias("bias"), F.lit(right).alias("percentage")))
    assert spark.range(1).select(cov.blindspot(s, F.lit(sources)).alias("b")).first().b is flag


def test_velocity_and_phases(spark):
    a = articles(spark, [(1, i, "left", "other", t) for i, t in enumerate(["2024-06-15 10:00:00", "2024-06-15 09:00:00", "2024-06-15 08:00:00"])])
    m = cov.metrics(a, instant(AS_OF)).first()
    assert (m.articles_24h, m.articles_7d, m.coverage_hours) == (3, 3, 2.0)
    phase = lambda a, b, h: spark.range(1).select(cov.phase(F.lit(a), F.lit(b), F.lit(h)).alias("p")).first().p
    assert [phase(3, 3, 5.0), phase(1, 2, 60.0), phase(0, 2, 100.0), phase(0, 1, 100.0), phase(3, 3, 24.0)] == ["breaking", "developing", "analysis", "aftermath", "developing"]


def test_diversity_is_a_half_for_one_bucket_and_one_for_equal_ones(spark):
    a = articles(spark, [(1, 1, "left", "x", "2024-06-15"), (1, 2, "right", "x", "2024-06-15"), (2, 1, "left", "x", "2024-06-15")])
    f = {r.story_id: r.f for r in cov.spectrum_arrays(a).select("story_id", cov.diversity_factor(F.col("spectrum")).alias("f")).collect()}
    assert f[1] == pytest.approx(1.0) and f[2] == 0.5


def test_trending_rises_with_viewers_and_falls_with_age(spark):
    t = lambda *x: spark.range(1).select(cov.trending(*map(F.lit, x)).alias("t")).first().t
    assert t(50, 4, 1.0, 4.0, 10) > t(50, 4, 1.0, 4.0, 0) > t(50, 4, 1.0, 40.0, 0) > 0 == t(0, 4, 1.0, 4.0, 10)
    assert t(50, 4, 1.0, 4.0, 0) == pytest.approx(50 * (1 + math.log10(4)) * 6**-1.5)


def test_half_up_of_negative_and_decimals(spark):
    r = spark.range(1).select(half_up(F.lit(2.5)).alias("a"), half_up(F.lit(-2.5)).alias("b"), half_up(F.lit(0.125), 2).alias("c")).first()
    assert (r.a, r.b, r.c) == (3, -2, 0.13)


def test_concentration_of_owners(spark):
    rows = [(1, 1, "A"), (1, 1, "A"), (1, 2, "B"), (1, None, None)]
    c = ownership.concentration(spark.createDataFrame(rows, "k long, owner long, name string"), "k", "owner", "name").first()
    assert (c.total, c.unknown, c.dominant) == (4, 1, "A") and c.hhi == pytest.approx((4 + 1 + 1) / 16)


def test_hierarchy_ends_at_cycles(spark):
    o = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, None)], "owner_id long, parent_id long")
    found = {(r.owner_id, r.ancestor_id) for r in ownership.hierarchy(o).collect()}
    assert {(1, 2), (1, 3), (2, 3), (2, 1)} <= found and not any(a == b for a, b in found)


def test_hierarchy_has_no_last_level(spark):
    o = spark.createDataFrame([(i, i + 1) for i in range(20)], "owner_id long, parent_id long")
    assert ownership.hierarchy(o).where("owner_id = 0").count() == 20


def test_owner_of_statements(spark):
    rows = [
        ("one", "A", "P127", "normal"), ("rank", "A", "P127", "normal"), ("rank", "B", "P127", "preferred"), ("tie", "A", "P127", "normal"), ("tie", "B", "P127", "normal"),
        ("mixed", "A", "P127", "normal"), ("mixed", "B", "P749", "preferred"), ("best", "A", "P749", "normal"), ("best", "A", "P127", "normal"), ("best", "B", "P127", "preferred"), ("old", "A", "P127", "deprecated"), ("old", "B", "P123", "normal"),
    ]
    got = {r.subject: r.owner for r in ownership.resolved(spark.createDataFrame(rows, "subject string, owner string, property string, rank string")).collect()}
    assert got == {"one": "A", "rank": "B", "tie": None, "mixed": None, "best": "B", "old": "B"}


def test_owner_types_and_backfill(spark):
    kinds = [["Q4830453"], ["Q0", "Q131589", "Q5"], ["Q17343363"], ["Q20530050"], [], ["Q0"], None]
    d = spark.createDataFrame(list(enumerate(kinds)), "i int, c array<string>").select("i", ownership.owner_kind(F.col("c")).alias("k")).orderBy("i")
    assert [r.k for r in d.collect()] == ["private_company", "cooperative", "private_company", "trust", "private_company", "private_company", "private_company"]
    rows = spark.createDataFrame([(None, None, "Q1"), (1, "Q1", "Q1"), (1, "Q2", "Q1"), (1, None, "Q1")], "o long, c string, p string")
    for overwrite, last in ((False, "mismatch"), (True, "link")):
        x = rows.select(ownership.backfill(F.col("o"), F.col("c"), F.col("p"), overwrite, F.lit("high")).alias("x")).collect()
        assert [tuple(r.x) for r in x] == [("insert", "high"), ("confirmed", "high"), (last, "low"), (last, "low")]


def test_sentences_about_coverage(spark):
    lane = lambda l, c, r, d: F.struct(F.lit(l).alias("left"), F.lit(c).alias("center"), F.lit(r).alias("right"), F.lit(d).alias("dominant"))
    say = lambda c: spark.range(1).select(c).first()[0]
    assert say(narrative.overview(lane(60, 25, 15, "left"))) == "Coverage leans left overall: 60% left, 25% center, 15% right."
    assert say(narrative.coverage_gap(lane(10, 80, 10, "center"))) == "Coverage gap: the story is heavily center-weighted, with only 10% left coverage and 10% right coverage."
    assert say(narrative.coverage_gap(lane(50, 50, 0, "center"))).startswith("Coverage gap: right coverage is missing")
    assert say(narrative.coverage_gap(lane(45, 45, 10, "center"))).startswith("Coverage gap: right is the thinnest lane at 10%")
    assert say(narrative.framing_delta(F.lit("\u2022 Both agree\n\u2022 More"), F.lit("- Cost"), F.lit(None))) == "Shared reporting centers on Both agree. Left-leaning coverage emphasizes Cost, while right-leaning coverage emphasizes additional reporting context."
    models = F.array(*[F.struct(F.lit(o).alias("ownership"), F.lit(n).alias("n")) for o, n in (("corporate", 2), ("private-equity", 1))])
    assert say(narrative.ownership_mix(models)) == "Ownership mix spans 2 models: corporate (2), and private equity (1)."
    wide, narrow = lane(30, 40, 30, "center"), lane(0, 100, 0, "center")
    assert say(narrative.momentum(F.lit("A"), F.lit(4), F.lit(12), narrow, wide)) == "A opened coverage, and the story grew to 4 sources over 12 hours. The spectrum widened from center-only coverage to include left, center, and right lanes."
    assert say(narrative.momentum(F.lit("A"), F.lit(2), F.lit(1), narrow, narrow)).endswith("over 1 hours while staying within center-only coverage.")
    assert say(narrative.momentum(F.lit(None), F.lit(0), F.lit(0), narrow, narrow)).startswith("Coverage momentum will become clearer")


def test_thin_topics_go_by_categories_then_priors_then_keywords(spark):
    rows = [(1, 1, 7, "x", ["Tech", "AI"]), (1, 2, 7, "x", ["markets"]), (1, 3, 8, "x", ["software"]), (2, 1, 7, "x", ["tech"]), (2, 2, 8, "x", ["money"]), (3, 1, 9, "The film festival", None), (4, 1, 9, "x", [])]
    a = spark.createDataFrame(rows, "k long, article long, source_id long, title string, categories array<string>")
    p = spark.createDataFrame([(7, "health", 0.8, 20), (8, "world", 0.9, 9), (9, "sports", 0.39, 50)], "source_id long, topic string, confidence double, total long")
    assert {r.k: r.topic for r in thin.classified(a, p, "k").collect()} == {1: "technology", 2: "health", 3: "culture", 4: "politics"}


def test_thin_topics_deal_articles_by_their_key_once(spark):
    rows = [(1, 1, 7, "x", ["Tech", "tech"]), (1, 1, 7, "x", ["software"]), (1, 2, 7, "x", ["europe"]), (1, 3, 8, "x", ["world"]), (1, None, 8, None, ["world", "markets"])]
    rows += [(2, 1, 7, "x", []), (2, 2, 8, "x", ["weather"]), (None, 1, 7, "The film festival", ["Tech"]), (3, 1, None, None, None), (4, 1, 7, "film", None), (4, 1, 9, "festival", None)]
    a = spark.createDataFrame(rows, "k long, article long, source_id long, title string, categories array<string>")
    p = spark.createDataFrame([(7, "health", 0.8, 20), (8, "world", 0.8, 20)], "source_id long, topic string, confidence double, total long")
    out = thin.classified(a, p, "k")
    assert {r.k: r.topic for r in out.collect()} == {1: "world", 2: "environment", None: "culture", 3: "politics", 4: "health"}
    assert {r.k: r.topic for r in thin.by_priors(a, p, "k").collect()} == {1: None, 2: None, 4: "health"}
    plan = thin.classified(a, p, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k#") == 1


def test_largest_remainder_sums_to_100(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 1, 2)], "k long, n long, o int")
    shares = [r.share for r in cov.largest_remainder(rows, "k", "n", "o").orderBy("o").collect()]
    assert shares == [34, 33, 33]


def test_weighted_centroid_falls_back_to_the_mean(spark):
    rows = spark.createDataFrame([(1, [2.0, 4.0], 1.0), (1, [4.0, 8.0], 3.0), (2, [2.0, 4.0], 0.0), (2, [4.0, 6.0], None)], "k long, v array<double>, w double")
    c = {r.k: list(r.centroid) for r in cov.weighted_centroid(rows, "k", "v", "w").collect()}
    assert c == {1: [3.5, 7.0], 2: [3.0, 5.0]}


def test_dominant_ties(spark):
    rows = spark.createDataFrame([(1, "right"), (1, "left"), (2, "left"), (2, "left"), (2, "right"), (3, None)], "k long, v string")
    assert {r.k: r.v for r in cov.dominant(rows, "k", "v", BIASES).collect()} == {1: "left", 2: "left"}
    assert {r.k: r.v for r in cov.dominant_or_null(rows, "k", "v").collect()} == {1: None, 2: "left"}


def test_timeline_shift_and_milestone(spark):
    a = articles(spark, [(1, i, "left" if i < 4 else "right", "x", f"2024-06-15 0{i}:00:00") for i in range(5)])
    t = timeline.states(a, "story_id", ["published_at", "source_id"]).orderBy("place").collect()
    assert [r["shift"] for r in t] == [False, False, False, False, True] and [r.milestone for r in t] == [None] * 4 + [5]
    e = [(r.kind, r.place) for r in timeline.events(timeline.states(a, "story_id", ["published_at", "source_id"]), "story_id").orderBy("sequence").collect()]
    assert e[-3:] == [("source", 5), ("shift", 5), ("milestone", 5)]


@pytest.mark.parametrize("args,score", [((True, 40, 0.0, True, True), 115), ((False, 15, 24.0, True, False), 35), ((False, 14, 48.0, False, True), 0)])
def test_for_you(spark, args, score):
    assert spark.range(1).select(readers.for_you_score(*map(F.lit, args)).alias("s")).first().s == score


def test_weighted_centroid_of_named_vectors_nulls_and_lengths(spark):
    """Sums made row by row, combined and by named vectors are the same, whatever the lengths, nulls and batches."""
    vectors = [(0, [1.0, 2.0]), (1, [3.0, None, 5.0]), (2, []), (3, [None, None]), (4, None)]
    rows = [(k, v, w) for k in range(12) for v in range(-1, 6) for w in (0.0, 0.5 + k, None) if (k + v) % 3] + [(12, 0, 0.0)] * 30 + [(None, 0, 2.0), (None, 1, 1.0), (13, 2, 1.0), (14, 3, 1.0)]
    r = spark.createDataFrame(rows, "k long, id long, w double")
    named = spark.createDataFrame(vectors, "id long, v array<double>")
    want = {}
    for key in {k for k, _, _ in rows}:
        mine = [(dict(vectors)[v], w or 0.0) for k, v, w in rows if k == key and dict(vectors).get(v) is not None]
        n = max((len(x) for x, _ in mine), default=0)
        c = []
        for i in range(n):
            at = [(x[i], w) for x, w in mine if len(x) > i]
            good, whole = [(x, w) for x, w in at if x is not None], sum(w for _, w in at)
            c.append(None if not good else sum(x * w for x, w in good) / whole if whole > 0 else sum(x for x, _ in good) / len(good))
        if n:
            want[key] = c
    joined = r.join(named, "id")
    for found in (cov.weighted_centroid(joined, "k", "v", "w"), cov.weighted_centroid(joined.coalesce(1), "k", "v", "w"), cov.weighted_centroid(r, "k", "v", "w", named, "id")):
        got = found.collect()
        assert len(got) == len(want)
        assert {x.k: [None if y is None else round(y, 9) for y in x.centroid] for x in got} == {k: [None if y is None else round(y, 9) for y in c] for k, c in want.items()}
