"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

from presswork.llm import fingerprints, lines, maxscore, mixing, near_dup, packing, passages, quality, queries, recurrent_lm, token_counts

LONG = " ".join(f"w{i}" for i in range(30_000))
BLOCK = "first line of many words\nsecond line of many words\nthird line of words"
ROWS = [
    (1, "a b c d e f g h", "en"),
    (2, "A b c d e f g h", None),
    (3, None, "en"),
    (4, "", "de"),
    (5, " \n\t ", None),
    (6, LONG, "en"),
    (6, LONG, "en"),
    (7, LONG + " end", "de"),
    (None, "no id here", "en"),
    (8, BLOCK, "en"),
    (9, BLOCK, "de"),
    (10, "x", "fr"),
    (11, "Été \U0001f600 naïve", "fr"),
]
CLASH = ["node", "root", "bucket", "part", "n", "word", "words", "rate", "p", "label", "grade", "start", "place", "signature", "digest", "copies", "__gone"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH:
        df = df.withColumn(c, F.lit(c))
    return df.repartition(3)


TOKENS = queries.tokenizer_path("word_bpe_49k.json")
RANKS = queries.tokenizer_path("byte_bpe_50k.tiktoken")


def ratings(spark):
    return spark.createDataFrame([(1, 2), (2, 0), (6, 1), (99, 2), (None, 1), (4, None), (1, 0)], "doc_id long, grade int")


OPERATORS = {
    "near": lambda s, d: near_dup.near_duplicates(d),
    "near_filter": lambda s, d: near_dup.deduplicated(d),
    "mixing": lambda s, d: mixing.mixing_rates(d, queries.languages(d), queries.LANGUAGE_WEIGHTS)[0],
    "mixed": lambda s, d: mixing.mixed(d, queries.languages(d), queries.LANGUAGE_WEIGHTS),
    "fingerprints": lambda s, d: fingerprints.compared(d),
    "tokens": lambda s, d: token_counts.apply(queries.edits_of(token_counts.index(d, RANKS, queries.pretokens())), None, RANKS, queries.pretokens()),
    "passages": lambda s, d: passages.repeats(d),
    "passages_cut": lambda s, d: passages.without_repeats(d),
    "lines": lambda s, d: lines.without_repeats(d),
    "lines_filter": lambda s, d: lines.deduplicated(d),
    "packing": lambda s, d: packing.pack_documents(d, TOKENS, 2048),
    "quality": lambda s, d: quality.scored(d, quality.fit(d, ratings(s), 3), 3),
    "quality_filter": lambda s, d: quality.selected(d, quality.fit(d, ratings(s), 3), 3),
    "lm": lambda s, d: recurrent_lm.language_model_scores(d, 1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_are_defined(spark, docs, name):
    rows = OPERATORS[name](spark, docs).collect()
    ids = sorted((r.doc_id for r in rows if r.doc_id is not None))
    every = [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11]
    if name in ("near", "lines", "tokens", "quality", "lm", "passages_cut", "fingerprints"):
        assert ids == every
    if name == "packing":
        assert sorted(r.doc_id for r in rows if r.piece == 0) == every and all(r.offset + r.length <= 2048 for r in rows)
        assert {r.length for r in rows if r.doc_id in (3, 4, 5)} == {1}
    if name == "passages":  # the long text repeats itself in its longer copy alone; equal rows are one
        assert {r.doc_id for r in rows} == {6, 7} and all(r.first_doc_id == 6 for r in rows)
    if name == "lines_filter":  # the later copies of whole texts go
        assert ids == [1, 2, 3, 4, 5, 6, 6, 7, 8, 10, 11]
    if name == "mixing":  # equal rows have one rate
        assert ids == sorted(set(every))
    if name in ("near_filter", "passages_cut", "lines", "mixed", "quality_filter"):
        assert any(r.doc_id is None for r in rows) and set(docs.columns) <= set(rows[0].asDict())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(spark, docs, name):
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline_on_edge_rows(spark, tmp_path, rows):
    """Null ids are judged and packed nowhere, null texts are empty, an empty table gives no rows, columns with clashing names stay."""
    import corpus_pipeline

    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for c in ("node", "root", "bucket", "rate", "p"):
        d = d.withColumn(c, F.lit(c))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in (1, 6, 8, 10, 11)] + [(None, 0, 1), (3, None, None)]
    spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.doc_id is not None and r.offset + r.length <= 2048 for r in out)
    assert {r.doc_id for r in out} <= {r[0] for r in rows} and bool(out) == bool(rows)


def test_near_duplicates_of_edges(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got[1] == (4, 1, True) and got[2] == (4, 1, False) and got[3] == (0, 3, True) and got[5] == (0, 5, True)
    assert got[6] == (29_996, 6, True) and got[7][1:] == (6, False) and got[9] == (got[8][0], 8, False) and got[10] == (1, 10, True)


def test_maxscore_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (None, [1.0, 1.0]), (50, [0.9, -0.2]), (50, [0.1, 0.2]), (7, [1.0]), (8, []), (100, [])]
    v = maxscore.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.search(v, v.where("vec_id % 50 = 0"), 2).orderBy("query_id", "rank").collect()]
    half = 2 * 128 * 128
    assert got[:2] == [(0, 1, 1, half), (0, 2, 2, half)] and {g[0] for g in got} == {0, 50, 100} and (100, 1, 8, 0) in got
    big = maxscore.quantized(spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>"))
    assert [r.score for r in maxscore.search(big, big.where("vec_id = 0"), 2).orderBy("rank").collect()] == [2**63 - 1, -(2**63)]
    assert maxscore.search(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("known", [True, False])
def test_components_of_a_chain_and_a_star(spark, known):
    from presswork.llm.components import components

    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 200)]
    rows, n = components(spark.createDataFrame(chain, "u long, v long"), n=len(chain) if known else None)
    got = {r.node: r.root for r in rows.collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and all(got[100 + i] == 100 for i in range(1, 200)) and n == len(got)


def test_edits_with_nulls_and_repeats(spark):
    """Null numbers are 0, a null `inserted` is nothing, equal edits are applied each, places beyond the text are its end; rows of one id are edited each."""
    ranks, pattern = queries.tokenizer_path("byte_bpe_50k.tiktoken"), queries.pretokens()
    docs = spark.createDataFrame([(1, "one two three four"), (1, "other text"), (2, None), (None, "no id")], "doc_id long, text string")
    rows = [(1, None, None, None, "A "), (1, None, None, None, "A "), (1, 2, None, 4, None), (2, 1, 5, 3, None), (2, 2, 9, None, "end"), (None, 1, 0, 0, "x"), (7, 1, 0, 0, "x")]
    edits = spark.createDataFrame(rows, "doc_id long, edit_no int, start long, removed long, inserted string")
    got = sorted((r.doc_id, r.text, r.new_chars, r.new_tokens) for r in token_counts.apply(token_counts.index(docs, ranks, pattern), edits, ranks, pattern).collect())
    counter = token_counts.Counter(ranks, pattern)
    want = [(1, "one two three four"), (1, "other text"), (2, "end")]
    assert got == [(i, t, len(t), len(counter.encode(t))) for i, t in want]


def test_vectors_with_clashing_columns(spark):
    """Other columns of the vectors, whatever their names, change no score."""
    given = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(1, 9)], "vec_id long, embedding array<float>")
    clashing = given.select(*[F.lit(n).alias(n) for n in ("v", "x", "score", "rank", "query_id", "slot", "block", "ids")], "*")
    best = lambda d: sorted(map(tuple, maxscore.search(maxscore.quantized(d), maxscore.quantized(d).where("vec_id % 4 = 0"), 3).collect()))
    assert len(best(given)) == 6 and best(clashing) == best(given)
