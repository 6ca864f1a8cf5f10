"""The registered queries of the operators, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, fingerprints, lines, maxscore, mixing, near_dup, packing, passages, quality, recurrent_lm, token_counts, windows, yinyang
from ._shared import table

CAPACITY = 2048
#: Target weights of the four languages' tokens in the mixture.
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers that are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for every vector whose id is divisible by 50."""
    vectors = maxscore.quantized(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return maxscore.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's posterior of the four languages and its rate in the mixture."""
    docs = table(spark, sf_dir, "documents")
    found, domains = mixing.mixing_rates(docs, languages(docs), LANGUAGE_WEIGHTS)
    posteriors = [F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)]
    return found.select("doc_id", F.col("n").alias("n_words"), *posteriors, "rate")


def languages(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("lang").alias("domain")).where("domain is not null")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def pretokens() -> str:
    """The pattern that the byte-level vocabularies split texts by, from the package they come in."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def edits_of(docs: DataFrame) -> DataFrame:
    """Three edits of each document, drawn by its id: 40 characters go, the first 32 come again in the middle, a line is added."""
    n = F.length("text")
    edit = lambda no, start, removed, inserted: F.struct(F.lit(no).alias("edit_no"), start.cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    drawn = F.pmod(F.xxhash64("doc_id"), (n + 1).cast("long"))
    return docs.withColumn("edits", F.array(edit(1, drawn, 40, F.lit("")), edit(2, F.floor(n / 2), 0, F.substring("text", 1, 32)), edit(3, n + 32, 0, F.lit("\nEdited in 2024."))))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits, and how many pre-tokens the edits had encoded."""
    ranks, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), pretokens()
    indexed = edits_of(token_counts.index(table(spark, sf_dir, "documents"), ranks, pattern))
    out = token_counts.apply(indexed, None, ranks, pattern)
    return out.select("doc_id", "n_tokens", "new_tokens", "new_chars", F.col("encoded").alias("pretokens_encoded"), F.md5("text").alias("new_text_md5"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document and each document whose passages it repeats (itself included): how many paragraphs, from where to where, and whether they stay."""
    found = passages.repeats(table(spark, sf_dir, "documents"))
    kept = F.expr(passages.stays())
    return found.groupBy("doc_id", "first_doc_id", kept.alias("kept")).agg(F.count(F.lit(1)).alias("paragraphs"), F.min("start").alias("first_word"), (F.max("start") + passages.WORDS).alias("end_word"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.without_repeats(docs)
    return out.select("doc_id", "chunks_removed", "lines_removed", F.length("text").cast("long").alias("chars_left"), F.md5("text").alias("text_md5"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), CAPACITY)


GRADES = 3


def ratings(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, ratings(table(spark, sf_dir, "labels")), GRADES)
    return quality.scored(docs, model, GRADES).withColumn("kept", F.col("p_best") >= quality.TAIL)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.language_model_scores(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, repeat and lose by source, in all orders of them."""
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), CAPACITY)


def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components after three rounds of k-means with 16 centroids."""
    return yinyang.clustered(yinyang.quantized(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), k=16, rounds=3)


QUERIES = {
    f.__name__: f
    for f in (
        op1_maxscore,
        op2_near_duplicates,
        op3_mixing,
        op4_fingerprints,
        op5_token_counts,
        op6_passages,
        op7_line_dedup,
        op8_packing,
        op9_quality,
        op10_language_model,
        op11_filter_audit,
        op12_windows,
        op13_yinyang,
    )
}


def _clusters(rounds: int = 3, k: int = 16) -> str:
    """SQL of op13: each round is an assignment (a) and new centroids (c)."""
    distance = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v, least.cluster, least.distance FROM (SELECT vec_id, any_value(v.v) AS v, min(struct_pack(distance := {distance}, cluster := cluster)) AS least FROM v CROSS JOIN c{i} c GROUP BY vec_id))")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a{i}) GROUP BY cluster, i)")
            parts.append(f"m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY cluster)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


ORACLES = {
    "op1_maxscore": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
""",
    "op13_yinyang": _clusters(),
    "op11_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask FROM w),
b AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN b USING (doc_id) GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a JOIN l b ON b.l <> a.l JOIN l c ON c.l NOT IN (a.l, b.l)
  JOIN l d ON d.l NOT IN (a.l, b.l, c.l) JOIN l e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
s AS (SELECT filter_order, i::INTEGER AS step, bits[i] AS own, coalesce(list_sum(bits[1 : i - 1]), 0)::INTEGER AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM o)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (before + own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM cells CROSS JOIN s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
""",
    "op7_line_dedup": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
r AS (SELECT doc_id, lines, list_transform(range(1, greatest(len(lines), 2)), lambda i: substr(md5(lines[i] || chr(10) || coalesce(lines[i + 1], '')), 1, 8)) AS roll FROM l),
s AS (SELECT doc_id, lines, list_filter(range(1, len(lines) + 1), lambda i: i = 1 OR (i < len(lines) AND roll[i] < roll[i - 1] AND (i >= len(lines) - 1 OR roll[i] <= roll[i + 1]))) AS starts FROM r),
c AS (SELECT doc_id, k, starts[k] AS a, coalesce(starts[k + 1], len(lines) + 1) - starts[k] AS n, array_to_string(lines[starts[k] : coalesce(starts[k + 1], len(lines) + 1) - 1], chr(10)) AS chunk
  FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS k FROM s)),
f AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY chunk, n >= 2 ORDER BY doc_id, a) > 1 AS gone FROM c),
o AS (SELECT doc_id, count(*) FILTER (gone) AS chunks_removed, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS lines_removed,
  coalesce(string_agg(chunk, chr(10) ORDER BY a) FILTER (NOT gone), '') AS t FROM f GROUP BY doc_id)
SELECT doc_id, chunks_removed, lines_removed, length(t) AS chars_left, md5(t) AS text_md5 FROM o
""",
    "op2_near_duplicates": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
k AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.root AS component_id, k.root = d.doc_id AS kept
FROM documents d JOIN k ON k.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
}
