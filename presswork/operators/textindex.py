"""A positional inverted index and web searches on it.

A posting says where a term stands in a field of a document; positions count
all words, those that are no terms too, so phrases keep their gaps. A search
reads the postings of its own terms alone: `written` clusters the table by
term, so a scan skips the rest. Null fields have no postings. Rows with one id
are one document to a search, and each keeps its postings; rows without an id
are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stems import STOP_WORDS, stem
from ..functions.text import parse_search

WORD = re.compile("[a-z0-9]+")
POSTINGS = "term string, id long, field string, positions array<int>, n int"
#: what a hit in a field of each class is worth
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def postings(docs: DataFrame, id_: str, fields: list[str], english: bool = True) -> DataFrame:
    """POSTINGS of text fields of docs; english leaves stop words out and takes stems, else words are terms as they are."""

    def index(batches):
        import pyarrow as pa

        names, types = [c.split()[0] for c in POSTINGS.split(", ")], (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int32())
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):  # documents at a time
                out: list[list] = [[] for _ in names]
                for k, field in enumerate(fields, 1):
                    for id_value, text in zip(ids[at : at + 256], batch.column(k).slice(at, 256).to_pylist()):
                        if text is None:
                            continue
                        places: dict[str, list[int]] = {}
                        for n, word in enumerate(WORD.findall(text.lower())):
                            if not english:
                                places.setdefault(word, []).append(n)
                            elif word not in STOP_WORDS:
                                places.setdefault(stem(word), []).append(n)
                        for term, where in places.items():
                            for column, value in zip(out, (term, id_value, field, where, len(where))):
                                column.append(value)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    given = docs.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), *[F.col(f).cast("string").alias(f) for f in fields])
    return given.mapInArrow(index, POSTINGS)


def written(postings_: DataFrame, folder: str) -> DataFrame:
    """The index as a table clustered by term and id; ranges of both, so a frequent term is dealt over several."""
    postings_.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(folder)
    return postings_.sparkSession.read.parquet(folder)


def terms_of(words: list[str], english: bool = True) -> list[tuple[str, int]]:
    """Terms of a phrase with their distance from its first word."""
    return [(stem(w) if english else w, n) for n, w in enumerate(words) if not english or w not in STOP_WORDS]


def search(index: DataFrame, text: str, english: bool = True, weights: dict[str, str] | None = None) -> DataFrame:
    """(id, rank) of the documents that meet a web search: quoted phrases, alternatives by `or`, a minus to exclude.

    weights gives fields their class (A to D, D for those it leaves out); rank
    is the sum of the worth of all hits of what is asked for. Clauses without
    terms ask for nothing; a search that asks for nothing, or excludes only,
    finds nothing.
    """
    clauses, phrases = [], {}  # of the phrases: terms to a number
    for negated, alternatives in parse_search(text):
        asked = [tuple(t) for words in alternatives if (t := terms_of(words, english))]
        if asked:
            clauses.append((negated, [phrases.setdefault(a, len(phrases)) for a in asked]))
    spark = index.sparkSession
    if not any(not negated for negated, _ in clauses):
        return spark.createDataFrame([], "id long, rank double")
    asked = [(term, number, at - p[0][1], len(p)) for p, number in phrases.items() for term, at in p]
    worth = F.lit(WEIGHTS["D"])
    for field, label in (weights or {}).items():
        worth = F.when(F.col("field") == field, WEIGHTS[label]).otherwise(worth)
    # the terms of one search are few: a condition on the scan, then their places in its phrases
    wanted = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(n).alias("phrase"), F.lit(o).alias("offset"), F.lit(k).alias("size")) for t, n, o, k in asked])
    hits = index.where(F.col("term").isin(sorted({t for t, *_ in asked}))).select("id", "field", "positions", "term", F.inline(wanted).alias("asked", "phrase", "offset", "size")).where("term = asked")
    starts = hits.select("id", "field", "phrase", "size", "offset", F.explode("positions").alias("p"))
    found = starts.groupBy("id", "field", "phrase", "size", (F.col("p") - F.col("offset")).alias("start")).agg(F.count_distinct("offset").alias("k")).where("k = size")
    by_phrase = found.groupBy("id", "phrase").agg(F.sum(worth).alias("worth"))
    by_doc = by_phrase.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("phrase", "worth"))).alias("has"))  # as many as the search has phrases
    positive = sorted({n for negated, numbers in clauses if not negated for n in numbers})
    met = F.lit(True)
    for negated, numbers in clauses:
        any_ = F.exists(F.array(*map(F.lit, numbers)), lambda n: F.map_contains_key("has", n))
        met = met & (~any_ if negated else any_)
    rank = sum((F.coalesce(F.try_element_at("has", F.lit(n)), F.lit(0.0)) for n in positive), F.lit(0.0))
    return by_doc.where(met).select("id", rank.alias("rank"))
