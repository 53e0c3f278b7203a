"""Full-text search over clauses: an inverted index as tables, and BM25 scores as DataFrame expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import checked_limit
from ..sources.documents import fragments
from ..sources.store import FEW, materialize

#: What is a term: letters and digits, in lower case.
TERM = r"[\p{L}\p{N}]+"
#: How soon more of a term in a clause adds nothing, and how much a clause's length counts.
K1, B = 1.2, 0.75
#: Characters of a fragment that it is searched by, and hits that are looked at, when its references are looked up.
BACKFILL_CHARS, BACKFILL_HITS = 400, 5


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


@dataclass(frozen=True)
class TextIndex:
    """postings (term, node_id, tf, length, and the columns to search within), frequency (term, df) and the number and mean length of clauses."""

    postings: DataFrame
    frequency: DataFrame
    clauses: int
    mean_length: float


def build_index(clauses: DataFrame, *within: str) -> TextIndex:
    """The index of clauses (node_id, text, within ...) with a term in their text, written once: postings lie by term, so that a search reads the
    files of its terms only. Repeated node_ids are clauses of their own."""
    rows = clauses.select("node_id", *within, terms(F.col("text")).alias("_terms")).where("size(_terms) > 0")
    rows = rows.withColumn("length", F.size("_terms")).withColumn("row", F.monotonically_increasing_id())
    counted = rows.select("row", "node_id", *within, "length", F.explode("_terms").alias("term")).groupBy("row", "node_id", *within, "length", "term").agg(F.count("*").alias("tf"))
    postings = materialize(counted.drop("row").repartitionByRange("term").sortWithinPartitions("term", "node_id"), "postings")
    frequency = materialize(postings.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    n, mean = clauses.select(F.size(terms(F.col("text"))).alias("n")).where("n > 0").agg(F.count("*"), F.avg("n")).first()
    return TextIndex(postings, frequency, n or 0, mean or 0.0)


def bm25(index: TextIndex) -> Column:
    """What a posting (tf, length) of a term (df) adds to its clause's score."""
    idf = F.log1p((F.lit(index.clauses) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(index.mean_length)))


def search_text(index: TextIndex, query: str, limit: int = 10, among: DataFrame | None = None) -> DataFrame:
    """(node_id, score) of the clauses with a term of the query, best first, ties by node_id; among (node_id): only these. No term, no hit."""
    spark = index.postings.sparkSession
    asked = spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(query)))).alias("term"))  # one row of text
    hits = index.postings.join(F.broadcast(asked), "term").join(index.frequency.join(F.broadcast(asked), "term"), "term")
    if among is not None:
        hits = hits.join(among.select("node_id").distinct(), "node_id", "left_semi")
    scored = hits.groupBy("node_id").agg(F.sum(bm25(index)).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "node_id").limit(checked_limit(limit))  # rounded, as a sum depends on its order


def search_many(index: TextIndex, queries: DataFrame, within: str, limit: int = 10) -> DataFrame:
    """(query_id, node_id, score, place) of the best hits of each query (query_id, text, and a column of the index to search within): all
    queries meet the postings by term and that column in one join."""
    asked = queries.select("query_id", within, F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    hits = asked.join(index.postings, ["term", within]).join(index.frequency, "term")
    scored = hits.groupBy("query_id", "node_id").agg(F.sum(bm25(index)).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "node_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= checked_limit(limit))


def search_once(clauses: DataFrame, query: str, limit: int = 10, among: Column | None = None) -> DataFrame:
    """search_text() without an index, for one search: texts are read where they lie, once for the query's terms' frequencies and once for
    scores. A clause with a hit leaves its task as one number, and nothing is written. among: a condition on clauses; frequencies are of all."""
    spark = clauses.sparkSession
    asked = spark.range(1).select(F.array_distinct(terms(F.lit(query))).alias("t")).first()["t"]  # one row of text
    asked = F.array(*map(F.lit, asked)).cast("array<string>")
    rows = clauses.withColumn("_terms", terms(F.col("text"))).where("size(_terms) > 0").withColumn("length", F.size("_terms"))
    every = F.array(F.lit(None).cast("string"))  # stands for all clauses
    said = rows.select("length", F.explode(F.concat(F.array_intersect("_terms", asked), every)).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("total"))
    said = said.collect()  # a row a term of the query
    n, total = next(((r["df"], r["total"]) for r in said if r["term"] is None), (0, 0))
    known = spark.createDataFrame([(r["term"], r["df"]) for r in said if r["term"] is not None], "term string, df long")
    rows = rows if among is None else rows.where(among)
    tf = lambda t: F.size(F.filter("_terms", lambda x: x == t))
    each = F.transform(F.array_intersect("_terms", asked), lambda t: F.struct(t.alias("term"), tf(t).alias("tf")))
    hits = rows.select("node_id", "length", F.explode(each).alias("h")).select("node_id", "length", "h.*").join(F.broadcast(known), "term")
    scored = hits.groupBy("node_id").agg(F.sum(bm25(TextIndex(rows, known, n, total / n if n else 0.0))).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "node_id").limit(checked_limit(limit))


#: Terms of a text that a task of search_within() holds, about: its tables of them stay in memory.
TASK_TERMS = 1_000_000


def search_within(clauses: DataFrame, queries: DataFrame, within: str, limit: int = 10, few: int = FEW, task_terms: int = TASK_TERMS) -> DataFrame:
    """search_many() without an index, for queries that each look into one value of within, such as their document. Texts are shuffled once,
    by that value, to tasks of a bounded number of terms; terms, hits and ranks are made where they then lie.

    Frequencies of the few most frequent terms are broadcast. A vocabulary grows with its texts, and what is beyond them is rare: each value of within gets
    a table of its own rare terms, so that no other posting is shuffled by its term.
    """
    rows = clauses.select("node_id", within, terms(F.col("text")).alias("_terms")).where("size(_terms) > 0")
    n, mean = rows.agg(F.count("*"), F.avg(F.size("_terms"))).first()
    distinct = rows.select(within, F.explode(F.array_distinct("_terms")).alias("term"))
    frequency = materialize(distinct.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    cut = frequent_from(frequency, few)
    frequent = F.broadcast(frequency.where(F.col("df") >= cut))
    index = TextIndex(rows, frequency, n or 0, mean or 0.0)
    both = clauses.select(within, F.lit(False).alias("asks"), F.col("node_id").alias("id"), "text").unionByName(queries.select(within, F.lit(True).alias("asks"), F.col("query_id").alias("id"), "text"))
    both = both.where(f"{within} is not null").repartition(1 + int((n or 0) * (mean or 0.0)) // task_terms, within)
    if cut > 1:
        rare = distinct.where(f"{within} is not null").join(frequency.where(F.col("df") >= cut).select("term").hint("broadcast"), "term", "left_anti")
        rare = rare.join(frequency.where(F.col("df") < cut), "term").groupBy(within).agg(F.map_from_entries(F.collect_set(F.struct("term", "df"))).alias("_rare"))
        both = both.join(rare.hint("shuffle_hash"), within, "left")
    else:
        both = both.withColumn("_rare", F.lit(None).cast("map<string,bigint>"))
    both = both.withColumns({"row": F.monotonically_increasing_id(), "_terms": terms(F.col("text"))})
    each = both.select(within, "asks", "id", "row", F.size("_terms").alias("length"), "_rare", F.explode("_terms").alias("term"))
    posted = each.groupBy(within, "asks", "id", "row", "length", "term").agg(F.count("*").alias("tf"), F.first(F.try_element_at("_rare", "term")).alias("_df"))
    posted = posted.join(frequent, "term", "left").withColumn("df", F.coalesce("df", "_df")).where("df is not null")
    side = lambda asks, *columns: F.collect_list(F.when(F.col("asks") == asks, F.struct(*columns)))
    met = posted.withColumn("w", bm25(index)).groupBy(within, "term").agg(side(True, "id").alias("q"), side(False, "id", "w").alias("p"))
    hits = met.where("size(q) > 0 and size(p) > 0").select(within, F.explode("q").alias("q"), "p").select(within, F.col("q.id").alias("query_id"), F.explode("p").alias("p"))
    scored = hits.groupBy(within, "query_id", F.col("p.id").alias("node_id")).agg(F.sum("p.w").alias("score"))
    order = W.partitionBy(within, "query_id").orderBy(F.desc(F.round("score", 9)), "node_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= checked_limit(limit)).drop(within)


def frequent_from(frequency: DataFrame, few: int) -> int:
    """The least df from which on there are at most few terms; 1 if there are no more in all."""
    counts = frequency.groupBy("df").count()  # as many rows as there are different frequencies
    down = counts.withColumn("above", F.sum("count").over(W.orderBy(F.desc("df"))))
    beyond = down.agg(F.max(F.when(F.col("above") > few, F.col("df")))).first()[0]
    return 1 if beyond is None else beyond + 1


def backfill_references(details: DataFrame, indexed: DataFrame, hits: int = BACKFILL_HITS) -> DataFrame:
    """(src, reference fields) for fragments of library documents that have a text and name no references: what a search index
    (node_id, doc_id, text, references) knows of them. A fragment is searched by its first characters within its document, and counts as
    found if it is among the first hits itself."""
    bare = fragments(details).where("user_id is null and (fragment.references is null or size(fragment.references) = 0) and trim(fragment.text) <> ''")
    queries = bare.select(F.col("fragment.id").alias("query_id"), "doc_id", F.substring("fragment.text", 1, BACKFILL_CHARS).alias("text"))
    found = search_within(indexed, queries, "doc_id", hits).where("query_id = node_id").select("node_id")
    return indexed.join(found.distinct(), "node_id", "left_semi").select(F.col("node_id").alias("src"), F.explode("references").alias("_r")).select("src", "_r.*")
