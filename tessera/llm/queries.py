"""Queries op1 to op13 over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .common import words_pattern
from .cover_tree import near_duplicate_vectors
from .divergence import audit_sources
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .mix import mix_sources
from .ngram_join import near_duplicates
from .periodic import collapse_runs, longest_run, run_lines
from .pii import find_pii, span_string
from .quality import fit_quality, held_out, predicted, score_quality
from .rules import apply_rules
from .sentencepiece_codec import decode_documents, encode_documents

from .suffix_dedup import dedup_substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    left = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut may part a character
    digest = ["doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    return out.select(*digest, left.alias("text"), F.length(left).cast("long").alias("n_chars"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted().alias("predicted"))


def op5_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, counted and hashed, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    encoded = encode_documents(docs, ("doc_id", "sha"))
    digest = encoded.withColumns({"n_ids": F.size("ids").cast("long"), "ids_hash": F.xxhash64("ids")})
    decoded = decode_documents(digest, ("doc_id", "sha", "n_ids", "ids_hash"))
    return decoded.select("doc_id", "n_ids", "ids_hash", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).eqNullSafe(F.col("sha")).alias("exact"))


def op8_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(span_string(F.col("base")), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def planted_vectors(vectors: DataFrame) -> DataFrame:
    """Three rows for each vector: itself, and two with noise in opposite directions, which link with it (cosine about 0.98) and hardly
    ever with each other (about 0.91), so that components need more than direct links."""
    noise = lambda side: F.transform("embedding", lambda x, i: x.cast("double") * (1 + side * 0.3 * F.sin((F.col("vec_id") + 7 * i).cast("double"))))
    copies = F.array(*(F.struct((3 * F.col("vec_id") + k).alias("vec_id"), noise(side).alias("embedding")) for k, side in enumerate((0, 1, -1))))
    return vectors.select("label", F.explode(copies).alias("v")).select("v.vec_id", "v.embedding", "label")


def planted_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over vectors with planted copies: the test tables' own hold no link."""
    return near_duplicate_vectors(planted_vectors(table(spark, sf_dir, "embeddings")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as op11 reads them: where a tenth of the hash of doc_id says so, words repeat from a word on with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(words_pattern()), F.lit(0))
    n, g = F.size("ws"), F.floor(F.col("h") / 10)
    hit = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("ws"))
    hit = hit.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", F.when(n > 0, (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")))
    again = F.transform("ws", lambda w, i: F.when(i >= F.col("a"), F.get("ws", F.col("a") + (i - F.col("a")) % F.col("p"))).otherwise(w))
    return hit.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse_runs(planted_runs(table(spark, sf_dir, "documents"))).withColumn("best", longest_run(F.col("runs")))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    digest = [F.sha2(run_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")]
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli, *digest, "n_words")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_scan_licenses": op5_scan_licenses,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_find_pii": op8_find_pii,
    "op9_embedding_dedup": op9_embedding_dedup,
    "planted_embedding_dedup": planted_embedding_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_quality_rules": op13_quality_rules,
}

#: The words of documents in place, one a row.
WORDS_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),"""

#: Statistics that op13's thresholds are made of: name, share, slack, whether low values break the rule too.
RULE_SQL = [
    ("symbols", "n_symbols / n_words", 0.1, False), ("dup_lines", "n_dup_lines / n_lines", 0.5, False), ("repeats", "n_repeat_words / n_words", 0.4, False),
    ("capitals", "n_capitals / word_chars", 0.1, False), ("shouts", "n_shouts / n_words", 0.1, False), ("word_length", "word_chars / n_words", 2.0, True),
]

#: Links of equal label, and the components that they make.
VECTOR_LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.93),
r AS (SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE a = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id) c ON c.vec_id = e.vec_id"""

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS draw
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS size, 3 * sum(size)::BIGINT AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(cap) OVER w - cap AS c, sum(weight) OVER () - sum(weight) OVER w + weight AS free, sum(size) OVER () AS total
  FROM s WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
lam AS (SELECT c, free, total FROM o WHERE cap::DOUBLE >= ((total - c) * weight)::DOUBLE / free ORDER BY c LIMIT 1),
t AS (
  SELECT s.source, s.size AS source_size,
         least(s.cap::DOUBLE, ((lam.total - lam.c) * s.weight)::DOUBLE / lam.free::DOUBLE) AS target
  FROM s, lam),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS goal,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) AS cum
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (whole + CASE WHEN cum - size / 2 <= goal THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r""",
    "op10_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reached) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op11_periodic_runs": WORDS_SQL + r"""
t AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
h AS (
  SELECT doc_id, ws, len(ws) AS n,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                         lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS h
  FROM d, t),
g AS (SELECT *, h // 10 % greatest(n, 1) AS a, 1 + (n - h // 10 % greatest(n, 1)) // (3 + h // 10 % 8) AS p FROM h),
v AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE ws END AS ws
  FROM g),
w AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM v),
m AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS part FROM m),
c AS (SELECT doc_id, p AS period, min(i) AS start, count(*) + p AS length FROM s GROUP BY doc_id, p, part HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c q WHERE q.doc_id = c.doc_id AND q.period < c.period AND q.start <= c.start AND q.start + q.length >= c.start + c.length)),
b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best
  FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN r ON r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length),
k AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i
  WHERE gone.i IS NULL GROUP BY w.doc_id)
SELECT v.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, v.n::BIGINT AS n_words
FROM v LEFT JOIN b ON b.doc_id = v.doc_id LEFT JOIN k ON k.doc_id = v.doc_id""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
w AS (SELECT doc_id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT grp.lang, grp.source, coalesce(sum(c.n), 0)::BIGINT AS n FROM grp LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source GROUP BY ALL),
voc AS (SELECT grp.lang, coalesce(any_value(v), 0) AS v, coalesce(any_value(n), 0) AS n FROM grp LEFT JOIN (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang) x ON x.lang = grp.lang GROUP BY grp.lang),
p AS (
  SELECT tot.lang, tot.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (tot.n + 2 * v) AS p, 1 + 1000000000 * (k.n + 2) // (voc.n + 2 * v) AS q
  FROM tot JOIN voc ON voc.lang = tot.lang JOIN k ON k.lang = tot.lang LEFT JOIN c ON c.lang = tot.lang AND c.source = tot.source AND c.term = k.term),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10""",
    "op13_quality_rules": WORDS_SQL + r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
ll AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
x AS (SELECT doc_id, i, ws[i + 1 : i + 3] AS three FROM (SELECT doc_id, ws, unnest(range(len(ws) - 2)) AS i FROM d)),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM x),
z AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM y, range(3) r(k) WHERE n > 1 GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
         len(regexp_extract_all(text, '!')) AS n_shouts
  FROM d LEFT JOIN ll ON ll.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
u AS (""" + " UNION ALL ".join(f"SELECT doc_id, lang, source, '{name}' AS rule, {share} AS x, {slack}::DOUBLE AS slack, {two} AS two FROM f WHERE NOT base_failed" for name, share, slack, two in RULE_SQL) + r"""),
gq AS (SELECT lang, source, rule, count(*) AS n, quantile_disc(x, [0.25, 0.5, 0.75]) AS q FROM u GROUP BY ALL),
lq AS (SELECT lang, rule, quantile_disc(x, [0.25, 0.5, 0.75]) AS q FROM u GROUP BY ALL),
t AS (
  SELECT gq.lang, gq.source, gq.rule, CASE WHEN n >= 100 THEN gq.q ELSE lq.q END AS q
  FROM gq JOIN lq ON lq.lang IS NOT DISTINCT FROM gq.lang AND lq.rule = gq.rule),
bad AS (
  SELECT u.doc_id, u.rule FROM u JOIN t ON t.lang IS NOT DISTINCT FROM u.lang AND t.source IS NOT DISTINCT FROM u.source AND t.rule = u.rule
  WHERE x > q[2] + greatest(slack, 8.0::DOUBLE * (q[3] - q[2])) OR two AND x < q[2] - greatest(slack, 8.0::DOUBLE * (q[2] - q[1]))),
e AS (SELECT doc_id, string_agg(rule, ',' ORDER BY list_position(['symbols', 'dup_lines', 'repeats', 'capitals', 'shouts', 'word_length'], rule)) AS failed FROM bad GROUP BY doc_id)
SELECT f.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed
FROM f LEFT JOIN e ON e.doc_id = f.doc_id""",
    "op3_line_dedup": r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, text IS NULL AS void, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM t),
k AS (
  SELECT trim(line) AS line FROM l WHERE trim(line) <> ''
  GROUP BY trim(line) HAVING count(DISTINCT coalesce('s' || source, '')) >= 10),
f AS (
  SELECT l.doc_id, l.line, l.pos,
         k.line IS NOT NULL AND row_number() OVER (PARTITION BY k.line ORDER BY l.doc_id, l.pos) > 1 AS gone
  FROM l LEFT JOIN k ON trim(l.line) = k.line),
r AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id)""",
    "op9_embedding_dedup": VECTOR_LINKS_SQL,
    "planted_embedding_dedup": """
WITH RECURSIVE embeddings_planted AS (
  SELECT 3 * vec_id + k AS vec_id, label,
         list_transform(embedding::DOUBLE[], lambda x, i: x * (1 + [0, 1, -1][k + 1] * 0.3::DOUBLE * sin((vec_id + 7 * (i - 1))::DOUBLE))) AS embedding
  FROM embeddings, (VALUES (0), (1), (2)) t(k)),"""
    + VECTOR_LINKS_SQL.replace("WITH RECURSIVE", "").replace("FROM embeddings", "FROM embeddings_planted"),
}
