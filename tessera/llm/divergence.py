"""Source divergence audit: how far the term shares of a language's sources lie apart, by dense tiles of sources and terms."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_staged, map_batches, small, stage
from .texts import TOGETHER

#: A kept term is in so many documents of its language at least; shares are in billionths.
LEAST_DOCS, SCALE_STEPS = 10, (1000, 1000, 1000)
#: Terms of a tile and sources on each side of it, on average; cells of a broadcast; entries a task holds before it hands them on.
TERMS, SOURCES, CELLS, HELD = 512, 64, 1 << 19, 200_000
#: Bytes of a text as terms see them: A-Z lower-cased, other ASCII characters that are no letters part terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by group, added up in each task already; a group also has
    rows with a null term, whether it has terms or not. Null lang, source and text are empty."""

    def run(batches):
        n, held = defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(langs, sources, texts):
                key = lang or "", source or ""
                words = (text or b"").translate(_TERMS).split()
                n[key].update(words)
                held[key].update(set(words))
                if sum(map(len, n.values())) > HELD:
                    yield from tables(n, held)
                    n, held = defaultdict(Counter), defaultdict(Counter)
        yield from tables(n, held)

    def tables(n, held):
        for (lang, source), counts in n.items():
            terms = [None, *counts]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *counts.values()], pa.int64()), pa.array([0, *map(held[lang, source].__getitem__, counts)], pa.int64()),
            ], ["lang", "source", "term", "n", "docs"])

    return map_batches(docs.select("lang", "source", "text"), run, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """Staged (lang, source, term, n, lang_n, first): counts of the kept terms, each with its language's and whether its row stands for the
    term in the language; a null term stands for the group. One shuffle: both sums go by (lang, term), which has a row a source."""
    counts = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = W.partitionBy("lang", "term")
    with_all = counts.select("*", F.sum("docs").over(same).alias("lang_docs"), F.sum("n").over(same).alias("lang_n"), F.row_number().over(same.orderBy("source")).alias("_row"))
    kept = with_all.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs))
    return stage(kept.select("lang", "source", "term", "n", "lang_n", (F.col("term").isNotNull() & (F.col("_row") == 1)).alias("first")), "terms")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total), exactly, by long division three digits a step; count may reach total, at most 9 * 10**15."""
    total = np.maximum(total, 1)
    out, rest = np.divmod(count, total)
    for step in SCALE_STEPS:
        digit, rest = np.divmod(rest * step, total)
        out = out * step + digit
    return 1 + out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


#: Rows of a tile by role: a term of the language (n its count there), a source (n its sum), a source's count of a term.
TERM, SOURCE, COUNT = 0, 1, 2


def tile(key: tuple, rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """Partial results of a tile, which is a block of terms and one or two blocks of sources of a language: the sum over its terms for
    each pair of sources, by broadcasting all pairs, and from tiles of one block the greatest terms of each source, by heaps."""
    lang, _, a, b = key
    terms, sources, counts = (rows[rows["role"] == r] for r in (TERM, SOURCE, COUNT))
    names = pd.Index(terms["term"])
    side = sources["side"].to_numpy()
    of_source = pd.Index(sources["source"])
    dense = np.zeros((len(sources), len(terms)), np.int64)
    dense[of_source.get_indexer(counts["source"]), names.get_indexer(counts["term"])] = counts["n"]
    v = int(rows["v"].iloc[0])
    p = shares(dense + 2, sources["n"].to_numpy()[:, None] + 2 * v)
    q = shares(terms["n"].to_numpy() + 2, np.int64(rows["lang_total"].iloc[0] + 2 * v))
    out = []
    label = of_source.to_numpy()
    left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
    step = max(1, CELLS // max(1, len(right) * len(terms)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        sums = gap(p[some][:, None, :], p[right][None, :, :]).sum(2)
        x, y = np.broadcast_arrays(some[:, None], right[None, :])
        other = (x != y).ravel()
        x, y, sums = x.ravel()[other], y.ravel()[other], sums.ravel()[other]
        out.append(pd.DataFrame({"source": label[x], "part": "pair", "item": label[y], "value": sums}))
        if a != b:
            out.append(pd.DataFrame({"source": label[y], "part": "pair", "item": label[x], "value": sums}))
    if a == b and len(terms):
        values = gap(p, q[None, :])
        more = (dense > 0) & (p > q[None, :])
        for k in range(len(sources)):
            best = heapq.nsmallest(top, ((-int(values[k, t]), names[t]) for t in np.flatnonzero(more[k])))
            out.append(pd.DataFrame({"source": label[k], "part": "term", "item": [t for _, t in best], "value": [-f for f, _ in best]}))
    found = pd.concat(out) if out else pd.DataFrame({"source": [], "part": [], "item": [], "value": []})
    return found.assign(lang=lang)[["lang", "source", "part", "item", "value"]].astype({"value": "int64"})


def tile_rows(kept: DataFrame, groups: DataFrame, langs: DataFrame, n_groups: int, n_langs: int) -> DataFrame:
    """Rows of all tiles. Sources and terms of a language go to blocks by their hash; a count goes to a tile for each block that its
    source's block meets, a term to all of its block of terms, a source to all that hold its block."""
    of_lang = small(langs, n_langs)
    block = F.pmod(F.xxhash64("term"), F.col("n_terms")).alias("tb")
    own = F.pmod(F.xxhash64("source"), F.col("n_sources"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["lang", "tb", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "role", "source", "side", "term", "n", "v", "lang_total"]
    none = F.lit(None).cast("string")
    cells = kept.where("term is not null").join(of_lang, "lang")
    counts = cells.select("lang", block, own.alias("side"), F.lit(COUNT).alias("role"), "source", "term", "n", "v", "lang_total", every("n_sources").alias("other")).select(*columns)
    firsts = cells.where("first").select("lang", block, F.lit(TERM).alias("role"), none.alias("source"), "term", F.col("lang_n").alias("n"), "v", "lang_total", "n_sources", every("n_sources").alias("side"))
    terms = firsts.withColumn("other", every("n_sources")).where("side <= other").select(*columns)
    named = groups.join(of_lang, "lang").select("lang", "source", F.col("total").alias("n"), own.alias("side"), F.lit(SOURCE).alias("role"), none.alias("term"), "v", "lang_total", "n_terms", every("n_sources").alias("other"))
    sources = named.withColumn("tb", every("n_terms")).select(*columns)
    return counts.unionByName(terms).unionByName(sources)


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = 10, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of docs.

    Part pair: every other source of the language, value the summed gap of the two sources' shares over the kept terms of the language,
    which are those in least_docs of its documents at least. Part term: the top terms whose share in the source exceeds the language's, by
    their gap. Shares are billionths of all kept terms, each counted twice more than it occurs; a gap is the squared difference over the
    sum, rounded down. Ranks count from 1 by falling value and rising item. All numbers are exact integers.

    Nulls in text, lang and source are empty; rows without terms still make their group, whose shares are those of no term at all; a language
    with one source has no pairs; without kept terms pairs have value 0. Repeated rows count as often as they are there. An
    empty table gives none. Other columns are ignored.
    """
    kept = kept_counts(docs, least_docs)
    groups = kept.groupBy("lang", "source").agg(F.sum(F.when(F.col("term").isNotNull(), F.col("n")).otherwise(0)).alias("total"), F.count_if("first").alias("firsts"))
    groups = stage(groups, "groups")
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("long")
    langs = groups.groupBy("lang").agg(F.sum("firsts").alias("v"), F.sum("total").alias("lang_total"), F.count("*").alias("g"))
    langs = stage(langs.select("lang", "v", "lang_total", blocks("v", terms).alias("n_terms"), blocks("g", sources).alias("n_sources")), "langs")
    rows = tile_rows(kept, groups, langs, groups.count(), langs.count())

    def partial(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return tile(key, rows, top)

    parts = stage(rows.groupBy("lang", "tb", "a", "b").applyInPandas(partial, "lang string, source string, part string, item string, value long"), "tiles")
    drop_staged(kept, groups, langs)
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    best = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")
