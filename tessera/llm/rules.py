"""Quality rules whose thresholds come from the data: quantile sketches of each language and source."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, map_batches, small, stage
from .texts import Words, word_groups

# The characters that count as symbols, and the base rule's numbers.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
_IS = np.zeros((4, 256), bool)
_IS[0, [32, *range(9, 14)]] = _IS[1, list(SYMBOLS)] = _IS[2, 65:91] = _IS[3, list(b"!")] = True
_STARTS = np.array([c & 0xC0 != 0x80 for c in range(256)])  # bytes that begin a character

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """A statistic that must not lie further above its group's median than reach times the spread from the median to the upper quartile,
    or slack if that is more; two-sided rules hold below the median alike."""

    name: str
    part: str
    whole: str
    slack: float
    two_sided: bool = False

    def value(self) -> Column:
        return F.try_divide(F.col(self.part), F.col(self.whole))


#: Shares that the rules look at. Slacks are what a group of which most documents have the same share still allows.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.1), Rule("dup_lines", "n_dup_lines", "n_lines", 0.5), Rule("repeats", "n_repeat_words", "n_words", 0.4),
    Rule("capitals", "n_capitals", "word_chars", 0.1), Rule("shouts", "n_shouts", "n_words", 0.1), Rule("word_length", "word_chars", "n_words", 2.0, True),
)
REACH = 8.0
#: Values a sketch keeps at its lowest level: up to so many it is exact, beyond that ranks are off by 0.3 % or so.
SKETCH_K = 1024
#: Groups of fewer documents are judged by their language.
LEAST_GROUP = 100


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends[1:]] - total[ends[:-1]]


def repeat_words(group: Words) -> np.ndarray:
    """For each text the words in windows of three words that the text has twice or more."""
    ids, bounds = group.ids, group.bounds
    if len(ids) < 3:
        return np.zeros(len(bounds) - 1, np.int64)
    most = int(ids.max()) + 1
    _, pairs = np.unique(ids[:-1] * most + ids[1:], return_inverse=True)
    _, at, n = np.unique(pairs[:-1] * most + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1  # windows over two texts are found once: no number is in two texts
    for end in bounds[1:-1]:
        again[max(0, end - 2) : end] = False
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return _sums(covered, bounds)


def count_group(group: Words) -> list[np.ndarray]:
    """The COUNTS of each text of a group."""
    raw = np.frombuffer(b"".join(group.texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in group.texts], dtype=np.int64)])
    space, symbol, capital, shout = (_sums(_IS[k][raw], ends) for k in range(4))
    lines = [[line for line in t.split(b"\n") if line.strip()] for t in group.texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    different = np.array([len(set(x)) for x in lines], np.int64)
    return [np.diff(group.bounds), _sums(_STARTS[raw], ends) - space, symbol, n_lines - different, repeat_words(group), n_lines, capital, shout]


def rule_counts(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep's columns and the COUNTS of every whole text; a null text counts 0 everywhere."""

    def run(batches):
        for group in word_groups(batches):
            columns = [*(group.rows.column(c) for c in keep), *map(pa.array, count_group(group))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *COUNTS])

    kinds = dict(docs.select(*keep).dtypes)
    return map_batches(docs.select(*keep, "text"), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def thresholds(counts: DataFrame, rules: tuple[Rule, ...] = RULES, reach: float = REACH, least_group: int = LEAST_GROUP, k: int = SKETCH_K) -> DataFrame:
    """Staged (_lang, _source, n, and low and high of each rule) for every group of documents that pass the base rule.

    Each group's statistics go into one sketch a rule, merged on their way by aggregation. The sketches of a language are those of its
    groups merged. A group of fewer than least_group documents has its language's quantiles.
    """
    sketches = [F.kll_sketch_agg_double(r.value(), F.lit(k)).alias(r.name) for r in rules]
    groups = stage(counts.where(~base_failed()).groupBy("lang", "source").agg(F.count("*").alias("n"), *sketches), "sketches")
    merged = groups.groupBy(F.col("lang").alias("_l")).agg(*(F.kll_merge_agg_double(r.name, F.lit(k)).alias(f"_{r.name}") for r in rules))
    both = groups.join(merged, F.col("lang").eqNullSafe(F.col("_l")))

    def bounds(r: Rule) -> list[Column]:
        sketch = F.when(F.col("n") >= least_group, F.col(r.name)).otherwise(F.col(f"_{r.name}"))
        q = F.kll_sketch_get_quantile_double(sketch, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        high = q[1] + F.greatest(F.lit(r.slack), F.lit(reach) * (q[2] - q[1]))
        low = q[1] - F.greatest(F.lit(r.slack), F.lit(reach) * (q[1] - q[0])) if r.two_sided else F.lit(None).cast("double")
        return [low.alias(f"{r.name}_low"), high.alias(f"{r.name}_high")]

    return stage(both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("n").alias("group_docs"), *(c for r in rules for c in bounds(r))), "thresholds")


def apply_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), rules: tuple[Rule, ...] = RULES, reach: float = REACH, least_group: int = LEAST_GROUP, k: int = SKETCH_K) -> DataFrame:
    """keep's columns, the COUNTS, base_failed, failed (names of the rules that a document breaks) and kept.

    kept is false if the base rule fails (under LEAST_WORDS words, or over REPEAT_PERCENT percent of them in repeated windows of three),
    else whether no rule of the document's group is broken. Null and empty texts have no words and fail; a null lang or source is a group
    of its own; repeated rows count each and are treated alike; an empty table gives none. Sketches of up to k documents are exact; of
    larger groups two runs may differ where a document lies within a sketch's error of a threshold.
    """
    counts = stage(rule_counts(docs, tuple(dict.fromkeys([*keep, "lang", "source"]))), "rule_counts")
    limits = thresholds(counts, rules, reach, least_group, k)
    joined = counts.join(small(limits, limits.count()), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    broken = lambda r: (r.value() > F.col(f"{r.name}_high")) | F.coalesce(r.value() < F.col(f"{r.name}_low"), F.lit(False))
    failed = F.array_compact(F.array(*(F.when(F.coalesce(broken(r), F.lit(False)), F.lit(r.name)) for r in rules)))
    out = joined.withColumn("base_failed", base_failed()).withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select(*keep, *COUNTS, "base_failed", "failed", "kept")
