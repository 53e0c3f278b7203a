from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.rules import COUNTS, RULES, apply_rules, rule_counts, thresholds


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines), sum("A" <= c <= "Z" for c in text), text.count("!"))


def test_counts_equal_brute_force(spark):
    r = random.Random(9)
    some = ["".join(r.choices(["a", "b ", " a b", "\n", "é!", "|#", "A", "\t", "\x0b", " ", "a a a a"], k=r.randrange(0, 80))) for _ in range(200)]
    some += [None, "", "\n\n", "a", "a b", "a b c", "😀 " * 500, "x" * 100000]
    rows = rule_counts(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), ("doc_id",)).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in rows} == {k: brute(t) for k, t in enumerate(some)}


def prose(r, n, mark=0.0):
    return " ".join(f"{r.randrange(5000)}" + ("#" if r.random() < mark else "") for _ in range(n))


def test_thresholds_follow_the_group(spark):
    """A source whose documents all carry many symbols keeps them; the same document elsewhere goes. Small sources follow their language."""
    r = random.Random(1)
    rows = [(f"code{k}", "en", "code", prose(r, 100, 0.6)) for k in range(110)] + [(f"news{k}", "en", "news", prose(r, 100)) for k in range(500)]
    rows += [("odd", "en", "news", prose(r, 100, 0.6)), ("small", "en", "tiny", prose(r, 100, 0.6)), ("short", "en", "news", "a b c"), ("twice", "en", "news", "a b c d e f " * 20)]
    out = {x["doc_id"]: x for x in apply_rules(spark.createDataFrame(rows, "doc_id string, lang string, source string, text string")).collect()}
    assert all(x["kept"] for k, x in out.items() if k.startswith(("code", "news")))
    assert out["odd"]["failed"] == ["symbols"] and not out["odd"]["kept"] and out["small"]["failed"] == ["symbols"]
    assert out["short"]["base_failed"] and out["twice"]["base_failed"] and not out["short"]["kept"]


def test_sketches_are_near_exact_quantiles(spark):
    """Beyond what a sketch holds whole, merged sketches of groups still give ranks within a percent."""
    names = {"lang": F.lit("en"), "source": (F.col("id") % 300).cast("string"), "n_words": F.lit(1000), "n_repeat_words": F.lit(0), "n_symbols": F.col("id") % 1000, "n_lines": F.lit(1)}
    counts = spark.range(60000).withColumns(names).withColumns({c: F.lit(0) for c in COUNTS if c not in names} | {"word_chars": F.lit(5000)})
    high = [x["symbols_high"] for x in thresholds(counts, RULES[:1], least_group=10**9).collect()]
    assert len(high) == 300 and max(high) - min(high) < 1e-9 and abs(high[0] - (0.4995 + 8 * 0.25)) < 0.05


def test_odd_rows(spark, odd_docs, no_docs):
    rows = apply_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    assert apply_rules(no_docs).count() == 0
