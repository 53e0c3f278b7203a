"""Licence scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# Phrases (their words in a row) and the label each stands for.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
MORE = {
    "bsd license": "bsd", "isc license": "isc", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "boost software license": "bsl",
    "licensed under cc by nc": "cc-by-nc", "licensed under cc by sa": "cc-by-sa", "licensed under cc by 4": "cc-by",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# How freely a text under a licence may be used, from 0 to 1.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsl": 0.95, "apache": 0.9, "cc-by": 0.85,
    "mpl": 0.6, "epl": 0.55, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.15, "proprietary": 0.05,
}
UNKNOWN, EXCEPTION = 0.4, 0.2
#: An expression ends with its line, as the SPDX standard has it.
EXPRESSION = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"[ \t]*(?:([a-z0-9][a-z0-9.+-]*)|([()]))")
ORDER = {"or": 1, "and": 2, "with": 3}
#: A-Z becomes a-z, every other ASCII character that is no letter or digit becomes a space; other bytes stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
LOWER = {c: c + 32 for c in range(65, 91)}


def family(identifier: str) -> str:
    """The label of an SPDX identifier: its family where known, else the identifier itself."""
    name = identifier.rstrip("+")
    for label in sorted(FREEDOM, key=len, reverse=True):
        if name == label or name.startswith(label + "-"):
            return label
    return name


def parse(expression: str) -> list[str] | None:
    """Reverse Polish order of an expression by the shunting-yard method; WITH binds closest, then AND, then OR.

    Reading stops at the first character that can't go on the expression; None if what stands before it is no expression.
    """
    out: list[str] = []
    held: list[str] = []
    operand, at = True, 0
    while m := TOKEN.match(expression, at):
        token, at = m[1] or m[2], m.end()
        if token == "(":
            if not operand:
                return None
            held.append(token)
        elif token == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif token in ORDER:
            if operand:
                return None
            while held and held[-1] != "(" and ORDER[held[-1]] >= ORDER[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif not operand:
            break
        else:
            out.append(token)
            operand = False
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return None if operand else out


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels and freedom: OR lets the reader choose (the freer), AND binds to both (the stricter), WITH adds an exception."""
    rpn, stack = parse(expression), []
    if rpn is None:
        return None
    for token in rpn:
        if token in ORDER:
            (labels, free), (labels_2, free_2) = stack[-2:]
            joined = {"or": max(free, free_2), "and": min(free, free_2), "with": min(1.0, free + EXCEPTION)}[token]
            stack[-2:] = [(labels if token == "with" else labels | labels_2, joined)]
        else:
            label = family(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[0]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in {**BASE, **MORE, TAG: ""}.items():
        found.add_word(f" {phrase} ", (phrase in BASE, label, len(phrase) + 1))
    found.make_automaton()
    return found


def scan_text(text: str, find) -> tuple:
    words = text.encode("utf-8", "replace").translate(FOLD).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    base, places, first, last, labels, strict, seen, word, tag = set(), 0, None, None, set(), [], 0, 0, False
    for end, (is_base, label, back) in sorted(find.iter(line), key=lambda m: m[0] - m[1][2]):
        if is_base:
            start = end - back
            word += line.count(" ", seen, start)
            seen = start
            places, last = places + 1, word
            first = word if first is None else first
            base.add(label)
        if label:
            labels.add(label)
            strict.append(FREEDOM[label])
        tag |= not label
    if tag:
        for m in EXPRESSION.finditer(text.translate(LOWER)):
            if got := evaluate(m[1]):
                labels |= got[0]
                strict.append(got[1])
    return len(words), places, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), min(strict, default=0.0)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row's whole text.

    score is how freely the text may be used by all its notices together: the strictest one's freedom, 0 without a notice.
    A null or empty text has no words, empty labels and score 0. Each row is scanned by itself, repeated ones too.
    """
    chosen = docs.select("doc_id", "text")
    kind = dict(chosen.dtypes)["doc_id"]

    def run(batches):
        find = automaton()
        for batch in batches:
            cols = list(zip(*(scan_text(t or "", find) for t in batch.column(1).to_pylist()))) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return map_batches(chosen, run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
