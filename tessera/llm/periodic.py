"""Periodic runs of words by harmonic grid probing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .texts import word_groups

#: A run has so many words at least, and so many periods.
LEAST_WORDS, PERIODS = 6, 4
#: Probes made together, and cells of a comparison.
PROBES, CELLS = 1 << 20, 1 << 18


def reach(ids: np.ndarray, at: np.ndarray, period: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from each place on (step 1) or back (-1) equal those a period later, limit at most: by chunks that double
    while few places are left."""
    out = np.zeros(len(at), np.int64)
    live, size = np.flatnonzero(limit > 0), 16
    while len(live):
        width = max(16, min(size, CELLS // len(live)))
        t = out[live][:, None] + np.arange(width)
        top = limit[live][:, None]
        i = at[live][:, None] + step * np.minimum(t, top - 1)
        same = (ids[i] == ids[i + period[live][:, None]]) & (t < top)
        met = np.where(same.all(1), width, same.argmin(1))
        out[live] += met
        live, size = live[met == width], size * 2
    return out


def grids(bounds: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, probes) of the periods from low to twice that which a text may have, a bounded number of probes at a time."""
    n = np.diff(bounds)
    text = np.flatnonzero(n >= PERIODS * low)
    many = np.minimum(n[text] // PERIODS, 2 * low - 1) - low + 1
    text = np.repeat(text, many)
    first = np.cumsum(many) - many
    period = low + np.arange(len(text)) - np.repeat(first, many)
    probes = (n[text] - 1) // period
    upto, at = np.cumsum(probes), 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PROBES, "right")))
        yield text[at:end], period[at:end], probes[at:end]
        at = end


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, length, period) rows, by start and then period, of all runs in texts of numbered words; starts count from the first text's.

    A run of period p with PERIODS periods holds three places jp, (j+1)p, (j+2)p whose words equal those p later, so for each period only
    multiples of it are probed: n log n probes. Survivors are extended both ways. A place whose next two periods lie in a run of a
    smaller period is skipped: what holds both has that smaller period. Periods go up by octaves, as a divisor is half as large at most.
    """
    found = np.zeros((0, 3), np.int64)
    longest = int(np.diff(bounds).max(initial=0))
    low = 1
    while PERIODS * low <= longest:
        new = [found]
        by_start = found[np.argsort(found[:, 0], kind="stable")]
        ends = np.maximum.accumulate(by_start[:, 0] + by_start[:, 1]) if len(found) else np.zeros(0, np.int64)
        for text, period, probes in grids(bounds, low):
            first = np.cumsum(probes) - probes
            pair = np.repeat(np.arange(len(text)), probes)
            place = bounds[text][pair] + (np.arange(len(pair)) - first[pair]) * period[pair]
            same = ids[place] == ids[place + period[pair]]
            hit = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
            hit = hit[pair[hit] == pair[hit + 2]]
            place, p = place[hit], period[pair[hit]]
            if len(found) and len(hit):
                before = np.searchsorted(by_start[:, 0], place, "right") - 1
                free = (before < 0) | (ends[np.maximum(before, 0)] < place + 2 * p)
                hit, place, p = hit[free], place[free], p[free]
            if not len(hit):
                continue
            start, end = bounds[text][pair[hit]], bounds[text + 1][pair[hit]]
            head = np.flatnonzero(np.diff(hit, prepend=-9) != 1)  # of consecutive places only the first of each stretch is extended
            last = np.append(head[1:], len(hit)) - 1
            while len(head):
                ahead = reach(ids, place[head], p[head], end[head] - p[head] - place[head], 1)
                far = ahead > 2 * p[head]
                k = head[far]
                behind = reach(ids, place[k] - 1, p[k], np.minimum(p[k], place[k] - start[k]), -1)
                length = behind + ahead[far] + p[k]
                good = (length >= np.maximum(LEAST_WORDS, PERIODS * p[k])) & (behind < p[k])  # a whole period back lies a place that was skipped
                new.append(np.stack([place[k] - behind, length, p[k]], 1)[good])
                head = head + ahead // p[head] + 1
                more = head <= last
                head, last = head[more], last[more]
        found = np.concatenate(new)
        low *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapse_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, n_words, runs (start, length, period of each, by start and then period) and text: the words, joined by one
    space, without those that a run holds after its first period.

    A run is a stretch of words of smallest period q, of LEAST_WORDS words and PERIODS periods at least, that no word beside it extends. A
    null or empty text has no words and no runs and an empty text. Each row is looked at by itself, so repeated rows give equal results; a
    task holds the words of one text, or of some short ones.
    """

    def run(batches):
        for group in word_groups(batches):
            bounds = group.bounds
            found = runs_of(group.ids, bounds)
            gone = np.zeros(bounds[-1] + 1, np.int64)
            np.add.at(gone, found[:, 0] + found[:, 2], 1)
            np.add.at(gone, found[:, 0] + found[:, 1], -1)
            stay = np.cumsum(gone[:-1]) == 0
            whole = np.add.reduceat(np.append(~stay, False), np.minimum(bounds[:-1], bounds[-1])) == 0 if bounds[-1] else np.ones(len(bounds) - 1, bool)
            texts = [b" ".join(w if all_ else compress(w, stay[a:b])) for w, all_, a, b in zip(group.lists, whole, bounds, bounds[1:])]
            cuts = np.searchsorted(found[:, 0], bounds).astype(np.int32)
            start = found[:, 0] - np.repeat(bounds[:-1], np.diff(cuts))
            rows = pa.StructArray.from_arrays([pa.array(start), pa.array(found[:, 1]), pa.array(found[:, 2])], ["start", "length", "period"])
            columns = [*(group.rows.column(c) for c in keep), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(cuts), rows), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_words", "runs", "text"])

    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words long, runs array<struct<start:long,length:long,period:long>>, text string"])
    return map_batches(docs.select(*keep, "text"), run, schema)


def longest_run(runs: Column) -> Column:
    """(length, start, period) of the longest run, of equal ones the first, then that of the smallest period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(best.isNotNull(), F.struct(best["length"].alias("length"), (-best["s"]).alias("start"), (-best["p"]).alias("period")))


def run_lines(runs: Column) -> Column:
    """Each run's start, length and period on a line of its own."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
