"""Suffix-array dedup: bytes covered by a long string that starts anywhere else in the corpus are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells, map_batches, slices, small, stage
from .shingles import text_buffers
from .suffix_array import equal_groups, suffix_array
from .windows import Hashed, segments

#: Offsets of a piece; what its strings have in common is one symbol when its suffixes are sorted.
WIDTH = 16
#: Different segments of one key that a task sorts together; in a larger group strings are counted by what they have beside their piece's core.
GROUP = 1024
#: Rows whose pieces are sorted at once, and symbols of a suffix array.
PACK, SYMBOLS = 2000, 60_000
#: Texts with spans or segments, and these (48 bytes each at most), that may be broadcast; beyond that they meet by a shuffle.
BROADCAST_TEXTS = 3_000_000
#: Bytes of two copies of a text that are compared at once.
CHUNK = 1 << 19


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes that stand for the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(29), text).alias("t2"))


def routed(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, t1, t2, loc, v, sh): every segment of every text with its key and the hash of its bytes.
    loc packs start, anchor and length; a segment holds at most length - GRAM + 1 strings, under 1,024 for lengths to 1,000."""
    chosen = docs.where(F.octet_length("text") >= length).select("doc_id", "t1", "t2", "text")
    kind = dict(chosen.dtypes)["doc_id"]

    def run(batches):
        for batch in slices(batches, 1024):
            for text, start, end, anchor, v, sh in segments(*text_buffers(batch.column(3)), length):
                at = pa.array(text)
                loc = (start << 20) | (anchor << 10) | (end - start - length)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(loc), pa.array(v), pa.array(sh)], ["doc_id", "t1", "t2", "loc", "v", "sh"])

    return map_batches(chosen, run, f"doc_id {kind}, t1 long, t2 long, loc long, v long, sh long")


def with_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """t1, t2, text, segs: the texts that hold chosen segments, with these."""
    by_text = stage(chosen.groupBy("doc_id", "t1", "t2").agg(F.collect_list(F.struct("loc", "v", "sh", "m")).alias("segs")), "wanted")
    wanted = by_text.withColumnsRenamed({"doc_id": "_id", "t1": "_t1", "t2": "_t2"})
    joined = docs.join(small(wanted, cells(wanted, "segs"), BROADCAST_TEXTS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")))
    return joined.select("t1", "t2", "text", "segs")


def cut_segments(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(v, sh, t1, t2, at, off, m, bytes): the bytes of the chosen segments, at the text position and off the distance of their anchor."""
    names = ["v", "sh", "t1", "t2", "at", "off", "m", "bytes"]

    def run(batches):
        for batch in slices(batches):
            rows = []
            for t1, t2, text, segs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = text.encode()
                for s in segs:
                    start, off, more = s["loc"] >> 20, (s["loc"] >> 10) & 1023, s["loc"] & 1023
                    rows.append((s["v"], s["sh"], t1, t2, start + off, off, s["m"], raw[start : start + length + more]))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names)

    return map_batches(with_texts(docs, chosen), run, "v long, sh long, t1 long, t2 long, at long, off long, m long, bytes binary")


def edges(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(k1, k2, hi, lo, around, t1, t2, first, m): pieces of the chosen segments, without the core that all strings of a piece share.

    Key and core are in k1, k2. The piece's strings start hi to lo bytes before the core, which lies at first; around is what the
    piece has on both sides, so that a string i bytes before the core is the WIDTH - 1 bytes of around from hi - i on."""
    names = ["k1", "k2", "hi", "lo", "around", "t1", "t2", "first", "m"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    size = length - WIDTH + 1

    def run(batches):
        for batch in slices(batches):
            for t1, t2, text, segs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw, rows = text.encode(), []
                for s in segs:
                    start, off, more = s["loc"] >> 20, (s["loc"] >> 10) & 1023, s["loc"] & 1023
                    at = start + off
                    hashed = Hashed(np.frombuffer(raw, np.uint8)[start : start + length + more])
                    q = np.arange((off - more) // WIDTH, off // WIDTH + 1)
                    cores = hashed.of(off - q * WIDTH, off - q * WIDTH + size).view(np.int64).tolist()
                    for q, core in zip(q.tolist(), cores):
                        hi, lo, first = min(off - q * WIDTH, WIDTH - 1), max(off - more - q * WIDTH, 0), at - q * WIDTH
                        rows.append((s["v"] + q, core, hi, lo, raw[first - hi : first] + raw[first + size : first + size + WIDTH - 1 - lo], t1, t2, first, s["m"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return stage(map_batches(with_texts(docs, chosen), run, "k1 long, k2 long, hi int, lo int, around binary, t1 long, t2 long, first long, m long"), "edges")


def counted(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(t1, t2, start, end) of the strings in the chosen segments that occur twice or more, for keys with many segments.

    Equal pieces are one row before their strings are counted, cores that occur once are left out, and strings are counted by core
    and the bytes beside it: what a task gets of a passage doesn't grow with the number of its copies, as each task sends one row of it.
    """
    whole, core = ["k1", "k2", "hi", "lo", "around"], ["k1", "k2"]
    pieces = edges(docs, chosen, length)
    distinct = stage(pieces.groupBy(*whole).agg(F.sum("m").alias("m")), "pieces")
    twice = stage(distinct.groupBy(*core).agg(F.sum("m").alias("m")).where("m >= 2").select(*core), "cores")
    distinct = distinct.join(small(twice, twice.count()), core)
    strings = distinct.withColumn("i", F.explode(F.sequence("lo", "hi"))).withColumn("beside", F.substring("around", F.col("hi") - F.col("i") + 1, F.lit(WIDTH - 1)))
    found = stage(strings.groupBy(*core, "i", "beside").agg(F.sum("m").alias("times")).where("times >= 2").drop("times"), "strings")
    hits = strings.join(small(found, found.count()), [*core, "i", "beside"]).groupBy(*whole).agg(F.array_sort(F.collect_list("i")).alias("found"))
    # Runs of neighbours: their least and their greatest, in order.
    near, far = F.filter("found", lambda i: ~F.array_contains("found", i - 1)), F.filter("found", lambda i: ~F.array_contains("found", i + 1))
    hits = stage(hits.select(*whole, F.arrays_zip(near.alias("near"), far.alias("far")).alias("runs")), "hit_pieces")
    out = pieces.join(small(hits, cells(hits, "runs")), whole).select("t1", "t2", "first", F.explode("runs").alias("run"))
    return out.select("t1", "t2", (F.col("first") - F.col("run.far")).alias("start"), (F.col("first") - F.col("run.near") + length).alias("end"))


def groups(batches) -> Iterator[pa.Table]:
    """Rows sorted by key in tables of about PACK rows that never part a key."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK:
            whole = pa.Table.from_batches(held).combine_chunks()
            v = whole.column(0).to_numpy()
            other = np.flatnonzero(v != v[-1])
            held = whole.to_batches()
            if len(other):
                cut = int(other[-1]) + 1
                yield whole.slice(0, cut)
                held = whole.slice(cut).to_batches()
                n -= cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def repeated_windows(table: pa.Table, length: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, flags) for rows of a table of whole keys: which of a row's strings of the given length occur in another row of its key;
    None if another row of the key is the same as a whole. Suffix arrays decide both; hashes only bring rows and pieces together."""
    every_v, every_off, every_m = (table.column(c).to_numpy() for c in ("v", "off", "m"))
    raws = table.column("bytes").to_pylist()
    every_group = np.cumsum(np.concatenate([[True], every_v[1:] != every_v[:-1]])) - 1
    alike = equal_groups(raws, SYMBOLS)
    _, rep, back, times = np.unique(every_group * (len(raws) + 1) + alike, return_index=True, return_inverse=True, return_counts=True)
    yield from ((int(r), None) for r in np.flatnonzero(times[back] >= 2))

    raws = [raws[r] for r in rep]
    group, off, settled = every_group[rep], every_off[rep], (times >= 2) | (every_m[rep] >= 2)
    size = np.array([len(b) for b in raws])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    data = np.frombuffer(b"".join(raws), np.uint8)
    hashed = Hashed(data)
    least = off - (size - length)
    q0, q1 = least // WIDTH, off // WIDTH
    row = np.repeat(np.arange(len(off)), q1 - q0 + 1)
    q = q0[row] + np.arange(len(row)) - np.repeat(np.cumsum(q1 - q0 + 1) - (q1 - q0 + 1), q1 - q0 + 1)
    most, low = np.minimum(off[row], q * WIDTH + WIDTH - 1), np.maximum(least[row], q * WIDTH)
    anchor = begin[row] + off[row]
    core = anchor - q * WIDTH
    core_hash = hashed.of(core, core + length - WIDTH + 1)
    whole = hashed.of(anchor - most, anchor - low + length)

    order = np.lexsort((whole, low, most, core_hash, q, group[row]))
    row, q, most, low, anchor, core, core_hash, whole = (x[order] for x in (row, q, most, low, anchor, core, core_hash, whole))
    new_run = np.concatenate([[True], (group[row[1:]] != group[row[:-1]]) | (q[1:] != q[:-1]) | (core_hash[1:] != core_hash[:-1])])
    new_piece = new_run | np.concatenate([[True], (most[1:] != most[:-1]) | (low[1:] != low[:-1]) | (whole[1:] != whole[:-1])])
    run, piece = np.cumsum(new_run) - 1, np.cumsum(new_piece) - 1
    # Two of the pieces that look the same are sorted; what the array finds of them holds for the others.
    first = np.flatnonzero(new_piece)
    two = np.flatnonzero(np.arange(len(row)) - first[piece] < 2)
    open_ = np.bincount(run, weights=~settled[row])
    two = two[(np.bincount(run[two], minlength=len(open_))[run[two]] >= 2) & (open_[run[two]] > 0)]
    hit: list[np.ndarray | None] = [None] * len(first)
    for at, flags in _sorted_flags(data, two, run[two], most, low, anchor, core, length):
        p = piece[two[at]]
        hit[p] = flags if hit[p] is None else hit[p] | flags

    flags_of: dict[int, np.ndarray] = {}
    for k in np.flatnonzero(~settled[row]).tolist():
        r, flags = int(row[k]), hit[piece[k]]
        if flags is None or not flags.any():
            continue
        if r not in flags_of:
            flags_of[r] = np.zeros(size[r] - length + 1, bool)
        flags_of[r][off[r] - most[k] : off[r] - low[k] + 1] |= flags
    yield from ((int(rep[r]), flags) for r, flags in flags_of.items())


def core_symbols(data: np.ndarray, start: np.ndarray, run: np.ndarray, size: int) -> np.ndarray:
    """A number for each core: its run's where its bytes are those of the run's first one, else one of its own."""
    head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    of = start[head[np.cumsum(np.concatenate([[True], run[1:] != run[:-1]])) - 1]]
    same, span = np.ones(len(start), bool), np.arange(size)
    for at in range(0, len(start), 4096):
        part = slice(at, at + 4096)
        same[part] = (data[start[part, None] + span] == data[of[part, None] + span]).all(1)
    return np.where(same, run, run[-1] + 1 + np.arange(len(start))) if len(start) else run


def _sorted_flags(data, first, run, most, low, anchor, core, length) -> Iterator[tuple[int, np.ndarray]]:
    """Which strings of the pieces equal one of another piece of their run, by suffix arrays of some runs at a time.
    In a piece what all its strings share is one symbol, its run's; a piece ends with a symbol of its own."""
    if not len(first):
        return
    left, right = anchor[first] - most[first], anchor[first] - low[first] + length
    n_left, n_right = core[first] - left, right - (core[first] + length - WIDTH + 1)
    total = n_left + n_right + 2
    shared = core_symbols(data, core[first], run, length - WIDTH + 1)
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])), [len(run)]])
    a = 0
    while a < len(bounds) - 1:
        sums = np.cumsum(total[bounds[a] :])
        b = a + 1
        while b < len(bounds) - 1 and sums[bounds[b + 1] - 1 - bounds[a]] <= SYMBOLS:
            b += 1
        ids = range(bounds[a], bounds[b])
        symbols, spot = np.empty(int(total[bounds[a] : bounds[b]].sum()), np.int64), np.full(int(total[bounds[a] : bounds[b]].sum()), -1)
        at, places = 0, []
        for k in ids:
            f = first[k]
            x, y = int(n_left[k]), int(n_right[k])
            symbols[at : at + x] = data[left[k] : core[f]]
            symbols[at + x] = 256 + shared[k]
            symbols[at + x + 1 : at + x + 1 + y] = data[right[k] - y : right[k]]
            symbols[at + x + 1 + y] = -1 - k
            count = int(most[f] - low[f]) + 1
            spot[at : at + count] = k
            places.append((k, at, count))
            at += x + y + 2
        sa = np.array(suffix_array(symbols))
        sa = sa[spot[sa] >= 0]
        views = np.lib.stride_tricks.sliding_window_view(np.concatenate([symbols, np.full(WIDTH, -1)]), WIDTH)
        same = (views[sa[1:]] == views[sa[:-1]]).all(1)
        flags = np.zeros(len(symbols), bool)
        flags[sa[1:][same]] = flags[sa[:-1][same]] = True
        yield from ((k, flags[s : s + count]) for k, s, count in places)
        a = b


def copied_texts(docs: DataFrame, length: int) -> DataFrame:
    """(t1, t2, start, end): the whole range of each text of length bytes or more that other rows have too.

    Copies meet by the hashes of their text. Two rows of each text, those of the least and the greatest doc_id, are compared by suffix
    arrays of their words of bytes; the others hold what these two do. Rows repeated with their doc_id are one of the two."""
    long_ = docs.where(F.octet_length("text") >= length)
    ends = long_.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("n >= 2")
    ends = stage(ends.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "lo", "hi"), "copied")
    ours = F.col("doc_id").eqNullSafe(F.col("lo")) | F.col("doc_id").eqNullSafe(F.col("hi"))
    two = long_.join(small(ends, ends.count()), (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")) & ours)
    two = two.withColumn("alone", F.col("lo").eqNullSafe(F.col("hi"))).groupBy("t1", "t2", "doc_id", "alone").agg(F.first("text").alias("text"))
    two = two.select("t1", "t2", "alone", "text").repartition("t1", "t2").sortWithinPartitions("t1", "t2")

    def run(batches):
        held, seen, waiting, n = None, [], [], 0

        def decided():
            same = equal_groups([x for pair in waiting for x in pair[2]], SYMBOLS)
            differ = {pair[:2] for k, pair in enumerate(waiting) if same[2 * k] != same[2 * k + 1]}
            done = [s for s in seen if s[:2] not in differ]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([s[0] for s in done], [s[1] for s in done], [0] * len(done), [s[2] for s in done])], ["t1", "t2", "start", "end"])

        for batch in batches:
            for t1, t2, alone, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = text.encode()
                if alone:
                    seen.append((t1, t2, len(raw)))
                elif held is None or held[:2] != (t1, t2):
                    held = (t1, t2, raw)
                elif len(raw) == len(held[2]):
                    seen.append((t1, t2, len(raw)))
                    waiting += [(t1, t2, (raw[at : at + CHUNK], held[2][at : at + CHUNK])) for at in range(0, len(raw), CHUNK)]
                    n, held = n + len(raw), None
                if n > CHUNK:
                    yield from decided()
                    seen, waiting, n = [], [], 0
        if seen:
            yield from decided()

    return map_batches(two, run, "t1 long, t2 long, start long, end long")


def merged(texts: DataFrame) -> DataFrame:
    """(t1, t2, ranges) with the ranges of each text in order, those that overlap or touch as one."""

    def run(batches):
        for batch in batches:
            ranges = batch.column(2)
            sizes = pa.compute.list_value_length(ranges).to_numpy(zero_copy_only=False)
            flat = ranges.flatten()
            start, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            text = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((start, text))
            start, end, text = start[order], end[order], text[order]
            reached = np.maximum.accumulate((text << 40) + end)  # a text has under 2**40 bytes
            new = np.concatenate([[True], (text[1:] != text[:-1]) | ((text[1:] << 40) + start[1:] > reached[:-1])])[: len(text)]
            last = np.concatenate([new[1:], [True]])[: len(text)]
            ends = np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(sizes)))])
            spans = pa.StructArray.from_arrays([pa.array(start[new]), pa.array(reached[last] - (text[last] << 40))], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], ["t1", "t2", "ranges"])

    return map_batches(texts, run, "t1 long, t2 long, ranges array<struct<start:long,end:long>>")


def shared_spans(docs: DataFrame, length: int) -> DataFrame:
    """(t1, t2, ranges): for each text with something to remove, ranges that cover the strings found elsewhere.

    Copies of whole texts are settled as such. Segments at two places or more of different texts (or of one) meet by their key; of
    those that look the same two are sent with their bytes."""
    segs, place = routed(docs, length), F.xxhash64("t1", "t2", "loc")
    seen = stage(segs.groupBy("v").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("v"), "keys")
    hits = stage(segs.join(small(seen, seen.count()), "v"), "hits")
    at = F.struct("t1", "t2", "loc", "doc_id")
    distinct = stage(hits.groupBy("v", "sh").agg(F.count("*").alias("m"), F.min(at).alias("lo"), F.max(at).alias("hi")), "segments")
    hot = stage(distinct.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("v"), "hot")
    n_hot = hot.count()
    rest = distinct.join(small(hot, n_hot), "v", "left_anti") if n_hot else distinct
    twice = F.struct("lo.t1", "lo.t2", "lo.loc") != F.struct("hi.t1", "hi.t2", "hi.loc")
    # m is 1 for a segment still to be settled; copies of one text at one place are settled with that text.
    still = F.when(twice | (F.col("m") == 1), 1).otherwise(2).cast("long").alias("m")
    chosen = rest.select("v", "sh", still, "lo.*").unionByName(rest.where(twice).select("v", "sh", still, "hi.*"))
    cut = cut_segments(docs, chosen, length).repartition("v").sortWithinPartitions("v")

    def run(batches):
        for table in groups(batches):
            out: list[tuple] = []
            for r, flags in repeated_windows(table, length):
                if flags is None:
                    out.append((table["v"][r].as_py(), table["sh"][r].as_py(), None, None, None, None))
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                start = table["at"][r].as_py() - table["off"][r].as_py()
                out += [(None, None, table["t1"][r].as_py(), table["t2"][r].as_py(), start + a, start + b - 1 + length) for a, b in edge.reshape(-1, 2).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["v", "sh", "t1", "t2", "start", "end"])

    settled = stage(map_batches(cut, run, "v long, sh long, t1 long, t2 long, start long, end long"), "settled")
    ranges = settled.where("v is null").select("t1", "t2", "start", "end")
    if n_hot:
        ranges = ranges.unionByName(counted(docs, distinct.join(small(hot, n_hot), "v").select("v", "sh", "m", "lo.*"), length))
        many = distinct.where("m >= 2").join(small(hot, n_hot), "v").select("v", "sh")
    else:
        many = distinct.select("v", "sh").limit(0)
    full = stage(settled.where("v is not null").select("v", "sh").distinct().unionByName(many), "full")
    full = hits.join(small(full, full.count()), ["v", "sh"]).select("t1", "t2", "loc")
    start = F.shiftright("loc", 20)
    full = full.select("t1", "t2", start.alias("start"), (start + length + F.col("loc").bitwiseAND(1023)).alias("end"))
    every = ranges.unionByName(full).unionByName(copied_texts(docs, length))
    return stage(merged(every.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))), "spans")


def dedup_substrings(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, spans (array of (start, end) byte ranges to remove) and kept (the other bytes) of each row's whole text.

    A byte goes if a string of length bytes (32 to 1,000) that covers it also starts at another place of any row, the same
    one included; matches never cross rows. A null or shorter text keeps everything. Repeated rows are copies
    of each other like any two rows.
    """
    keys = keyed(docs)
    kind = dict(keys.dtypes)["doc_id"]
    found = shared_spans(keys, length).withColumnsRenamed({"t1": "_t1", "t2": "_t2"})
    joined = keys.join(small(found, cells(found, "ranges"), BROADCAST_TEXTS), (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")

    def run(batches):
        for batch in slices(batches):
            spans, kept, sizes = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, gone = text.encode(), [(r["start"], r["end"]) for r in ranges or ()]
                cuts = [0, *(x for ab in gone for x in ab), len(raw)]
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                sizes.append(len(raw))
            places = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, places), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return map_batches(joined.select("doc_id", "text", "ranges"), run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
