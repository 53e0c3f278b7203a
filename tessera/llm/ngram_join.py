"""Exact Jaccard join of word shingle sets: rare-first prefixes with length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_staged, map_batches, small, stage
from .shingles import shingle_sets

#: Slots of the table of document frequencies; it is broadcast, so its size is fixed (512 KB).
SLOTS = 1 << 16
#: Rows of a shingle's group that are compared as one block in the second round.
GROUP_BLOCK = 2048


def odd_sketch(s: np.ndarray) -> bytes:
    """Bits toggled by each hash of a set. Two sets differ in as many hashes at least as their sketches differ in bits, so a
    comparison of sketches only rules out pairs that can't be similar. Two thirds of a set's size in bits are three times what a similar pair may differ by."""
    bits = max(256, 1 << (2 * len(s) // 3).bit_length())
    times = np.bincount((s >> np.uint64(20)) & np.uint64(bits - 1), minlength=bits)
    return np.packbits((times & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(sketches: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For index pairs (x, y) the bits in which their sketches differ. The longer of two is folded: its halves meet by exclusive or."""
    length = pa.compute.binary_length(sketches).to_numpy(zero_copy_only=False).astype(np.int64)
    place, rows = np.zeros(len(length), np.int64), {}
    for b in np.unique(length).tolist():
        at = np.flatnonzero(length == b)
        place[at] = np.arange(len(at))
        rows[b] = np.frombuffer(b"".join(sketches.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1)
    out = np.zeros(len(x), np.int64)
    combos = length[x] * (1 << 32) + length[y]
    for combo in np.unique(combos).tolist():
        p, q = combo >> 32, combo & (1 << 32) - 1
        w = min(p, q) // 8
        at = np.flatnonzero(combos == combo)
        for part in np.array_split(at, max(1, len(at) * max(p, q) >> 24)):
            u, v = (np.bitwise_xor.reduce(rows[b][place[z[part]]].reshape(len(part), -1, w), 1) for b, z in ((p, x), (q, y)))
            out[part] = np.bitwise_count(u ^ v).sum(1)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """Staged: (doc_id, th, n, sig, sketch) for each row, th standing for its text, and (slot, df) rows that count, in each task,
    documents by their shingles' slot."""
    chosen = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    kind = dict(chosen.dtypes)["doc_id"]
    names = ["doc_id", "th", "n", "sig", "sketch", "slot", "df"]

    def run(batches):
        seen, none = np.zeros(SLOTS, np.int64), None
        for batch in batches:
            none = batch.column(0).slice(0, 0)
            sets = list(shingle_sets(batch.column(1)))
            for k in range(0, len(sets), 512):
                seen += np.bincount(np.concatenate(sets[k : k + 512]) & np.uint64(SLOTS - 1), minlength=SLOTS).astype(np.int64) if sets else 0
            sigs = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), sigs, pa.array([odd_sketch(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)
        slots = np.flatnonzero(seen)
        if len(slots):
            n = len(slots)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, none.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(slots, pa.int32()), pa.array(seen[slots], pa.int64())], names)

    return stage(map_batches(chosen, run, f"doc_id {kind}, th long, n long, sig binary, sketch binary, slot int, df long"), "described")


def frequencies(described: DataFrame) -> np.ndarray:
    """Documents by slot over the whole corpus; SLOTS numbers reach the driver."""
    df = np.zeros(SLOTS, np.int64)
    for slot, n in described.where("slot is not null").groupBy("slot").agg(F.sum("df")).collect():
        df[slot] = n
    return df


def prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def prefixes(docs: DataFrame, nodes: DataFrame, df: np.ndarray, percent: int) -> DataFrame:
    """(node, n, hs): the prefix of each node's set in the order of document frequency, rarest first, ties by hash."""
    rarity = docs.sparkSession.sparkContext.broadcast(df)
    chosen = docs.select("doc_id", "text").where("doc_id is not null")
    kind = dict(chosen.dtypes)["doc_id"]

    def run(batches):
        rare = rarity.value
        for batch in batches:
            flat, ends, sizes, sigs = [], [0], [], []
            for s in shingle_sets(batch.column(1)):
                order = np.argsort(rare[s & np.uint64(SLOTS - 1)], kind="stable")[: prefix_length(len(s), percent) if len(s) else 0]
                flat.append(s[order])
                ends.append(ends[-1] + len(order))
                sizes.append(len(s))
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            values = pa.array(np.concatenate(flat).view(np.int64) if flat else [], pa.int64())
            hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), hashes], ["doc_id", "sig", "n", "hs"])

    packed = map_batches(chosen, run, f"doc_id {kind}, sig binary, n long, hs array<long>")
    return packed.join(nodes.select("doc_id", "sig", "node"), ["doc_id", "sig"]).select("node", "n", "hs")


def similar_enough(n_a: np.ndarray, n_b: np.ndarray, pos_a: np.ndarray, pos_b: np.ndarray, percent: int) -> np.ndarray:
    """Length and positional filters: what may still be shared from the first common shingle on reaches the overlap that is needed."""
    n_a, n_b = n_a.astype(np.int64), n_b.astype(np.int64)
    lo, hi = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    most = np.minimum(n_a - pos_a, n_b - pos_b)
    return (lo * 100 >= hi * percent) & (most * (100 + percent) >= percent * (n_a + n_b))


def _table(batches) -> dict[str, np.ndarray] | None:
    batches = list(batches)
    if not batches or not sum(b.num_rows for b in batches):
        return None
    whole = pa.Table.from_batches(batches)
    return {c: whole.column(c).to_numpy() for c in whole.column_names}


#: Entries of one shingle in a task that are chained there, before any of them is sent; their ends go on to meet those of other tasks.
LOCAL = 64
#: Entries that a task holds to find such shingles.
HELD = 200_000
# What a row of the first round's shuffle is: an entry, the end of a chain whose entries are settled, a settled entry, a pair.
ENTRY, END, SETTLED, PAIR = range(4)
_ROUTE = ["kind", "h", "a", "b", "n", "pos"]


def _rows(kind: int, h, a, b, n, pos) -> pa.RecordBatch:
    none = lambda c: pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64())
    pos = pa.nulls(len(a), pa.int32()) if pos is None else pa.array(pos, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), none(h), none(a), none(b), pa.array(n, pa.int32()), pos], _ROUTE)


def neighbours(h: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(places k whose entry and the next one are a candidate pair, entries of its shingle by entry) of entries sorted by h, n, node."""
    same = h[1:] == h[:-1]
    k = np.flatnonzero(same)
    k = k[similar_enough(n[k], n[k + 1], pos[k], pos[k + 1], percent)]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    count = np.diff(np.concatenate([first, [len(h)]]))
    return k, np.repeat(count, count)


def exploded(prefix: DataFrame, percent: int) -> DataFrame:
    """(kind, h, a, b, n, pos): an ENTRY for each hash of each prefix (a its node). Where a task has more than LOCAL entries of one
    hash they are chained there by size: SETTLED entries and PAIRs of neighbours, and the two ENDs of the chain. So what is
    sent by hash grows with tasks, not with documents, where a hash is frequent."""

    def settle(parts: list[tuple]):
        h, node, n, pos = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        order = np.lexsort((node, n, h))
        h, node, n, pos = h[order], node[order], n[order], pos[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])  # a repeated row
        h, node, n, pos = h[fresh], node[fresh], n[fresh], pos[fresh]
        k, members = neighbours(h, node, n, pos, percent)
        many = members > LOCAL
        rest = np.flatnonzero(~many)
        for at in range(0, len(rest), 100_000):
            part = rest[at : at + 100_000]
            yield _rows(ENTRY, h[part], node[part], None, n[part], pos[part])
        if many.any():
            own = np.flatnonzero(many)
            k = k[many[k]]
            end = own[(h[own] != np.roll(h[own], 1)) | (h[own] != np.roll(h[own], -1))] if len(np.unique(h[own])) > 1 else own[[0, -1]]
            for at in range(0, len(own), 100_000):
                part = own[at : at + 100_000]
                yield _rows(SETTLED, h[part], node[part], None, n[part], pos[part])
            yield _rows(END, h[end], node[end], None, n[end], pos[end])
            for at in range(0, len(k), 100_000):
                part = k[at : at + 100_000]
                yield _rows(PAIR, None, np.minimum(node[part], node[part + 1]), np.maximum(node[part], node[part + 1]), members[part], None)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            hs = batch.column(2)
            size = pa.compute.list_value_length(hs).to_numpy(zero_copy_only=False).astype(np.int64)
            total = int(size.sum())
            if not total:
                continue
            before = np.repeat(np.cumsum(size) - size, size)
            node, n = np.repeat(batch.column(0).to_numpy(), size), np.repeat(batch.column(1).to_numpy().astype(np.int32), size)
            parts.append((hs.flatten().to_numpy(), node, n, (np.arange(total) - before).astype(np.int32)))
            held += total
            if held > HELD:
                yield from settle(parts)
                held = 0
        if parts:
            yield from settle(parts)

    return map_batches(prefix, run, "kind byte, h long, a long, b long, n int, pos int")


def chained(prefix: DataFrame, percent: int) -> DataFrame:
    """Staged. Rows with h null: candidate pairs (a, b) of neighbours by size in each shingle's group, n = nodes of that group.
    Others: the entries (h, a = node, n, pos) of groups of three and more, whose other pairs may still matter. Shingles of one
    document end here."""
    settled = F.col("kind") >= SETTLED
    dealt = exploded(prefix, percent).repartition(F.when(settled, F.xxhash64("a", "b", "h")).otherwise(F.col("h")))

    def run(batches):
        held = []
        for batch in batches:
            done = pa.compute.greater_equal(batch.column(0), SETTLED)
            through, own = batch.filter(done), batch.filter(pa.compute.invert(done))
            if through.num_rows:
                yield through.select(["h", "a", "b", "n", "pos"])
            if own.num_rows:
                held.append(own.select(["kind", "h", "a", "n", "pos"]))
        t = _table(held)
        if t is None:
            return
        order = np.lexsort((t["a"], t["n"], t["h"]))
        kind, h, node, n, pos = (t[c][order] for c in ("kind", "h", "a", "n", "pos"))
        del t, order
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])  # a repeated row
        kind, h, node, n, pos = kind[fresh], h[fresh], node[fresh], n[fresh].astype(np.int64), pos[fresh].astype(np.int64)
        k, members = neighbours(h, node, n, pos, percent)
        # A group that ends of chains belong to has more entries than come here.
        open_ = np.concatenate([[0], np.cumsum(kind == END)])
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        ends = np.repeat(np.diff(open_[np.append(first, len(h))]), np.diff(np.append(first, len(h))))
        members = np.where(ends > 0, np.maximum(members, LOCAL), members)
        pairs = np.stack([np.minimum(node[k], node[k + 1]), np.maximum(node[k], node[k + 1])], 1)
        rest = np.flatnonzero((members >= 3) & (kind == ENTRY))
        for cols in ((None, pairs[:, 0], pairs[:, 1], members[k], None), (h[rest], node[rest], None, n[rest], pos[rest])):
            m = len(cols[1])
            for at in range(0, m, 100_000):
                part = slice(at, min(m, at + 100_000))
                yield pa.RecordBatch.from_arrays([pa.nulls(part.stop - at, t_) if c is None else pa.array(c[part], t_) for c, t_ in zip(cols, _KINDS)], ["h", "a", "b", "n", "pos"])

    return stage(map_batches(dealt, run, "h long, a long, b long, n int, pos int"), "chained")


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def first_partners(chain: DataFrame) -> DataFrame:
    """Staged: for each node the partner that it meets in most groups and its least one. The first round only has to join what is
    easily joined; all other pairs are compared in the rounds after it: those of larger groups by crossing, the others by left_out."""
    pairs = chain.where("h is null").groupBy("a", "b").agg(F.count("*").alias("times"))
    best = pairs.groupBy("b").agg(F.max(F.struct("times", (-F.col("a")).alias("minus"))).alias("m"), F.min("a").alias("least"))
    return stage(best.select("b", F.explode(F.array(-F.col("m.minus"), F.col("least"))).alias("a")).select("a", "b").distinct(), "pairs")


def left_out(chain: DataFrame, tried: DataFrame, roots: DataFrame) -> DataFrame:
    """Staged: the pairs of groups of two that the first round did not try and whose ends lie in different components so far."""
    pairs = stage(chain.where("h is null and n = 2").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "untried")
    n = roots.count()
    for end in ("a", "b"):
        pairs = pairs.join(small(roots.select(F.col("node").alias(end), F.col("component_id").alias(f"root_{end}")), n), end, "left")
    return stage(pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "left_out")


def allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many hashes sets of n hashes in all may differ by."""
    return n - 2 * -(-percent * n // (100 + percent))


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Staged: the pairs whose sketches don't rule them out, before any whole set is sent."""
    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x")), "a")
    both = both.join(sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y")), "b").select("a", "b", "n_a", "n_b", "x", "y")

    def run(batches):
        for batch in batches:
            k = batch.num_rows
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            differ = sketch_distance(pa.concat_arrays([batch.column(4), batch.column(5)]), np.arange(k), np.arange(k, 2 * k))
            ok = pa.array(differ <= allowed(n, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return stage(map_batches(both, run, "a long, b long"), "plausible")


def crossing(left: DataFrame, roots: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Staged pairs (a, b) that share a prefix shingle, pass all filters and lie in different components so far.

    A shingle whose group lies in one component is done. The others' groups are cut into blocks, and each two blocks are
    compared in a task. nearest: for each node of a task only the pair with the nearest sketch.
    """
    rooted = left.join(small(roots.withColumnRenamed("node", "a"), roots.count()), "a", "left").select("h", "a", "n", "pos", F.coalesce("component_id", "a").alias("root"))
    rooted = stage(rooted, "rooted")
    split = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    split = stage(split.select("h", F.ceil(F.col("m") / GROUP_BLOCK).cast("int").alias("nb")), "split")
    blocked = rooted.join(small(split, split.count()), "h").withColumn("block", F.pmod(F.xxhash64("a"), F.col("nb")).cast("int"))
    blocked = blocked.join(sketches.select(F.col("node").alias("a"), "sketch"), "a")
    # A row meets each block once; in a pair of two blocks only rows across are compared.
    dealt = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", "n", "pos", "root", "sketch")

    def fitting(t: dict, nodes: np.ndarray, at: np.ndarray, found: list[np.ndarray]):
        """Distinct pairs whose sketches don't differ by more than similar sets may."""
        pairs = np.unique(np.concatenate(found), axis=0)
        n = t["n"][at].astype(np.int64)
        n = n[pairs[:, 0]] + n[pairs[:, 1]]
        differ = sketch_distance(t["sketch"].take(pa.array(at)), pairs[:, 0], pairs[:, 1])
        fit = differ <= allowed(n, percent)
        pairs, differ = pairs[fit], differ[fit]
        if nearest and len(pairs):
            order = np.lexsort((pairs[:, 1], differ, pairs[:, 0]))
            pairs = pairs[order]
            pairs = pairs[np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])]
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], ["a", "b"])

    def run(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        whole = pa.Table.from_batches(batches).combine_chunks()
        t = {c: whole.column(c).to_numpy() for c in whole.column_names if c != "sketch"}
        order = np.lexsort((t["a"], t["root"], t["j"], t["i"], t["h"]))
        t = {c: v[order] for c, v in t.items()}
        t["sketch"] = whole.column("sketch").combine_chunks().take(pa.array(order))
        nodes, at, node = np.unique(t["a"], return_index=True, return_inverse=True)
        new = np.concatenate([[True], (np.diff(t["h"]) != 0) | (np.diff(t["i"]) != 0) | (np.diff(t["j"]) != 0)])
        end = np.append(np.flatnonzero(new)[1:], len(new))[np.cumsum(new) - 1]
        own = new | np.concatenate([[True], t["root"][1:] != t["root"][:-1]])
        y = np.append(np.flatnonzero(own)[1:], len(own))[np.cumsum(own) - 1]  # the first row of the next component
        x = np.arange(len(y))
        found, n = [], 0
        while len(x):
            open_ = y < end[x]
            x, y = x[open_], y[open_]
            ok = ((t["i"][x] == t["j"][x]) | (t["block"][x] != t["block"][y])) & similar_enough(t["n"][x], t["n"][y], t["pos"][x], t["pos"][y], percent)
            p, q = node[x[ok]], node[y[ok]]
            found.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1))
            n += len(p)
            if n > 1_000_000:
                yield from fitting(t, nodes, at, found)
                found, n = [], 0
            y = y + 1
        if n:
            yield from fitting(t, nodes, at, found)

    return stage(map_batches(dealt.repartition("h", "i", "j"), run, "a long, b long").distinct(), "crossing")


def suffix_bound(x: np.ndarray, y: np.ndarray, allowed: int, depth: int = 3) -> bool:
    """Suffix filter: cut both sorted sets at y's middle hash; the halves' differences in size bound how much the sets differ."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y)) <= allowed
    w = y[len(y) // 2]
    i, j = int(np.searchsorted(x, w)), len(y) // 2
    left, right = abs(i - j), abs((len(x) - i) - (len(y) - j))
    return left + right <= allowed and suffix_bound(x[:i], y[:j], allowed - right, depth - 1) and suffix_bound(x[i:], y[j:], allowed - left, depth - 1)


def is_similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y| for sorted distinct hashes."""
    need = -(-percent * (len(x) + len(y)) // (100 + percent))
    if not suffix_bound(x, y, int(allowed(len(x) + len(y), percent))):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) >= need


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Staged: those of the distinct pairs whose whole sets are similar. Sets are made for documents in a pair only."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    needed = stage(nodes.join(ends, "node").select("node", "doc_id", "sig"), "needed")
    chosen = docs.select("doc_id", "text").join(small(needed, needed.count()), "doc_id").select("node", "sig", "text")

    def make(batches):
        for batch in batches:
            keep, sets = [], []
            for k, (s, sig) in enumerate(zip(shingle_sets(batch.column(2)), batch.column(1).to_pylist())):
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == sig:
                    keep.append(k)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], ["node", "hs"])

    sets = stage(map_batches(chosen, make, "node long, hs binary"), "sets").dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hs").alias("y")), "b").select("a", "b", "x", "y")

    def check(batches):
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            ok = [is_similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return stage(map_batches(both, check, "a long, b long"), "edges")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, kept of each row of docs: documents link when 100 * shared shingles >= percent *
    all shingles.

    Equal sets are one node. Round one compares neighbours by size in each prefix shingle's group, which joins most of a large
    group of near copies by a pair or two each; round two the pairs of groups of two that round one left out and the nearest
    pairs between different components, and round three all pairs left between different components, so that components are
    those of the full join. No round verifies a pair that an earlier one did. A row without words has 0 shingles and its own doc_id; a row with a null
    doc_id links with nothing and has a null component; rows with one doc_id but different texts are nodes each.
    text_hash (64 bits) tells texts under one doc_id apart. kept: the row stands for its component, as the one of the least (doc_id,
    text_hash), or links with nothing; repeated rows are kept or not alike.
    """
    described = describe(docs)
    rows = described.where("n is not null").select("doc_id", "th", "n", "sig")
    nodes = described.where("doc_id is not null and sig is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "th", "n", "sketch")).alias("m"))
    nodes = stage(nodes.select("sig", "m.doc_id", "m.th", "m.n", "m.sketch", F.monotonically_increasing_id().alias("node")), "nodes")
    sketches, nodes = nodes.select("node", "n", "sketch"), nodes.drop("n", "sketch")
    n_nodes = nodes.count()
    # Written before it is chained: a stage with two Python steps would run twice the workers of a core at once.
    prefix = stage(prefixes(docs, small(nodes, n_nodes), frequencies(described), percent), "prefixes")
    chain = chained(prefix, percent)
    first = first_partners(chain)
    tried = plausible(first, sketches, percent)
    roots = stage(components(verified(tried, docs, nodes, percent)), "roots")
    entries = chain.where("h is not null").drop("b")
    for nearest in (True, False):
        met = crossing(entries, roots, sketches, percent, nearest)
        if nearest:
            met = stage(met.unionByName(plausible(left_out(chain, first, roots), sketches, percent)).distinct(), "second")
        if met.isEmpty():
            break
        # A pair that failed before meets again; a node whose nearest one it was goes on to the last round.
        rest = stage(met.join(tried, ["a", "b"], "left_anti"), "rest")
        # Components so far go on as stars, which end in a round; only what is new has to be joined.
        links = roots.select(F.col("node").alias("a"), F.col("component_id").alias("b")).unionByName(verified(rest, docs, nodes, percent))
        roots = stage(components(links), "roots")
        tried = tried.unionByName(rest)
    named = nodes.join(roots, "node", "left").select("sig", "doc_id", "th", F.coalesce("component_id", "node").alias("root"))
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("least"))
    of = stage(named.join(least, "root").select("sig", "least"), "components")
    drop_staged(chain, prefix)
    out = rows.join(small(of, n_nodes), "sig", "left")
    linked = F.col("doc_id").isNotNull() & F.col("least").isNotNull()
    kept = ~linked | (F.struct("doc_id", "th") == F.col("least"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("th").alias("text_hash"), F.coalesce(kept, F.lit(True)).alias("kept"))
