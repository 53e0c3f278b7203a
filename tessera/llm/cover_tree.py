"""Embedding near-dedup: exact pairs above a cosine by a dual traversal of cover trees."""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_batches, small, stage
from .vectors import matrix, usable

#: Vectors of a block, which has a tree of its own; a task holds two blocks.
BLOCK = 3072
#: A label's vectors are parted around at most so many centres at a time, in at most so many turns, and by so many rows a task.
FAN, TURNS, PART = 64, 8, 1 << 16
#: Parts of the table of blocks that a label's blocks meet in.
SALT = 16
#: Distances are allowed this much more before a pair of nodes is pruned, and this much less before all of it counts as linked.
#: Radii and gaps are computed in double, with errors under 1e-7, so rounding never loses a pair.
SLACK = 1e-4
#: Pairs of nodes that hold no more pairs of vectors than this are compared at once. Slices hold so many pairs, or numbers.
FEW, SLICE = 4096, 1 << 20


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between unit vectors, by their products: errors are under 1e-7."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


class CoverTree:
    """Unit vectors in nested levels with halving radii. All centres of a level lie further apart than its radius, whatever their
    parents; each vector lies within it of a centre; a centre is one on all levels below and its parent is the centre that
    covers it on the level above. A node's covering radius is the greatest distance from its centre to a vector below it."""

    def __init__(self, unit: np.ndarray, centres: list[np.ndarray], parents: list[np.ndarray], below: list[np.ndarray], far: list[np.ndarray]) -> None:
        self.unit, self.centre, self.parent, self.below, self.far = unit, centres, parents, below, far
        self.members = [grouped(b, len(c)) for b, c in zip(below, centres)]
        self.children = [grouped(p, len(c)) for p, c in zip(parents[1:], centres)]

    @classmethod
    def build(cls, unit: np.ndarray, smallest: float) -> CoverTree:
        """Level by level down to a radius of smallest or less, or to nodes of one vector. A vector that no centre covers yet becomes
        one; it is compared with the centres under nodes near enough to have one within reach."""
        centres, parents = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        cover, radius = np.zeros(len(unit), np.int64), 2.0
        while radius > smallest and len(centres[-1]) < len(unit):
            radius /= 2
            above = centres[-1]
            points = unit[above]
            now, parent = above.tolist(), list(range(len(above)))
            under = [[k] for k in range(len(above))]
            new = np.full(len(unit), -1)
            new[above] = np.arange(len(above))
            for p, inside in enumerate(grouped(cover, len(above))):
                inside = inside[new[inside] < 0]
                if not len(inside):
                    continue
                around = np.flatnonzero(distances(points[p : p + 1], points)[0] <= 5 * radius + SLACK)
                at = np.array([c for q in around.tolist() for c in under[q]])
                for k in range(0, len(inside), 256):
                    part = inside[k : k + 256]
                    near = distances(unit[part], unit[np.array(now)[at]])
                    best = near.argmin(1)
                    hit = near[np.arange(len(part)), best] <= radius
                    new[part[hit]] = at[best[hit]]
                    part, made = part[~hit], []
                    while len(part):
                        one = int(part[0])
                        c = len(now)
                        now.append(one)
                        parent.append(p)
                        made.append(c)
                        hit = distances(unit[one : one + 1], unit[part])[0] <= radius
                        hit[0] = True
                        new[part[hit]] = c
                        part = part[~hit]
                    under[p] += made
                    at = np.concatenate([at, np.array(made, np.int64)])
            centres.append(np.array(now))
            parents.append(np.array(parent))
            cover = new
        below = [cover]
        for parent in parents[:0:-1]:
            below.insert(0, parent[below[0]])
        far = [furthest(unit, c[b], b, len(c)) for c, b in zip(centres, below)]
        return cls(unit, centres, parents, below, far)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *(a.astype(np.int32) for part in (self.centre, self.parent, self.below) for a in part), *self.far)
        return out.getvalue()

    @classmethod
    def load(cls, unit: np.ndarray, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as file:
            arrays = [file[f"arr_{k}"] for k in range(len(file.files))]
        n = len(arrays) // 4
        return cls(unit, *([a.astype(np.int64) for a in arrays[k * n : k * n + n]] for k in range(3)), arrays[3 * n :])


def grouped(of: np.ndarray, n: int) -> list[np.ndarray]:
    """The places of 0, 1, ... n - 1 in an array."""
    order = np.argsort(of, kind="stable")
    return np.split(order, np.cumsum(np.bincount(of, minlength=n))[:-1])


def furthest(unit: np.ndarray, centre: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
    """By node the greatest norm of a difference, in double: dot products can't tell distances under 1e-7."""
    out, step = np.zeros(n), max(1, SLICE // unit.shape[1])
    for k in range(0, len(unit), step):
        d = unit[k : k + step] - unit[centre[k : k + step]]
        np.maximum.at(out, node[k : k + step], np.sqrt((d * d).sum(1)))
    return out


def close_pairs(a: CoverTree, b: CoverTree, reach: float):
    """(members of a, members of b, sure) of node pairs that may hold vectors within reach, or surely hold no others. Both trees are
    walked down together, the one with fewer levels waiting at its leaves; a pair of nodes is pruned when its centres are further
    apart than reach and both covering radii, and done when all its members are within reach. Within one tree each pair of
    vectors comes once, and a node with itself as the same array twice."""
    pairs = [(0, 0)]
    depth = max(len(a.children), len(b.children), 1)
    for turn in range(depth):
        down_a, down_b = turn < len(a.children), turn < len(b.children)
        la, lb = min(turn + 1, len(a.children)), min(turn + 1, len(b.children))
        last = turn + 1 >= depth
        below = []
        for x, y in pairs:
            xs = a.children[turn][x] if down_a else np.array([x])
            ys = b.children[turn][y] if down_b else np.array([y])
            ca, ra = a.unit[a.centre[la][xs]], a.far[la][xs]
            cb, rb = b.unit[b.centre[lb][ys]], b.far[lb][ys]
            parts = [b.members[lb][q] for q in ys]
            size_a, size_b = np.array([len(a.members[la][p]) for p in xs]), np.array([len(m) for m in parts])
            members, of = np.concatenate(parts), np.repeat(np.arange(len(ys)), size_b)
            for at in range(0, len(xs), 256):
                part = slice(at, at + 256)
                gap = distances(ca[part], cb)
                both = ra[part, None] + rb[None, :]
                near, sure = gap <= reach + SLACK + both, gap + both <= reach - SLACK
                small_ = last | (size_a[part, None] * size_b[None, :] <= FEW)
                for k in range(len(gap)):
                    p = at + k
                    if not near[k].any():
                        continue
                    own = a.members[la][xs[p]]
                    if a is b and x == y:
                        near[k, :p] = False
                        if sure[k, p] or small_[k, p]:
                            near[k, p] = False
                            if len(own) > 1:
                                yield own, own, bool(sure[k, p])
                    whole, rest = near[k] & sure[k], near[k] & ~sure[k]
                    for chosen, done in ((whole, True), (rest & small_[k], False)):
                        if chosen.any():
                            yield own, members[chosen[of]], done
                    below += [(xs[p], ys[q]) for q in np.flatnonzero(rest & ~small_[k]).tolist()]
        pairs = below


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node it reaches) over links x, y."""
    nodes, back = np.unique(np.concatenate([x, y]), return_inverse=True)
    p, q = back[: len(x)], back[len(x) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, root[p], least)
        np.minimum.at(new, root[q], least)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


class Links:
    """Counts of links and links that keep who reaches whom, from pairs of groups of vectors; memory is bounded whatever their size."""

    def __init__(self, v: np.ndarray, m: np.ndarray, cosine: float) -> None:
        self.v, self.m, self.cosine = v, m, cosine
        self.norm = np.sqrt((v * v).sum(1))
        self.unit = v / self.norm[:, None]
        self.links, self.found, self.n = np.zeros(len(v), np.int64), [], 0

    def keep(self, x: np.ndarray, y: np.ndarray) -> None:
        self.found.append(np.stack([x, y]))
        self.n += len(x)
        if self.n > 2 * SLICE:
            x, y = forest(*np.concatenate(self.found, 1))
            self.found, self.n = [np.stack([x, y])], 0

    def all(self, xs: np.ndarray, ys: np.ndarray) -> None:
        """Every two of the groups, or of one group, are linked: counted as a whole."""
        m = self.m
        if xs is ys:
            self.links[xs] += m[xs].sum() - m[xs]
        else:
            self.links[xs] += m[ys].sum()
            self.links[ys] += m[xs].sum()
            self.keep(xs, np.full(len(xs), ys[0]))
        self.keep(np.full(len(ys), xs[0]), ys)

    def check(self, xs: np.ndarray, ys: np.ndarray) -> None:
        """Linked are those whose cosine is high enough, by products of slices; those near the threshold are computed again."""
        m, step = self.m, max(1, SLICE // len(ys))
        for at in range(0, len(xs), step):
            part = xs[at : at + step]
            dot = self.unit[part] @ self.unit[ys].T
            close = dot >= self.cosine
            i, j = np.nonzero(np.abs(dot - self.cosine) < 1e-9)
            few = max(1, SLICE // self.v.shape[1])
            for k in range(0, len(i), few):
                p, q = i[k : k + few], j[k : k + few]
                x, y = part[p], ys[q]
                close[p, q] = (self.v[x] * self.v[y]).sum(1) / (self.norm[x] * self.norm[y]) >= self.cosine
            if xs is ys:
                close[np.arange(len(part)), at + np.arange(len(part))] = False
            self.links[part] += close @ m[ys]
            if xs is not ys:
                self.links[ys] += m[part] @ close
            i, j = np.nonzero(close)
            if len(i):
                self.keep(part[i], ys[j])


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """n of the vectors (all if fewer), each the furthest from those before it: centres that lie apart."""
    chosen, gap = [0], distances(sample[:1], sample)[0]
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample[chosen[-1:]], sample)[0])
    return np.array(chosen)


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    v = matrix(column)
    return v / np.sqrt((v * v).sum(1))[:, None]


def parted(distinct: DataFrame) -> DataFrame:
    """(root, block, node, m, v): vectors of a label and length (its root) in blocks of BLOCK or so.

    The upper levels of a label's tree: where more than BLOCK vectors are together, centres that lie apart are chosen from a few of
    them, and each vector goes to its nearest centre; again for parts that are still large. What TURNS turns leave large (vectors
    of nearly one direction) is dealt by hash. Where a vector goes changes no result, only what can be pruned.
    """
    roots = stage(distinct.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("root", F.monotonically_increasing_id()), "roots")
    rows = distinct.join(small(roots, roots.count()), ["label", "dim"]).select("root", F.col("root").cast("string").alias("block"), "node", "m", "v")
    kinds = f"root long, block string, node long, m long, v {dict(distinct.dtypes)['v']}"

    def centres(group: pa.Table) -> pa.Table:
        x = unit_rows(group.sort_by("node").column("v"))
        x = x[spread_out(x, group.column("fan")[0].as_py())]
        return pa.table({"block": pa.array([group.column("block")[0].as_py()] * len(x)), "at": pa.array(np.arange(len(x)), pa.int32()), "centre": pa.array(list(x), pa.list_(pa.float64()))})

    def to_nearest(some: pa.Table, chosen: pa.Table) -> pa.Table:
        some = some.drop_columns(["part"])
        if not some.num_rows or chosen.num_rows < 2:
            return some
        chosen, x = chosen.sort_by("at"), unit_rows(some.column("v"))
        y, near = matrix(chosen.column("centre")), np.empty(len(x), np.int64)
        for k in range(0, len(x), 4096):
            near[k : k + 4096] = distances(x[k : k + 4096], y).argmin(1)
        names = pa.array([f"{b}/{k}" for b, k in zip(some.column("block").to_pylist(), near.tolist())])
        return some.set_column(some.column_names.index("block"), "block", names)

    for turn in range(TURNS + 1):
        sizes = rows.groupBy("root", "block").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        sizes = stage(sizes.select("block", "n", F.least(F.lit(FAN), F.ceil(2 * F.col("n") / BLOCK)).cast("int").alias("fan")), "large")
        n = sizes.count()
        if not n:
            break
        large = rows.join(small(sizes, n), "block")
        rest = rows.join(small(sizes.select("block"), n), "block", "left_anti")
        if turn == TURNS:
            dealt = F.concat_ws("#", "block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).cast("string"))
            return rest.unionByName(large.select("root", dealt.alias("block"), "node", "m", "v"))
        few = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1 << 30)) < F.lit(4.0 * (1 << 30)) * F.col("fan") / F.col("n")
        chosen = stage(large.where(few).select("block", "fan", "node", "v").groupBy("block").applyInArrow(centres, "block string, at int, centre array<double>"), "centres")
        n_parts = F.ceil(F.col("n") / PART).cast("int")
        here = large.select("root", "block", "node", "m", "v", F.pmod(F.xxhash64(F.lit(-1), "node"), n_parts).cast("int").alias("part"))
        there = chosen.join(small(sizes, n), "block").select("block", "at", "centre", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"))
        moved = here.groupBy("block", "part").cogroup(there.groupBy("block", "part")).applyInArrow(to_nearest, kinds)
        rows = stage(rest.select("root", "block", "node", "m", "v").unionByName(moved), "parted")
    return rows


def planted(distinct: DataFrame, reach: float) -> DataFrame:
    """Staged (root, block, centre, radius, node, m, v, tree): a row for each block, with its vectors, a ball around them and the tree
    of its directions. Each tree is built once."""

    def plant(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        v = matrix(group.column("v"))
        unit = v / np.sqrt((v * v).sum(1))[:, None]
        centre = unit.mean(0)
        radius = float(np.sqrt(((unit - centre) ** 2).sum(1)).max())
        one = lambda values, kind: pa.array([values], kind)
        return pa.table({
            "root": group.column("root").slice(0, 1), "block": group.column("block").slice(0, 1), "centre": one(centre, pa.list_(pa.float64())), "radius": pa.array([radius]),
            "node": one(group.column("node").to_numpy(), pa.list_(pa.int64())), "m": one(group.column("m").to_numpy(), pa.list_(pa.int64())),
            "v": one(v.tobytes(), pa.binary()), "tree": one(CoverTree.build(unit, reach / 2).dump(), pa.binary()),
        })

    schema = "root long, block string, centre array<double>, radius double, node array<long>, m array<long>, v binary, tree binary"
    return stage(parted(distinct).groupBy("root", "block").applyInArrow(plant, schema), "blocks")


def touching(blocks: DataFrame, reach: float) -> DataFrame:
    """Staged (i, j): pairs of blocks of a root, a block with itself too, whose balls may hold vectors within reach."""
    b = blocks.select("root", "block", "centre", "radius")
    salt = F.pmod(F.xxhash64("block"), F.lit(SALT)).cast("int")
    x = b.select("root", F.col("block").alias("i"), F.col("centre").alias("x"), F.col("radius").alias("r"), salt.alias("salt"))
    y = b.select("root", F.col("block").alias("j"), F.col("centre").alias("y"), F.col("radius").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    gap = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, c: (a - c) * (a - c)), F.lit(0.0), lambda a, c: a + c))
    met = x.join(y, ["root", "salt"]).where((F.col("i") == F.col("j")) | ((F.col("i") < F.col("j")) & (gap <= F.col("r") + F.col("s") + reach + SLACK)))
    return stage(met.select("i", "j"), "touching")


def linked(distinct: DataFrame, cosine: float) -> DataFrame:
    """Staged (node, links) and (a, b) rows: how many vectors each node links to within a pair of blocks, and who reaches whom there."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    blocks = planted(distinct, reach)
    pairs = touching(blocks, reach)
    whole = blocks.select("block", F.struct("node", "m", "v", "tree").alias("w"))
    both = pairs.join(whole.select(F.col("block").alias("i"), F.col("w").alias("x")), "i")
    both = both.join(whole.select(F.col("block").alias("j"), F.col("w").alias("y")), "j")
    both = both.select((F.col("i") == F.col("j")).alias("own"), "x", F.when(F.col("i") != F.col("j"), F.col("y")).alias("y"))

    def compare(sides: list[dict]) -> pa.RecordBatch:
        node, m = (np.concatenate([s[c] for s in sides]) for c in ("node", "m"))
        v = np.concatenate([np.frombuffer(s["v"]).reshape(len(s["node"]), -1) for s in sides])
        seen, first = Links(v, m, cosine), len(sides[0]["node"])
        places = [np.arange(first), np.arange(first, len(node))]
        trees = [CoverTree.load(seen.unit[at], s["tree"]) for at, s in zip(places, sides)]
        for xs, ys, sure in close_pairs(trees[0], trees[-1], reach):
            if len(sides) > 1:
                ys = ys + first
            (seen.all if sure else seen.check)(xs, ys)
        at, found = np.flatnonzero(seen.links), seen.found
        a, b = forest(*np.concatenate(found, 1)) if found else (at, at)
        away = a != b
        a, b = a[away], b[away]
        one = lambda values, k: pa.concat_arrays([pa.array(values, pa.int64()), pa.nulls(k, pa.int64())])
        other = lambda values, k: pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(values, pa.int64())])
        columns = [one(node[at], len(a)), one(seen.links[at], len(a)), other(node[a], len(at)), other(node[b], len(at))]
        return pa.RecordBatch.from_arrays(columns, ["node", "links", "a", "b"])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                yield compare([x] if batch.column(0)[k].as_py() else [x, y])

    return stage(map_batches(both, run, "node long, links long, a long, b long"), "links")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors. Vectors of equal label and length link from a cosine upwards.

    Equal vectors under a label are one node. The nodes of a label are parted into blocks around centres, each with a cover tree that
    is built once; two blocks meet in a task unless their covering radii rule out a link, so no label is gathered. A task sends on
    counts and who reaches whom, never all pairs. A row whose label or vector is null, or whose
    vector is empty, zero or not finite, links with nothing. Rows repeated with their vec_id link like any two rows.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    ok = usable(F.col("v")) & F.col("label").isNotNull()
    distinct = rows.where(ok).groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    distinct = stage(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    found = linked(distinct, cosine)
    links = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("a is not null").select("a", "b"))
    named = distinct.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("component_id", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), "component")
    out = rows.where(ok).join(named, ["label", "v"]).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
