"""Exact near-duplicate embeddings by dual traversal of cover trees.

Vectors compare only within a label, by cosine in double precision. On unit vectors the threshold is a
distance, so a tree of nested levels with halving radii lets a traversal of two trees drop every pair of
nodes whose centres are further apart than both covering radii and the threshold together. Equal
vectors are one node with a count. A large label is dealt to cells, the upper levels of a cover tree over
a bounded sample of it, and a large cell by hash to chunks. A vector goes to a cell other than its own only if
its distance to the centre is within the cell's covering radius (over all its vectors) and the threshold;
each pair of chunks that meet is one task, so a hot label spreads over many. A task returns sums of
links and a spanning forest, never its pairs. Where vectors are so spread that no bound prunes, every
pair of a label is compared, by matrix products.

Cases: a null label, a null vec_id, and a vector that is null, empty, zero or holds null or non-finite
components link with nothing (component: itself); vectors of different length do not link; repeated
rows are vectors of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import components, cut

COSINE = 0.93
#: Distinct vectors of a chunk at most, on average; members of a leaf; rows of one matrix product.
CHUNK, LEAF, TILE = 4096, 128, 2048
#: Cosines this close to the threshold are worked out again from the vectors as given.
EDGE = 1e-9
#: Cells of a label at most, and distinct vectors that their centres are chosen from (on average).
CELLS, SAMPLE = 64, 4096


class Tree:
    """Cover tree over unit vectors: per node its centre, covering radius and children or members.

    A node of at most ``LEAF`` members is a leaf, and so is one whose members the next level would set
    nearly all apart (no ball of half the radius holds many of them, so bounds on balls prune nothing).
    """

    def __init__(self, raw: np.ndarray) -> None:
        self.raw, x = raw, raw / np.sqrt((raw * raw).sum(axis=1))[:, None]
        self.x, self.centre, self.radius, self.children, self.members = x, [], [], [], []
        self._grow(np.arange(len(x)))

    def _add(self, centre: int, members: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(self._far(centre, members).max(initial=0.0)))
        self.children.append(None)
        self.members.append(members)
        return len(self.centre) - 1

    def _grow(self, members: np.ndarray) -> None:
        """Splits nodes level by level: greedy nets of half the radius, the parent's centre first."""
        todo = [self._add(members[0], members)]
        while todo:
            node = todo.pop()
            rest, c = self.members[node], self.centre[node]
            if len(rest) <= LEAF or self.radius[node] < 1e-7:
                continue
            level = 2.0 ** math.ceil(math.log2(self.radius[node]) - 1)  # the largest power of two below the radius
            kids, most = [], max(8, len(rest) // 16)
            while rest.size and len(kids) <= most:
                near = self._far(c, rest) <= level
                near |= rest == c
                kids.append((c, rest[near]))
                rest = rest[~near]
                c = rest[0] if rest.size else c
            if rest.size:
                continue
            self.children[node] = np.array([self._add(c, m) for c, m in kids])
            todo += self.children[node].tolist()

    def _far(self, c: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[members] @ self.x[c])))


Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def _leaf_pairs(a: Tree, b: Tree, p: np.ndarray, q: np.ndarray, cosine: float, own: bool) -> Pairs:
    """Index pairs of that cosine between the members of two leaves, by matrix products of bounded size."""
    for m in range(0, len(p), TILE):
        for n in range(m if own else 0, len(q), TILE):
            i, j = p[m : m + TILE], q[n : n + TILE]
            dots = a.x[i] @ b.x[j].T
            u, v = np.nonzero(dots >= cosine - EDGE)
            if own and m == n:
                u, v = u[u < v], v[u < v]
            near = np.flatnonzero(dots[u, v] <= cosine + EDGE)  # rounding decides: by the stated formula
            x, y = a.raw[i[u[near]]], b.raw[j[v[near]]]
            keep = np.ones(len(u), bool)
            keep[near] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= cosine
            yield i[u[keep]], j[v[keep]]


def close_pairs(a: Tree, b: Tree, cosine: float) -> Pairs:
    """Indices of all pairs of at least that cosine, in parts of bounded size; for a tree with itself each pair once."""
    same, todo, limit = a is b, [(0, 0)], math.sqrt(2 - 2 * cosine) + 1e-7
    while todo:
        i, j = todo.pop()
        own = same and i == j
        if a.children[i] is None and b.children[j] is None:
            yield from _leaf_pairs(a, b, a.members[i], b.members[j], cosine, own)
            continue
        ka = np.array([i]) if a.children[i] is None else a.children[i]
        kb = np.array([j]) if b.children[j] is None else b.children[j]
        ca, cb, ra, rb = (np.take(x, k) for x, k in ((a.centre, ka), (b.centre, kb), (a.radius, ka), (b.radius, kb)))
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (a.x[ca] @ b.x[cb].T)))
        near = d <= ra[:, None] + rb[None, :] + limit
        if own:
            near = np.triu(near)
        p, q = np.nonzero(near)
        todo += zip(ka[p].tolist(), kb[q].tolist(), strict=True)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each, with the links a-b added to those that gave ``label``."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def compare(x: np.ndarray, y: np.ndarray | None, cosine: float = COSINE) -> Pairs:
    """Index pairs of rows with at least that cosine, in parts; ``y`` None: within ``x``."""
    tree = Tree(x)
    yield from close_pairs(tree, tree if y is None else Tree(y), cosine)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as scaled bytes of doubles; null where they cannot link."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            x = np.array(v, float) if v and None not in v else np.zeros(0)
            top = np.abs(x).max(initial=0.0)
            out.append((x / 2.0 ** math.frexp(top)[1]).tobytes() if np.isfinite(x).all() and top > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "v"])


def _task(cosine: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        left, right = g[g.side == 0], g[g.side == 1]
        load = lambda part: np.frombuffer(b"".join(part.v), float).reshape(len(part), -1)
        own = bool(((g.a == g.b) & (g.ac == g.bc)).all())
        if not len(left) or not (own or len(right)):
            return pd.DataFrame({"rid": [], "links": [], "root": []})
        both = left if own else pd.concat([left, right])
        n, rid, shift = both.n.to_numpy(), both.rid.to_numpy(), 0 if own else len(left)
        links, root = np.zeros(len(both)), np.arange(len(both))
        for a, b in compare(load(left), None if own else load(right), cosine):
            links += np.bincount(a, n[b + shift], len(both)) + np.bincount(b + shift, n[a], len(both))
            root = _merge(root, a, b + shift)
        hit = links > 0
        return pd.DataFrame({"rid": rid[hit], "links": links[hit].astype(np.int64), "root": rid[root[hit]]})

    return run


def _unit(part: pd.Series) -> np.ndarray:
    raw = np.frombuffer(b"".join(part), float).reshape(len(part), -1)
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _net(g: pd.DataFrame) -> pd.DataFrame:
    """Centres of a label's cells: the upper levels of its cover tree, farthest vector first."""
    x, k = _unit(g.v), int(g.cells.iloc[0])
    far, chosen = np.full(len(x), np.inf), [0]
    while len(chosen) < k:
        far = np.minimum(far, 2 - 2 * (x @ x[chosen[-1]]))
        if far.max() < 1e-9:
            break
        chosen.append(int(far.argmax()))
    return pd.DataFrame({"label": g.label.iloc[0], "dim": g.dim.iloc[0], "net": [x[chosen].tobytes()]})


def _placed(vectors: pd.DataFrame, net: pd.DataFrame) -> pd.DataFrame:
    """The nearest centre of each vector and its distance to every centre; without a net all are in cell 0."""
    if not len(vectors):
        return pd.DataFrame({"label": [], "dim": [], "rid": [], "n": [], "v": [], "cell": [], "far": []})
    out = vectors[["label", "dim", "rid", "n", "v"]].copy()
    if len(net):
        x = _unit(vectors.v)
        far = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ np.frombuffer(net.net.iloc[0], float).reshape(-1, x.shape[1]).T)))
        out["cell"], out["far"] = far.argmin(axis=1), far.tolist()
    else:
        out["cell"], out["far"] = 0, [[0.0]] * len(out)
    return out


def near_duplicates(embeddings: DataFrame, *, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    plain = embeddings.select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    rows = plain.mapInArrow(_vectors, "vec_id BIGINT, label STRING, v BINARY")
    usable = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = rows.select("vec_id", "label", F.when(usable, F.col("v")).alias("v")).withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "v", "label")})
    rows = cut(rows)
    groups = rows.filter("v IS NOT NULL").groupBy("h1", "h2", "label").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    groups = cut(groups.withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.length("v")))
    found = cut(_found(groups.select("label", "dim", "rid", "n", "v"), cosine, chunk))
    linked = found.groupBy("rid").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    named = groups.join(parts.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("root", F.coalesce("component", "rid"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = named.join(ids, "root").join(linked, "rid", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(cut(final), ["h1", "h2"], "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.when(F.col("v").isNull(), 0).otherwise(F.col("n_links")).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _found(vectors: DataFrame, cosine: float, chunk: int) -> DataFrame:
    """(rid, links, root) of each task; ``vectors`` holds (label, dim, rid, n, v), distinct within a label."""
    key = ["label", "dim"]
    sizes = cut(vectors.groupBy(*key).agg(F.count("*").alias("all")).withColumn("parts", F.ceil(F.col("all") / chunk).cast("int")))
    many = sizes.filter("parts > 1").withColumn("cells", F.least("parts", F.lit(CELLS)))
    drawn = F.pmod(F.xxhash64("rid", F.lit(3)), F.col("all")) < SAMPLE
    net = cut(vectors.join(many, key).filter(drawn).select(*key, "v", "cells").groupBy(*key).applyInPandas(_net, "label STRING, dim INT, net BINARY"))
    nets = net.join(many, key).select(*key, "net", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = vectors.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).select(*key, "part", "rid", "n", "v")
    by = [*key, "part"]
    placed = cut(dealt.groupBy(*by).cogroup(nets.groupBy(*by)).applyInPandas(_placed, "label STRING, dim INT, rid BIGINT, n BIGINT, v BINARY, cell INT, far ARRAY<DOUBLE>"))
    own = F.get("far", F.col("cell"))
    cells = placed.groupBy(*key, "cell").agg(F.max(own).alias("radius"), F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    per = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("radius", "chunks")))).alias("cells"))  # CELLS entries at most
    known = placed.join(cut(per), key).withColumn("c", F.pmod(F.xxhash64("rid", F.lit(5)), F.col("cells")[F.col("cell")]["chunks"]).cast("int"))
    limit = math.sqrt(2 - 2 * cosine) + 1e-6
    # A vector further from a centre than its radius and the threshold has no partner in that cell.
    met = F.filter(F.map_entries("cells"), lambda e: (e["key"] == F.col("cell")) | (F.get("far", e["key"]) <= e["value"]["radius"] + limit))
    there = known.select(*key, "rid", "n", "v", "cell", "c", F.explode(F.transform(met, lambda e: F.struct(e["key"].alias("cell"), e["value"]["chunks"].alias("chunks")))).alias("o"))
    spread = there.select("*", F.explode(F.sequence(F.lit(0), F.col("o.chunks") - 1)).alias("oc"))
    mine, other = F.struct(F.col("cell"), F.col("c")), F.struct(F.col("o.cell"), F.col("oc").alias("c"))
    task = spread.select(*key, "rid", "n", "v", F.least(mine, other).alias("ci"), F.greatest(mine, other).alias("cj"), (mine > other).cast("int").alias("side"))
    named = task.select(*key, F.col("ci.cell").alias("a"), F.col("ci.c").alias("ac"), F.col("cj.cell").alias("b"), F.col("cj.c").alias("bc"), "rid", "n", "v", "side")
    return named.groupBy(*key, "a", "ac", "b", "bc").applyInPandas(_task(cosine), "rid BIGINT, links BIGINT, root BIGINT")


def query(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
