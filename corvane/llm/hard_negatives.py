"""Hard negatives by dual-tree search: a tree over anchors meets a tree over candidates, node by node."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import cut, small, written

#: Rows of which an anchor is one, whose label is changed, and steps that a component's unit has.
EVERY, RELABELLED, SCALE = 100, 7, 256
#: Positives of an anchor, negatives of a positive, and the least share (in fifths) of the positive's score that a negative has.
POSITIVES, NEGATIVES, LEAST_FIFTHS = 5, 5, 4
#: Rows of a leaf of either tree, groups of labels, and levels of cells: GROUPS * 2 ** MAX_DEPTH cells at most.
ANCHOR_LEAF, LEAF, GROUPS, MAX_DEPTH = 64, 1024, 64, 10
#: Rows that the cells' planes are fitted on, those with the least keyed hash of the id. All rows are sorted into cells.
SAMPLE = 4096
#: Pairs of nodes looked at at once, and anchor leaves whose best rows a task holds.
PAIRS, HELD = 1 << 18, 256
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec): rows that take part, labels as the contract changes them and components as whole doubles.

    A row without id, label or vector, or with a null or non-finite component,
    takes no part. Of rows that repeat an id, the first by label and vector does.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("vec"))
    odd = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where("vec_id is not null and label is not null and vec is not null").where(~odd)
    label = F.when(F.col("vec_id") % RELABELLED == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform("vec", lambda c: F.floor(c * SCALE).cast("double")).alias("vec"))
    if rows.groupBy("vec_id").count().where("count > 1").take(1):
        first = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "vec"))
        rows = rows.withColumn("__row", first).where("__row = 1").drop("__row")
    return rows


@dataclass
class Cells:
    """A binary tree of planes: node k's children are 2k + 1 and 2k + 2; each node has a centre, which balls stand around."""

    depth: int
    planes: np.ndarray
    cuts: np.ndarray
    centres: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.planes[node]) > self.cuts[node])
        return node - (2**self.depth - 1)

    def at(self, depth: int, cell: np.ndarray) -> np.ndarray:
        """The centres of the nodes at a depth."""
        return self.centres[2**depth - 1 + cell]


def fit_cells(sample: np.ndarray, depth: int) -> Cells:
    """Planes that halve the sample along its main direction, again and again."""
    dim = sample.shape[1]
    planes, cuts, centres = np.zeros((2**depth - 1, dim)), np.zeros(2**depth - 1), np.zeros((2 ** (depth + 1) - 1, dim))
    parts = {0: sample}
    for node in range(len(centres)):
        own = parts.pop(node)
        centres[node] = own.mean(axis=0) if len(own) else centres[(node - 1) // 2] if node else 0
        if node < len(planes):
            if len(own) > 1:
                planes[node] = np.linalg.svd(own - centres[node], full_matrices=False)[2][0]
            along = own @ planes[node]
            cuts[node] = np.median(along) if len(own) else 0
            parts[2 * node + 1], parts[2 * node + 2] = own[along <= cuts[node]], own[along > cuts[node]]
    return Cells(depth, planes, cuts, centres)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as a matrix; what a list lacks of dim is zero."""
    ends = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (ends == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(ends), dim))
    out[np.arange(dim) < ends[:, None]] = flat
    return out


def _routed(rows: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """rows with grp, its label's group, and cell."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells.of(_matrix(batch.column(2), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["vec_id", "label", "vec", "cell"])

    out = rows.select("vec_id", "label", "vec").mapInArrow(route, "vec_id long, label long, vec array<double>, cell int")
    return out.withColumn("grp", F.pmod("label", F.lit(GROUPS)).cast("int"))


PACKED = "block string, grp int, cell int, n int, ids binary, labels binary, vecs binary, his binary, los binary, windows int, centre binary, radius double, radii array<double>, lo long, hi long, least long, most long, top double"


def _packed(rows: DataFrame, cells: Cells, dim: int, depth: int, leaf: int) -> DataFrame:
    """Leaves of rows(vec_id, label, vec, grp, cell, his, los): so many rows of one group and one cell of a depth, with their ball and its bounds.

    Rows are dealt out by ranges of group, cell and id, so that a group of any
    size is cut among tasks, and packed as they stream by.
    """
    shift = cells.depth - depth

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        grp, cell = t.column("grp")[0].as_py(), t.column("cell")[0].as_py()
        ids, labels = (t.column(c).to_numpy().astype("<i8") for c in ("vec_id", "label"))
        vecs = _matrix(t.column("vec").combine_chunks(), dim)
        his, los = (np.array(t.column(c).to_pylist(), dtype="<i8").reshape(len(ids), -1) for c in ("his", "los"))
        centre = vecs.mean(axis=0)
        far = lambda c: float(np.sqrt(((vecs - c) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
        radii = [far(cells.at(d, np.array([cell >> (depth - d)]))) for d in range(depth + 1)]
        row = [f"{grp}/{cell}/{ids[0]}", grp, cell, len(ids), ids.tobytes(), labels.tobytes(), vecs.astype("<f8").tobytes(), his.tobytes(), los.tobytes(), his.shape[1], centre.astype("<f8").tobytes(), far(centre), radii]
        row += [int(los.min(initial=HIGHEST)), int(his.max(initial=LOWEST)), int(labels.min()), int(labels.max()), float(np.abs(vecs).max(initial=0))]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    schema = pa.schema([("block", pa.string()), ("grp", pa.int32()), ("cell", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "vecs", "his", "los")], ("windows", pa.int32()), ("centre", pa.binary()), ("radius", pa.float64()), ("radii", pa.list_(pa.float64())), *[(c, pa.int64()) for c in ("lo", "hi", "least", "most")], ("top", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, key = [], 0, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("grp", "cell")], axis=1)
            for part in np.split(np.arange(len(keys)), np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1):
                at = 0
                while at < len(part):
                    now = tuple(keys[part[at]])
                    if n and (now != key or n == leaf):
                        yield pack(held)
                        held, n = [], 0
                    take = min(leaf - n, len(part) - at)
                    held.append(batch.slice(part[at], take))
                    n, at, key = n + take, at + take, now
        if n:
            yield pack(held)

    order = ["grp", "cell", "vec_id"]
    dealt = rows.select("vec_id", "label", "vec", "grp", F.shiftright("cell", shift).alias("cell"), "his", "los").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, PACKED)


@dataclass
class Tree:
    """The candidates' tree: its leaves as a table, and each inner node's radius for each group, by depth (negative: no rows)."""

    cells: Cells
    dim: int
    leaves: DataFrame
    radii: list[np.ndarray]
    least: np.ndarray
    most: np.ndarray


def tree_of(rows: DataFrame, cells: Cells, dim: int) -> Tree:
    """The tree over routed rows. Its inner nodes are GROUPS * 2 ** (MAX_DEPTH + 1) at most, a bound that does not grow with the rows."""
    bare = rows.withColumns({"his": F.array().cast("array<long>"), "los": F.array().cast("array<long>")})
    leaves = written(_packed(bare, cells, dim, cells.depth, LEAF), "leaves")
    each = leaves.select("grp", F.posexplode("radii").alias("depth", "radius"), "cell", "least", "most").withColumn("prefix", F.expr(f"shiftright(cell, {cells.depth} - depth)"))
    radii = [np.full((GROUPS, 2**d), -1.0) for d in range(cells.depth + 1)]
    least, most = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for r in each.groupBy("grp", "depth", "prefix").agg(F.max("radius").alias("radius"), F.min("least").alias("least"), F.max("most").alias("most")).collect():
        radii[r["depth"]][r["grp"], r["prefix"]] = r["radius"]
        if not r["depth"]:
            least[r["grp"]], most[r["grp"]] = r["least"], r["most"]
    return Tree(cells, dim, leaves, radii, least, most)


def _interval(a: np.ndarray, ra: np.ndarray, c: np.ndarray, rc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between balls around a and around c, row by row, a little wide."""
    middle = np.einsum("ij,ij->i", a, c)
    na, nc = np.sqrt((a**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
    wide = na * rc + nc * ra + ra * rc
    wide += 1e-9 * (na + ra) * (nc + rc) + 1e-3
    return middle - wide, middle + wide


def _decoded(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), "<f8").reshape(-1, dim)


def node_pairs(anchors: DataFrame, tree: Tree, depth: int, same: bool) -> DataFrame:
    """(a_block, grp, cell): candidate cells that each anchor leaf must look into.

    Both trees are gone down together, from their roots: a pair of nodes whose
    inner products can't reach any window of the anchors below goes, with all
    anchors and all candidates below it. anchors are leaves of cells of a depth;
    same: rows of their own label are sought, else rows of other labels.
    """
    cells, dim, radii, least, most = tree.cells, tree.dim, tree.radii, tree.least, tree.most

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(c).to_numpy() for c in ("grp", "cell", "lo", "hi", "least", "most", "radius")}
            centre, own = _decoded(batch, "centre", dim), np.array(batch.column("radii").to_pylist())
            levels = []
            for d in range(depth + 1):
                code = col["grp"].astype(np.int64) << 32 | col["cell"] >> (depth - d)
                keys, back = np.unique(code, return_inverse=True)
                node = {"grp": keys >> 32, "cell": keys & 0xFFFFFFFF}
                for name, x, f in (("lo", col["lo"], np.minimum), ("hi", col["hi"], np.maximum), ("r", own[:, d], np.maximum), ("least", col["least"], np.minimum), ("most", col["most"], np.maximum)):
                    node[name] = x[np.unique(back, return_index=True)[1]].copy()
                    f.at(node[name], back, x)
                parent = np.searchsorted(levels[-1]["code"], (keys >> 32) << 32 | (keys & 0xFFFFFFFF) >> 1) if d else None
                levels.append(node | {"code": keys, "parent": parent, "back": back})
            found = []
            roots = [(i, g) for i, g0 in enumerate(levels[0]["grp"]) for g in range(GROUPS) if radii[0][g, 0] >= 0 and (g == g0 if same else not (least[g] == most[g] == levels[0]["least"][i] == levels[0]["most"][i]))]
            stack = [(0, *(np.array(x, np.int64) for x in (zip(*((i, g, 0) for i, g in roots), strict=True) if roots else ((), (), ()))))]
            while stack:
                d, i, g, c = stack.pop()
                if len(i) > PAIRS:
                    half = len(i) // 2
                    stack += [(d, i[:half], g[:half], c[:half]), (d, i[half:], g[half:], c[half:])]
                    continue
                a = levels[min(d, depth)]
                low, high = _interval(cells.at(min(d, depth), a["cell"][i]), a["r"][i], cells.at(d, c), radii[d][g, c])
                ok = (high >= a["lo"][i]) & (low <= a["hi"][i])
                i, g, c = i[ok], g[ok], c[ok]
                if not len(i):
                    continue
                if d < depth:
                    # Anchor nodes go down as well: each pair becomes those of the anchor node's children.
                    order = np.argsort(levels[d + 1]["parent"], kind="stable")
                    starts, ends = (np.searchsorted(levels[d + 1]["parent"][order], i, side=s) for s in ("left", "right"))
                    n = ends - starts
                    i = order[np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    g, c = np.repeat(g, n), np.repeat(c, n)
                if d == cells.depth:
                    found.append((i, g, c))
                    continue
                i, g, c = np.tile(i, 2), np.tile(g, 2), np.concatenate([2 * c, 2 * c + 1])
                there = radii[d + 1][g, c] >= 0
                stack.append((d + 1, i[there], g[there], c[there]))
            of_node = np.argsort(levels[-1]["back"], kind="stable")
            sorted_back = levels[-1]["back"][of_node]
            for i, g, c in found:
                starts, ends = (np.searchsorted(sorted_back, i, side=s) for s in ("left", "right"))
                n = ends - starts
                a = of_node[np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                g, c = np.repeat(g, n), np.repeat(c, n)
                for at in range(0, len(a), PAIRS):
                    s = slice(at, at + PAIRS)
                    low, high = _interval(centre[a[s]], col["radius"][a[s]], cells.at(cells.depth, c[s]), radii[-1][g[s], c[s]])
                    ok = (high >= col["lo"][a[s]]) & (low <= col["hi"][a[s]])
                    yield pa.RecordBatch.from_arrays([batch.column("block").take(pa.array(a[s][ok])), pa.array(g[s][ok].astype(np.int32)), pa.array(c[s][ok].astype(np.int32))], ["a_block", "grp", "cell"])

    summary = ["block", "grp", "cell", "lo", "hi", "least", "most", "radius", "centre", "radii"]
    return anchors.select(summary).mapInArrow(meet, "a_block string, grp int, cell int")


def leaf_pairs(anchors: DataFrame, tree: Tree, cell_pairs: DataFrame) -> DataFrame:
    """(a_block, c_block): pairs of leaves whose own balls let them hold a row of a window."""
    dim = tree.dim

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = [batch.column(c).to_numpy() for c in ("a_radius", "c_radius", "lo", "hi")]
                low, high = _interval(_decoded(batch, "a_centre", dim), r[0], _decoded(batch, "c_centre", dim), r[1])
                yield batch.select(["a_block", "c_block"]).filter(pa.array((high >= r[2]) & (low <= r[3])))

    ball = lambda df, side, *more: df.select(F.col("block").alias(f"{side}_block"), F.col("centre").alias(f"{side}_centre"), F.col("radius").alias(f"{side}_radius"), *more)
    met = cell_pairs.join(small(ball(tree.leaves, "c", "grp", "cell")), ["grp", "cell"]).join(small(ball(anchors, "a", "lo", "hi")), "a_block")
    return met.select("a_block", "c_block", "a_centre", "a_radius", "c_centre", "c_radius", "lo", "hi").mapInArrow(test, "a_block string, c_block string")


def _products(a: np.ndarray, c: np.ndarray, top: float) -> np.ndarray:
    """Whole inner products, in doubles where their sums can't round and in Python's integers elsewhere."""
    if top < 2**53:
        return np.rint(a @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return (whole(a) @ whole(c).T).astype(np.int64)


def scored(pairs: DataFrame, anchors: DataFrame, tree: Tree, same: bool, most: int) -> DataFrame:
    """(anchor_id, window, score, vec_id): of each anchor's window the best rows of the leaves it is paired with, by score and then id; each pair of leaves is one product."""
    dim = tree.dim

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(k[0], k[1], -s, i) for best in held.values() for k, found in best.items() for s, i in found]
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor_id", "window", "score", "vec_id"])

        for batch in batches:
            for k in range(batch.num_rows):
                get = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                ints = {c: np.frombuffer(get[c], "<i8") for c in ("a_ids", "a_labels", "his", "los", "c_ids", "c_labels")}
                a, c = (np.frombuffer(get[x], "<f8").reshape(-1, dim) for x in ("a_vecs", "c_vecs"))
                his, los = (ints[x].reshape(len(a), -1) for x in ("his", "los"))
                s = _products(a, c, get["a_top"] * get["c_top"] * dim)
                fits = (ints["a_labels"][:, None] == ints["c_labels"]) == same
                fits &= (ints["a_ids"][:, None] != ints["c_ids"]) & (s >= los.min(axis=1, initial=HIGHEST)[:, None]) & (s <= his.max(axis=1, initial=LOWEST)[:, None])
                best = held.setdefault(get["a_block"], {})
                for row in np.flatnonzero(fits.any(axis=1)):
                    at = np.flatnonzero(fits[row])
                    at = at[np.lexsort((ints["c_ids"][at], -s[row, at]))]
                    fall = -s[row, at]
                    for w in range(his.shape[1]):
                        begin, end = np.searchsorted(fall, -his[row, w] if his[row, w] < HIGHEST else LOWEST, "left"), np.searchsorted(fall, -los[row, w] if los[row, w] > LOWEST else HIGHEST, "right")
                        if begin < end:
                            key, take = (int(ints["a_ids"][row]), w), at[begin : min(end, begin + most)]
                            best[key] = sorted([*best.get(key, ()), *zip((-s[row, take]).tolist(), ints["c_ids"][take].tolist(), strict=True)])[:most]
                if len(held) > HELD:
                    yield from flush()
        yield from flush()

    side = lambda df, s, *more: df.select(F.col("block").alias(f"{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "labels", "vecs", "top")], *more)
    met = pairs.join(small(side(anchors, "a", "his", "los")), "a_block").join(side(tree.leaves, "c"), "c_block")
    found = met.mapInArrow(score, "anchor_id long, window int, score long, vec_id long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= most)


def dual_search(anchors: DataFrame, tree: Tree, depth: int, same: bool, most: int) -> DataFrame:
    """(anchor_id, window, score, vec_id, rank): the best rows, most of them, of each window of anchors(vec_id, label, vec, grp, cell, his, los).

    his[w] and los[w] bound the scores of window w. First each anchor leaf looks
    into one leaf of the few cells that lie nearest: where that fills a window,
    the last row found bounds it from below. Then the trees meet.
    """
    cells, dim = tree.cells, tree.dim
    first = written(_packed(anchors, cells, dim, depth, ANCHOR_LEAF), "anchors")
    some = tree.leaves.groupBy("grp", "cell").agg(F.min_by("block", F.struct(-F.col("n"), "block")).alias("c_block"))
    near = nearest_cells(first, tree, same).join(small(some), ["grp", "cell"]).select("a_block", "c_block")
    floors = scored(near, first, tree, same, most).where(F.col("rank") == most).select(F.col("anchor_id").alias("vec_id"), "window", "score")
    floors = cut(floors.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floors")))
    raised = anchors.join(small(floors), "vec_id", "left")
    at_least = lambda lo, w: F.greatest(lo, F.coalesce(F.try_element_at("floors", w), lo))
    raised = raised.withColumn("los", F.when(F.col("floors").isNull(), F.col("los")).otherwise(F.transform("los", at_least))).drop("floors")
    second = written(_packed(raised, cells, dim, depth, ANCHOR_LEAF), "anchors")
    pairs = cut(leaf_pairs(second, tree, node_pairs(second, tree, depth, same)))
    return scored(pairs.repartition("c_block"), second, tree, same, most)


def nearest_cells(anchors: DataFrame, tree: Tree, same: bool, most: int = 4) -> DataFrame:
    """(a_block, grp, cell): the few cells with rows whose centres have the largest products with an anchor leaf's."""
    cells, dim, radii, least, most_label = tree.cells, tree.dim, tree.radii[-1], tree.least, tree.most

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf_centres = cells.at(cells.depth, np.arange(2**cells.depth))
        for batch in batches:
            out = []
            for block, grp, label, centre in zip(batch.column("block").to_pylist(), batch.column("grp").to_pylist(), batch.column("least").to_pylist(), _decoded(batch, "centre", dim) if batch.num_rows else (), strict=True):
                there = radii >= 0
                if same:
                    there &= (np.arange(GROUPS) == grp)[:, None]
                else:
                    there &= ~((np.arange(GROUPS) == grp) & (least == label) & (most_label == label))[:, None]
                worth = np.where(there, (leaf_centres @ centre)[None, :], -np.inf).ravel()
                for k in np.argsort(-worth, kind="stable")[:most]:
                    if worth[k] > -np.inf:
                        out.append((block, int(k) // radii.shape[1], int(k) % radii.shape[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)], ["a_block", "grp", "cell"])

    return anchors.select("block", "grp", "least", "centre").mapInArrow(near, "a_block string, grp int, cell int")


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of embeddings(vec_id, label, embedding).

    usable() tells which rows take part. Anchors are rows whose id is divisible
    by `every`. A score is the whole inner product; higher ones come first, ties
    by the smaller id. An anchor's positives are its best other rows of its
    label; a positive's negatives the best rows of other labels that score no
    more than the positive and no less than four fifths of it (none do where the
    positive's score is below zero). Anchors without positives, and positives
    without negatives, give no rows. Vectors of different lengths are filled up
    with zeros; scores must fit in a long. Other columns are not read; an empty
    table gives no rows. The search is exact: the sample decides only which rows
    lie together.
    """
    rows = written(usable(embeddings), "vectors")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    is_anchor = F.col("vec_id") % every == 0
    n, n_anchors, dim = rows.agg(F.count("*"), F.count_if(is_anchor), F.max(F.size("vec"))).first()
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], empty)
    dim = max(dim, 1)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow().column(0).combine_chunks()
    groups = min(GROUPS, rows.select(F.pmod("label", F.lit(GROUPS)).alias("g")).distinct().count())
    levels = lambda n, leaf: min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / (groups * leaf))))))
    cells = fit_cells(_matrix(sample, dim), levels(n, LEAF))
    depth = min(cells.depth, levels(n_anchors, ANCHOR_LEAF))
    routed = _routed(rows, cells, dim)
    tree = tree_of(routed, cells, dim)
    window = lambda x: F.array(F.lit(x).cast("long"))
    anchors = cut(routed.where(is_anchor)).withColumns({"his": window(HIGHEST), "los": window(LOWEST)})
    found = cut(dual_search(anchors, tree, depth, True, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("window")))
    fifths = lambda s: F.expr(f"{LEAST_FIFTHS} * ({s} div 5) + ({LEAST_FIFTHS} * ({s} % 5) + 4) div 5")
    limits = found.withColumn("lo", fifths("positive_score"))
    wide = limits.where("positive_score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score", "lo"))).alias("w"))
    wide = wide.select(F.col("anchor_id").alias("vec_id"), F.transform("w", lambda x: x["positive_score"]).alias("h"), F.transform("w", lambda x: x["lo"]).alias("l"))
    # Positives stand by falling score, so those below zero are the last and windows keep their numbers. Anchors of a leaf have equally many windows; those that are missing hold nothing.
    filled = lambda c, x: F.concat(c, F.array_repeat(F.lit(x).cast("long"), F.lit(positives) - F.size(c)))
    second = anchors.drop("his", "los").join(small(cut(wide)), "vec_id").select("vec_id", "label", "vec", "grp", "cell", filled(F.col("h"), LOWEST).alias("his"), filled(F.col("l"), HIGHEST).alias("los"))
    hard = dual_search(second, tree, depth, False, negatives)
    out = hard.join(found, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same by scoring every row with every anchor.
ORACLE_SQL = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % {RELABELLED} = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= {NEGATIVES}"""
