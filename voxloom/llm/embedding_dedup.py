"""Near-duplicate embeddings through a product-quantised inverted index.

1. Vectors that are equal, within a label and a dimension, form one node.
2. A bounded random sample of nodes fits coarse centroids, one for each
   inverted list, and codebooks for the subspaces of the residuals.
3. Every node is encoded: its home list, the residual's codes, the length of
   what the codes leave out, and the lists that it has to probe.
4. Lists are packed on shelves of about ``SHELF`` nodes a label, long lists
   cut over several.  A node is stored on one shelf and sent to those shelves
   that hold a list it probes.  There distances come from tables of its
   residual to the codewords, and what these leave possible is settled by the
   cosine in double precision.
5. A shelf returns each node's link count and a spanning forest of its links;
   no pair leaves a task.  Components are found by contraction.

Nothing is lost on the way but by the rounding of the cosine itself.  Let d be
the distance of two unit vectors at the least cosine.  If p lies in another
list than q, the plane between the two lists' centroids separates them, so one
of them is within d / 2 of it: each node probes the lists whose plane is that
near, and one of the two finds the other.  On a shelf, |q - p| is at least
|q - decoded p| less the length that p's codes leave out.  The index may see
fewer coordinates than the vectors have: distances only shrink by that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near_dedup import components
from .storage import stored, tidy

#: Nodes of a shelf, queries of one of its blocks, and queries compared at once.
SHELF, QUERIES, AT_ONCE = 2048, 16_384, 256
#: A table of so many rows at most is broadcast.
BROADCAST_ROWS = 10_000


def unit(values: np.ndarray) -> np.ndarray | None:
    """The vector at length 1; None for one that is empty, zero or not finite throughout."""
    top = np.abs(values).max() if len(values) else 0.0
    if not np.isfinite(top) or top == 0:
        return None
    values = values / top
    return values / np.sqrt(values @ values)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding")
        flat, keys, units, sizes = column.values, [], [], []
        labels, ends = batch.column("label").to_pylist(), column.offsets.to_numpy()
        whole = flat.to_numpy(zero_copy_only=False)  # a null component reads as NaN
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            values = whole[a:b] if column[i].is_valid and labels[i] is not None else whole[:0]
            vector = unit(values)
            # Adding 0.0 makes one of the two zeros.
            keys.append(None if vector is None else blake2b(f"{labels[i]}|".encode() + (values + 0.0).tobytes(), digest_size=16).digest())
            units.append(None if vector is None else vector.tobytes())
            sizes.append(b - a)
        made = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(units, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("label"), *made], names=["row", "vec_id", "label", "node", "dim", "unit"])


@dataclass
class Index:
    dims: int
    centroids: np.ndarray  # lists x dims
    words: np.ndarray  # subspaces x codewords x width

    def seen(self, units: list[bytes]) -> np.ndarray:
        """The coordinates that the index sees: cut or filled with zeros to ``dims``."""
        out = np.zeros((len(units), self.dims))
        for i, raw in enumerate(units):
            v = np.frombuffer(raw, np.float64)[: self.dims]
            out[i, : len(v)] = v
        return out

    def parts(self, residuals: np.ndarray) -> np.ndarray:
        """subspaces x rows x width."""
        m, _, width = self.words.shape
        filled = np.zeros((len(residuals), m * width))
        filled[:, : self.dims] = residuals
        return filled.reshape(len(residuals), m, width).transpose(1, 0, 2)

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """Squared distance of each part of each residual to each codeword: subspaces x rows x codewords."""
        parts = self.parts(residuals)
        return (parts**2).sum(2)[:, :, None] - 2 * parts @ self.words.transpose(0, 2, 1) + (self.words**2).sum(2)[:, None, :]


def _means(points: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """Centroids of the points by Lloyd's rounds from ``k`` of them; equal ones count once."""
    found = points[np.sort(random.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        near = (2 * points @ found.T - (found**2).sum(1)).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(found))
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return np.unique(found, axis=0)


def fit(units: list[bytes], lists: int, subspaces: int, codewords: int, rounds: int = 6, seed: int = 5) -> Index:
    """An index for vectors like ``units``, over as many coordinates as most of them have."""
    sizes, counts = np.unique([len(u) // 8 for u in units], return_counts=True)
    dims = int(sizes[counts.argmax()])
    random = np.random.default_rng(seed)
    index = Index(dims, np.zeros((1, dims)), np.zeros((subspaces, 1, -(-dims // subspaces))))
    points = index.seen(units)
    index.centroids = _means(points, lists, rounds, random)
    near = (2 * points @ index.centroids.T - (index.centroids**2).sum(1)).argmax(1)
    books = [_means(p, codewords, rounds, random) for p in index.parts(points - index.centroids[near])]
    # Books are filled up to one length with their last word.
    most = max(map(len, books))
    index.words = np.stack([np.concatenate([b, np.repeat(b[-1:], most - len(b), axis=0)]) for b in books])
    return index


def probed(points: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home list of each point, and which lists are within ``reach`` beyond the plane between the home's centroid and theirs."""
    far = (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)
    home = far.argmin(1)
    apart = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(2))
    np.fill_diagonal(apart, 1.0)
    return home, (far - far[np.arange(len(points)), home][:, None]) <= 2 * apart[home] * (reach + 1e-9)


def _encoded(index: Index, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = index.seen(batch.column("unit").to_pylist())
            home, near = probed(points, index.centroids, reach)
            residuals = points - index.centroids[home]
            codes = index.tables(residuals).argmin(2)
            decoded = index.words[np.arange(len(codes))[:, None], codes]
            left = np.sqrt(((index.parts(residuals) - decoded) ** 2).sum((0, 2)))
            near[np.arange(len(home)), home] = False
            made = [
                pa.array(home, pa.int32()),
                pa.array([np.flatnonzero(n).tolist() for n in near], pa.list_(pa.int32())),
                pa.array([c.tobytes() for c in codes.T.astype(np.uint8)], pa.binary()),
                pa.array(left, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "home", "probes", "codes", "lost"])

    return run


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of ``root`` that the links a - b connect; every root is its tree's smallest place."""
    while len(a):
        x, y = root[a], root[b]
        on = x != y
        a, b, x, y = a[on], b[on], x[on], y[on]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def compare(index: Index, least: float, rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """Link counts of the rows of one block of a shelf, and each row's root among their links.

    ``rows``: node, copies, home, probes, codes, lost, unit, kind (0: stored, 1: queries, 2: both).
    """
    node, copies, home, kind = (np.array(rows[k]) for k in ("node", "copies", "home", "kind"))
    n, reach = len(node), math.sqrt(max(0.0, 2 - 2 * least))
    units = np.stack([np.frombuffer(u, np.float64) for u in rows["unit"]])
    points = index.seen(rows["unit"])
    near = np.zeros((n, len(index.centroids)), bool)
    for i, lists in enumerate(rows["probes"]):
        near[i, lists] = True
    codes = np.stack([np.frombuffer(c, np.uint8) for c in rows["codes"]])
    within = (reach + np.array(rows["lost"]) + 1e-5) ** 2
    links, root = np.zeros(n, np.int64), np.arange(n)
    for at in np.unique(home[kind != 1]):
        held = np.flatnonzero((kind != 1) & (home == at))
        asking = np.flatnonzero((kind != 0) & ((home == at) | near[:, at]))
        for i in range(0, len(asking), AT_ONCE):
            some = asking[i : i + AT_ONCE]
            tables = index.tables(points[some] - index.centroids[at]).astype(np.float32)
            far = np.zeros((len(some), len(held)), np.float32)
            for table, code in zip(tables, codes[held].T, strict=True):
                far += table[:, code]
            # A pair whose ends both meet the other's list is taken by the smaller node's query.
            both = (home[some] == at)[:, None] | near[held][:, home[some]].T
            q, p = np.nonzero((far <= within[held]) & (~both | (node[some][:, None] < node[held])) & (node[some][:, None] != node[held]))
            for k in range(0, len(q), 1 << 16):
                a, b = some[q[k : k + (1 << 16)]], held[p[k : k + (1 << 16)]]
                on = np.einsum("ij,ij->i", units[a], units[b]) >= least
                a, b = a[on], b[on]
                links += np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
                merge(root, a, b)
    return links, root


_FIELDS = ("node", "copies", "home", "probes", "codes", "lost", "unit", "kind")


def _linked(index: Index, least: float):
    """Rows sorted by block -> node, links, other (a node it is linked with, directly or over others of the block)."""

    def settled(rows: dict[str, list]) -> pa.RecordBatch:
        links, root = compare(index, least, rows)
        node, on = np.array(rows["node"], np.int64), links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(links[on]), pa.array(node[root[on]])], names=["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = {k: [] for k in _FIELDS}, None
        for batch in batches:
            names = batch.column("block").to_pylist()
            columns = {k: batch.column(k).to_pylist() for k in _FIELDS}
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if block is not None and names[a] != block:
                    yield settled(held)
                    held = {k: [] for k in _FIELDS}
                block = names[a]
                for k in _FIELDS:
                    held[k] += columns[k][a:b]
        if block is not None:
            yield settled(held)

    return run


def _joined(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``few`` is broadcast when a count shows that it is short."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


def _blocks(coded: DataFrame) -> DataFrame:
    """The rows of ``coded`` as often as blocks need them, with ``block`` and ``kind``."""
    group = ["label", "dim"]
    over = Window.partitionBy(*group).orderBy("home")
    sizes = coded.groupBy(*group, "home").agg(F.count("*").alias("n"))
    # Lists follow each other on shelves; a long one has shelves of its own.  A window holds one row a list.
    sizes = sizes.withColumn("long", F.ceil(F.col("n") / SHELF).cast("int")).withColumn("few", F.when(F.col("long") == 1, F.col("n")).otherwise(0))
    sizes = sizes.withColumn("first", F.floor((F.sum("few").over(over) - F.col("few")) / SHELF).cast("int"))
    sizes = sizes.withColumn("first", F.when(F.col("long") > 1, -F.sum(F.when(F.col("long") > 1, F.col("long")).otherwise(0)).over(over).cast("int")).otherwise(F.col("first")))
    shelf = F.map_from_entries(F.collect_list(F.struct("home", F.struct("first", "long").alias("at")))).alias("shelf")
    shelves = stored(sizes.groupBy(*group).agg(shelf), "shelves")
    rows = _joined(coded, shelves, group)
    at = lambda k: F.element_at("shelf", k)
    mine = (at(F.col("home"))["first"] + F.pmod(F.xxhash64("node"), at(F.col("home"))["long"])).cast("int")
    # Lists without a node have no shelf.
    all_of = lambda k: F.when(at(k).isNotNull(), F.sequence(at(k)["first"], at(k)["first"] + at(k)["long"] - 1)).otherwise(F.array().cast("array<int>"))
    visited = F.array_distinct(F.flatten(F.transform(F.concat("probes", F.array("home")), all_of)))
    rows = rows.withColumn("mine", mine).withColumn("visited", visited).drop("shelf")
    asked = rows.select(*group, F.explode("visited").alias("at")).groupBy(*group, "at").agg(F.count("*").alias("n"))
    busy = stored(asked.where(f"n > {QUERIES}").select(*group, "at", F.ceil(F.col("n") / QUERIES).cast("int").alias("cuts")), "busy")
    rows = _joined(rows.withColumn("at", F.explode("visited")).drop("visited"), busy, [*group, "at"], "left")
    cuts = F.coalesce("cuts", F.lit(1))
    turn = F.pmod(F.xxhash64("node", F.lit("turn")), cuts).cast("int")
    blocks = F.when(F.col("at") == F.col("mine"), F.sequence(F.lit(0), cuts - 1)).otherwise(F.array(turn))
    rows = rows.withColumn("turn", turn).withColumn("part", F.explode(blocks))
    kind = F.when(F.col("at") != F.col("mine"), 1).when(F.col("part") == F.col("turn"), 2).otherwise(0)
    block = F.concat_ws("|", "dim", "at", "part", F.col("label").cast("string"))
    return rows.select(block.alias("block"), "node", "copies", "home", "probes", "codes", "lost", "unit", kind.cast("int").alias("kind"))


@tidy
def near_vectors(vectors: DataFrame, least: float = 0.93, lists: int = 64, subspaces: int = 16, codewords: int = 64, sample: int = 20_000) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, label, embedding).

    Two rows are linked when their labels are equal and not null, their
    vectors have equally many components and a cosine of ``least`` or more.
    Vectors that are null, empty, zero, or hold null or non-finite components
    are linked with nothing.  ``n_links`` counts linked rows, equal vectors
    included; ``component_id`` is the smallest vec_id reachable, and ``kept``
    marks the rows that bear it.  Rows are nodes of their own, whatever their
    ids; a null id names a component only if all its ids are null.  Other
    columns are ignored; an empty table gives an empty result.

    ``sample`` bounds the nodes that fit the index; all nodes are encoded.
    """
    labels = F.col("label").cast("string").alias("label")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), labels, F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows.mapInArrow(_prepared, "row long, vec_id long, label string, node binary, dim int, unit binary"), "units")
    stays = F.min(F.struct(F.col("vec_id").isNull().alias("no"), "vec_id")).alias("stays")
    equal = stored(rows.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.count("*").alias("copies"), stays), "equal")
    nodes = rows.select("row", "node", "label", "dim", "unit").join(equal.select("node", "row", "copies"), ["node", "row"])
    nodes = stored(nodes.select(F.col("row").alias("node"), "copies", "label", "dim", "unit"), "nodes")

    share = min(1.0, 1.2 * sample / max(1, nodes.count()))
    picked = nodes.where(F.pmod(F.xxhash64("unit", "label"), F.lit(1 << 30)) < int(share * (1 << 30))).select("node", "unit").collect()
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    if picked:
        index = fit([bytes(r["unit"]) for r in sorted(picked, key=lambda r: r["node"])[:sample]], lists, subspaces, codewords)
    else:
        # So few nodes that none was picked: one list, one word.
        index = Index(1, np.zeros((1, 1)), np.zeros((subspaces, 1, 1)))
    kinds = "node long, copies long, label string, dim int, unit binary, home int, probes array<int>, codes binary, lost double"
    coded = stored(nodes.mapInArrow(_encoded(index, reach / 2), kinds), "coded")
    blocks = _blocks(coded).repartition("block").sortWithinPartitions("block")
    found = stored(blocks.mapInArrow(_linked(index, least), "node long, links long, other long"), "links")

    classes = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = equal.select(F.col("node").alias("key"), F.col("row").alias("node"), "copies", "stays").join(links, "node", "left").join(classes, "node", "left")
    named = stored(named.select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "node").alias("class"), "stays"), "named")
    ids = stored(named.groupBy("class").agg(F.min("stays").alias("least")), "ids")
    named = stored(named.join(ids, "class").select(F.col("key").alias("node"), (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("least.vec_id").alias("least")), "components")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    named_by = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), named_by.alias("component_id"))
    return stored(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "near_vectors")
