"""Near-duplicate classes by an LSH forest of MinHash signatures.

1. Each text becomes the set of its word shingles and a signature of 512
   minima, read as 64 orders of 8 levels.  Texts with equal sets form one node,
   whatever their number.
2. Nodes are sorted by signature in each of the first 16 orders, over ranges
   that follow each other.  Nodes next to each other have the longest common
   prefixes; where these reach 4 levels the two are candidates, also over the
   edge of a range.  Candidates are confirmed on whole shingle sets and
   confirmed links contracted to classes.
3. Nodes with a common prefix of 4 levels form a region.  Where a region still
   holds several classes, its pairs of different classes are candidates as
   well, so step 2 leaves out links inside a class and none between classes.
4. Depth adapts to the region: one with more than ``REGION`` nodes is compared
   at 8 levels instead, in all 64 orders: first each node with the partner of
   the largest estimate, then all pairs of classes that are left.  What is
   crowded at 8 levels too is compared by pairs of blocks.

A pair whose similarity is s shares a region at 4 levels of 16 orders with
probability 1 - (1 - s**4)**16 and at 8 levels of 64 with 1 - (1 - s**8)**64:
at s = 0.85 all but 8e-6 and 2e-9, at s = 0.8 all but 3e-4 and 8e-6.  Its
estimate passes the filter (3.5 standard deviations below the threshold) with
0.9998.

Null or wordless texts are their own class; repeated rows share a node; a null
doc_id takes part and is never a class's name unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .storage import documents, fetch, stored, tidy

HASHES, LEVELS, LEAST_LEVELS, REGION = 512, 8, 4, 2048
#: Orders that are sorted and compared at LEAST_LEVELS, and those compared at LEVELS.
ORDERS, DEEP_ORDERS = 16, HASHES // LEVELS
_XOR = kernels.constants(HASHES, 5).astype(np.uint32)
_MUL = kernels.constants(HASHES, 6).astype(np.uint32) | np.uint32(1)


def node_id(shingles: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> bytes:
    """512 minima of 16 bits: 8 levels for each of 64 orders."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, ((x[None, i : i + 256] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=least)
    return kernels.mix(least.astype(np.uint64)).astype(">u2").tobytes()


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernels.slices(batch.column("text")):
                sets = kernels.shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(sets)),
                        batch.column("row").slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([node_id(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "row", "n_shingles", "node", "sig"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in kernels.slices(batch.column("text")):
                shingles = [s.tobytes() for s in kernels.shingle_sets(texts, width)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(texts)), pa.array(shingles, pa.binary())], names=["node", "shingles"])

    return run


def _neighbours(percent: int):
    """Rows of one range in the order of (tree, key, node): what has a neighbour with a common prefix, and the range's two ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined, begun = None, False, False

        def made(rows: pa.RecordBatch, after: np.ndarray, before: np.ndarray, edge: np.ndarray, follower: pa.RecordBatch) -> pa.RecordBatch:
            n, m = (x.column("n_shingles").to_numpy() for x in (rows, follower))
            near = after & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            following = pa.compute.if_else(pa.array(near), follower.column("node"), pa.scalar(None, pa.binary()))
            out = rows.append_column("next", following).append_column("edge", pa.array(edge))
            return out.filter(pa.array(after | before | edge))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            tree = rows.column("tree").to_numpy()
            start = np.frombuffer(b"".join(rows.column("key").to_pylist()), ">u8").reshape(-1, 2)[:, 0]
            after = (tree[1:] == tree[:-1]) & (start[1:] == start[:-1])
            before = np.concatenate([[joined], after])
            if len(after):
                edge = np.zeros(len(after), bool)
                edge[0] = not begun
                begun = True
                yield made(rows.slice(0, len(after)), after, before[:-1], edge, rows.slice(1))
            held, joined = rows.slice(len(after)), bool(before[-1])
        if held is not None:
            yield made(held, np.zeros(1, bool), np.array([joined]), np.ones(1, bool), held)

    return run


@dataclass
class Region:
    nodes: list[bytes]
    sketch: np.ndarray  # minima of 8 bits, one row a node
    sizes: np.ndarray  # of the shingle sets
    classes: list[bytes]
    starts: np.ndarray  # the prefixes in all orders, hashed, one row a node
    sides: np.ndarray  # 0 and 1 in a pair of blocks; -1 where all nodes meet
    trees: np.ndarray  # the order that brought the node here


def _regions(levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[Region]:
    """Whole regions of sorted rows."""
    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("region", "node", "sig", "n_shingles", "class", "side", "tree")]
        for row in zip(*columns, strict=True):
            if held and held[0][0] != row[0]:
                yield _region(levels, held)
                held = []
            held.append(row)
    if held:
        yield _region(levels, held)


def _region(levels: int, rows: list[tuple]) -> Region:
    raw = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
    halves = raw.view(np.uint64).reshape(len(rows), DEEP_ORDERS, 2)
    starts = halves[:, :ORDERS, 0] if levels == LEAST_LEVELS else kernels.mix(halves[:, :, 0]) ^ halves[:, :, 1]
    return Region([r[1] for r in rows], raw[:, 1::2], np.array([r[3] for r in rows]), [r[4] for r in rows], starts, np.array([r[5] for r in rows]), np.array([r[6] for r in rows]))


def _estimates(sig: np.ndarray, sizes: np.ndarray, i: int, rest: np.ndarray, percent: int) -> np.ndarray:
    """Estimated similarity of node i to the others; 0 where sizes alone rule a link out."""
    est = (sig[rest] == sig[i]).mean(axis=1)
    low, high = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
    return np.where(100 * low >= percent * high, est, 0.0)


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.binary()), pa.array([max(p) for p in found], pa.binary())], names=["a", "b"])


def _across(percent: int, floor: float, levels: int, best: bool = False):
    """All pairs of a region whose ends are in different classes, each in the first order where they meet.

    With ``best``, of each node's pairs only that of the largest estimate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for r in _regions(levels, batches):
            nodes, sig, sizes = r.nodes, r.sketch, r.sizes
            names = {c: k for k, c in enumerate(dict.fromkeys(r.classes))}
            if len(names) == 1:
                continue
            of = np.array([names[c] for c in r.classes])
            for i in range(len(nodes) - 1):
                meet = (of[i + 1 :] != of[i]) & (r.trees[i + 1 :] == r.trees[i]) & ((r.sides[i + 1 :] != r.sides[i]) | (r.sides[i] < 0))
                rest = i + 1 + np.flatnonzero(meet)
                if not best:
                    rest = rest[~(r.starts[rest, : r.trees[i]] == r.starts[i, : r.trees[i]]).any(axis=1)]
                if len(rest):
                    est = _estimates(sig, sizes, i, rest, percent)
                    near = est >= floor
                    if best:
                        near &= np.arange(len(rest)) == est.argmax()
                    out += [(nodes[i], nodes[j]) for j in rest[near]]
                if len(out) > 50_000:
                    yield _pairs(out)
                    out = []
        yield _pairs(out)

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


@tidy
def components(links: DataFrame) -> DataFrame:
    """(node, class) for every end of ``links`` (a, b): class is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, halves the paths
    twice and contracts the links, so a chain of n nodes takes about log n
    rounds.  Rounds work on what is left of the links, written to the shared folder.
    """
    links = stored(links.where("a <> b"), "links")
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b"))).distinct()
    named = stored(ends.select("node", F.col("node").alias("class")), "classes")
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        up = stored(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y")).select("x", F.least("x", "y").alias("y")), "hooks")
        for _ in range(2):
            up = up.join(up.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left").select("x", F.coalesce("z", "y").alias("y"))
        up = stored(up, "hooks")
        a, b = up.select(F.col("x").alias("a"), F.col("y").alias("na")), up.select(F.col("x").alias("b"), F.col("y").alias("nb"))
        links = links.join(a, "a").join(b, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
        links = stored(links.distinct(), "links")
        named = stored(named.join(up.select(F.col("x").alias("class"), "y"), "class", "left").select("node", F.coalesce("y", "class").alias("class")), "classes")
    return named


def _orders(nodes: DataFrame, percent: int) -> DataFrame:
    """(tree, key, node, n_shingles, next, edge) of nodes that share 4 levels with a neighbour in one of the sorted orders.

    Orders are cut into ranges by (tree, key, node), so equal signatures do not
    meet in one task; ``edge`` marks each range's first and last row.
    """
    tree = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("tree")
    rows = nodes.select("node", "n_shingles", "start", tree)
    rows = rows.select("tree", F.expr(f"substring(start, tree * {2 * LEVELS} + 1, {2 * LEVELS})").alias("key"), "node", "n_shingles")
    rows = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    shape = "tree int, key binary, node binary, n_shingles long, next binary, edge boolean"
    return stored(rows.mapInArrow(_neighbours(percent), shape).withColumn("start", F.substring("key", 1, 2 * LEAST_LEVELS)), "orders")


def _neighbour_pairs(orders: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of neighbours, those over the edges of ranges included."""
    over = Window.partitionBy("tree", "start").orderBy("key", "node")
    edges = orders.where("edge").withColumn("next", F.lead("node").over(over)).withColumn("m", F.lead("n_shingles").over(over))
    edges = edges.where(f"100 * least(n_shingles, m) >= {percent} * greatest(n_shingles, m)")
    pairs = orders.select("node", "next").where("next is not null").unionByName(edges.select("node", "next"))
    return pairs.select(F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b")).distinct()


@tidy
def _open_regions(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(region, node, tree, class, members) of the regions in ``rows`` (region, node, tree) that hold several classes."""
    rows = stored(rows.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "regions")
    sizes = rows.groupBy("region").agg(F.count("*").alias("members"), F.min("class").alias("least"), F.max("class").alias("most"))
    sizes = stored(sizes.where("least <> most").select("region", "members"), "sizes")
    return stored(rows.join(sizes, "region"), "open")


@tidy
def _block_pairs(crowded: DataFrame) -> DataFrame:
    """(region, node, tree, class, side) of crowded regions' rows (region, node, tree, class), dealt to pairs of blocks.

    A block holds about half of ``REGION`` nodes.  A class with more has blocks
    of its own, which meet all blocks but those of the same class; the other
    blocks meet all.  Regions of a single class have no pair to compare.
    """
    half = max(1, REGION // 2)
    sizes = stored(crowded.groupBy("region", "class").agg(F.count("*").alias("n")), "sizes")
    own = F.struct("class", F.ceil(F.col("n") / half).cast("int").alias("blocks"))
    regions = sizes.groupBy("region").agg(
        F.count("*").alias("classes"),
        F.ceil(F.sum(F.when(F.col("n") <= half, F.col("n")).otherwise(0)) / half).cast("int").alias("shared"),
        F.array_sort(F.collect_list(F.when(F.col("n") > half, own))).alias("own"),
    )
    regions = regions.where("classes > 1").drop("classes")
    # The owner of each block: -1 for shared ones, else the place of its class in ``own``.
    regions = stored(regions.withColumn("owners", F.expr("concat(array_repeat(-1, shared), flatten(transform(own, (o, k) -> array_repeat(k, o.blocks))))")), "blocks")
    rows = crowded.join(regions, "region").withColumn("owner", F.expr("cast(array_position(transform(own, o -> o.class), class) as int) - 1"))
    first = F.expr("if(owner < 0, 0, cast(array_position(owners, owner) as int) - 1)")
    count = F.expr("if(owner < 0, shared, own[greatest(owner, 0)].blocks)")
    rows = rows.withColumn("block", first + F.pmod(F.xxhash64("node"), count).cast("int"))
    others = F.expr("filter(sequence(0, size(owners) - 1), k -> owner < 0 or owners[k] <> owner)")
    rows = rows.select("region", "node", "tree", "class", "block", F.explode(others).alias("other"))
    side = F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int"))
    return rows.select(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "node", "tree", "class", side.alias("side"))


@tidy
def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Links two texts when 100 * shared shingles >= percent * all shingles.
    ``component_id`` is the smallest doc_id reachable, ``kept`` marks it.
    ``row`` names a column of stored, distinct longs: it comes back as
    ``row``, and ``kept`` marks one row of each class.
    Any further columns of ``docs`` are ignored; an empty table gives an empty result.
    """
    docs = documents(docs, row)
    signed = stored(docs.mapInArrow(_signed(width), "doc_id long, row long, n_shingles long, node binary, sig binary"), "signatures")
    firsts = signed.where("node is not null").groupBy("node").agg(F.min("row").alias("row"))
    # Of a signature, what the sorted orders read; the whole of it is fetched for the few nodes that are compared again.
    heads = signed.select("row", "node", "n_shingles", F.substring("sig", 1, 2 * LEVELS * ORDERS).alias("start"))
    heads = stored(heads.join(firsts, ["node", "row"]), "nodes")
    floor = percent / 100 - 3.5 * (percent / 100 * (1 - percent / 100) / HASHES) ** 0.5

    orders = _orders(heads, percent)
    tried = stored(_neighbour_pairs(orders, percent), "neighbours")
    # A lone end of a range is no region, and goes with the regions of one class.
    regions = orders.select(F.xxhash64("tree", "start").alias("region"), "node", "tree")
    wanted = stored(heads.select("row", "node").join(regions.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = fetch(docs, wanted, ["text"]).select("node", "text")
    sets = stored(sets.mapInArrow(_sets(width), "node binary, shingles binary"), "sets", "none")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        return stored(pairs.mapInArrow(_confirmed(percent), "a binary, b binary"), "confirmed")

    def signatures(nodes: DataFrame) -> DataFrame:
        rows = stored(heads.select("row", "node", "n_shingles").join(nodes.select("node").distinct(), "node", "left_semi"), "compared")
        return stored(fetch(signed, rows, ["sig"]).select("node", "n_shingles", "sig"), "sketches", "none")

    def across(members: DataFrame, sketches: DataFrame, levels: int, best: bool = False) -> DataFrame:
        rows = members.join(sketches, "node")
        rows = rows.select("region", "node", "sig", "n_shingles", "class", "side", "tree").repartition("region").sortWithinPartitions("region", "node")
        return stored(rows.mapInArrow(_across(percent, floor, levels, best), "a binary, b binary").distinct(), "candidates")

    linked = confirm(tried)
    classes = components(linked)
    members = _open_regions(regions, classes)
    sketches = signatures(members)
    met = across(members.where(f"members <= {REGION}").withColumn("side", F.lit(-1)), sketches, LEAST_LEVELS).join(tried, ["a", "b"], "left_anti")
    more = confirm(met)
    if not more.isEmpty():
        linked = linked.unionByName(more)
        classes = components(linked)
    crowd = members.where(f"members > {REGION}").select("node").distinct()
    if not crowd.isEmpty():
        deep = sketches.join(crowd, "node", "left_semi").select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(DEEP_ORDERS - 1))).alias("tree"))
        deep = deep.select(F.xxhash64(F.lit("deep"), "tree", F.expr(f"substring(sig, tree * {2 * LEVELS} + 1, {2 * LEVELS})")).alias("region"), "node", "tree")
        # First each node's best partner, so that few classes are left when all pairs across them are taken.
        for best in (True, False):
            members = _open_regions(deep, classes)
            met = members.where(f"members <= {REGION}").select("region", "node", "tree", "class", F.lit(-1).alias("side"))
            still = members.where(f"members > {REGION}").drop("members")
            if not still.isEmpty():
                met = met.unionByName(_block_pairs(still))
            more = stored(across(met, sketches, LEVELS, best).join(tried, ["a", "b"], "left_anti"), "tried")
            tried, more = tried.unionByName(more), confirm(more)
            if not more.isEmpty():
                linked = linked.unionByName(more)
                classes = components(linked)

    # Ids are gathered by node, then by class, and joined as stored tables, so that a large class can be dealt out.
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("stays")
    nodes = signed.where("node is not null").groupBy("node").agg(stays).join(classes, "node", "left")
    nodes = stored(nodes.select("node", F.coalesce("class", "node").alias("class"), "stays"), "named")
    ids = stored(nodes.groupBy("class").agg(F.min("stays").alias("stays")), "ids")
    nodes = stored(nodes.select("node", "class").join(ids, "class").select("node", F.col("stays.doc_id").alias("least"), F.col("stays.row").alias("stays")), "kept")
    out = signed.select("doc_id", "row", "n_shingles", "node").join(nodes, "node", "left")
    alone = F.col("node").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("least")))
    if row is None:
        out = out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    else:
        out = out.select("doc_id", "n_shingles", "component_id", (alone | (F.col("row") == F.col("stays"))).alias("kept"), "row")
    return stored(out, "near_duplicates")
