"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct word shingles (ASCII lower case). Its signature has
``trees * depth`` MinHash values; each tree has a path of its own ``depth`` values.

1. Sets: one pass gives set size, a 128-bit hash of the set, and the signature. Equal
   sets are one node (a partial aggregation), so copies count once from here on.
2. Regions: the paths of every tree are sorted, and the common prefix of neighbours is
   measured. Neighbours that share ``min_depth`` values or more are in one region; its own
   depth is the least common prefix in it, and of regions with the same members the deepest
   stays. Most nodes share less with both neighbours and are done. A crowded region is not
   made deeper, which would lose links, but cut into blocks that meet in pairs.
3. Links: the full sets of a region meet, and every pair is counted exactly over an
   inverted list. A region of more than ``block`` sets is cut by a hash of the node into
   parts of about ``block`` sets, however alike their signatures are, and the parts then
   meet in pairs; no task holds more than two parts. What leaves a task are spanning
   links only, never all pairs.
4. Classes: connected components over the links, and of equal sets.

A link is lost only if its ends share no region in any tree and no chain of other links
joins them: with 16 trees the depth is chosen so that this chance is below 2e-5 for a
lone pair just at the threshold (depth 4 at 0.85, 3 at 0.8), and less above it.

Defined results: texts with fewer words than a shingle are one shingle of all their
words; null, empty and blank texts have an empty set and stand alone; rows that repeat
an id are one document, with the links of all its texts; a null id stands alone. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import hashing as H
from shelfmark.llm.components import components
from shelfmark.llm.frames import GROUP_BYTES, row_slabs, stored, text_bytes, texts, total_bytes

TREES, DEPTH = 16, 8
#: Chance to lose a lone pair that is just similar enough.
MISS = 2e-5
#: Sets that one block of a region holds, about.
BLOCK = 1500
#: Bytes of sets that are sent on at once.
MEMBER_BYTES = 8 << 20
_RNG = np.random.default_rng(97)
_A = (_RNG.integers(1, 1 << 32, TREES * DEPTH, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by row and the sorted distinct shingle hashes of each row."""
    offsets, data = text_bytes(column)
    data = H.LOWER[data]
    start, end, doc = H.words(data, offsets)
    word = H.word_hashes(data, start, end)
    rows = len(offsets) - 1
    count = np.bincount(doc, minlength=rows)
    h = H.mix(H.windows(word, shingle))
    whole = doc[: len(h)] == doc[shingle - 1 : shingle - 1 + len(h)]
    h, owner = h[whole], doc[: len(whole)][whole]
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        base = np.searchsorted(doc, short)
        own = [H.mix(H.windows(word[b : b + n], int(n)) + np.uint64(n)) for b, n in zip(base, count[short])]
        h, owner = np.concatenate((h, *own)), np.concatenate((owner, short))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return np.searchsorted(owner, np.arange(rows + 1)), h


def signatures(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """MinHash values of each row's set; rows of empty sets are all ones."""
    size = np.diff(offsets)
    out = np.full((len(size), len(_A)), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    low = (h >> np.uint64(32)).astype(np.uint32)
    step = 1 << 15
    for a, b in _pieces(offsets[full], offsets[full + 1], step):
        rows = full[a:b]
        lo = offsets[rows[0]]
        part, heads = low[lo : offsets[rows[-1] + 1]], offsets[rows] - lo
        for k in range(len(_A)):
            out[rows, k] = np.minimum.reduceat(part * _A[k] + _B[k], heads)
    return out


def _pieces(begin: np.ndarray, end: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + size, "right")))
        yield a, b
        a = b


def set_hashes(offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set."""
    sums = []
    for salt in (3, 5):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(H.mix(h * np.uint64(salt) + np.uint64(salt)), out=total[1:])
        sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return sums[0], sums[1]


_SETS = "doc long, n long, one long, two long, signature binary"


def _sets(shingle: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slabs(batch.column(1)):
                offsets, h = shingle_sets(batch.column(1).slice(a, b - a), shingle)
                mark = signatures(offsets, h)
                sums = [pa.array(x, pa.int64()) for x in set_hashes(offsets, h)]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(offsets), pa.int64()),
                        *sums,
                        pa.array([m.tobytes() for m in mark], pa.binary()),
                    ],
                    names=["doc", "n", "one", "two", "signature"],
                )

    return fn


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per tree: the tree and the path of the node in it, in bytes that sort as its values do."""
    for batch in batches:
        mark = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(batch) * TREES, DEPTH)
        yield pa.record_batch(
            [
                pa.array(np.tile(np.arange(TREES), len(batch)), pa.int32()),
                pa.array([r.tobytes() for r in mark.astype(">u4")], pa.binary()),
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), TREES), pa.int64()),
            ],
            names=["tree", "path", "node"],
        )


def _neighbours(min_depth: int):
    """Of sorted paths those that share ``min_depth`` values with a neighbour, with their region and depth.

    The last row waits for its right neighbour. The first and the last row of a partition
    are kept, as their neighbours lie in others.
    """

    def rows(tree: np.ndarray, path: np.ndarray, node: np.ndarray, depth: np.ndarray) -> pa.RecordBatch:
        region = np.zeros(len(node), np.uint64)
        for k in range(min_depth):
            region = H.mix(region * H.BASE[0] + path[:, k] + np.uint64(1))
        region = H.mix(region + tree.astype(np.uint64) * H.BASE[1]).view(np.int64)
        return pa.record_batch([pa.array(node, pa.int64()), pa.array(region, pa.int64()), pa.array(depth, pa.int32())], names=["node", "region", "depth"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            tree, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            path = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint64)
            before = min_depth  # the neighbour in the partition before is not known
            if held is not None:
                tree, path, node = (np.concatenate(x) for x in zip(held[:3], (tree, path, node)))
                before = held[3]
            same = (path[1:] == path[:-1]) & (tree[1:] == tree[:-1])[:, None]
            common = np.logical_and.accumulate(same, axis=1).sum(axis=1)
            left = np.append(before, common)
            depth = np.maximum(left[:-1], common)
            near = np.flatnonzero(depth >= min_depth)
            yield rows(tree[near], path[near], node[near], depth[near])
            held = tree[-1:], path[-1:], node[-1:], int(left[-1])
        if held is not None:
            yield rows(*held[:3], np.array([max(held[3], min_depth)]))

    return fn


def forest_regions(nodes: DataFrame, min_depth: int) -> DataFrame:
    """``node, region, members, depth`` of every region with two sets at least, once for equal members.

    The paths of all trees are sorted; neighbours with a common prefix of ``min_depth``
    values or more are in one region, whose own depth is the least among its neighbours.
    """
    paths = nodes.select("node", "signature").mapInArrow(_paths, "tree int, path binary, node long")
    order = ["tree", "path", "node"]
    paths = paths.repartitionByRange(*order).sortWithinPartitions(*order)
    near = stored(paths.mapInArrow(_neighbours(min_depth), "node long, region long, depth int"), "neighbours")
    crowd = near.groupBy("region").agg(
        F.count("*").alias("members"),
        F.min("depth").alias("depth"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("one"),
        F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("two"),
    )
    # of regions with the same members one is enough: the deepest
    crowd = crowd.filter("members > 1").groupBy("members", "one", "two").agg(F.max(F.struct("depth", "region")).alias("r"))
    return near.drop("depth").join(crowd.select("r.region", "members", "r.depth"), "region")


def depth_for(percent: int) -> int:
    """The longest common prefix that may be asked for without missing more than ``MISS``."""
    fits = [d for d in range(1, DEPTH) if (1 - (percent / 100) ** d) ** TREES <= MISS]
    return max(fits, default=1)


class _Joined:
    """Union-find over local numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _products(
    which: np.ndarray, owner: np.ndarray, shared: np.ndarray, n: int, rows: int, room: int = 1 << 22
) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes of the intersections of the first ``rows`` sets with all, by matrix products over slices of the shingles.

    They come as bands of rows, each with its first row; no matrix has more than about
    ``room`` entries.
    """
    place = np.cumsum(shared) - 1
    use = shared[which]
    column, row = place[which[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    high = step = max(1, min(4096, room // n))
    for top in range(0, rows, high):
        end = min(rows, top + high)
        out = np.zeros((end - top, n), np.float32)
        for at in range(0, int(shared.sum()), step):
            a, b = np.searchsorted(column, [at, at + step])
            part = np.zeros((n, step), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            out += part[top:end] @ part.T
        yield top, out


def spanning_links(sets: list[np.ndarray], split: int, part: int, whole: int) -> list[tuple[int, int]]:
    """Links that join what any link joins: ``part * union <= whole * intersection``.

    The first ``split`` sets are one block, the others a second; pairs inside one block
    are compared only if there is no second. The intersections of a set with all others
    are counted at once over the inverted list.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    _, first, count = np.unique(flat, return_index=True, return_counts=True)
    # each list is a slice of `owner`
    which = np.empty(len(flat), np.int64)
    which[order] = np.repeat(np.arange(len(first)), count)
    starts = np.concatenate(([0], np.cumsum(size)))
    shared = count > 1
    joined, links = _Joined(n), []
    first_last = split if split < n else n
    bands = band = None
    # where most sets hold most shingles, a product of matrices counts faster than lists do
    if (count[shared].astype(np.float64) ** 2).sum() > n * n * shared.sum() / 16 and n > 64:
        bands = _products(which, np.repeat(np.arange(n), size), shared, n, first_last)
    for x in range(first_last):
        if bands is not None:
            if band is None or x >= top + len(band):
                band = None  # let go before the next one is made
                top, band = next(bands)
            both = band[x - top].astype(np.int64)
        else:
            mine = which[starts[x] : starts[x + 1]]
            mine = mine[shared[mine]]
            if not len(mine):
                continue
            length = count[mine]
            ends = np.cumsum(length)
            at = np.repeat(first[mine] - (ends - length), length) + np.arange(ends[-1])
            both = np.bincount(owner[at], minlength=n)
        near = np.flatnonzero(whole * both >= part * (size[x] + size - both))
        near = near[near >= split] if split < n else near[near > x]
        for y in near:
            if joined.join(x, int(y)):
                links.append((x, int(y)))
    return links


def placed_in_blocks(regions: DataFrame, block: int, pools: int) -> DataFrame:
    """``node, place`` of every region member: its task, and its block among those of the region.

    The block is a hash of the node, so that blocks stay about even where all signatures agree.
    """
    blocks = F.ceil(F.col("members") / block)
    return regions.select(
        "node",
        F.struct(
            "region",
            # small regions share tasks; a crowded one has tasks of its own
            F.when(blocks == 1, F.pmod(F.xxhash64("region"), F.lit(pools))).otherwise(pools + F.abs(F.col("region") % (1 << 40))).alias("task"),
            F.pmod(F.xxhash64("node"), blocks).alias("block"),
            blocks.alias("blocks"),
        ).alias("place"),
    )


_ITEM = "task long, low long, high long, node long, region long, block long, items binary"


def _item_batch(out: list[list]) -> pa.RecordBatch:
    return pa.record_batch(
        [*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())],
        names=["task", "low", "high", "node", "region", "block", "items"],
    )


def _members(shingle: int):
    """Full sets of region members, one row for each task that needs them."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slabs(batch.column(1)):
                offsets, h = shingle_sets(batch.column(1).slice(a, b - a), shingle)
                out: list[list] = [[] for _ in range(7)]
                held = 0
                node, places = batch.column(0).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a)
                # of the texts of an id, the one whose set the class has
                own_set = [x == batch.column(k).slice(a, b - a).to_numpy() for k, x in zip((3, 4), set_hashes(offsets, h))]
                for i in np.flatnonzero(own_set[0] & own_set[1]).tolist():
                    items = h[offsets[i] : offsets[i + 1]].tobytes()
                    for place in places[i].as_py():
                        own = place["block"]
                        for other in range(place["blocks"]):
                            row = (place["task"], min(own, other), max(own, other), node[i], place["region"], own, items)
                            for column, value in zip(out, row):
                                column.append(value)
                            held += len(items) + 100
                            if held > MEMBER_BYTES:  # a set may be wanted by many tasks
                                yield _item_batch(out)
                                out, held = [[] for _ in range(7)], 0
                yield _item_batch(out)

    return fn


def _link(part: int, whole: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def fn(tab: pa.Table) -> pa.Table:
        node, items = tab.column("node").to_pylist(), tab.column("items").to_pylist()
        block, family = tab.column("block").to_pylist(), tab.column("region").to_pylist()
        left = tab.column("low")[0].as_py()
        order = sorted(range(len(node)), key=lambda i: (family[i], block[i] != left, node[i]))
        a, b, at = [], [], 0
        while at < len(order):
            stop = at
            while stop < len(order) and family[order[stop]] == family[order[at]]:
                stop += 1
            some = order[at:stop]
            split = sum(block[i] == left for i in some)
            for x, y in spanning_links([np.frombuffer(items[i], np.uint64) for i in some], split, part, whole):
                a.append(node[some[x]])
                b.append(node[some[y]])
            at = stop
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return fn


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    min_depth: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: classes of documents linked at ``percent`` Jaccard or more."""
    rows = texts(docs, id_col, text_col)
    sets = stored(rows.mapInArrow(_sets(shingle), _SETS), "sets")
    full = sets.filter("n > 0 and doc is not null")
    # equal sets are one node, whatever their ids; its text is that of its least document.
    # written first: a join of two shuffles can split a crowd of copies, one with an aggregate in it cannot
    same = ["one", "two", "n"]
    nodes = full.groupBy(*same).agg(F.min("doc").alias("least"), F.first("signature").alias("signature"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = stored(full.select("doc", *same).join(nodes.select(*same, "node", "least"), same).select("doc", "node", "least").distinct(), "members")
    regions = forest_regions(nodes, min_depth or depth_for(percent))
    pools = max(1, total_bytes(rows) // GROUP_BYTES)
    placed = placed_in_blocks(regions, block, pools)
    placed = placed.groupBy("node").agg(F.collect_list("place").alias("places"))  # at most one per tree
    placed = placed.join(nodes.select("node", "least", "one", "two"), "node").withColumnRenamed("least", "doc")
    # merge: the same plan whatever the size of the smaller side
    items = rows.join(placed.hint("merge"), "doc").select("node", "text", "places", "one", "two").mapInArrow(_members(shingle), _ITEM)
    links = items.groupBy("task", "low", "high").applyInArrow(_link(percent, 100), "a long, b long")
    # rows that repeat an id with other texts are one document: their nodes are linked
    several = members.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    links = links.unionByName(members.join(several.select("doc", "a"), "doc").select("a", F.col("node").alias("b")))
    linked = components(links)
    linked = linked.join(nodes.select("node", "least"), "node")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = stored(linked.join(least, "component").select("node", "component_id"), "linked")
    joined = members.join(linked, "node", "left")
    joined = joined.select("doc", F.coalesce("component_id", "least").alias("component_id")).distinct()
    sized = sets.select("doc", "n")
    out = sized.join(joined, "doc", "left")
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"),
        F.coalesce(F.col("doc") == F.coalesce("component_id", "doc"), F.lit(True)).alias("kept"),
    )
