"""Hard negatives by score windows, over R-trees that are packed by sort-tile-recursion.

Vectors are dealt into tiles: slabs of equal size along the widest coordinate, each cut again along
the next one. A tile is a packed R-tree of its own: its rows are sorted and tiled along its widest
coordinates until a leaf is left, and every node has the least and greatest value of each
coordinate below it. With an anchor, each coordinate of such a box gives an interval of products,
and their sum an interval of inner products.

A search has a queue of boxes by the greatest score that they may hold, and takes the best box
first. A box is left out if its interval lies outside of the score windows or strictly below the
k-th best score so far (ties are settled by ids, so equal ones are looked at). Each anchor first
searches the tile in which it lies; what it finds there prunes tiles as a whole, and boxes of the
tiles that remain. Anchors meet tiles in blocks, as rows of a join: a task holds one block of
anchors and one tile, whatever the number of either.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.llm.common import small_batches
from siftmark.session import written

LEAF, FANOUT = 64, 8
TILE_BYTES = 4 << 20  # of the components of one tile, eight bytes each
BLOCK_TILES = 12  # whose anchors are one block
MOST = 1 << 24  # of a component, by amount

_TILE = "shard bigint, part bigint, lo array<bigint>, hi array<bigint>, ids binary, labels binary, anchors binary, vectors binary"
_ANCHOR = "place bigint, shard bigint, block bigint, id bigint, label bigint, q array<bigint>"
_FOUND = "place bigint, w int, score bigint, id bigint, found bigint"
_LEAST, _GREATEST = -(1 << 62), 1 << 62


def quantized(vectors: DataFrame, anchor: Column, scale: int = 256) -> DataFrame:
    """id, label, anchor and ``q``, the components as whole numbers floor(scale * x)."""

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        # Null and infinite ones are left out by a filter that Spark may run after this.
        beyond = ((y < -MOST) | (y > MOST)) & (F.abs(x) != float("inf"))
        return F.when(beyond, F.raise_error(F.lit(f"a scaled component is beyond {MOST}")).cast("bigint")).otherwise(y)

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return vectors.where(usable).where(finite).select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
        anchor.alias("anchor"), F.transform("embedding", whole).alias("q"),
    )


def packed_order(vectors: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order: each run of ``leaf`` rows is a leaf."""
    leaves = -(-len(vectors) // leaf)
    depth = min(vectors.shape[1], max(1, (leaves - 1).bit_length()))
    axes = np.argsort(-vectors.var(axis=0), kind="stable")[:depth] if vectors.shape[1] else []

    def tiled(rows: np.ndarray, axes: np.ndarray) -> list[np.ndarray]:
        if not len(axes) or len(rows) <= leaf:
            return [rows]
        rows = rows[np.argsort(vectors[rows, axes[0]], kind="stable")]
        count = -(-len(rows) // leaf)
        slabs = round(count ** (1 / len(axes)) + 0.499)
        size = -(-count // slabs) * leaf
        return [x for at in range(0, len(rows), size) for x in tiled(rows[at : at + size], axes[1:])]

    return np.concatenate(tiled(np.arange(len(vectors)), axes))


class Tree:
    """A packed R-tree over rows in packed order; ``levels[0]`` are the boxes of the leaves."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.vectors, self.leaf, self.fanout = vectors, leaf, fanout
        lo, hi = vectors, vectors
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = leaf
        while not self.levels or len(lo) > 1:
            at = np.arange(0, len(lo), size)
            lo, hi = np.minimum.reduceat(lo, at, axis=0), np.maximum.reduceat(hi, at, axis=0)
            self.levels.append((lo, hi))
            size = fanout

    def intervals(self, level: int, nodes: slice, anchor: np.ndarray) -> tuple[list[int], list[int]]:
        """The least and greatest score that each of some boxes may hold."""
        lo, hi = (x[nodes] for x in self.levels[level])
        up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
        return (lo @ up + hi @ down).tolist(), (hi @ up + lo @ down).tolist()


class Goal:
    """The best rows of one score window so far, as (-score, id, row)."""

    __slots__ = ("best", "floor", "high", "k", "low")

    def __init__(self, low: int, high: int, kth: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.best: list[tuple[int, int, int]] = []
        self.floor = max(low, kth)

    def may_hold(self, least: int, greatest: int) -> bool:
        return greatest >= self.floor and least <= self.high

    def take(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.floor) & (scores <= self.high))
        if len(at):
            at = at[np.lexsort((ids[at], -scores[at]))][: self.k]
            new = zip((-scores[at]).tolist(), ids[at].tolist(), rows[at].tolist(), strict=True)
            self.best = sorted([*self.best, *new])[: self.k]
            if len(self.best) == self.k:
                self.floor = max(self.floor, -self.best[-1][0])


def search(tree: Tree, ids: np.ndarray, wanted: np.ndarray, anchor: np.ndarray, goals: list[Goal]) -> None:
    """Fill the goals from the wanted rows of a tree, the most promising box first."""
    cap = max(g.high for g in goals)
    top = len(tree.levels) - 1
    queue: list[tuple[int, int, int, int, int]] = []

    def offer(level: int, nodes: slice) -> None:
        for node, least, greatest in zip(
            range(nodes.start, nodes.stop), *tree.intervals(level, nodes, anchor), strict=False
        ):
            if any(g.may_hold(least, greatest) for g in goals):
                heapq.heappush(queue, (-min(greatest, cap), level, node, least, greatest))

    offer(top, slice(0, len(tree.levels[top][0])))
    while queue:
        key, level, node, least, greatest = heapq.heappop(queue)
        if -key < min(g.floor for g in goals):
            break
        open_goals = [g for g in goals if g.may_hold(least, greatest)]
        if not open_goals:
            continue
        if level:
            below = len(tree.levels[level - 1][0])
            offer(level - 1, slice(node * tree.fanout, min(below, (node + 1) * tree.fanout)))
            continue
        first = node * tree.leaf
        mine = np.flatnonzero(wanted[first : first + tree.leaf])
        if len(mine):
            rows = mine + first
            scores = tree.vectors[rows] @ anchor
            for g in open_goals:
                g.take(scores, ids[rows], rows)


def _exact(vectors: np.ndarray, other: int) -> np.ndarray:
    """As doubles where sums of products with numbers up to ``other`` are exact in them."""
    most = int(np.abs(vectors).max(initial=0))
    return vectors.astype(np.float64 if max(1, vectors.shape[1]) * most * other < 1 << 53 else np.int64)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def pack_tiles(rows: DataFrame) -> DataFrame:
    """The R-trees, one row each: shard, part, the box of all (lo, hi), and ids, labels, anchor
    marks and vectors in packed order, little-endian. Shorter vectors are filled up with zeros."""
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    n, width = total["n"], total["width"] or 0
    most = max(LEAF, TILE_BYTES // (8 * max(1, width)))
    parts = max(1, -(-n // most))
    rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("q"))))
    spread = (
        rows.select(F.posexplode("q")).groupBy("pos").agg(F.var_pop("col").alias("v"))
        .orderBy(F.desc("v"), "pos").limit(2).collect()
    )
    first, second = ([F.get("q", F.lit(r["pos"])) for r in spread] + [F.lit(0)] * 2)[:2]
    tie = F.rand(17)
    dealt = (
        rows.withColumns({"_one": first, "_two": second, "_tie": tie})
        .repartitionByRange(max(1, round(parts**0.5)), "_one", "_tie").withColumn("_slab", F.spark_partition_id())
        .repartitionByRange(parts, "_slab", "_two", "_tie").select("id", "label", "anchor", "q")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def tile(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            q = _matrix(table["q"].combine_chunks(), width)
            order = packed_order(q)
            q = q[order]
            column = lambda name: table[name].to_numpy()[order]
            kind = "<i2" if np.abs(q).max(initial=0) < 1 << 15 else "<i4"
            return pa.RecordBatch.from_arrays([
                pa.array([part << 16 | number]), pa.array([part]),
                *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (q.min(axis=0), q.max(axis=0))),
                *(pa.array([column(c).astype(k).tobytes()], pa.binary()) for c, k in (("id", "<i8"), ("label", "<i8"), ("anchor", "?"))),
                pa.array([q.astype(kind).tobytes()], pa.binary()),
            ], names=[c.split()[0] for c in _TILE.split(", ")])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= most:
                table = pa.Table.from_batches(held)
                yield tile(table.slice(0, most))
                held, size, number = table.slice(most).to_batches(), size - most, number + 1
        if size:
            yield tile(pa.Table.from_batches(held))

    return written(dealt.mapInArrow(pack, _TILE))


class _Tile:
    def __init__(self, row: dict):
        self.shard = row["shard"]
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        n = len(self.ids)
        width = len(row["lo"])
        self.vectors = np.frombuffer(row["vectors"], "<i2" if len(row["vectors"]) == 2 * n * width else "<i4").reshape(n, width)


def find_anchors(tiles: DataFrame) -> DataFrame:
    """The anchors of the tiles; ``place`` is a number of their own, ``block`` that of some tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tile = _Tile(row)
                at = np.flatnonzero(np.frombuffer(row["anchors"], "?"))
                same = lambda x: pa.array(np.full(len(at), x))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([
                    pa.array(tile.shard << 20 | at), same(tile.shard), same(row["part"] // BLOCK_TILES),
                    pa.array(tile.ids[at]), pa.array(tile.labels[at]),
                    pa.array(tile.vectors[at].astype(np.int64).tolist(), pa.list_(pa.int64())),
                ], names=[c.split()[0] for c in _ANCHOR.split(", ")])

    return written(tiles.mapInArrow(run, _ANCHOR))


def _searched(cells: DataFrame, same: bool, k: int, at_home: bool) -> DataFrame:
    """What the anchors of each cell find in its tile. Anchors that lie in it are searched if
    ``at_home``, the others if not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tile = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                anchors = [a for a in row["members"] if (a["shard"] == row["shard"]) == at_home]
                if not anchors:
                    continue
                if tile is None or tile.shard != row["shard"]:
                    tile = _Tile(row)
                    tree = None
                q = np.array([a["q"] for a in anchors], np.int64).reshape(len(anchors), -1)
                vectors = _exact(tile.vectors, int(np.abs(q).max(initial=0)))
                if tree is None or tree.vectors.dtype != vectors.dtype:
                    tree = Tree(vectors)
                found = []
                for a, x in zip(anchors, q.astype(vectors.dtype), strict=True):
                    wanted = (tile.labels == a["label"]) == same
                    if at_home:
                        wanted[a["place"] & ((1 << 20) - 1)] = False
                    goals = [Goal(w["low"], w["high"], w["kth"], k) for w in a["windows"]]
                    search(tree, tile.ids, wanted, x, goals)
                    for w, g in zip(a["windows"], goals, strict=True):
                        found += [(a["place"], w["w"], int(-s), r, tile.shard << 20 | at) for s, r, at in g.best]
                columns = zip(*found, strict=True) if found else [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["place", "w", "score", "id", "found"],
                )

    return cells.select("shard", "lo", "ids", "labels", "vectors", "members").mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place", "w").orderBy(F.desc("score"), "id", "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _box_product(bound: str) -> Column:
    """The sum over coordinates of the least or greatest product of two intervals."""
    pick = {"least": F.least, "greatest": F.greatest}[bound]
    ends = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x.alias("lo"), y.alias("hi")))
    products = F.zip_with(
        ends("q_lo", "q_hi"), ends("lo", "hi"),
        lambda a, b: pick(a["lo"] * b["lo"], a["lo"] * b["hi"], a["hi"] * b["lo"], a["hi"] * b["hi"]),
    )
    return F.aggregate(products, F.lit(0).cast("bigint"), lambda total, x: total + x)


def sweep(tiles: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor's windows, as (place, w, rank, score, id, found).

    ``anchors`` have ``windows``, a list of structs (w, low, high, kth); rows of the same label
    are wanted, or of all others. All rows of the windows are ranked, by score and then id.
    """
    member = F.struct("place", "shard", "label", "q", "windows").alias("member")
    home = anchors.groupBy("shard").agg(F.collect_list(member).alias("members"))
    near = written(_searched(tiles.join(home, "shard"), same, k, True))
    kth = (
        _first(near, k).where(F.col("rank") == k)
        .groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    )
    known = anchors.join(kth, "place", "left").withColumn("windows", F.transform("windows", lambda w: w.withField(
        "kth", F.coalesce(F.try_element_at("kth", w["w"]), w["kth"]))))
    blocks = written(known.groupBy("block").agg(F.collect_list(member).alias("members")))
    # What a block may hold and wants: the boxes of its anchors' tiles, and the widest of its windows.
    widest = blocks.select("block", F.explode("members").alias("m")).select(
        "block", "m.shard", F.explode("m.windows").alias("w")
    ).groupBy("block", "shard").agg(
        F.min(F.greatest("w.low", "w.kth")).alias("least"), F.max("w.high").alias("most")
    )
    # Pairs of a block's tile and another tile meet by a number of the tile, dealt over groups.
    groups = max(1, round(tiles.count() ** 0.5))
    boxes = tiles.select("shard", "lo", "hi")
    from_box = widest.join(boxes, "shard").select(
        "block", "least", "most", F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
    )
    met = boxes.withColumn("g", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int")).join(from_box, "g").where(
        (_box_product("greatest") >= F.col("least")) & (_box_product("least") <= F.col("most"))
    )
    # Cells are few rows for much work: they are dealt out by number, not by their small size.
    cells = written(met.select("shard", "block").distinct())
    tasks = min(cells.count(), int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = cells.repartition(max(1, tasks), "shard", "block")
    far = _searched(cells.join(tiles, "shard").join(blocks, "block"), same, k, False)
    return written(_first(near.unionByName(far), k))


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """Rows of other labels that score nearly as high as an anchor's positives.

    ``vectors`` has vec_id, embedding and label; ``anchor`` tells the anchors. Scores are inner
    products of components floor(scale * x). An anchor's positives are its first ``positives``
    other rows of its label, by score downwards, then vec_id. For each of them the first
    ``negatives`` rows of other labels are returned whose score is from ``low`` to ``high`` percent
    of the positive's: anchor_id, positive_id, rank (1, 2, ...), negative_id, positive_score and
    negative_score. A negative positive score has no such window.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part;
    shorter vectors count as zero in what they lack; a component beyond 2^24 / scale raises.
    Rows of one vec_id are different rows. Extra columns are left out; an empty table gives none.
    """
    small_batches(vectors.sparkSession)
    tiles = pack_tiles(quantized(vectors, anchor, scale))
    anchors = find_anchors(tiles)
    window = lambda w, least, most: F.struct(
        w.cast("int").alias("w"), least.cast("bigint").alias("low"), most.cast("bigint").alias("high"),
        F.lit(_LEAST).cast("bigint").alias("kth"),
    )
    everything = F.array(window(F.lit(0), F.lit(_LEAST), F.lit(_GREATEST)))
    best = sweep(tiles, anchors.withColumn("windows", everything), True, positives).select(
        "place", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    windows = best.where("positive_score >= 0").select(
        "place", window(
            F.col("w"), F.expr(f"({low} * positive_score + 99) div 100"), F.expr(f"{high} * positive_score div 100")
        ).alias("window"),
    ).groupBy("place").agg(F.collect_list("window").alias("windows"))
    near = sweep(tiles, anchors.join(windows, "place"), False, negatives)
    named = anchors.select("place", F.col("id").alias("anchor_id"))
    return near.join(best, ["place", "w"]).join(named, "place").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
