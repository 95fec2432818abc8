"""N-gram Jaccard join: size-banded tiles, hashed bitmaps that bound overlaps, exact intersection of sorted arrays.

Every text becomes a sorted array of 64-bit shingle hashes; equal sets are one node, named by a 64-bit hash of the set.
A tile is a size band and a piece of the hash space: of two sets that reach the similarity, and whose larger one is in a
band, at most `apart` shingles are in one set alone, so of more than `apart` cells of the hash space some hold the same in
both. Each set offers the apart + 1 cells that hold most (a prefix in an order that is the same for all sets, so two such
sets still share one), for its own band and the next. Only sets that share a cell meet, their bitmaps bound the overlap
from above, and what passes is intersected exactly. Sets in one component by then need no comparison; the last round
compares all that share a cell and are still apart, so no link between components is missed. Links are counted after that,
over all pairs of each component.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, fresh, small_batches, table, tidy, written

#: Cells for each that a set offers; rounds with a hub for each tile, and with a forest of likely links, before the last; sets of a block.
CELLS, HUB_ROUNDS, FOREST_ROUNDS, BLOCK = 1.3, 1, 3, 1024
#: Sets that one task compares with a hub; sets of a block when a component's links are counted.
HUB_SETS, LINK_BLOCK = 512, 128
#: Parts of the hash space whose cells are shuffled one after the other.
SLICES = 4
#: The filter that keeps texts without a partner from being moved has 16 bits for each mark, up to 2^FILTER_BITS (32 MB); more
#: marks are a table. Bits of a mark that it looks at.
FILTER_BITS, FILTER_SHIFTS = 28, (0, 17, 34)
#: Words, and sets of one task, that a worker remembers.
CACHED = 200_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Join:
    """The sizes and hashes of a join of shingles of `words` words with a similarity of `num` / `den` or more."""

    def __init__(self, words: int = 3, num: int = 90, den: int = 100):
        self.words, self.num, self.den = words, num, den
        #: Largest size of each band: a set's partners are in its band and its neighbours.
        self.upper = [1]
        while self.upper[-1] < 1 << 31:
            self.upper.append(max(self.upper[-1] + 1, self.upper[-1] * den // num))
        self.memory: dict[bytes, int] = {}

    def band(self, n: int) -> int:
        return bisect_left(self.upper, n)

    def apart(self, both: int) -> int:
        """Shingles that are in one set alone, at most, if two sets of this size in all are linked."""
        return (self.den - self.num) * both // (self.den + self.num)

    def linked(self, common: int, n: int, m: int) -> bool:
        return self.den * common >= self.num * (n + m - common)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes. Only A-Z is lower-cased; a text of fewer words is one shingle, one without words none."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        memory = self.memory
        try:
            held = [memory[w] for w in words]
        except KeyError:
            if len(memory) > CACHED:
                memory.clear()
            for w in set(words):
                if w not in memory:
                    memory[w] = xxhash.xxh64_intdigest(w)
            held = [memory[w] for w in words]
        h = np.array(held, dtype=np.uint64)
        k = min(self.words, len(h))
        s = h[: len(h) - k + 1] * _A + np.uint64(k)
        for j in range(1, k):
            s = (s ^ (s >> np.uint64(29))) * _B + h[j : len(h) - k + 1 + j] * _C
        return np.unique(mixed(s))

    @staticmethod
    def node(s: np.ndarray) -> int:
        return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)

    def cells(self, s: np.ndarray) -> np.ndarray:
        """The cells that a set offers, as 64-bit names whose last byte is the band."""
        out, content = [], np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s ^ _C))])
        own = self.band(len(s))
        for b in (own, own + 1):
            need = self.apart(2 * self.upper[b]) + 1
            n = need if need == 1 else int(np.ceil(need * CELLS))
            weight = np.bincount((((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64), minlength=n)
            ends = np.cumsum(weight)
            name = mixed((content[ends] - content[ends - weight]) ^ mixed(np.arange(n, dtype=np.uint64) * _A + np.uint64(b)))
            if n > need:
                name = name[np.lexsort((name, -weight))[:need]]
            out.append((name & ~np.uint64(255)) | np.uint64(b & 255))
        return np.concatenate(out).view(np.int64)

    def bitmap(self, s: np.ndarray, band: int) -> np.ndarray:
        """Parities of the shingles that a bit stands for: bits in which two sets differ are shingles that one has alone."""
        words = max(4, self.apart(2 * self.upper[band]) // 8 + 1)
        n = np.bincount((s % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
        return np.packbits(n.astype(np.uint8)).view(np.int64)


def shingled(docs: DataFrame, join: Join, key: str, text: str) -> DataFrame:
    """doc_id, n, node (null without words), mark (a hash of the text) of every row; and cells, the cells that the node
    offers: the one pass that makes the shingles of all texts. A task offers equal sets once; cells are null elsewhere."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        known: dict[int, tuple[int, int | None]] = {}
        for b in batches:
            sizes, nodes, cells, ends = [], [], [], [0]
            for t, mark in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                found = known.get(mark)
                offers = found is None
                if found is None:
                    s = join.shingles(t.as_py())
                    found = (len(s), join.node(s) if len(s) else None)
                    if len(known) < CACHED:
                        known[mark] = found
                    if len(s):
                        cells.append(join.cells(s))
                sizes.append(found[0])
                nodes.append(found[1])
                ends.append(ends[-1] + (len(cells[-1]) if offers and found[0] else 0))
            flat = np.concatenate(cells) if cells else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), b.column(2), lists], ["doc_id", "n", "node", "mark", "cells"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n long, node long, mark long, cells array<long>")


def meetings(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """(cell, node) of the cells that two nodes or more offer, and the tables that these rows are read from.

    One slice of the cells is shuffled at a time, and its shuffle files are gone before the next: beside the cells themselves
    the disk holds a part of them, not all of them once more with two nodes each."""
    spark = found.sparkSession
    offered, met, paths = found.select(F.explode("cells").alias("cell"), "node"), [], []
    for k in range(SLICES):
        # The last byte is the band, which is not evenly spread.
        part = offered.filter(F.pmod(F.shiftright("cell", 8), F.lit(SLICES)) == k)
        # Combined before moving, so a cell of very many sets is one row of a task; written, so that the join can split it.
        shared = part.groupBy("cell").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("cell")
        shared, cells_path = written(spark, shared, "cells")
        rows, path = written(spark, part.join(shared, "cell", "left_semi"), "met")
        drop(spark, cells_path)
        met.append(rows)
        paths.append(path)
    return reduce(DataFrame.unionByName, met), paths


def filter_of(marks: DataFrame, bits: int) -> np.ndarray:
    """A bit set that has three bits of each mark: at most 2^(bits - 6) rows of two numbers reach the driver."""
    mask = (1 << bits) - 1
    bit = F.explode(F.array(*[F.shiftrightunsigned("mark", s).bitwiseAND(mask) for s in FILTER_SHIFTS])).alias("bit")
    rows = marks.select(bit).groupBy((F.shiftright("bit", 6)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out.view(np.uint64)


def partners(docs: DataFrame, join: Join, text: str, found: DataFrame, met: DataFrame, most: int = FILTER_BITS) -> DataFrame:
    """node, n, band, own and next (bitmaps for the set's band and the next), text: a row for each node that meets another.

    Only texts whose marks pass a filter of such nodes' marks, or beyond its largest size are in a table of them, are split
    into shingles again, and moved."""
    spark = docs.sparkSession
    # Rows of one text are one before they move.
    marks = found.filter("node IS NOT NULL").select("node", "mark").distinct().join(met.select("node").distinct(), "node", "left_semi").select("mark").distinct()
    marks, _ = written(spark, marks, "marks")
    size = max(16, (16 * marks.count()).bit_length())
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    if size > most:
        rows, held = rows.join(marks, "mark", "left_semi").select("text", "mark"), None
    else:
        held = spark.sparkContext.broadcast(filter_of(marks, size))
    mask = np.uint64((1 << size) - 1)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            marks = b.column(1).to_numpy()
            passed = np.ones(len(marks), bool)
            if held is not None:
                at = [(marks.view(np.uint64) >> np.uint64(shift)) & mask for shift in FILTER_SHIFTS]
                passed = np.logical_and.reduce([held.value[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1) for p in at])
            rows = []
            for i in np.flatnonzero(passed).tolist():
                mark, t = int(marks[i]), b.column(0)[i].as_py()
                if mark in seen:
                    continue
                if len(seen) < CACHED:
                    seen.add(mark)
                s = join.shingles(t)
                if len(s):
                    band = join.band(len(s))
                    rows.append((join.node(s), len(s), band, join.bitmap(s, band).tolist(), join.bitmap(s, band + 1).tolist(), t))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["node", "n", "band", "own", "next", "text"])

    return rows.mapInArrow(tidy(run), "node long, n long, band int, own array<long>, next array<long>, text string").dropDuplicates(["node"])


def bounded(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for a link: differing bits are no more than the shingles that may be apart."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("band").alias(f"band{x}"), F.col("own").alias(f"own{x}"), F.col("next").alias(f"next{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    top = F.greatest("banda", "bandb")
    use = lambda x: F.when(F.col(f"band{x}") == top, F.col(f"own{x}")).otherwise(F.col(f"next{x}"))
    differ = F.aggregate(F.zip_with(use("a"), use("b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x.cast("int"))
    room = F.floor((F.col("na") + F.col("nb")) * (join.den - join.num) / (join.den + join.num))
    return both.filter((F.abs(F.col("banda") - F.col("bandb")) <= 1) & (differ <= room)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) that are linked. Texts of a go to the task that has b; a b with many partners has several tasks."""
    text = sets.select("node", "text")
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_SETS).cast("int").alias("tasks"))
    others = pairs.join(many, "b").withColumn("task", F.pmod(F.xxhash64("a"), F.col("tasks")).cast("int")).join(text.withColumnRenamed("node", "a"), "a").select("b", "task", "a", "text")
    hubs = many.join(text.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(None).cast("long").alias("a"), "text")
    dealt = others.unionByName(hubs).repartition("b", "task").sortWithinPartitions("b", "task", F.col("a").asc_nulls_first())

    def run(batches):
        hub = None
        for batch in batches:
            rows = []
            for b, a, t in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                s = join.shingles(t.as_py())
                if not a.is_valid:
                    hub = s
                elif join.linked(len(np.intersect1d(s, hub, assume_unique=True)), len(s), len(hub)):
                    rows.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link (a, b). Each round gives a node the least name next to it and contracts
    the edges; names are hashes, so the rounds are few even for chains."""
    spark = links.sparkSession
    edges, path = written(spark, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    paths, out = [path], None
    while True:
        ways = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up, path = written(spark, ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "up")
        paths.append(path)
        out = up.withColumnRenamed("up", "root") if out is None else out.join(up.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        edges = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        edges, path = written(spark, edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "edges")
        paths.append(path)
        if edges.isEmpty():
            break
    out, _ = written(spark, out, "roots")
    drop(spark, *paths)
    return out


def widened(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) once more links are known: the components so far are the nodes of what the new links join."""
    if roots is None:
        return components(links)
    for c in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).select("a", "b")
    more = components(links)
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    first = more.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return written(links.sparkSession, moved.unionByName(first), "roots")[0]


def labelled(met: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(cell, node, root) of the cells whose nodes are not all in one component yet."""
    rows = met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").select("cell", "node", F.coalesce("root", "node").alias("root"))
    if roots is None:
        return rows
    torn = rows.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("cell")
    return rows.join(torn, "cell")


def hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node with one or two of the hubs of its cells, where they are in other components. A cell's hub changes with the turn."""
    hubs = rows.groupBy("cell").agg(F.min_by(F.struct("node", "root"), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("hub"))
    met = rows.join(hubs, "cell").filter(F.col("root") != F.col("hub.root")).groupBy("node").agg(F.min("hub.node").alias("x"), F.max("hub.node").alias("y"))
    return met.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("x", "y"))).alias("b"))


def torn_pairs(rows: DataFrame, sets: DataFrame, join: Join, forest: bool) -> DataFrame:
    """(a, b): pairs of different components in a cell whose bitmaps leave room for a link, from blocks of the cell's nodes:
    all of them, or a forest that would join all components of a block, which takes the nearest bitmaps first.

    A block holds nodes of one large component, or of small ones; two blocks of one component never meet, so a large one
    costs its own size for each block of others."""
    spark = rows.sparkSession
    rows, rows_path = written(spark, rows.distinct(), "torn")
    per = rows.groupBy("cell", "root").agg(F.count("*").alias("size"))
    per, per_path = written(spark, per, "torn-sizes")
    small = per.groupBy("cell").agg(F.sum(F.when(F.col("size") < BLOCK, F.col("size"))).alias("small"))
    large = F.col("size") >= BLOCK
    dealt_by = lambda key, size: F.pmod(F.xxhash64(key, F.lit(7)), F.ceil(size / BLOCK).cast("long"))
    block = F.when(large, F.xxhash64("root", dealt_by("node", F.col("size")))).otherwise(dealt_by("root", F.col("small")))
    placed = rows.join(per.join(small, "cell"), ["cell", "root"]).select("cell", "node", "root", block.alias("block"), F.when(large, F.col("root")).alias("sole"))
    placed, placed_path = written(spark, placed, "torn-blocks")
    drop(spark, rows_path, per_path)
    blocks = placed.select("cell", "block", "sole").distinct()
    meet = blocks.select("cell", F.col("block").alias("i"), F.col("sole").alias("si")).join(blocks.select("cell", F.col("block").alias("j"), F.col("sole").alias("sj")), "cell")
    meet = meet.filter("i <= j AND (si IS NULL OR sj IS NULL OR si <> sj)")
    sides = meet.select("cell", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sides, _ = written(spark, sides, "torn-tiles")
    tiles = placed.drop("sole").join(sides, ["cell", "block"])
    band = F.col("cell").bitwiseAND(255).cast("int")
    held = tiles.join(sets.select("node", "n", "band", "own", "next"), "node").withColumn("bits", F.when(F.col("band") == band, F.col("own")).otherwise(F.col("next"))).drop("own", "next", "band")
    dealt = held.select("cell", "i", "j", "node", "root", "block", "n", "bits").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node")
    num, den = join.num, join.den

    def tile(i, j, node, root, block, n, bits):
        """The pairs of one tile."""
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for x in left:
            if i == j:
                right = right[node[right] > node[x]]
            away = right[root[right] != root[x]]
            if forest:
                far = np.bitwise_count(bits[right] ^ bits[x]).sum(axis=1)
                fits = (far <= (den - num) * (n[right] + n[x]) // (den + num)) & (root[right] != root[x])
                while fits.any():
                    y = right[fits][far[fits].argmin()]
                    yield int(node[x]), int(node[y])
                    root[root == root[y]] = root[x]
                    fits &= root[right] != root[x]
            elif len(away):
                fits = np.bitwise_count(bits[away] ^ bits[x]).sum(axis=1) <= (den - num) * (n[away] + n[x]) // (den + num)
                yield from ((int(node[x]), int(y)) for y in node[away[fits]])

    def run(batches):
        held, seen = None, set()
        for batch in _with_end(batches):
            new = [] if batch is None else [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else held if not new else [np.concatenate(c) for c in zip(held, new, strict=True)]
            if not held or not len(held[0]):
                continue
            key = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
            starts = np.concatenate([[0], key])
            ends = np.concatenate([key, [len(held[0])]])
            whole = len(starts) if batch is None else len(starts) - 1
            out = []
            for p, q in zip(starts[:whole], ends[:whole], strict=True):
                bits = np.stack(held[7][p:q]).view(np.uint64)
                for pair in tile(held[1][p], held[2][p], *[c[p:q].copy() for c in held[3:7]], bits):
                    if pair not in seen:
                        if len(seen) < CACHED:
                            seen.add(pair)
                        out.append(pair)
            if whole:
                held = [c[ends[whole - 1] :] for c in held]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def roots_of(docs: DataFrame, join: Join, text: str, found: DataFrame, met: DataFrame, met_paths: list[str]) -> tuple[DataFrame | None, DataFrame | None, str | None]:
    """(node, root) of the nodes with links, None if there are none; the sets that met, with their path. `met` is dropped."""
    spark = docs.sparkSession
    if met.isEmpty():
        drop(spark, *met_paths)
        return None, None, None
    sets, sets_path = written(spark, partners(docs, join, text, found, met), "sets")
    roots, paths = None, [*met_paths]
    last, turn = HUB_ROUNDS + FOREST_ROUNDS, -1
    while turn < last:
        turn += 1
        rows = labelled(met, roots)
        pairs = bounded(hub_pairs(rows, turn), sets, join) if turn < HUB_ROUNDS else torn_pairs(rows, sets, join, turn < last)
        pairs, path = written(spark, pairs, "pairs")
        paths.append(path)
        if pairs.isEmpty():
            if turn >= HUB_ROUNDS:
                break  # no two components have a pair that could be linked
            continue
        new, path = written(spark, verified(pairs, sets, join), "links")
        paths.append(path)
        if not new.isEmpty():
            roots = widened(roots, new)
        elif HUB_ROUNDS <= turn < last - 1:
            turn = last - 1  # another forest would be the same
    drop(spark, *paths)
    return roots, sets, sets_path


def link_counts(found: DataFrame, roots: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """(node, links): rows of other nodes that a node is linked with. Both ends of a link are in one component, so all pairs
    of a component's sets are compared exactly, block by block: the tiles of a component of n sets are (n / LINK_BLOCK)^2 / 2."""
    rows = found.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("rows"))
    sizes, _ = written(roots.sparkSession, roots.groupBy("root").agg(F.ceil(F.count("*") / LINK_BLOCK).cast("int").alias("blocks")), "components")
    placed = roots.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = placed.join(rows, "node").select("*", other).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "rows")
    dealt = tiles.join(sets.select("node", "text"), "node").select("root", "i", "j", "block", "node", "rows", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "block")

    def counted(i: int, j: int, block: list[int], rows: list[int], held: list[np.ndarray]) -> np.ndarray:
        """Linked rows of each set of one tile."""
        sizes, weight, block = np.array([len(s) for s in held]), np.array(rows), np.array(block)
        every, at = np.unique(np.concatenate(held), return_inverse=True)
        ends = np.cumsum(sizes)
        own, out = np.zeros(len(every), bool), np.zeros(len(held), np.int64)
        right = int(np.searchsorted(block, j)) if i != j else 0
        for x in range(right if i != j else len(held) - 1):
            first = right if i != j else x + 1
            own[at[ends[x] - sizes[x] : ends[x]]] = True
            common = np.add.reduceat(own[at[ends[first] - sizes[first] :]], ends[first:] - sizes[first:] - (ends[first] - sizes[first]), dtype=np.int64)
            own[at[ends[x] - sizes[x] : ends[x]]] = False
            fits = join.den * common >= join.num * (sizes[first:] + sizes[x] - common)
            out[x] += weight[first:][fits].sum()
            out[first:][fits] += weight[x]
        return out

    def run(batches):
        tile, rows = None, []
        for batch in _with_end(batches):
            done: list[tuple[int, int]] = []
            for key in [None] if batch is None else zip(*[c.to_pylist() for c in batch.columns[:6]], batch.column(6), strict=True):
                if rows and (key is None or key[:3] != tile):
                    block, nodes, weights, held = zip(*rows, strict=True)
                    done += [(n, int(v)) for n, v in zip(nodes, counted(tile[1], tile[2], block, weights, held), strict=True) if v]
                    rows = []
                if key is not None:
                    tile = key[:3]
                    rows.append((key[3], key[4], key[5], join.shingles(key[6].as_py())))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in (0, 1)], ["node", "links"])

    return dealt.mapInArrow(tidy(run), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def rooted(docs: DataFrame, join: Join, key: str, text: str, count: bool = False) -> tuple[DataFrame, list[str]]:
    """doc_id, n, node, mark and root (a name of the component; null without words) of every row of docs; if asked, n_links,
    the number of other rows that the row is linked with. And the tables that these rows are read from."""
    spark = docs.sparkSession
    small_batches(spark)
    wide, wide_path = written(spark, shingled(docs, join, key, text), "shingled")
    met, met_paths = meetings(wide)
    # The cells are most of that table and not read again.
    found, found_path = written(spark, wide.select("doc_id", "n", "node", "mark"), "sizes")
    drop(spark, wide_path)
    roots, sets, sets_path = roots_of(docs, join, text, found, met, met_paths)
    # What is known of a node is one written table: a join with it can split a set of very many rows, two joins in a row can't.
    known = roots
    if count:
        known = found.filter("node IS NOT NULL").groupBy("node").agg((F.count("*") - 1).alias("n_links"))
        if roots is not None:
            links, _ = written(spark, link_counts(found, roots, sets, join), "link-counts")
            known = known.join(links, "node", "left").join(roots, "node", "left").select("node", (F.col("n_links") + F.coalesce("links", F.lit(0))).alias("n_links"), "root")
        else:
            known = known.withColumn("root", F.lit(None).cast("long"))
        known, _ = written(spark, known.filter("n_links > 0"), "nodes")
    names = ["doc_id", "n", "node", "mark", "root"]
    out = found.withColumn("root", F.col("node")) if known is None else found.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    out = out.select(*names, *[F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] * count)
    if sets_path:
        drop(spark, sets_path)
    return out, [found_path]


def linked(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id that links reach), node, n_links (the other rows it
    is linked with, counted over all pairs; rows with equal sets are linked).

    Null and empty texts, and those without words, have no shingles and only themselves. Rows with equal sets are one
    class; repeated rows belong to it each. Null ids are passed over where others are in the component. Links are exact,
    but for 64-bit hashes of shingles and sets. Other columns are not read.
    """
    found, _ = rooted(docs, Join(words, num, den), key, text, count=True)
    least = found.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").select("root", "least")
    # Written, so that a small table is broadcast, and a component of very many rows can be split.
    least, _ = written(docs.sparkSession, least.withColumn("several", F.lit(True)), "least")
    component = F.when(F.col("several"), F.col("least")).otherwise(F.col("doc_id"))
    return found.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "node", "n_links")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, with docs' columns, of each component: one of the smallest id, a null id if there are no others.

    Rows are told apart by id and text, not by id alone: ids may be null, or repeat with other texts. Texts without words
    stay. Only rows whose id and text repeat are compared once more by their own set.
    """
    spark = docs.sparkSession
    found, paths = rooted(docs, Join(words, num, den), key, text)
    rows, rows_path = written(spark, found.filter("root IS NOT NULL").select("doc_id", "mark", "root"), "classes")
    drop(spark, *paths)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    shared = rows.groupBy("root").agg(F.count("*").alias("n"), first).filter("n > 1").drop("n")
    # Written, so that a small table is broadcast, and a component of very many rows can be split.
    shared, shared_path = written(spark, shared, "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    own_id, own_mark, own_n, own_out = fresh(docs, "__jac_id", "__jac_mark", "__jac_n", "__jac_out")
    # Ids and texts that go, and those of which one of several rows stays.
    again = rows.join(shared, "root").groupBy(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)).agg(F.count("*").alias(own_n), F.max((~stays).cast("int")).alias(own_out))
    marked, _ = written(spark, again.filter((F.col(own_n) > 1) | (F.col(own_out) == 1)).drop(own_n), "marked")
    drop(spark, rows_path, shared_path)
    out = docs.join(marked, F.col(key).eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_mark)), "left").filter(F.col(own_out).isNull() | (F.col(own_out) == 0))
    if marked.filter(F.col(own_out) == 0).isEmpty():
        return out.select(*docs.columns)
    once = out.filter(F.col(own_out) == 0).select(*docs.columns).dropDuplicates([key, text])
    return out.filter(F.col(own_out).isNull()).select(*docs.columns).unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
