"""N-gram Jaccard join by grouped prefixes (operator 6).

1. Every text becomes its set of shingle hashes. A sketch of fixed size counts the shingles of all texts; a set is
   ordered by (count, hash), rare ones first. A pair at the threshold shares one of its first n - ceil(t n) + 1 shingles.
2. Texts with equal prefixes and sizes form a group; prefixes are compared between groups only.
3. Groups that share a prefix shingle of up to SMALL groups become pairs, which sizes, places in the prefixes and bitmaps of
   the sets filter. Each pair that is left is a cell: the sets of one group against those of the other.
4. A shingle of more groups would give pairs without a bound. Its groups of like size (a pair's sizes differ by one class at
   most) are chained through the smallest one, so it gives as many rows as it has groups. A chained unit against itself, and
   against the unit of the next size class, are cells too; pairs of groups that such a cell compares are no cells of their own.
5. Cells are expanded to their distinct sets and verified exactly, in blocks of bounded size against each other, inside
   tasks: what leaves a task is a number of links and a root for each set, never a list of pairs. Only verified links are
   closed to components.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import mix, shingle_sets
from placeweave.operators.graph import connected_components, cut, few, fresh_path, release, remove, skew_join

#: Counters of the sketch of shingle counts, and the pieces in which its parts are added up.
SKETCH, PIECES = 1 << 23, 512
#: Groups of a shingle that are paired one by one.
SMALL = 32
#: Bits of a set's bitmap: a power of two from twice its size on, within these. With fewer bits than shingles, unlike sets look alike.
LEAST_BITS, MOST_BITS = 256, 1 << 24
#: Sets of a block; a task holds two blocks.
BLOCK = 128


def levels(counts: np.ndarray) -> np.ndarray:
    """A byte for each count that rises with it: in steps of a hundredth of their median, or of one, and by eighths of an octave from 128 steps on."""
    steps = counts / max(1.0, float(np.median(counts)) / 100)
    return np.where(steps < 128, steps, np.minimum(255, 128 + 8 * np.log2(np.maximum(steps, 128) / 128))).astype(np.uint8)


def shingle_levels(docs: DataFrame, k: int) -> np.ndarray:
    """Levels of the counts of shingles by the low bits of their hash, over all texts: what is rare has a low one.

    There are several million counters, so that the others of a counter don't hide over gigabytes which shingles are rare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int32)
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                np.add.at(total, (s & np.uint64(SKETCH - 1)).astype(np.int64), np.int32(1))
        parts = [zlib.compress(p.astype("<u1" if p.max() < 256 else "<u4").tobytes(), 1) for p in total.reshape(PIECES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], ["piece", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // PIECES, np.int64)
        for c in group["counts"]:
            part = zlib.decompress(c.as_py())
            total += np.frombuffer(part, "<u1" if len(part) == len(total) else "<u4")
        return pa.table([group["piece"][:1], pa.array([levels(total).tobytes()], pa.binary())], names=["piece", "levels"])

    parts = docs.select("text").mapInArrow(run, "piece int, counts binary")
    out = np.zeros((PIECES, SKETCH // PIECES), np.uint8)
    for r in parts.groupBy("piece").applyInArrow(add, "piece int, levels binary").collect():  # PIECES rows of a fixed size
        out[r["piece"]] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out.reshape(-1)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def bitmap_of(s: np.ndarray) -> np.ndarray:
    """Which slots the hashes of a set fall into."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[(s >> np.uint64(40)) & np.uint64(size - 1)] = True
    return np.packbits(bits).view(np.int64)


def differing(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Of each row, the bits that differ in two bitmaps, which as many shingles at least are not shared; a longer one is folded to the other's length."""
    flat, first, size = [], [], []
    for x in (a, b):
        offsets = x.offsets.to_numpy()
        flat.append(x.values.to_numpy().view(np.uint64))  # bits of a negative number are counted without its sign
        first.append(offsets[:-1])
        size.append(np.diff(offsets))
    out = np.zeros(len(a), np.int64)
    for m, n in {*zip(size[0].tolist(), size[1].tolist())}:
        rows, least = np.flatnonzero((size[0] == m) & (size[1] == n)), min(m, n)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            x, y = (np.bitwise_or.reduce(flat[i][first[i][part][:, None] + np.arange(w)].reshape(len(part), -1, least), axis=1) for i, w in ((0, m), (1, n)))
            out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def prefixes(docs: DataFrame, k: int, num: int, den: int, rarity: np.ndarray) -> DataFrame:
    """(doc_id, n, f, g, p, q, prefix, bitmap): size, fingerprints of the set and of the prefix, the prefix, and which slots of a bitmap the set's hashes fall into, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, prints, lists, maps = [], [], [], [], []

            def out() -> pa.RecordBatch:
                f = np.array(prints, np.uint64).astype(np.int64).reshape(-1, 4)
                ids = batch.column(0).take(pa.array(at, pa.int64()))
                lengths = np.cumsum([0, *map(len, lists)])
                prefix = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(lists).astype(np.int64) if lists else [], pa.int64()))
                bitmap = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, maps)]), pa.int32()), pa.array(np.concatenate(maps), pa.int64()))
                return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), *(pa.array(f[:, i], pa.int64()) for i in range(4)), prefix, bitmap], ["doc_id", "n", "f", "g", "p", "q", "prefix", "bitmap"])

            for row, s in shingle_sets(batch.column(1), k):
                head = s[np.lexsort((s, rarity[s & np.uint64(SKETCH - 1)]))[: prefix_length(len(s), num, den)]] if len(s) else s
                second = lambda x: mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                at.append(row)
                n.append(len(s))
                prints.append((s.sum(dtype=np.uint64), second(s), head.sum(dtype=np.uint64), second(head)))
                lists.append(head)
                maps.append(bitmap_of(s))
                if len(at) >= 512:
                    yield out()
                    at, n, prints, lists, maps = [], [], [], [], []
            if at:
                yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f long, g long, p long, q long, prefix array<long>, bitmap array<long>")


def linked(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places before i) that link with set i; with sides, only across them.

    Shared shingles are counted exactly over the block's inverted lists.
    """
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(flat)]])
    which = np.cumsum(new) - 1
    shared = (end - begin)[which] > 1
    # for each set, its shingles that another set has too
    place = np.argsort(owner[shared], kind="stable")
    terms, bounds = which[shared][place], np.searchsorted(owner[shared][place], np.arange(len(sets) + 1))
    for i in range(1, len(sets)):
        mine = terms[bounds[i] : bounds[i + 1]]
        if not len(mine):
            continue
        lengths = end[mine] - begin[mine]
        at = np.repeat(begin[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        common = np.bincount(owner[at], minlength=len(sets))[:i]
        ok = den * common >= num * (sizes[i] + sizes[:i] - common)
        ok &= common > 0
        if side is not None:
            ok &= side[:i] != side[i]
        if ok.any():
            yield i, np.flatnonzero(ok)


def _verify(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        # blocks of two units, or two blocks of one, are compared across; a block by itself within
        across = group["x"][0].as_py() != group["y"][0].as_py() or group["i"][0].as_py() != group["j"][0].as_py()
        side = group["side"].to_numpy() if across else None
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["members"]]
        root, links = list(range(len(nodes))), np.zeros(len(nodes), np.int64)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, found in linked(sets, side, num, den):
            links[i] += copies[found].sum()
            links[found] += copies[i]
            for j in found:
                a, b = find(i), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
        keep = np.flatnonzero(links)
        return pa.table([pa.array(nodes[keep], pa.int64()), pa.array(nodes[[find(int(i)) for i in keep]], pa.int64()), pa.array(links[keep], pa.int64())], names=["node", "root", "links"])

    return run


def jaccard_classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs(doc_id, text, ...).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, a text's set is its distinct k-word shingles (with fewer words
    the whole sequence as one), and two texts link when den * |intersection| >= num * |union|. component_id is the smallest
    doc_id that links reach; n_links counts the rows that a row links with. A null or empty text, or one without words, has
    size 0, no link and its own id. Rows with a null doc_id keep their size and have neither links nor a component. doc_id
    is expected to be unique: rows that share one are versions of one document and fall into one component. Equal texts
    are linked through one of them. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "prefixes")
    prefixes(docs, k, num, den, shingle_levels(docs, k)).write.parquet(path)
    found = spark.read.parquet(path)
    groups = found.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "p", "q").agg(F.min("doc_id").alias("gid"), F.any_value("prefix").alias("prefix"), F.any_value("bitmap").alias("bitmap"), ((F.min("f") == F.max("f")) & (F.min("g") == F.max("g"))).alias("single"))
    # prefixes and bitmaps are the bulk: they stay once a group, and rows keep their numbers
    groups_path, rows_path = fresh_path(spark, "groups"), fresh_path(spark, "rows")
    groups.write.parquet(groups_path)
    found.select("doc_id", "n", "f", "g", "p", "q").write.parquet(rows_path)
    remove(spark, path)
    release(spark)
    groups, rows = spark.read.parquet(groups_path), spark.read.parquet(rows_path)
    graph = rows.where("n > 0 AND doc_id IS NOT NULL")
    sets = graph.groupBy("f", "g", "n", "p", "q").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))

    # sizes of a pair that links differ by a factor of den / num at most, so by one class
    size_class = F.floor(F.log(F.col("n")) / (1.0001 * math.log(den / num))).alias("class") if num < den else F.col("n").alias("class")
    entries = groups.select("gid", "n", F.posexplode("prefix").alias("at", "shingle"))
    hubs = entries.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1")
    shared_path, seats_path = fresh_path(spark, "shared"), fresh_path(spark, "seats")
    skew_join(entries, hubs, "shingle").select("shingle", "gid", "n", size_class, "at", "m").write.parquet(shared_path)
    release(spark)
    shared = spark.read.parquet(shared_path)
    a = shared.where(F.col("m") <= SMALL).select("shingle", F.col("gid").alias("a"), F.col("n").alias("n1"), F.col("at").alias("i"))
    b = a.select(F.col("shingle").alias("other"), F.col("a").alias("b"), F.col("n1").alias("n2"), F.col("i").alias("j"))
    # shared shingles if this is the first one of both prefixes
    most = 1 + F.least(F.col("n1") - F.col("i"), F.col("n2") - F.col("j")) - 1
    similar = lambda overlap: (num + den) * overlap >= num * (F.col("n1") + F.col("n2"))
    pairs = a.join(b, (F.col("shingle") == F.col("other")) & (F.col("a") < F.col("b")) & similar(most)).select("a", "b", "n1", "n2").distinct()
    map_of = lambda x: groups.select(F.col("gid").alias(x), F.col("bitmap").alias(f"{x}_map"), F.col("single").alias(f"{x}_single"))
    mapped = pairs.join(map_of("a"), "a").join(map_of("b"), "b")

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n1, n2, whole_a, whole_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n1", "n2", "a_single", "b_single"))
            most = (n1 + n2 - differing(batch.column("a_map"), batch.column("b_map"))) // 2
            ok = pa.array(~(whole_a & whole_b) | ((num + den) * most >= num * (n1 + n2)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    pairs = cut(mapped.mapInArrow(fitting, "a long, b long"))
    release(spark)

    common = shared.where(F.col("m") > SMALL)
    first = cut(common.groupBy("shingle", "class").agg(F.min("gid").alias("hub")))
    third = lambda df: df.withColumn("k", F.xxhash64("shingle", "class"))  # noqa: E731  keeps the aggregate's own partitioning from serving the join
    chained = third(common).join(third(first), ["shingle", "class", "k"]).where("gid <> hub").select(F.col("gid").alias("a"), F.col("hub").alias("b")).distinct()
    units = cut(connected_components(chained))
    unit_of = lambda x, name: units.select(F.col("node").alias(x), F.col("component").alias(name))
    # one unit has all groups of a shingle and a class
    placed = first.join(unit_of("hub", "u"), "hub", "left").select("shingle", "class", F.coalesce("u", "hub").alias("unit"))
    beside = placed.select("shingle", (F.col("class") - 1).alias("class"), F.col("unit").alias("next"))
    crossed = cut(placed.join(beside, ["shingle", "class"]).select(F.least("unit", "next").alias("x"), F.greatest("unit", "next").alias("y")).where("x <> y").distinct())

    own = pairs.join(unit_of("a", "u"), "a", "left").join(unit_of("b", "v"), "b", "left").select("a", "b", F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v")).where("u <> v")
    own = own.withColumns({"x": F.least("u", "v"), "y": F.greatest("u", "v")}).join(crossed, ["x", "y"], "left_anti").select(F.col("a").alias("x"), F.col("b").alias("y"))
    of_group = groups.select("n", "p", "q", "gid").join(unit_of("gid", "unit"), "gid", "left").select("n", "p", "q", "gid", F.coalesce("unit", "gid").alias("unit"))
    members = cut(sets.join(of_group, ["n", "p", "q"]).select(F.col("rep").alias("node"), "copies", "gid", "unit"))

    def seats(cells: DataFrame, key: str) -> DataFrame:
        """Rows (node, copies, kind, x, y, side, block, blocks_x, blocks_y) of the sets of cells(x, y) of groups or units."""
        blocks = members.groupBy(F.col(key).alias("x")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        sized = cells.join(blocks.withColumnRenamed("blocks", "blocks_x"), "x").join(blocks.select(F.col("x").alias("y"), F.col("blocks").alias("blocks_y")), "y")
        both = sized.select(F.col("x").alias(key), "x", "y", "blocks_x", "blocks_y", F.lit(0).alias("side")).union(sized.where("x <> y").select("y", "x", "y", "blocks_x", "blocks_y", F.lit(1)))
        block = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("blocks_x")).otherwise(F.col("blocks_y")))
        return skew_join(members.select("node", "copies", key), both, key).select("node", "copies", F.lit(key).alias("kind"), "x", "y", "side", block.alias("block"), "blocks_x", "blocks_y")

    within = members.groupBy("unit").agg(F.count("*").alias("m")).where("m > 1").select(F.col("unit").alias("x"), F.col("unit").alias("y"))
    seats(own, "gid").union(seats(within.union(crossed), "unit")).write.parquet(seats_path)
    release(spark)
    seated = spark.read.parquet(seats_path)

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [s.tobytes() for _, s in shingle_sets(batch.column("text").slice(at, 512), k)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, 512), pa.array(found, pa.binary())], ["node", "members"])

    texts = docs.select(F.col("doc_id").alias("node"), "text").where("doc_id IS NOT NULL")
    held = texts.join(few(cut(seated.select("node").distinct())), "node", "left_semi").mapInArrow(as_sets, "node long, members binary")
    # a set of a unit meets each block of the other unit, or its own block and all others of its unit
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    inside = F.transform(every(F.col("blocks_x")), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), F.when(F.col("block") <= o, 0).otherwise(1).alias("side")))
    across = F.when(F.col("side") == 0, F.transform(every(F.col("blocks_y")), lambda o: F.struct(F.col("block").alias("i"), o.alias("j"), F.lit(0).alias("side")))).otherwise(F.transform(every(F.col("blocks_x")), lambda o: F.struct(o.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))))
    cells = seated.join(held, "node").select("node", "copies", "kind", "x", "y", F.inline(F.when(F.col("x") == F.col("y"), inside).otherwise(across)), "members")
    found = cells.groupBy("kind", "x", "y", "i", "j").applyInArrow(_verify(num, den), "node long, root long, links long")
    found = cut(found)
    for path in (shared_path, seats_path, groups_path):
        remove(spark, path)
    release(spark)

    versions = graph.join(sets.select("f", "g", "n", "rep"), ["f", "g", "n"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    same = versions.select("a", "b").union(versions.select("doc_id", "a"))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(same)
    classes = connected_components(edges)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_set = (
        sets.select("f", "g", "n", "rep", "copies")
        .join(links.withColumnRenamed("node", "rep"), "rep", "left")
        .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .select("f", "g", "n", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    # a set with very many copies: its rows of the left side may be split over tasks
    fourth = lambda df: df.withColumn("k", F.xxhash64("f"))
    light = fourth(rows.select("doc_id", "n", "f", "g")).alias("l")
    known = F.col("doc_id").isNotNull()
    return light.join(fourth(of_set), ["f", "g", "n", "k"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )
