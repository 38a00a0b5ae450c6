"""N-gram Jaccard join: MinHash banding.

Every distinct set of word n-grams is one class of documents. Classes are banded by MinHash, and those
that meet in a band form candidate groups. In each group all pairs are verified on their full n-gram
sets, block against block inside a task, and what leaves the task is one row for each class: how many
it is linked to, and a link that holds its component together. No pair is ever a row. Groups of very
many classes, as chance meetings chain them together in large corpora, are taken apart: there the
classes of each band's bucket are verified, each pair in the first band in which it meets. Either way
exactly the pairs that meet in a band are verified, so a link never hangs on how large its group is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.llm.text import SHINGLE_WORDS, shingle_hashes, unused
from lavra.sources.scratch import written

SIMILARITY = 0.8
RECALL = 0.999
#: Pairs of the similarity PASSAGE, as a shared passage gives it, may meet in a band this often.
PASSAGE, CHANCE = 0.4, 0.03
#: Classes in a block; a task verifies two blocks at most.
BLOCK = 256
#: Groups of more classes are verified by the buckets of their bands; the links are the same either way.
WHOLE_GROUP = 4096
#: Columns of the membership matrix handled at once.
_COLUMNS = 4096


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of `rows` minima in which a pair of this similarity meets with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def band_plan(similarity: float = SIMILARITY, recall: float = RECALL, passage: float = PASSAGE, chance: float = CHANCE) -> tuple[int, int]:
    """(bands, rows): the fewest minima that give the recall, and by which pairs of the similarity `passage` meet with `chance` at most."""
    for rows in range(1, 64):
        bands = bands_for(similarity, recall, rows)
        if 1 - (1 - passage**rows) ** bands <= chance:
            return bands, rows
    raise ValueError(f"no bands tell {passage} from {similarity}")


def signatures(docs: DataFrame, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (id, v, class, n_grams, bands): the n-gram set's 128-bit hash, its size, and a hash for each band.

    v tells texts of one id apart. Null texts are empty; a text without words has the empty set, no
    bands, and shares its class with others like it.
    """
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"), F.array_distinct(shingle_hashes(F.col(text_col), size)).alias("grams"))
    kind = T.StructType([
        hashed.schema["id"], T.StructField("v", T.LongType()), T.StructField("class", T.BinaryType()),
        T.StructField("n_grams", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(20_011)
        a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        for batch in batches:
            classes, sizes, found = [], [], []
            for value in batch.column(2):
                grams = np.sort(value.values.to_numpy().view(np.uint64))
                classes.append(xxhash.xxh3_128_digest(grams.tobytes()))
                sizes.append(len(grams))
                if not len(grams):
                    found.append([])
                    continue
                # Multiply-add on 32 bits taken from both halves of each hash, then the minimum.
                h = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
                low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(h), 512):
                    mixed = h[at : at + 512, None] * a + b
                    mixed ^= mixed >> np.uint32(15)
                    np.minimum(low, (mixed * np.uint32(0x2C1B3C6D)).min(axis=0), out=low)
                found.append([xxhash.xxh3_64_intdigest(low[k * rows : (k + 1) * rows].tobytes(), k) - (1 << 63) for k in range(bands)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(classes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=kind.names
            )

    return hashed.mapInArrow(run, kind)


def components(edges: DataFrame, levels: int = 40) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b): root is the smallest node of its component.

    By contraction: every node points at the smallest of itself and its neighbours, pointers are followed
    twice, and the edges between what is then pointed at are the next, smaller graph. It ends when no
    edge is left, after a number of levels that grows with the logarithm of the longest path. Minima are
    taken before the shuffle, so a node with many neighbours is no larger than any other.
    """
    one = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = one.select("a").unionByName(one.select(F.col("b").alias("a"))).distinct()
    left = one.where("a <> b")
    maps = []
    while not left.isEmpty():
        if len(maps) == levels:
            raise ValueError(f"components not settled after {levels} levels")
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low")).select("n", F.least("n", "low").alias("p")), "hooks")
        for _ in range(2):
            up = hooks.select(F.col("n").alias("u"), F.col("p").alias("pp"))
            hooks = hooks.join(up, hooks.p == up.u).select("n", F.col("pp").alias("p"))
        hooks = written(hooks, "labels")
        maps.append(hooks)
        x, y = hooks.select(F.col("n").alias("a"), F.col("p").alias("pa")), hooks.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        moved = left.join(x, "a").join(y, "b").where("pa <> pb")
        left = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    done = nodes.select(F.col("a").alias("node"), F.col("a").alias("root"))
    for hooks in maps:
        done = done.join(hooks, done.root == hooks.n, "left").select("node", F.coalesce("p", "root").alias("root"))
    # Labels fall with every level but need not end at the smallest node.
    done = written(done, "labels")
    least = written(done.groupBy("root").agg(F.min("node").alias("least")), "roots")
    return done.join(least, "root").select("node", F.col("least").alias("root"))


def candidate_groups(classes: DataFrame) -> DataFrame:
    """Rows (class, group): classes that meet in a band, directly or through others, share a group.

    classes: (class, bands). Within a band each class is linked to the smallest one, so a band that many
    share gives as many links as it has classes. Classes that meet no other are left out.
    """
    buckets = classes.select("class", F.posexplode("bands").alias("band", "hash"))
    # A table of its own, so that the planner can split what very many classes share.
    shared = written(buckets.groupBy("band", "hash").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").drop("high"), "shared-bands")
    links = buckets.join(shared, ["band", "hash"]).where("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b"))
    return components(links).select(F.col("node").alias("class"), F.col("root").alias("group"))


def in_buckets(members: DataFrame, most: int) -> DataFrame:
    """members (class, group, n_grams, bands) with `band`: -1 for groups of at most `most` classes.

    Members of larger groups get a row for each band in which they meet another, with the bucket as group.
    """
    sizes = written(members.groupBy("group").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") > most).select("group"), "large-groups")
    if sizes.isEmpty():
        return members.withColumn("band", F.lit(-1))
    whole = members.join(sizes, "group", "left_anti").withColumn("band", F.lit(-1))
    each = written(members.join(sizes, "group", "left_semi").select("class", "n_grams", "bands", F.posexplode("bands").alias("band", "hash")).select(
        "class", F.encode(F.concat_ws("|", "band", "hash"), "UTF-8").alias("group"), "n_grams", "bands", "band"
    ), "buckets")
    shared = written(each.groupBy("group").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("group"), "shared-buckets")
    return whole.unionByName(each.join(shared, "group", "left_semi"))


def _size_step(n: Column, similarity: float) -> Column:
    """Sets whose steps differ by more than one are too unequal to be similar."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(similarity)) + 1e-9).cast("int")


def block_pairs(members: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Rows (class, group, bands, band, x, y, i, j, side): each cell is one group, or two blocks of a large one.

    members: (class, group, n_grams, bands, band). Groups of more than `block` classes are dealt by set
    size and hash into blocks; each block meets itself, and those whose sizes allow similarity. The number
    of cells a class is in grows with its group's size by blocks, never by classes.
    """
    own_columns = ("class", "group", "bands", "band")
    step = _size_step(F.col("n_grams"), similarity)
    counted = written(members.groupBy("group").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > block).select(F.col("group").alias("g")), "group-sizes")
    zero, one = F.lit(0), F.lit(1)
    small = members.join(counted, members.group == counted.g, "left_anti").select(*own_columns, *(zero.alias(c) for c in ("x", "y", "i", "j", "side")))
    large = members.join(counted, members.group == counted.g, "left_semi").select(*own_columns, step.alias("step"))
    steps = large.groupBy("group", "step").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    after = steps.select("group", (F.col("step") - 1).alias("step"), F.col("blocks").alias("after"))
    before = steps.select("group", (F.col("step") + 1).alias("step"), F.col("blocks").alias("before"))
    ring = written(steps.join(after, ["group", "step"], "left").join(before, ["group", "step"], "left").na.fill(0, ["after", "before"]), "rings")
    own = large.join(ring, ["group", "step"]).withColumn("me", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda x, y, i, j, side: F.struct(x.alias("x"), y.alias("y"), i.alias("i"), j.alias("j"), side.alias("side"))
    s, me = F.col("step"), F.col("me")
    cells = F.concat(
        F.transform(upto(F.col("blocks")), lambda k: cell(s, s, F.least(me, k), F.greatest(me, k), F.when(me <= k, zero).otherwise(one))),
        F.transform(upto(F.col("after")), lambda k: cell(s, s + 1, me, k, zero)),
        F.transform(upto(F.col("before")), lambda k: cell(s - 1, s, k, me, one)),
    )
    dealt = own.select(*own_columns, F.explode(cells).alias("c")).select(*own_columns, "c.x", "c.y", "c.i", "c.j", "c.side")
    return small.unionByName(dealt)


def _overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of hashes."""
    m = len(grams)
    rows = np.repeat(np.arange(m), [len(g) for g in grams])
    values, column = np.unique(np.concatenate(grams), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1
    rank = np.cumsum(often) - 1
    keep = often[column]
    rows, column = rows[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((m, m), np.float32)
    for at in range(0, int(often.sum()), _COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + _COLUMNS))
        there = np.zeros((m, _COLUMNS), np.float32)
        there[rows[lo:hi], column[lo:hi] - at] = 1
        total += there @ there.T
    return total


def verify(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (class, links, root), one or more per class of members (class, copies, grams, group, bands, band, x, y, i, j, side).

    links counts the documents (copies) of other classes of at least this similarity within the cell,
    each pair in one cell only; root is the smallest class it reaches over such links there. Only pairs
    that meet in a band count, in a bucket (band of 0 or more) those that meet in no earlier band.
    """
    kind = T.StructType([T.StructField("class", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType())])

    def run(cell: pa.Table) -> pa.Table:
        order = np.argsort(np.array(cell.column("class").to_pylist(), dtype=object), kind="stable")
        cell = cell.take(pa.array(order))
        names, copies, side = cell.column("class").to_pylist(), cell.column("copies").to_numpy(), cell.column("side").to_numpy()
        grams = [g.values.to_numpy() for g in cell.column("grams")]
        sizes = np.array([len(g) for g in grams])
        shared = _overlaps(grams)
        union = sizes[:, None] + sizes[None, :] - shared
        alike = shared >= similarity * union - 1e-6
        np.fill_diagonal(alike, False)
        x, y, i, j = (cell.column(c)[0].as_py() for c in "xyij")
        if (x, i) != (y, j):
            alike &= side[:, None] != side[None, :]  # two blocks: each has a cell of its own for pairs within it
        band = cell.column("band")[0].as_py()
        bands = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(len(names), -1)
        met = np.zeros_like(alike)
        for hashes in (bands if band < 0 else bands[:, :band]).T:
            met |= hashes[:, None] == hashes[None, :]
        alike &= met if band < 0 else ~met
        links = alike @ copies
        root = np.arange(len(names))
        while True:
            reach = np.where(alike, root[None, :], len(names)).min(axis=1, initial=len(names))
            low = np.minimum(root, reach)
            low = low[low]
            if (low == root).all():
                break
            root = low
        out = np.flatnonzero(links > 0)
        return pa.table([pa.array([names[k] for k in out], pa.binary()), pa.array(links[out], pa.int64()), pa.array([names[root[k]] for k in out], pa.binary())], names=kind.names)

    return members.groupBy("group", "x", "y", "i", "j").applyInArrow(run, kind)


def link_documents(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, whole_group: int = WHOLE_GROUP) -> DataFrame:
    """Rows (id, v, class_id, copy_id, n_links), one per row of docs.

    Documents are linked when the Jaccard similarity of their n-gram sets is at least `similarity`; those
    of equal sets, also of no words at all, are copies and linked. class_id is the smallest id of the
    documents connected over links, copy_id the smallest id of its copies, n_links the number of
    documents linked with this one. v is xxhash64 of the text. Null ids never name a class unless all
    ids in it are null. A pair of similarity s is missed only if it never meets in a band: for
    s = `similarity` at most 1 - `recall`. `whole_group` chooses how groups are verified and changes no row.

    Exact copies are one class from the start, so they cost as one. Other columns are not carried.
    """
    sets = written(signatures(docs, *band_plan(similarity, recall), id_col, text_col, size), "signatures")
    classes = written(sets.groupBy("class").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("copy_id"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"),
        F.min(F.struct(F.col("id").isNull(), "id", "v")).alias("bearer"),
    ), "classes")
    groups = written(candidate_groups(classes.where("n_grams > 0").select("class", "bands")), "groups")
    members = written(groups.join(classes.select("class", "copies", "n_grams", "bands", "bearer"), "class"), "members")
    # One document of each class brings its text; the sets of classes that meet no other never travel.
    texts = docs.select(F.col(id_col).alias("t_id"), F.xxhash64(text_col).alias("t_v"), F.col(text_col).alias("t"))
    same = F.col("t_id").eqNullSafe(F.col("bearer.id")) & (F.col("t_v") == F.col("bearer.v"))
    brought = texts.join(members.select("class", "copies", "bearer"), same).dropDuplicates(["class"])
    grams = brought.select("class", "copies", F.array_distinct(shingle_hashes(F.col("t"), size)).alias("grams"))
    cells = block_pairs(in_buckets(members.select("class", "group", "n_grams", "bands"), whole_group), similarity)
    found = written(verify(cells.join(grams, "class"), similarity), "verified")
    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "copies", "copy_id").join(linked, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = written(named.select("class", "copy_id", F.coalesce("root", "class").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "classes")
    ids = written(named.groupBy("root").agg(F.min("copy_id").alias("class_id")), "class-ids")
    done = named.join(ids, "root").select("class", "class_id", "copy_id", "n_links")
    return sets.select("id", "v", "class").join(done, "class").select(F.col("id").alias(id_col), "v", "class_id", "copy_id", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class: that of the smallest id, and of rows with that id one with the smallest text hash.

    Rows without an id stay if no row of their class has one, else they go. Documents linked with no
    other stay as they are.
    """
    links = link_documents(docs, similarity, id_col=id_col, text_col=text_col)
    b_id, b_v = unused(docs, "id", "v")
    best = links.where(F.col(id_col) == F.col("class_id")).groupBy("class_id").agg(F.min("v").alias(b_v)).withColumnRenamed("class_id", b_id)
    # Deduplicating by the join's own keys needs no shuffle of its own.
    named = docs.join(best, (F.col(id_col) == F.col(b_id)) & (F.xxhash64(text_col) == F.col(b_v))).dropDuplicates([b_id, b_v]).select(*docs.columns)
    alone = links.where(F.col(id_col).isNull() & F.col("class_id").isNull()).select(F.col("v").alias(b_v)).distinct()
    nameless = docs.where(F.col(id_col).isNull()).join(alone, F.xxhash64(text_col) == F.col(b_v), "left_semi")
    return named.unionByName(nameless)
