"""Exact Jaccard join of documents as a metric-space join over document pivots.

Distance is 1 - Jaccard of word-shingle sets, a metric; documents link at
R = 1 - 3/4 or less. The steps:

1. Equal sets form one class; its least id stands for it.
2. First pivots. Nearly all distances between documents are 1, and there the
   triangle inequality prunes nothing: it would put every document into every
   region. So only pivots that can be near are looked up, through an inverted
   index of prefix shingles in one global order, those of rare words before those
   of common words and frequent ones last: two linked
   documents share one among their first quarter (the overlap bound). The pivot of
   a shingle is the least document that holds it there; a document belongs to the
   regions of its shingles' pivots, so each linked pair meets in a region.
3. Members within R of their pivot join its component: a group of near copies
   costs one distance a member. Regions that hold one component are done.
4. The others are cut into size windows (a set's size bounds its distance) and
   then recursively into Voronoi cells: up to PIVOTS members, of different
   components, are pivots; each member goes to its nearest pivot's cell and, with
   d its distance there, is replicated to each pivot within d + 2 R and within R of
   the cell's radius. By the triangle inequality each linked pair meets in the cell
   of either end. Pivots have met all members and leave.
5. Cells of up to LEAF members, and those in which a cut would not halve the
   comparisons (all distances alike), are compared in blocks of bounded size: a pair
   is measured only if the shared prefix shingles allow the threshold.
6. Links give components. No bound drops a pair that reaches the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import drop, own_shuffles, stash
from .shingles import as_set, batch_sets, batch_words, ordered_set

#: Frequent shingles that are put last in the order; it only affects speed.
FREQUENT = 1 << 17
#: Shingles counted together, and the least count there that is reported.
COUNTED, REPORTED = 1 << 21, 3
#: Common words, by which shingles are ordered, and the least count of a word that is reported.
WORDS, WORD_REPORTED = 1 << 16, 32
#: Prefix rows are dealt by shingle to up to SLICES shuffles, one after the other, from SLICE_ROWS rows each.
SLICES, SLICE_ROWS = 4, 1 << 23
#: Row ids are broadcast up to this many (8 MB), else shuffled.
BROADCAST_ROWS = 1_000_000
BLOCK, LEAF, PIVOTS = 64, 128, 8
#: A cell is cut only if that leaves at most this share of its comparisons.
THINNED = 0.5
#: Rows of whole texts, or of pairs of sets, in one Arrow batch.
TEXTS, SETS = 1000, 250
R = 0.25


def probe_length(n):
    """First shingles, in the global order, of which linked sets share one: n - ceil(3n/4) + 1."""
    return n - (3 * n + 3) // 4 + 1


def index_length(n):
    """The same for the smaller of two sets: n - ceil(6n/7) + 1."""
    return n - (6 * n + 6) // 7 + 1


def pick_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on ``doc_id``: a broadcast for few ids, a shuffle beyond."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", how)


def profile(texts: DataFrame, width: int) -> DataFrame:
    """One row per document (n, key of its set) and one per frequent shingle, or common word, of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, words = Chunk(REPORTED), Chunk(WORD_REPORTED)
        for batch in batches:
            n, key = [], []
            for said in batch_words(batch.column(1)):
                x = as_set(said, width)
                n.append(len(x))
                key.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                for found in shingles.add(x):
                    yield row(token=found)
                for found in words.add(said):
                    yield row(word=found)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), none, none, none], names=names)
        yield row(token=shingles.counts())
        yield row(word=words.counts())

    def row(token: tuple | None = None, word: tuple | None = None) -> pa.RecordBatch:
        key, count = token or word
        none, key = pa.nulls(len(key), pa.int64()), pa.array(key.view(np.int64))
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(key), pa.binary()), key if token else none, pa.array(count, pa.int64()), key if word else none], names=names)

    names = ["doc_id", "n", "key", "token", "count", "word"]
    return texts.mapInArrow(run, "doc_id long, n long, key binary, token long, count long, word long")


class Chunk:
    """Counts keys, COUNTED at a time, and gives those found ``least`` times there."""

    def __init__(self, least: int):
        self.held, self.size, self.least = np.empty(COUNTED, np.uint64), 0, least

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(keys), COUNTED):
            part = keys[at : at + COUNTED]
            if self.size + len(part) > COUNTED:
                yield self.counts()
            self.held[self.size : self.size + len(part)] = part
            self.size += len(part)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        held, least = self.held[: self.size], self.least
        held.sort()
        at = np.flatnonzero(held[least - 1 :] == held[: len(held) - least + 1]) if len(held) >= least else np.zeros(0, np.int64)
        at = at[np.append(True, held[at[1:]] != held[at[:-1]])] if len(at) else at  # first places of those that repeat so often
        key = held[at]
        self.size = 0
        return key, np.searchsorted(held, key, "right") - at


def commonest(seen: DataFrame, kind: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a ``kind`` with the highest counts, in ascending order, and their counts."""
    with own_shuffles(seen.sparkSession):
        top = seen.where(f"{kind} is not null").groupBy(F.col(kind).alias("key")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "key").limit(most).collect()
    key, count = np.array([r["key"] for r in top], np.int64).view(np.uint64), np.array([r["count"] for r in top], np.int64)
    order = np.argsort(key)
    return key[order], count[order]


def prefixes(texts: DataFrame, width: int, frequent: np.ndarray, rank: np.ndarray, words: np.ndarray, often: np.ndarray) -> DataFrame:
    """``(token, node, n, first)``: each set's probe prefix and size; first: also in the index prefix.

    The order: shingles of rare words first, by the logarithms of the counts of
    their words, so that few texts share one by chance; ``frequent`` ones last.
    """
    level = np.round(4 * np.log2(np.maximum(often, 1))).astype(np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, count, first, size = [], [], [], []
            for said in batch_words(batch.column(1)):
                x = ordered_set(said, width, words, level)
                n = len(x)
                if n and len(frequent):
                    at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                    common = frequent[at] == x
                    if common.any():
                        late = np.argsort(rank[at[common]], kind="stable")
                        x = np.concatenate([x[~common], x[common][late]])
                p = probe_length(n) if n else 0
                token.append(x[:p])
                count.append(p)
                size.append(n)
                first.append(np.arange(p) < (index_length(n) if n else 0))
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), count)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(node, pa.int64()), pa.array(np.repeat(np.array(size, np.int64), count)), pa.array(np.concatenate(first))], names=["token", "node", "n", "first"])

    return texts.mapInArrow(run, "token long, node long, n long, first boolean")


def place(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(token, node, n, pivot, open)`` of the prefix rows whose shingle another document holds, and where they are kept.

    Shingles are dealt to slices, so that only a slice's rows are on disk twice.
    """
    slices = min(SLICES, 1 + rows.count() // SLICE_ROWS)
    found, kept = None, []
    for k in range(slices):
        own = rows.where(F.pmod("token", F.lit(slices)) == k)
        regions = own.groupBy("token").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.max("first").alias("open"))
        regions, regions_at = stash(regions.where("pivot <> last").select("token", "pivot", "open"), "regions")
        part, at = stash(own.join(regions, "token").select("token", "node", "n", "pivot", "open"), "placed")
        drop(rows.sparkSession, regions_at)
        found, kept = part if found is None else found.union(part), [*kept, at]
    return found, kept


def overlap_needed(a: str, b: str):
    """ceil(3 (a + b) / 7) less what the longer rest behind a prefix can hold."""
    a, b = F.col(a), F.col(b)
    return F.ceil(3 * (a + b) / 7) - F.ceil(3 * F.greatest(a, b) / 4) + 1


def near_size(a: str, b: str):
    return 4 * F.least(F.col(a), F.col(b)) >= 3 * F.greatest(F.col(a), F.col(b))


def shared_shingles(texts: DataFrame, pairs: DataFrame, width: int) -> tuple[DataFrame, str]:
    """``(a, b, total, shared)`` of the pairs ``(a, b)``: sizes of both whole sets, and of what they share.

    Where an id repeats with other texts, a pair has a row for each two texts.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in batch_sets(batch.column(1), width)], pa.binary())], names=["node", "tokens"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, shared = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                total.append(len(both))
                shared.append(int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(shared, pa.int64())], names=["a", "b", "total", "shared"])

    pairs, pairs_at = stash(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    found, found_at = stash(pick_ids(texts, ids, "left_semi").mapInArrow(sets, "node long, tokens binary"), "sets", TEXTS)
    left = found.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = found.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    out = stash(rows.mapInArrow(measured, "a long, b long, total long, shared long"), "shared", SETS)
    drop(texts.sparkSession, pairs_at, found_at)
    return out


def linked(total: str = "total", shared: str = "shared") -> Column:
    return 7 * F.col(shared) >= 3 * F.col(total)


def verify(texts: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs ``(a, b)`` that link, by whole sets."""
    return shared_shingles(texts, pairs, width)[0].where(linked()).select("a", "b")


def cell_pairs(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidate pairs within cells: several components, sizes near, prefixes shared enough."""
    key = ["cell"]
    sides = cells.groupBy(*key, "label").agg(F.count("*").alias("k"))
    total = sides.groupBy(*key).agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("k_main"), F.sum("k").alias("k"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = cells.select("cell", "node", "n", "label", "home").join(total, key).join(sizes.select("node", "n", "tokens"), ["node", "n"]).withColumn("is_main", F.col("label") == F.col("main"))
    rows = rows.withColumn("main_blocks", blocks(F.col("k_main"))).withColumn("other_blocks", blocks(F.col("k") - F.col("k_main")))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("other_blocks"))).cast("int")
    rows = rows.withColumn("own", own)
    others = F.transform(F.sequence(F.lit(0), F.col("other_blocks") - 1), lambda o: F.when(F.col("is_main"), F.struct(o.alias("i"), (-1 - F.col("own")).alias("j"))).otherwise(F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"))))
    mains = F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda m: F.struct(F.col("own").alias("i"), (-1 - m).alias("j")))
    unit = F.explode(F.when(F.col("is_main"), others).otherwise(F.concat(others, mains)))
    rows = rows.withColumn("unit", unit).select(*key, "unit.i", "unit.j", "node", "n", "home", "label", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        node, label = table["node"].to_numpy(), table["label"].to_numpy()
        n, native = table["n"].to_numpy(), table["home"].to_numpy(zero_copy_only=False)
        lists = table["tokens"].combine_chunks()
        token = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(node)), lists.value_lengths().to_numpy(zero_copy_only=False))
        shared = np.zeros((len(node), len(node)), np.float32)
        count = np.bincount(token) if len(token) else np.zeros(0, int)
        place = np.cumsum(count > 1) - 1
        seen = count[token] > 1
        token, owner = place[token[seen]], owner[seen]
        for at in range(0, int(token.max()) + 1 if len(token) else 0, 4096):
            part = (token >= at) & (token < at + 4096)
            grid = np.zeros((len(node), 4096), np.float32)
            grid[owner[part], token[part] - at] = 1
            shared += grid @ grid.T
        low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
        need = -((-3 * (low + high)) // 7) + (-3 * high) // 4 + 1
        ok = (node[:, None] < node[None, :]) & (label[:, None] != label[None, :]) & (native[:, None] | native[None, :]) & (4 * low >= 3 * high) & (shared >= np.maximum(need, 1))
        a, b = np.nonzero(ok)
        return pa.table({"a": node[a].astype(np.int64), "b": node[b].astype(np.int64)})

    return rows.groupBy(*key, "i", "j").applyInArrow(compare, "a long, b long").distinct()


def mixed_cells(cells: DataFrame) -> DataFrame:
    """Rows of the cells that hold several components and a home member, with the cell's size ``k``."""
    sides = cells.groupBy("cell", "label").agg(F.count("*").alias("k"), F.max("home").alias("home"), F.max("flat").alias("flat"))
    mixed = sides.groupBy("cell").agg(F.sum("k").alias("k"), F.count("*").alias("sides"), F.max("home").alias("home"), F.max("flat").alias("flat"))
    return cells.drop("flat").join(mixed.where("sides > 1 and home").select("cell", "k", "flat"), "cell")


def voronoi(texts: DataFrame, rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Cut each cell by up to PIVOTS members: ``(links, smaller cells)``.

    A pivot is the least member of the commonest component among those that share
    a remainder, so finding them is a partial aggregation whatever a cell's size.
    """
    spark = texts.sparkSession
    sides = rows.groupBy("cell", "label").agg(F.count("*").alias("many"), F.min(F.struct("node", "n")).alias("lead"))
    seat = F.pmod(F.xxhash64("label"), F.lit(PIVOTS))
    pivots = sides.groupBy("cell", seat.alias("seat")).agg(F.max_by("lead", F.struct("many", "label")).alias("lead"))
    pivots, pivots_at = stash(pivots.select("cell", F.col("lead.node").alias("pivot"), F.col("lead.n").alias("n_pivot")), "pivots")
    met = rows.join(pivots, "cell").where("node <> pivot")
    pairs = met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    shared, _ = shared_shingles(texts, pairs, width)
    far = F.min(1 - F.col("shared") / (F.col("total") - F.col("shared")))
    known = shared.groupBy("a", "b").agg(far.alias("d"))
    seen = met.withColumn("a", F.least("node", "pivot")).withColumn("b", F.greatest("node", "pivot")).join(known, ["a", "b"])
    near = seen.groupBy("cell", "node", "n").agg(F.min(F.struct("d", "pivot")).alias("near"))
    seen = seen.select("cell", "k", "node", "n", "label", "home", "pivot", "d").join(near, ["cell", "node", "n"])
    seen = seen.join(pivots.select("cell", F.col("pivot").alias("node"), F.lit(True).alias("seated")), ["cell", "node"], "left_anti")
    seen, seen_at = stash(seen.withColumn("own", F.col("pivot") == F.col("near.pivot")).withColumn("limit", F.col("near.d") + 2 * R), "voronoi")
    radius = seen.where("own and home").groupBy("cell", "pivot").agg(F.max("d").alias("radius"))
    slack = 1e-9
    inside = F.col("own") | (F.col("d") <= F.least("limit", F.col("radius") + R) + slack)
    parts, parts_at = stash(seen.join(radius, ["cell", "pivot"]).where(inside).drop("radius"), "parts")
    work = parts.groupBy("cell", "pivot").agg(F.count("*").alias("m"), F.max("k").alias("k"))
    work = work.groupBy("cell").agg((F.sum(F.col("m") * F.col("m")) > THINNED * F.max(F.col("k") * F.col("k"))).alias("flat"))
    work, work_at = stash(work, "work")
    cut = parts.join(work.where("not flat").select("cell"), "cell")
    cut = cut.select(F.xxhash64("cell", "pivot").alias("cell"), "node", "n", "label", (F.col("home") & F.col("own")).alias("home"), F.lit(False).alias("flat"))
    whole = seen.where("own").join(work.where("flat").select("cell", "flat"), "cell").select("cell", "node", "n", "label", "home", "flat")
    cells, _ = stash(cut.union(whole), "cells")
    drop(spark, pivots_at, seen_at, parts_at, work_at)
    return shared.where(linked()).select("a", "b"), cells


def cell_links(texts: DataFrame, cells: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """All links between different components within ``cells(cell, node, n, label, home, flat)``."""
    spark = texts.sparkSession
    links = []
    while True:
        rows, rows_at = stash(mixed_cells(cells), "mixed")
        small = (F.col("k") <= LEAF) | F.col("flat")
        leaves = rows.where(small)
        if leaves.limit(1).count():
            links.append(verify(texts, cell_pairs(leaves, sizes), width))
        big = rows.where(~small)
        if not big.limit(1).count():
            break
        found, cells = voronoi(texts, big, width)
        links.append(found)
        drop(spark, rows_at)
    out = links[0] if links else None
    for more in links[1:]:
        out = out.union(more)
    return out if out is not None else spark.createDataFrame([], "a long, b long")


def repeated_ids(members: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the classes of rows that share an id."""
    rows = members.join(repeated, "doc_id")
    least = rows.groupBy("doc_id").agg(F.min("node").alias("a"))
    return rows.join(least, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()


def jaccard_components(df: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``df``.

    Threshold: 100 * intersection >= 75 * union. ``component_id`` is the least
    id reachable over links, itself included. Null and empty texts, and texts
    without words, have no shingle and link with nothing; fewer words than
    ``width`` form one shingle. Very long texts are read in pieces of a megabyte
    and compared whole. Rows that share an id count as one linked document,
    whatever their texts; a null id keeps a null component and links with nothing.
    An empty table gives an empty one. Columns other than id and text are not read.
    """
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen, seen_at = stash(profile(texts, width), "profile", TEXTS)
    docs = seen.where("n is not null").select("doc_id", "n", "key")
    frequent, rank = commonest(seen, "token", FREQUENT)
    words, count = commonest(seen, "word", WORDS)

    sets = docs.where("key is not null and doc_id is not null")
    repeated = sets.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id")
    repeated, _ = stash(repeated, "repeated")
    shared, shared_at = stash(sets.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").select("key", "rep"), "classes")
    members = docs.where("key is not null").join(shared, "key", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("node"))
    members, _ = stash(members.union(docs.where("key is null").select("doc_id", "n", F.col("doc_id").alias("node"))), "members")
    drop(spark, seen_at, shared_at)

    live = texts.where("doc_id is not null")
    stands = members.where("node <> doc_id").select("doc_id").distinct().join(members.where("node = doc_id").select("doc_id"), "doc_id", "left_anti")
    live = pick_ids(live, stash(stands, "copies")[0], "left_anti")
    rows, rows_at = stash(prefixes(live, width, frequent, rank, words, count), "prefixes", TEXTS)
    placed, placed_at = place(rows)
    drop(spark, rows_at)

    sizes = placed.groupBy("node", "n").agg(F.collect_set("token").alias("tokens"))
    sizes, sizes_at = stash(sizes.withColumn("m", F.size("tokens")), "sizes")
    stars, stars_at = stash(placed.where("open and node <> pivot").select("pivot", "node").distinct(), "stars")
    drop(spark, *placed_at)

    # token lists are joined only to pairs whose sizes allow a link
    few = lambda x: sizes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("m").alias(f"m_{x}"))
    of = lambda x: sizes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    met = stars.withColumnRenamed("node", "member").join(few("pivot"), "pivot").join(few("member"), "member").where(near_size("n_pivot", "n_member"))
    met = met.where(F.least("m_pivot", "m_member") >= overlap_needed("n_pivot", "n_member"))
    met = met.join(of("pivot"), ["pivot", "n_pivot"]).join(of("member"), ["member", "n_member"])
    met = met.where(F.size(F.array_intersect("t_pivot", "t_member")) >= overlap_needed("n_pivot", "n_member"))
    links = verify(live, met.select(F.col("pivot").alias("a"), F.col("member").alias("b")).distinct(), width)
    labels = components(links.union(repeated_ids(members, repeated)))

    klass = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)))
    windows = F.explode(F.array(F.struct(klass.alias("size_class"), F.lit(True).alias("home")), F.struct((klass - 1).alias("size_class"), F.lit(False).alias("home"))))
    cells = stars.join(sizes.select("node", "n"), "node").join(labels, "node", "left")
    cells = cells.select("pivot", "node", "n", F.coalesce("label", "node").alias("label"), windows.alias("w"))
    # an id with several texts is no point of the metric space: its cells are not cut
    several = repeated.select(F.col("doc_id").alias("node"), F.lit(True).alias("flat"))
    cells = cells.select(F.xxhash64("pivot", "w.size_class").alias("cell"), "node", "n", "label", "w.home").join(several, "node", "left")
    cells = cells.select("cell", "node", "n", "label", "home", F.coalesce("flat", F.lit(False)).alias("flat"))
    cells, cells_at = stash(cells, "cells")
    drop(spark, stars_at)
    more = cell_links(live, cells, sizes, width)
    drop(spark, cells_at, sizes_at)
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
    bridges = more.join(named("a"), "a", "left").join(named("b"), "b", "left")
    bridges = components(bridges.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")))

    out = members.join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("near"))
    out = out.join(bridges.select(F.col("node").alias("near"), "label"), "near", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("label", "near").alias("component_id"))


def drop_near_copies(df: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` but one of each component: that of the least id.

    Of rows that share an id, one stays (the least by its text). Rows with a null
    id stay; so does a column ``doc_id`` beside another ``id_col``. Null and empty
    texts link with nothing and stay. An empty table gives an empty one.
    """
    found, _ = stash(jaccard_components(df, width, id_col, text_col).withColumnRenamed(id_col, "doc_id"), "components")
    gone, _ = stash(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    rows = drop_ids(df, gone, id_col)
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    twice, _ = stash(twice, "twice")
    if not twice.limit(1).count():
        return rows
    mine = fresh(df)
    row = F.struct(F.col(text_col).alias("t"), *[F.to_json(F.struct(c)).alias(f"c{k}") for k, c in enumerate(df.columns)])
    some = rows.withColumn(mine, F.col(id_col).cast("long")).join(twice.withColumnRenamed("doc_id", mine), mine, "left_semi")
    some = some.groupBy(mine).agg(F.min_by(F.struct(*df.columns), row).alias("row")).select("row.*")
    return drop_ids(rows, twice, id_col).unionByName(some)


def fresh(df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    name = "own_id"
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def drop_ids(df: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``gone(doc_id)``; rows with a null id stay."""
    mine = fresh(df)
    ids = gone.select(F.col("doc_id").alias(mine))
    rows = df.withColumn(mine, F.col(id_col).cast("long"))
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, mine, "left_anti").select(*df.columns)
