"""Cosine top-k: exact, through inverted lists, and fused with a lexical rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cairn.functions.text import cosine_distance

RANK_OFFSET = 60
#: Rows, and queries, of a list that one group compares; queries of one matrix product; rounding error of a product of unit vectors, and more.
BLOCK, QUERIES, MARGIN = 4096, 256, 1e-12


def top_k(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The k nearest of ``(vec_id, embedding)`` by cosine distance, ties by id: one scan, k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", cosine_distance(F.col("embedding"), q).alias("distance")).orderBy(F.col("distance").asc_nulls_last(), "vec_id").limit(k)


def fit_lists(vectors: DataFrame, lists: int = 100, sample: int = 20_000, seed: int = 1):
    """K-means centres, fitted on at most ``sample`` rows chosen by a hash of the id, of those with a direction."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = F.col("embedding").cast("array<double>")
    norm = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    some = vectors.where((norm > 0) & (norm < float("inf"))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(some.select(array_to_vector(x).alias("features")))
    return [c.tolist() for c in model.clusterCenters()]


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as doubles, and their norms: -1 for null, another width, null elements or a norm of 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width
    m, norms = np.zeros((len(column), width)), np.full(len(column), -1.0)
    flat = pc.list_flatten(column.filter(pa.array(fits)))
    m[fits] = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    fits[fits] = ~pc.is_null(flat).to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
    norms[fits] = np.sqrt(in_order(m[fits] * m[fits]))
    norms[norms == 0] = -1.0
    return m, norms


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows from the left, as ``cosine_distance`` adds."""
    return products.cumsum(axis=1)[:, -1]


def plain(norms: np.ndarray) -> np.ndarray:
    return (norms > 0) & (norms < np.inf)


def nearest_lists(vectors: DataFrame, centres: list, n: int = 1) -> DataFrame:
    """Each row with its ``n`` nearest lists; every row is indexed, those without a direction in the first lists."""
    c = np.array(centres, dtype=float)
    c /= np.linalg.norm(c, axis=1, keepdims=True)

    def nearest(column: pa.Array) -> pa.Array:
        m, norms = matrix(column, c.shape[1])
        score = np.zeros((len(m), len(c)))
        ok = plain(norms)
        score[ok] = m[ok] / norms[ok, None] @ c.T
        ids = np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)
        return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * ids.shape[1], ids.ravel())

    return vectors.withColumn("list_id", F.explode(F.arrow_udf(nearest, "array<int>")("embedding")))


def nearest_in_block(rows: pa.Table, asked: pa.Table, k: int, width: int) -> pa.Table:
    """For each query its k nearest rows: finite distances, then NaN, then null, ties by id.

    Of equal vectors only the k smallest ids can be among them. Matrix products
    find all rows within ``MARGIN`` of the k-th; their distances are computed anew,
    added as ``cosine_distance`` adds, so that equal vectors have equal distances.
    """
    rows = rows.take(pc.sort_indices(rows, [("vec_id", "ascending")], null_placement="at_start"))
    (m, a), (q, b) = matrix(rows["embedding"], width), matrix(asked["q"], width)
    at, of, distance = [], [], []

    def add(queries, found, values):
        at.append(queries), of.append(found), distance.append(values)

    some = np.flatnonzero(plain(a))
    if len(some):
        _, equal = np.unique(np.ascontiguousarray(m[some]).view(f"V{width * 8}").ravel(), return_inverse=True)
        order = np.argsort(equal.ravel(), kind="stable")
        first = np.flatnonzero(np.diff(equal.ravel()[order], prepend=-1))
        seen = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
        some = np.sort(some[order[seen < k]])
    unit = (m[some] / a[some, None]).T
    clear = np.flatnonzero(plain(b))
    for part in np.array_split(clear, -(-len(clear) // QUERIES) or 1):
        if not len(some) or not len(part):
            continue
        far = -(q[part] / b[part, None] @ unit)
        near = far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k] + MARGIN if len(some) > k else np.ones(far.shape, bool)
        i, j = np.nonzero(near)
        i, j = part[i], some[j]
        exact = np.concatenate([1 - in_order(m[y] * q[x]) / (a[y] * b[x]) for x, y in zip(*(np.array_split(z, len(i) // BLOCK + 1) for z in (i, j)), strict=True)])
        order = np.lexsort((j, exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        keep = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i))) < k
        add(i[keep], j[keep], exact[keep])
    # -2 stands for null
    lacks, odd = np.flatnonzero(a < 0), np.flatnonzero(~plain(a) & ~(a < 0))
    if len(some) < k:
        rest = np.concatenate([odd, lacks])[: k - len(some)]
        add(np.repeat(clear, len(rest)), np.tile(rest, len(clear)), np.tile(np.where(a[rest] < 0, -2.0, np.nan), len(clear)))
    for x in np.flatnonzero(~plain(b)):
        rest = np.arange(min(k, len(a))) if b[x] < 0 else np.concatenate([np.flatnonzero(~(a < 0))[:k], lacks])[:k]
        add(np.full(len(rest), x), rest, np.where((a[rest] < 0) | (b[x] < 0), -2.0, np.nan))
    i, j, d = (np.concatenate([np.empty(0, t), *z]).astype(t) for z, t in ((at, np.int64), (of, np.int64), (distance, float)))
    return pa.table({"query_id": asked["query_id"].take(pa.array(i)), "vec_id": rows["vec_id"].take(pa.array(j)), "distance": pa.array(d, mask=d == -2.0, from_pandas=False)})


def ivf_top_k(index: DataFrame, queries: DataFrame, centres: list, k: int = 5, probes: int = 10) -> DataFrame:
    """For each ``(query_id, embedding)`` the k nearest rows of the probed lists of ``index``, null distances last.

    A list is cut into blocks of about ``BLOCK`` rows, its queries too, and each
    block of rows meets each block of queries in one group; nothing is left out.
    """
    probing = nearest_lists(queries.select("query_id", "embedding"), centres, probes).select("query_id", "list_id", F.col("embedding").alias("q"))
    index, width = index.select("vec_id", "list_id", "embedding"), len(centres[0])
    blocks = lambda df, name: df.groupBy("list_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cut = F.broadcast(blocks(index, "rows_in").join(blocks(probing, "asked_in"), "list_id"))
    dealt = lambda key, own: F.pmod(F.xxhash64(key), F.col(own)).cast("int")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    rows = index.join(cut, "list_id").select("list_id", dealt("vec_id", "rows_in").alias("i"), every("asked_in").alias("j"), "vec_id", "embedding")
    asked = probing.join(cut, "list_id").select("list_id", every("rows_in").alias("i"), dealt("query_id", "asked_in").alias("j"), "query_id", "q")
    schema = StructType([asked.schema["query_id"], rows.schema["vec_id"], StructField("distance", DoubleType())])
    cells = [df.groupBy("list_id", "i", "j") for df in (rows, asked)]
    pairs = cells[0].cogroup(cells[1]).applyInArrow(lambda x, y: nearest_in_block(x, y, k, width), schema)
    best = W.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def fused(dense: DataFrame, sparse: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two rankings ``(id, rank)``."""
    both = dense.select("id", F.col("rank").alias("a")).join(sparse.select("id", F.col("rank").alias("b")), "id", "full")
    part = lambda c: F.coalesce(1 / (RANK_OFFSET + F.col(c)), F.lit(0.0))
    return both.select("id", (part("a") + part("b")).alias("score")).orderBy(F.desc("score"), "id").limit(k)
