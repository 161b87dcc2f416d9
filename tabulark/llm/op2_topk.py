"""Exact top-k inner-product search by no-random-access aggregation.

Every dimension is a list of the candidates' values.  A query reads its lists
one after the other, the heaviest weights first, and what it has read of a
candidate counts exactly.  What the unread lists can still add lies between two
bounds: the smaller of what the lists' heads allow and of the product of what
is left of both vectors' norms (Cauchy and Schwarz; norms come with the block).
So every candidate has a lower and an upper score.  After each stretch of
lists, candidates whose upper bound is under the k-th lower bound leave: no
more of them is read, and their scores are never resolved.  Reading stops for a
query when only k candidates can qualify or its lists are at their end; then
the scores of those that are left are resolved exactly.  The k-th best of
earlier blocks of a task bounds the later ones.

Queries and candidates meet block by block: each query block is sent to every
slice of the candidates, so that no key holds more than its share.  Only k rows
a query leave a pair of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, QUERY_BLOCK, BLOCK = 5, 1024, 8192
#: Shares of a query's squared weights that lists read so far hold at the end of each stretch; queries that are read together.
STRETCHES, TOGETHER = (0.85, 0.93, 0.97, 0.99), 128


def whole(embedding: Column) -> Column:
    """floor(256 x) of every component; null for vectors that take no part."""
    ok = embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(ok, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256)))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """vectors(vec_id, v array<bigint>) as rows of up to size vectors of one
    width: width, ids and values in bytes."""

    def run(batches):
        kept: dict[int, list] = {}

        def full(width):
            ids, rows = zip(*kept.pop(width))
            return pa.RecordBatch.from_pylist([{"width": width, "ids": np.array(ids, "<i8").tobytes(), "values": np.array(rows, "<i8").tobytes()}], schema=schema)

        schema = pa.schema([("width", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())])
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kept.setdefault(len(v), []).append((i, v))
                if len(kept[len(v)]) >= size:
                    yield full(len(v))
        for width in list(kept):
            yield full(width)

    return vectors.select("vec_id", "v").mapInArrow(run, "width int, ids binary, values binary")


class Lists:
    """The lists of a block: values, their squares, each list's highest and lowest value."""

    def __init__(self, values: np.ndarray):
        self.whole, self.values = values, values.astype(np.float64)
        self.squares = self.values * self.values
        self.high, self.low = self.values.max(0), self.values.min(0)


def search(queries: np.ndarray, query_ids: np.ndarray, lists: Lists, ids: np.ndarray, k: int, floor: np.ndarray, reads: dict | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate ids, scores) of each query's k best in a block.

    floor: for each query, a score that k candidates of earlier blocks reach.
    reads, if given, counts the values read and the scores resolved.
    """
    out = []
    for at in range(0, len(queries), TOGETHER):
        part = slice(at, at + TOGETHER)
        for row, found, score in _search(queries[part], query_ids[part], lists, ids, k, floor[part], reads):
            out.append((at + row, found, score))
    return out


def _search(queries, query_ids, lists: Lists, ids, k: int, floor, reads):
    q = queries.astype(np.float64)
    n, width = len(ids), q.shape[1]
    order = np.argsort(-np.abs(q), axis=1, kind="stable")
    weights = np.take_along_axis(q, order, axis=1)
    energy = np.cumsum(weights * weights, axis=1)
    total = energy[:, -1]
    # what lists not yet read can add at most and at least by their heads, from the end of the order
    ends = np.stack([np.maximum(q * lists.high, q * lists.low), np.minimum(q * lists.high, q * lists.low)])
    ends = np.take_along_axis(ends, order[None], axis=2)
    after = np.concatenate([np.cumsum(ends[:, :, ::-1], axis=2)[:, :, ::-1], np.zeros((2, len(q), 1))], axis=2)
    depths = [np.minimum((energy < share * total[:, None]).sum(1) + 1, width) for share in STRETCHES]
    slack = 1 + 1e-9 * np.sqrt(total * lists.squares.sum(1).max(initial=0.0))  # of the bounds' arithmetic

    def bounds(seen, rest, rows, depth):
        left = np.sqrt(np.maximum(total[rows] - energy[rows, depth - 1], 0))
        norm = left * np.sqrt(np.maximum(rest, 0))
        upper = seen + np.minimum(norm, after[0, rows, depth]) + slack[rows]
        return seen + np.maximum(-norm, after[1, rows, depth]) - slack[rows], upper

    def reached(lower, row):
        """The k-th best lower bound; one of the k may be the query's own row."""
        return max(floor[row], np.partition(lower, len(lower) - k - 1)[len(lower) - k - 1]) if len(lower) > k else floor[row]

    # first stretch: all candidates, by matrix products
    depth = depths[0]
    read = np.zeros(q.shape, bool)
    np.put_along_axis(read, order, np.arange(width)[None, :] < depth[:, None], axis=1)
    seen = (q * read) @ lists.values.T
    rest = (~read).astype(np.float64) @ lists.squares.T
    lower, upper = bounds(seen, rest, np.arange(len(q))[:, None], depth[:, None])
    out, resolved, values = [], 0, int(depth.sum()) * n
    for row in range(len(q)):
        open_ = np.flatnonzero(upper[row] >= reached(lower[row], row))
        s, r, d = seen[row, open_], rest[row, open_], int(depth[row])
        for more in depths[1:]:
            to = int(more[row])
            if len(open_) <= k or to <= d:
                continue
            next_lists = order[row, d:to]
            s = s + lists.values[np.ix_(open_, next_lists)] @ q[row, next_lists]
            r = r - lists.squares[np.ix_(open_, next_lists)].sum(1)
            values, d = values + len(open_) * (to - d), to
            low, up = bounds(s, r, row, d)
            keep = up >= reached(low, row)
            open_, s, r = open_[keep], s[keep], r[keep]
        score = lists.whole[open_] @ queries[row]
        resolved, values = resolved + len(open_), values + len(open_) * (width - d)
        best = np.flatnonzero((ids[open_] != query_ids[row]) & (score >= floor[row]))
        best = best[np.lexsort((ids[open_][best], -score[best]))][:k]
        if len(best):
            out.append((row, ids[open_][best], score[best]))
    if reads is not None:
        for name, more in (("values", values), ("resolved", resolved), ("all values", n * q.size), ("all scores", n * len(q))):
            reads[name] = reads.get(name, 0) + more
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products.

    vectors(vec_id, v, ...): v is an array of whole numbers; null vectors and
    null ids take no part, and vectors meet those of their own width only.  Ties
    go to the smaller vec_id.  Every row counts: rows of an id that repeats are
    candidates each for themselves, and as queries they share one list of k; rows
    of a query's own id are not its candidates.  Fewer candidates give fewer
    rows, an empty table none; other columns are ignored.
    """
    spark = vectors.sparkSession
    base = vectors.where("v is not null and vec_id is not null").select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, n_q = base.agg(F.count("*"), F.count_if("asks")).first()
    if not n_q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_parts, slices = max(1, math.ceil(n_q / query_block)), max(1, math.ceil(n / block))
    dealt = lambda df, parts: df.repartition(parts, F.xxhash64("vec_id", "v"))
    left = blocks(dealt(base.where("asks"), q_parts), query_block).select("width", F.col("ids").alias("q_ids"), F.col("values").alias("q_values"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    right = blocks(dealt(base, slices), block).select("width", "ids", "values", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int").alias("slice"))
    # the candidate blocks of a slice are few and wait, the query blocks pass by
    pairs = left.join(right.hint("merge"), ["width", "slice"])

    def run(batches):
        names = ("query_id", "vec_id", "score")
        floors: dict[bytes, np.ndarray] = {}
        held: dict[bytes, Lists] = {}
        for b in batches:
            for at in range(b.num_rows):
                width = b.column("width")[at].as_py()
                q_ids, ids = (np.frombuffer(b.column(c)[at].as_py(), "<i8") for c in ("q_ids", "ids"))
                q, raw = np.frombuffer(b.column("q_values")[at].as_py(), "<i8").reshape(-1, width), b.column("values")[at].as_py()
                if raw not in held:
                    if len(held) > 3:
                        held.clear()
                    held[raw] = Lists(np.frombuffer(raw, "<i8").reshape(-1, width))
                if len(floors) > 1000:
                    floors.clear()
                floor = floors.setdefault(q_ids.tobytes() + q.tobytes(), np.full(len(q_ids), -np.inf))
                got = search(q, q_ids, held[raw], ids, k, floor)
                for i, _, score in got:
                    if len(score) == k:
                        floor[i] = max(floor[i], score[-1])
                if got:
                    cols = [np.concatenate([np.full(len(v), q_ids[i]) for i, v, _ in got]), np.concatenate([v for _, v, _ in got]), np.concatenate([s for _, _, s in got])]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)

    found = pairs.select("width", "q_ids", "q_values", "ids", "values").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors.select("vec_id", whole(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
pairs as (
  select a.vec_id as query_id, b.vec_id, list_dot_product(a.v, b.v)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 5
"""
