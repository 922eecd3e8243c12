"""Exact top-k inner products.

Vectors are processed by descending length. Each is turned into the basis of the
right singular vectors of all rows (the eigenvectors of the summed Gram matrix), so
that the leading coordinates hold most of the length. A partial inner product over
those, plus the Cauchy-Schwarz bound of what is left, discards most candidates; the
integer inner product is computed only for the others.

Rows and queries travel in blocks (a matrix in one binary cell). A first pass runs
every query against the block of the longest vectors, which gives each query a
threshold; the second pairs query blocks with the row blocks that may still reach it.
The pairs are an equi-join on a shard number, so their work is spread evenly whatever
the ids and vectors are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import checkpointed

#: Rows in a block of candidates and in a block of queries.
BLOCK_ROWS, QUERY_ROWS = 4096, 512
#: Rows that share one threshold test inside a block.
STRIP = 512
#: Share of the squared length that the leading coordinates must hold.
HEAD_ENERGY = 0.7
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

BLOCK = "dim int, block long, n int, longest double, ids binary, vectors binary"


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024, carried: Sequence[str] = ()) -> DataFrame:
    """id, v (and the carried columns): floor(scale * x) of each component, x as double; beyond 64 bits the ends of these.

    Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, take no part.
    """
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *carried)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(row["n"], row["dim"])


def _blocks(rows: int):
    """Rows sorted by (dim, length) become blocks of at most so many rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"dim": None, "ids": [], "v": []}

        def flush() -> Iterator[pa.RecordBatch]:
            if held["ids"]:
                v = np.array(held["v"], np.int64).reshape(len(held["ids"]), held["dim"])
                longest = float(np.sqrt((v.astype(float) ** 2).sum(1)).max())
                row = {"dim": held["dim"], "block": held["first"], "n": len(v), "longest": longest, "ids": np.array(held["ids"], np.int64).tobytes(), "vectors": v.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())]))
            held["ids"], held["v"] = [], []

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(v) != held["dim"] or len(held["ids"]) >= rows:
                    yield from flush()
                    held["dim"], held["first"] = len(v), i
                held["ids"].append(i)
                held["v"].append(v)
        yield from flush()

    return pack


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            v = _unpack(row)[1].astype(float)
            sums[row["dim"]] = sums.get(row["dim"], 0) + v.T @ v
    for d, g in sums.items():
        at = np.indices((d, d), np.int32).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(at[0]), pa.array(at[1]), pa.array(g.ravel())], names=["dim", "i", "j", "s"])


def rotations(blocks: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """For each dimension the singular basis of all its rows and how many leading axes hold HEAD_ENERGY.

    A basis has the square of its dimension in cells, at the driver and in every task.
    """
    sums = blocks.where("dim > 0").mapInArrow(_gram, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toArrow()
    dim, i, j, s = (sums.column(k).to_numpy() for k in range(4))
    out = {}
    for d in np.unique(dim).tolist():
        g, own = np.zeros((d, d)), dim == d
        g[i[own], j[own]] = s[own]
        values, axes = np.linalg.eigh((g + g.T) / 2)
        values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        out[d] = np.ascontiguousarray(axes), int(min(d, 1 + np.searchsorted(share, HEAD_ENERGY)))
    return out


class _Best:
    """The k best (score, id) of each query so far; ties go to smaller ids."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.scores, self.ids = np.full((queries, k), NONE), np.full((queries, k), LAST)
        self.floor = np.full(queries, NONE) if floor is None else floor

    def least(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """For the queries named in which: a row of scores and of ids each."""
        s, i = np.concatenate([self.scores[which], scores], 1), np.concatenate([self.ids[which], ids], 1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.scores.shape[1]]  # ~s falls as s rises, without overflow
        self.scores[which], self.ids[which] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b; those beyond 64 bits stop at the ends of these."""
    norm = lambda x: float(np.sqrt((x.astype(float) ** 2).sum(1)).max(initial=0))
    if norm(a) * norm(b) < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, int(NONE) + 1, int(LAST)).astype(np.int64).reshape(len(a), len(b))


def search(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, best: _Best, basis: tuple[np.ndarray, int] | None) -> None:
    """Adds to best what the rows, longest first, have for the queries."""
    d = queries.shape[1]
    axes, head = basis or (np.eye(d), d)
    q, c = queries.astype(float), rows.astype(float)
    long_q, long_c = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    order = np.argsort(-long_c, kind="stable")
    rows, ids, c, long_c = rows[order], ids[order], c[order], long_c[order]
    q_turned, c_turned = q @ axes, c @ axes
    rest = lambda x: np.sqrt((x[:, head:] ** 2).sum(1))
    q_rest, c_rest = rest(q_turned), rest(c_turned)
    exact_floats = bool(len(rows) and len(queries)) and float(long_q.max()) * float(long_c.max()) < 2.0**52
    for at in range(0, len(rows), STRIP):
        strip = slice(at, at + STRIP)
        least = best.least().astype(float)
        slack = 1e-9 * long_q * long_c[at] + 1
        live = np.flatnonzero(long_q * long_c[at] + slack >= least)
        if not len(live):
            break  # the rows that follow are shorter still
        bound = q_turned[live, :head] @ c_turned[strip, :head].T + np.outer(q_rest[live], c_rest[strip]) + slack[live, None]
        may = bound >= least[live, None]
        live, may = live[may.any(1)], may[may.any(1)]
        some = np.flatnonzero(may.any(0))
        if not len(some):
            continue
        pick = at + some
        if exact_floats:
            scores = np.rint(q[live] @ c[pick].T).astype(np.int64)
        else:
            scores = products(queries[live], rows[pick])
        scores = np.where(may[:, some], scores, NONE)
        best.add(live, scores, np.where(may[:, some], ids[pick][None, :], LAST))


def _pairs(k: int, bases: dict, seed: bool):
    """For rows that hold a query block (q_...) and a row block: a threshold for each query, or its best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = _unpack({n: row[f"q_{n}"] for n in ("n", "dim", "ids", "vectors")})
                ids, rows = _unpack(row) if row["n"] else (np.empty(0, np.int64), np.empty((0, row["q_dim"]), np.int64))
                best = _Best(len(q), k, None if seed else np.frombuffer(row["q_least"], np.int64))
                search(q, rows, ids, best, bases.get(row["q_dim"]))
                if seed:
                    least = best.least()
                    out = {n: row[n] for n in _QUERY} | {"q_least": least.tobytes(), "q_min": float(least.min())}
                    yield pa.RecordBatch.from_pylist([out], schema=_QUERY_SCHEMA)
                    continue
                at = np.nonzero(best.ids != LAST)
                own = np.array([products(x[None, :], x[None, :])[0, 0] for x in q], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[0]), row["q_block"])), pa.array(at[0].astype(np.int32)), pa.array(q_ids[at[0]]), pa.array(own[at[0]]), pa.array(best.ids[at]), pa.array(best.scores[at])], names=["q_block", "place", "query_id", "own", "vec_id", "score"])

    return run


_QUERY_SCHEMA = pa.schema([("q_block", pa.int64()), ("q_dim", pa.int32()), ("q_n", pa.int32()), ("q_longest", pa.float64()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("q_least", pa.binary()), ("q_min", pa.float64())])
_QUERY = ("q_block", "q_dim", "q_n", "q_longest", "q_ids", "q_vectors")


def topk(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, its own row left out.

    queries and rows have id long, v array<long>; queries are some of the rows. Only
    vectors of one length meet. Ties go to smaller ids. A query row that is repeated
    returns its list as often; of the rows equal to a query (id and vector), one, its
    own, is left out. Empty tables give no rows.
    """
    spark = rows.sparkSession
    total = rows.count()
    dim, length = F.size("v"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    spread = rows.select("id", "v").repartitionByRange(max(1, math.ceil(total / BLOCK_ROWS)), dim, length.desc(), "id")
    blocks = checkpointed(spread.sortWithinPartitions(dim, length.desc(), "id").select("id", "v").mapInArrow(_blocks(BLOCK_ROWS), BLOCK))
    bases = rotations(blocks)

    groups = max(1, math.ceil(queries.count() / QUERY_ROWS))
    q_blocks = queries.select("id", "v").repartition(groups).sortWithinPartitions(dim, "id", "v").mapInArrow(_blocks(QUERY_ROWS), BLOCK)
    q_blocks = q_blocks.select(F.monotonically_increasing_id().alias("q_block"), *(F.col(n).alias(f"q_{n}") for n in ("dim", "n", "longest", "ids", "vectors")))
    seeds = blocks.groupBy("dim").agg(F.max_by(F.struct("n", "ids", "vectors"), F.struct("longest", "block")).alias("b")).select("dim", "b.*")
    if len(bases) <= 16:  # a block of each dimension: at most 16 * BLOCK_ROWS vectors
        seeds = F.broadcast(seeds)
    k1 = k + 1  # the own row is among them
    shape = "q_block long, q_dim int, q_n int, q_longest double, q_ids binary, q_vectors binary, q_least binary, q_min double"
    # checkpointed, so that the block numbers stay
    q_blocks = checkpointed(q_blocks.join(seeds, F.col("q_dim") == F.col("dim"), "left").mapInArrow(_pairs(k1, bases, True), shape))

    # shards are ranges of length, longest first: a query block goes to those that it may reach, and no further
    n = blocks.count()
    shards = max(1, min(n, 3 * spark.sparkContext.defaultParallelism), math.ceil(n / 32))
    ends = sorted(blocks.approxQuantile("longest", [1 - s / shards for s in range(1, shards)], 1 / (4 * shards)), reverse=True) if shards > 1 else []
    ends = F.array(*map(F.lit, ends)).cast("array<double>")
    may = lambda longest: F.col("q_longest") * longest * (1 + 1e-9) + 1 >= F.col("q_min")
    tiles = q_blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.size(F.filter(ends, may)))))
    place = F.size(F.filter(ends, lambda x: x >= F.col("longest")))
    # where many blocks have one length its end is there several times: they are dealt over as many shards
    alike = F.greatest(F.when(place > 0, F.size(F.filter(ends, lambda x: x == F.element_at(ends, place)))), F.lit(1))
    held = blocks.withColumn("shard", place - F.pmod(F.xxhash64("block", "dim"), alike).cast("int"))
    reach = F.col("q_longest") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("q_min")
    pairs = tiles.join(held, (tiles["shard"] == held["shard"]) & (F.col("q_dim") == F.col("dim")) & reach).drop("shard")
    found = pairs.mapInArrow(_pairs(k1, bases, False), "q_block long, place int, query_id long, own long, vec_id long, score long")

    # k + 1 at most from each pair meet here; the own row, if among the best, is the one to go
    order = "transform(array_sort(collect_list(struct(-1 - score as s, vec_id, score))), x -> struct(x.vec_id, x.score))"
    best = found.groupBy("q_block", "place", "query_id", "own").agg(F.expr(order).alias("best"))
    mine = "cast(array_position(best, struct(query_id as vec_id, own as score)) as int)"
    others = F.expr(f"if({mine} > 0, concat(slice(best, 1, {mine} - 1), slice(best, {mine} + 1, size(best))), best)")
    best = best.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "b"))
    return best.select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")
