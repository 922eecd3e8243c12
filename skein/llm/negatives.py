"""Hard negatives: rows of another label whose scores lie in a window under a positive's score.

A row is stored as the codes of a product quantiser (one of CENTRES centroids for each
piece of WIDTH components) and the norm of what each code leaves over. For an anchor a
table of inner products with all centroids gives any row's score by adding looked-up
entries, up to plus or minus the sum over the pieces of the anchor's norm times the
stored residual norm (Cauchy-Schwarz in each piece). The bounds decide which rows can be
in a result at all:

1. positives: an anchor's best rows of its own label, where rows whose upper bound is
   below the k-th best lower bound, or the k-th exact score so far, are out;
2. windows: for each positive the best rows of other labels between a share of its score
   and its score, where rows whose bounds miss the window are out, and likewise those
   below the k-th best lower bound of rows that lie in the window for certain.

What stays is scored again by exact integer products. Anchors and rows meet tile by tile:
a tile is a block of anchors and a shard of rows in one task, and returns at most k rows
for each list, whatever the scores are. The codebooks come from a bounded sample of rows
(SAMPLE); they have no say in the results, as the bounds hold for any codebook.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import Tables, checkpointed
from skein.llm.topk import products

#: Components in a piece, centroids of a piece, rows that the codebooks are fitted on, rounds of the fit.
WIDTH, CENTRES, SAMPLE, ROUNDS = 2, 256, 8192, 6
#: Anchors and rows in a tile; cells of one table of estimates.
ANCHORS, ROWS, CELLS = 4096, 16384, 1 << 20
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_BOOKS = "dim int, piece int, centres binary"
_CODED = "id long, label long, dim int, own long, v binary, codes binary, rest binary"


def _pieces(dim: int) -> list[slice]:
    return [slice(at, min(dim, at + WIDTH)) for at in range(0, dim, WIDTH)]


def _unpack(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


# -- codebooks --


def _fitted(centres: int, rounds: int):
    """The centroids of one piece, by Lloyd's rounds from spread starting rows."""

    def run(rows: pa.Table) -> pa.Table:
        x = np.array(rows.column("x").to_pylist(), float)
        x = x[np.lexsort(x.T)]
        c = x[np.linspace(0, len(x) - 1, min(centres, len(x))).astype(int)]
        for _ in range(rounds):
            near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            n = np.bincount(near, minlength=len(c))
            sums = np.stack([np.bincount(near, x[:, i], len(c)) for i in range(x.shape[1])], 1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        c = np.concatenate([c, np.repeat(c[:1], centres - len(c), 0)])
        return pa.table({"dim": pa.array([rows.column("dim")[0].as_py()], pa.int32()), "piece": pa.array([rows.column("piece")[0].as_py()], pa.int32()), "centres": pa.array([c.tobytes()], pa.binary())})

    return run


def codebooks(rows: DataFrame, sample: int = SAMPLE, centres: int = CENTRES, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """For each dimension in the sample (the rows with the least hashes) the centroids of its pieces.

    Each piece is fitted in a task of its own. What reaches the driver, and every task
    after it, has CENTRES times the dimension cells. A dimension that no row of the
    sample has gets a single centroid at the origin when rows are coded.
    """
    some = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).where(F.size("v") > 0)
    piece = F.transform(F.sequence(F.lit(0), F.ceil(F.size("v") / WIDTH).cast("int") - 1), lambda i: F.struct(i.alias("piece"), F.slice("v", i * WIDTH + 1, F.lit(WIDTH)).cast("array<double>").alias("x")))
    cut = some.select(F.size("v").alias("dim"), F.inline(piece))
    books: dict[int, dict[int, np.ndarray]] = {}
    for r in cut.groupBy("dim", "piece").applyInArrow(_fitted(centres, rounds), _BOOKS).collect():
        p = _pieces(r.dim)[r.piece]
        books.setdefault(r.dim, {})[r.piece] = np.frombuffer(bytes(r.centres), float).reshape(centres, p.stop - p.start)
    return {d: [b[i] for i in range(len(b))] for d, b in books.items()}


def book_of(books: dict[int, list[np.ndarray]], dim: int) -> list[np.ndarray]:
    return books.get(dim) or [np.zeros((1, p.stop - p.start)) for p in _pieces(dim)]


def encode(x: np.ndarray, book: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a byte a piece) and residual norms (rounded up) of each piece of each row."""
    codes, rest = np.empty((len(x), len(book)), np.uint8), np.empty((len(x), len(book)), np.float32)
    for j, (p, c) in enumerate(zip(_pieces(x.shape[1]), book, strict=True)):
        own = x[:, p].astype(float)
        codes[:, j] = ((c * c).sum(1) - 2 * own @ c.T).argmin(1)
        norms = np.sqrt(((own - c[codes[:, j]]) ** 2).sum(1)) * (1 + 1e-12)
        rest[:, j] = np.nextafter(norms.astype(np.float32), np.float32(np.inf))
    return codes, rest


def _encoded(books: dict[int, list[np.ndarray]]):
    def run(batches):
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            dims = np.array([len(v) for v in vectors])
            cells: list = [None] * len(vectors)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.array([vectors[i] for i in at], np.int64).reshape(len(at), d)
                codes, rest = encode(x, book_of(books, d))
                for i, v, c, r in zip(at.tolist(), x, codes, rest, strict=True):
                    cells[i] = (int(products(v[None, :], v[None, :])[0, 0]), v.tobytes(), c.tobytes(), r.tobytes())
            own, *made = zip(*cells, strict=True) if cells else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(own, pa.int64()), *(pa.array(c, pa.binary()) for c in made)], names=["id", "label", "dim", "own", "v", "codes", "rest"])

    return run


# -- bounds --


class Rows:
    """A shard of coded rows of one dimension, best to be asked with some anchors at a time."""

    def __init__(self, table: pa.Table, dim: int, book: list[np.ndarray]):
        self.book, self.dim = book, dim
        self.ids, self.labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        self.v = _unpack(table.column("v"), np.int64, dim) if dim else np.zeros((table.num_rows, 0), np.int64)
        self.codes = _unpack(table.column("codes"), np.uint8, len(book)) if dim else np.zeros((table.num_rows, 0), np.uint8)
        self.rest = _unpack(table.column("rest"), np.float32, len(book)).astype(float) if dim else np.zeros((table.num_rows, 0))
        self.norms = np.sqrt((self.v.astype(float) ** 2).sum(1))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of all rows for all queries."""
        q = q.astype(float)
        estimate, norms = np.zeros((len(q), len(self.ids))), np.empty((len(q), len(self.book)))
        for j, (p, c) in enumerate(zip(_pieces(self.dim), self.book, strict=True)):
            estimate += np.take(q[:, p] @ c.T, self.codes[:, j], axis=1)
            norms[:, j] = np.sqrt((q[:, p] ** 2).sum(1))
        # the last term covers the rounding of doubles
        off = norms @ self.rest.T + np.outer(np.sqrt((q * q).sum(1)), 1e-9 * self.norms) + 1e-3
        return estimate - off, estimate + off

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact scores of one query."""
        return products(q[None, :], self.v[at])[0]


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -math.inf


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id)."""
    if len(scores) > 8 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], ~scores[some]))[:k]]
    return np.lexsort((ids, ~scores))[:k]


def window_of(score: int, percent: int) -> int:
    """The least score s with percent * score <= 100 * s."""
    return -((-percent * score) // 100)


def _tile(books: dict[int, list[np.ndarray]], cells: int):
    """Splits a tile's anchors so that a table of estimates stays below so many cells."""

    def parts(anchors: pa.Table, rows: pa.Table):
        if anchors.num_rows and rows.num_rows:
            dim = rows.column("dim")[0].as_py()
            held = Rows(rows, dim, book_of(books, dim))
            q = _unpack(anchors.column("v"), np.int64, dim) if dim else np.zeros((anchors.num_rows, 0), np.int64)
            step = max(1, cells // len(held.ids))
            for at in range(0, len(q), step):
                lower, upper = held.bounds(q[at : at + step])
                for i in range(len(lower)):
                    yield held, at + i, q[at + i], lower[i], upper[i]

    return parts


_FOUND = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _table(found: list[tuple]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _positives(k: int, books: dict, cells: int):
    """Of a tile: the k best rows of each anchor's own label."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        numbers, labels, found = anchors.column("anchor").to_numpy(), anchors.column("label").to_numpy(), []
        for held, i, q, lower, upper in _tile(books, cells)(anchors, rows):
            own = np.flatnonzero(held.labels == labels[i])
            own = own[upper[own] >= kth(lower[own], k)]
            scores = held.scores(q, own)
            took = best(scores, held.ids[own], k)
            found.append((np.full(len(took), numbers[i]), np.zeros(len(took), np.int32), held.ids[own[took]], scores[took]))
        return _table(found)

    return run


def _windows(k: int, percent: int, books: dict, cells: int):
    """Of a tile: for each of an anchor's positives (scores) the k best rows of other labels in its window; place is the positive's."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        numbers, labels, found = anchors.column("anchor").to_numpy(), anchors.column("label").to_numpy(), []
        positives = anchors.column("scores").to_pylist()
        for held, i, q, lower, upper in _tile(books, cells)(anchors, rows):
            others = np.flatnonzero(held.labels != labels[i])
            low, high = lower[others], upper[others]
            for place, top in enumerate(positives[i]):
                floor = window_of(top, percent)
                may = (high >= floor) & (low <= top)
                sure = (low >= floor) & (high <= top)
                may &= high >= kth(low[sure], k)
                at = others[may]
                scores = held.scores(q, at)
                inside = (scores >= floor) & (scores <= top)
                at, scores = at[inside], scores[inside]
                took = best(scores, held.ids[at], k)
                found.append((np.full(len(took), numbers[i]), np.full(len(took), place, np.int32), held.ids[at[took]], scores[took]))
        return _table(found)

    return run


# -- the operator --


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each list; tasks drop what is behind k of their own before the rows are moved."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: int = 80, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, checkpointed.

    rows: id long, label long, v array<long> (see topk.integer_vectors); anchors: a
    condition on them. A score is the integer inner product, at the ends of 64 bits beyond
    these; higher ones come first, ties by smaller id. An anchor's positives are its first
    rows of its own label, itself left out; negatives of a pair are the first rows of
    another label with percent * positive_score <= 100 * score <= 100 * positive_score, so
    a negative positive_score has none where percent < 100. Rows with a null id, label or
    vector take no part; only vectors of one length meet. Of rows equal to an anchor in id
    and score one counts as itself, so an anchor row that is repeated has its copies among
    its positives, and returns its lists as often. An empty table gives no rows.
    """
    tables = Tables(rows.sparkSession)
    try:
        return _hard_negatives(rows, anchors, positives, negatives, percent, sample, tables)
    finally:
        tables.drop()


def _hard_negatives(rows: DataFrame, anchors: Column, positives: int, negatives: int, percent: int, sample: int, tables: Tables) -> DataFrame:
    rows = rows.where("id is not null and label is not null and v is not null").select("id", F.col("label").cast("long").alias("label"), "v")
    books = codebooks(rows, sample)
    # a row's number isn't its id, which may be that of many rows: shards and blocks are even whatever the ids are
    coded = tables.write(rows.mapInArrow(_encoded(books), _CODED).withColumn("number", F.monotonically_increasing_id()))
    total = coded.count()
    asking = coded.where(anchors)
    blocks = max(1, math.ceil(asking.count() / ANCHORS))
    parallel = 2 * rows.sparkSession.sparkContext.defaultParallelism
    shards = max(math.ceil(total / ROWS), min(parallel, math.ceil(total / 2048)), 1)
    spread = coded.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asking = asking.select(F.col("number").alias("anchor"), "id", "label", "dim", "own", "v").withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    tile = ("dim", "block", "shard")

    def met(left: DataFrame, work) -> DataFrame:
        return left.withColumn("shard", everywhere).groupBy(*tile).cogroup(spread.groupBy(*tile)).applyInArrow(work, "anchor long, place int, id long, score long")

    # one more than asked for, as the anchor itself may be among them
    near = _ranked(met(asking, _positives(positives + 1, books, CELLS)), positives + 1)
    lists = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), "score"))).alias("best"))
    mine = "cast(array_position(transform(best, x -> struct(x.positive_id, x.score)), struct(id as positive_id, own as score)) as int)"
    others = F.expr(f"if({mine} > 0, concat(slice(best, 1, {mine} - 1), slice(best, {mine} + 1, size(best))), best)")
    listed = asking.join(lists, "anchor").withColumn("best", F.slice(others, 1, positives))
    listed = tables.write(listed.where(F.size("best") > 0))

    pairs = met(listed.select("anchor", "label", "dim", "v", "block", F.col("best.score").alias("scores")), _windows(negatives, percent, books, CELLS))
    found = _ranked(pairs, negatives).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    pair = listed.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("best").alias("place", "p")).select("anchor", "place", "anchor_id", "p.positive_id", F.col("p.score").alias("positive_score"))
    out = found.join(pair, ["anchor", "place"])
    return checkpointed(out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"))

