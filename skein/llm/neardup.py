"""Near duplicates by an LSH forest over MinHash signatures, with links confirmed on whole sets.

1. A text becomes the set of its word shingles. Texts with equal sets are one class.
2. The forest has TREES orders of the signature. A class stands in each of them; those
   that share the first DEPTH values of an order with another make a region. Most
   classes are alone and go no further.
3. Regions are sorted by the order's next DEEPER values. A first round takes of each class
   its best candidate on either side among the WINDOW classes around it in each order and,
   in regions beyond that, the centre of its stretch, so that variants of one text, which
   may be near that text only, find it. It confirms the FIRST whose signatures agree best,
   and merges what is linked. It only makes what follows smaller.
4. Then every pair of a shared region that isn't in one component yet is compared. In
   regions of up to WINDOW + 1 classes all pairs whose signatures agree are confirmed. What
   larger regions join, over all orders, is a crowd: its classes are dealt to blocks of
   bounded size, and blocks are compared whole, set against set, without signatures. Blocks
   meet only where sizes allow a link and where more than one component is in them, so a
   crowd of copies costs a row for each class; look-alikes that are linked with nothing
   cost a comparison for each pair, BLOCK rows at a time, but no row.

Components come from links confirmed on the whole sets only. A linked pair is left
unconfirmed if it shares no region (at a similarity of 0.8 three times in a million) or
if all regions that it shares are small and its signatures agree in less than threshold -
SLACK of their values (over five standard deviations off); then it matters only if no
chain of other links joins its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import Tables, checkpointed
from skein.llm.graph import components

#: Orders of the forest; values that a region shares; values that sort it further; neighbours compared on either side.
TREES, DEPTH, DEEPER, WINDOW = 32, 5, 24, 64
HASHES = TREES * DEPTH
#: How far below the threshold signatures may agree before a pair is left out (over five standard deviations).
SLACK = 0.18
#: Candidates of each class that are confirmed before all others.
FIRST = 3
#: Classes and shingles of a block, about; cells that a task counts at once.
BLOCK, BLOCK_SHINGLES, CELLS = 1024, 1 << 20, 1 << 22
_RANDOM = np.random.default_rng(77)
_XOR = _RANDOM.integers(0, 1 << 32, (HASHES, 1), np.uint32, endpoint=False)
_TIMES = _RANDOM.integers(0, 1 << 32, (HASHES, 1), np.uint32, endpoint=False) | np.uint32(1)
_FOLD = _RANDOM.integers(0, 1 << 63, DEPTH, np.uint64) | np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, words between ASCII white space; fewer words than size: all as one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = _mixed(out * _A + h[i : i + n] * _B + np.uint64(i))
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, ((low[None, at : at + 2048] ^ _XOR) * _TIMES).min(1), out=least)
    least *= np.uint32(0x9E3779B1)
    return ((least ^ (least >> np.uint32(15))) & np.uint32(0xFFFF)).astype(np.uint16)


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                keys.append(divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64))
                signatures.append(signature(s).tobytes() if len(s) else None)
            k1, k2 = zip(*keys, strict=True) if keys else ((), ())
            made = [pa.array(n, pa.int64()), _signed(k1), _signed(k2), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]], names=["doc_id", "n", "k1", "k2", "sig", *batch.schema.names[2:]])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, node) of every class in every tree."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            levels = _matrix(part.column(1)).reshape(-1, TREES, DEPTH).astype(np.uint64)
            region = _mixed((levels * _FOLD).sum(2, dtype=np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64) * _A)
            node = np.repeat(part.column(0).to_numpy(), TREES)
            tree = np.tile(np.arange(TREES, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([_signed(region.ravel()), pa.array(node), pa.array(tree)], names=["region", "node", "tree"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a signature, what a region needs: the deeper values of its tree, and a byte of each value."""
    for batch in batches:
        cell = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
        small = (_matrix(cell["sig"]) & np.uint16(255)).astype(np.uint8)
        places = ((cell["tree"].to_numpy() + 1)[:, None] * DEPTH + np.arange(DEEPER)) % HASHES
        deep = np.take_along_axis(small, places, 1)
        made = [pa.array([x.tobytes() for x in deep], pa.binary()), pa.array([x.tobytes() for x in small], pa.binary())]
        yield pa.RecordBatch.from_arrays([cell["region"], cell["node"], cell["n"], cell["crowded"], *made], names=["region", "node", "n", "crowded", "deep", "sig"])


def _near(least: float, same: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Which row pairs are near enough, by the number of agreeing values and in size."""
    return (same >= least * HASHES) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)


def _best(x: np.ndarray, y: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Of candidates y of x, which to take first: for each x the best on either side of it."""
    side = y > x
    order = np.lexsort((-agree, side, x))
    again = np.zeros(len(x), bool)
    again[1:] = (np.diff(x[order]) == 0) & (np.diff(side[order].astype(int)) == 0)
    return order[~again]


def _candidates(threshold: float, whole: bool):
    """Sorted rows (region, node, root, crowd, n, deep, sig): a, b, agree of near rows of one region, of different roots and not of one crowd.

    Compared are rows at most WINDOW apart, and in regions beyond that each row with the
    centre of its stretch, the row that agrees best with the most frequent values, and
    with the centre of the stretch before. agree is the number of agreeing values, then
    the length of the common prefix. whole: all pairs, else of a row's candidates on
    either side (a is the row) the best.
    """
    least = threshold - SLACK

    def pairs(region, node, root, crowd, n, deep, sig, start: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the earlier and the later row, and agree. The order begins at start, after the centre carried over; pairs before new are known."""
        rows = len(region)
        prefix = np.zeros(rows, np.int64)  # with the row before
        if rows > 1:
            prefix[1:] = np.concatenate([(region[1:] == region[:-1])[:, None], deep[1:] == deep[:-1], np.zeros((rows - 1, 1), bool)], 1).argmin(1)
        shared, out = np.full(rows, DEEPER + 1), []

        def add(earlier: np.ndarray, later: np.ndarray, common: np.ndarray) -> None:
            use = (root[earlier] != root[later]) & ((crowd[earlier] != crowd[later]) | (crowd[earlier] < 0))
            earlier, later, common = earlier[use], later[use], common[use]
            same = (sig[earlier] == sig[later]).sum(-1)
            near = _near(least, same, n[earlier], n[later], threshold)
            out.append((earlier[near], later[near], (same * 32 + common)[near]))

        for j in range(1, min(WINDOW, rows - start - 1) + 1):
            shared[j:] = np.minimum(shared[j:], prefix[1 : rows - j + 1])
            later = np.arange(max(new, start + j), rows)
            later = later[shared[later] > 0]
            if not len(later):
                break
            add(later - j, later, shared[later])
        bounds = np.flatnonzero(np.concatenate([[True], region[start + 1 :] != region[start:-1], [True]])) + start
        centre = None
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            known = start and region[0] == region[lo]
            if hi - lo <= WINDOW + 1 and not known:
                continue
            counts = np.bincount((sig[lo:hi] + 256 * np.arange(HASHES)).ravel(), minlength=256 * HASHES).reshape(HASHES, 256)
            centre = lo + int((sig[lo:hi] == counts.argmax(1)).sum(1).argmax())
            fresh = np.arange(max(lo, new), hi)
            for at in (centre, 0) if known else (centre,):
                one, other = np.full(len(fresh), at), fresh
                far = abs(one - other) > (0 if at < start else WINDOW)
                one, other = one[far], other[far]
                add(np.minimum(one, other), np.maximum(one, other), np.zeros(len(one), int))
        held = centre if centre is not None and region[centre] == region[-1] else 0 if start and region[0] == region[-1] else None
        found = tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
        return *found, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = tail = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cells = [part.column(i).to_numpy() for i in range(5)]
                cells += [np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(part.num_rows, -1) for i in (5, 6)]
                before = [x for x in (centre, tail) if x is not None]
                start, new = (0 if centre is None else 1), sum(len(x[0]) for x in before)
                cells = [np.concatenate(x) for x in zip(*before, cells, strict=True)]
                i, j, agree, held = pairs(*cells, start, new)
                if len(i):
                    x, y = i, j
                    if not whole:
                        x, y, agree = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(agree, 2)
                    took = slice(None) if whole else _best(x, y, agree)
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (cells[1][x[took]], cells[1][y[took]], agree[took])], names=["a", "b", "agree"])
                centre = None if held is None else [x[held : held + 1] for x in cells]
                tail = [x[start:][-WINDOW:] for x in cells]

    return run


def _confirm(threshold: float):
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked)], names=["a", "b", "linked"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_confirm(threshold), "a long, b long, linked boolean").where("linked").select("a", "b")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, shingle).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return run


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of a shares with each of b."""
    rows, columns = len(a), len(b)
    at = np.repeat(np.arange(rows + columns), [len(x) for x in (*a, *b)])
    values, shingle = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    at, shingle = at[order], shingle[order]
    (xa, xs), (ya, ys) = ((at[use], shingle[use]) for use in (at < rows, at >= rows))
    ya = ya - rows
    in_a, in_b = (np.bincount(s, minlength=len(values)) for s in (xs, ys))
    out = np.zeros((rows, columns), np.int64)
    # what many have by products of matrices
    frequent = in_a * in_b * 64 > rows * columns
    listed = np.flatnonzero(frequent)
    place, width = np.cumsum(frequent) - 1, max(1, CELLS // (rows + columns))
    for lo in range(0, len(listed), width):
        hi, sides = min(lo + width, len(listed)), []
        for s, r, n in ((xs, xa, rows), (ys, ya, columns)):
            use = frequent[s] & (place[s] >= lo) & (place[s] < hi)
            m = np.zeros((n, hi - lo), np.float32)
            m[r[use], place[s[use]] - lo] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    # the rest pair by pair
    rare = ~frequent[xs] & (in_b[xs] > 0)
    xa, xs = xa[rare], xs[rare]
    times, first = in_b[xs], np.cumsum(in_b) - in_b
    done = np.concatenate([[0], np.cumsum(times)])
    lo = 0
    while lo < len(xs):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + CELLS, "right")) - 1)
        k = np.repeat(np.arange(lo, hi), times[lo:hi])
        y = ya[first[xs[k]] + np.arange(len(k)) - (done[k] - done[lo])]
        out += np.bincount(xa[k] * columns + y, minlength=rows * columns).reshape(rows, columns)
        lo = hi
    return out


def _compared(threshold: float):
    """Two blocks (late: the second one; one with itself if none is), rows root and set: a, b, roots that links between the blocks join, as few as join them."""
    percent = round(threshold * 100)

    def run(table: pa.Table) -> pa.Table:
        late, root = table["late"].to_numpy(zero_copy_only=False), table["root"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        i = np.flatnonzero(~late)
        j = np.flatnonzero(late) if late.any() else i
        both = _shared([sets[k] for k in i], [sets[k] for k in j])
        size = np.array([len(s) for s in sets])
        linked = (100 * both >= percent * (size[i][:, None] + size[j] - both)) & (root[i][:, None] != root[j])
        x, y = np.nonzero(linked)
        names, ends = np.unique(np.concatenate([root[i[x]], root[j[y]]]), return_inverse=True)
        x, y = ends[: len(x)], ends[len(x) :]
        low, before = np.arange(len(names)), None
        while before is None or (low != before).any():
            before, least = low.copy(), np.minimum(low[x], low[y])
            np.minimum.at(low, x, least)
            np.minimum.at(low, y, least)
            low = low[low]
        more = low != np.arange(len(names))
        return pa.table({"a": pa.array(names[more], pa.int64()), "b": pa.array(names[low[more]], pa.int64())})

    return run


def _crowd_links(crowds: DataFrame, sets: DataFrame, threshold: float, tables: Tables) -> DataFrame:
    """a, b: links between roots of one crowd. crowds: node, root, crowd, n.

    A component of a block's size or more has blocks of its own, so that those aren't
    compared with each other; the others share their crowd's. Blocks go by size, and
    only those of one level or of neighbouring ones can hold linked sets.
    """
    level = F.floor(F.log("n") / float(np.log(1.001 / threshold)))
    full = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES))
    roots = crowds.groupBy("root").agg(full(F.count("*"), F.sum("n")).alias("__of")).where("__of > 1").select("root", F.col("root").alias("owner"))
    rows = crowds.join(roots, "root", "left").withColumn("owner", F.coalesce("owner", F.lit(-1))).withColumn("level", level)
    key = ("crowd", "owner", "level")
    parts = rows.groupBy(*key).agg(full(F.count("*"), F.sum("n")).alias("parts"))
    rows = tables.write(rows.join(parts, [*key]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))))
    blocks = tables.write(rows.select(*key, "part").distinct().withColumn("block", F.monotonically_increasing_id()))
    # blocks of one component, alone in a level or not, have nothing to find among themselves
    alone = rows.groupBy(*key, "part").agg(F.min("root").alias("a"), F.max("root").alias("z"))
    blocks = tables.write(blocks.join(alone, [*key, "part"]).withColumn("only", F.when(F.col("a") == F.col("z"), F.col("a"))))
    other = blocks.select("crowd", F.col("level").alias("level2"), F.col("block").alias("second"), F.col("only").alias("only2"))
    met = blocks.join(other, "crowd").where("block <= second and abs(level - level2) <= 1 and not coalesce(only = only2, false)")
    met = tables.write(met.select(F.col("block").alias("first"), "second").withColumn("pair", F.monotonically_increasing_id()))
    sides = met.select("pair", F.col("first").alias("block"), F.lit(False).alias("late")).unionByName(met.where("first != second").select("pair", F.col("second").alias("block"), F.lit(True).alias("late")))
    dealt = rows.join(blocks.select(*key, "part", "block"), [*key, "part"]).join(sides, "block").select("pair", "late", "node", "root")
    dealt = dealt.join(sets, "node").select("pair", "late", "root", "set")
    return tables.write(dealt.groupBy("pair").applyInArrow(_compared(threshold), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    With carried, these columns of docs too, and group: a number for each component,
    null for a text without words.

    Texts whose sets' Jaccard similarity is threshold or more are linked;
    component_id is the smallest id reachable over links. A text without words is
    linked with nothing. Rows with equal ids and texts stand or fall together. A null
    id takes part, but is never the smallest: its component's id may be null, and kept
    is true only if that is so. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession)
    try:
        return _near_duplicates(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, shingle, threshold, carried, tables)
    finally:
        tables.drop()


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, carried: tuple[str, ...], tables: Tables) -> DataFrame:
    # a row is told by its id (the least long for null) and a hash of its text
    told = (F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("did"), F.xxhash64(text_col).alias("th"))
    described = docs.select(*told, *carried)
    more = [f"`{f.name}` {f.dataType.simpleString()}" for f in described.schema[2:]]
    table = tables.write(described.mapInArrow(_describe(shingle), ", ".join(["doc_id long, n long, k1 long, k2 long, sig binary", *more])))
    classes = table.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.min(F.struct("did", "th")).alias("one"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # written, so that the numbers stay
    classes = tables.write(classes.withColumn("node", F.monotonically_increasing_id()))

    def forest(rows: DataFrame) -> DataFrame:
        """The regions of classes (node, n, sig) that they share with others."""
        trees = rows.select("node", "sig").mapInArrow(_trees, "region long, node long, tree int")
        shared = trees.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
        placed = trees.join(shared, "region").join(rows.select("node", "n", "sig"), "node").withColumn("crowded", F.col("size") > WINDOW + 1)
        return tables.write(placed.mapInArrow(_placed, "region long, node long, n long, crowded boolean, deep binary, sig binary"))

    placed = forest(classes)

    order = ("region", "deep", "node")

    def candidates(dealt: DataFrame, whole: bool = False) -> DataFrame:
        rows = dealt.sortWithinPartitions(*order).select("region", "node", "root", "crowd", "n", "deep", "sig")
        return rows.mapInArrow(_candidates(threshold, whole), "a long, b long, agree long")

    # a region that the window covers stays whole, a crowded one is spread
    own = placed.withColumn("root", F.col("node")).withColumn("crowd", F.lit(-1).cast("long"))
    near = candidates(own.where("not crowded").repartition("region")).unionByName(candidates(own.where("crowded").repartitionByRange(*order)))
    found = tables.write(near.repartition("a").groupBy("a", "b").agg(F.max("agree").alias("agree")))

    # the sets of all classes that have a candidate, from the text of one row of each
    crowd = tables.write(placed.where("crowded").select("node").distinct())
    wanted = found.select(F.col("a").alias("node")).unionByName(crowd).distinct().join(classes.select("node", "one.did", "one.th"), "node")
    there = docs.select(*told[1:]).join(wanted, ["did", "th"]).dropDuplicates(["did", "th", "node"]).select("node", "text")
    sets = tables.write(there.mapInArrow(_sets(shingle), "node long, set binary"))

    best = Window.partitionBy("a").orderBy(F.desc("agree"), "b")
    first = found.withColumn("i", F.row_number().over(best)).where(F.col("i") <= FIRST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = tables.write(components(_linked(first, sets, threshold), tables))

    def merged(roots: DataFrame, crossing: DataFrame) -> DataFrame:
        """roots with what the links between components make one."""
        if crossing.isEmpty():
            return roots
        for end in ("a", "b"):
            crossing = crossing.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
        more = tables.write(components(crossing.select(F.col("ra").alias("a"), F.col("rb").alias("b")), tables))
        renamed = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        # roots of one class only are in more, not in roots
        return tables.write(renamed.unionByName(more.join(roots.select("node"), "node", "left_anti")))

    # what regions over the window join
    rooted = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    full = tables.write(rooted.where("crowded").select("region", "node", "n", "root"))
    mixed = full.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("region", "low")
    joined = full.select("region", "root").distinct().join(mixed, "region").select(F.col("root").alias("a"), F.col("low").alias("b")).distinct()
    crowds = components(joined, tables).select(F.col("node").alias("root"), F.col("root").alias("crowd"))
    crowds = tables.write(full.select("node", "n", "root").distinct().join(crowds, "root"))
    links = None if crowds.isEmpty() else _crowd_links(crowds, sets, threshold, tables)

    # what the window covers, but for pairs of one crowd, which are compared
    small = rooted.where("not crowded").join(crowds.select("node", "crowd"), "node", "left").withColumn("crowd", F.coalesce("crowd", F.lit(-1)))
    pairs = candidates(small.repartition("region"), whole=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    rest = _linked(pairs, sets, threshold)
    roots = merged(roots, tables.write(rest if links is None else rest.unionByName(links)))
    tables.drop(placed)

    lowest = roots.join(classes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component"))
    lows = classes.select("node", "k1", "k2", "low").join(roots.join(lowest, "root"), "node", "left")
    lows = lows.select("k1", "k2", F.when(F.col("root").isNotNull(), F.col("component")).otherwise(F.col("low")).alias("low"), F.coalesce("root", "node").alias("group"))
    beside = (*carried, "group") if carried else ()
    out = table.select("doc_id", "n", "k1", "k2", *carried).join(lows, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *beside)
    return checkpointed(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
