"""Nearest neighbours over shifted Hilbert orderings; an exact check by block bounds can follow."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonewright.functions.storage import materialize
from zonewright.llm.common import running_offsets, sorted_parts

CURVES = 4
#: Projected dimensions and bits of each; a key has DIMS * BITS bits.
DIMS, BITS = 8, 7
BLOCK_ROWS = 1024
#: A window serves the queries of at most so many blocks at once.
MOST_STEPS = 16
#: Summaries that meet in one task of the exact check.
BALLS_A_LOT = 4096
#: The windows are as wide as it takes to find this share of the neighbours of a sample of queries.
SAMPLE_QUERIES, RECALL = 64, 0.95

FOUND = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (n, d) with whole coordinates of so many bits (after Skilling, 2004)."""
    n, d = cells.shape
    x = [cells[:, i].astype(np.int64) for i in range(d)]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(n, dtype=np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = np.where(x[d - 1] & q, turn ^ (q - 1), turn)
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | ((x[i] ^ turn) >> b & 1)
    return key


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(n, d) doubles of a column of equally long lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def projections(dim: int, curves: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each curve, orthonormal directions (dim, dims) and a shift of its grid in [0, 1) of the range."""
    rng = np.random.Generator(np.random.PCG64(seed))
    dims = min(DIMS, dim)
    turned = [np.linalg.qr(rng.standard_normal((dim, dims)))[0] for _ in range(curves)]
    return np.stack(turned), rng.random((curves, dims))


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector) of the rows that can take part."""
    v = F.col("vector")
    bare = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return bare.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False)))


def _ranges(turned: np.ndarray):
    def run(batches):
        low = high = None
        for b in batches:
            if len(b):
                at = np.einsum("nd,cdk->nck", matrix(b.column(0)), turned)
                low = at.min(axis=0) if low is None else np.minimum(low, at.min(axis=0))
                high = at.max(axis=0) if high is None else np.maximum(high, at.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(low.size), pa.int32()), pa.array(low.ravel()), pa.array(high.ravel())], names=["i", "low", "high"])

    return run


def _keys(turned: np.ndarray, shifts: np.ndarray, low: np.ndarray, span: np.ndarray):
    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(1))
            for c in range(len(turned)):
                unit = ((x @ turned[c] - low[c]) / span[c] + shifts[c]) / 2  # the range fills half the grid, wherever it is shifted to
                cells = np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), c, dtype=np.int32)), pa.array(hilbert_keys(cells, BITS)), b.column(0), b.column(1)], names=["curve", "key", "rep", "vector"])

    return run


def _nearest(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """For each query (query, vector, reach) its k nearest rows (rep, vector), none beyond its reach."""
    if not len(queries) or not len(rows):
        return FOUND.empty_table()
    q, x, reps, reach = matrix(queries["vector"]), matrix(rows["vector"]), rows["rep"].to_numpy(), queries["reach"].to_numpy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ids, of_x = queries["query"].to_numpy(), (x * x).sum(axis=1)
    for at in range(0, len(q), 256):
        some = q[at : at + 256]
        rough = (some * some).sum(axis=1)[:, None] + of_x[None] - 2 * some @ x.T
        loose = 1e-9 * ((some * some).sum(axis=1) + of_x.max())  # above what the product form can be off
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(some), np.inf)
        limit = np.minimum(kth, reach[at : at + 256] ** 2) + loose
        i, j = np.nonzero(rough <= limit[:, None])
        exact = np.sqrt(np.add.accumulate((some[i] - x[j]) ** 2, axis=1)[:, -1])  # summed in order, as SQL does
        order = np.lexsort((reps[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = (rank < k) & (exact <= reach[at : at + 256][i])
        out.append((ids[at : at + 256][i[keep]], reps[j[keep]], exact[keep]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, once each."""
    once = found.groupBy("query", "rep").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def _summaries(name: str):
    def ball(part: pa.Table) -> pa.Table:
        """Centre and radius of the vectors, and the longest reach among them."""
        x = matrix(part["vector"])
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-9)
        reach = float(part["reach"].to_numpy().max())
        return pa.table([part[name][:1].combine_chunks(), pa.array([centre]), pa.array([radius]), pa.array([reach])], names=[name, "centre", "radius", "reach"])

    return ball


def _reached(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
    """(block, chunk) wherever the block's ball may hold a row within the reach of one of the chunk's queries."""
    names = ["block", "chunk"]
    if not len(blocks) or not len(chunks):
        return pa.table([pa.array([], pa.int64())] * 2, names=names)
    c, r, ids = matrix(blocks["centre"]), blocks["radius"].to_numpy(), blocks["block"].to_numpy()
    q, wide, own = matrix(chunks["centre"]), chunks["radius"].to_numpy() + chunks["reach"].to_numpy(), chunks["chunk"].to_numpy()
    out = []
    for at in range(0, len(q), 64):
        apart = np.sqrt(((q[at : at + 64, None] - c[None]) ** 2).sum(axis=2))
        i, j = np.nonzero(apart - r[None] <= wide[at : at + 64, None] * (1 + 1e-9))
        out.append((ids[j], own[at : at + 64][i]))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)


def _searched(pairs: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """What the queries (chunk, query, vector, reach) find among the rows (block, rep, vector) of the blocks they are paired with.

    Of pairs (block, chunk) each ships a block's rows and a chunk's queries once; blocks that no chunk reaches stay.
    """
    key = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("block", "chunk")]
    left = pairs.join(queries, "chunk").select(*key("asked"), "query", "vector", "reach").groupBy("asked_block", "asked_chunk")
    right = pairs.join(rows, "block").select(*key("held"), "rep", "vector").groupBy("held_block", "held_chunk")
    return left.cogroup(right).applyInArrow(lambda q, x: _nearest(q, x, k), "query long, rep long, score double")


def _sampled_neighbours(sample: pa.Table, k: int):
    def run(batches):
        for b in batches:
            for out in _nearest(sample, pa.Table.from_batches([b]), k).to_batches():
                yield out

    return run


def window_width(index: DataFrame, asked: DataFrame, distinct: DataFrame, k: int) -> tuple[int, float]:
    """(blocks on either side, share found): how wide windows must be for RECALL of a sample's neighbours, by brute force.

    The sample is of at most SAMPLE_QUERIES queries, and meets all rows in one pass without a shuffle. A neighbour is
    found where it stands within that many blocks of its query on any of the curves.
    """
    sample = asked.select("query", "vector").distinct().orderBy(F.xxhash64("query"), "query").limit(SAMPLE_QUERIES).toArrow()
    sample = sample.append_column("reach", pa.array(np.full(len(sample), np.inf)))
    truth = _best(distinct.select("rep", "vector").mapInArrow(_sampled_neighbours(sample, k), "query long, rep long, score double"), k).filter("query <> rep")
    at = index.select("curve", "rep", "block")
    theirs = truth.select("query", "rep").join(at, "rep").withColumnRenamed("block", "there")
    here = at.select("curve", F.col("rep").alias("query"), F.col("block").alias("here")).join(truth.select("query").distinct(), "query")
    apart = theirs.join(here, ["query", "curve"]).groupBy("query", "rep").agg(F.min(F.abs(F.col("there") - F.col("here"))).alias("apart"))
    far = np.sort([r["apart"] for r in apart.collect()])  # k rows for each sampled query
    if not len(far):
        return 1, 1.0
    width = max(1, int(far[min(len(far) - 1, math.ceil(RECALL * len(far)) - 1)]))
    return width, float((far <= width).mean())


def nearest_neighbours(vectors: DataFrame, queries_where, k: int = 10, *, curves: int = CURVES, block_rows: int = BLOCK_ROWS, seed: int = 5, complete: bool = True, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of every row that queries_where (of vec_id) picks.

    Distinct vectors are projected on a few random directions, several times over, and ordered along a Hilbert curve
    of each shifted grid: one range-partitioned sort. The curve is cut into blocks of block_rows; a query is ranked
    against the blocks round its own on each curve, as many on either side as window_width finds to be needed, and the
    curves' results merge. With `complete` an exact check follows: the windows give each query a distance which its k
    nearest cannot exceed, and every block of the first curve whose ball (centre and radius) comes within that distance
    of the ball of a block's queries is searched too; on vectors without clusters those are most blocks. Without, the
    result is approximate, at RECALL or so, and exact where windows cover the table. Scores are exact either way.

    Vectors are compared with those of their own length, a search for each length. Copies of a vector enter the index
    once, and come back as the k + 1 smallest ids of their group: ties go to the smaller id. Null vec_ids and vectors
    that are null, empty, zero or hold null or non-finite numbers take no part. A vec_id is never its own neighbour; a
    repeated one counts at its nearest. Fewer candidates than k give fewer rows; an empty table none; extra columns
    are ignored.
    """
    rows = usable(vectors, id_column, vector_column)
    lengths = [r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    options = {"curves": curves, "block_rows": block_rows, "seed": seed, "complete": complete}
    found = [_nearest_of_length(rows.filter(F.size("vector") == n), n, queries_where, k, **options) for n in lengths]
    if not found:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    each = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_of_length(rows: DataFrame, dim: int, queries_where, k: int, *, curves: int, block_rows: int, seed: int, complete: bool) -> DataFrame:
    """(query_id, vec_id, score): at least the k nearest of each query among rows (vec_id, vector) of one length."""
    # Spark limits a group to its first k + 1 in each task before it moves: copies never gather.
    sorted_ids = Window.partitionBy("vector").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = rows.withColumn("n", F.row_number().over(sorted_ids)).withColumn("rep", F.first("vec_id").over(sorted_ids))
    members = materialize(members.filter(F.col("n") <= k + 1).select("rep", "vec_id", "n", "vector"), "vector-members")
    distinct = members.filter("n = 1").select("rep", "vector")
    asking = materialize(rows.filter(queries_where).join(distinct, "vector").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")), "vector-queries")

    turned, shifts = projections(dim, curves, seed)
    spans = distinct.select("vector").mapInArrow(_ranges(turned), "i int, low double, high double").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = {r["i"]: (r["low"], r["high"]) for r in spans.collect()}  # curves * dims rows
    low, high = (np.array([spans[i][side] for i in range(len(spans))]).reshape(shifts.shape) for side in (0, 1))
    kind = dict(distinct.dtypes)["vector"]
    keyed = distinct.mapInArrow(_keys(turned, shifts, low, np.maximum(high - low, 1e-300)), f"curve int, key long, rep long, vector {kind}")
    stored = sorted_parts(keyed, ["curve", "key", "rep"], "vector-curves")
    offsets = running_offsets(stored, F.lit(1)).select("part", "before")
    # Each curve has every row, and blocks of its own: in a block of two curves a row would take two places among the k.
    n = distinct.count()
    block = F.expr(f"curve * {-(-n // block_rows)}L + (before + place - curve * {n}L) div {block_rows}").cast("long")
    index = stored.join(offsets, "part").withColumn("block", block).select("curve", "block", "rep", "vector")
    index = materialize(index, "vector-index")

    own = index.join(asking.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").select("curve", "block", F.col("rep").alias("query"), "vector")
    own = materialize(own, "vector-asked")
    width, _ = window_width(index, own, distinct, k + 1)
    step = min(width, MOST_STEPS)
    far = F.lit(float("inf"))
    near = own.select("query", "vector", far.alias("reach"), F.expr(f"block div {step}").alias("chunk"))
    around = F.sequence(F.col("chunk") * step - width, F.col("chunk") * step + (step - 1 + width))
    pairs = near.select("chunk").distinct().select("chunk", F.explode(around).alias("block"))
    best = materialize(_best(_searched(pairs, near, index.select("block", "rep", "vector"), k + 1), k + 1), "vector-windows")
    if complete:
        reach = best.groupBy("query").agg(F.when(F.count("*") > k, F.max("score")).otherwise(far).alias("reach"))
        asked = own.filter("curve = 0").join(reach, "query")
        asked = materialize(asked.select(F.col("block").alias("chunk"), "query", "vector", "reach"), "vector-chunks")
        first = index.filter("curve = 0")
        ball = "centre array<double>, radius double, reach double"
        blocks = materialize(first.withColumn("reach", F.lit(0.0)).groupBy("block").applyInArrow(_summaries("block"), f"block long, {ball}"), "vector-balls")
        chunks = materialize(asked.groupBy("chunk").applyInArrow(_summaries("chunk"), f"chunk long, {ball}"), "vector-chunk-balls")
        block_lots, chunk_lots = ((t.count() // BALLS_A_LOT) + 1 for t in (blocks, chunks))
        lot = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).alias(name)
        every = lambda n, name: F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias(name)
        blocks, chunks = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (blocks, chunks))
        left = blocks.select("*", lot("block", block_lots, "lot"), every(chunk_lots, "of")).groupBy("lot", "of")
        right = chunks.select("*", lot("chunk", chunk_lots, "of"), every(block_lots, "lot")).groupBy("lot", "of")
        reached = materialize(left.cogroup(right).applyInArrow(_reached, "block long, chunk long"), "vector-reached")
        more = _searched(reached, asked, first.select("block", "rep", "vector"), k + 1)
        best = materialize(_best(best.select("query", "rep", "score").unionByName(more), k + 1), "vector-best")
    each = asking.join(best, "query").join(members.select("rep", "vec_id"), "rep").filter("vec_id <> query_id")
    return each.select("query_id", "vec_id", "score")
