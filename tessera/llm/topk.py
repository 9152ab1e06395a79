"""Exact top-k search by inner product, by distributed selection on histograms.

Every query meets every candidate, block by block. In each round a task counts the scores of its block in a
histogram over the interval that still holds a query's k-th highest score; the histograms add up over all
blocks, and the bin that holds the k-th score becomes the next interval. When the interval is one score wide,
the k-th value is known: scores above it are in the result, and of the equal ones those of smallest id. A
task lets go only bins from the top that could hold the k-th score and, in the end, at most k ties a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_ready, durable

#: Vectors of a block at most, and bytes of a block about.
ROWS, BYTES = 1024, 1 << 20
#: Binary logarithm of the bins of a histogram.
BITS = 10
#: Bytes of query blocks that may be sent to every task; more are dealt to a grid of so many query and candidate blocks a cell.
SENT, GRID = 8 << 20, (16, 64)
#: Scores are below this bound, so that whole numbers of 64 bits hold them and their intervals.
LARGEST = 2**61

BLOCK = "block long, dim int, ids binary, asked binary, n_asked long, data binary, most double"
_BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("asked", pa.binary()), ("n_asked", pa.int64()), ("data", pa.binary()), ("most", pa.float64())])
QUERIES = "q_block long, dim int, q_ids binary, q_rows binary, q_data binary, q_most double"
_QUERIES = pa.schema([("q_block", pa.int64()), ("dim", pa.int32()), ("q_ids", pa.binary()), ("q_rows", pa.binary()), ("q_data", pa.binary()), ("q_most", pa.float64())])


def _raw(data: np.ndarray) -> bytes:
    """Whole numbers as 32-bit ones, or as doubles where they are larger: both are exact."""
    small = not data.size or np.abs(data).max() < 2**31
    return data.astype("<i4" if small else "<f8").tobytes()


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * n * dim else "<f8").reshape(n, dim)


def _most(data: np.ndarray) -> float:
    return float(np.abs(data).max()) if data.size else 0.0


def _packed(scale: int):
    """Arrow function from rows (id, vector, asked) to blocks of whole numbers floor(scale * x), unfit vectors left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, asked, data = (np.concatenate(c) for c in zip(*held.pop(dim)))
            made += 1
            if not np.isfinite(data).all():
                raise OverflowError("a scaled component is too large for a double")
            values = [[base + made], [dim], [ids.astype("<i8").tobytes()], [asked.tobytes()], [int(asked.sum())], [_raw(data)], [_most(data)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _BLOCK)], schema=_BLOCK)

        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            rows = np.flatnonzero(np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid()))
            if not len(rows):
                continue
            ids, vectors, asked = (batch.column(i).take(pa.array(rows)) for i in range(3))
            lengths = np.diff(vectors.offsets.to_numpy())
            numbers = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL becomes NaN
            ids, asked = ids.cast(pa.int64()).to_numpy(), np.asarray(asked.fill_null(False))
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            for dim in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == dim)
                data = numbers[starts[of][:, None] + np.arange(dim)[None, :]]
                fit = np.isfinite(data).all(axis=1)
                with np.errstate(over="ignore"):
                    left = [ids[of][fit], asked[of][fit], np.floor(scale * data[fit])]
                most = max(1, min(ROWS, BYTES // (4 * max(dim, 1))))
                while len(left[0]):
                    room = most - sum(len(p[0]) for p in held.get(dim, []))
                    held.setdefault(dim, []).append(tuple(c[:room] for c in left))
                    left = [c[room:] for c in left]
                    if sum(len(p[0]) for p in held[dim]) >= most:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return run


def _places(block: int, n: int) -> np.ndarray:
    """A number for each row of a block, different for all rows of the table."""
    return block * 1024 + np.arange(n)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of candidates the rows that are queries, as a block of queries."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, asked = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["asked"], bool)
            data = _matrix(r["data"], len(ids), r["dim"])[asked]
            values = [[r["block"]], [r["dim"]], [ids[asked].tobytes()], [_places(r["block"], len(ids))[asked].astype("<i8").tobytes()], [_raw(data)], [_most(data)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _QUERIES)], schema=_QUERIES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries put together to blocks of full size."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def block(dim: int, number: int) -> pa.RecordBatch:
        ids, rows, data = (np.concatenate(c) for c in zip(*held.pop(dim)))
        values = [[number], [dim], [ids.tobytes()], [rows.tobytes()], [_raw(data)], [_most(data)]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _QUERIES)], schema=_QUERIES)

    number, base = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for r in batch.to_pylist():
            ids, dim = np.frombuffer(r["q_ids"], "<i8"), r["dim"]
            if sum(len(p[0]) for p in held.get(dim, [])) + len(ids) > ROWS:
                number += 1
                yield block(dim, base + number)
            held.setdefault(dim, []).append((ids, np.frombuffer(r["q_rows"], "<i8"), _matrix(r["q_data"], len(ids), dim)))
    for dim in list(held):
        number += 1
        yield block(dim, base + number)


def _scores(q: np.ndarray, c: np.ndarray, bound: float, count: np.ndarray) -> np.ndarray:
    """Inner products (queries x candidates) of the pairs that count, exact in whole numbers: as doubles, 64-bit or unbounded ones."""
    if bound < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < LARGEST:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c)]
    scores = np.where(count, whole[0] @ whole[1].T, 0)
    if any(abs(x) >= LARGEST for x in scores.ravel()):
        raise OverflowError("a score needs more than 61 bits")
    return scores.astype(np.int64)


def _met(rows: Iterator[pa.RecordBatch]):
    """Of each pair of blocks: query block, query ids, candidate ids, lows of the intervals, places still open, scores, which count."""
    for batch in rows:
        for r in batch.to_pylist():
            q_ids, c_ids, dim = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8"), r["dim"]
            q, c = _matrix(r["q_data"], len(q_ids), dim), _matrix(r["data"], len(c_ids), dim)
            count = np.frombuffer(r["q_rows"], "<i8")[:, None] != _places(r["block"], len(c_ids))[None, :]
            scores = _scores(q, c, r["q_most"] * r["most"] * max(dim, 1), count)
            lows, left = np.zeros(len(q_ids), np.int64), np.zeros(len(q_ids), np.int64)
            for s in r["state"]:
                lows[s["place"]], left[s["place"]] = s["low"], s["left"]
            yield r["q_block"], q_ids, c_ids, lows, left, scores, count


_BINS = pa.schema([("q_block", pa.int64()), ("place", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())])


def _histograms(width: int, shift: int):
    """Counts of the scores in [low, low + width) by bins of 2**shift, from the top down to the one with the k-th score."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = width >> shift
        for block, q_ids, _, lows, left, scores, count in _met(rows):
            offset = scores - lows[:, None]
            inside = count & (offset >= 0) & (offset < width)
            place, column = np.nonzero(inside)
            flat = place * bins + (offset[place, column] >> shift)
            counts = np.bincount(flat, minlength=len(q_ids) * bins).reshape(len(q_ids), bins)
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            place, column = np.nonzero((counts > 0) & (above < left[:, None]))
            if len(place):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(place), block)), pa.array(place.astype(np.int32)), pa.array(column), pa.array(counts[place, column])], schema=_BINS
                )

    return run


_HITS = pa.schema([("q_block", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _hits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose score is above the k-th value, and of those equal to it the smallest ids that could still count."""
    for block, q_ids, c_ids, lows, left, scores, count in _met(rows):
        order = np.argsort(c_ids, kind="stable")
        c_ids, scores, count = c_ids[order], scores[:, order], count[:, order]
        tie = count & (scores == lows[:, None])
        wanted = (count & (scores > lows[:, None])) | (tie & (np.cumsum(tie, axis=1) <= left[:, None]))
        place, column = np.nonzero(wanted)
        if len(place):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), block)), pa.array(place.astype(np.int32)), pa.array(q_ids[place]), pa.array(c_ids[column]), pa.array(scores[place, column])],
                schema=_HITS,
            )


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest score for each row of vectors that queries picks.

    A vector counts as the whole numbers floor(scale * x); the score is the inner product. Candidates are all rows
    but the query's own; another row of the same id is one. Equal scores go by the smaller id; fewer candidates
    than k are all returned, and none give no row. Rows with a NULL id or vector, or a NULL or non-finite
    component, take no part; vectors of different lengths have no score together. Repeated rows are candidates
    each; a repeated query is answered once for each of its rows. A score of 61 bits or more raises OverflowError.
    An empty table gives an empty result; other columns do not matter.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    arrow_ready(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    candidates = durable(rows.where("id is not null and v is not null").mapInArrow(_packed(scale), BLOCK))
    some = candidates.where("n_asked > 0").select("block", "dim", "ids", "asked", "data")
    number = candidates.agg(F.sum("n_asked")).first()[0] or 0
    asked = durable(some.mapInArrow(_asked, QUERIES).repartition(max(1, -(-number // ROWS))).mapInArrow(_joined, QUERIES))
    sizes = asked.groupBy("dim").agg(F.max("q_most").alias("q"), F.count("*").alias("n_q"), F.sum(F.length("q_data")).alias("bytes"))
    by_dim = sizes.join(candidates.groupBy("dim").agg(F.max("most").alias("c"), F.count("*").alias("n_c")), "dim")
    bound, n_q, n_c, size = by_dim.agg(F.max(F.col("q") * F.col("c") * F.greatest("dim", F.lit(1))), F.sum("n_q"), F.sum("n_c"), F.sum("bytes")).first()
    reach = int(min(bound or 0, LARGEST - 2)) + 1
    few = (size or 0) <= SENT
    down, across = (max(1, -(-int(n or 0) // share)) for n, share in zip((n_q, n_c), GRID))

    def grid(state: DataFrame) -> DataFrame:
        """Every block of queries, with its state, beside every block of candidates of its length."""
        packed = state.groupBy("q_block").agg(F.collect_list(F.struct("place", "low", "left")).alias("state"))
        q, c, on = asked.join(packed, "q_block"), candidates.select("block", "dim", "ids", "data", "most"), ["dim"]
        if few:
            q = F.broadcast(q)  # at most SENT bytes
        else:
            every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
            q = q.withColumn("down", F.pmod(F.xxhash64("q_block"), F.lit(down)).cast("int")).withColumn("across", every(across))
            c = c.withColumn("across", F.pmod(F.xxhash64("block"), F.lit(across)).cast("int")).withColumn("down", every(down))
            on = ["dim", "down", "across"]
        return c.join(q, on).select("q_block", "dim", "block", "ids", "data", "most", "q_ids", "q_rows", "q_data", "q_most", "state")

    places = asked.select("q_block", F.explode(F.sequence(F.lit(0), (F.length("q_ids") / 8).cast("int") - 1)).alias("place"))
    state = durable(places.select("q_block", "place", F.lit(-reach).cast("long").alias("low"), F.lit(k).cast("long").alias("left")))
    width = 1 << (2 * reach).bit_length()
    while width > 1:
        shift = max(0, width.bit_length() - 1 - BITS)
        counts = grid(state).mapInArrow(_histograms(width, shift), "q_block long, place int, bin long, n long").groupBy("q_block", "place", "bin").agg(F.sum("n").alias("n"))
        falling = Window.partitionBy("q_block", "place").orderBy(F.col("bin").desc())
        passed = counts.withColumn("through", F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, 0)))
        holds = passed.join(state, ["q_block", "place"]).where((F.col("through") >= F.col("left")) & (F.col("through") - F.col("n") < F.col("left")))
        found = holds.select("q_block", "place", (F.col("low") + F.col("bin") * (1 << shift)).alias("low"), (F.col("left") - F.col("through") + F.col("n")).alias("left"))
        # queries with fewer candidates than k keep an interval below all scores: everything is above it
        short = state.join(found, ["q_block", "place"], "left_anti").select("q_block", "place", F.lit(-reach - (1 << 40)).cast("long").alias("low"), "left")
        state = durable(found.union(short))
        width = 1 << shift
    hits = grid(state).mapInArrow(_hits, "q_block long, place int, query_id long, vec_id long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q_block", "place").orderBy(F.col("score").desc(), F.col("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
