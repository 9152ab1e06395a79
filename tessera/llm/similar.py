"""Links between all texts whose shingles' similarity (Jaccard) reaches a threshold, by an exact prefix filter.

Put the distinct shingles of every text into one order. Of two texts with a similarity of t or more, each has the
first shingle they share among its first n - ceil(t * n) + 1 ones, n being its own number of shingles. The index
therefore lists each text under the shingles of that prefix. Pairs that meet in a list are candidates if their
sizes and the places of the shingle leave room for the similarity; no pair that has it is lost. Any order gives
the same links: shingles that are common in a sample come last, so lists are short.

Candidates are verified in three rounds, so that a large group does not cost all its pairs: pairs of near fingerprints
from the byte-position index (simhash.py) and neighbours by size in each list; neighbours in an order by chance; and then
all pairs that the links so far have not brought together. The verdict is exact, on all distinct shingles of both texts
(by their 64-bit hashes); before it go pairs whose shingles differ too much in number by last byte of their hashes, which
no similar pair does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, arrow_ready, map_texts
from .components import components
from .simhash import majority, shingle_hashes

#: Documents that show which shingles are common, about; occurrences there from which on one is; and how many may be.
SHOWN, OFTEN, COMMON = 8000, 3, 100_000
#: Places in a list within which pairs are verified first; four times as many in the second round.
NEIGHBOURS = 16
#: Rows of a list that a task holds at a time, about; longer lists are cut, and for all their pairs dealt in parts.
#: Otherwise tasks take ranges of rows, not of lists, so that one long list is the work of several.
HELD = 1 << 17
#: Rows of a list from which on only pairs of different labels are looked at one by one.
LONG = 512
#: What float arithmetic may be off by.
SLACK = 1e-9


def common(docs: DataFrame, text_col: str, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are common in a sample of the texts, sorted, and their counts there."""
    text = F.col(f"`{text_col}`")
    rate = max(1, docs.count() // SHOWN)
    shown = docs.select(text.alias("__body")).where(F.pmod(F.xxhash64(text, F.lit(1)), F.lit(rate)) == 0)

    def make():
        return lambda texts: [[np.unique(shingle_hashes(t, shingle_words)).view(np.int64) for t in texts]]

    hashes = map_texts(shown, "__body", [], "__hashes array<long>", make).select(F.explode("__hashes").alias("__hash"))
    counted = hashes.groupBy("__hash").agg(F.count("*").alias("__n")).where(F.col("__n") >= OFTEN)
    found = counted.orderBy(F.desc("__n"), "__hash").limit(COMMON).toArrow()
    at, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(at)
    return at[order], n[order]


def prefix(own: np.ndarray, alike: float, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of the distinct hashes `own`, as many as a similar text must share one of."""
    if not len(own):
        return own
    size = len(own) - int(np.ceil(alike * len(own) - SLACK)) + 1
    rank = np.zeros(len(own), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        rank = np.where(known[at] == own, counts[at], 0)
    return own[np.lexsort((own, rank))[:size]]


def spread(own: np.ndarray) -> bytes:
    """How many of the distinct hashes have each last byte; nothing if a number does not fit a byte."""
    counts = np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_alike(a: bytes, b: bytes, alike: float) -> bool:
    """Whether texts of these spreads can be similar: they share at most the lesser number of each last byte."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if not len(x) or not len(y):
        return True
    return np.minimum(x, y).sum(dtype=np.int64) >= (x.sum(dtype=np.int64) + y.sum(dtype=np.int64)) * alike / (1 + alike) - SLACK


def marked(docs: DataFrame, text_col: str, keep: list[str], shingle_words: int, alike: float) -> DataFrame:
    """The columns keep; __fp; __node long, equal for texts of equal distinct shingles; __n long, their number; __prefix; __spread."""
    known, counts = common(docs, text_col, shingle_words)

    def make():
        def work(texts):
            hashes = [shingle_hashes(t, shingle_words) for t in texts]
            fps = np.fromiter(map(majority, hashes), np.uint64, len(texts))
            own = [np.unique(h) for h in hashes]
            nodes = np.fromiter((xxhash.xxh64_intdigest(o.tobytes()) for o in own), np.uint64, len(texts))
            return [fps.view(np.int64), nodes.view(np.int64), [len(o) for o in own], [prefix(o, alike, known, counts).view(np.int64) for o in own], list(map(spread, own))]

        return work

    return map_texts(docs, text_col, keep, "__fp long, __node long, __n long, __prefix array<long>, __spread binary", make)


def _room(a: np.ndarray, b: np.ndarray, alike: float) -> np.ndarray:
    """Whether texts can be similar, given by size << 32 | the shared shingle's place in their prefix."""
    n, m = a >> 32, b >> 32
    fits = np.minimum(n, m) >= alike * np.maximum(n, m) - SLACK
    most = np.minimum(n - (a & 0xFFFFFFFF), m - (b & 0xFFFFFFFF))
    return fits & (most >= (n + m) * alike / (1 + alike) - SLACK)


def _candidates(keys: np.ndarray, packed: np.ndarray, alike: float, furthest: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in whole lists, sorted by key, that can be similar: all, if the lists are sorted by size, or those at most `furthest` places apart."""
    sizes = packed >> 32
    i, apart = np.arange(len(keys)), 1
    while len(i := i[i + apart < len(keys)]) and (furthest is None or apart <= furthest):
        i = i[keys[i] == keys[i + apart]]
        if furthest is None:  # sizes only grow: who fails here is done
            i = i[sizes[i] >= alike * sizes[i + apart] - SLACK]
        j = i + apart
        room = _room(packed[i], packed[j], alike)
        yield i[room], j[room]
        apart += 1


def _of_different_labels(packed: np.ndarray, labels: np.ndarray, alike: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one list that can be similar and differ in their labels; rows of the most frequent label are not compared with each other."""
    values, counts = np.unique(labels, return_counts=True)
    most = labels == values[counts.argmax()]
    for i in np.flatnonzero(~most):
        other = (labels != labels[i]) & _room(packed[i], packed, alike)
        other[:i] &= most[:i]
        j = np.flatnonzero(other)
        yield np.full(len(j), i), j


def _whole_lists(batches: Iterator[pa.RecordBatch], held_rows: int | None = None) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by their first one, cut between its values, and within one after held_rows, if that is given."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or (held and held[0][0][-1] != columns[0][0]):
            done = [*held, [c[:cut] for c in columns]]
            yield [np.concatenate(c) for c in zip(*done)]
            held = []
        held.append([c[cut:] for c in columns])
        if held_rows and sum(len(h[0]) for h in held) > held_rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _members(alike: float):
    """Arrow function from (key, packed, node), sorted, to those rows that have a candidate in their list; all rows of lists that may go on elsewhere.

    Those are long ones, of which a task holds parts, and a task's first and last one, where lists are cut between tasks.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("key", "packed", "node")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = _whole_lists(batches, HELD)
        columns, before = next(lists, None), None
        while columns is not None:
            following = next(lists, None)
            keys = columns[0]
            starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            met = np.repeat(sizes > LONG, sizes) | (keys == (keys[0] if before is None else before))
            if following is None:
                met |= keys == keys[-1]
            short = np.flatnonzero(~met)
            for i, j in _candidates(keys[short], columns[1][short], alike):
                met[short[i]] = met[short[j]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in columns], schema=schema)
            columns, before = following, keys[-1]

    return run


def _pairs(alike: float, furthest: int | None):
    """Arrow function from (key, packed, node, label), sorted, to candidates (a, b) of different labels."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def found(keys: np.ndarray, packed: np.ndarray, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if furthest is not None:
            yield from _candidates(keys, packed, alike, furthest)
            return
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        mixed = np.minimum.reduceat(labels, starts) != np.maximum.reduceat(labels, starts)
        short = np.flatnonzero(np.repeat(mixed & (sizes <= LONG), sizes))
        for i, j in _candidates(keys[short], packed[short], alike):
            yield short[i], short[j]
        for n in np.flatnonzero(mixed & (sizes > LONG)):
            own = slice(starts[n], starts[n] + sizes[n])
            for i, j in _of_different_labels(packed[own], labels[own], alike):
                yield i + starts[n], j + starts[n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, packed, nodes, labels in _whole_lists(batches, None if furthest is None else HELD):
            for i, j in found(keys, packed, labels):
                apart = labels[i] != labels[j]
                a, b = nodes[i[apart]], nodes[j[apart]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (key, ..., label): without lists of one label, and with lists of over HELD rows dealt to parts, so that each pair of rows of a list is in some part."""
    often = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    met = rows.join(often.select("key", F.ceil(F.col("n") / HELD).cast("int").alias("parts")), "key")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    cells = F.transform(others, lambda x: F.xxhash64(F.col("key"), F.least(x, own), F.greatest(x, own)))
    keys = F.when(F.col("parts") == 1, F.array("key")).otherwise(cells)
    return met.select(F.explode(keys).alias("key"), *[c for c in rows.columns if c != "key"])


def alike_enough(a: bytes, b: bytes, alike: float) -> bool:
    """Whether two texts, given by all their distinct hashes, have that similarity."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, True))
    return both >= alike * (len(x) + len(y) - both)


def _judged(judge: Callable[[bytes, bytes, float], bool], alike: float):
    """Arrow function from (a, b, what judge takes of a, of b) to the pairs that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3))
            yield batch.select(["a", "b"]).filter(pa.array([bool(judge(x.as_py(), y.as_py(), alike)) for x, y in both], pa.bool_()))

    return run


def links(rows: DataFrame, bodies: DataFrame, shingle_words: int, alike: float, max_distance: int, scratch: Scratch) -> DataFrame:
    """rows (__row and what marked() gives), bodies (__row, __body) -> (a, b): links that connect all similar nodes."""
    arrow_ready(rows.sparkSession)
    first = [F.first(c).alias(c) for c in ("__n", "__prefix", "__spread")]
    nodes = scratch.keep(rows.groupBy("__node").agg(*first, F.min("__fp").alias("__fp"), F.min("__row").alias("__of")))

    packed = F.shiftleft("__n", 32).bitwiseOR(F.col("__at").cast("long"))
    index = nodes.select("__node", "__n", F.posexplode("__prefix").alias("__at", "key")).select("key", packed.alias("packed"), F.col("__node").alias("node"))
    order = ["key", "packed", "node"]
    members = scratch.keep(index.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_members(alike), "key long, packed long, node long"))
    known = scratch.keep(members.select("node").distinct().join(nodes.select(F.col("__node").alias("node"), "__fp", "__spread", "__of"), "node"))

    def make():
        return lambda texts: [[np.unique(shingle_hashes(t, shingle_words)).astype("<u8").tobytes() for t in texts]]

    def beside(pairs: DataFrame, what: DataFrame, column: str) -> DataFrame:
        for n in "ab":
            pairs = pairs.join(what.select(F.col("node").alias(n), F.col(column).alias(f"{column}_{n}")), n)
        return pairs

    def similar(pairs: DataFrame) -> DataFrame:
        both = beside(pairs, known, "__spread").select("a", "b", "__spread_a", "__spread_b")
        left = scratch.keep(both.mapInArrow(_judged(may_be_alike, alike), "a long, b long"))
        chosen = scratch.keep(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(known.select("node", "__of"), "node"))
        texts = bodies.join(chosen, F.col("__row") == F.col("__of")).select("node", "__body")
        hashes = scratch.keep(map_texts(texts, "__body", ["node"], "__hashes binary", make).dropDuplicates(["node"]))
        return beside(left, hashes, "__hashes").select("a", "b", "__hashes_a", "__hashes_b").mapInArrow(_judged(alike_enough, alike), "a long, b long")

    def labelled(found: DataFrame | None) -> DataFrame:
        if found is None:
            return members.withColumn("label", F.col("node"))
        return members.join(components(found, scratch).toDF("node", "root"), "node", "left").select(*order, F.coalesce("root", "node").alias("label"))

    def candidates(lists: DataFrame, by: list, furthest: int | None) -> DataFrame:
        """Pairs of different labels; by orders the lists, which only stay in one task if all their pairs are looked at."""
        rows = lists.select(*order, "label")
        sorted_ = (rows.repartition("key") if furthest is None else rows.repartitionByRange("key", *by)).sortWithinPartitions("key", *by)
        return sorted_.mapInArrow(_pairs(alike, furthest), "a long, b long").distinct()

    def near_fingerprints() -> DataFrame:
        """Pairs of nodes: one for each link of the index, and the nodes of one fingerprint with one of them."""
        at = scratch.keep(known.groupBy("__fp").agg(F.min("node").alias("node")))
        near = simhash.links(at.select("__fp"), max_distance, scratch=scratch)
        for n in "ab":
            near = near.join(at.select(F.col("__fp").alias(n), F.col("node").alias(f"node_{n}")), n)
        same = known.join(at.select("__fp", F.col("node").alias("other")), "__fp").where("node <> other")
        pairs = near.select(F.col("node_a").alias("x"), F.col("node_b").alias("y")).union(same.select("node", "other"))
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    tried = scratch.keep(near_fingerprints().union(candidates(labelled(None), order[1:], NEIGHBOURS)).distinct())
    found = scratch.keep(similar(tried))
    more = scratch.keep(candidates(labelled(found), [F.xxhash64("node", "key"), "node"], 4 * NEIGHBOURS).join(tried, ["a", "b"], "left_anti"))
    found = scratch.keep(found.union(similar(more)))
    rest = candidates(_dealt(scratch.keep(labelled(found))), order[1:], None)
    rest = scratch.keep(rest.join(tried.union(more), ["a", "b"], "left_anti"))
    return scratch.keep(found.union(similar(rest)))
