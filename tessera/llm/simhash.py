"""Near-duplicate documents by SimHash.

A fingerprint has 64 bits, eight bytes at eight positions. Two fingerprints that differ in at most d bits have
at least 8 - d bytes equal, position by position. The inverted index lists each fingerprint under the bytes at
some choices of positions, one byte fewer than that guaranteed minimum, chosen so that any 8 - d positions
hold one of the choices (20 choices of three for d = 4): near fingerprints meet in some list. There the shared
positional bytes of each pair are tallied, pairs below the minimum go, and the rest is verified bit by bit.
Equal fingerprints are one entry of the index, so copies cost nothing there.

A list that outgrows LIST fingerprints is not compared there: its members stream out and are listed again,
under each of d + 1 interleaved blocks of the bits that they do not share yet, at least one of which is equal in
any two that differ in d bits; and so on, until every list fits. A task holds 8 bytes for each member of a list
and lets go only the links of a spanning forest of it, never all pairs.

Near copies of texts differ in more bits than an index of guaranteed matches can cover. deduplicated() therefore
takes the pairs that the index finds as its first candidates, completes them by an exact filter over the texts'
shingles, and verifies every link on all shingles of both texts (similar.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, durable, map_texts
from .components import components

#: Fingerprints that a list of the index may hold before it is listed again by blocks of bits.
LIST = 4096
#: Bits that values of a list may differ in from which on it is compared however long it is: it has at most 2 ** FREE values.
FREE = 12
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15
LINKS = "a long, b long, key long, mask long"


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of one text, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - shingle_words + 1)
    first, last = starts[:count].tolist(), ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, count)


def majority(hashes: np.ndarray) -> int:
    """The unsigned number whose bits are set in over half of the hashes; 0 without any."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle_words: int) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    return majority(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, shingle_words: int = 4, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns keep and __fp long (the fingerprint's 64 bits, signed) for every row of docs.

    Words are runs of characters other than the six ASCII separators, after lower-casing A-Z; shingles are
    shingle_words words joined by a space, repeats included; fewer words make one shingle. Bit i is set if
    over half of the shingles' XXH64 values (seed 42) have it set. No words or NULL: 0.
    """

    def make():
        return lambda texts: [np.fromiter((fingerprint(t, shingle_words) for t in texts), np.uint64, len(texts)).view(np.int64)]

    return map_texts(docs, text_col, keep or [], "__fp long", make)


@lru_cache
def positions(shared: int) -> list[tuple[int, ...]]:
    """Choices of byte positions, one fewer than shared (four at most), such that any `shared` of the eight hold one of them."""
    size = max(1, min(4, shared - 1))
    left = {frozenset(c) for c in combinations(range(8), shared)}
    chosen = []
    while left:
        best = max(combinations(range(8), size), key=lambda c: sum(x.issuperset(c) for x in left))
        chosen.append(best)
        left = {x for x in left if not x.issuperset(best)}
    return chosen


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _lists(fp: Column, shared: int) -> Column:
    """(key, mask) for each choice of positions: the choice's number and those bytes; and the bits that they take."""
    byte = [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    found = []
    for number, chosen in enumerate(positions(shared)):
        key, mask = F.lit(number).cast("long"), 0
        for place in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(byte[place])
            mask |= 255 << 8 * place
        found.append(F.struct(key.alias("key"), F.lit(_signed(mask)).cast("long").alias("mask")))
    return F.array(*found)


def _near(values: np.ndarray, other: np.ndarray, distance: int) -> np.ndarray:
    """Which of the values are within the distance of the other ones: by the tally of shared positional bytes, then by bits."""
    apart = (values ^ other).view(np.uint64)  # of a signed number, bitwise_count takes the absolute value
    near = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - distance
    near[near] = np.bitwise_count(apart[near]) <= distance
    return near


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (pairs of values) of a spanning forest of the graph of values within the distance."""
    links = []
    left = values
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            near = _near(left, node, distance)
            if near.any():
                met, left = left[near], left[~near]
                links.extend((int(node), int(x)) for x in met)
                frontier.extend(met)
    return links


def _lists_of(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, list[pa.RecordBatch], bool]]:
    """From rows sorted by a key: the key, rows of it, and whether these are the last ones, batch by batch."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            if held and keys[start] != key:
                yield key, held, True
                held = []
            key = int(keys[start])
            held.append(batch.slice(start, end - start))
        yield key, held, False
    if held:
        yield key, held, True


FOUND = pa.schema([(n, pa.int64()) for n in ("a", "b", "key", "mask")])


def _found(*columns: np.ndarray | None) -> pa.RecordBatch:
    size = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], schema=FOUND)


def _listed_again(key: int, mask: int, fps: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Members of a list under distance + 1 blocks of the bits outside the mask, as (fp, NULL, key, mask)."""
    free = [i for i in range(64) if not mask >> i & 1]
    for block in range(distance + 1):
        bits = sum(1 << i for i in free[block :: distance + 1])
        mixed = (fps.view(np.uint64) & np.uint64(bits)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= np.uint64((key * 0xBF58476D1CE4E5B9 + block * 0x94D049BB133111EB) % 2**64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        yield _found(fps, None, mixed.view(np.int64), np.full(len(fps), _signed((mask | bits) % 2**64)))


def _compared(distance: int, limit: int):
    """Arrow function over rows (key, fp, mask), sorted by key: links of a forest of each list as (a, b, NULL, NULL); the
    members of a list of over `limit` values under the keys of the next lists, as (fp, NULL, key, mask)."""

    def pairs_of(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, list[tuple[int, int]]]:
        """Lists of two that lie inside the batch, compared at once, and the stretches of rows that are left."""
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        place, sizes = np.arange(len(starts)), ends - starts
        inside = (place > 0) & (place < len(starts) - 1)
        at = starts[inside & (sizes == 2)]
        at = at[_near(fps[at], fps[at + 1], distance)]
        rest = np.flatnonzero(~inside | (sizes > 2))
        return _found(fps[at], fps[at + 1], None, None), [(int(starts[n]), int(ends[n] - starts[n])) for n in rest]

    def left_over(batches: Iterator[pa.RecordBatch], out: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, rest = pairs_of(batch)
                out.append(found)
                for start, size in rest:
                    yield batch.slice(start, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        over = None  # the key of a list that has outgrown the limit
        for key, held, whole in _lists_of(left_over(batches, out)):
            size, mask = sum(b.num_rows for b in held), held[0].column(2)[0].as_py() % 2**64
            if (key == over or size > limit) and 64 - mask.bit_count() > FREE:
                fps = np.concatenate([b.column(1).to_numpy() for b in held])
                held.clear()
                over = key
                yield from _listed_again(key, mask, fps, distance)
            elif whole and size > 1:
                fps = np.concatenate([b.column(1).to_numpy() for b in held])
                if links := _forest(fps, distance):
                    a, b = np.array(links, np.int64).T
                    out.append(_found(a, b, None, None))
            if len(out) > 64:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0] if any(b.num_rows for b in out) else out[0]
                out.clear()
        yield from out

    return run


def links(nodes: DataFrame, max_distance: int, longest: int = LIST, scratch: Scratch | None = None) -> DataFrame:
    """nodes (__fp long, distinct) -> (a, b): links that connect all fingerprints within max_distance (at most 5).

    Each round compares the lists that fit and deals the members of longer ones to shorter lists, until none is
    left; every round fixes further bits of a list, so there are few. Its tables belong to scratch if that is given.
    """
    if not 0 <= max_distance <= 5:
        raise ValueError("the index needs three shared bytes at least: a distance from 0 to 5")
    spark = nodes.sparkSession
    arrow_ready(spark)
    keep = scratch.keep if scratch is not None else durable
    lists = nodes.select(F.explode(_lists(F.col("__fp"), 8 - max_distance)).alias("list"), "__fp").select("list.key", "__fp", "list.mask")
    found = None
    while True:
        now = keep(lists.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(max_distance, longest), LINKS))
        linked = now.where("b is not null").select("a", "b")
        found = linked if found is None else found.union(linked)
        again = now.where("b is null")
        if again.isEmpty():
            return found
        lists = again.select("key", F.col("a").alias("__fp"), "mask")


def _components(marked: DataFrame, least: Column, linked: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """marked (__fp, ...) -> (__fp, __component): the smallest `least` among the rows of the fingerprint's component.

    linked gives the links (a, b) of the distinct fingerprints.
    """
    nodes = scratch.keep(marked.groupBy("__fp").agg(F.min(least).alias("__least")))
    members = components(linked(nodes.select("__fp")), scratch).toDF("__fp", "__root")
    smallest = nodes.join(members, "__fp").groupBy("__root").agg(F.min("__least").alias("__component"))
    named = members.join(smallest, "__root").select("__fp", "__component")
    return nodes.join(named, "__fp", "left").select("__fp", F.coalesce("__component", "__least").alias("__component"))


def grouped(docs: DataFrame, max_distance: int = 4, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id for every row of docs.

    component_id is the smallest id that a chain of links (fingerprints that differ in at most max_distance
    bits) reaches, the row's own included. Texts without words (NULL too) have fingerprint zero and are linked
    like any others. Rows with a NULL id are linked too, but their id is never a component's; component_id is
    NULL only if no linked row has an id. Repeated rows stay, each with its component. An empty table gives an
    empty result. Other columns of docs are not read.
    """
    scratch = Scratch()
    bare = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__body"))
    marked = durable(fingerprints(bare, shingle_words, ["__id"], "__body"))
    named = durable(_components(marked, F.col("__id"), lambda nodes: links(nodes, max_distance, scratch=scratch), scratch))
    scratch.clear(docs.sparkSession)
    return marked.join(named, "__fp").select(
        F.col("__id").alias(id_col),
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.col("__component").alias("component_id"),
    )


def deduplicated(docs: DataFrame, shingle_words: int = 5, alike: float = 0.8, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each group of near-duplicates: the one of the smallest id.

    Texts are linked if the similarity (Jaccard) of their distinct shingles is `alike` or more; groups are what
    chains of links connect. Fingerprints within max_distance give the first candidates, similar.py all others;
    equal fingerprints are candidates like any, and every link is verified exactly. Texts without words, NULL
    too, are alike. Of rows with the smallest id the one of the smallest hash of its text stays, and of equal rows
    one. A NULL id comes before all others. Names of other columns do not matter; an empty table stays empty.
    """
    from . import similar

    spark, scratch = docs.sparkSession, Scratch()
    row = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    bare = docs.select(F.col(f"`{id_col}`").alias("__id"), row.alias("__row"), F.col(f"`{text_col}`").alias("__body"))
    rows = scratch.keep(similar.marked(bare, "__body", ["__id", "__row"], shingle_words, alike))
    marked = rows.select(F.col("__node").alias("__fp"), "__id", "__row")
    linked = similar.links(rows, bare.select("__row", "__body"), shingle_words, alike, max_distance, scratch)
    chosen = _components(marked, F.struct("__id", "__row"), lambda _: linked, scratch).select("__component.*").distinct()
    often = marked.groupBy("__id", "__row").agg(F.count("*").alias("__n"))
    chosen = durable(chosen.alias("c").join(often.alias("o"), F.expr("c.__row = o.__row and c.__id <=> o.__id")).select(F.col("c.__id").alias("__i"), F.col("c.__row").alias("__r"), "__n"))
    scratch.clear(spark)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(f"`{id_col}`").alias("__id"), row.alias("__row"))
    met = held.join(chosen, (F.col("__row") == F.col("__r")) & F.col("__id").eqNullSafe(F.col("__i")))
    single = met.where("__n = 1").select("__doc.*")
    return single.union(met.where("__n > 1").dropDuplicates(["__row", "__id"]).select("__doc.*"))
