from itertools import combinations

import numpy as np
import pytest
from brute import classes, fingerprint, near_classes

from tessera.llm import components, simhash
from tessera.llm.common import table


def expected(rows, distance, size):
    """(id, fingerprint, component) of every row, by comparing all pairs."""
    prints = [fingerprint(t, size) for _, t in rows]
    of = classes(prints, distance)
    least = {}
    for (i, _), c in zip(rows, of):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(str((i, f"{p:016x}", least.get(c))) for (i, _), p, c in zip(rows, prints, of))


def near(rng, n):
    """Fingerprints in a few dense groups, some of them chained, and some alone."""
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    found = set()
    for c in centres:
        value = int(c)
        for _ in range(n):
            value ^= 1 << int(rng.integers(0, 64))
            if rng.random() < 0.5:
                value ^= 1 << int(rng.integers(0, 64))
            found.add(value)
            if rng.random() < 0.1:
                value = int(c)
    found |= {int(x) for x in rng.integers(0, 2**63, n, dtype=np.uint64)}
    return sorted(found)


def test_fingerprints(rows):
    for _, text, *_ in rows:
        if len(text or "") < 20_000:
            for size in (1, 4, 5):
                assert simhash.fingerprint(text, size) == fingerprint(text, size)
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == 0


def test_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text, 4) == fingerprint(text, 4)


def test_odd_documents(odd, none, rows):
    found = simhash.grouped(odd)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(str, map(tuple, found.collect()))) == expected([r[:2] for r in rows], 4, 4)
    assert simhash.grouped(none).count() == 0


def test_documents(spark, data):
    docs = table(spark, data, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(str, map(tuple, simhash.grouped(docs).collect()))) == expected(rows, 4, 4)


@pytest.mark.parametrize("distance", [0, 1, 4, 5])
@pytest.mark.parametrize("longest", [20, 4096])
def test_links_connect_all_near_pairs(spark, distance, longest):
    values = near(np.random.default_rng(distance), 60)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "__fp long").repartition(3)
    links = [(a % 2**64, b % 2**64) for a, b in simhash.links(nodes, distance, longest).collect()]
    assert all(0 < (a ^ b).bit_count() <= distance for a, b in links)
    at = {v: i for i, v in enumerate(values)}
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = sorted((find(at[a]), find(at[b])))
        label[y] = x
    assert [find(i) for i in range(len(values))] == classes(values, distance)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(5, 5), (1, 0)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(frame).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(60)} | {2000 + i: 2000 for i in range(9)}
    assert components.components(frame.where("false")).count() == 0


def test_one_row_of_each_group_stays(odd, rows, none):
    kept = simhash.deduplicated(odd, shingle_words=4)
    assert kept.columns == odd.columns
    of = near_classes([t for _, t, *_ in rows], 4, 0.8)
    got = kept.collect()
    assert len(got) == len(set(of))
    best = {}
    for (i, *_), c in zip(rows, of):
        best[c] = min(best.get(c, (True, 1e9)), (i is not None, i or 0))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i if known else None) for known, i in best.values())
    assert simhash.deduplicated(none).count() == 0


def test_similar_texts_are_one_group(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = []
    for n in range(40):
        base = [word() for _ in range(60 + 20 * (n % 7))]
        texts.append(" ".join(base))
        for edits in range(n % 4):
            copy = list(base)
            for _ in range(edits + 1):
                copy[int(rng.integers(len(copy)))] = word()
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    of = near_classes(texts, 5, 0.8)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == sorted(set(of))


def test_any_near_pair_meets_under_some_positions():
    for distance in range(6):
        shared = 8 - distance
        assert all(len(c) == max(1, min(4, shared - 1)) for c in simhash.positions(shared))
        assert all(any(set(c) <= set(x) for c in simhash.positions(shared)) for x in combinations(range(8), shared))


def test_the_tally_rejects_pairs_of_a_list():
    """Values that share the three bytes of a key and lie within 4 bits need a fourth equal byte."""
    rng = np.random.default_rng(8)
    values = np.unique((rng.integers(0, 2**40, 3000, dtype=np.uint64) << np.uint64(24)) | np.uint64(0xABCDEF)).view(np.int64)
    one = values[0]
    shared = ((values ^ one).view(np.uint64).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    assert (shared < 4).mean() > 0.9 and not simhash._near(values, one, 4)[shared < 4].any()
    near = one ^ np.int64(0b1111 << 32)
    assert simhash._near(np.array([near, one ^ np.int64(0x0101010101000000)]), one, 4).tolist() == [True, False]


def test_a_hot_list_is_dealt_until_it_fits(spark):
    """100,000 fingerprints that share four bytes; some near others."""
    rng = np.random.default_rng(9)
    values = np.unique((rng.integers(0, 2**31, 100_000, dtype=np.uint64) << np.uint64(32)) | np.uint64(0x12345678))
    values = np.unique(np.concatenate((values, values[:500] ^ np.uint64(7 << 40))))
    import pandas as pd

    nodes = spark.createDataFrame(pd.DataFrame({"__fp": values.view(np.int64)})).repartition(4)
    links = [(a % 2**64, b % 2**64) for a, b in simhash.links(nodes, 3).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in links)
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    assert all(find(int(v)) == find(int(v) ^ (7 << 40)) for v in values[:50] if int(v) ^ (7 << 40) in set(values.tolist()))


def test_equal_fingerprints_of_different_texts_are_not_duplicates(spark):
    texts = [" ".join(["spam"] * 300 + [f"{n}w{i}" for i in range(120)]) for n in range(2)]
    assert simhash.fingerprint(texts[0], 5) == simhash.fingerprint(texts[1], 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [0, 1]
