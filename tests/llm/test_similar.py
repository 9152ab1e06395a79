import numpy as np
from brute import near_classes

from tessera.llm import simhash, similar


def copies(seed, sizes):
    """Texts and copies of them with a few words changed, at similarities on either side of 0.8."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    texts = []
    for n, size in enumerate(sizes):
        base = [word() for _ in range(size)]
        texts.append(" ".join(base))
        for edits in range(1 + n % 4):
            copy = list(base)
            for at in rng.choice(size, 1 + size * (edits + 1) // 100, False):
                copy[int(at)] = word()
            texts.append(" ".join(copy))
    return texts


def test_all_similar_pairs_are_linked_however_many_bits_differ(spark):
    texts = copies(5, [60 + 15 * (n % 8) for n in range(40)])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    of = near_classes(texts, 5, 0.8)
    assert len(set(of)) < len(texts)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == sorted(set(of))


def test_candidates_of_lists_across_batches():
    import pyarrow as pa

    keys, sizes = np.sort(np.arange(300) % 17), np.tile(10, 300)
    rows = [keys, sizes << 32, np.arange(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 7]) for c in rows], ["key", "packed", "node"]) for i in range(0, 300, 7)]
    whole = list(similar._whole_lists(iter(batches)))
    assert all((np.concatenate(c) == r).all() for c, r in zip(zip(*whole), rows))
    assert all(a[0][-1] < b[0][0] for a, b in zip(whole, whole[1:]))
    got = {(int(w[2][a]), int(w[2][b])) for w in whole for i, j in similar._candidates(w[0], w[1], 0.8) for a, b in zip(i, j)}
    assert got == {(a, b) for a in range(300) for b in range(a + 1, 300) if keys[a] == keys[b]}


def test_rows_of_lists_that_are_cut_all_stay(monkeypatch):
    """One row is left of a list that a task holds in two parts; lists go on in the tasks before and after."""
    import pyarrow as pa

    monkeypatch.setattr(similar, "HELD", 9)
    monkeypatch.setattr(similar, "LONG", 4)
    keys = np.array([1, 2] + [3] * 15 + [4, 5, 5, 6])
    rows = [keys, np.full(len(keys), 10 << 32), np.arange(len(keys))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 8]) for c in rows], ["key", "packed", "node"]) for i in range(0, len(keys), 8)]
    got = [k for b in similar._members(0.8)(iter(batches)) for k in b.column(0).to_pylist()]
    assert got == [1] + [3] * 15 + [5, 5, 6]
    assert list(similar._members(0.8)(iter([]))) == []


def test_long_texts_near_the_threshold_are_judged_exactly(spark):
    rng = np.random.default_rng(6)
    texts = []
    for n in range(24):
        base = [f"{n}w{i}" for i in range(600)]
        copy = list(base)
        for at in rng.choice(120, 12 + n % 4, False):  # 13 words in places five or more apart are the most for 0.8
            copy[int(at) * 5] = f"{n}x{at}"
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    of = near_classes(texts, 5, 0.8)
    assert 24 < len(set(of)) < 48
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == sorted(set(of))


def test_spreads_let_all_similar_pairs_pass():
    rng = np.random.default_rng(7)
    for size in (1, 9, 60, 800, 90_000):
        own = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for shared in (0.85, 0.9, 0.95):
            other = np.unique(np.concatenate((own[: int(shared * size)], rng.integers(0, 2**63, size - int(shared * size), dtype=np.uint64))))
            if similar.alike_enough(own.tobytes(), other.tobytes(), 0.8):
                assert similar.may_be_alike(similar.spread(own), similar.spread(other), 0.8)
    few = [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64)) for _ in range(2)]
    assert not similar.may_be_alike(*map(similar.spread, few), 0.8)


def test_long_lists_are_dealt_in_parts_and_lose_no_link(spark, monkeypatch):
    """One list of many texts: three groups of near copies that share a rare shingle."""
    rng = np.random.default_rng(8)
    texts = []
    for n in range(3):
        base = [f"{n}w{i}" for i in range(30)] + ["the", "one", "shared", "rare", "shingle"]
        for _ in range(25):
            copy = list(base)
            copy[int(rng.integers(0, 30))] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    of = near_classes(texts, 5, 0.8)
    for held, long, near in ((9, 4, 1), (1 << 17, 4, 1), (1 << 17, 512, 16)):
        for name, value in (("HELD", held), ("LONG", long), ("NEIGHBOURS", near)):
            monkeypatch.setattr(similar, name, value)
        assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == sorted(set(of))


def test_documents_of_the_tables_lose_no_near_copy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    of = near_classes([t for _, t in rows], 5, 0.8)
    assert 900 < len(set(of)) < 1000 and max(len(t.split()) for _, t in rows) > 500
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == sorted(rows[c][0] for c in set(of))
