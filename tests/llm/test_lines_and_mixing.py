import pytest
from brute import cleaned, draws
from compare import rows_of

from tessera.llm import line_dedup, mixing, queries


def test_line_dedup_of_odd_documents(odd, none, rows):
    found = line_dedup.cleaned(odd, 3, counts=("before", "gone"))
    assert found.columns == [*odd.columns, "before", "gone"]
    named = [(i, t, s) for i, t, s, _ in rows if i is not None]
    want = cleaned(named, 3)
    got = [r for r in found.collect()]
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.text == want[r.doc_id], r.doc_id
            assert r.before - r.gone == (len(r.text.split("\n")) if r.text or r.before > r.gone else 0)
    by = {r.doc_id: r for r in got}
    assert by[12].text == "the same line here\nmine" and by[13].text == "other" and by[14].text == "zzz"
    assert by[3].text == "" and by[3].gone == 0
    assert line_dedup.cleaned(none, 3).count() == 0


def test_a_null_id_is_the_first_occurrence(spark):
    docs = spark.createDataFrame([(None, "x\nhere", "s1"), (1, "here\ny", "s2"), (0, "z\nhere\n", "s3")], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs, 3).collect()}
    assert got == {None: "x\nhere", 1: "y", 0: "z\n"}


@pytest.mark.parametrize("sites", [19, 20, 21, 22, 40])
def test_spread_near_the_threshold_is_exact(spark, sites):
    rows = [(100 * n + s, f"line {n}\nown {n} {s}", f"s{s}") for n in (18, 19, 20, 21, 22, 40) for s in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs, sites).collect()}
    assert got == cleaned(rows, sites)


def test_all_lines_of_a_text_may_go(spark):
    texts = ["a\nb\n\na", "b\na", "a", "c\na\nb\nd"]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs, 3).collect()}
    assert got == cleaned([(i, t, f"s{i}") for i, t in enumerate(texts)], 3) == {0: "a\nb\n", 1: "", 2: "", 3: "c\nd"}


def test_a_block_on_enough_sites_goes_whole(spark):
    block = "licence one\nlicence two\nlicence three\nlicence four"
    rows = [(i, f"text {i}\n{block}\nend {i}", f"s{i}") for i in range(10)] + [(50 + i, f"own {i}\nfew\nof them", f"s{i}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs, 5).collect()}
    assert got == {i: t if i in (0, 50, 51, 52, 53) else f"text {i}\nend {i}" for i, t, _ in rows}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, data, duck, name):
    assert rows_of(queries.QUERIES[name](spark, data).toPandas()) == rows_of(duck.sql(queries.ORACLE_SQL[name]).df())


def test_mixing_of_odd_documents(odd, none, rows):
    want = draws([(i, t, s, lang) for i, t, s, lang in rows if i is not None], mixing.POWER, 42)
    got = mixing.mixed(odd.where("doc_id is not null")).collect()
    assert len(got) == 15
    for r in got:
        weight, p, kept = want[r.doc_id]
        assert abs(r.weight - weight) < 1e-5 and abs(r.probability - p) < 1e-5 and r.kept == kept
    assert mixing.mixed(odd).count() == len(rows)
    assert mixing.mixed(none).count() == 0


def test_expected_tokens_meet_the_targets(spark):
    rows = [(i, "w " * (5 + i % 7), f"s{i % 3 if i % 5 else 0}", "en" if i % 4 else "de", f"t{i % 2}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string")
    targets = {"source": {"s0": 0.2, "s1": 0.5, "s2": 0.3}, "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "value string, share double"), "topic": {"t0": 0.6, "t1": 0.4}}
    found = mixing.mixed(docs, targets, topic_col="subject").toPandas()
    expected = found.n_tokens * found.weight
    for column, shares in (("source", targets["source"]), ("lang", {"en": 0.5, "de": 0.5}), ("topic", targets["topic"])):
        for value, share in shares.items():
            assert abs(expected[found[column] == value].sum() / expected.sum() - share) < 1e-5
    assert found.probability.max() == 1.0
    sampled = found[found.kept].n_tokens.sum() / (found.n_tokens * found.probability).sum()
    assert 0.93 < sampled < 1.07


@pytest.mark.parametrize("lang", [{"en": 0.1, "de": 0.9}, {"de": 1.0}])
def test_targets_that_contradict_each_other_raise(spark, monkeypatch, lang):
    monkeypatch.setattr(mixing, "PATIENCE", 20)
    docs = spark.createDataFrame([(1, "a b", "s0", "en"), (2, "c d", "s1", "de")], "doc_id long, text string, source string, lang string")
    with pytest.raises(ValueError, match="contradict"):
        mixing.mixed(docs, {"source": {"s0": 0.9, "s1": 0.1}, "lang": lang})


def test_fitting_in_one_task_and_in_many_agree(spark, monkeypatch):
    rows = [(i, "w " * (5 + i % 7), f"s{i % 3 if i % 5 else 0}", "en" if i % 4 else "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    one = sorted(mixing.mixed(docs).collect())
    monkeypatch.setattr(mixing, "CELLS", 2)
    assert sorted(mixing.mixed(docs).collect()) == one
