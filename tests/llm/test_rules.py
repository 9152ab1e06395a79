from collections import Counter

from brute import words
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import rules
from tessera.llm.common import table


def measures(text):
    text = text or ""
    found = words(text)
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 8))
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    chars = sum(len(w.decode()) for w in found)
    base = len(found) < 20 or 100 * len(covered) > 30 * len(found)
    return len(found), chars, sum(c in "#*$%&|<>" for c in text), again, len(covered), base


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("ab \n\t#|é\x85\x1c", max_size=80), st.lists(st.sampled_from(["a", "b", "a b c d e f g h", "\n", "x y"]), max_size=40).map(" ".join)))
def test_measures_equal_plain_ones(text):
    m = rules.Measures(text)
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed) == measures(text)


def test_screened(odd, none, rows):
    found = rules.screened(odd)
    assert found.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = found.collect()
    assert sorted(str(tuple(r[:7])) for r in got) == sorted(str((i, *measures(t))) for i, t, *_ in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert {r.doc_id: r.kept for r in got}[11] and rules.screened(none).count() == 0


def test_verdict_does_not_depend_on_the_order(spark, data):
    docs = table(spark, data, "documents")
    texts = [r.text for r in docs.collect()]
    ordered = rules.order(rules.RULES, [rules.tried(rules.RULES, t) for t in texts[:50]])
    assert sorted(r.name for r in ordered) == sorted(r.name for r in rules.RULES)
    for t in texts:
        assert rules.keeps(ordered, rules.Measures(t)) == rules.keeps(rules.RULES[::-1], rules.Measures(t))
    assert rules.order(rules.RULES, []) == list(rules.RULES)


def test_cheap_rejections_come_first_and_end_the_cascade():
    asked = []
    cheap = rules.Rule("cheap", lambda m: asked.append("cheap") or True)
    dear = rules.Rule("dear", lambda m: asked.append("dear") or sum(range(200_000)) < 0)
    assert [r.name for r in rules.order([dear, cheap], [rules.tried([dear, cheap], "t")] * 5)] == ["cheap", "dear"]
    asked.clear()
    assert not rules.keeps([cheap, dear], rules.Measures("t")) and asked == ["cheap"]


def test_shared_measures_cost_the_first_rule_only():
    """By itself c is dearer than b; once a has paid for the measure that both use, it is cheaper, and rejects what a lets pass."""
    three = [rules.Rule(n, lambda m: False, needs) for n, needs in (("a", ("words",)), ("b", ()), ("c", ("words",)))]
    cost = {"words": 10.0, "a": 1.0, "b": 5.0, "c": 1.0}
    sample = [(cost, (True, False, False))] * 50 + [(cost, (False, True, True))] * 10 + [(cost, (True, True, True))] * 5
    assert [r.name for r in rules.order(three, sample)] == ["a", "c", "b"]
    assert [r.name for r in rules.order(three[1:], sample)] == ["b", "c"]


def test_long_texts_are_judged_and_sampled(spark):
    texts = ["x y " * 60_000, " ".join(f"w{i}" for i in range(40_000)), "few", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r[:7]) for r in rules.screened(docs).collect())
    assert got == [(i, *measures(t)) for i, t in enumerate(texts)]


def test_clean_documents_stay(spark):
    data = "/root/testdata/sf0.1"
    found = rules.screened(table(spark, data, "documents")).join(table(spark, data, "labels"), "doc_id").toPandas()
    good = found[(found.quality == 1) & ~found.base_failed]
    assert good.kept.mean() > 0.999
    assert found[found.quality == 0].kept.mean() < 0.05
