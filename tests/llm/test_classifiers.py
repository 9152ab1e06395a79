import re
import tracemalloc
import zlib
from itertools import product

import numpy as np
import pytest

from tessera.llm import quality, sampling, toxicity
from tessera.llm.common import table


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of two kinds, and their labels."""
    rng = np.random.default_rng(5)
    parts = ["ri", "sto", "gre", "hou", "wal", "un", "li", "se", "mo", "ta", "ne", "po"]
    words = ["".join(rng.choice(parts, 2 + n % 3)) for n in range(1500)]
    docs, labels = [], []
    for i in range(600):
        bad, toxic = i % 5 == 0, i % 4 == 0
        lines = [" ".join(rng.choice(words, 12)).capitalize() + "." for _ in range(1 + i % 6)]
        if bad:
            lines += [" ".join(f"{w}$$$" for w in rng.choice(words, 12)) for _ in range(8)]
        if toxic:
            lines[0] += f" you {rng.choice(['nitwit', 'dunce', 'grumblat', 'grumblor'])}"
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def in_part(i, parts, part):
    return i is not None and zlib.crc32(str(i).encode()) % parts == part


@pytest.mark.parametrize("module, label, parts, part, cut", [(quality, "quality", 4, 2, 0.7), (toxicity, "toxic", 5, 0, 0.5)])
def test_held_out_accuracy_and_contract(labelled, odd, none, rows, module, label, parts, part, cut):
    docs, labels = labelled
    truth = {r.doc_id: r[label] for r in labels.collect()}
    found = module.scored(docs, labels).collect()
    assert all(r.held_out == in_part(r.doc_id, parts, part) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held) > 0
    other = module.scored(odd, labels)  # no labelled document at hand: nothing to learn from
    assert other.columns == ["doc_id", "held_out", "score", "predicted"]
    assert sorted(str(r.doc_id) for r in other.collect()) == sorted(str(i) for i, *_ in rows)
    assert module.scored(none, labels).count() == 0
    assert module.scored(docs, labels.where("false")).count() == 600


@pytest.mark.parametrize("module, label, parts, part", [(quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)])
def test_held_out_labels_teach_nothing(spark, labelled, module, label, parts, part):
    docs, labels = labelled
    turned = labels.selectExpr("doc_id", *[f"case when pmod(crc32(cast(cast(doc_id as string) as binary)), {parts}) = {part} then 1 - {c} else {c} end as {c}" for c in ("quality", "toxic")])
    assert sorted(module.scored(docs, labels).collect()) == sorted(module.scored(docs, turned).collect())


def test_labels_with_nulls_and_contradictions(spark, labelled):
    docs, labels = labelled
    more = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 0, 1), (4, 1, 0)], labels.schema)).union(labels.where("doc_id = 9"))
    without = labels.where("doc_id <> 4")
    for module in (quality, toxicity):
        assert sorted(module.scored(docs, more).collect()) == sorted(module.scored(docs, without).collect())


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    first, logits, ties = np.array([0, 3, 4]), rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs, log_z = quality.Chains(first, 8).marginals(logits, ties)
    want, total, moves = np.zeros(8), 0.0, np.zeros((2, 2))
    for a, b in ((0, 3), (3, 4), (4, 8)):
        weights, n = {}, b - a
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            weights[tuple(y)] = np.exp(sum(logits[a + k] * y[k] for k in range(n)) + sum(ties[y[k], y[k + 1]] for k in range(n - 1)))
        z = sum(weights.values())
        total += np.log(z)
        for y, w in weights.items():
            for k in range(n):
                want[a + k] += w / z * y[k]
                if k:
                    moves[y[k - 1], y[k]] += w / z
    assert np.allclose(good, want) and np.allclose(pairs, moves) and np.isclose(log_z, total)


def plain_measures(line):
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", line) if w]
    n = max(len(words), 1)
    shares = [sum(line.count(bytes([c])) for c in chars) / max(len(line), 1) for chars in quality.CLASSES]
    same, again = (sum(a == b for a, b in zip(words, words[k:])) / n for k in (1, 2))
    return [*shares, same, again, min(sum(map(len, words)) / n, 50) / 10, np.log1p(len(words)) / 5, not words, sum(len(w) <= 1 for w in words) / n]


@pytest.mark.parametrize("block", [5, 64, 1 << 20])
def test_line_measures_equal_plain_ones(monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    texts = [b"Ab ab ab | 12!\n\nx", b"", b"no no no no yes", b"long" * 40 + b" b b\t\tlonglong " + b"long" * 40, b"\n\n", b"  a b a b a \r\nend ", "é ü | é".encode()]
    lines = quality.Lines(texts)
    assert lines.first.tolist() == np.cumsum([0] + [t.count(b"\n") + 1 for t in texts[:-1]]).tolist()
    want = np.array([plain_measures(line) for t in texts for line in t.split(b"\n")], float)
    got = np.concatenate([m for _, m in lines.parts()])
    assert np.allclose(got, want)
    weights = np.random.default_rng(0).normal(size=3 * quality.WIDTH + 1)
    assert np.allclose(lines.logits(weights), lines.evidence() @ weights, atol=1e-4)
    assert quality.Lines([]).first.tolist() == []


def test_scores_equal_plain_ones(labelled):
    """Evidence, marginals by enumeration, length-weighted share and curve of short texts, written out."""
    model = quality.trained(*labelled)
    logistic = lambda x: 1 / (1 + np.exp(-x))
    for text in (b"", b"one line here", b"a\n$$ $$ $$\nc d", b"$$$ $$$ $$$\n$$$ $$$\n\nplain words follow"):
        measures = [np.array(plain_measures(line), float) for line in text.split(b"\n")]
        none, n = np.zeros(quality.WIDTH), len(measures)
        logits = [np.concatenate((m, measures[i - 1] if i else none, measures[i + 1] if i + 1 < n else none, [1])) @ model.weights for i, m in enumerate(measures)]
        good, total = np.zeros(n), 0.0
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(logits[i] for i in range(n) if y[i]) + sum(model.ties[a, b] for a, b in zip(y, y[1:])))
            good, total = good + w * np.array(y), total + w
        length = np.array([len(line) + 1 for line in text.split(b"\n")])
        share = (good / total * length).sum() / length.sum()
        assert np.isclose(model.scores([text])[0], logistic(model.curve[0] * (share - model.curve[1])), atol=1e-5)


def test_very_long_texts_and_lines(labelled):
    """A line of 9 MB, a word of 5 MB and 100,000 lines: memory beside the text stays bounded, and stretches change nothing."""
    model = quality.trained(*labelled)
    texts = [b"some words that go on and on " * 300_000, b"x" * 5_000_000 + b" y", b"word by word\n" * 100_000]
    tracemalloc.start()
    scores = [model.scores([t])[0] for t in texts]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert all(0 <= s <= 1 for s in scores)
    assert np.isclose(scores[0], model.scores([texts[0][: len(texts[0]) // 300]])[0], atol=0.2)


def test_training_samples_are_bounded_by_characters(spark):
    docs = spark.createDataFrame([(i, "x" * (5 if i % 2 else 1000)) for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as quality")
    sample = lambda most, chars: [len(r[0]) for r in sampling.labelled(docs, labels, "quality", 4, 2, most, chars).collect()]
    every = sample(100, 10**6)
    assert 20 < len(every) < 40 and sum(sample(100, 3100)) <= 3100 and sample(100, 3100).count(1000) == 3 and len(sample(7, 10**6)) == 7


def test_scores_do_not_depend_on_blocks(monkeypatch, labelled):
    docs, labels = labelled
    model = quality.trained(docs, labels)
    texts = [r.text.encode() for r in docs.limit(50).collect()] + [b"", b"a\n" * 5000]
    whole = model.scores(texts)
    monkeypatch.setattr(quality, "BLOCK", 300)
    assert np.allclose(whole, model.scores(texts))


def test_rejected_documents_go(labelled, spark):
    docs, labels = labelled
    wide = docs.selectExpr("'a' as score", "doc_id", "text", "1 as predicted")
    kept = quality.kept(wide, labels)
    assert kept.columns == wide.columns
    want = {r.doc_id for r in quality.scored(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.3
    right = [0.9, 0.85, 0.8, 0.55]
    votes = np.stack([np.where(rng.random(3000) < r, truth, ~truth) * 2.0 - 1 for r in right], axis=1)
    votes = np.concatenate((votes, votes[:, 3:], votes[:, 3:]), axis=1)  # the worst voter three times
    q, accuracy, weight = toxicity.label_model(votes, 0.3)
    assert ((q > 0.5) == truth).mean() > 0.88
    assert accuracy[0] > accuracy[3] and weight[3] < 0.4 < weight[0]


def test_label_model_equals_a_plain_one():
    """Expectation maximisation written out voter by voter, with the correlations of all pairs within the classes."""
    rng = np.random.default_rng(3)
    votes = rng.choice([-1.0, 0.0, 1.0], (40, 5))
    votes[:, 4] = votes[:, 3]
    prior, rows = 0.3, votes.tolist()

    def weights(groups):
        cov = [[0.0] * 5 for _ in range(5)]
        for g in groups:
            mean = [sum(w * r[v] for w, r in zip(g, rows)) / sum(g) for v in range(5)]
            for w, r in zip(g, rows):
                for a, b in product(range(5), repeat=2):
                    cov[a][b] += w * (r[a] - mean[a]) * (r[b] - mean[b])
        r = [[1.0 if a == b else abs(cov[a][b]) / (cov[a][a] * cov[b][b]) ** 0.5 * (1 - toxicity.SHRUNK) for b in range(5)] for a in range(5)]
        return np.clip(np.linalg.solve(np.array(r) + 1e-6 * np.eye(5), np.ones(5)), 0.2, 1)

    w = weights([[1.0] * 40])
    q = [0.9 if sum(a * b for a, b in zip(w, r)) > 0 else 0.05 for r in rows]
    for step in range(30):
        rate = {}
        for c, v, said in product((0, 1), range(5), (-1, 1)):
            mass = [x if c else 1 - x for x in q]
            rate[c, v, said] = (sum(m for m, r in zip(mass, rows) if r[v] == said) + 0.5 * prior) / (sum(mass) + 1)
        if step in (5, 15):
            w = weights([[1 - x for x in q], q])
        logits = [np.log(prior / (1 - prior)) + sum(w[v] * np.log(rate[1, v, r[v]] / rate[0, v, r[v]]) for v in range(5) if r[v]) for r in rows]
        q = [1 / (1 + np.exp(-x)) for x in logits]
    got, _, weight = toxicity.label_model(votes, prior)
    assert np.allclose(got, q, atol=1e-6) and np.allclose(weight, w, atol=1e-6) and weight[3] < 0.6


def test_terms_and_scores_equal_plain_ones(labelled):
    docs, labels = labelled
    model = toxicity.trained(docs, labels)
    texts = [r.text for r in docs.collect()] + ["", "N1TWIT n1twit you", "DUNCE!!! grumbla grumblax looooser"]

    def score(text):
        found = set(re.findall(r"[^\W\d_]+", text.lower()))
        masked = {m.lower().translate(toxicity.UNMASK) for m in re.findall(r"[^\W\d_]+(?:[0-9@$!]+[^\W\d_]+)+", text)}
        found |= masked
        begins = lambda w, s: w == s.strip() if s.endswith(" ") else w.startswith(s)
        hits = [i for i, (s, k) in enumerate(model.terms) if sum(begins(w, s) for w in found) >= k]
        held = len({w for w in found for s, _ in model.terms if begins(w, s)}) if hits else 0
        hidden = any(sum(begins(w, s) for w in masked) >= k for s, k in model.terms)
        n, you = max(len(found), 1), min(1, len(found & toxicity.SECOND) / 2)
        more = [min(held, 4) / 4, bool(hits), min(1, 20 * held / n), hidden, you * (held > 0), min(1, len(set(re.findall(r"\b[A-Z]{3,}\b", text))) / n), min(1, text.count("!") / n), any(re.search(r"([^\W\d_])\1\1", w) for w in found), 1]
        return 1 / (1 + np.exp(-sum(model.weights[i] for i in hits) - sum(a * b for a, b in zip(model.weights[len(model.terms) :], more))))

    assert np.allclose([model.score(t) for t in texts], [score(t) for t in texts])
    assert model.score(None) == model.score("") and {"nitw", "dunc", "grum"} <= {s for s, _ in model.terms}
    assert model.score("a n1twit") > model.score("a")


def test_terms_of_several_words():
    """A beginning that clean documents hold once and toxic ones several times is a term from two words on."""
    rng = np.random.default_rng(4)
    docs, toxic = [], []
    for i in range(400):
        own = {f"w{rng.integers(10**6)}x" for _ in range(20)} | {f"bomb{'abcdefgh'[k]}{i % 26}" for k in range((3 if i % 4 == 0 else int(rng.random() < 0.3)))}
        docs.append(toxicity.seen(" ".join(sorted(own))))
        toxic.append(int(i % 4 == 0))
    assert ("bomb", 2) in toxicity.lexicon(docs, np.array(toxic)) and ("bomb", 1) not in toxicity.lexicon(docs, np.array(toxic))
    assert len(toxicity.lexicon(docs, np.array(toxic), 1)) == 1


def test_held_out_documents_of_the_tables(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    found = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = ((found.predicted == 1) & (found.toxic == 1)).sum()
    assert hit / found.toxic.sum() >= 0.9 and hit / found.predicted.sum() >= 0.95
    found = quality.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    bad = ((found.predicted == 0) & (found.quality == 0)).sum()
    assert (found.predicted == found.quality).mean() > 0.99 and bad / (found.quality == 0).sum() >= 0.97
    print(bad / (found.quality == 0).sum(), bad / (found.predicted == 0).sum(), (found.predicted == found.quality).mean())
