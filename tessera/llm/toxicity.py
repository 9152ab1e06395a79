"""Toxicity by weak supervision.

Voters look at a text. Lexicon voters know one word, or a beginning of words that a text holds once, twice or
three times; pattern voters look at the text itself: shouting, exclamation marks, stretched and masked
spellings, address in the second person beside a term of the lexicon, how many and how densely terms occur, and
whether there are none. The lexicon comes from labelled training documents. A generative label model, fitted by
expectation maximisation without labels, estimates each voter's accuracy in either class and the correlations
of all pairs of voters within the classes; voters that repeat each other share their weight. Its posterior
labels train a linear classifier on the terms, their number and density, and the measures of the patterns,
which scores texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple
from sys import intern
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, released
from .sampling import CHARS, held_out, labelled

#: Labelled documents that are fitted on, at most.
MOST = 8000
#: Beginnings of words that are terms, and how many words of a text have to begin so.
BEGINNINGS, TIMES = (4, 5, 6, 7), (1, 2, 3)
#: A term's part of toxic documents among those that hold it, at least.
PRECISION = 0.9
#: A term is in so many toxic documents that chance would put all of them there this rarely, and in this part of them.
CHANCE, RARE = 1e-6, 0.005
#: Odd multipliers that make a digest into several.
SALTS = (1, 2654435761, 2246822519, 3266489917)
#: How far estimated correlations are drawn towards none: the part taken of the identity.
SHRUNK = 0.1
#: Entries of a worker's memo of words before it is emptied.
MEMO = 200_000
#: Words of the second person, and letters that signs stand for in masked spellings.
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
UNMASK = str.maketrans("0134578@$!", "oieastbasi")

Term = tuple[str, int]
_words = re.compile(r"[^\W\d_]+").findall
_signs_inside = re.compile(r"(?<=[^\W\d_])[0-9@$!]+(?=[^\W\d_])").finditer
_of_masked = re.compile(r"[^\W\d_]|[0-9@$!]").match
_shouted = re.compile(r"\b[A-Z]{3,}\b").findall
_stretched = re.compile(r"([^\W\d_])\1{2,}").search


class Seen(NamedTuple):
    """What of a text the voters look at: distinct words, masked ones as they read among them, these alone, and measures of the patterns."""

    words: Sequence[str]
    masked: Sequence[str]
    shouted: float
    exclaimed: float
    stretched: float
    address: float


def words(text: str | None) -> set[str]:
    return set(_words((text or "").lower()))


def masked_words(text: str) -> set[str]:
    """Words with digits or signs between their letters, read as letters. Each character is looked at a few times only."""
    found, end = set(), 0
    for inside in _signs_inside(text):
        if inside.start() >= end:
            begin, end = inside.span()
            while begin and _of_masked(text[begin - 1]):
                begin -= 1
            while end < len(text) and _of_masked(text[end]):
                end += 1
            found.add(text[begin:end].strip("0123456789@$!").lower().translate(UNMASK))
    return found


def seen(text: str | None) -> Seen:
    text = text or ""
    masked = masked_words(text)
    found = sorted(words(text) | masked)
    n = len(found) or 1
    return Seen(found, sorted(masked), min(1.0, len(set(_shouted(text))) / n), min(1.0, text.count("!") / n), float(_stretched(" ".join(found)) is not None), min(1.0, len(SECOND.intersection(found)) / 2))


def stems_of(word: str) -> Iterable[str]:
    """The word itself, marked by a space at its end, and its beginnings."""
    yield word + " "
    for n in BEGINNINGS:
        if len(word) >= n:
            yield word[:n]


def terms_of(found: Iterable[str], known: Callable[[str], Iterable[str]]) -> set[Term]:
    """Stems that known() picks of each word, with each number of times up to how many words have them."""
    counts = Counter(s for w in found for s in known(w))
    return {(s, k) for s, n in counts.items() for k in TIMES if k <= n}


def signatures(found: Iterable[str]) -> tuple[int, ...]:
    """Smallest salted digests of the long words: near copies mostly share them, other documents do not."""
    long = [w for w in found if len(w) >= 7] or list(found)
    if not long:
        return (0,) * len(SALTS)
    digests = np.fromiter((crc32(w.encode()) for w in long), np.uint64, len(long))
    return tuple(int((digests * np.uint64(s) & np.uint64(0xFFFFFFFF)).min()) for s in SALTS)


def _spread(docs: Iterable[Seen], stems: set[str]) -> Counter[Term]:
    """In how many documents each term of the stems is, near copies counted about once."""
    held: dict[Term, list[set[int]]] = {}
    for doc in docs:
        own = terms_of(doc.words, lambda w: (s for s in stems_of(w) if s in stems))
        if own:
            digests = signatures(doc.words)
            for t in own:
                for digest, met in zip(digests, held.setdefault(t, [set() for _ in SALTS])):
                    met.add(digest)
    return Counter({t: min(map(len, sets)) for t, sets in held.items()})


def _often(docs: Sequence[Seen], least: int) -> Counter[str]:
    """Stems in `least` documents or more: beginnings of growing length, then words, of those that begin so often."""
    found: Counter[str] = Counter()
    for length in (*BEGINNINGS, None):
        counts: Counter[str] = Counter()
        for doc in docs:
            own = set()
            for w in doc.words:
                before = [n for n in BEGINNINGS if n <= len(w) and (length is None or n < length)]
                if (length is None or len(w) >= length) and (not before or w[: before[-1]] in found):
                    own.add(w + " " if length is None else w[:length])
            counts.update(own)
        found.update({t: n for t, n in counts.items() if n >= least})
    return found


def lexicon(docs: Sequence[Seen], toxic: np.ndarray, most_terms: int | None = None) -> list[Term]:
    """Terms that mark toxic documents, those of most documents first; all, or the first most_terms."""
    base = float(np.clip(toxic.mean(), 1e-3, 0.5))
    least = int(np.ceil(max(np.log(CHANCE) / np.log(base), RARE * toxic.sum())))
    bad, good = [d for d, y in zip(docs, toxic) if y], [d for d, y in zip(docs, toxic) if not y]
    stems = set(_often(bad, least))
    inside, outside = _spread(bad, stems), _spread(good, stems)
    precision = {t: n / (n + outside[t]) for t, n in inside.items() if n >= least}
    kept: dict[Term, int] = {}
    for t in sorted((t for t, p in precision.items() if p >= PRECISION), key=lambda t: (t[1], len(t[0]), t)):
        stem, times = t
        shorter = [stem[:n] for n in BEGINNINGS if n < len(stem)] + [stem]
        if not any((b, k) in kept and precision[b, k] >= precision[t] - 0.02 for b in shorter for k in TIMES if k <= times and (b, k) != t):
            kept[t] = inside[t]  # nothing simpler tells as much
    return sorted(kept, key=lambda t: (-kept[t], t))[:most_terms]


class Matcher:
    """Terms of the lexicon that a text holds; words without a stem of them, which are most, are memoised."""

    def __init__(self, terms: Sequence[Term]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.stems = {s for s, _ in terms}
        self.without: set[str] = set()

    def stems_in(self, word: str) -> tuple[str, ...]:
        own = tuple(s for s in stems_of(word) if s in self.stems)
        if not own:
            if len(self.without) >= MEMO:
                self.without.clear()
            self.without.add(word)
        return own

    def hits(self, found: Iterable[str]) -> tuple[list[int], int]:
        """The numbers of the terms, and how many of the words, which are distinct, have a stem of them."""
        counts: dict[str, int] = {}
        held = 0
        for w in set(found).difference(self.without):
            if own := self.stems_in(w):
                held += 1
                for s in own:
                    counts[s] = counts.get(s, 0) + 1
        number = self.number
        terms = [number[s, k] for s, n in counts.items() for k in TIMES if k <= n and (s, k) in number]
        return sorted(terms), held if terms else 0


def patterns(doc: Seen, n_terms: int, n_held: int, n_masked: int) -> list[int]:
    """Votes of the pattern voters: 1 toxic, -1 clean, 0 none."""
    return [
        -1 if n_terms == 0 and n_masked == 0 else 0,
        1 if n_terms >= 2 else 0,
        1 if n_held > 0.02 * len(doc.words) else 0,
        1 if n_masked else 0,
        1 if doc.address and n_held else 0,
        1 if doc.shouted > 0.3 else 0,
        1 if doc.exclaimed > 0.1 else 0,
        1 if doc.stretched else 0,
    ]


PATTERNS, MEASURES = 8, 9


def _weights(votes: np.ndarray, groups: Iterable[np.ndarray]) -> np.ndarray:
    """Weights w from 0 to 1 with R w = 1, R being the voters' correlations within the groups of rows (given as the rows' weights).

    A voter that correlates with none has weight 1, each of n voters that always agree 1 / n.
    """
    total = np.zeros((votes.shape[1], votes.shape[1]))
    for rows in groups:
        mass = rows.sum()
        if mass > 1:
            centred = votes - rows @ votes / mass
            total += (centred * rows[:, None]).T @ centred
    spread = np.sqrt(np.maximum(np.diag(total), 1e-9))
    correlation = np.abs(total / np.outer(spread, spread)) * (1 - SHRUNK)
    np.fill_diagonal(correlation, 1.0)
    return np.clip(np.linalg.solve(correlation + 1e-6 * np.eye(len(spread)), np.ones(len(spread))), 1 / len(spread), 1.0)


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of votes (1, -1, 0 none), the voters' accuracies and their weights.

    A voter that votes errs at a rate of its own for each class. Correlations of all pairs are estimated within the
    classes, as the posterior has them, and give the voters' weights. The start is the majority, with weights
    from the correlations over all rows.
    """
    yes, no = (votes > 0).astype(float), (votes < 0).astype(float)
    weight = _weights(votes, [np.ones(len(votes))])
    q = np.where(votes @ weight > 0, 0.9, 0.05)
    for step in range(rounds):
        rate = np.empty((2, 2, votes.shape[1]))  # class, vote
        for c, of in enumerate((1 - q, q)):
            total = of.sum()
            rate[c, 0], rate[c, 1] = (of @ no + 0.5 * prior) / (total + 1), (of @ yes + 0.5 * prior) / (total + 1)
        if step in (5, 15):
            weight = _weights(votes, [1 - q, q])
        odds = np.log(rate[1]) - np.log(rate[0])
        logit = np.log(prior / (1 - prior)) + yes @ (weight * odds[1]) + no @ (weight * odds[0])
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    accuracy = (yes.T @ q + no.T @ (1 - q)) / np.maximum(yes.sum(axis=0) + no.sum(axis=0), 1)
    return q, accuracy, weight


def _measures(doc: Seen, n_terms: int, n_held: int, n_masked: int) -> list[float]:
    """Features beside the terms: their number and density, the patterns' measures, and a constant."""
    return [
        min(n_held, 4) / 4, float(n_terms > 0), min(1.0, 20 * n_held / max(len(doc.words), 1)), float(n_masked > 0),
        doc.address * (n_held > 0), doc.shouted, doc.exclaimed, doc.stretched, 1.0,
    ]


class Model:
    """terms: the lexicon; weights: of its terms, then of the measures."""

    def __init__(self, terms: list[Term], weights: np.ndarray):
        self.terms, self.weights = terms, [float(w) for w in weights]
        self.matcher = Matcher(terms)

    def score(self, text: str | None) -> float:
        doc = seen(text)
        hits, held = self.matcher.hits(doc.words)
        masked = len(self.matcher.hits(doc.masked)[0]) if doc.masked else 0
        w = self.weights
        logit = sum(w[i] for i in hits) + sum(a * b for a, b in zip(w[len(self.terms) :], _measures(doc, len(hits), held, masked)))
        return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, logit)))))


def fit(docs: Sequence[Seen], toxic: np.ndarray, rounds: int = 300, decay: float = 1e-4, most_terms: int | None = None) -> Model:
    """A model from what is seen of documents, and labels. Without labels of both kinds, or terms that tell them
    apart, every score is the base rate."""
    terms = lexicon(docs, toxic, most_terms) if 0 < toxic.sum() < len(toxic) else []
    if not terms:  # nothing to vote on: every text has the base rate
        base = float(np.clip(toxic.mean() if len(toxic) else 0.0, 0.01, 0.99))
        return Model([], np.array([0.0] * (MEASURES - 1) + [np.log(base / (1 - base))]))
    matcher, size = Matcher(terms), len(terms)
    votes, rows = np.zeros((len(docs), size + PATTERNS), np.float32), np.zeros((len(docs), size + MEASURES), np.float32)
    for i, doc in enumerate(docs):
        hits, held = matcher.hits(doc.words)
        masked = len(matcher.hits(doc.masked)[0])
        votes[i, hits] = rows[i, hits] = 1
        votes[i, size:] = patterns(doc, len(hits), held, masked)
        rows[i, size:] = _measures(doc, len(hits), held, masked)
    q, _, _ = label_model(votes, float(toxic.mean()))
    w, m, v = np.zeros(size + MEASURES), np.zeros(size + MEASURES), np.zeros(size + MEASURES)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(rows @ w.astype(np.float32), -30, 30)))
        gradient = rows.T @ (q - p).astype(np.float32) / len(q) - decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(terms, w)


def trained(
    docs: DataFrame, labels: DataFrame, most: int = MOST, most_chars: int = CHARS, parts: int = 5, part: int = 0, id_col: str = "doc_id", text_col: str = "text", most_terms: int | None = None
) -> Model:
    """A model from labelled documents whose id's CRC-32 modulo parts is not part: at most `most`, with at most
    most_chars characters in all. The driver gets what the voters see of them; equal ones count once. most_terms
    bounds the lexicon, which is whole without it.
    """
    sample = labelled(docs, labels, "toxic", parts, part, most, most_chars, id_col, text_col)

    def make():
        def work(texts):
            found = [seen(t) for t in texts]
            return [[" ".join(d.words) for d in found], [" ".join(d.masked) for d in found], [list(d[2:]) for d in found]]

        return work

    rows = map_texts(sample, "__text", ["__label"], "words string, masked string, signs array<double>", make).collect()
    rows = sorted({(r.words, r.masked, tuple(r.signs), r["__label"]) for r in rows})
    toxic, docs_seen = np.array([y for *_, y in rows], int), []
    for n, (found, masked, signs, _) in enumerate(rows):
        docs_seen.append(Seen(tuple(map(intern, found.split())), masked.split(), *signs))  # one object for each word
        rows[n] = None
    model = fit(docs_seen, toxic, most_terms=most_terms)
    del docs_seen, rows
    released()  # the driver lives on
    return model


def scored(docs: DataFrame, labels: DataFrame, most: int = MOST, most_chars: int = CHARS, parts: int = 5, part: int = 0, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row of docs.

    Labels (id, toxic) teach only where the id's CRC-32 modulo parts is not part; held_out marks that part.
    predicted is 1 from the threshold on. Only the text enters a score. NULL counts as an empty text, which
    holds no terms. Rows with equal or NULL ids each keep their own row; a NULL id is not held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, most, most_chars, parts, part, id_col, text_col))

    def make():
        score = model.value.score
        return lambda texts: [[score(t) for t in texts]]

    found = map_texts(docs, text_col, [id_col], "__score double", make)
    return found.select(
        F.col(f"`{id_col}`"), held_out(f"`{id_col}`", parts, part).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted")
    )
