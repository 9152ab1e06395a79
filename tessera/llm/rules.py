"""Quality rules as a short-circuit cascade.

Each rule rejects some documents and costs some time. Both are estimated on a sample of documents; then the
rules are put in order one after the other: next comes the rule of most rejections per cost among the documents
that the rules before it let pass, and a document leaves the cascade at the first rule that rejects it. Measures
of a document are computed when a rule first asks for them and are shared by later rules, so they cost the first
rule only. The order changes the time only: a document is kept if no rule rejects it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from functools import cached_property
from time import perf_counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Characters that count as symbols, and the window of repeated words.
SYMBOLS, WINDOW = "#*$%&|<>", 8
SPACE = " \t\n\r\x0b\x0c"
#: Documents that the cost and the selectivity of the rules are estimated on, at most.
SAMPLE = 512


class Measures:
    """Measures of one text, each computed when it is first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes: the six ASCII separators only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if line.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of WINDOW words found twice or more."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        joined = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, self.n_words) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        windows = [joined[a:b] for a, b in zip(starts, ends[WINDOW - 1 :].tolist())]
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        found = np.fromiter((counts[w] > 1 for w in windows), bool, n)
        change = np.zeros(self.n_words + 1, np.int64)
        change[:n] += found
        change[WINDOW : WINDOW + n] -= found
        return int((np.cumsum(change)[:-1] > 0).sum())

    @cached_property
    def n_adjacent(self) -> int:
        """Words equal to the word before."""
        return sum(a == b for a, b in zip(self.words, self.words[1:]))

    @cached_property
    def n_capital(self) -> int:
        """Words of two bytes or more with letters of A-Z and none of a-z."""
        return sum(w.isupper() and len(w) > 1 for w in self.words)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Measures], bool]
    #: Measures that it asks for, each after those that it is made from.
    needs: tuple[str, ...] = ()


RULES = (
    Rule("few_words", lambda m: m.n_words < 20, ("words", "n_words")),
    Rule("repeated_windows", lambda m: 100 * m.n_repeat_words > 30 * m.n_words, ("words", "n_words", "n_repeat_words")),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words, ("words", "n_words", "n_symbols")),
    Rule("repeated_lines", lambda m: 2 * m.n_dup_lines > len(m.lines), ("lines", "n_dup_lines")),
    Rule("adjacent_repeats", lambda m: 5 * m.n_adjacent > m.n_words, ("words", "n_words", "n_adjacent")),
    Rule("capitals", lambda m: 2 * m.n_capital > m.n_words, ("words", "n_words", "n_capital")),
    Rule("short_words", lambda m: 2 * m.word_chars < 3 * m.n_words, ("words", "n_words", "word_chars")),
    Rule("long_words", lambda m: m.word_chars > 200 * m.n_words, ("words", "n_words", "word_chars")),
)

#: Seconds of each measure and rule on one text, and which rules reject it.
Tried = tuple[dict[str, float], Sequence[bool]]


def tried(rules: Sequence[Rule], text: str) -> Tried:
    measures, seconds, rejected = Measures(text), {}, []
    for rule in rules:
        for need in rule.needs:
            if need not in seconds:
                began = perf_counter()
                getattr(measures, need)
                seconds[need] = perf_counter() - began
        began = perf_counter()
        rejected.append(bool(rule.rejects(measures)))
        seconds[rule.name] = perf_counter() - began
    return seconds, rejected


def order(rules: Sequence[Rule], sample: Sequence[Tried]) -> list[Rule]:
    """The rules, next always the one of most rejections per second among the texts left; as they stand without texts."""
    left, known, rest, found = list(sample), set(), list(range(len(rules))), []
    while rest:

        def rate(i: int) -> float:
            needs = [rules[i].name, *(n for n in rules[i].needs if n not in known)]
            return sum(rejected[i] for _, rejected in left) / max(sum(seconds[n] for seconds, _ in left for n in needs), 1e-9)

        best = max(rest, key=rate)
        rest.remove(best)
        found.append(rules[best])
        known.update(rules[best].needs)
        left = [t for t in left if not t[1][best]]
    return found


def keeps(rules: Sequence[Rule], measures: Measures) -> bool:
    return not any(rule.rejects(measures) for rule in rules)


def screened(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row of docs.

    sample bounds the documents that the order of the rules is estimated on, those of the smallest hashes of
    their texts, of any length; they are tried on an executor, and only times and verdicts reach the driver.
    Every document is judged. NULL counts as an empty text, which has no words and fails. Rows with equal or NULL
    ids each keep their own row. Other columns of docs are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    costs = list(dict.fromkeys(c for r in rules for c in (*r.needs, r.name)))
    hashes = docs.select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(sample)
    last = hashes.agg(F.max("h")).first()[0]
    few = docs.select(text.alias("__body"), F.xxhash64(text).alias("h")).where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).select("__body")

    def trying():
        def work(texts):
            found = [tried(rules, t) for t in texts]
            return [[[seconds[c] for c in costs] for seconds, _ in found], [list(rejected) for _, rejected in found]]

        return work

    seen = [] if last is None else map_texts(few, "__body", [], "__seconds array<double>, __rejected array<boolean>", trying).collect()
    ordered = order(rules, [(dict(zip(costs, r["__seconds"])), r["__rejected"]) for r in seen])

    def make():
        def work(texts):
            found = [Measures(t or "") for t in texts]
            kept = [keeps(ordered, m) for m in found]
            columns = [[getattr(m, c) for m in found] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
            return [*columns, [k and not b for k, b in zip(kept, columns[-1])]]

        return work

    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_texts(docs, text_col, [id_col], added, make)


#: DuckDB SQL for screened() over documents with the rules above.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
p AS (
  SELECT doc_id, x, i, CASE WHEN i <= n - 7 THEN count(*) OVER (PARTITION BY doc_id, win) > 1 ELSE false END AS twice,
         lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n,
               unnest([CASE WHEN j <= len(w) - 7 THEN array_to_string(w[j:j + 7], ' ') END FOR j IN range(1, len(w) + 1)]) AS win FROM d)),
c AS (
  SELECT doc_id, sum(length(x)) AS word_chars, sum(CASE WHEN covered THEN 1 ELSE 0 END) AS n_repeat_words, sum(CASE WHEN x = before THEN 1 ELSE 0 END) AS n_adjacent,
         sum(CASE WHEN strlen(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') THEN 1 ELSE 0 END) AS n_capital
  FROM (SELECT *, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM p) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.word_chars, 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines, coalesce(c.n_adjacent, 0) AS n_adjacent, coalesce(c.n_capital, 0) AS n_capital
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 5 * n_adjacent > n_words
            OR 2 * n_capital > n_words OR 2 * word_chars < 3 * n_words OR word_chars > 200 * n_words) AS kept
FROM m"""
