"""Mixing of sources to target weights: iterative proportional fitting, then sampling of documents.

The tokens of the documents are summed in cells of source, language and topic. Each dimension's values have a
factor; in turn, the factors of one dimension are set so that its marginal meets the target while the other
factors stand, until no factor changes. A cell's weight is the product of its factors, and a document is kept
with a probability in proportion to it, the largest one that leaves no probability above 1: the expected
tokens of the sample meet every target marginal. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dropped, durable, written

DIMENSIONS = ("source", "lang", "topic")
#: Target shares where none are given are those of a table of tokens to this power in each cell; under 1 evens the cells out.
POWER = 0.95
#: Factors count as settled when none changes by a larger part; rounds in which the change has to halve; how far a marginal may miss its target.
SETTLED, PATIENCE, MISSED = 1e-10, 200, 1e-6
#: Rounds between two looks at the change; and cells that one task may hold while fitting.
AT_ONCE, CELLS = 5, 200_000
#: Characters of a long word, and the digits that clusters of long words go by.
LONG, DIGITS = 8, "0123456789abcdef"
UNKNOWN = "unknown"


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def digits_of(text: Column) -> Column:
    """The first digit of the MD5 of each distinct long word of the text: texts that share much of their vocabulary have similar ones."""
    long = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(" + WORD[:-1] + f"{{{LONG},}})"), F.lit(1))
    return F.array_join(F.transform(F.array_distinct(long), lambda w: F.substring(F.md5(w.cast("binary")), 1, 1)), "")


def cluster(digits: Column) -> Column:
    """The topic from the digits of the text's long words: the most frequent one, ties to the smaller; "none" without any."""
    counts = [16 * (F.length(digits) - F.length(F.replace(digits, F.lit(d), F.lit("")))) + 15 - i for i, d in enumerate(DIGITS)]
    return F.when(digits == "", "none").otherwise(F.concat(F.lit("topic-"), F.substring(F.lit(DIGITS[::-1]), (F.greatest(*counts) % 16 + 1).cast("int"), F.lit(1))))


def topic(text: Column) -> Column:
    """A topic for tables that have none. The digits are bound to a variable, so that they are made once."""
    return F.element_at(F.transform(F.array(digits_of(text)), cluster), 1)


def _label(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(UNKNOWN))


def _measured(docs: DataFrame, id_col: str, text_col: str, columns: Mapping[str, str | None], kept: Column | None) -> DataFrame:
    text = F.col(f"`{text_col}`")
    found = docs.select(
        F.col(f"`{id_col}`").alias("__id"), text.alias("__text"), tokens(text).alias("__tokens"), *[_label(F.col(f"`{c}`")).alias(f"__{d}") for d, c in columns.items() if c], *([kept] if kept is not None else [])
    )
    if columns.get("topic") is None:
        found = found.withColumn("__topic", topic(F.col("__text")))
    return found.drop("__text")


def _shares(cells: DataFrame, dimension: str, target: Mapping[str, float] | DataFrame | None, power: float) -> DataFrame:
    """(__<dimension>, __t_<dimension>): target tokens of the values that have tokens, as parts of 1."""
    key = f"__{dimension}"
    present = cells.where("__tokens > 0").groupBy(key).agg(F.sum(F.pow(F.col("__tokens").cast("double"), F.lit(power))).alias("share"))
    if isinstance(target, Mapping):
        target = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in target.items()], "value string, share double")
    if target is None:
        wanted = present
    else:
        given = target.select(F.col("value").cast("string").alias(key), F.col("share").cast("double"))
        wanted = present.select(key).join(given, key, "left").select(key, F.coalesce("share", F.lit(0.0)).alias("share"))
    total = wanted.agg(F.sum("share")).first()[0]
    return wanted.select(key, (F.col("share") / F.lit(total or 1.0)).alias(f"__t_{dimension}"))


def _refit(cells: DataFrame, dimension: str, total: int, together: bool) -> DataFrame:
    """cells with the dimension's factors set so that its marginal meets the target while the others stand."""
    key, factor = f"__{dimension}", f"__f_{dimension}"
    weight = F.col("__tokens").cast("double")
    for other in DIMENSIONS:
        if other != dimension:
            weight = weight * F.col(f"__f_{other}")
    if together:
        held = F.sum(weight).over(Window.partitionBy(key))
    else:
        cells = cells.join(cells.groupBy(key).agg(F.sum(weight).alias("__held")), key)
        held = F.col("__held")
    fresh = F.when(held > 0, F.coalesce(F.col(f"__t_{dimension}"), F.lit(0.0)) * F.lit(float(total)) / held).otherwise(1.0)
    change = F.greatest("__change", F.abs(F.coalesce(F.try_divide("__fresh", F.col(factor)), F.lit(1.0)) - 1))
    return cells.withColumn("__fresh", fresh).withColumn("__change", change).drop(factor, "__held").withColumnRenamed("__fresh", factor)


def fit(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | DataFrame] | None = None, power: float = POWER) -> DataFrame:
    """cells (__source, __lang, __topic, __tokens), as a stored table -> (__source, __lang, __topic, __tokens, __weight).

    targets: shares of tokens for the values of a dimension; values that are missing get none. A dimension
    without targets takes the marginal of the cells' tokens to the power, so that targets of this kind alone can
    always be met. Cells without tokens have the product of their values' factors for a weight, as others do. Up to
    CELLS cells are fitted in one task, several rounds at a time; more are summed where they lie and joined with the
    sums. Factors so far are a table in the shared folder. Rounds go on until no factor changes. Targets that
    contradict each other (where the cells between them have no tokens) do not settle, or leave a marginal that misses its
    target: they raise ValueError.
    """
    spark = cells.sparkSession
    total, number = cells.agg(F.sum("__tokens"), F.count("*")).first()
    together = number <= CELLS
    state = cells
    for d in DIMENSIONS:
        state = state.join(_shares(cells, d, (targets or {}).get(d), power), f"__{d}", "left").withColumn(f"__f_{d}", F.lit(1.0))
    state, path = written(state.withColumn("__change", F.lit(0.0)))
    best, since, change = float("inf"), 0, float("inf") if total else 0.0
    while change >= SETTLED:
        last = path
        for step in range(AT_ONCE):
            state = (state.coalesce(1) if together and not step else state).withColumn("__change", F.lit(0.0))
            for d in DIMENSIONS:
                state = _refit(state, d, total, together)
                if not together:
                    state, path = written(state)
                    dropped(spark, last)
                    last = path
        if together:
            state, path = written(state)
            dropped(spark, last)
        change = state.agg(F.max("__change")).first()[0]
        since += AT_ONCE
        if change <= best / 2:
            best, since = change, 0
        if since >= PATIENCE:
            raise ValueError(f"the targets contradict each other: a factor still changes by {change:.2g}")
    weight = F.col("__f_source") * F.col("__f_lang") * F.col("__f_topic")
    if total:
        for d in DIMENSIONS:
            held = state.groupBy(f"__{d}").agg(F.sum(F.col("__tokens") * weight).alias("held"), F.first(F.coalesce(f"__t_{d}", F.lit(0.0))).alias("wanted"))
            missed = held.agg(F.max(F.abs(F.col("held") / F.lit(float(total)) - F.col("wanted")))).first()[0]
            if missed > MISSED:
                raise ValueError(f"the targets contradict each other: a share of {d} is missed by {missed:.2g}")
    return state.select(*[f"__{d}" for d in DIMENSIONS], "__tokens", weight.alias("__weight"))


def _chance(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed only, from 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mixed(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float] | DataFrame] | None = None,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    keep: list[str] | None = None,
    power: float = POWER,
) -> DataFrame:
    """A row for each row of docs: id, source, lang, topic, n_tokens, weight, probability, kept.

    Tokens are words (runs of other characters than ASCII white space). weight is the product of the document's
    factors, probability the calibrated chance, kept the draw, which depends on the id and the seed only: rows
    with equal ids go together. A NULL source, language or topic is a value of its own, "unknown". NULL and
    empty texts have no tokens and are drawn like others of their cell. Without topic_col the topic is the
    cluster of most of the text's long words (cluster()). targets and power are those of fit(). keep: columns of docs to return instead of the measures, with kept alone added as
    __kept. Clashing names of other columns do not matter.
    """
    columns = {"source": source_col, "lang": lang_col, "topic": topic_col}
    held = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__doc") if keep else None
    keys = [f"__{d}" for d in DIMENSIONS]
    measured = _measured(docs, id_col, text_col, columns, held)
    if not keep:
        measured = durable(measured)  # short rows, without the texts
    cells = durable(measured.groupBy(*keys).agg(F.sum("__tokens").alias("__tokens")))
    weights = fit(cells, targets, power)
    most = weights.where("__tokens > 0").agg(F.max("__weight")).first()[0] or 1.0
    drawn = measured.join(weights.drop("__tokens"), keys, "left").withColumn("__p", F.least(F.lit(1.0), F.col("__weight") / F.lit(most)))
    kept = _chance(F.col("__id"), seed) < F.col("__p")
    if keep:
        return drawn.select(*[F.col(f"__doc.`{c}`").alias(c) for c in keep], kept.alias("__kept"))
    return drawn.select(
        F.col("__id").alias(id_col),
        F.col("__source").alias("source"),
        F.col("__lang").alias("lang"),
        F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"),
        F.round("__weight", 6).alias("weight"),
        F.round("__p", 6).alias("probability"),
        kept.alias("kept"),
    )


def oracle(seed: int = 42, rounds: int = 25) -> str:
    """DuckDB SQL for mixed() over documents without targets; the rounds of fitting are written out."""
    steps = []
    for d in DIMENSIONS:
        steps.append(
            f"sh_{d} AS MATERIALIZED (SELECT v, h / (sum(h) OVER ()) * (SELECT sum(n) FROM c) AS want FROM (SELECT {d} AS v, sum(pow(n::DOUBLE, {POWER})) AS h FROM c WHERE n > 0 GROUP BY 1))"
        )
        steps.append(f"{d}_0 AS MATERIALIZED (SELECT v, 1.0::DOUBLE AS f FROM sh_{d})")
    for r in range(1, rounds + 1):
        for i, d in enumerate(DIMENSIONS):
            others = [(o, f"{o}_{r if DIMENSIONS.index(o) < i else r - 1}") for o in DIMENSIONS if o != d]
            joins = " ".join(f"LEFT JOIN {t} ON {t}.v = c.{o}" for o, t in others)
            product = " * ".join(f"coalesce({t}.f, 1.0)" for _, t in others)
            steps.append(f"{d}_{r} AS MATERIALIZED (SELECT s.v, CASE WHEN h > 0 THEN want / h ELSE 1.0 END AS f FROM sh_{d} s JOIN (SELECT c.{d} AS v, sum(c.n::DOUBLE * {product}) AS h FROM c {joins} GROUP BY 1) USING (v))")
    last = " ".join(f"LEFT JOIN {d}_{rounds} ON {d}_{rounds}.v = x.{d}" for d in DIMENSIONS)
    weight = " * ".join(f"coalesce({d}_{rounds}.f, 1.0)" for d in DIMENSIONS)
    counts = ", ".join(f"16 * (length(h) - length(replace(h, '{x}', ''))) + {15 - i}" for i, x in enumerate(DIGITS))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n,
         coalesce(array_to_string([md5(w)[1] FOR w IN list_distinct(regexp_extract_all(coalesce(text, ''), '{WORD[:-1]}{{{LONG},}}'))], ''), '') AS h
  FROM documents),
t AS MATERIALIZED (
  SELECT doc_id, source, lang, n, CASE WHEN h = '' THEN 'none' ELSE 'topic-' || substr('{DIGITS[::-1]}', (greatest({counts}) % 16 + 1)::INT, 1) END AS topic
  FROM d),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n)::BIGINT AS n FROM t GROUP BY ALL),
{", ".join(steps)},
top AS (SELECT max({weight}) AS m FROM c x {last} WHERE x.n > 0),
w AS (SELECT x.*, {weight} AS w, least(1.0, {weight} / (SELECT m FROM top)) AS p FROM t x {last})
SELECT doc_id, source, lang, topic, n AS n_tokens, round(w, 6) AS weight, round(p, 6) AS probability,
       ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(16**13)} < p AS kept
FROM w"""
