"""Conversations in reply order, with quotations linked to their originals and taken out.

Lines that begin with ">" are quoted, as many times as there are marks. A run of lines of one level is a
passage. Passages are normalised (lower case, white space and line breaks as one space) and hashed as a whole; so are
each message's own text, its paragraphs and its lines. A passage's original is the latest earlier message of the
conversation that holds it in one of these forms, however it was wrapped; if none does, its lines are looked up one
by one, and the message that holds most of them is its original. A message replies to the original of most
of its least-quoted passages. Threads follow each other by their first messages; within a thread messages
follow by turn, so that a reply comes after what it replies to. Only DataFrame functions are used.

Nothing gathers a conversation in one task, nor all that says or quotes one line: originals are found along a range
partitioning of all passages and lines, with the latest original of the parts before; threads by pointer jumping, and
positions from a range partitioning of all messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, durable, written

#: How a message is written.
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>"
MARKS = r"^[ \t]*((?:>[ \t]*)*)"
ATTRIBUTION = r"(?i)\bwrote:[ \t]*$"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def _spaced(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _normal(line: Column) -> Column:
    return _spaced(F.regexp_replace(line, MARKS, ""))


def _hash(normal: Column) -> Column:
    return F.md5(normal.cast("binary"))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def unquoted(text: Column) -> Column:
    """The text without quoted lines, lines that announce them, and line feeds at either end."""
    lines = F.transform(_split(text), lambda x: F.struct(x.alias("line"), (_level(x) > 0).alias("quoted")))
    own = F.filter(
        lines,
        lambda x, i: ~x["quoted"] & ~(x["line"].rlike(ATTRIBUTION) & F.coalesce(F.try_element_at(lines, i + 2)["quoted"], F.lit(False))),
    )
    return F.btrim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit("\n"))


def _units(text: Column) -> Column:
    """The forms in which a message's own text may be quoted, normalised: whole, by paragraphs and by lines."""
    lines = F.transform(_split(text), lambda x: F.when(_level(x) > 0, F.lit("")).otherwise(x))
    paragraphs = F.split(F.array_join(lines, "\n"), r"\n\s*\n")
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(unquoted(text)), paragraphs, lines), _spaced), lambda x: x != ""))


def quotations(messages: DataFrame) -> DataFrame:
    """messages (__conv, __turn, __row, __text) -> (__conv, __row, __run, __level, __source): each passage that has an original, and that one's (__turn, __row)."""
    named = messages.where("__conv is not null").dropDuplicates(["__conv", "__row"])
    quoting = named.where(F.col("__text").rlike(r"(?m)^[ \t]*>"))
    each = quoting.select("__conv", "__turn", "__row", F.posexplode(_split(F.col("__text"))).alias("__pos", "__line"))
    each = each.select("__conv", "__turn", "__row", "__pos", _level(F.col("__line")).alias("__level"), _normal(F.col("__line")).alias("__normal"))
    along = Window.partitionBy("__conv", "__row").orderBy("__pos")  # the lines of one message
    begins = (F.col("__level") != F.coalesce(F.lag("__level").over(along), F.lit(-1))).cast("int")
    each = each.withColumn("__begins", begins).withColumn("__run", F.sum("__begins").over(along)).where("__level > 0 and __normal <> ''")
    of = ["__conv", "__turn", "__row", "__run", "__level"]
    # a passage's own lines; as a whole, if it has several
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__normal"))), lambda x: x["__normal"]), " ")
    whole = each.groupBy(*of).agg(joined.alias("__all")).select(*of, F.lit(0).alias("__kind"), _hash(F.col("__all")).alias("__hash"))
    quoted = durable(whole.union(each.select(*of, F.lit(1), _hash(F.col("__normal")))))
    units = named.select("__conv", "__turn", "__row", F.explode(_units(F.col("__text"))).alias("__unit")).select("__conv", "__turn", "__row", _hash(F.col("__unit")).alias("__hash"))
    own = units.join(quoted.select("__conv", "__hash").distinct(), ["__conv", "__hash"], "left_semi")
    both = quoted.withColumn("__own", F.lit(0)).unionByName(own.withColumn("__own", F.lit(1)), allowMissingColumns=True)
    # in the order of turns, quotations before the originals of their own turn: the latest original seen is an earlier one
    order = ["__turn", "__own", "__row"]
    placed = durable(both.repartitionByRange("__conv", "__hash", *order).withColumn("__part", F.spark_partition_id()))
    original = F.when(F.col("__own") == 1, F.struct("__turn", "__row"))
    of_part = ["__conv", "__hash", "__part"]
    inside = F.last(original, True).over(Window.partitionBy(*of_part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = placed.groupBy(*of_part).agg(F.max(original).alias("__end"))
    parts = Window.partitionBy("__conv", "__hash").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", F.last("__end", True).over(parts)).where("__carried is not null").select(*of_part, "__carried")
    met = placed.withColumn("__inside", inside).where("__own = 0").join(carried, of_part, "left").withColumn("__source", F.coalesce("__inside", "__carried")).where("__source is not null")
    votes = met.groupBy("__conv", "__row", "__run", "__level", "__kind", "__source").agg(F.count("*").alias("__votes"))
    best = votes.groupBy("__conv", "__row", "__run", "__level").agg(F.max(F.struct((-F.col("__kind")).alias("whole"), "__votes", "__source")).alias("b"))
    return best.select("__conv", "__row", "__run", "__level", F.col("b.__source").alias("__source"))


def _links(messages: DataFrame) -> DataFrame:
    """messages (__conv, __turn, __row, __text) -> (__conv, __row, __to, __to_turn, __quoted): what each quoting message replies to, and the turns of all originals."""
    found = durable(quotations(messages))
    votes = found.groupBy("__conv", "__row", "__level", "__source").agg(F.count("*").alias("__votes"))
    best = votes.groupBy("__conv", "__row").agg(
        F.max(F.struct((-F.col("__level")).alias("level"), "__votes", "__source")).alias("b"), F.array_sort(F.collect_set("__source.__turn")).alias("__turns")
    )
    turns = F.array_join(F.transform("__turns", lambda x: x.cast("string")), ",")
    return best.select("__conv", "__row", F.col("b.__source.__row").alias("__to"), F.col("b.__source.__turn").alias("__to_turn"), turns.alias("__quoted"))


def _roots(links: DataFrame) -> DataFrame:
    """(__conv, __row, __root, __root_turn, __depth) of every message that replies to another."""
    spark = links.sparkSession
    now, path = written(links.select("__conv", "__row", F.col("__to").alias("__root"), F.col("__to_turn").alias("__root_turn"), F.lit(1).alias("__depth")))
    while True:
        beyond = now.select("__conv", F.col("__row").alias("__root"), F.col("__root").alias("__next"), F.col("__root_turn").alias("__next_turn"), F.col("__depth").alias("__more"))
        joined = now.join(beyond, ["__conv", "__root"], "left")
        if joined.where("__next is not null").isEmpty():
            return now
        old = path
        now, path = written(
            joined.select(
                "__conv",
                "__row",
                F.coalesce("__next", "__root").alias("__root"),
                F.when(F.col("__next").isNull(), F.col("__root_turn")).otherwise(F.col("__next_turn")).alias("__root_turn"),
                (F.col("__depth") + F.coalesce("__more", F.lit(0))).alias("__depth"),
            )
        )
        dropped(spark, old)


def _said(template: str, role: Column, text: Column) -> Column:
    head, rest = template.split("{role}")
    middle, tail = rest.split("{text}")
    return F.concat(F.lit(head), F.coalesce(role, F.lit("unknown")), F.lit(middle), text, F.lit(tail))


def threaded(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """conv_id, position, turn, role, parent_turn, thread_turn, depth, quoted_turns, text, formatted for every row of messages.

    position counts from 1 within a conversation, in reply order; parent_turn is NULL and depth 0 where a
    message replies to none; thread_turn is the turn of the thread's first message; quoted_turns has the turns of
    all passages' originals, with commas, and is empty without any; text is without quotes, formatted is the message
    by the template (a NULL role as "unknown"): one after the other they are the conversation. A quotation of what no earlier message of the conversation holds links to nothing. A NULL text counts as
    empty. Rows without a conversation are not linked, and are positioned together. A NULL turn comes first.
    Equal rows have equal links and adjacent positions.
    """
    at = {n: F.col(f"`{c}`") for n, c in (("conv", conv_col), ("turn", turn_col), ("role", role_col), ("text", text_col))}
    rows = messages.select(
        at["conv"].alias("__conv"), at["turn"].alias("__turn"), at["role"].cast("string").alias("__role"), F.coalesce(at["text"], F.lit("")).alias("__text"), F.xxhash64(*at.values()).alias("__row")
    )
    links = durable(_links(rows))
    roots = links.join(_roots(links), ["__conv", "__row"])
    linked = rows.join(roots, ["__conv", "__row"], "left").select(
        "__conv", "__turn", "__role", "__row", unquoted(F.col("__text")).alias("__text"), F.col("__to_turn").alias("__parent"),
        F.coalesce("__root", "__row").alias("__root"), F.when(F.col("__root").isNull(), F.col("__turn")).otherwise(F.col("__root_turn")).alias("__thread"), F.coalesce("__depth", F.lit(0)).alias("__depth"),
        F.coalesce("__quoted", F.lit("")).alias("__quoted"),
    )
    order = ["__conv", "__thread", "__root", "__turn", "__row"]
    ranged = linked.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    runs = placed.groupBy("__conv", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("__conv").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(F.col("__conv").alias("__c"), F.col("__part").alias("__p"), "__first", "__before")
    met = placed.join(runs, F.col("__conv").eqNullSafe(F.col("__c")) & (F.col("__part") == F.col("__p")))
    return met.select(
        F.col("__conv").alias("conv_id"),
        (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("position"),
        F.col("__turn").alias("turn"),
        F.col("__role").alias("role"),
        F.col("__parent").alias("parent_turn"),
        F.col("__thread").alias("thread_turn"),
        F.col("__depth").alias("depth"),
        F.col("__quoted").alias("quoted_turns"),
        F.col("__text").alias("text"),
        _said(template, F.col("__role"), F.col("__text")).alias("formatted"),
    )


def conversations(messages: DataFrame, segment: int, **options: str) -> DataFrame:
    """conv_id, segment, n_messages, text: conversations written by the template, in reply order, without quotes.

    A segment holds `segment` messages, the last one fewer; longer conversations have several, from 0, so that no
    task gathers an unbounded one. A message that is only quotes stays, as an empty one. Options and edge cases as in
    threaded().
    """
    rows = threaded(messages, **options).select("conv_id", F.floor((F.col("position") - 1) / segment).alias("segment"), "position", "formatted")
    grouped = rows.groupBy("conv_id", "segment").agg(F.count("*").alias("n_messages"), F.sort_array(F.collect_list(F.struct("position", "formatted"))).alias("all"))
    return grouped.select("conv_id", "segment", "n_messages", F.array_join(F.transform("all", lambda x: x["formatted"]), "\n").alias("text"))


#: DuckDB SQL for threaded() over conversations, in which no two rows have the same conversation and turn.
ORACLE = r"""
WITH RECURSIVE m AS MATERIALIZED (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS MATERIALIZED (
  SELECT conv_id, turn, i, line, len(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)*)', 1), '[^>]', '', 'g')) AS level,
         lower(trim(regexp_replace(regexp_replace(line, '^[ \t]*((?:>[ \t]*)*)', ''), '\s+', ' ', 'g'))) AS n
  FROM (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM m)),
u AS MATERIALIZED (
  SELECT conv_id, turn, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (says AND coalesce(next, 0) > 0)), ''), chr(10)) AS text
  FROM (SELECT *, regexp_matches(line, '(?i)\bwrote:[ \t]*$') AS says, lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i) AS next FROM l)
  GROUP BY ALL),
r AS MATERIALIZED (
  SELECT *, sum(b) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER w OR (level = 0 AND (n = '') IS DISTINCT FROM (lag(n) OVER w = '')) THEN 1 ELSE 0 END AS b
        FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i))),
o AS MATERIALIZED (
  SELECT DISTINCT conv_id, turn, n FROM (
    SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM u
    UNION ALL SELECT conv_id, turn, string_agg(n, ' ' ORDER BY i) FROM r WHERE level = 0 AND n <> '' GROUP BY conv_id, turn, run
    UNION ALL SELECT conv_id, turn, n FROM l WHERE level = 0) WHERE n <> ''),
q AS MATERIALIZED (
  SELECT conv_id, turn, run, level, 0 AS kind, i, n FROM (SELECT conv_id, turn, run, level, 0 AS i, string_agg(n, ' ' ORDER BY i) AS n FROM r WHERE level > 0 AND n <> '' GROUP BY ALL)
  UNION ALL SELECT conv_id, turn, run, level, 1, i, n FROM r WHERE level > 0 AND n <> ''),
s AS MATERIALIZED (
  SELECT q.conv_id, q.turn, q.run, q.level, q.kind, q.i, max(o.turn) AS src FROM q JOIN o ON o.conv_id = q.conv_id AND o.n = q.n AND o.turn < q.turn GROUP BY ALL),
g AS MATERIALIZED (
  SELECT conv_id, turn, level, src FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn, run ORDER BY kind, v DESC, src DESC) AS r
    FROM (SELECT conv_id, turn, run, level, kind, src, count(*) AS v FROM s GROUP BY ALL)) WHERE r = 1),
k AS (SELECT conv_id, turn, string_agg(src, ',' ORDER BY src) AS quoted FROM (SELECT DISTINCT conv_id, turn, src FROM g) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT conv_id, turn, src AS parent FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, v DESC, src DESC) AS r
    FROM (SELECT conv_id, turn, level, src, count(*) AS v FROM g GROUP BY ALL)) WHERE r = 1),
t AS (
  SELECT m.conv_id, m.turn, p.parent, m.turn AS thread, 0 AS depth FROM m LEFT JOIN p USING (conv_id, turn) WHERE p.parent IS NULL
  UNION ALL
  SELECT p.conv_id, p.turn, p.parent, t.thread, t.depth + 1 FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.parent)
SELECT m.conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY t.thread, m.turn) AS position, m.turn, m.role,
       t.parent AS parent_turn, t.thread AS thread_turn, t.depth, coalesce(k.quoted, '') AS quoted_turns, u.text,
       '<|im_start|>' || coalesce(m.role, 'unknown') || chr(10) || u.text || '<|im_end|>' AS formatted
FROM m JOIN t USING (conv_id, turn) JOIN u USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn)"""
