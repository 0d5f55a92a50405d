"""Line dedup with a log-template tree, in DataFrame functions only.

Every line of every document is parsed by a tree of fixed depth: the number of tokens, then the first `DEPTH` tokens,
where a token with a digit counts as a variable field. What is left of the line is cut into at most
`SEGMENTS` runs of tokens, single tokens in lines of up to `DEPTH + SEGMENTS` of them. A leaf that `MIN_DOCS` documents or
more reach gets templates, one a round: the run that most documents have at one place is the pivot, the commonest runs of all
places among the lines with the pivot are the template, and all lines that agree with it in `AGREEMENT` of the places belong to
it, so a differing field of any kind is generalised. Lines of a template go on to no other; lines with the pivot of a template
that too few share do not either. Rounds go on until no leaf has a pivot, so a leaf gets all its templates; each
round takes lines of `MIN_DOCS` documents or more from every leaf it works on. With `whole`, as in the pipeline, what the rounds leave is looked at again,
with all pivots at once, until no pivot of lines without a template has a template that `MIN_DOCS` different documents contain.

A template is recurring if `MIN_DOCS` documents contain it. All other lines are compared as they are, with their variable fields masked unless they have no other, and are recurring from `EXACT_DOCS` documents on. The first line
(smallest id, then smallest line number) of what recurs stays, all its other lines are dropped.

A document is an id and a text: repeated rows count as one document and have one result. Blank lines are never
dropped. Null texts stay null and have no lines; other columns are passed on. Rounds work on the different lines of busy leaves, not on
their copies. Only short hashes are shuffled; the texts move once, to meet the numbers of their dropped lines. Joins that would
change with the size of the table are of one kind at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import stored
from fareloom.session import scratch_path

EXACT_DOCS = 2
MIN_DOCS = 10
DEPTH = 3
SEGMENTS = 16
AGREEMENT = 0.75

# A token with a digit; the look-behind and the possessive run keep the matcher from trying a token twice.
VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def parsed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per line that is not blank: document, line number, leaf, masked line and the runs after the leading tokens, all as hashes."""
    text = F.col(f"`{text_col}`")
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("copy"), F.posexplode(F.split(text, "\n", -1)).alias("line", "body"))
    body = F.col("body")
    lines = lines.where(F.ltrim(body, F.lit(" \t\n\x0b\f\r")) != "")
    even = F.regexp_replace(body, r"\s+", " ")
    masked = F.regexp_replace(even, VARIABLE, "<*>")
    # A line of variable fields only, such as a row of numbers, is no template.
    masked = F.when(F.trim(F.replace(masked, F.lit("<*>"), F.lit(""))) != "", masked).otherwise(even)
    # The matcher only sees the few lines with something to replace.
    odd = body.rlike(r"[0-9\t\x0b\f\r]") | F.contains(body, F.lit("  "))
    lines = lines.select("id", "copy", "line", F.trim(F.when(odd, masked).otherwise(body)).alias("masked"))
    # The tokens are an array of one inside one expression, so that they are cut once and stay in the memory of the task.
    parsed = F.transform(F.array(F.split("masked", " ")), _leaf_and_segments)[0]
    lines = lines.select("id", "copy", "line", F.xxhash64("masked").alias("own"), parsed.alias("parsed"))
    return lines.select("id", "copy", "line", "parsed.leaf", "own", "parsed.segments")


def _leaf_and_segments(tokens: Column) -> Column:
    rest = F.size(tokens) - DEPTH
    count = F.least(F.lit(SEGMENTS), rest)
    bound = lambda n: F.call_function("div", n * rest, count).cast("int")
    # Tokens are taken one by one: a slice would look at all of them for every run.
    places = lambda n: F.sequence(DEPTH + bound(n), DEPTH - 1 + bound(n + 1))
    segment = lambda n: F.hash(F.transform(places(n), lambda place: F.get(tokens, place)))
    segments = F.when(rest > 0, F.transform(F.sequence(F.lit(0), count - 1), segment)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.xxhash64(F.size(tokens), F.slice(tokens, 1, DEPTH)).alias("leaf"), segments.alias("segments"))


def _documents(lines: DataFrame, *key: str) -> DataFrame:
    """How many documents have each key."""
    return lines.groupBy(*key, "id", "copy").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("*").alias("docs"))


def _commonest(units: DataFrame) -> DataFrame:
    """(leaf, place, value, docs, first) of all runs of some lines."""
    spots = units.select("leaf", "docs", "first", F.posexplode("segments").alias("place", "value"))
    return spots.groupBy("leaf", "place", "value").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))


def _templates(units: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, place, value, template): each leaf's pivot, if enough documents have it, and the template around it."""
    rank = F.struct((-F.col("docs")).alias("docs"), "first", "place", "value")
    pivots = _commonest(units).where(F.col("docs") >= min_docs).groupBy("leaf").agg(F.min(rank).alias("pivot"))
    pivots = stored(pivots.select("leaf", "pivot.place", "pivot.value"), "pivots", tidy=False)
    holders = units.join(pivots, "leaf").where(F.get("segments", F.col("place")) == F.col("value")).select(units.columns)
    best = _commonest(holders).groupBy("leaf", "place").agg(F.min(F.struct((-F.col("docs")).alias("docs"), "first", "value")).alias("best"))
    whole = best.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "best.value"))), lambda s: s["value"]).alias("template"))
    return pivots.join(whole, "leaf")


def _round(units: DataFrame, min_docs: int) -> DataFrame:
    """The lines of leaves that have a pivot, with `ok` (the template has enough documents), `belongs` and `holds` (the pivot)."""
    met = units.join(_templates(units, min_docs), "leaf")
    agreeing = F.size(F.filter(F.zip_with("segments", "template", lambda a, b: a == b), lambda same: same))
    belongs, holds = agreeing >= AGREEMENT * F.size("segments"), F.get("segments", F.col("place")) == F.col("value")
    marked = stored(met.select(*units.columns, belongs.alias("belongs"), holds.alias("holds")), "template-lines", tidy=False)
    enough = marked.where("belongs").groupBy("leaf").agg((F.sum("docs") >= min_docs).alias("ok"))
    # Stored again, as every round reads what the one before it has left.
    return stored(marked.join(enough, "leaf", "left").withColumn("ok", F.coalesce("ok", F.lit(False))), "template-round", tidy=False)


def _best_template(rest: DataFrame, lines: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, own) of the lines of one template for each leaf that has any, whatever the pivot: the one that most documents contain.

    All runs of `min_docs` documents are pivots at once. `min_docs` documents whose lines agree in `AGREEMENT` of the places have, over all places,
    that share of `min_docs` agreeing documents a place at least, no place counting more than `min_docs`; templates, and leaves, that
    cannot reach it are left out before lines are compared.
    """
    enough = F.sum(F.least("docs", F.lit(min_docs))) >= AGREEMENT * min_docs * F.count("*")
    votes = stored(_commonest(rest), "run-votes", tidy=False)
    able = votes.groupBy("leaf", "place").agg(F.max("docs").alias("docs")).groupBy("leaf").agg(enough.alias("able")).where("able").select("leaf")
    able = stored(able, "able-leaves", tidy=False)
    rest = stored(rest.join(able, "leaf"), "able-lines", tidy=False)
    votes = votes.join(able, "leaf").select("leaf", "place", "value", "docs")
    pivots = votes.where(F.col("docs") >= min_docs).select("leaf", F.col("place").alias("spot"), F.col("value").alias("main"))
    spots = rest.select("leaf", "docs", "first", "segments", F.posexplode("segments").alias("spot", "main"))
    holders = spots.join(pivots, ["leaf", "spot", "main"]).select("leaf", "spot", "main", "docs", "first", F.posexplode("segments").alias("place", "value"))
    common = holders.groupBy("leaf", "spot", "main", "place", "value").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))
    best = common.groupBy("leaf", "spot", "main", "place").agg(F.min(F.struct((-F.col("docs")).alias("docs"), "first", "value"))["value"].alias("value"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("template")
    templates = best.join(votes, ["leaf", "place", "value"]).groupBy("leaf", "spot", "main").agg(enough.alias("able"), whole)
    templates = stored(templates.where("able").select("leaf", "template").distinct(), "able-templates", tidy=False)
    agreeing = F.size(F.filter(F.zip_with("segments", "template", lambda a, b: a == b), lambda same: same))
    members = rest.join(templates, "leaf").where(agreeing >= AGREEMENT * F.size("segments")).select("leaf", "template", "own")
    members = stored(members, "template-members", tidy=False)
    held = _documents(members.join(lines.select("own", "id", "copy"), "own"), "leaf", "template").where(F.col("docs") >= min_docs)
    chosen = held.groupBy("leaf").agg(F.min(F.struct((-F.col("docs")).alias("docs"), "template"))["template"].alias("template"))
    return members.join(chosen, ["leaf", "template"]).select("leaf", "own")


def _left_over(lines: DataFrame, busy: DataFrame, found: DataFrame, min_docs: int) -> DataFrame:
    """`found` with the templates of enough documents only, and further ones until the lines that belong to none have no such template left."""
    marked = lines.select("id", "copy", "own").join(found, "own")
    found = found.join(_documents(marked, "template").where(F.col("docs") >= min_docs).select("template"), "template").select("own", "template")
    found, turn = stored(found, "whole-templates", tidy=False), 0
    rest = busy.join(found, "own", "left_anti")
    while True:
        more = stored(_best_template(rest, lines, min_docs), "further-lines", tidy=False)
        if more.isEmpty():
            return found
        # Numbers below 0 are not those of a round before.
        turn -= 1
        found = stored(found.unionByName(more.select("own", F.xxhash64("leaf", F.lit(turn)).alias("template"))), "whole-templates", tidy=False)
        rest = stored(rest.join(more.select("leaf").distinct(), "leaf", "left_semi").join(more.select("own"), "own", "left_anti"), "left-lines", tidy=False)


def generalised(lines: DataFrame, units: DataFrame, min_docs: int, whole: bool = False) -> DataFrame:
    """(own, template) of the different lines that belong to a template, from the lines and (leaf, own, docs) of the different ones."""
    busy = units.groupBy("leaf").agg(F.sum("docs").alias("all_docs")).where(F.col("all_docs") >= min_docs).select("leaf")
    here = F.struct("id", "copy", "line")
    rest = lines.join(stored(busy, "busy-leaves", tidy=False).hint("merge"), "leaf").where(F.size("segments") > 0).groupBy("leaf", "own").agg(F.min(here).alias("first"), F.first("segments").alias("segments"))
    rest = every = stored(rest.join(units, ["leaf", "own"]), "busy-lines", tidy=False)
    # Rounds add to one folder, which is read once however many there are.
    spark, path, turn = lines.sparkSession, scratch_path(lines.sparkSession, "generalised"), 0
    found = spark.createDataFrame([], "own long, template long")
    found.write.parquet(path)
    while not rest.isEmpty():
        marked = _round(rest, min_docs)
        marked.where("ok AND belongs").select("own", F.xxhash64("leaf", F.lit(turn)).alias("template")).write.mode("append").parquet(path)
        rest = marked.where("NOT (ok AND belongs) AND (ok OR NOT holds)").select(rest.columns)
        turn += 1
    found = spark.read.schema(found.schema).parquet(path)
    return _left_over(lines, every, found, min_docs) if whole else found


def recurring_lines(lines: DataFrame, min_docs: int = MIN_DOCS, exact_docs: int = EXACT_DOCS, whole: bool = False) -> DataFrame:
    """(id, copy, line) of the lines to drop."""
    units = stored(_documents(lines, "leaf", "own"), "different-lines")
    found = generalised(lines, units, min_docs, whole)
    wanted = units.where(F.col("docs") >= exact_docs).select("own", "docs").join(found, "own", "full")
    marked = stored(lines.select("id", "copy", "line", "own").join(stored(wanted, "recurring", tidy=False).hint("merge"), "own"), "recurring-lines")
    enough = _documents(marked.where("template IS NOT NULL"), "template").where(F.col("docs") >= min_docs).select("template", F.lit(True).alias("ok"))
    keyed = marked.join(stored(enough, "recurring-templates", tidy=False), "template", "left")
    keyed = keyed.where("ok OR docs IS NOT NULL").withColumn("key", F.when(F.col("ok"), F.col("template")).otherwise(F.col("own")))
    keyed = stored(keyed.select("id", "copy", "line", F.coalesce("ok", F.lit(False)).alias("ok"), "key"), "keyed-lines")
    here = F.struct("id", "copy", "line")
    first = stored(keyed.groupBy("ok", "key").agg(F.min(here).alias("first")), "first-lines", tidy=False)
    return keyed.join(first, ["ok", "key"]).where(~here.eqNullSafe(F.col("first"))).select("id", "copy", "line")


def _cut(docs: DataFrame, id_col: str, text_col: str, min_docs: int, exact_docs: int, again: bool = False) -> DataFrame:
    """(whole, kept, n_lines, n_dropped): the rows as they are, and their texts without the lines to drop."""
    lines = stored(parsed_lines(docs, id_col, text_col), "lines")
    dropped = recurring_lines(lines, min_docs, exact_docs, again).groupBy("id", "copy").agg(F.collect_set("line").alias("gone"))
    text = F.col(f"whole.`{text_col}`")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col(f"`{id_col}`").alias("own_id"), F.xxhash64(f"`{text_col}`").alias("own_copy"))
    met = whole.join(stored(dropped, "gone").hint("merge"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_copy") == F.col("copy")), "left")
    parts = F.split(text, "\n", -1)
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone"), lambda n: F.get(parts, n)), "\n")
    kept = F.when(F.col("gone").isNull(), text).otherwise(left)
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    return met.select("whole", kept.alias("kept"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, exact_docs: int = EXACT_DOCS, whole: bool = False
) -> DataFrame:
    """All columns of the documents, as they are, with the lines dropped from the text; `whole` looks for templates among set-aside lines too."""
    found = _cut(docs, id_col, text_col, min_docs, exact_docs, whole)
    return found.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"whole.`{c}`").alias(c) for c in docs.columns))


def count_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, exact_docs: int = EXACT_DOCS) -> DataFrame:
    """One row per document: id, n_lines, n_dropped and the text without the dropped lines."""
    found = _cut(docs, id_col, text_col, min_docs, exact_docs)
    return found.select(F.col(f"whole.`{id_col}`").alias(id_col), "n_lines", "n_dropped", F.col("kept").alias(text_col))


# The same rows in SQL for an independent engine, with the values above.
SQL = rf"""
WITH RECURSIVE evened AS (
  SELECT DISTINCT doc_id, text, line, regexp_replace(string_split(text, chr(10))[line + 1], '\s+', ' ', 'g') AS even
  FROM (SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents)),
masks AS (SELECT *, regexp_replace(even, '(^| )[^ 0-9]*[0-9][^ ]*', '\1<*>', 'g') AS masked FROM evened),
lines AS (SELECT doc_id, text, line, trim(CASE WHEN trim(replace(masked, '<*>', '')) <> '' THEN masked ELSE even END) AS own FROM masks),
cut AS (SELECT *, string_split(own, ' ') AS w FROM lines WHERE own <> ''),
parsed AS (SELECT *, concat_ws(' ', CAST(len(w) AS VARCHAR), array_to_string(w[1:{DEPTH}], ' ')) AS leaf, len(w) - {DEPTH} AS rest, least({SEGMENTS}, len(w) - {DEPTH}) AS n FROM cut),
units AS (
  SELECT leaf, own, rest, n, w, count(DISTINCT ROW(doc_id, text)) AS docs, min(ROW(doc_id IS NOT NULL, doc_id, text, line)) AS first
  FROM parsed GROUP BY ALL),
busy AS (SELECT leaf FROM units GROUP BY leaf HAVING sum(docs) >= {MIN_DOCS}),
rounds AS (
  SELECT 0 AS turn, leaf, own, docs, first[2] AS f_id, first[3] AS f_text, first[4] AS f_line,
         [array_to_string(w[{DEPTH + 1} + (i * rest) // n : {DEPTH} + ((i + 1) * rest) // n], ' ') for i in range(0, n)] AS t, false AS done
  FROM units WHERE n > 0 AND leaf IN (FROM busy)
  UNION ALL
  (WITH spots AS (SELECT turn, leaf, docs, f_id, f_text, f_line, own, t, unnest(range(1, len(t) + 1)) AS place FROM rounds WHERE NOT done),
  votes AS (
    SELECT leaf, place, t[place] AS value, sum(docs) AS votes, min(ROW(f_id IS NOT NULL, f_id, f_text, f_line)) AS first FROM spots GROUP BY ALL),
  pivots AS (
    SELECT leaf, place AS spot, value AS main FROM votes WHERE votes >= {MIN_DOCS}
    QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY votes DESC, first, place) = 1),
  holders AS (SELECT s.* FROM spots s JOIN pivots USING (leaf) WHERE t[spot] = main),
  best AS (
    SELECT leaf, place, t[place] AS value FROM holders GROUP BY leaf, place, t[place]
    QUALIFY row_number() OVER (PARTITION BY leaf, place ORDER BY sum(docs) DESC, min(ROW(f_id IS NOT NULL, f_id, f_text, f_line))) = 1),
  whole AS (SELECT leaf, list(value ORDER BY place) AS template FROM best GROUP BY leaf),
  met AS (
    SELECT r.*, t[spot] = main AS holds, len([i for i in range(1, len(t) + 1) if t[i] = template[i]]) >= {AGREEMENT} * len(t) AS belongs
    FROM rounds r JOIN pivots USING (leaf) JOIN whole USING (leaf) WHERE NOT done),
  sizes AS (SELECT leaf, sum(CASE WHEN belongs THEN docs ELSE 0 END) >= {MIN_DOCS} AS ok FROM met GROUP BY leaf)
  SELECT turn + 1, leaf, own, docs, f_id, f_text, f_line, t, ok AND belongs FROM met JOIN sizes USING (leaf) WHERE ok OR NOT holds)),
grouped AS (SELECT own, leaf || ' ' || turn AS template FROM rounds WHERE done),
marked AS (SELECT p.doc_id, p.text, p.line, p.own, template FROM parsed p LEFT JOIN grouped USING (own)),
enough AS (
  SELECT template, true AS ok FROM (SELECT DISTINCT template, doc_id, text FROM marked WHERE template IS NOT NULL) GROUP BY template HAVING count(*) >= {MIN_DOCS}),
keyed AS (SELECT m.doc_id, m.text, m.line, CASE WHEN ok THEN 'template ' || m.template ELSE 'line ' || m.own END AS key, coalesce(ok, false) AS ok, docs
          FROM marked m LEFT JOIN enough e ON m.template = e.template JOIN units u ON m.own = u.own),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, text, line) AS r FROM keyed WHERE ok OR docs >= {EXACT_DOCS}),
gone AS (SELECT doc_id, text, list(line) AS gone FROM numbered WHERE r > 1 GROUP BY doc_id, text)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(
         [string_split(d.text, chr(10))[i + 1] for i in range(0, len(string_split(d.text, chr(10)))) if NOT list_contains(gone, i)], chr(10)) END AS text
FROM documents d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text
"""
