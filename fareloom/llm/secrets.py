"""Secret scans: fixed patterns, and character Markov models for what the patterns miss.

DataFrame functions only. Matches of a pattern and the pieces between them give code point offsets by adding up
lengths. Two first-order character models are counted over labelled samples: random strings (values that the fixed
patterns found) and ordinary identifiers (other long tokens of letters and joiners only). A token that no pattern covers is a `markov` span if
its mean log-likelihood ratio per character is above `THRESHOLD` nats. The samples are bounded: `SAMPLE` distinct
strings of each label, those with the smallest hash; all rows are scanned and scored.

Defined results: null and empty texts have no spans; equal rows get equal results; other columns are not looked at;
without labelled strings both models are uniform and no token is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import keyed, stored

# The patterns and their least lengths, in the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more: runs are taken whole either way
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 characters or more, likewise
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "markov")

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
STATES = len(ALPHABET) + 1  # 0 stands before the first character
SAMPLE = 20_000
THRESHOLD = 1.0
PRIOR = 20.0
SPANS = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-overlapping matches as (start, end, value): code points, end exclusive, value of the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["size"]
        here = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(here)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(parts, begin, step)["out"]).otherwise(F.array().cast(SPANS))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the spans of each fixed kind, and the long tokens that none of them touches."""
    text = F.coalesce("text", F.lit(""))
    found = keyed(df, id_col, text_col).select(
        "id",
        F.filter(matches(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= LEAST_ASSIGNED).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS)).otherwise(F.array().cast(SPANS)).alias("access"),
        matches(text, HEX).alias("hex"),
        matches(text, TOKEN).alias("tokens"),
    )
    base = F.concat("assign", "access", "hex")
    free = F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.withColumn("tokens", free)


def _sample(values: DataFrame, most: int) -> DataFrame:
    return values.where(F.length("value") > 1).distinct().orderBy(F.xxhash64("value"), "value").limit(most)


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(value: Column) -> Column:
    """The model's cell of each step from a character to the next."""
    codes = _codes(value)
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, 1, F.size(codes) - 1)), codes, lambda a, b: a * STATES + b)


def train(scanned: DataFrame, most: int = SAMPLE) -> list[float]:
    """The log ratio of the two models for each step, STATES x STATES values.

    Each state's frequencies are drawn towards the character's overall frequency by `PRIOR` counts.
    """
    named = lambda column: scanned.select(F.explode(column).alias("s")).select("s.value")
    labelled = _sample(named(F.concat("assign", "access", "hex")), most).select("value", F.lit(1).alias("label"))
    labelled = labelled.unionByName(_sample(named("tokens").where(F.col("value").rlike("^[A-Za-z_-]+$")), most).select("value", F.lit(0).alias("label")))
    counted = labelled.select("label", F.explode(_steps(F.col("value"))).alias("step")).groupBy("label", "step").count().collect()
    counts = [[0] * (STATES * STATES) for _ in range(2)]
    for row in counted:
        counts[row.label][row.step] += row["count"]
    common = [[sum(kind[c::STATES]) + 1 for c in range(STATES)] for kind in counts]
    shares = [[n / sum(row) for n in row] for row in common]
    table = []
    for state in range(STATES):
        rows = [kind[state * STATES : (state + 1) * STATES] for kind in counts]
        logs = [[math.log((n + PRIOR * share[c]) / (sum(row) + PRIOR)) for c, n in enumerate(row)] for row, share in zip(rows, shares, strict=True)]
        table += [a - b for a, b in zip(logs[1], logs[0], strict=True)]
    return table


def ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio per character: above 0, more like random strings than like identifiers."""
    cells = F.split(F.lit(" ".join(f"{x:.6f}" for x in table)), " ").cast("array<double>")
    return F.aggregate(_steps(value), F.lit(0.0), lambda s, i: s + F.get(cells, i)) / F.length(value)


def _listed(columns: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""
    def ordered(kind: str) -> Column:
        number = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), number, s["end"].alias("end")))

    each = map(ordered, columns)
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, counts of the fixed kinds, digest of their spans, all spans as text, and the added spans."""
    scanned = stored(scan(df, id_col, text_col), "secrets")
    table = train(scanned)
    added = F.filter("tokens", lambda t: ratio(t["value"], table) > threshold)
    return scanned.withColumn("markov", added).select(
        F.col("id").alias(id_col),
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"),
        _listed(KINDS).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )
