"""Secret scans against the patterns of the contract, run by another engine."""

import hashlib
import random
import re
import string

from fareloom.llm import secrets

BASE = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def base(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), n, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def documents(draw):
    pick = lambda letters, n: "".join(draw.choices(letters, k=n))
    b64 = string.ascii_letters + string.digits
    rows = [None, "", "x", "password=short token", 'token: "secret=abcdefghijkl1"', 'password: "token" : "abcdefghijklmnop"', "AKIAAKIA" + "Z" * 12, "ÀÉ😀 api_key='" + "Q" * 12 + "' é", "a" * 50_000]
    keys = ["password", "Passwd", "SECRET", "token", "apikey", "api_Key", "tokens"]
    for _ in range(120):
        parts = []
        for _ in range(draw.randint(1, 12)):
            parts.append(draw.choice(["deadé ", "face off ", "AKIA" + pick("AKI0Z", draw.randint(10, 18)), pick("0123456789abcdef", draw.randint(10, 30)), draw.choice(keys) + draw.choice(["=", ": ", " :\"", "'  =  '"]) + pick(b64 + "+/_.=-", draw.randint(8, 24)), "internationalization_of_the_service", "\n"]))
            parts.append(draw.choice([" ", "", ";"]))
        rows.append("".join(parts))
    return rows


def test_base_spans(spark):
    texts = documents(random.Random(11))
    df = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, spans string")
    found = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert len(found) == len(texts)
    for n, text in enumerate(texts):
        wanted = base(text)
        row = found[n]
        assert row.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest(), text
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(w.startswith(k) for w in wanted) for k in ("assign", "access", "hex"))
        spans = row.spans.split(",") if row.spans else []
        assert [s for s in spans if not s.startswith("markov")] == wanted
        for span in spans:
            kind, a, b = span.split(":")
            assert 0 <= int(a) < int(b) <= len(text)


def test_models_tell_random_strings_from_identifiers(spark):
    draw = random.Random(2)
    b64 = string.ascii_letters + string.digits
    words = ["service", "internal", "connection", "manager", "request", "handler", "number", "configuration"]
    known = [f"password={''.join(draw.choices(b64, k=20))} {'_'.join(draw.choices(words, k=3))}" for _ in range(400)]
    tests = ["".join(draw.choices(b64, k=28)) for _ in range(30)], ["_".join(draw.choices(words, k=4)) for _ in range(30)]
    rows = [(n, t) for n, t in enumerate([*known, *tests[0], *tests[1]])]
    found = {r.doc_id: r.n_markov for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[n] for n in range(400, 430)) >= 28
    assert sum(found[n] for n in range(430, 460)) == 0


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.find_secrets(empty).count() == 0
    twice = spark.createDataFrame([(None, "token=abcdefghijkl")] * 2, "doc_id long, text string")
    assert [r.spans for r in secrets.find_secrets(twice).collect()] == ["assign:0:18"] * 2
