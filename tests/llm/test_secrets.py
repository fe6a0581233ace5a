import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from quillon.llm.secrets import OP1_SQL, PATTERNS, REACH, TESTS, op1_secret_scans, redact, scan
from tests.llm.conftest import ODD, prose

HEX = "0123456789abcdef0123456789abcdef01234567"
TEXTS = [
    f'token = "{HEX}" and more', "password: short", "PASSWORD='abcdefghijkl'", "token=a token=secret:abcdefghijklmnop api_key=ABCDEFGHIJKL", "AKIA" + "B" * 14, "AKIA" + "B" * 13, "xAKIAAKIA" + "C" * 16, "0123456789abcdef", "0123456789abcde",
    "user = alice password = pw1234", "user = alice", "password = pw1234 " + "x " * 150 + "user = alice", "host=db.example.org:5432 user=bob secret=abcdefghijklmnop", "https://api.example.org/v1 and nothing", "AKIA" + "D" * 16 + " Zm9vYmFyMTIzNDU2Nzg5MEFCQ0RFRkdISUo9 x", "Zm9vYmFyMTIzNDU2Nzg5MEFCQ0RFRkdISUo9",
    "é😀 token=abcdefghijklm é", "secret=abcdefghijklmnop" * 40, prose(1, 300) + f" token={HEX}", "", None,
]


def base(text):
    """Kind, start and end by the definition."""
    t = text or ""
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def linked(text):
    """The weak parts by comparing all pairs."""
    t = text or ""
    parts = [(s, k, e) for s, k, _, e in base(t)]
    strong = list(parts)
    for k, (kind, pattern, group, least) in enumerate(PATTERNS):
        if k < 3:
            continue
        for m in re.finditer(pattern, t):
            mixed = kind != "blob" or all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))
            if len(m[group]) >= least and mixed:
                parts.append((m.start(), k, m.end()))
    near = lambda p, kinds: any(q != p and q[1] in kinds and q[2] >= p[0] - REACH and q[0] <= p[2] + REACH for q in parts)
    out = []
    for p in parts:
        if p[1] < 3 or any(q[2] > p[0] and q[0] < p[2] for q in strong):
            continue
        by_id, by_secret = near(p, (1, 3)), near(p, (0, 2, 4, 5))
        if {3: by_secret, 4: by_id, 5: by_id, 6: by_id and by_secret}[p[1]]:
            out.append(p)
    return out


def check(rows, texts):
    for r in rows:
        t = texts[r["doc_id"]]
        b = base(t)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in b) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in b).encode()).hexdigest()
        every = sorted([(s, n, e) for s, n, _, e in b] + linked(t))
        assert r["spans"] == ",".join(f"{PATTERNS[n][0]}:{s}:{e}" for s, n, e in every)


def test_spans(spark, folder, odd):
    texts = dict(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    at = folder(documents=docs)
    rows = op1_secret_scans(spark, at).collect()
    assert len(rows) == len(TEXTS)
    check(rows, texts)
    assert sum(r["n_linked"] for r in rows) == 5
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    cur = con.execute(OP1_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in rows))) == sorted(map(repr, cur.fetchall()))


def test_odd_rows(spark, odd, none, folder):
    assert op1_secret_scans(spark, folder()).count() == len(ODD)
    made, name = scan(odd)
    assert name == "found_" and made.count() == len(ODD) and made.columns == [*odd.columns, name]
    assert scan(none)[0].count() == 0
    same = redact(odd)
    assert same.columns == odd.columns
    assert sorted(map(repr, same.collect())) == sorted(map(repr, odd.collect()))
    assert op1_secret_scans(spark, folder(empty=True)).count() == 0


def test_quick_tests_decide_as_the_patterns(spark):
    r = random.Random(12)
    texts = ["".join(r.choice("aA0+/ .\n=é") if r.random() < 0.06 else r.choice("abzAZ09+/") for _ in range(r.randint(0, 90))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, test in TESTS.items():
        pattern = next(p[1] for p in PATTERNS if p[0] == kind)
        got = {row["a"]: row["n"] for row in df.groupBy(F.col("t").rlike(pattern).alias("a"), F.col("t").rlike(test).alias("b")).agg(F.count("*").alias("n")).where("a = b").collect()}
        assert sum(got.values()) == len(texts) and min(got.values()) > 100


def test_columns_of_any_kind_pass(spark):
    """Maps can't be compared or grouped by, and are carried all the same."""
    df = spark.createDataFrame([(1, "token=abcdefghijklm", {"a": 1}), (2, None, None)], "doc_id long, text string, more map<string,int>")
    got = {r["doc_id"]: (r["text"], r["more"]) for r in redact(df).collect()}
    assert got == {1: ("token=[SECRET]", {"a": 1}), 2: (None, None)}


def test_redaction(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = dict(redact(spark.createDataFrame(rows, "i int, text string")).collect())
    assert got[0] == 'token = "[SECRET]" and more' and got[1] == TEXTS[1] and got[20] is None
    assert got[9] == "user = [SECRET] password = [SECRET]"
    assert got[16] == "é😀 token=[SECRET] é"
    assert got[12].startswith("host=db.example.org:5432 ")


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "token=abcdefghijklm")], "doc_id long, text string")
    plan = scan(df)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert scan(df)[0].select(F.size("found")).first()[0] == 1
