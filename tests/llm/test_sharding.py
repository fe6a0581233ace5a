import zlib
from collections import Counter, defaultdict

from quillon.llm.sharding import op10_sharding, shards
from tests.llm.conftest import ODD, prose


def check(rows, docs, n=24, part=0.125):
    """Sizes, checksums, gapless slots, near-equal bytes, equal texts together unless they are an eighth of a shard."""
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r[0], r["size"], r["text_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(n))
    total = sum(r["size"] for r in rows)
    copies = Counter()
    for _, t in docs:
        copies[t or ""] += len((t or "").encode()) + 8
    unit = max([min(x, total / n * part) for x in copies.values()] + [len((t or "").encode()) + 8 for _, t in docs])
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert all(abs(sizes[k] - total / n) <= 2 * unit + total / n / 16 for k in range(n))
    where = defaultdict(set)
    shard = {r[0]: r["shard"] for r in rows}
    for i, t in docs:
        where[t or ""].add(shard[i])
    assert all(len(s) == 1 for t, s in where.items() if copies[t] < total / n * part)


def test_real_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = op10_sharding(spark, d).collect()
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    check(rows, docs)
    assert sorted(map(repr, rows)) == sorted(map(repr, op10_sharding(spark, d).collect()))


def test_a_text_with_a_third_of_all_rows(spark):
    docs = [(i, prose(1, 40) if i % 3 == 0 else prose(i, 30)) for i in range(6000)]
    rows = shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    check(rows, docs)
    assert len({r["shard"] for r in rows if r[0] % 3 == 0}) >= 8


def test_one_row_that_is_a_third_of_all(spark):
    """Rows with one id and one text part between shards, which are as near to their share as others."""
    docs = [(7, prose(1, 40)) if i % 3 == 0 else (i, prose(i, 30)) for i in range(6000)]
    rows = shards(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    assert Counter((r[0], r["size"]) for r in rows) == Counter((i, len(t.encode()) + 8) for i, t in docs)
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    share = sum(sizes.values()) / 24
    assert set(sizes) == set(range(24)) and all(abs(x - share) <= share / 16 + 400 for x in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r[0] == 7}) >= 8


def test_odd_rows(spark, odd, none, folder):
    rows = op10_sharding(spark, folder()).collect()
    assert len(rows) == len(ODD) and shards(odd).count() == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert shards(none).count() == 0 and op10_sharding(spark, folder(empty=True)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    plan = shards(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
