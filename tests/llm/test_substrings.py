import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from quillon.llm.substrings import OP2_SQL, deduplicate, op2_suffix_array_dedup
from tests.conftest import SF
from tests.llm.conftest import ODD, prose


def brute(docs, least=100):
    """id -> (bytes, removed, spans, hash of what is left), walking all strings in order."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            if w in seen:
                gone[p : p + least] = b"\x01" * least
            seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def run(df, **more):
    made = deduplicate(df, **more)
    return {r[0]: tuple(r)[1:] for r in made.select("id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")), F.size("runs"), F.sha2("kept", 256)).collect()}


@pytest.mark.parametrize(("shard_bytes", "common"), [(2_000, 1 << 40), (20_000, 1 << 40), (1_500_000, 1 << 40), (2_000, 0), (20_000, 3), (2_000, 5)])
def test_any_sharding_gives_the_same(spark, shard_bytes, common):
    """Copies, shared passages, near copies, periodic and long texts, in shuffled order."""
    passage = prose(50, 60)
    docs = []
    for i in range(40):
        docs.append((i, prose(i % 30, 80)))
    for i in range(40, 60):
        docs.append((i, prose(i, 30) + " " + passage + " " + prose(i + 500, 30)))
    for i in range(60, 75):
        w = prose(60, 120).split()
        w[(i * 11) % 120] = f"new{i}"
        docs.append((i, " ".join(w)))
    docs += [(80, "ab" * 400), (81, "ab" * 300 + "c" + "ab" * 300), (82, "é" * 300), (83, "x" * 99), (84, "x" * 100), (85, "y" + "x" * 100), (86, prose(7, 3000) + prose(8, 1500) + prose(7, 3000)), (87, ""), (88, None)]
    docs = [(d * 7919 % 1009, t) for d, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert run(df, shard_bytes=shard_bytes, common_rows=common, one_in=1) == brute(docs)


def brute_rows(docs, least=100):
    """For each row (bytes, removed, hash of what is left): a string goes if it also is in a row of a smaller id, or earlier under the same id."""
    rank = lambda i: 1 << 62 if i is None else i
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            w, at = b[p : p + least], (rank(i), p)
            first[w] = min(first.get(w, at), at)
    out = collections.Counter()
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < (rank(i), p):
                gone[p : p + least] = b"\x01" * least
        out[i, len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("shard_bytes", "common"), [(700, 1 << 40), (3_000, 1 << 40), (1_500_000, 1 << 40), (700, 0)])
def test_null_and_shared_ids_lose_only_what_is_repeated(spark, shard_bytes, common):
    x, y, z, v = (prose(i, 70) for i in (301, 302, 303, 304))
    docs = [(0, x), (None, x + y), (None, z), (None, z), (None, y + v), (None, None), (1, x + v), (1, z + "!"), (1, "! " + z), (1, x + v), (2, v), (2, y + x), (None, "q" * 150), (5, prose(305, 30) + x + z), (5, prose(306, 40) + z + x)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    made = deduplicate(df, shard_bytes=shard_bytes, common_rows=common, one_in=1).select("id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.sha2("kept", 256))
    assert collections.Counter(tuple(r) for r in made.collect()) == brute_rows(docs)


def test_repeated_rows_are_searched_once(spark):
    """Rows that repeat id and text lose what one of them does, without each bringing the spans of all."""
    from quillon.llm.substrings import repeats

    x, y, z = (prose(i, 70) for i in (311, 312, 313))
    docs = [(1, x), (2, x + y), (3, "! " + y + z), (None, z + x), (4, x), (5, y[:150] + "?" + y[:150]), (6, None), (7, "short")]
    once, often = (spark.createDataFrame(docs * m, "doc_id long, text string").repartition(4) for m in (1, 12))
    spans = [sorted(tuple(r) for r in repeats(df, shard_bytes=700, one_in=1)[1].collect()) for df in (once, often)]
    assert spans[0] and spans[1] == spans[0]
    made = deduplicate(often, shard_bytes=700, one_in=1).select("id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.sha2("kept", 256))
    assert collections.Counter(tuple(r) for r in made.collect()) == brute_rows(docs * 12)


def test_common_anchors_are_found_and_spread(spark):
    """A passage with other text around it in each document: its strings come from many stretches of few anchors."""
    from quillon.llm.substrings import common_anchors, repeats

    rare = prose(60, 30)
    docs = [(i, prose(7000 + i, 12) + " " + rare + " " + prose(9000 + i, 12)) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    keyed = df.selectExpr("doc_id as key", "text")
    every, some = common_anchors(keyed, shard_bytes=5_000, rows=150, one_in=1), common_anchors(keyed, shard_bytes=5_000, rows=150, one_in=4)
    assert 0 < len(every) < 50 and set(some) & set(every)
    assert len(common_anchors(keyed, shard_bytes=5_000, rows=150, one_in=1, most=1)) == 1
    a = run(df, shard_bytes=5_000, common_rows=150, one_in=4)
    assert a == run(df, shard_bytes=5_000, common_rows=1 << 40) == brute(docs)
    assert repeats(df, shard_bytes=5_000, common_rows=150, one_in=4)[1].count() > 500


def test_lookup_over_blocks_is_that_over_one():
    """Stretches of one anchor that come in several blocks, with equal starts under one id."""
    import numpy as np

    from quillon.llm.substrings import _lookup

    texts = [prose(400 + i % 3, 40).encode() for i in range(6)]
    doc, first = np.array([1, 1, 1, 2, 2, 3]), np.array([0, 0, 5, 0, 0, 7])
    group = np.full(6, 9)
    whole = _lookup([], group, doc, first, np.cumsum([0] + [len(t) for t in texts]), np.frombuffer(b"".join(texts), np.uint8), 100)
    state, parts = [], []
    for i in range(6):
        parts.append(_lookup(state, group[i : i + 1], doc[i : i + 1], first[i : i + 1], np.array([0, len(texts[i])]), np.frombuffer(texts[i], np.uint8), 100))
    assert (np.concatenate(parts) == whole).all() and whole.any() and not whole.all()


def test_odd_rows(spark, odd, none, folder):
    rows = op2_suffix_array_dedup(spark, folder()).collect()
    assert len(rows) == len(ODD)
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"]))
    first = got[1][0][0]
    assert got[1] == [(first, 0, 0)] * 2 and got[6] == [(first, first, 1)] and got[2] == got[3] == [(0, 0, 0)]
    assert got[None][0][1] == 0 and got[9][0][1] > 0
    assert deduplicate(odd).count() == len(ODD)
    assert deduplicate(none).count() == 0
    assert op2_suffix_array_dedup(spark, folder(empty=True)).count() == 0


def test_documents_of_the_small_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op2_suffix_array_dedup(spark, d).collect()}
    assert got == brute(docs)


def test_sql(spark, same_rows):
    same_rows(op2_suffix_array_dedup(spark, SF), OP2_SQL)
