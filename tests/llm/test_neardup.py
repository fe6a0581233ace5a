import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.neardup import OP4_SQL, cells, near_duplicates, op4_minhash_near_dedup, signatures
from quillon.llm.bytesets import mix
from tests.conftest import SF
from tests.llm.conftest import ODD, prose


def classes(texts, threshold=0.8):
    """id -> least id of its class, by comparing all pairs that share a shingle."""
    sets, twin = {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    where = collections.defaultdict(list)
    for i, s in sets.items():
        if (texts[i] or "") in twin:
            join(i, twin[texts[i] or ""])
        twin.setdefault(texts[i] or "", i)
        shared = collections.Counter(j for g in s for j in where[g])
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n):
                join(i, j)
        for g in s:
            where[g].append(i)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("folder_", [SF, "/root/testdata/sf0.01"])
def test_classes_of_real_documents(spark, folder_):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder_}/documents.parquet").collect()}
    got = {r["doc_id"]: r["class_id"] for r in op4_minhash_near_dedup(spark, folder_).collect()}
    assert got == classes(texts)


def test_chains_and_hot_groups(spark):
    """Copies of a text with a few words changed, a chain whose ends differ, and hundreds of equal texts."""
    base = prose(11, 300).split()
    texts = {}
    for i in range(120):
        w = list(base)
        w[(i * 7) % 300] = f"x{i}"
        w[(i * 13) % 300] = f"y{i}"
        texts[i] = " ".join(w)
    w = prose(12, 200).split()
    for i in range(12):
        w = list(w)
        w[i * 15] = f"z{i}"
        w[i * 15 + 7] = f"q{i}"
        texts[1000 + i] = " ".join(w)
    for i in range(500):
        texts[5000 + i] = prose(13, 50)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r["id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == classes(texts)


def test_agreement_is_the_similarity():
    rng = np.random.default_rng(5)
    for common, own in ((80, 10), (30, 40)):
        both = rng.integers(0, 1 << 62, common).astype(np.uint64)
        a = np.r_[both, rng.integers(0, 1 << 62, own).astype(np.uint64)]
        b = np.r_[both, rng.integers(0, 1 << 62, own).astype(np.uint64)]
        s = signatures(mix(np.r_[a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 4000)
        assert (s != 0).all()
        assert abs((s[0] == s[1]).mean() - common / (common + 2 * own)) < 0.04


def test_counts_as_weights():
    x = np.arange(1, 11, dtype=np.uint64)
    doc = np.repeat([0, 1], [10, 20])
    c = cells(np.r_[x, x, x], doc, "count")
    s = signatures(c, doc, 2, 4000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.04
    s = signatures(cells(np.r_[x, x, x], doc, "set"), doc, 2, 500)
    assert (s[0] == s[1]).all()


def test_signature_does_not_depend_on_its_block():
    x = mix(np.arange(1, 60, dtype=np.uint64))
    alone = signatures(x[:40], np.zeros(40, np.int64), 1, 96)
    beside = signatures(x, np.repeat([0, 1], [40, 19]), 3, 96)
    assert (alone[0] == beside[0]).all() and (beside[2] == 0).all()


def test_odd_rows(spark, odd, none, folder):
    rows = op4_minhash_near_dedup(spark, folder()).collect()
    assert len(rows) == len(ODD)
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r["class_id"])
    assert got[1] == [1, 1] and got[6] == [1] and got[2] == got[3] == [2] and got[None] == [None]
    assert near_duplicates(odd).count() == len(ODD)
    assert near_duplicates(none).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7} | {100 + i: 100 for i in range(41)}


def _core(n, common, own, seed):
    """Texts that share a passage of ``common`` shingles and have ``own`` more each."""
    passage = prose(seed, common + 4)
    return {i: passage + " " + " ".join(f"w{seed}x{i}x{j}" for j in range(own)) for i in range(n)}


def _rare(spark, texts):
    from quillon.llm.neardup import _rare_pairs, _sets
    from quillon.llm.rows import annotate

    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    sets = annotate(df, "text", _sets(5, "set"), "x array<long>", ["id"], "s").select(F.col("id").alias("node"), F.col("id").alias("component"), F.col("s.x").alias("x"))
    return _rare_pairs(sets, 0.8)


def test_a_shared_passage_makes_no_pairs(spark):
    """Two thousand texts with a similarity of 0.74 to each other; a few have a copy with one word changed."""
    texts = _core(2000, 85, 15, 77)
    for i in range(0, 2000, 100):
        texts[5000 + i] = texts[i].replace(f"w77x{i}x7", "new")
    assert _rare(spark, texts).distinct().count() <= 2 * 20
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i in texts}


def test_pairs_of_rare_shingles_lose_none(spark):
    """Sets of many sizes with shared parts: every pair at the threshold is there."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(400)]
    texts = {}
    for i in range(160):
        a = r.randint(0, 40)
        w = base[a : a + r.randint(20, 260)]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{i}"
        texts[i] = " ".join(w)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in texts.items()}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {(p["a"], p["b"]) for p in _rare(spark, texts).collect()}
    assert len(want) > 300 and want <= got and len(got) < 160 * 159 / 2


def test_crowded_buckets(spark, monkeypatch):
    """Texts that share a long passage fill each other's buckets; a few are alike in the rest, too."""
    from quillon.llm import neardup

    passage = prose(900, 260)
    texts = {i: passage + " " + prose(2000 + i, 110) for i in range(150)}
    for i in range(150, 158):
        w = texts[i - 150].split()
        w[300] = f"new{i}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = classes(texts)
    for fan in (2, 32):
        monkeypatch.setattr(neardup, "FAN", fan)
        assert {r["id"]: r["class_id"] for r in near_duplicates(df).collect()} == want
    assert len(set(want.values())) == 150


def test_sql(spark, same_rows):
    same_rows(op4_minhash_near_dedup(spark, SF), OP4_SQL)
