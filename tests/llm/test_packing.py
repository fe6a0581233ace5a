import random
import zlib

import numpy as np

from quillon.llm.packing import Tokens, op7_packing, pack, plan, public
from tests.llm.conftest import ODD


def best(at, cost, size):
    """The least cost, by trying all transitions."""
    low = [0.0] + [1e18] * (len(at) - 1)
    for i in range(1, len(at)):
        for j in range(i):
            n = at[i] - at[j]
            if n <= size:
                low[i] = min(low[i], low[j] + (0 if n & (n - 1) == 0 else size - n) + cost[i])
    return low[-1]


def test_plan_is_optimal():
    r = random.Random(1)
    for _ in range(300):
        at = np.cumsum([0] + [r.randint(1, 14) for _ in range(r.randint(1, 40))])
        cost = np.array([r.choice([0.0, 1.0, 3.0]) for _ in at])
        cuts = plan(at, cost, 32)
        points, total = [0, *cuts], 0.0
        for a, b in zip(points, points[1:], strict=False):
            n = at[b] - at[a]
            assert n <= 32
            total += (0 if n & (n - 1) == 0 else 32 - n) + cost[b]
        assert cuts[-1] == len(at) - 1 and abs(total - best(at, cost, 32)) < 1e-9


def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts):
    """Each id in one piece, pieces where they say, sequences gapless and at most 1024."""
    t = reference()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    return [sum(n for _, n in p) for p in sequences.values()]


def test_real_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sizes = check(op7_packing(spark, d).collect(), texts)
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes) < 0.01 * sum(sizes)


def test_the_fast_tokenizer_gives_the_same_ids():
    t, mine = reference(), Tokens(*public())
    r = random.Random(4)
    texts = [t_ or "" for _, t_, *_ in ODD] + ["<|endoftext|> don't  \n\n x", "a<|endoftext|><|endoftext|>  \n<|endoftext|", "  <|endoftext|>  b", "".join(chr(r.choice([r.randint(32, 126), r.randint(0xA0, 0x24F), r.randint(0x4E00, 0x4E80), 0x1F600])) for _ in range(3000))]
    for x in texts:
        assert t.encode(x, add_special_tokens=False).ids == list(mine.ids(x))


def test_odd_rows(spark, odd, none, folder):
    unique = odd.dropDuplicates(["doc_id"]).where("doc_id is not null")
    texts = {r["doc_id"]: r["text"] for r in unique.collect()}
    check(op7_packing(spark, folder(documents=unique.select("doc_id", "text", "lang", "source", "n_chars"))).collect(), texts)
    rows = pack(odd, *public(), tokens=True).collect()
    assert sum(r["start"] == 0 for r in rows) == len(ODD)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert pack(none, *public()).count() == 0


def test_blocks_change_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1)
    one = pack(docs, *public(), block=10_000_000).groupBy("sequence_id").count().count()
    many = pack(docs, *public(), block=20_000).groupBy("sequence_id").count().count()
    assert abs(one - many) <= 0.03 * one
