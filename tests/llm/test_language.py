import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import language
from quillon.llm.bytesets import buffers
from quillon.llm.language import OP5_SQL, learn, op5_language_id
from tests.conftest import SF
from tests.llm.conftest import ODD


class Tree:
    """The same model byte by byte, with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.n = order, defaultdict(lambda: defaultdict(int))
        for t in texts:
            b = b" " * order + t.encode()
            for i in range(order, len(b)):
                for k in range(order + 1):
                    self.n[b[i - k : i]][b[i]] += 1

    def bits(self, text):
        b, total = b" " * self.order + text.encode(), 0.0
        for i in range(self.order, len(b)):
            for k in range(self.order, -1, -1):
                c = self.n.get(b[i - k : i])
                if not c:
                    continue
                whole = sum(c.values()) + len(c)
                if b[i] in c:
                    total -= math.log2(c[b[i]] / whole)
                    break
                total -= math.log2(len(c) / whole)
            else:
                total += 8
        return total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_are_exact(spark, order):
    texts = [("en", "the cat sat on the mat"), ("en", "that hat"), ("de", "die katze saß auf der matte"), ("de", "übrig"), (None, "zzz"), ("fr", None)]
    model = learn(spark.createDataFrame(texts, "lang string, text string"), order)
    assert model.langs == ["de", "en"]
    import pyarrow as pa

    asked = ["the matte", "", "xyz ßü 😀", "q"]
    got = model.bits(*buffers(pa.array(asked)))
    for i, lang in enumerate(model.langs):
        tree = Tree([t for x, t in texts if x == lang], order)
        assert np.allclose(got[:, i], [tree.bits(t) for t in asked], rtol=1e-5)


@pytest.mark.parametrize("held", [1 << 30, 0])
def test_no_context_is_dropped(spark, monkeypatch, held):
    """More contexts than any bound of old, in a model that is broadcast or one in several files."""
    import random

    import pyarrow as pa

    monkeypatch.setattr(language, "HELD", held)
    monkeypatch.setattr(language, "PART", 50_000)
    r = random.Random(5)
    noise = {x: ["".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1000)) for _ in range(100)] for x in ("aa", "bb")}
    docs = spark.createDataFrame([(x, t) for x, own in noise.items() for t in own], "lang string, text string")
    model = learn(docs)
    asked = [noise["aa"][0], noise["bb"][-1], "not seen: 漢字"]
    found, at = language.identify(spark.createDataFrame([(t,) for t in asked], "text string"), model)
    got = {r["text"]: r[at] for r in found.collect()}
    trees = {x: Tree(own, 3) for x, own in noise.items()}
    want = [[trees[x].bits(t) for x in ("aa", "bb")] for t in asked]
    assert np.allclose(model.bits(*buffers(pa.array(asked))), want, rtol=1e-5)
    assert len(model.parts) > 1 and isinstance(model.parts[0], list) == (held > 0)
    assert [got[t]["lang"] for t in asked[:2]] == ["aa", "bb"]
    assert all(math.isclose(got[t]["bits"], min(w) / len(t.encode()), rel_tol=1e-5) for t, w in zip(asked, want, strict=True))


def test_many_languages(spark, monkeypatch):
    """Sixty languages with words of their own, one of them with a third of the text: held or in files, the same answers."""
    import pickle
    import random

    r = random.Random(8)
    words = {f"l{i:02d}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyzäöüß", k=r.randint(2, 7))) for _ in range(40)] for i in range(60)}
    rows = [(x, " ".join(r.choices(own, k=60))) for x, own in words.items() for _ in range(100 if x == "l00" else 4)]
    asked = [(x, " ".join(r.choices(own, k=30))) for x, own in words.items()]
    docs, more = spark.createDataFrame(rows, "lang string, text string"), spark.createDataFrame(asked, "want string, text string")
    answers = []
    for held in (1 << 30, 0):
        monkeypatch.setattr(language, "HELD", held)
        model = learn(docs)
        found, at = language.identify(more, model)
        answers.append({row["want"]: tuple(row[at]) for row in found.collect()})
        if held:
            grams = sum(len(own[0]) for part in model.parts for own in part)
            assert len(pickle.dumps(model)) < language.EACH * grams + 4000 * len(model.langs)
    assert answers[0] == answers[1] and all(a[0] == x for x, a in answers[0].items())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op5_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, folder):
    rows = op5_language_id(spark, folder()).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4, 10))
    assert by[7]["lang_pred"] == "en" and not by[None]["held_out"]
    assert op5_language_id(spark, folder(empty=True)).count() == 0


def test_nothing_to_learn_from(spark, folder, odd):
    bare = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    assert {r["lang_pred"] for r in op5_language_id(spark, folder(documents=bare)).collect()} == {"und"}


def test_sql(spark, same_rows):
    same_rows(op5_language_id(spark, SF), OP5_SQL)
