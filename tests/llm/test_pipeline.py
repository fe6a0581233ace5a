import collections
import re

import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.conftest import prose
from tests.llm.test_neardup import classes
from tests.llm.test_packing import check as packed
from tests.llm.test_quality import brute as counts
from tests.llm.test_secrets import base


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The rows of each stage over the smallest documents, with some planted."""
    at = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    w = prose(77, 200).split()
    near = " ".join([*w[:100], "other", *w[101:]])
    more = [(90_001, " ".join(w)), (90_002, near), (90_003, prose(78, 50) + " " + item + " " + prose(79, 50)), (90_004, prose(80, 60) + " secret=abcdefghijklmnopqrst " + prose(81, 20)), (90_005, "too short"), (90_006, "again and again " * 50)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in more], docs.schema))
    docs.write.parquet(f"{at}/in")
    docs = spark.read.parquet(f"{at}/in")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        out.append(docs.collect())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_quality(staged):
    kept = {r["doc_id"] for r in staged[1]}
    for r in staged[0]:
        n, _, _, _, repeated = counts(r["text"])
        if n < 20 or 100 * repeated > 30 * n:
            assert r["doc_id"] not in kept
    assert not kept & {90_005, 90_006} and {90_001, 90_003} <= kept


def test_near_duplicates(staged):
    texts = {r["doc_id"]: r["text"] for r in staged[1]}
    assert sorted(r["doc_id"] for r in staged[2]) == sorted(set(classes(texts).values()))
    assert {r["doc_id"] for r in staged[2]} & {90_001, 90_002} == {90_001}


def test_decontamination(spark, staged):
    def grams(t):
        w = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [r["doc_id"] for r in staged[2] if not any(q and len(q & grams(r["text"])) >= 0.8 * len(q) for q in items)]
    assert sorted(r["doc_id"] for r in staged[3]) == sorted(want) and 90_003 not in want


def test_secrets(staged):
    before = {r["doc_id"]: r for r in staged[3]}
    assert sorted(before) == sorted(r["doc_id"] for r in staged[4])
    for r in staged[4]:
        if base(before[r["doc_id"]]["text"]):
            assert "[SECRET]" in r["text"] and not base(r["text"])
    assert "secret=[SECRET] " in {r["doc_id"]: r["text"] for r in staged[4]}[90_004]


def test_packing(staged):
    packed(staged[5], {r["doc_id"]: r["text"] for r in staged[4]})


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda r: (r["doc_id"], r["start"])
    total = lambda rows: {d: n for d, n in collections.Counter({r["doc_id"]: r["doc_tokens"] for r in rows}).items()}
    assert total(sorted(corpus_pipeline.run(spark, SF).collect(), key=key)) == total(sorted(docs.collect(), key=key))


def test_odd_and_no_rows(spark, folder):
    at = folder()
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, at)
        if i == 1:
            # Of equal texts one row stays, and of two rows with a null id and one text too.
            texts = [r["text"] for r in docs.collect()]
            assert len(texts) == len(set(texts)) > 1
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, folder(empty=True)).count() == 0
    extra = spark.read.parquet(f"{at}/documents.parquet").selectExpr("*", "1 AS twin", "2 AS first_id", "3 AS quality", "4 AS found", "5 AS state")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        extra = stage(spark, extra, at)
    assert {"twin", "first_id", "quality", "found", "state"} <= set(extra.columns)
