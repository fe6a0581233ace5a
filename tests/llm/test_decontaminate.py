import pickle

import pytest

from quillon.llm import decontaminate
from quillon.llm.decontaminate import EXPANDED, OP6_SQL, Index, contained, unsearchable, op6_benchmark_decontamination
from tests.llm.conftest import prose


def test_against_all_shingles(spark):
    """Whole, cut, edited and mixed-case items of 10 to 300 words inside short and long documents."""
    items = [(i, prose(700 + i, n)) for i, n in enumerate((10, 12, 18, 25, 33, 40, 70, 130, 300, 5, 4))]
    docs = []
    for i, t in items:
        w = t.split()
        for j, inside in enumerate((t, t.upper().replace(" ", "\n"), " ".join(w[: int(len(w) * 0.9)]), " ".join(w[: len(w) // 2]), " ".join([*w[: len(w) // 2], "changed", *w[len(w) // 2 + 1 :]]))):
            docs.append((100 * i + j, prose(i * 9 + j, 40 + 900 * (j % 2)) + " " + inside + " " + prose(i * 9 + j + 3000, 200)))
    got = {(r["doc"], r["item"]): r["containment"] for r in contained(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    import re

    def grams(t):
        w = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {}
    own = {i: grams(t) for i, t in items}
    for d, t in docs:
        g = grams(t)
        for i, q in own.items():
            if q and len(q & g) >= 0.8 * len(q):
                want[d, i] = len(q & g) / len(q)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(want) > 25


@pytest.mark.parametrize("n", [5, 6, 7, 20])
def test_no_short_item_is_missed(spark, n):
    """Verbatim items of few words, each in a long text; of 20 words also with the last three cut off."""
    items = [(i, prose(5000 + i, n)) for i in range(300)]
    docs = [(i, f"{prose(i, 200 + i)} {t if n < 20 else ' '.join(t.split()[:17])} {prose(9000 + i, 200)}") for i, t in items]
    got = {(r["doc"], r["item"]) for r in contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i) for i in range(300)} <= got


def test_sql_of_the_small_table(spark, same_rows):
    d = "/root/testdata/sf0.001"
    same_rows(op6_benchmark_decontamination(spark, d), OP6_SQL)


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 500)
    items = spark.createDataFrame([(i, prose(i, 20)) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "start " + prose(i, 20) + " end") for i in range(30)], "doc_id long, text string")
    assert {(r["doc"], r["item"]) for r in contained(docs, items).collect()} == {(i, i) for i in range(30)}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, folder, empty):
    rows = op6_benchmark_decontamination(spark, folder(empty)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == (set() if empty else {(7, 0), (None, None)})


def test_the_index_is_bounded():
    """What is broadcast stays within its multiple of the items' bytes, whatever their length."""
    for words, count in ((6, 4000), (22, 4000), (40, 4000), (700, 300)):
        items = [(i, prose(i, words)) for i in range(count)]
        size = sum(len(t) + 100 for _, t in items)
        assert len(pickle.dumps(Index(items, 5, 64, 0.8))) <= EXPANDED * size + (20 << 20)


def test_items_that_cannot_be_sought_are_told(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two, three-four"), (4, "one two three four five"), (5, "漢字漢字漢字。漢字"), (None, "a b")], "item_id long, text string")
    assert {(r["item"], r["words"]) for r in unsearchable(items).collect()} == {(1, 0), (2, 0), (3, 4), (5, 1), (None, 2)}
