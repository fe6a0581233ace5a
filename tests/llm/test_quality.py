import re

from quillon.llm.quality import OP8_SQL, judge, op8_quality_rules
from tests.conftest import SF
from tests.llm.conftest import ODD


def brute(text):
    """Counts by the definitions, with sets and loops."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    mark = set()
    for at in seen.values():
        if len(at) > 1:
            mark |= {i + j for i in at for j in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(mark)


def repeats(text, least=5):
    """(covered words, longest repeat) by comparing all pairs of positions of a short text."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j:
                n = 0
                while max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                best[i] = max(best[i], n)
    mark = {i + j for i, n in enumerate(best) if n >= least for j in range(n)}
    return len(mark), max([n for n in best if n >= least], default=0)


def test_counts_of_real_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op8_quality_rules(spark, SF).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute(docs[r["doc_id"]])
        assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (r["base_failed"] and r["kept"])
        if got[0] < 300:
            assert (r["n_covered"], r["longest_repeat"]) == repeats(docs[r["doc_id"]])


def test_odd_rows(spark, odd, none, folder):
    rows = op8_quality_rules(spark, folder()).collect()
    assert len(rows) == len(ODD)
    want = sorted((repr(i), brute(t)) for i, t, *_ in ODD)
    assert sorted((repr(r["doc_id"]), (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows) == want
    made, name = judge(odd)
    assert name == "quality_" and made.columns == [*odd.columns, name] and made.count() == len(ODD)
    assert judge(none)[0].count() == 0
    assert op8_quality_rules(spark, folder(empty=True)).count() == 0


def test_clean_labelled_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1")
    rows = op8_quality_rules(spark, d).join(labels, "doc_id").where("not base_failed").collect()
    assert len(rows) > 200 and all(r["kept"] for r in rows)


def test_sql(spark, same_rows):
    same_rows(op8_quality_rules(spark, SF), OP8_SQL)
