import random

import pytest

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(".,") if r.random() < 0.1 else "") for _ in range(n))


#: Nulls, empty and odd texts, repeated rows, equal texts under other ids, ids twice, one very long text.
ODD = [
    (1, prose(1, 60), "en", "s"), (2, None, "en", "s"), (3, "", None, None), (None, prose(2, 60), "en", "s"), (4, " \t\n ", "en", "s"), (5, "word", "en", "s"), (6, prose(1, 60), "en", "s"),
    (7, prose(3, 30_000), "en", "s"), (8, "Ünïcödé 漢字 😀 text\x00with\u0085odd space", "de", "s"), (1, prose(1, 60), "en", "s"), (9, "a a a a a " * 200, "en", "s"), (10, "###$$$ 12345", None, "s"), (5, "another text under the same id as one word", "en", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with odd rows, and columns with names that operators use themselves."""
    rows = [(*r, len(r[1] or ""), "x", "y", "z", "u", "v", "w", 1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string, found string, twin string, id string, node string, key string, row int").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -1")


@pytest.fixture()
def folder(odd, none, tmp_path, spark):
    """A folder of tables like those of the driver, from odd rows or none."""

    def made(empty: bool = False, **more):
        at = tmp_path / ("none" if empty else "odd")
        docs = (none if empty else odd).select("doc_id", "text", "lang", "source", "n_chars")
        tables = {"documents": docs, "benchmark": spark.createDataFrame([(0, prose(3, 40)), (1, None), (2, "too short"), (None, prose(2, 30))], "item_id long, text string").where("false" if empty else "true")}
        tables |= more
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{at}/{name}.parquet")
        return str(at)

    return made
