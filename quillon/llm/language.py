"""Language identification by prediction by partial matching (operator 5).

Each language has a byte context tree of orders 0 to ``order``.  A byte's probability in a context of the tree is
count / (total + distinct); if the context has not seen it, the escape probability distinct / (total + distinct) is paid
and the next shorter context is asked, down to 1/256 for every byte.  Statistics are frozen after learning, so the code
length of every (context, byte) is a constant, and a text's code length is a sum of table entries: the context of each
position is the longest suffix of up to ``order`` bytes that is in the trees.  A text has the language of its least code
length; ``score`` is that language's posterior under equal priors.

Counts are taken over all learning rows: per task in numpy, then summed per (language, n-gram) in Spark.  No n-gram or
context is left out.  Tables are sorted and sparse, and are made in parts by the last byte of the context, so the driver holds
about ``PART`` n-grams of one part at a time.  A model of up to ``HELD`` n-grams is broadcast (under ``EACH`` bytes each, whatever the number
of languages); the parts of a larger one are files in the shared folder, which executors get once and map into memory.

Null texts and those without a letter are ``und`` with score 0; so is every text if no row can be learned from.  Rows with null
language teach nothing.  Ties between languages go to the first in order of name.  Repeated rows each count and each
get a row.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bytesets import blocks
from quillon.llm.rows import annotate, bounded, cut, folder, fresh, put, read

ORDER = 3
#: n-grams of which a part of a model is made at once.
PART = 4_000_000
#: n-grams of a model that is broadcast; a larger one goes to executors in files.
HELD = 4_000_000
#: Bytes of a model for each n-gram at most: a number and a code length for it, and those of its context and of shorter ones.
EACH = 60


def _codes(off: np.ndarray, data: np.ndarray, order: int) -> np.ndarray:
    """For each byte the number made of it and the ``order`` bytes before it; before a text stand spaces."""
    n = len(data)
    g = np.zeros(n, np.int64)
    at = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    for back in range(order, 0, -1):
        g <<= 8
        before = np.full(n, 32, np.int64)
        before[back:] = data[: n - back]
        before[at < back] = 32
        g |= before
    return (g << 8) | data


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each byte follows each context of ``order`` bytes."""
    bounded(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part, off, data in blocks(batch, "text"):
                langs, of = np.unique(np.asarray(part.column("lang").to_pylist(), object), return_inverse=True)
                if not len(data):
                    continue
                code = _codes(off, data, order)
                code |= np.repeat(of.astype(np.int64), np.diff(off)) << (8 * (order + 1))
                key, n = np.unique(code, return_counts=True)
                which = key >> (8 * (order + 1))
                yield pa.RecordBatch.from_arrays([pa.array(langs[which], pa.string()), pa.array(key & ((1 << 8 * (order + 1)) - 1)), pa.array(n)], names=["lang", "gram", "n"])

    made = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, gram long, n long")
    return made.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tables(g: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from the highest to 1: sorted n-grams, their code lengths, sorted contexts, their escape's."""
    made = []
    for k in range(order, 0, -1):
        gram, inv = np.unique(g & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        count = np.bincount(inv, n, len(gram))
        ctx, inv, distinct = np.unique(gram >> 8, return_inverse=True, return_counts=True)
        whole = np.bincount(inv, count, len(ctx)) + distinct
        made += [gram, -np.log2(count / whole[inv]).astype(np.float32), ctx, -np.log2(distinct / whole).astype(np.float32)]
    return made


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of keys in a sorted table."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Model:
    """Code lengths in bits of each byte in each context, for each language."""

    def __init__(self, langs: list[str], bytes_: np.ndarray, order: int):
        """bytes_: (languages, 256) counts of bytes."""
        self.langs, self.order = langs, order
        total, distinct = bytes_.sum(axis=1, keepdims=True), (bytes_ > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            self.shortest = np.where(bytes_ > 0, -np.log2(bytes_ / (total + distinct)), 8.0 - np.log2(distinct / (total + distinct)))
        #: The part of each last byte of a context, and each part's tables by language; in files: (name, places of the arrays).
        self.part = np.zeros(256, np.int64)
        self.parts: list = []
        self._open: dict[int, list[list[np.ndarray]]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def add(self, tables: list[list[np.ndarray]], write: Callable[[Iterable[bytes]], str] | None = None) -> None:
        """Adds the tables of a part; ``write`` stores its bytes as a file and gives the file's name, else the part is held."""
        if write is None:
            self.parts.append(tables)
            return
        places, at = [], 0
        for own in tables:
            places.append([])
            for x in own:
                places[-1].append((x.dtype.str, at, len(x)))
                at += x.nbytes + -x.nbytes % 8
        self.parts.append((write(x.tobytes() + b"\0" * (-x.nbytes % 8) for own in tables for x in own), places))

    def _of(self, p: int) -> list[list[np.ndarray]]:
        part = self.parts[p]
        if isinstance(part, list):
            return part
        if p not in self._open:
            name = SparkFiles.get(part[0])
            self._open[p] = [[np.memmap(name, d, "r", at, n) if n else np.zeros(0, d) for d, at, n in own] for own in part[1]]
        return self._open[p]

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """(languages, n-grams) code lengths of distinct n-grams."""
        out = np.zeros((len(self.langs), len(grams)))
        of = self.part[(grams >> 8) & 255]
        for p in np.unique(of):
            here = np.flatnonzero(of == p)
            for i, tables in enumerate(self._of(int(p))):
                left = here
                for k in range(self.order, 0, -1):
                    gram, own, ctx, escape = tables[4 * (self.order - k) : 4 * (self.order - k) + 4]
                    keys = grams[left] & ((1 << 8 * (k + 1)) - 1)
                    at, there = _found(gram, keys)
                    out[i, left[there]] += own[at[there]]
                    left, keys = left[~there], keys[~there]
                    at, there = _found(ctx, keys >> 8)
                    out[i, left[there]] += escape[at[there]]
                out[i, left] += self.shortest[i, grams[left] & 255]
        return out

    def bits(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """(texts, languages) code lengths."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        if not len(data):
            return out
        grams, inv = np.unique(_codes(off, data, self.order), return_inverse=True)
        full = np.flatnonzero(np.diff(off))
        for i, cost in enumerate(self.lengths(grams)):
            out[full, i] = np.add.reduceat(cost[inv], off[full])
        return out


def learn(docs: DataFrame, order: int = ORDER) -> Model:
    """A model of rows (lang, text); only counts of n-grams come to the driver, part by part."""
    docs = docs.where("lang is not null and text is not null and text <> ''")
    spark = docs.sparkSession
    found = cut(counts(docs, order)).withColumn("last", F.shiftright("gram", 8).bitwiseAND(F.lit(255)))
    sums = found.groupBy("lang", "last", F.col("gram").bitwiseAND(F.lit(255)).alias("byte")).agg(F.sum("n").alias("n"), F.count("*").alias("grams")).toArrow()
    langs = sorted(pc.unique(sums.column("lang")).to_pylist())
    code = pa.array(langs, pa.string())
    lang, last, byte, n, many = (sums.column(c).to_numpy() if c != "lang" else pc.index_in(sums.column(c), code).to_numpy() for c in ("lang", "last", "byte", "n", "grams"))
    table = np.zeros((len(langs), 256))
    np.add.at(table, (lang, byte), n)
    model = Model(langs, table, order)
    size = np.bincount(last, many, 256)
    at = folder(spark, "language") if size.sum() > HELD else None

    def write(pieces: Iterable[bytes]) -> str:
        file = f"{at}/{os.path.basename(at)}-{len(model.parts)}"
        put(spark.sparkContext, file, pieces)
        spark.sparkContext.addFile(file)
        return os.path.basename(file)

    first = 0
    while first < 256:
        end = max(first + 1, int(np.searchsorted(np.cumsum(size[first:]), PART, "right")) + first)
        mine = found.where(F.col("last").between(first, end - 1)).select("lang", "gram", "n")
        tables = [_tables(np.zeros(0, np.int64), np.zeros(0, np.int64), order)] * len(langs)
        # A part of one byte may be larger than PART: its languages come one by one.
        for some in [mine] if size[first:end].sum() <= PART else [mine.where(F.col("lang") == x) for x in langs]:
            got = some.toArrow()
            of = pc.index_in(got.column("lang"), code).to_numpy()
            gram, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
            for i in np.unique(of):
                tables[i] = _tables(gram[of == i], n[of == i], order)
        model.part[first:end] = len(model.parts)
        model.add(tables, write if at else None)
        first = end
    return model


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all by default) and a struct (lang, score, bits): ``bits`` a byte in that language."""
    keep = df.columns if keep is None else keep
    out = fresh(df, "language")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def made(off, data):
        m = shared.value
        n = len(off) - 1
        if not m.langs:
            return [["und"] * n, np.zeros(n), np.zeros(n)]
        bits = m.bits(off, data)
        best = bits.argmin(axis=1)
        least = bits[np.arange(n), best]
        score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
        names = np.asarray(m.langs, object)[best]
        size = np.maximum(np.diff(off), 1)
        return [names, score, least / size]

    found = annotate(df, text, made, "lang string, score double, bits double", keep, out)
    return found, out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, as the module says.

    Null and empty texts, and those without a letter, are ``und`` with score 0; rows with null lang teach nothing; a null doc_id
    is not held out; rows with one id and repeated rows each give a row; whole texts count, whatever their length; an empty table
    gives no rows; other columns aren't read.
    """
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.where(~held_out).select("lang", "text"))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"), has_letter(F.col("text")).alias("letter"))
    found, at = identify(docs, model, keep=["doc_id", "held_out", "letter"])
    lang, score = F.col(f"{at}.lang"), F.col(f"{at}.score")
    return found.select("doc_id", "held_out", F.when(F.col("letter"), lang).otherwise(F.lit("und")).alias("lang_pred"), F.when(F.col("letter") & (lang != "und"), F.round(score, 6)).otherwise(F.lit(0.0)).alias("score"))



def _crc_table() -> list[int]:
    made = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        made.append(i)
    return made


def _sql(order: int = ORDER) -> str:
    """The same model: n-grams are hexadecimal digits, each order has its counts, and code lengths are added up over escapes."""
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1]::bigint)), 4294967295)"
    tables, joins, cost = [], [], "CASE WHEN s0.n IS NOT NULL THEN -log2(s0.n / (t0.total + t0.kinds)) ELSE 8 - log2(t0.kinds / (t0.total + t0.kinds)) END"
    for k in range(order + 1):
        tables.append(f"g{k} AS MATERIALIZED (SELECT lang, right(g, {2 * k + 2}) AS g, sum(n) AS n FROM c GROUP BY 1, 2), c{k} AS MATERIALIZED (SELECT lang, left(g, {2 * k}) AS g, sum(n) AS total, count(*) AS kinds FROM g{k} GROUP BY 1, 2)")
        joins.append(f"LEFT JOIN g{k} s{k} ON s{k}.lang = l.lang AND s{k}.g = right(a.g, {2 * k + 2}) LEFT JOIN c{k} t{k} ON t{k}.lang = l.lang AND t{k}.g = substring(a.g, {2 * (order - k) + 1}, {2 * k})")
        if k:
            cost = f"CASE WHEN s{k}.n IS NOT NULL THEN (-log2(s{k}.n / (t{k}.total + t{k}.kinds)))::float::double ELSE coalesce((-log2(t{k}.kinds / (t{k}.total + t{k}.kinds)))::float::double, 0) + ({cost}) END"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text, coalesce(({crc}) % 4 = 2, false) AS held_out FROM documents),
blocks AS (SELECT k, substring(x, 2000 * n + 1, {2000 + 2 * order}) AS x FROM (SELECT k, '{'20' * order}' || hex(encode(text)) AS x FROM d WHERE text <> ''), LATERAL (SELECT unnest(range(0, length(x) // 2000 + 1)) AS n)),
w AS MATERIALIZED (SELECT k, substring(x, 2 * i + 1, {2 * order + 2}) AS g, count(*) AS n FROM blocks, LATERAL (SELECT unnest(range(0, length(x) // 2 - {order})) AS i) GROUP BY 1, 2),
c AS MATERIALIZED (SELECT lang, g, sum(n) AS n FROM w JOIN d USING (k) WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2),
{', '.join(tables)},
l AS (SELECT DISTINCT lang FROM c), a AS (SELECT DISTINCT g FROM w),
b AS MATERIALIZED (SELECT l.lang, a.g, {cost} AS bits FROM a CROSS JOIN l {' '.join(joins)}),
t AS (SELECT w.k, b.lang, sum(w.n * b.bits) AS bits FROM w JOIN b ON w.g = b.g GROUP BY 1, 2),
m AS (SELECT k, min(bits) AS least FROM t GROUP BY k),
p AS (SELECT t.k, min(CASE WHEN bits = least THEN lang END) AS lang, 1 / sum(pow(2, greatest(least - bits, -1000))) AS score FROM t JOIN m USING (k) GROUP BY t.k)
SELECT doc_id, held_out, CASE WHEN regexp_matches(text, '\\p{{L}}') THEN coalesce(p.lang, 'und') ELSE 'und' END AS lang_pred, CASE WHEN regexp_matches(text, '\\p{{L}}') AND p.lang IS NOT NULL THEN round(score, 6) ELSE 0.0 END AS score FROM d LEFT JOIN p USING (k)
"""


OP5_SQL = _sql()


__all__ = ["Model", "counts", "identify", "learn", "op5_language_id"]
