"""Near duplicates by DartMinHash (operator 4).

A text is the weighted set of its five-word shingles.  Hashed darts fall, as a Poisson process in rank, into the region
of every element (one unit cell for each unit of weight: each distinct shingle weighs 1, or its count with
``weights="count"``); each dart aims at one of ``k`` coordinates and the earliest one at each coordinate is the
signature.  Two texts agree at a coordinate with a chance equal to their (weighted) Jaccard similarity.  Since few darts
are thrown below a rank that shrinks with the text's weight, the work is that of the shingles plus k log k.

Bands of ``rows`` coordinates are joined; candidates are verified by exact similarity of their shingle sets, and
classes are the connected components of pairs at ``threshold`` or above:

1. equal texts are one class before anything else (a count and a minimum per text, combined before the shuffle);
2. in each bucket every member is compared with one leader only;
3. after components of these links, only members of different components that share a bucket are compared: each with each in
   buckets of up to ``FAN`` such members; in larger ones only pairs that also share one of their rarest shingles, as
   any pair at the threshold must.  How many of the rarest is set by both sizes (in bands of ``STEP``): sets of n and m shingles at
   threshold t share at least o = t (n + m) / (1 + t), and so one of the n - o + 1 rarest of the one and of the m - o + 1 rarest of
   the other.

So every candidate pair is verified, known to be of one class or known to be below the threshold; no link between classes is lost.
A passage that fills the buckets of many texts makes no pairs of them: its shingles are among the rarest of two texts only where
the passage alone makes the two (nearly, by one band) alike enough.  Each text then gives some hundred rows and no pair.

Null text counts as empty.  Equal texts share a class even without words; otherwise a text without words is like none.
Texts of one to four words have one shingle, all their words.  Rows with a null id belong to the class of their text,
and have a null class if no row with that text has an id.  Repeated rows each give a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.bytesets import U, mix, per_text, shingles, word_hashes
from quillon.llm.components import components
from quillon.llm.rows import annotate, cut, read

_GOLD = U(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
#: Ids that are sent to all tasks at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Members of different components up to which all of a bucket are compared.
FAN = 32
#: The ratio of sizes that is one band; a text of n shingles is compared with bands up to n / threshold.
STEP = 1.03


def cells(sh: np.ndarray, doc: np.ndarray, weights: str = "set") -> np.ndarray:
    """A hash for each unit of weight: with "count", a shingle's second occurrence in a text is another cell."""
    if weights == "set":
        return sh  # the same cell twice throws the same darts
    order = np.lexsort((sh, doc))
    s, d = sh[order], doc[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])] if len(s) else np.zeros(0, bool)
    i = np.arange(len(s))
    nth = np.empty(len(s), U)
    nth[order] = (i - np.maximum.accumulate(np.where(new, i, 0))).astype(U)
    return mix(sh + nth * _GOLD)


def signatures(cell: np.ndarray, doc: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) earliest darts of n texts; zeros for texts without cells."""
    made = np.zeros((n, k), U)
    weight = per_text(n, doc)
    area = np.full(n, k * (math.log(k) + 3.0))
    todo = weight > 0
    while todo.any():
        reach = np.where(todo, area / np.maximum(weight, 1), 0.0)
        at = np.flatnonzero(todo[doc])
        c, d = cell[at], doc[at]
        rank, limit, j = np.zeros(len(at)), reach[d], 0
        ranks, keys, darts = [], [], []
        while len(c):
            j += 1
            x = mix(c + U(j * int(_GOLD) & _MASK))
            rank = rank - np.log(((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53)
            live = rank <= limit
            c, d, rank, limit, x = c[live], d[live], rank[live], limit[live], x[live]
            x = mix(x + U(0x632BE59BD9B4E019))
            ranks.append(rank)
            keys.append(d * k + (x % U(k)).astype(np.int64))
            darts.append(x | U(1))
        order = np.argsort(np.concatenate(ranks))[::-1]
        flat = made.reshape(-1)
        flat[np.concatenate(keys)[order]] = np.concatenate(darts)[order]  # the earliest is written last
        todo &= (made == 0).any(axis=1)
        made[todo] = 0
        area = np.where(todo, area * 2, area)
    return made


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band; the band's number is part of it."""
    n, k = signature.shape
    b = k // rows
    part = signature[:, : b * rows].reshape(n, b, rows)
    h = np.broadcast_to(np.arange(1, b + 1).astype(U) * _GOLD, (n, b)).copy()
    for i in range(rows):
        h = mix(h + part[:, :, i])
    return h.view(np.int64)


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, pa.int64()))


def _signed(n_words: int, k: int, rows: int, weights: str):
    def made(off, data):
        n = len(off) - 1
        sh, doc = shingles(*word_hashes(off, data), n_words)
        b = bands(signatures(cells(sh, doc, weights), doc, n, k), rows)
        return [_lists(b.reshape(-1), np.arange(n + 1) * b.shape[1]), per_text(n, doc)]

    return made


def _sets(n_words: int, weights: str):
    def made(off, data):
        n = len(off) - 1
        sh, doc = shingles(*word_hashes(off, data), n_words)
        x = cells(sh, doc, weights)
        order = np.lexsort((x, doc))
        x, doc = x[order], doc[order]
        if len(x):
            new = np.r_[True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])]
            x, doc = x[new], doc[new]
        return [_lists(x.view(np.int64), np.searchsorted(doc, np.arange(n + 1)))]

    return made


def identified(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(id, text, twin): twin is the same for equal texts alone."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(doc).alias("id"), t.alias("text"), F.unhex(F.md5(t)).alias("twin"))


def _across(members: DataFrame) -> DataFrame:
    """(a, b) of members (at, node, component) of different components at one place."""
    left = members.select("at", F.col("node").alias("a"), F.col("component").alias("ca"))
    right = members.select("at", F.col("node").alias("b"), F.col("component").alias("cb"))
    return left.join(right, "at").where("ca < cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _rare_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of sets (node, component, x) of different components that share one of as many of their rarest shingles as any pair at the threshold must.

    Sizes are in bands; a set gives its rarest shingles for each band of partners, as many as the least size of the band asks for.
    Shingles of one set alone count as rare and are left out of the join.
    """
    low = lambda band: F.ceil(F.lit(STEP) ** band - 1e-9)
    size = F.size("x")
    each = sets.select("node", "component", size.alias("n"), F.floor(F.log(size.cast("double")) / math.log(STEP) + 1e-9).cast("int").alias("band"), F.explode("x").alias("at"))
    common = each.groupBy("at").agg(F.count("*").alias("f"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("f", "at"))
    ranked = each.join(common, "at").withColumn("rank", rank).where((F.col("rank") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1) & (F.col("f") > 1))
    reach = math.ceil(math.log(1 / threshold) / math.log(STEP)) + 1

    def side(bands, name: str) -> DataFrame:
        """A set's rarest shingles for partners of each band."""
        spread = ranked.withColumn("other", F.explode(bands))
        least = F.greatest(F.ceil(threshold / (1 + threshold) * (F.col("n") + low(F.col("other"))) - 1e-6), F.lit(1))
        kept = spread.where(F.col("rank") <= F.col("n") - least + 1)
        smaller, larger = ("band", "other") if name == "a" else ("other", "band")
        return kept.select("at", F.col(smaller).alias("s"), F.col(larger).alias("l"), F.col("node").alias(name), F.col("component").alias(f"c{name}"), F.col("n").alias(f"n{name}"))

    # a is of the smaller band, or of the same one.
    left = side(F.sequence("band", F.col("band") + reach), "a")
    right = side(F.sequence(F.greatest(F.col("band") - reach, F.lit(0)), "band"), "b")
    pairs = left.join(right, ["at", "s", "l"]).where((F.col("ca") != F.col("cb")) & ((F.col("s") < F.col("l")) | (F.col("a") < F.col("b"))))
    pairs = pairs.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.8, n_words: int = 5, k: int = 96, rows: int = 4, weights: str = "set") -> DataFrame:
    """(id, twin, node, class_id) for each row of df: node is the least id of equal texts, class_id that of the class."""
    docs = identified(df, doc, text)
    signed = cut(annotate(docs, "text", _signed(n_words, k, rows, weights), "bands array<long>, n long", ["id", "twin"], "s").select("id", "twin", "s.*"))
    nodes = signed.groupBy("twin").agg(F.min("id").alias("node"), F.first(F.when(F.col("n") > 0, F.col("bands"))).alias("bands"))
    spread = nodes.where("node is not null and bands is not null").select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader"), F.max("node").alias("last")).where("n > 1 and leader <> last")
    members = cut(spread.join(shared.select("bucket", "leader"), "bucket"))
    chosen = members.select(F.col("node").alias("id")).distinct()
    sets = docs.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen, "id", "left_semi")
    sets = cut(annotate(sets, "text", _sets(n_words, weights), "x array<long>", ["id"], "s").select(F.col("id").alias("node"), F.col("s.x").alias("x")))

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs at the threshold or above, exactly."""
        small = sets.select("node", F.size("x").alias("n"))
        p = pairs.join(small.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(small.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        p = p.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select("a", "b").distinct()
        p = p.join(sets.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
        both = F.size(F.array_intersect("xa", "xb"))
        return p.where(both >= threshold * (F.size("xa") + F.size("xb") - both)).select("a", "b").distinct()

    star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(alike(star))
    first = components(links)
    placed = members.select("bucket", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    open_ = cut(placed.join(mixed, "bucket").distinct())
    sizes = open_.groupBy("bucket").agg(F.count("*").alias("members"))
    few = open_.join(sizes.where(F.col("members") <= FAN).select("bucket"), "bucket").select(F.col("bucket").alias("at"), "node", "component")
    crowd = open_.join(sizes.where(F.col("members") > FAN).select("bucket"), "bucket").select("node", "component").distinct()
    across = _across(few)
    if not crowd.isEmpty():
        across = across.unionByName(_rare_pairs(sets.join(crowd, "node"), threshold))
    across = across.distinct().join(star, ["a", "b"], "left_anti")
    more = cut(alike(across))
    if not more.isEmpty():
        second = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    else:
        second = first
    named = signed.groupBy("twin").agg(F.min("id").alias("node"))
    named = named.join(second, "node", "left").select("twin", "node", F.coalesce("component", "node").alias("class_id"))
    return signed.select("id", "twin").join(named, "twin")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document, as the module says.

    Null texts count as empty, and equal texts without words are one class; a null doc_id has the class of its text, or none;
    rows with one id and repeated rows each give a row; whole texts count, whatever their length; an empty table gives no rows; other
    columns aren't read.
    """
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", (F.col("node") != F.col("id")).alias("is_copy"), (F.col("class_id") != F.col("id")).alias("is_duplicate"))


OP4_SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY 1),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t WHERE id IS NOT NULL),
g AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.g = b.g AND a.id < b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id WHERE least(x.n, y.n) >= 0.8 * greatest(x.n, y.n)
  GROUP BY a.id, b.id HAVING count(*) >= 0.8 * (any_value(x.n) + any_value(y.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS id, a AS c FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a),
c AS (SELECT id, min(c) AS class_id FROM r GROUP BY id)
SELECT doc_id, coalesce(c.class_id, t.id) AS class_id, t.id <> doc_id AS is_copy, coalesce(c.class_id, t.id) <> doc_id AS is_duplicate
FROM documents d JOIN t ON coalesce(d.text, '') = t.text LEFT JOIN c ON c.id = t.id
"""
