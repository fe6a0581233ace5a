"""Removal of repeated substrings with suffix arrays (operator 2).

A byte goes if a string of ``least`` bytes that covers it also starts earlier: in a document with a smaller id, or in the same
one before.  Strings are judged on the input; matches never cross documents.

1. Whole copies: of equal texts only the one with the least id is searched; the others go whole (one row per text and id is
   shuffled, combined before).  Rows that repeat both id and text lose the same; one of them is searched for all.
2. Shards: each task sorts all suffixes of a megabyte or two of documents, or of a part of one longer document
   (Larsson-Sadakane); Kasai's common prefixes give the classes of equal strings of ``least`` bytes, and all but the
   earliest of a class in the shard are marked there.
3. Anchors: what is left are the earliest strings of each shard.  Every string contains an anchor, its least-hashed run of
   ``K`` bytes; neighbours with the same anchor form a stretch.  Stretches are brought together by their anchor's hash.
   A stretch equal to an earlier one goes whole.  Anchors of very many stretches (``COMMON`` or more, estimated from a
   sample) would fill one task; each of their strings is brought together with its equals by its own hash, and at most once from
   a shard.
4. Merging: where stretches with one anchor differ, the strings of each distinct stretch are looked up, by binary search, in
   the sorted strings of those before.

So each text is read a bounded number of times and shards are never compared in pairs: the shuffle holds about one row for 40
bytes.  Equality of strings across shards is that of 128 bits of hashes (within a shard it is exact).

Null text counts as empty.  Ids only order rows; what goes is kept by row, told apart by id and 64 bits of the text's hash.  Null
ids come after all others.  In rows with the same id (or none) strings are ordered by their start alone, and those at the same start are
not earlier than each other.  Repeated rows each give a row.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.bytesets import U, blocks, buffers, mix, powers, prefix, span_hash
from quillon.llm.rows import bounded, cut, read
from quillon.llm.suffix import byte_suffix_array, common_prefixes

LEAST, K = 100, 20
SHARD = 1_500_000
_LAST = (1 << 63) - 1
#: Ids of whole copies that are sent to all tasks at most; more are joined.
BROADCAST_ROWS = 200_000
#: Stretches from which an anchor is common, and the part of documents in which they are counted.
COMMON, ONE_IN = 20_000, 32


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of x over windows of w."""
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - have : len(x) - w + 1 + w - have]) if have < w else m


def _spans(start: np.ndarray, least: int) -> np.ndarray:
    """(from, to) rows of the union of [start, start + least) for ascending starts."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    new = np.r_[True, start[1:] > start[:-1] + least]
    at = np.flatnonzero(new)
    return np.stack([start[at], start[np.r_[at[1:] - 1, len(start) - 1]] + least], axis=1)


def segments(off: np.ndarray, data: np.ndarray, least: int, shard: int):
    """Shards (first text, off, data, base): whole texts, or part of one that is longer than a shard.

    Parts of a text overlap by least - 1 bytes, so every string lies whole in one of them; base is where a part starts.
    """
    i, n = 0, len(off) - 1
    while i < n:
        size = int(off[i + 1] - off[i])
        if size <= shard:
            j = max(i + 1, int(np.searchsorted(off, off[i] + shard, "right")) - 1)
            yield i, off[i : j + 1] - off[i], data[off[i] : off[j]], 0
            i = j
        else:
            for base in range(0, size - least + 1, shard):
                part = data[off[i] + base : min(off[i + 1], off[i] + base + shard + least - 1)]
                yield i, np.array([0, len(part)]), part, base
            i += 1


def search(ids: np.ndarray, off: np.ndarray, data: np.ndarray, least: int = LEAST, k: int = K, common: np.ndarray = np.zeros(0, np.int64)):
    """What a shard finds: removed (text, from, to) and stretches (anchor, content, text, start, windows).

    ids: the documents' ids; texts stand in any order; common: anchors whose strings come one by one.
    """
    n = len(data)
    none = np.zeros((0, 3), np.int64)
    if n < least:
        return none, np.zeros((0, 5), np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.arange(n) - off[text]
    valid = at + least <= np.diff(off)[text]
    # The earliest of each class: rank documents by id, then by start.
    sa, tied = byte_suffix_array(off, data, least)
    lcp = common_prefixes(data, text, sa, tied)
    same = lcp >= least
    removed = np.zeros(n, bool)
    if same.any():
        _, rank = np.unique(ids, return_inverse=True)
        member = same.copy()
        member[:-1] |= same[1:]
        slots = np.flatnonzero(member)
        head = ~same[slots]
        pos = sa[slots]
        key = rank[text[pos]] * (n + 1) + at[pos]
        first = np.minimum.reduceat(key, np.flatnonzero(head))
        removed[pos[key > first[np.cumsum(head) - 1]]] = True
    del sa, tied, lcp, same
    out = []
    gone = np.flatnonzero(removed)
    if len(gone):
        s = _spans(gone + text[gone] * least, least)  # texts are moved apart so that spans of two never join
        t = text[gone[np.searchsorted(gone + text[gone] * least, s[:, 0])]]
        out = np.stack([t, s[:, 0] - t * least - off[t], s[:, 1] - t * least - off[t]], axis=1)
    return (out if len(out) else none), _stretches(off, data, text, at, valid, removed, least, k, common)


def _stretches(off: np.ndarray, data: np.ndarray, text: np.ndarray, at: np.ndarray, valid: np.ndarray, removed: np.ndarray, least: int, k: int, common: np.ndarray) -> np.ndarray:
    """(anchor, content, text, start, windows) of the strings of a shard that aren't removed, by stretches with one anchor.

    Strings with one of the anchors in ``common`` (sorted) come one by one, each with its own hashes for anchor and content.
    """
    n = len(data)
    sums = prefix(data)
    inverse = powers(n + 1)[1]
    h = sums[k:] - sums[:-k]
    h *= inverse[: n - k + 1]
    h = mix(h)
    bits = int(n).bit_length()
    packed = (h >> U(bits)) << U(bits)
    packed |= np.arange(n - k + 1, dtype=U)
    low = _sliding_min(packed, least - k + 1)
    anchor = (low & U((1 << bits) - 1)).astype(np.int64)
    del packed, low
    start = np.flatnonzero(valid[: n - least + 1])
    if not len(start):
        return np.zeros((0, 5), np.int64)
    a = anchor[start]
    new = np.r_[True, (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)]
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, len(start)])
    # A stretch all of whose strings start earlier in the shard has nothing new for others.
    fresh = size > np.add.reduceat(removed[start].astype(np.int64), head)
    single = np.zeros((0, 5), np.int64)
    if len(common):
        spread = np.isin(h[a[head]].view(np.int64), common)
        s = start[np.repeat(spread, size) & ~removed[start]]
        half = s + least // 2
        second = span_hash(sums, s, half) ^ mix(span_hash(sums, half, s + least) + U(1))
        single = np.stack([span_hash(sums, s, s + least).view(np.int64), second.view(np.int64), text[s], at[s], np.ones(len(s), np.int64)], axis=1)
        fresh &= ~spread
    head, size = head[fresh], size[fresh]
    s, i = start[head], a[head]
    content = span_hash(sums, s, s + size + least - 1) ^ mix((i - s).astype(U) * U(0x9E3779B97F4A7C15) + size.astype(U))
    return np.concatenate([np.stack([h[i].view(np.int64), content.view(np.int64), text[s], at[s], size], axis=1), single])


def common_anchors(docs: DataFrame, least: int = LEAST, k: int = K, shard_bytes: int = SHARD, rows: int = COMMON, one_in: int = ONE_IN, most: int = BROADCAST_ROWS) -> np.ndarray:
    """The anchors, sorted, of about ``rows`` or more stretches of docs (key, text), by a count over one document in ``one_in``.

    They only decide by what name strings are brought together, not which are found.  Of more than ``most`` the commonest are named.
    """

    def anchors(batches):
        for batch in batches:
            for _, off, data, _ in segments(*buffers(batch.column("text")), least, shard_bytes):
                n = len(data)
                text = np.repeat(np.arange(len(off) - 1), np.diff(off))
                at = np.arange(n) - off[text]
                made = _stretches(off, data, text, at, at + least <= np.diff(off)[text], np.zeros(n, bool), least, k, np.zeros(0, np.int64)) if n >= least else np.zeros((0, 5), np.int64)
                # Equal stretches of a shard would come once.
                anchor, times = np.unique(np.unique(made[:, :2], axis=0)[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(times.astype(np.int64))], names=["anchor", "n"])

    some = docs.where((F.octet_length("text") >= least) & (F.pmod(F.xxhash64("key", F.octet_length("text")), F.lit(one_in)) == 0))
    counted = some.select("text").mapInArrow(anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") * one_in >= rows)
    return np.array(sorted(r["anchor"] for r in counted.orderBy(F.desc("n"), "anchor").limit(most).collect()), np.int64)


def _lookup(state: list[np.ndarray], group: np.ndarray, doc: np.ndarray, first: np.ndarray, off: np.ndarray, data: np.ndarray, least: int) -> np.ndarray:
    """Merges strings of sorted stretches: which windows of the given contexts occur in an earlier one.

    Contexts come by (group, doc, first); ``state`` keeps the last group, its sorted strings and where each is first for what follows.
    """
    sums = prefix(data)
    size = np.diff(off) - least + 1
    row = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    start = off[row] + nth
    w = span_hash(sums, start, start + least)
    w ^= mix(group[row].astype(np.int64).view(U))
    d, s = doc[row], first[row] + nth
    order = np.lexsort((s, d, w))
    new = np.r_[True, w[order][1:] != w[order][:-1]] if len(order) else np.zeros(0, bool)
    head = order[new]  # the earliest of each string
    run = np.cumsum(new) - 1
    # Equal strings at the same start under the same id are not earlier than each other.
    seen = np.zeros(len(row), bool)
    seen[order] = (d[order] != d[head][run]) | (s[order] != s[head][run])
    if state and len(group) and state[0][0] == group[0]:
        mine = np.flatnonzero(group[row] == group[0])
        at = np.minimum(np.searchsorted(state[1], w[mine]), len(state[1]) - 1)
        seen[mine] |= (state[1][at] == w[mine]) & ((state[2][at] != d[mine]) | (state[3][at] != s[mine]))
    if len(group):
        tail = head[group[row[head]] == group[-1]]
        kept = [w[tail], d[tail], s[tail]]
        if state and state[0][0] == group[-1]:
            fresh = tail[~np.isin(w[tail], state[1])]
            kept = [np.r_[x, y[fresh]] for x, y in zip(state[1:], (w, d, s), strict=True)]
            order = np.argsort(kept[0], kind="stable")
            kept = [x[order] for x in kept]
        state[:] = [group[-1:], *kept]
    return seen


def _ordered(ids: Column) -> Column:
    return F.coalesce(ids.cast("long"), F.lit(_LAST))


def repeats(df: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, shard_bytes: int = SHARD, common_rows: int = COMMON, one_in: int = ONE_IN) -> tuple[DataFrame, DataFrame]:
    """(docs, spans): docs has (id, key, row, text, whole), spans (key, row, spans: sorted array of from, to) of what goes.

    ``whole`` marks copies of texts that are kept elsewhere; they have no spans.
    """
    spark = df.sparkSession
    bounded(spark)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = df.select(F.col(doc).alias("id"), _ordered(F.col(doc)).alias("key"), t.alias("text"), F.unhex(F.md5(t)).alias("twin"))
    docs = docs.withColumn("row", F.xxhash64("twin"))
    twins = docs.where(F.octet_length("text") >= least).groupBy("twin", "key").agg(F.count("*").alias("n")).groupBy("twin").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min_by("n", "key").alias("n"))
    twins = cut(twins.where("first < last or n > 1").select("twin", "first", (F.col("n") > 1).alias("again")))
    few, again = twins.count() <= BROADCAST_ROWS, not twins.where("again").isEmpty()
    docs = docs.join(F.broadcast(twins) if few else twins, "twin", "left").select("id", "key", "row", "text", F.coalesce(F.col("key") > F.col("first"), F.lit(False)).alias("whole"), F.coalesce("again", F.lit(False)).alias("again"))
    searched = docs.where("not whole").where(F.octet_length("text") >= least).select("key", "row", "text", "again")
    if again:  # else each of m such rows would bring the stretches of all m
        searched = searched.where("not again").unionByName(cut(searched.where("again").dropDuplicates(["key", "row"])))
    searched, docs = searched.drop("again"), docs.drop("again")
    names = ["anchor", "content", "key", "row", "a", "b"]
    common = spark.sparkContext.broadcast(common_anchors(searched, least, K, shard_bytes, common_rows, one_in))

    def shard(batches):
        for batch in batches:
            keys, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "row"))
            for i, off, data, base in segments(*buffers(batch.column("text")), least, shard_bytes):
                ids, own = keys[i : i + len(off) - 1], marks[i : i + len(off) - 1]
                removed, rows = search(ids, off, data, least, K, common.value)
                removed[:, 1:] += base
                rows[:, 3] += base
                gone = [np.full(len(removed), 0, np.int64), np.full(len(removed), 0, np.int64), ids[removed[:, 0]], own[removed[:, 0]], removed[:, 1], -removed[:, 2]]
                # Removed spans ride along, spread by their document, and are told apart by b < 0.
                gone[0] = mix(gone[3].astype(np.int64).view(U) + removed[:, 1].astype(U)).view(np.int64)
                made = [rows[:, 0], rows[:, 1], ids[rows[:, 2]], own[rows[:, 2]], rows[:, 3], rows[:, 4]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y]).astype(np.int64)) for x, y in zip(gone, made, strict=True)], names=names)

    found = searched.mapInArrow(shard, "anchor long, content long, key long, row long, a long, b long")
    by = Window.partitionBy("anchor").orderBy("content", "key", "a")
    everywhere = Window.partitionBy("anchor").orderBy("content", "key", "a").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.col("b") > 0
    judged = (
        found.withColumn("before", F.lag(F.struct("content", "key", "a", one.alias("one"))).over(by))
        .withColumn("low", F.min(F.when(one, F.col("content"))).over(everywhere))
        .withColumn("high", F.max(F.when(one, F.col("content"))).over(everywhere))
    )
    twin = F.coalesce(F.col("before.one") & (F.col("before.content") == F.col("content")), F.lit(False))
    # The same start of the same document (rows with one id) is not earlier.
    late = twin & ~((F.col("before.key") == F.col("key")) & (F.col("before.a") == F.col("a")))
    judged = judged.select("anchor", "key", "row", "a", "b", F.when(~one | late, F.lit(0)).when(F.col("low") < F.col("high"), F.lit(1)).alias("kind")).where("kind is not null")
    judged = cut(judged)
    spans = judged.where("kind = 0").select("key", "row", "a", F.when(F.col("b") < 0, -F.col("b")).otherwise(F.col("a") + F.col("b") + (least - 1)).alias("b"))
    wanted = judged.where("kind = 1").groupBy("key", "row").agg(F.collect_list(F.struct("anchor", "a", "b")).alias("stretches"))

    def contexts(batches):
        for batch in batches:
            lists = batch.column("stretches")
            off, data = buffers(batch.column("text"))
            keys, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "row"))
            lo = np.asarray(lists.offsets)
            flat = lists.values
            anchor, a, b = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            which = np.repeat(np.arange(len(keys)), np.diff(lo))
            anchor, a, b = anchor[lo[0] : lo[-1]], a[lo[0] : lo[-1]], b[lo[0] : lo[-1]]
            s = off[which] + a
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(keys[which]), pa.array(marks[which]), pa.array(a), pa.array([raw[x : x + y + least - 1] for x, y in zip(s.tolist(), b.tolist(), strict=True)], pa.binary())], names=["anchor", "key", "row", "a", "context"])

    def merge(batches):
        state: list[np.ndarray] = []
        for batch in batches:
            for part, off, data in blocks(batch, "context", SHARD):
                anchor, key, mark, a = (part.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "key", "row", "a"))
                seen = _lookup(state, anchor, key, a, off, data, least)
                size = np.diff(off) - least + 1
                row = np.repeat(np.arange(len(size)), size)[seen]
                nth = (np.arange(len(seen)) - np.repeat(np.cumsum(size) - size, size))[seen]
                # Neighbouring starts of one stretch become one span.
                new = np.r_[True, (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)] if len(row) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                stop = np.r_[at[1:] - 1, len(row) - 1] if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(key[row[at]]), pa.array(mark[row[at]]), pa.array(a[row[at]] + nth[at]), pa.array(a[row[stop]] + nth[stop] + least)], names=["key", "row", "a", "b"])

    places = searched.join(wanted, ["key", "row"]).mapInArrow(contexts, "anchor long, key long, row long, a long, context binary")
    merged = places.repartition("anchor").sortWithinPartitions("anchor", "key", "a").mapInArrow(merge, "key long, row long, a long, b long")
    spans = spans.unionByName(merged).groupBy("key", "row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return docs, cut(spans)


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs."""
    runs: list[list[int]] = []
    for a, b in spans:
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out), [(a, b) for a, b in runs]


def deduplicate(df: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, shard_bytes: int = SHARD, common_rows: int = COMMON, one_in: int = ONE_IN) -> DataFrame:
    """(id, n_bytes, runs: array of from, to; kept: binary) of every row."""
    docs, spans = repeats(df, doc, text, least, shard_bytes, common_rows, one_in)
    kind = df.schema[doc].dataType

    def run(batches):
        for batch in batches:
            lists = batch.column("spans").to_pylist()
            whole = batch.column("whole").to_pylist()
            off, data = buffers(batch.column("text"))
            raw = data.tobytes()
            n, runs, kept = [], [], []
            for i, (s, w) in enumerate(zip(lists, whole, strict=True)):
                x = raw[off[i] : off[i + 1]]
                left, gone = _kept(x, [(0, len(x))] if w else [(d["a"], d["b"]) for d in s or ()])
                n.append(len(x))
                runs.append([{"a": a, "b": b} for a, b in gone])
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "runs", "kept"])

    return docs.join(spans, ["key", "row"], "left").select("id", "text", "whole", "spans").mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, runs array<struct<a:long,b:long>>, kept binary")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when repeated strings of 100 bytes are removed, as the module says.

    Null and empty texts, and those under 100 bytes, lose nothing; a null doc_id stays null and comes after all others; rows with
    one id are rows of their own; texts longer than a shard are searched in overlapping parts; an empty table gives no rows; other
    columns aren't read.
    """
    made = deduplicate(read(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return made.select(F.col("id").alias("doc_id"), "n_bytes", removed.cast("long").alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))




#: Texts as hexadecimal digits; strings are cut from blocks of a thousand bytes, as a place in a long text is reached from its start.
OP2_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT k, coalesce(doc_id, 9223372036854775807) AS id, n * 1000 AS base, substring(x, 2000 * n + 1, 2198) AS x FROM d, LATERAL (SELECT unnest(range(0, length(x) // 2000 + 1)) AS n)),
w AS (SELECT k, id, base + i AS a, md5_number(substring(x, 2 * i + 1, 200)) AS h FROM blocks, LATERAL (SELECT unnest(range(0, least(1000, length(x) // 2 - 99))) AS i)),
f AS (SELECT h, min((id, a)) AS first FROM w GROUP BY h HAVING count(*) > 1),
late AS (SELECT w.k, w.a FROM w JOIN f ON w.h = f.h WHERE (w.id, w.a) > f.first),
e AS (SELECT k, a, coalesce(a > lag(a) OVER (PARTITION BY k ORDER BY a) + 100, true) AS new FROM late),
s AS (SELECT k, min(a) AS a, max(a) + 100 AS b FROM (SELECT k, a, sum(new::int) OVER (PARTITION BY k ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM e) GROUP BY k, run),
p AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM s),
r AS (SELECT p.k, sum(p.b - p.a) AS n_removed, count(*) AS n_spans, string_agg(substring(d.x, 2 * p.before + 1, 2 * (p.a - p.before)), '' ORDER BY p.a) AS head, max(p.b) AS last FROM p JOIN d USING (k) GROUP BY p.k)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substring(d.x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN r USING (k)
"""
