"""Benchmark decontamination by size-partitioned MinHash containment search (operator 6).

Short test items are sought inside long documents.  Words are runs of letters, digits and non-ASCII characters in lower
case; an item or document is its set of shingles of five words.  A containment threshold only turns into a usable
Jaccard threshold if both sizes are near each other, so items of 17 shingles and more are partitioned by size (up to
u = 32, 64, 128 ... shingles) and for each partition documents are read as overlapping windows of 2u shingles, u apart: an item of the
partition that occurs in a document lies whole in one window of at most four times its size.  Windows and items get
``k`` minimum hashes each; any agreement makes a candidate (with k = 64 an item that fills a quarter of its window is
missed with a chance of 0.75^64 = 1e-8, one that is there to four fifths 0.8^64 = 6e-7).  Items of up to 16 shingles
would fill too little of a window; they are looked up by shingles instead, as many of each (its rarest) as a document
at the threshold can't all lack, so none is missed.  Candidates are verified exactly:
the share of the item's shingles, as words, that the document has must reach the threshold.

Items are the query set: they are read in blocks of a bounded number of bytes, and documents are scanned once for each block
without a shuffle.  A block's index is broadcast; it has the items' texts, eight bytes a shingle and ``k`` hashes an item, by
measurement under ``EXPANDED`` times the bytes of text, besides bit tables of some megabytes.  Null and empty texts, and items of fewer than five words, match nothing.  Repeated documents each
give their rows; repeated items too.  Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.bytesets import PUNCTUATION, U, blocks, folded, prefix, shingles, span_hash, words
from quillon.llm.rows import bounded, read

#: Shingles of the smallest size partition; items of up to half as many are looked up by their shingles.
LEAST = 32
#: Bytes of item text that one scan of the documents looks for.
ITEM_BYTES = 16 << 20
#: What an index takes at most for each byte that ITEM_BYTES counts.
EXPANDED = 12
#: Items whose shingles a task keeps as words from one verification to the next.
KEPT = 1000


def _shingles(off: np.ndarray, data: np.ndarray, n: int):
    """(hash, text index) of runs of n words, and the words' spans; texts with fewer words have none."""
    start, end, doc = words(off, data, PUNCTUATION)
    if len(doc) < n:
        return np.zeros(0, U), np.zeros(0, np.int64), (start, end, doc)
    sh, of = shingles(span_hash(prefix(data), start, end), doc, n)
    enough = np.bincount(doc, minlength=len(off) - 1)[of] >= n
    return sh[enough], of[enough], (start, end, doc)


def _grams(text: bytes, n: int) -> set[bytes]:
    """The shingles of a folded text as words."""
    data = np.frombuffer(text, np.uint8)
    start, end, _ = words(np.array([0, len(data)]), data, PUNCTUATION)
    w = [text[a:b] for a, b in zip(start, end, strict=True)]
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


class Index:
    """Items with their minimum hashes, by size."""

    def __init__(self, items: list[tuple[object, str | None]], n: int, k: int, threshold: float):
        self.n, self.k, self.threshold = n, k, threshold
        self.odd = np.random.default_rng(6).integers(0, 1 << 62, k, dtype=U) * U(2) + U(1)
        self.ids, self.texts, self.hashes = [], [], []
        self._words: dict[int, set[bytes]] = {}
        parts: dict[int, list[int]] = {}
        small: list[int] = []
        for key, text in items:
            data = folded(np.frombuffer((text or "").encode(), np.uint8))
            sh = np.unique(_shingles(np.array([0, len(data)]), data, n)[0])
            if len(sh):
                if 2 * len(sh) <= LEAST:
                    small.append(len(self.ids))
                else:
                    u = LEAST
                    while u < len(sh):
                        u *= 2
                    parts.setdefault(u, []).append(len(self.ids))
                self.ids.append(key)
                self.texts.append(data.tobytes())
                self.hashes.append(sh)
        self._look_up(small)
        self.tables = {}
        for u, members in parts.items():
            values = np.stack([(self.hashes[i][:, None] * self.odd).min(axis=0) for i in members])
            seen = np.zeros((k, 1 << 16), bool)
            for j in range(k):
                seen[j, self._bits(values[:, j])] = True
            by = np.argsort(values, axis=0, kind="stable")
            self.tables[u] = (np.array(members), seen, np.take_along_axis(values, by, 0), by)

    def grams(self, i: int) -> set[bytes]:
        """The shingles of an item as words."""
        if i not in self._words:
            if len(self._words) >= KEPT:
                self._words.clear()
            self._words[i] = _grams(self.texts[i], self.n)
        return self._words[i]

    def _look_up(self, small: list[int]) -> None:
        """Sorted keys of the small items, and whose each is."""
        if not small:
            self.keys = np.zeros(0, U)
            return
        every, often = np.unique(np.concatenate([self.hashes[i] for i in small]), return_counts=True)
        keys, of = [], []
        for i in small:
            h = self.hashes[i]
            lacking = len(h) - max(1, math.ceil(self.threshold * len(h) - 1e-9))
            keys.append(h[np.argsort(often[np.searchsorted(every, h)], kind="stable")[: max(0, lacking) + 1]])
            of.append(np.full(len(keys[-1]), i))
        both, of = np.concatenate(keys), np.concatenate(of)
        order = np.argsort(both, kind="stable")
        self.keys, self.key_of = both[order], of[order]
        self.shift = U(64 - min(24, max(16, int(8 * len(order)).bit_length())))
        self.key_seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.key_seen[(self.keys >> self.shift).astype(np.int64)] = True

    def _small(self, sh: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """Pairs (text index, small item) that share a key."""
        if not len(self.keys):
            return set()
        hit = np.flatnonzero(self.key_seen[(sh >> self.shift).astype(np.int64)])
        a = np.searchsorted(self.keys, sh[hit], "left")
        n = np.searchsorted(self.keys, sh[hit], "right") - a
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        return set(zip(np.repeat(doc[hit], n).tolist(), self.key_of[at].tolist(), strict=True))

    @staticmethod
    def _bits(v: np.ndarray) -> np.ndarray:
        return ((v >> U(24)) & U(0xFFFF)).astype(np.int64)

    def candidates(self, sh: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """Pairs (text index, item) that share a key, or agree in a minimum hash of a window."""
        found = self._small(sh, doc)
        if not len(sh) or not self.tables:
            return found
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, len(doc)])
        text = doc[first]
        per = -(-count // LEAST)
        of = np.repeat(np.arange(len(first)), per)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        cut = first[of] + nth * LEAST
        finest = np.empty((self.k, len(cut)), U)
        for j in range(self.k):
            np.minimum.reduceat(sh * self.odd[j], cut, out=finest[j])
        for u in sorted(self.tables):
            members, seen, values, by = self.tables[u]
            step = u // LEAST
            at = np.flatnonzero(nth % step == 0)
            low = np.minimum.reduceat(finest, at, axis=1) if step > 1 else finest
            mine = of[at]
            window = low.copy()
            joins = np.flatnonzero(mine[1:] == mine[:-1])
            window[:, joins] = np.minimum(low[:, joins], low[:, joins + 1])
            for j in range(self.k):
                v = window[j]
                hit = np.flatnonzero(seen[j, self._bits(v)])
                if not len(hit):
                    continue
                a = np.searchsorted(values[:, j], v[hit], "left")
                b = np.searchsorted(values[:, j], v[hit], "right")
                for w in np.flatnonzero(b > a):
                    found |= {(int(text[mine[hit[w]]]), int(members[i])) for i in by[a[w] : b[w], j]}
        return found

    def search(self, off: np.ndarray, data: np.ndarray) -> list[tuple[int, int, float]]:
        """(text index, item, containment) of every item that a text has."""
        data = folded(data)
        sh, doc, _ = _shingles(off, data, self.n)
        out = []
        grams: tuple[int, set[bytes]] = (-1, set())
        last, own = -1, sh
        for t, i in sorted(self.candidates(sh, doc)):
            if last != t:
                last, own = t, np.unique(sh[np.searchsorted(doc, t) : np.searchsorted(doc, t, "right")])
            at = np.minimum(np.searchsorted(own, self.hashes[i]), len(own) - 1)
            if (own[at] == self.hashes[i]).mean() < self.threshold:
                continue
            if grams[0] != t:
                grams = t, _grams(data[off[t] : off[t + 1]].tobytes(), self.n)
            item = self.grams(i)
            share = len(item & grams[1]) / len(item)
            if share >= self.threshold:
                out.append((t, i, share))
        return out


def unsearchable(items: DataFrame, item: str = "item_id", item_text: str = "text", n: int = 5) -> DataFrame:
    """(item, words) of items with fewer than n words, null and empty ones too: they have no shingle, so nothing is found for them.

    Scripts without spaces count a run of characters as one word.
    """
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(item_text).cast("string"), F.lit("")), F.lit(r"[A-Za-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0)))
    return items.select(F.col(item).alias("item"), words.alias("words")).where(F.col("words") < n)


def _item_blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of about ITEM_BYTES."""
    total = items.agg(F.sum(F.octet_length(text) + 100)).first()[0] or 0
    n = total // ITEM_BYTES + 1
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == i)
        yield [tuple(r) for r in part.select(item, text).toLocalIterator()]


def contained(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.8, n: int = 5, k: int = 64) -> DataFrame:
    """(doc, item, containment) for each item that a document has at the threshold or above."""
    bounded(docs.sparkSession)
    names = ["doc", "item", "containment"]
    schema = T.StructType([T.StructField("doc", docs.schema[doc].dataType), T.StructField("item", items.schema[item].dataType), T.StructField("containment", T.DoubleType())])
    kind = {f.name: f.dataType for f in schema.fields}
    from pyspark.sql.pandas.types import to_arrow_type

    narrow, found = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")), None
    for block in _item_blocks(items, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, n, k, threshold))

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part, off, data in blocks(batch, "text"):
                    hits = index.search(off, data)
                    if hits:
                        yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array([t for t, _, _ in hits])), pa.array([index.ids[i] for _, i, _ in hits], to_arrow_type(kind["item"])), pa.array([s for _, _, s in hits])], names=names)

        part = narrow.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document contains, as the module says.

    Null and empty texts, and items of under five words, match nothing; null ids stay null; rows with one id and repeated rows
    each give their rows; whole texts are searched, whatever their length; empty tables give no rows; other columns aren't read.
    """
    made = contained(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return made.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("containment", 6).alias("containment"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
OP6_SQL = f"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+') FROM benchmark
), g AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5
), q AS (SELECT id, count(*) AS n FROM g WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, round(count(*) / any_value(q.n), 6) AS containment
FROM g d JOIN g i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' JOIN q ON q.id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(q.n)
"""
