"""Sharding by sampled splitters (operator 10), in DataFrame operations only.

Records get a key: high bits from the text, so equal texts are neighbours, middle bits from the id and low bits from the record's
place in the table, so even a text, or one row repeated, that holds a third of all records can be divided.

1. Keys are drawn with a chance in proportion to their record's size (by a hash of key and place, so a rerun draws the same).
2. Splitters are quantiles of the drawn keys at text boundaries: ``ranges`` ranges of about equal bytes.
3. Exact sizes of the ranges are summed; one that is overfull (beyond twice its share) is subdivided at drawn keys inside.
4. Neighbouring ranges form shards: each shard ends where the bytes so far come nearest to its share (law ``bytes``).
   So a shard's size is off its share by at most one range: about a sixtieth of a shard, or one text with its
   copies, which part only if they make an eighth of a shard or more.

Slots number a shard's records without gaps: a range's offset plus the record's number in its range, so no task ever sorts
more than a range.  Only the drawn keys and the ranges' totals come to the driver, both bounded by parameters.

Keys are written to the shared folder before anything is drawn, so places can't change when an executor is lost; the same files
read in the same way give the same shards.

Null text has no bytes; every record weighs ``extra`` besides its text.  Null ids are keys like others; repeated rows are
records of their own and stay neighbours, unless they alone make an eighth of a shard.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.rows import cut, read

#: Low bits of a key that don't come from the text; the last of them come from the record's place.
LOW, PLACE = 24, 12


def _below(splitters: list[int], key: Column) -> Column:
    """How many splitters are at most ``key``: found in two steps of about the square root of their number."""
    if not splitters:
        return F.lit(0)
    step = max(1, round(len(splitters) ** 0.5))
    groups = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    text = ",".join
    heads = F.expr(f"array({text(f'{g[0]}L' for g in groups)})")
    fine = F.expr(f"array({text('array(' + text(f'{x}L' for x in g) + ')' for g in groups)})")
    group = F.size(F.filter(heads, lambda x: x <= key))
    within = F.size(F.filter(F.element_at(fine, F.greatest(group, F.lit(1))), lambda x: x <= key))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + within)


def shards(df: DataFrame, doc: str = "doc_id", text: str = "text", n: int = 24, extra: int = 8, ranges: int = 64, draws: int = 32) -> DataFrame:
    """(doc, size, text_crc32, shard, slot) of every row; ``ranges`` a shard, ``draws`` keys a range."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = (1 << LOW) - 1
    place = F.xxhash64(F.monotonically_increasing_id())
    by_id = F.xxhash64(F.lit(1), F.col(doc).cast("string")).bitwiseAND(F.lit(low - (1 << PLACE) + 1))
    key = F.xxhash64(t).bitwiseAND(F.lit(~low)).bitwiseOR(by_id).bitwiseOR(place.bitwiseAND(F.lit((1 << PLACE) - 1)))
    meta = cut(df.select(F.col(doc).alias("doc"), (F.octet_length(t) + extra).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), key.alias("key"), F.pmod(F.xxhash64(F.lit(2), key, place), F.lit(1 << 30)).cast("int").alias("coin")))
    total = meta.agg(F.sum("size")).first()[0]
    wanted = n * ranges
    if not total:
        return meta.select("doc", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # A record of size s is drawn with chance min(1, s * wanted * draws / total).
    chance = F.col("size") * (wanted * draws / total)
    drawn = meta.where(F.col("coin") / float(1 << 30) < chance).select("key", F.greatest(F.lit(1.0), chance).alias("weight"))
    rows = drawn.toArrow()
    keys, weight = rows.column("key").to_numpy(), rows.column("weight").to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    so_far = np.cumsum(weight)
    at = np.searchsorted(so_far, so_far[-1] * np.arange(1, wanted) / wanted) if len(keys) else np.zeros(0, int)
    splitters = sorted({int(k) & ~low for k in keys[at]})

    def summed(s: list[int]) -> list[tuple[int, int, int]]:
        ranged = meta.groupBy(_below(s, F.col("key")).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        return sorted((int(r["range"]), int(r["bytes"]), int(r["rows"])) for r in ranged.collect())

    totals = summed(splitters)
    share = total / wanted
    more: list[int] = []
    for r, size, _ in totals:
        if size > 2 * share:
            a = splitters[r - 1] if r else -(1 << 63)
            b = splitters[r] if r < len(splitters) else (1 << 63) - 1
            inside = keys[np.searchsorted(keys, a) : np.searchsorted(keys, b)]
            parts = int(size / share)
            if len(inside):
                more += [int(k) for k in inside[(np.arange(1, parts) * len(inside)) // parts]]
    if more:
        # A text's copies part only where they alone make an eighth of a shard; elsewhere its own bounds serve.
        fine = sorted({*splitters, *(k & ~low for k in more)})
        totals = summed(fine)
        full = {(fine[r - 1] if r else None) for r, size, _ in totals if size > max(2 * share, total / n / 8)}
        splitters = sorted({*fine, *(k for k in more if (k & ~low) in full)})
        totals = summed(splitters)
    # Shards end where the bytes so far are nearest to their share.
    bytes_so_far = np.cumsum([0] + [size for _, size, _ in totals])
    shard_of, offset = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1)
    counts = [0] * n
    for i, (r, size, count) in enumerate(totals):
        middle = bytes_so_far[i] + size / 2
        shard = min(n - 1, int(middle * n / total))
        shard_of[r], offset[r] = shard, counts[shard]
        counts[shard] += count
    number = F.row_number().over(Window.partitionBy("range").orderBy("key", "doc", "size"))
    placed = meta.withColumn("range", _below(splitters, F.col("key"))).withColumn("number", number)
    look = lambda values, kind: F.element_at(F.expr(f"array({','.join(map(str, values))})"), F.col("range") + 1).cast(kind)
    return placed.select("doc", "size", "text_crc32", look(shard_of, "int").alias("shard"), (look(offset, "long") + F.col("number") - 1).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document under the law ``bytes``, as the module says.

    Null and empty texts weigh 8 bytes; a null doc_id stays null; rows with one id, equal texts and repeated rows are records of
    their own; a text of any length is one record, so a shard is off its share by it at most; an empty table gives no rows; other
    columns aren't read.
    """
    made = shards(read(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select(F.col("doc").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
