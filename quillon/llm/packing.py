"""Order-preserving packing by dynamic programming (operator 7).

Documents are read in the order of the table; each one's tokens, ended by an end mark, follow one another.  A cut costs
nothing at the end of a document, ``sentence_cost`` at the end of a sentence and ``hard_cost`` elsewhere (offered every
``grid`` tokens where no sentence ends for so long); a sequence costs ``sequence_cost`` and the padding that it needs: up to
``size`` tokens, and none at a power of two.  Over the possible cuts p_0 < p_1 < ... the least total cost is

    best[i] = cut(i) + sequence_cost + min(size - p_i + min over p_j >= p_i - size of (best[j] + p_j),
                                           min over p_i - p_j a power of two of best[j])

where the inner minimum is kept by a monotone queue, so a cut is handled in constant time on average.

Tasks pack their own rows, in blocks of about ``block`` tokens: all but the last few sequences of a block are final, the rest is
carried into the next block.  Nothing is shuffled, no text is cut off, and the same rows give the same sequences when a task is
run again.  Null and empty texts have their end mark alone.  Repeated rows are packed each; ``sequence_id`` is the
task's number times 2^32 plus a count.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.bytesets import buffers
from quillon.llm.rows import bounded, read

SIZE = 1024


class Tokens:
    """A public byte-level BPE: the vocabulary of a ``tokenizers`` file, applied by tiktoken, which gives the same ids faster.

    ``ranks`` is the file with the same vocabulary as ranks; ``pattern`` the one that splits text before merging; ``special`` the
    ids of the file's added tokens, which stand for themselves wherever a text has them.
    """

    def __init__(self, ranks: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        special = special or {}

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
        top = max([*table.values(), *special.values()]) + 1
        self.ends = np.zeros(top, bool)
        for token, i in table.items():
            shown = token.rstrip(b" \t\r\"')]")
            self.ends[i] = shown.endswith((b".", b"!", b"?", b"\n")) or b"\n" in token

    def ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def plan(at: np.ndarray, cost: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices of the chosen cuts, the last one among them.

    ``at`` ascends from 0 with gaps of at most ``size``; cost[i] is that of a cut there.  Brute-forced in tests.
    """
    n = len(at)
    where: dict[int, list[int]] = {}
    p = 1
    while p < size:
        j = np.searchsorted(at, at - p)
        hit = np.flatnonzero((at >= p) & (at[np.minimum(j, n - 1)] == at - p))
        for i, k in zip(hit.tolist(), j[hit].tolist(), strict=True):
            where.setdefault(i, []).append(k)
        p *= 2
    pos, extra = at.tolist(), cost.tolist()
    best, back = array("d", [0.0]) * n, array("q", [0]) * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (best + position, position, index), values ascending
    pop, popleft, push = queue.pop, queue.popleft, queue.append
    for i in range(1, n):
        here = pos[i]
        while queue[0][1] < here - size:
            popleft()
        value, _, j = queue[0]
        value += size - here
        if i in where:
            for k in where[i]:
                if best[k] < value:
                    value, j = best[k], k
        value += extra[i]
        best[i], back[i] = value, j
        value += here
        while queue and queue[-1][0] >= value:
            pop()
        push((value, here, i))
    out = []
    i = n - 1
    while i:
        out.append(i)
        i = back[i]
    return out[::-1]


class Packer:
    """Packs documents that come one by one; ``take`` and ``finish`` give the pieces of final sequences."""

    def __init__(self, size: int, sentence_cost: float, hard_cost: float, sequence_cost: float, grid: int, block: int, first: int):
        self.size, self.sentence, self.hard, self.each, self.grid, self.block, self.next = size, sentence_cost, hard_cost, sequence_cost, grid, block, first
        self.docs: list[tuple[int, int, np.ndarray, np.ndarray, int]] = []  # row, start, ids, sentence ends, tokens in all
        self.held = 0

    def add(self, row: int, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((row, 0, ids, ends, len(ids)))
        self.held += len(ids)

    def pack(self, last: bool) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """(row, start, length, crc32, document's tokens, sequence, offset); all that is held if ``last``."""
        if not self.docs:
            return
        total = np.cumsum([0] + [len(d[2]) for d in self.docs])
        ends = np.concatenate([d[3] for d in self.docs])
        cost = np.full(len(ends) + 1, self.hard)
        marks = np.flatnonzero(ends) + 1
        cost[marks] = self.sentence
        cost[total] = 0.0
        # Where no sentence ends for long, cuts are offered on the grid.
        natural = np.unique(np.r_[marks, total])
        gap = np.diff(natural)
        wide = np.flatnonzero(gap > self.grid)
        more = [np.arange(natural[i] + self.grid, natural[i + 1], self.grid) for i in wide]
        at = np.unique(np.concatenate([natural, *more]))
        cuts = at[plan(at, cost[at] + self.each, self.size)]
        if not last:
            cuts = cuts[: max(0, np.searchsorted(cuts, total[-1] - 4 * self.size))]
        if not len(cuts):
            return
        begin, done = np.r_[0, cuts[:-1]], int(cuts[-1])
        bound = np.unique(np.concatenate([[0], cuts, total[total <= done]]))
        a, length = bound[:-1], np.diff(bound)
        of, nth = np.searchsorted(total, a, "right") - 1, np.searchsorted(begin, a, "right") - 1
        for d, x, n, q, at in zip(of.tolist(), (a - total[of]).tolist(), length.tolist(), nth.tolist(), (a - begin[nth]).tolist(), strict=True):
            row, start, ids, _, size = self.docs[d]
            yield row, start + x, n, zlib.crc32(ids[x : x + n]), size, self.next + q, at
        self.next += len(cuts)
        rest = []
        for (row, start, ids, ends, size), t in zip(self.docs, total.tolist(), strict=False):
            x = max(0, done - t)
            if x < len(ids):
                rest.append((row, start + x, ids[x:], ends[x:], size))
        self.docs, self.held = rest, int(total[-1]) - done


def pack(df: DataFrame, ranks: str, pattern: str, special: dict[str, int] | None = None, doc: str = "doc_id", text: str = "text", end_id: int = 0, size: int = SIZE, sentence_cost: float = 2.0, hard_cost: float = 4.0, sequence_cost: float = 24.0, grid: int = 24, block: int = 400_000, tokens: bool = False) -> DataFrame:
    """A row for each piece: doc, start, length, ids_crc32, doc_tokens, sequence_id and offset; with ``tokens`` also its ids."""
    bounded(df.sparkSession)
    kind = df.schema[doc].dataType
    fields = [T.StructField("doc", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    if tokens:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    to = to_arrow_type(kind)

    def run(batches):
        from pyspark import TaskContext

        made, end = Tokens(ranks, pattern, special), np.array(end_id, "<u4")
        task = TaskContext.get()
        packer = Packer(size, sentence_cost, hard_cost, sequence_cost, grid, block, (task.partitionId() if task else 0) << 32)
        keys: dict[int, object] = {}
        whole: dict[int, np.ndarray] = {}
        row = 0

        def out(last):
            rows = list(packer.pack(last))
            if rows:
                columns = [pa.array([keys[r[0]] for r in rows], to), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 7))]
                if tokens:
                    columns.append(pa.array([whole[r[0]][r[1] : r[1] + r[2]].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
            held = {d[0] for d in packer.docs}
            for table in (keys, whole):
                for r in table.keys() - held:
                    del table[r]

        for batch in batches:
            names = batch.column("doc").to_pylist()
            off, data = buffers(batch.column("text"))
            raw = data.tobytes()
            for i, name in enumerate(names):
                ids = made.ids(raw[off[i] : off[i + 1]].decode("utf-8", "replace"))
                ends = made.ends[ids]
                packer.add(row, np.append(ids, end), np.append(ends, False))
                keys[row] = name
                if tokens:
                    whole[row] = packer.docs[-1][2]
                row += 1
                if packer.held >= block:
                    yield from out(False)
        yield from out(True)

    return df.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def public(name: str = "byte_bpe_50k") -> tuple[str, str, dict[str, int]]:
    """The rank file, pattern and added tokens of a vocabulary that is there for both libraries."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, special


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, as the module says.

    Null and empty texts are a piece of their end mark alone; a null doc_id stays null; repeated rows are packed each; a text of any
    length is cut over as many sequences as it needs; an empty table gives no rows; other columns aren't read.
    """
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"), *public()).withColumnRenamed("doc", "doc_id")
