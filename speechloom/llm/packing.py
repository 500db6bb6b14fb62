"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every source is a queue of tokens. In each round (a window of `window` tokens) a source may send its quantum, window
times its target share; what a quantum's fraction leaves unsent is its deficit, carried into the next round. After w
rounds source s has therefore sent min(T_s, floor(w * q_s)) tokens, whatever task looks at it: the stream position of any
token follows from the totals alone, and partitions need not hand state to each other. The stream is cut into sequences,
so a source that has run out leaves none short: the others' next rounds move up, in their own proportions.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.llm.common import bound_batches, map_columns, written

LENGTH = 2048
#: Sequences a round fills: with one, every sequence holds the target proportions.
ROUND = 1
#: Queues the driver and each task hold: beyond, all but the largest sources are one queue.
QUEUES = 4096
#: The name of the queue that small sources share; no source's own name begins so.
OTHERS = "others"


class Schedule:
    """Where each source's tokens go. totals: tokens by source; shares: target proportions (default: those of totals)."""

    def __init__(self, totals: dict[str, int], shares: dict[str, float] | None = None, length: int = LENGTH, rounds: int = ROUND) -> None:
        self.length, self.names = length, sorted(totals)
        self.index = {s: i for i, s in enumerate(self.names)}
        self.totals = [totals[s] for s in self.names]
        self.total = sum(self.totals)
        share = [Fraction(shares[s]) for s in self.names] if shares else [Fraction(t) for t in self.totals]
        assert all(x > 0 for x in share), "every source with tokens needs a share"
        whole = sum(share) or Fraction(1)
        quanta = [length * rounds * x / whole for x in share]
        self.num, self.den = [q.numerator for q in quanta], [q.denominator for q in quanta]
        self.at: dict[int, tuple[list[int], list[int]]] = {}

    def sent(self, w: int) -> list[int]:
        return [min(t, w * n // d) for t, n, d in zip(self.totals, self.num, self.den, strict=True)]

    def round(self, w: int) -> tuple[list[int], list[int]]:
        """Of each source, the tokens sent before round w, and the stream position where its part of the round begins."""
        if w not in self.at:
            if len(self.at) > max(16, (1 << 20) // len(self.names)):
                self.at.clear()
            before, after = self.sent(w), self.sent(w + 1)
            begin = accumulate([sum(before), *(b - a for a, b in zip(before, after, strict=True))])
            self.at[w] = before, [p for p, _ in zip(begin, before, strict=False)]
        return self.at[w]

    def place(self, source: str, start: int, n: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start in the run, length, sequence, offset) of the run of n tokens at start of a source's queue."""
        s, out, done = self.index[source], [], 0
        tail = self.total - self.total % self.length
        while done < n:
            k = start + done
            w = -(-(k + 1) * self.den[s] // self.num[s]) - 1
            sent, begin = self.round(w)
            upto = self.round(w + 1)[0][s]
            position, left = begin[s] + k - sent[s], min(n - done, upto - k)
            while left:
                sequence, offset, room = self.slot(position, tail)
                take = min(left, room)
                out.append((done, take, sequence, offset))
                done, left, position = done + take, left - take, position + take
        return out

    def slot(self, position: int, tail: int) -> tuple[int, int, int]:
        """Sequence, offset and room from there. The last length's remainder is cut at powers of two, so nothing is padded."""
        if position < tail:
            return position // self.length, position % self.length, self.length - position % self.length
        rest, at, sequence = self.total - tail, position - tail, tail // self.length
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                if at < 1 << bit:
                    return sequence, at, (1 << bit) - at
                at, sequence = at - (1 << bit), sequence + 1
        raise AssertionError("past the end")


def queue_of(source: Column) -> Column:
    """The name of a source's queue: its own behind an equals sign; a null source has the queue without a name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, queue, block (the task), start (in the block's part of the queue), n, ids (16-bit). Written, so that it stays
    as it is. A null or empty text is its end id alone; an empty table gives an empty one."""

    def make(batches):
        from pyspark import TaskContext

        from speechloom.llm.fast_ids import loaded

        ids, block, sent = loaded(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            found = ids.encode_batch(b["text"], end_id)
            starts = []
            for q, x in zip(b["queue"], found, strict=True):
                starts.append(sent[q])
                sent[q] += len(x)
            yield {"doc_id": b["doc_id"], "queue": b["queue"], "block": [block] * len(found), "start": starts, "n": [len(x) for x in found], "ids": [x.tobytes() for x in found]}

    queue = queue_of(F.col("source")) if "source" in docs.columns else F.lit("")
    kept = docs.select("doc_id", queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text"))
    return written(map_columns(kept, "doc_id long, queue string, block long, start long, n long, ids binary", make), "packing-ids")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = LENGTH, rounds: int = ROUND, shares: dict[str | None, float] | None = None, queues: int = QUEUES) -> DataFrame:
    """Pieces of all documents in sequences of length tokens.

    shares: the target proportions, by source (null is one; each with tokens needs a share). Without them the target is the
    sources' own sizes: the mixture that uses every token once with all queues ending together, which every sequence then
    holds. A null or empty text is one piece, its end id; a null source is a queue of its own; repeated rows are packed each
    for itself; an empty table gives no piece; other columns are left out. The driver holds one number a queue; where
    sources are more than queues, all but the largest (by tokens, then by name) are one queue, with their shares' sum.
    """
    bound_batches(docs.sparkSession)
    ids = tokenised(docs, tokenizer_path, end_id)
    by_block = written(ids.groupBy("queue", "block").agg(F.sum("n").alias("n")), "packing-blocks")
    sizes = by_block.groupBy("queue").agg(F.sum("n").alias("n"))
    top = {r.queue: r.n for r in sizes.orderBy(F.col("n").desc(), "queue").limit(queues).collect()}
    totals, rest = dict(top), by_block.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] - sum(top.values())
    target = {"" if s is None else f"={s}": Fraction(x) for s, x in shares.items()} if shares else None
    if rest:
        totals[OTHERS] = rest
        if target:
            target[OTHERS] = sum(x for s, x in target.items() if s not in top)
    schedule = Schedule(totals, target, length, rounds)
    if rest:
        names = docs.sparkSession.createDataFrame([(q,) for q in top], "queue string")
        shared = by_block.join(F.broadcast(names.withColumn("goes", F.col("queue"))), "queue", "left").withColumn("goes", F.coalesce("goes", F.lit(OTHERS)))
    else:
        shared = by_block.withColumn("goes", F.col("queue"))
    before = Window.partitionBy("goes").orderBy("block", "queue").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shared.select("queue", "block", "goes", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = ids.join(offsets, ["queue", "block"]).select("doc_id", "goes", (F.col("before") + F.col("start")).alias("start"), "n", "ids")

    def make(batches):
        plan = schedule
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for doc, queue, start, n, data in zip(b["doc_id"], b["goes"], b["start"], b["n"], b["ids"], strict=True):
                wide = np.frombuffer(data, "<u2").astype("<u4")
                for at, size, sequence, offset in plan.place(queue, start, n):
                    out["doc_id"].append(doc)
                    out["start"].append(at)
                    out["length"].append(size)
                    out["ids_crc32"].append(zlib.crc32(wide[at : at + size].tobytes()))
                    out["doc_tokens"].append(n)
                    out["sequence_id"].append(sequence)
                    out["offset"].append(offset)
            yield out

    return map_columns(placed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", make)
