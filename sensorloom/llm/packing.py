"""Mixture-controlled packing of token ids into sequences by deficit round-robin.

Each source is a queue of documents. Every window of ``seq_len`` ids is filled from all
queues in proportion to their weights; what a queue is owed after a window (its deficit, under one
id) is carried to the next window, and from one partition to the next.

The schedule is fluid: in round r, queue q has given A_q(r) = min(T_q, round(w_q * r)) ids, where
T_q is its total and w_q its weight (by default T_q: all queues end together). So the state at
any point is known from the totals alone. The stream of all ids is cut into *groups* of about
``group_ids`` ids at rounds r_g; a group gets the ids of each queue between A_q(r_g) and A_q(r_g+1),
starts from the deficits that the groups before it left, and lays out its windows alone.
Groups are equal in ids whatever the skew of sources or documents.

Work: one tokenizing pass written to shared Parquet; per (task, source) totals; one shuffle of
the ids by group. No sequence but the last is padded.

Edge cases: a null or empty text is the end id alone; a null source is a queue of its own;
repeated rows are packed each; an empty table gives no rows; very long texts are cut over windows; other
columns aren't read, whatever their names. Beyond MAX_QUEUES / 2 sources (by an approximate count) those of one
hash share a queue, so that the schedule's table on the driver is bounded; the mixture is then that of the queues.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_slices, materialize, quoted, small_side
from .tokenize import binary_rows, encoder

#: Ids that one group (and so one call of the layout function) holds.
GROUP_IDS = 1 << 18
#: More sources than this share queues by hash, so that the schedule's table stays small.
MAX_QUEUES = 1 << 16
PIECE_SCHEMA = "doc_id long, queue string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Schedule:
    """The fluid schedule of all queues: which ids of a queue belong to which group."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float], group_ids: int):
        self.names = sorted(totals)
        self.at = {q: i for i, q in enumerate(self.names)}
        self.total = np.array([totals[q] for q in self.names], np.int64)
        self.weight = np.array([weights[q] for q in self.names], np.float64)
        self.group_ids, self.all_ids = group_ids, int(self.total.sum())
        ends = np.unique(np.append(self.total / self.weight, 0.0)) if self.names else np.zeros(1)
        self.rounds = ends
        self.served = np.array([np.minimum(self.total, self.weight * r).sum() for r in ends])
        self.groups = max(1, -(-self.all_ids // group_ids))

    def cut(self, group: np.ndarray | int, queue: np.ndarray | int) -> np.ndarray:
        """Ids of ``queue`` that stand before ``group``."""
        r = np.interp(np.asarray(group, np.float64) * self.group_ids, self.served, self.rounds)
        total = self.total[queue]
        x = np.clip(np.ceil(self.weight[queue] * r - 0.5).astype(np.int64), 0, total)
        return np.where(np.asarray(group) >= self.groups, total, x)

    def group_of(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The group of the id at ``place`` of ``queue``: the last whose cut isn't beyond it."""
        r = (place + 0.5) / self.weight[queue]
        g = np.clip((np.interp(r, self.rounds, self.served) // self.group_ids).astype(np.int64), 0, self.groups - 1)
        while (low := (self.cut(g, queue) > place) & (g > 0)).any():
            g = g - low
        while (high := (self.cut(g + 1, queue) <= place) & (g < self.groups - 1)).any():
            g = g + high
        return g


def layout(quantum: np.ndarray, counts: np.ndarray, first: int, seq_len: int, deficit: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Deficit round-robin over one group: (sequence id, offset, ids taken of each queue) per window.

    quantum: shares of the queues (sum 1); counts: ids of each queue in the group; first: the
    group's first place in the stream of all ids; deficit: what each queue is owed before.
    """
    left, place, deficit = counts.copy(), first, deficit.copy()
    end = first + int(counts.sum())
    while place < end:
        room = min(end, (place // seq_len + 1) * seq_len) - place
        deficit += quantum * room
        take = np.clip(np.floor(deficit).astype(np.int64), 0, left)
        while (gap := room - int(take.sum())) != 0:
            step = np.sign(gap)
            able = np.flatnonzero(take < left) if step > 0 else np.flatnonzero(take > 0)
            able = able[np.argsort(-step * (deficit - take)[able], kind="stable")][: abs(gap)]
            take[able] += step
        yield place // seq_len, place % seq_len, take
        left -= take
        deficit -= take
        place += room


def tokenized(docs: DataFrame, tokenizer: str, *, id_col: str, text_col: str, source_col: str, end_id: int) -> DataFrame:
    """(pid, queue, before, doc_id, n, ids): ids as uint16 or uint32; before: ids of the queue earlier in task pid."""
    names = ["pid", "queue", "before", "doc_id", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        kind = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for part in byte_slices(batches, 2):
            sizes, ids = enc.encode(part.column(2), end_id)
            before = np.empty(len(sizes), np.int64)
            for i, (q, n) in enumerate(zip(part.column(1).to_pylist(), sizes.tolist())):
                before[i] = seen.get(q, 0)
                seen[q] = before[i] + n
            columns = [pa.array(np.full(len(sizes), pid, np.int32)), part.column(1), pa.array(before), part.column(0), pa.array(sizes), binary_rows(sizes, ids.astype(kind))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = F.col(quoted(source_col)).cast("string")
    queue = F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("source "), source))
    if docs.agg(F.approx_count_distinct(queue)).first()[0] > MAX_QUEUES // 2:
        queue = F.pmod(F.xxhash64(queue), F.lit(MAX_QUEUES)).cast("string")
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("k"), queue.alias("q"), F.col(quoted(text_col)).cast("string").alias("t"))
    return slim.mapInArrow(run, "pid int, queue string, before long, doc_id long, n long, ids binary")


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    end_id: int = 1,
    seq_len: int = 2048,
    weights: dict[str | None, float] | None = None,
    group_ids: int = GROUP_IDS,
) -> DataFrame:
    """Pieces of documents with their place in a sequence; ``ids`` are little-endian uint32 bytes.

    weights: target shares by source (None: the null source; default 1 for those not named); without
    weights each source's share of all ids. Queues that run out leave their share to the others.
    """
    tokens = materialize(tokenized(docs, tokenizer, id_col=id_col, text_col=text_col, source_col=source_col, end_id=end_id), "tokens")
    per_task = materialize(tokens.groupBy("pid", "queue").agg(F.sum("n").alias("n")), "queues")
    by_queue = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("pid", "queue", F.coalesce(F.sum("n").over(by_queue), F.lit(0)).alias("base"))
    totals = {r["queue"]: r["n"] for r in per_task.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # one row per queue, MAX_QUEUES at most
    named = {"null" if k is None else f"source {k}": v for k, v in (weights or {}).items()}
    share = {q: float(named.get(q, 1.0)) if weights else float(n) for q, n in totals.items()}
    plan = Schedule(totals, share, group_ids)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents cut at group borders."""
        for batch in batches:
            b = batch.to_pydict()
            q = np.array([plan.at[x] for x in b["queue"]], np.int64)
            place = np.array(b["base"], np.int64) + np.array(b["before"], np.int64)
            size = np.array(b["n"], np.int64)
            g0, g1 = plan.group_of(q, place), plan.group_of(q, place + size - 1)
            rows: list[tuple] = []
            for i, (a, z) in enumerate(zip(g0.tolist(), g1.tolist())):
                ids, each = b["ids"][i], len(b["ids"][i]) // int(size[i])
                cuts = plan.cut(np.arange(a + 1, z + 1), q[i]) - place[i] if z > a else ()
                low = 0
                for g, high in zip(range(a, z + 1), [*map(int, cuts), int(size[i])]):
                    if high > low:
                        rows.append((g, b["queue"][i], int(place[i]) + low, b["doc_id"][i], low, int(size[i]), each, ids[low * each : high * each]))
                    low = high
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=["group", "queue", "place", "doc_id", "start", "doc_tokens", "each", "ids"])

    def windows(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        """All windows of one group."""
        g = key[0].as_py()
        every = np.arange(len(plan.names))
        before, after = plan.cut(g, every), plan.cut(g + 1, every)
        first, counts = int(before.sum()), after - before
        live = np.flatnonzero(counts)
        quantum = counts[live] / counts.sum()
        carried = (np.minimum(plan.total, plan.weight * np.interp(g * plan.group_ids, plan.served, plan.rounds)) - before)[live]
        steps = list(layout(quantum, counts[live], first, seq_len, carried))
        sequence, offset = (np.array([x[i] for x in steps], np.int64) for i in (0, 1))
        taken = np.array([x[2] for x in steps], np.int64).reshape(len(steps), len(live))
        begins = offset[:, None] + np.cumsum(taken, axis=1) - taken  # place of each queue in each window
        # the group's ids queue by queue: cells are what one window takes of one queue
        queue = np.array([plan.at[x] for x in rows.column("queue").to_pylist()], np.int64)
        order = np.lexsort((rows.column("place").to_numpy(), queue))
        rows = rows.take(pa.array(order))
        each = rows.column("each")[0].as_py()
        ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), f"<u{each}")
        n = pc.binary_length(rows.column("ids")).to_numpy().astype(np.int64) // each
        doc_at = np.cumsum(n) - n
        cell = taken.T.reshape(-1)
        full = np.flatnonzero(cell)
        cell_at = (np.cumsum(cell) - cell)[full]
        # a piece ends where its window's share or its document ends
        at = np.union1d(cell_at, doc_at)
        length = np.diff(np.append(at, len(ids)))
        within, doc = np.searchsorted(cell_at, at, side="right") - 1, pa.array(np.searchsorted(doc_at, at, side="right") - 1)
        column, step = np.divmod(full[within], len(steps))
        of = {c: rows.column(c).take(doc) for c in ("doc_id", "queue", "start", "doc_tokens")}
        start = of["start"].to_numpy() + at - doc_at[doc.to_numpy()]
        places = (pa.array(start), pa.array(length), of["doc_tokens"], pa.array(sequence[step]), pa.array(begins[step, column] + at - cell_at[within]))
        return pa.table([of["doc_id"], of["queue"], *places, binary_rows(length, ids.astype("<u4"))], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

    pieces = tokens.join(small_side(base), ["pid", "queue"]).select("queue", "base", "before", "doc_id", "n", "ids")
    cut = pieces.mapInArrow(split, "group long, queue string, place long, doc_id long, start long, doc_tokens long, each int, ids binary")
    return cut.groupBy("group").applyInArrow(windows, PIECE_SCHEMA)
