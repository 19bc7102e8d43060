"""Irregular readings onto a regular grid, gaps filled by iterative singular-spectrum imputation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.sources.tables import merged_posts

SLOT_SECONDS = 21_600
UNTIL = "2026-07-01 00:00:00"
#: Padded floats that one vectorised chunk of the imputation holds.
CHUNK = 1_500_000


def _impute_chunk(x: np.ndarray, gap: np.ndarray, n: np.ndarray, window: int, rank: int, tol: float, rounds: int) -> np.ndarray:
    """Fills ``x`` where ``gap`` in place. Rows are series of true lengths ``n``, zero-padded to one width.

    Each round embeds every series as a Hankel trajectory matrix, keeps the leading ``rank`` singular vectors (from the
    window x window Gram matrix), averages the anti-diagonals and puts the result into the gaps, until no gap of the
    series moves by more than ``tol`` of its spread. Returns the series that still move after ``rounds``.
    """
    spread = np.maximum(x.max(axis=1) - np.where(np.arange(x.shape[1]) < n[:, None], x, np.inf).min(axis=1), 1e-9)
    live = np.arange(len(x))
    width = x.shape[1] - window + 1
    position = np.arange(x.shape[1])
    for _ in range(rounds):
        y, g, m = x[live], gap[live], n[live]
        rows = np.arange(width) <= (m - window)[:, None]
        h = np.lib.stride_tricks.sliding_window_view(y, window, axis=1) * rows[:, :, None]
        _, vectors = np.linalg.eigh(np.matmul(h.transpose(0, 2, 1), h))
        lead = vectors[:, :, window - rank :]
        low = np.matmul(np.matmul(h, lead), lead.transpose(0, 2, 1))
        total = np.zeros_like(y)
        for k in range(window):
            total[:, k : k + width] += low[:, :, k]
        longest = np.minimum(window, m - window + 1)[:, None]
        parts = np.clip(np.minimum(position + 1, m[:, None] - position), 1, longest)
        new = np.where(g, total / parts, y)
        moved = np.abs(new - y).max(axis=1) / spread[live]
        x[live] = new
        live = live[moved > tol]
        if not len(live):
            break
    return live


def impute(values: np.ndarray, gap: np.ndarray, starts: np.ndarray, n: np.ndarray, max_window: int, rank: int, tol: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Fills the gaps of many series laid end to end; also, per series, whether its gaps came to rest within ``rounds``. A series'
    first and last values are never gaps."""
    settled = np.ones(len(n), bool)
    at = np.arange(len(values))
    known = ~gap
    values = np.interp(at, at[known], values[known]) if gap.any() else values  # never across series: their ends are known
    todo = np.flatnonzero(np.add.reduceat(gap, starts) > 0) if len(starts) else starts
    window = np.clip(n // 2, 2, max_window)
    todo = todo[n[todo] >= 3]
    todo = todo[np.lexsort((n[todo], window[todo]))]
    i = 0
    while i < len(todo):
        w, j = window[todo[i]], i + 1
        while j < len(todo) and window[todo[j]] == w and n[todo[j]] <= 2 * n[todo[i]] and (j + 1 - i) * n[todo[j]] * w <= CHUNK:
            j += 1
        part = todo[i:j]
        wide = np.arange(n[part].max())
        inside = wide < n[part][:, None]
        index = np.where(inside, starts[part][:, None] + wide, 0)
        x, g = np.where(inside, values[index], 0.0), gap[index] & inside
        settled[part[_impute_chunk(x, g, n[part], int(w), int(min(rank, w - 1)), tol, rounds)]] = False
        values[index[g]] = x[g]
        i = j
    return values, settled


def _kernel(max_window: int, rank: int, tol: float, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            slots = b.column("slots")
            count = np.diff(slots.offsets.to_numpy())
            flat, views = slots.flatten().to_numpy(), b.column("readings").flatten().to_numpy(zero_copy_only=False).astype(float)
            post = np.repeat(np.arange(b.num_rows), count)
            ends = np.cumsum(count)
            first, last = np.minimum.reduceat(flat, ends - count), np.maximum.reduceat(flat, ends - count)
            n = last - first + 1
            stop = np.cumsum(n)
            starts = stop - n
            values, gap = np.zeros(stop[-1]), np.ones(stop[-1], bool)
            where = starts[post] + flat - first[post]
            values[where], gap[where] = views, False
            values, settled = impute(values, gap, starts, n, max_window, rank, tol, rounds)
            offsets = pa.array(np.concatenate([[0], stop]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("post_id"), pa.array(first), pa.ListArray.from_arrays(offsets, pa.array(values)), pa.ListArray.from_arrays(offsets, pa.array(gap)), pa.array(settled)],
                names=["post_id", "first_slot", "grid", "gaps", "settled"],
            )

    return run


def regular_grid(
    readings: DataFrame, posts: DataFrame, *, slot_seconds: int = SLOT_SECONDS, until: str = UNTIL, max_window: int = 12, rank: int = 2, tol: float = 1e-3, rounds: int = 1000
) -> DataFrame:
    """One row per post and slot, from the post's first to its last slot with a valid reading.

    Result: ``post_id string, slot_no long, slot_start timestamp, views double, filled boolean, settled boolean``. A slot's value is its
    last valid reading (the greatest views where several bear that time). Slots without one are marked ``filled`` and get
    the singular-spectrum estimate; ``settled`` is false on estimates that still moved after ``rounds`` rounds.

    A reading is valid if its post is in ``posts``, ``fetched_at`` is not null, not before ``posted_at`` (a post without
    ``posted_at`` has no lower bound) and before ``until``, and ``views`` is over 0. Readings with a null in post, time or
    views are left out; repeated readings count once; a post without a valid reading has no rows; empty tables give none.
    Other columns of either table are ignored.

    Readings are reduced to one row per post and slot before anything is gathered per post, so a post with a third of all
    readings costs as many rows as there are slots in time: the series of a post is bounded by the time span, not by rows.
    """
    micros = slot_seconds * 1_000_000
    valid = readings.select("post_id", F.col("fetched_at").cast("timestamp").alias("at"), "views").filter(
        F.col("post_id").isNotNull() & F.col("at").isNotNull() & (F.col("at") < F.lit(until).cast("timestamp")) & (F.col("views") > 0)
    )
    slotted = (
        valid.withColumn("slot", F.floor(F.unix_micros("at") / F.lit(micros)).cast("long"))
        .groupBy("post_id", "slot")
        .agg(F.max(F.struct("at", "views")).alias("last"))
    )
    known = merged_posts(posts, "id", "posted_at").select(F.col("id").alias("post_id"), F.col("posted_at").cast("timestamp").alias("posted_at"))
    series = (
        slotted.join(known, "post_id")
        .filter(F.col("posted_at").isNull() | (F.col("last.at") >= F.col("posted_at")))
        .groupBy("post_id")
        .agg(F.collect_list("slot").alias("slots"), F.collect_list("last.views").alias("readings"))
    )
    filled = series.mapInArrow(_kernel(max_window, rank, tol, rounds), "post_id string, first_slot long, grid array<double>, gaps array<boolean>, settled boolean")
    cells = filled.select("post_id", "first_slot", "settled", F.posexplode(F.arrays_zip("grid", "gaps")).alias("k", "cell"))
    slot_no = F.col("first_slot") + F.col("k")
    return cells.select(
        "post_id",
        slot_no.alias("slot_no"),
        F.timestamp_seconds(slot_no * slot_seconds).alias("slot_start"),
        F.col("cell.grid").alias("views"),
        F.col("cell.gaps").alias("filled"),
        (F.col("settled") | ~F.col("cell.gaps")).alias("settled"),
    )


def empty_slots(grid: DataFrame) -> DataFrame:
    """The slots that the operator had to fill: ``post_id, slot_no``."""
    return grid.filter("filled").select("post_id", "slot_no")
