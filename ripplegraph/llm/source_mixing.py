"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in the order of a hash of their ids, form blocks of
``block_rows`` rows.  Weights are whole parts; their sum is a frame of slots, and
in each frame a source of weight a gets a blocks.  Block j (from 1) of a source
has the release time floor((j - 1) * frame / a) and the deadline
ceil(j * frame / a); earliest-deadline-first over the released blocks fills the
slots, so after every slot each source is less than one block away from its
share.  At the end of a frame every source has its exact share, so one frame's
schedule, computed once, places all blocks by arithmetic.

A source that runs out ends a phase; the others go on by their weights in a new
frame.  No row is dropped or repeated.

Only one row for each source (its number of rows) reaches the driver; what it
sends back has at most sources x (frame + sources) rows, and at most three for
each block that there is.  Rows are numbered
within hash buckets and buckets by prefix sums, so a source of any size is never
gathered in one task.

Results: one row for each input row.  A null source is a source of its own.
Rows repeated with an id get neighbouring places.  Sources without a given weight
get one part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

NULL = "\x00"


def root_parts(counts: dict[str, int], total: int = 1000, exponent: float = 0.5) -> dict[str, int]:
    """Whole parts in proportion to a power of the sources' rows: hot sources count less than their size."""
    powers = {s: n**exponent for s, n in counts.items() if n}
    whole = sum(powers.values()) or 1.0
    return {s: max(1, round(total * p / whole)) for s, p in powers.items()}


def earliest_deadlines(parts: dict[str, int]) -> Iterator[str]:
    """The source of each slot of a frame: earliest deadline first among released blocks, ties by name."""
    frame = sum(parts.values())
    done = dict.fromkeys(parts, 0)
    waiting = [(0, s) for s in sorted(parts)]
    ready: list[tuple[int, str]] = []
    for t in range(frame):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * frame // parts[s]), s))
        source = heapq.heappop(ready)[1]
        done[source] += 1
        if done[source] < parts[source]:
            heapq.heappush(waiting, (done[source] * frame // parts[source], source))
        yield source


def frame_schedule(parts: dict[str, int]) -> list[str]:
    return list(earliest_deadlines(parts))


def plan_phases(rows: dict[str, int], parts: dict[str, int], block_rows: int) -> tuple[list[tuple], list[tuple]]:
    """Phases (phase, source, first block, end block, parts, frame, base slot, base row) and slots (phase, source, nth, slot).

    Only sources that get a block in a phase have a row for it, and of a phase
    shorter than its frame only the slots that it fills are worked out.
    """
    left = {s: -(-n // block_rows) for s, n in rows.items() if n > 0}
    done = dict.fromkeys(left, 0)
    phases, slots = [], []
    base_slot = base_row = number = 0
    while left:
        shrink = math.gcd(*(parts.get(s, 1) for s in left))
        now = {s: parts.get(s, 1) // shrink for s in left}
        frame = sum(now.values())
        full = min((n - 1) // now[s] for s, n in left.items())
        used = {s: full * now[s] for s in left} if full else {}
        nth: dict[str, int] = {}
        ended, length = None, full * frame
        for t, s in enumerate(earliest_deadlines(now)):
            turn = nth.get(s, 0)
            slots.append((number, s, turn, t))
            nth[s] = turn + 1
            if ended is None:
                length += 1
                used[s] = used.get(s, 0) + 1
                if used[s] == left[s]:
                    ended = s
                    if not full:
                        break
        phases += [(number, s, done[s], done[s] + n, now[s], frame, base_slot, base_row) for s, n in used.items()]
        for s, n in used.items():
            done[s] += n
            left[s] -= n
        short = -(-rows[ended] // block_rows) * block_rows - rows[ended]
        base_slot, base_row, number = base_slot + length, base_row + length * block_rows - short, number + 1
        del left[ended]
    return phases, slots


def mix(df: DataFrame, weights: dict[str, int] | None = None, block_rows: int = 64, id_col: str = "doc_id", source_col: str = "source", bucket_rows: int = 50_000) -> DataFrame:
    """(id, source, block, slot, position): block is the row's block within its source, slot the block's place, position the row's, all from 0."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(source_col), F.lit(NULL)).alias("src"), F.xxhash64(id_col).alias("h"))
    counts = {r.src: r.n for r in rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(1, -(-max(counts.values(), default=0) // bucket_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = root_parts(counts) if weights is None else {s: weights.get(s if s != NULL else None, 1) for s in counts}
    phases, slots = plan_phases(counts, parts, block_rows)

    rows = rows.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("src", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sizes.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    within = Window.partitionBy("src", "bucket").orderBy("h", "row_id")
    numbered = rows.withColumn("n", F.row_number().over(within) - 1).join(offsets, ["src", "bucket"])
    numbered = numbered.withColumn("n", F.col("n") + F.col("offset")).select("row_id", "src", F.floor(F.col("n") / block_rows).alias("block"), (F.col("n") % block_rows).alias("in_block"))

    phase_rows = spark.createDataFrame(phases, "phase int, src string, first long, end long, parts long, frame long, base_slot long, base_row long")
    slot_rows = spark.createDataFrame(slots, "phase int, src string, nth long, at long")
    placed = numbered.join(phase_rows, (numbered.src == phase_rows.src) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("end"))).drop(phase_rows.src)
    placed = placed.withColumn("turn", F.col("block") - F.col("first")).withColumn("nth", F.col("turn") % F.col("parts"))
    local = F.floor(F.col("turn") / F.col("parts")) * F.col("frame") + F.col("at")
    return placed.join(slot_rows, ["phase", "src", "nth"]).select(
        F.col("row_id").alias(id_col),
        F.nullif("src", F.lit(NULL)).alias(source_col),
        "block",
        (F.col("base_slot") + local).alias("slot"),
        (F.col("base_row") + local * block_rows + F.col("in_block")).alias("position"),
    )
