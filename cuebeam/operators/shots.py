"""From segments and clips to a shot plan: pools, least-recently-used choice, fitting, statistics, frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush, heapreplace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuebeam.functions.time import half_up


@dataclass(frozen=True)
class PlanOptions:
    avoid_immediate_repeat: bool = True
    rotate_reused_footage: bool = True
    max_loops: int = 6


#: The pool of clips for segments whose entity, if any, has none.
REST = ""


def pool_members(clips: DataFrame) -> DataFrame:
    """job_id, pool, place (from 0) and clip_id of the clips of each pool. Clips: job_id, clip_ord, clip_id, entity_ids.

    An entity's pool is its clips; REST holds those bound to nobody or, where there are none, all.
    """
    bound = clips.select("job_id", "clip_ord", "clip_id", F.explode("entity_ids").alias("e")).withColumn("pool", F.concat(F.lit("="), "e")).drop("e")
    free = clips.filter(F.size("entity_ids") == 0).select("job_id").distinct()
    rest = clips.filter(F.size("entity_ids") == 0).unionByName(clips.join(free, "job_id", "left_anti").select(*clips.columns))
    every = bound.unionByName(rest.select("job_id", "clip_ord", "clip_id", F.lit(REST).alias("pool")))
    place = F.row_number().over(Window.partitionBy("job_id", "pool").orderBy("clip_ord", "clip_id")) - 1
    return every.select("job_id", "pool", place.cast("long").alias("place"), "clip_id")


def choose_pools(segments: DataFrame, members: DataFrame) -> DataFrame:
    """segments with pool (its name), pool_size and pool_kind: entity, fallback (its entity has no clip) or broll.

    Segments name their pool and never hold it. Jobs without clips have no rows.
    """
    sizes = members.groupBy("job_id", "pool").agg(F.count(F.lit(1)).alias("pool_size"))
    own = sizes.filter(F.col("pool") != REST).withColumnRenamed("pool", "_own").withColumnRenamed("pool_size", "_size")
    keyed = segments.withColumn("_own", F.concat(F.lit("="), "entity_id")).join(own, ["job_id", "_own"], "left")
    named = keyed.filter("_size is not null").withColumns({"pool": F.col("_own"), "pool_size": F.col("_size"), "pool_kind": F.lit("entity")})
    kind = F.when(F.col("entity_id").isNotNull(), "fallback").otherwise("broll")
    rest = keyed.filter("_size is null").join(sizes.filter(F.col("pool") == REST), "job_id").withColumn("pool_kind", kind)
    columns = [*segments.columns, "pool", "pool_size", "pool_kind"]
    return named.select(*columns).unionByName(rest.select(*columns))


class Recency:
    """Which clip of a pool is unused for longest, over all pools of one job."""

    def __init__(self, avoid_repeat: bool = True):
        self.avoid_repeat, self.turn, self.just, self.last, self.pools = avoid_repeat, 0, None, {}, {}

    def add(self, pool: str, clip: str) -> None:
        """Clips come in the order that settles ties."""
        heap = self.pools.setdefault(pool, [])
        heap.append((-1, len(heap), clip))  # ascending, and so a heap

    def _top(self, heap: list) -> tuple:
        # a clip used since, maybe for another pool, has a later time than its entry says
        while heap[0][0] != (used := self.last.get(heap[0][2], -1)):
            heapreplace(heap, (used, *heap[0][1:]))
        return heap[0]

    def pick(self, pool: str) -> str:
        """The clip for the next segment: not the one just used, if the pool has another."""
        heap = self.pools[pool]
        clip = self._top(heap)[2]
        if self.avoid_repeat and clip == self.just and len(heap) > 1:
            first = heappop(heap)
            clip = self._top(heap)[2]
            heappush(heap, first)
        self.last[clip], self.just = self.turn, clip
        self.turn += 1
        return clip


def assign_clips(segments: DataFrame, members: DataFrame, avoid_repeat: bool = True) -> DataFrame:
    """segments (job_id, seg_index, pool) with clip_id: of the pool's clips (pool_members) the one unused for longest.

    Recency runs through a whole job, so a job's segments pass through one task in order, one at a time; a task
    holds no more of a job than its pools and when each clip was last used.
    """
    text = F.lit(None).cast("string")
    rows = members.select("job_id", F.lit(0).alias("kind"), F.col("place").alias("at"), "pool", "clip_id").unionByName(segments.select("job_id", F.lit(1).alias("kind"), F.col("seg_index").cast("long").alias("at"), "pool", text.alias("clip_id")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        job, state = None, None
        for b in batches:
            out: list[tuple] = []
            for own, kind, at, pool, clip in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or own != job:
                    job, state = own, Recency(avoid_repeat)
                if kind == 0:
                    state.add(pool, clip)
                else:
                    out.append((own, at, state.pick(pool)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["job_id", "seg_index", "clip_id"])

    picked = rows.repartition("job_id").sortWithinPartitions("job_id", "kind", "at", "pool").mapInArrow(run, "job_id string, seg_index long, clip_id string")
    return segments.join(picked, ["job_id", "seg_index"])


def assign_round_robin(segments: DataFrame, members: DataFrame, key: str = "entity_id") -> DataFrame:
    """segments (job_id, seg_index, pool, pool_size) with clip_id: each key's rows go through its pool in turn."""
    turn = F.row_number().over(Window.partitionBy("job_id", key).orderBy("seg_index")) - 1
    return segments.withColumn("place", F.pmod(turn, F.col("pool_size")).cast("long")).join(members, ["job_id", "pool", "place"]).drop("place")


def use_ordinal(rows: DataFrame) -> DataFrame:
    """rows with uses: how often the job used the row's clip before."""
    return rows.withColumn("uses", (F.row_number().over(Window.partitionBy("job_id", "clip_id").orderBy("seg_index")) - 1).cast("long"))


def fit_source(available: Column, need: Column, uses: Column, options: PlanOptions | None = None) -> Column:
    """in_ms, out_ms, fit_mode and loops of a clip of `available` ms in a segment of `need` ms.

    Long enough: trimmed, and moved on at each reuse; too short to repeat: stretched; else looped.
    """
    o = options or PlanOptions()
    slack = available - need
    step = F.greatest(F.lit(500), F.floor(slack / 4)).cast("long")
    moved = F.when(F.lit(o.rotate_reused_footage) & (slack > 250), (uses * step) % (slack + 1)).otherwise(0)
    fit = lambda a, b, mode, loops: F.struct(a.cast("long").alias("in_ms"), b.cast("long").alias("out_ms"), F.lit(mode).alias("fit_mode"), loops.cast("long").alias("loops"))
    zero, one = F.lit(0), F.lit(1)
    looped = F.least(F.lit(o.max_loops), F.ceil(need / available))
    return (
        F.when(available <= 0, fit(zero, need, "stretch", one)).when(available >= need, fit(moved, moved + need, "trim", one))
        .when(available < 400, fit(zero, available, "stretch", one)).otherwise(fit(zero, available, "loop", looped))
    )


def plan_shots(segments: DataFrame, clips: DataFrame, entities: DataFrame, options: PlanOptions | None = None) -> DataFrame:
    """The shots of each job: one for each segment, with its clip and the part of it that is shown."""
    o = options or PlanOptions()
    members = pool_members(clips)
    chosen = use_ordinal(assign_clips(choose_pools(segments, members), members, o.avoid_immediate_repeat))
    named = chosen.join(entities.select("job_id", "entity_id", F.col("canonical").alias("entity_name")), ["job_id", "entity_id"], "left")
    rows = named.join(clips.select("job_id", "clip_id", F.col("filename").alias("clip_filename"), F.col("duration_ms").alias("_available")), ["job_id", "clip_id"])
    shown = F.coalesce("entity_name", "entity_id")
    # fixed values: reasons that callers compare
    reason = (
        F.when(F.col("pool_kind") == "fallback", "no clip for this character - b-roll").when(F.col("pool_kind") == "broll", "no character named - b-roll")
        .when(F.col("source") == "named", F.concat(F.lit("named: "), shown)).otherwise("carried from previous mention")
    )
    rows = rows.withColumn("fit", fit_source(F.col("_available"), F.col("duration_ms"), F.col("uses"), o))
    return rows.select(
        "job_id", F.col("seg_index").alias("segment_index"), "start_ms", "end_ms", "duration_ms", "clip_id", "clip_filename", F.col("fit.in_ms").alias("source_in_ms"),
        F.col("fit.out_ms").alias("source_out_ms"), "fit.fit_mode", "fit.loops", "entity_id", "entity_name", reason.alias("reason"), "text", "pool_kind",
    )


def plan_stats(shots: DataFrame) -> DataFrame:
    """total_duration_ms, shot_count, named_shots, broll_shots, unmatched_shots, clips_used and clip_reuse of each job."""
    count = lambda cond: F.count_if(cond).alias
    totals = shots.groupBy("job_id").agg(
        F.max("end_ms").alias("total_duration_ms"), F.count(F.lit(1)).alias("shot_count"), count(F.col("pool_kind") == "entity")("named_shots"),
        count(F.col("pool_kind") == "broll")("broll_shots"), count(F.col("pool_kind") == "fallback")("unmatched_shots"),
    )
    uses = shots.groupBy("job_id", "clip_id", "clip_filename").agg(F.count(F.lit(1)).alias("n"))
    reuse = uses.groupBy("job_id", "clip_filename").agg(F.max_by("n", "clip_id").alias("n"), F.count(F.lit(1)).alias("c")).groupBy("job_id").agg(F.sum("c").alias("clips_used"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("clip_filename", "n")))).alias("clip_reuse"))
    return totals.join(reuse, "job_id")


def overused_clips(shots: DataFrame) -> DataFrame:
    """Clips used more than six times and in more than a third of a job's shots."""
    uses = shots.groupBy("job_id", "clip_id").agg(F.count(F.lit(1)).alias("n"))
    total = shots.groupBy("job_id").agg(F.count(F.lit(1)).alias("shots"))
    return uses.join(total, "job_id").filter("n > greatest(6, shots / 3)").select("job_id", "clip_id", "n")


def plan_warnings(shots: DataFrame, clips: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id and warning: no clips, an entity without a clip (once each), a clip used too often."""
    # fixed values: sentences that callers compare
    none = jobs.select("job_id").join(clips.select("job_id").distinct(), "job_id", "left_anti").select("job_id", F.lit("No clips were provided, so there is nothing to build a video from.").alias("warning"))
    missing = shots.filter("pool_kind = 'fallback'").select("job_id", F.coalesce("entity_name", "entity_id").alias("n")).distinct()
    missing = missing.select("job_id", F.concat(F.lit('No clip is tagged for "'), "n", F.lit('" - those moments fall back to b-roll.')).alias("warning"))
    over = overused_clips(shots).join(clips.select("job_id", "clip_id", "filename"), ["job_id", "clip_id"])
    over = over.select("job_id", F.concat(F.lit('"'), "filename", F.lit('" is used '), "n", F.lit(" times. Add more clips for that character to reduce repetition.")).alias("warning"))
    return none.unionByName(missing).unionByName(over)


def replace_clip(shots: DataFrame, changes: DataFrame, clips: DataFrame, options: PlanOptions | None = None) -> DataFrame:
    """shots with the clip of single ones (changes: job_id, segment_index, clip_id) replaced and fitted anew, without rotation."""
    o = options or PlanOptions()
    new = changes.join(clips.select("job_id", "clip_id", F.col("filename").alias("new_name"), F.col("duration_ms").alias("available")), ["job_id", "clip_id"]).withColumnRenamed("clip_id", "new_id")
    rows = shots.join(new, ["job_id", "segment_index"], "left").withColumn("fit", fit_source(F.col("available"), F.col("duration_ms"), F.lit(0), o))
    swap = {"clip_id": "new_id", "clip_filename": "new_name", "source_in_ms": "fit.in_ms", "source_out_ms": "fit.out_ms", "fit_mode": "fit.fit_mode", "loops": "fit.loops"}
    changed = F.col("new_id").isNotNull()
    return rows.withColumns({c: F.when(changed, F.col(n)).otherwise(F.col(c)) for c, n in swap.items()}).withColumn("reason", F.when(changed, "chosen by hand").otherwise(F.col("reason"))).select(*shots.columns)


# frames


def frame_number(ms: Column, fps: Column | int) -> Column:
    return half_up(ms / F.lit(1000.0) * fps)


def frame_spans(shots: DataFrame, fps: int, partition: list[str] | None = None) -> DataFrame:
    """shots with frames: the difference of the frame numbers at their bounds, at least one. Rounding errors cancel along the way."""
    w = Window.partitionBy(*(partition or ["job_id"])).orderBy("start_ms")
    nxt = F.coalesce(F.lead("start_ms").over(w), F.col("end_ms"))
    return shots.withColumn("frames", F.greatest(F.lit(1).cast("long"), frame_number(nxt, fps) - frame_number(F.col("start_ms"), fps)))


def drifts(frames: Column, total_ms: Column, fps: int) -> Column:
    """Whether frames last at most one and a half frames more or less than total_ms."""
    return F.abs(frames * F.lit(1000.0) / fps - total_ms) <= F.lit(1500.0 / fps)


def playback_speed(available: Column, frames: Column, fps: int, fit_mode: Column) -> Column:
    needed = frames * F.lit(1000.0) / fps
    return F.when((fit_mode == "stretch") & (available > 0), F.greatest(F.lit(0.25), F.least(F.lit(1.0), available / needed))).otherwise(F.lit(1.0))


def part_chunks(rows: DataFrame, size: int = 40, order: str = "segment_index") -> DataFrame:
    """rows with chunk: parts of `size` in order."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("job_id").orderBy(order)) - 1) / size).cast("long"))


def pack_batches(rows: DataFrame, budget_bytes: int, order: str = "segment_index") -> DataFrame:
    """rows (job_id, clip_id, bytes) with batch: consecutive rows whose distinct clips, as they first come, fill a budget."""
    first = F.row_number().over(Window.partitionBy("job_id", "clip_id").orderBy(order)) == 1
    before = F.coalesce(F.sum("_new").over(Window.partitionBy("job_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_new", F.when(first, F.col("bytes")).otherwise(0)).withColumn("batch", F.floor(before / budget_bytes).cast("long")).drop("_new")


def progress(done: Column, total: Column, work_ms: Column) -> Column:
    """percent and eta_ms of a rendering."""
    fraction = done / total
    return F.struct(half_up(F.lit(2.0) + fraction * 78).alias("percent"), F.when(fraction > 0.03, half_up(work_ms / fraction - work_ms)).alias("eta_ms"))


def filter_chain(source: dict[str, Column], profile: dict, speed: Column) -> Column:
    """The encoder's filters for a shot, leaving out those that would change nothing."""
    w, h, fps = profile["width"], profile["height"], profile["fps"]
    crop = f"scale={w}:{h}:force_original_aspect_ratio=increase,crop={w}:{h}"
    pad = f"scale={w}:{h}:force_original_aspect_ratio=decrease,pad={w}:{h}:(ow-iw)/2:(oh-ih)/2:color=black"
    return F.concat_ws(
        ",", F.when(speed != 1, F.concat(F.lit("setpts="), F.format_string("%.6f", F.lit(1.0) / speed), F.lit("*PTS"))),
        F.when((source["width"] != w) | (source["height"] != h), F.lit(crop if profile.get("fill") == "crop" else pad)), F.lit("setsar=1"),
        F.when((speed != 1) | (F.abs(source["fps"] - fps) >= 0.01), F.lit(f"fps={fps}")), F.lit("format=yuv420p"),
    )


# views of a plan


def lanes(shots: DataFrame, entities: DataFrame) -> DataFrame:
    """Shots by entity in the order of entities, b-roll last: lane, lane_ord and its shots in order."""
    keyed = shots.withColumn("lane", F.coalesce("entity_id", F.lit("__broll")))
    order = entities.select("job_id", F.col("entity_id").alias("lane"), "entity_ord")
    rows = keyed.groupBy("job_id", "lane").agg(F.sort_array(F.collect_list("segment_index")).alias("shots"))
    return rows.join(order, ["job_id", "lane"], "left").withColumn("lane_ord", F.coalesce("entity_ord", F.lit(1 << 40))).drop("entity_ord")


def upper_median(rows: DataFrame, partition: list[str], value: str) -> DataFrame:
    """The value at position n / 2 of n in order: the upper of two middle ones. No group is gathered."""
    order = Window.partitionBy(*partition).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    return rows.withColumns({"_k": F.row_number().over(order) - 1, "_n": n}).filter("_k = _n div 2").select(*partition, F.col(value).alias("median"))


def contiguous(shots: DataFrame) -> DataFrame:
    """Shots that do not start where the one before ended (none, in a sound plan)."""
    end = F.lag("end_ms").over(Window.partitionBy("job_id").orderBy("start_ms"))
    return shots.withColumn("_e", end).filter("_e <> start_ms").drop("_e")
