"""From mentions to segments that tile a timeline.

Everything is joins and windows over stretches of a timeline (see stretches), so that no task holds a whole one. Only
floors are walked in order, over runs of segments between bounds that no merge can move. Words are read from blocks, a row
for a few hundred of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuebeam.functions.text import CONNECTORS, ends_sentence, may_refer_back, refers_back
from cuebeam.functions.time import half_up
from cuebeam.operators import stretches
from cuebeam.operators.stretches import carry, numbered
from cuebeam.staging import stage


@dataclass(frozen=True)
class SegmentOptions:
    """Floors and ceiling of a segment's length, and how long a name holds the screen."""

    min_named_ms: int = 600
    min_broll_ms: int = 2000
    max_duration_ms: int = 7000
    carry_forward: bool = True
    carry_forward_ms: int = 9000

    #: Bounds of each setting.
    BOUNDS = (("min_named_ms", 200, 10_000), ("min_broll_ms", 400, 20_000), ("max_duration_ms", 1000, 60_000), ("carry_forward_ms", 0, 60_000))

    def __post_init__(self):
        for name, least, most in self.BOUNDS:
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be between {least} and {most}")
        if self.min_broll_ms >= self.max_duration_ms:
            raise ValueError("min_broll_ms must be under max_duration_ms")
        if self.min_named_ms > self.min_broll_ms:
            raise ValueError("min_named_ms must not be over min_broll_ms")

    @classmethod
    def preset(cls, name: str) -> SegmentOptions:
        named, broll, most = {"rapid": (400, 1400, 4500), "balanced": (600, 2000, 7000), "relaxed": (1000, 3000, 11_000)}[name]
        return cls(min_named_ms=named, min_broll_ms=broll, max_duration_ms=most)

    def merged(self, **given) -> SegmentOptions:
        """These options with those given that are not None."""
        return replace(self, **{k: v for k, v in given.items() if v is not None})


# operators on rows


def collapse_runs(rows: DataFrame, partition: list[str], order: list[str | Column], key: str) -> DataFrame:
    """The first of each run of rows with one key (null is a key of its own)."""
    before = F.lag(F.struct(key)).over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.col("_before")[key].eqNullSafe(F.col(key))).drop("_before")


def merge_adjacent(segments: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """Runs of segments of one entity that follow each other word for word, as one; the first gives source, confidence and trigger."""
    job = ["job_id"]
    rows = carry(segments, job, "from_word", {"_was": ("before", F.struct("entity_id", "to_word"))}, long=long)
    goes_on = F.col("_was").isNotNull() & F.col("_was.entity_id").eqNullSafe(F.col("entity_id")) & (F.col("_was.to_word") == F.col("from_word"))
    rows = carry(rows, job, "from_word", {"_run": ("last", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("from_word")))}, long=long)
    firsts = [F.min_by(c, "from_word").alias(c) for c in ("entity_id", "source", "confidence", "trigger_surface")]
    text = F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from_word", "text"))), lambda t: t["text"]), " "))
    texts = [text.alias("text")] if "text" in segments.columns else []
    return rows.groupBy("job_id", "_run").agg(F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), *firsts, *texts).drop("_run").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def tile(rows: DataFrame, partition: list[str], total: Column, start: str = "start_ms") -> DataFrame:
    """rows with start_ms and end_ms that leave no gap: from 0, each to the next start, the last to the total."""
    w = Window.partitionBy(*partition).orderBy(start)
    nxt, first = F.lead(start).over(w), F.row_number().over(w) == 1
    rows = rows.withColumns({"_start": F.when(first, 0).otherwise(F.col(start)), "_end": F.coalesce(nxt, F.greatest(total, F.when(first, 0).otherwise(F.col(start)) + 1))})
    return rows.drop("start_ms", "end_ms").withColumnsRenamed({"_start": "start_ms", "_end": "end_ms"})


def split_long(rows: DataFrame, max_ms: int, tolerance: float = 1.25) -> DataFrame:
    """Rows (start_ms, end_ms) longer than tolerance * max_ms in equal parts of at most max_ms; part numbers them from 0."""
    length = F.col("end_ms") - F.col("start_ms")
    parts = F.when(length > max_ms * tolerance, F.ceil(length / F.lit(max_ms))).otherwise(1).cast("long")
    rows = rows.withColumns({"_start": F.col("start_ms"), "_length": length, "_parts": parts}).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    at = lambda p: F.col("_start") + half_up(F.col("_length") * p / F.col("_parts"))
    return rows.withColumns({"start_ms": at(F.col("part")), "end_ms": F.when(F.col("part") == F.col("_parts") - 1, F.col("end_ms")).otherwise(at(F.col("part") + 1))}).drop("_start", "_length", "_parts")


def stabbing_join(points: DataFrame, tiles: DataFrame, partition: list[str], at: str) -> DataFrame:
    """For each point the tile (start_ms <= at < end_ms) that holds it. Tiles leave no gap, so it is the last to start by then.

    One pass over both in order of time; no point meets more than one tile.
    """
    kept = [c for c in tiles.columns if c not in partition]
    both = points.select(*partition, F.col(at).alias("_t"), F.lit(1).alias("_k"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(tiles.select(F.struct(*kept)).schema[0].dataType).alias("_s")).unionByName(
        tiles.select(*partition, F.col("start_ms").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_p"), F.struct(*kept).alias("_s"))
    )
    w = Window.partitionBy(*partition).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).filter("_k = 1").filter("_t < _s.end_ms")
    return found.select("_p.*", *[F.col(f"_s.{c}").alias(f"tile_{c}") for c in kept])


# floors


def enforce_floors_rows(rows: list[dict], min_named: int, min_broll: int) -> list[dict]:
    """Merge segments under their floor into a neighbour until none can be.

    Of one entity with a neighbour: into that, the one before first. Else into the shorter neighbour, where a
    named one only goes into b-roll. After each merge the search begins anew, though nothing
    before the merged place can have changed but the segment right before it.
    """
    out = [dict(r) for r in rows]
    i = 0
    while i < len(out) and len(out) > 1:
        seg = out[i]
        length = lambda s: s["end_ms"] - s["start_ms"]
        if length(seg) >= (min_named if seg["entity_id"] is not None else min_broll):
            i += 1
            continue
        near = [k for k in (i - 1, i + 1) if 0 <= k < len(out)]
        same = [k for k in near if out[k]["entity_id"] == seg["entity_id"]]
        free = [k for k in near if seg["entity_id"] is None or out[k]["entity_id"] is None]
        if not same and not free:
            i += 1
            continue
        k = same[0] if same else min(free, key=lambda k: (length(out[k]), k))
        into = out[k]
        a, b = (into, seg) if k < i else (seg, into)
        text = {"text": f"{a['text']} {b['text']}".strip()} if "text" in seg else {}
        into |= {"start_ms": min(a["start_ms"], b["start_ms"]), "end_ms": max(a["end_ms"], b["end_ms"]), "from_word": min(a["from_word"], b["from_word"]), "to_word": max(a["to_word"], b["to_word"])} | text
        del out[i]
        i = max(0, min(i, k) - 1)  # a neighbour that found no target may have one now
    return out


def enforce_floors(segments: DataFrame, options: SegmentOptions | None = None, long: DataFrame | None = None) -> DataFrame:
    """Segments (job_id, from_word, to_word, start_ms, end_ms, entity_id, ..) merged until none is under its floor that can be helped.

    A segment that meets its floor is never merged into another, and takes in only what lies between it and the
    next such one. So the bound between two neighbours that both meet theirs stays, and nothing on one side tells on the other:
    runs between such bounds are walked each for itself, one after the other, in tasks dealt by run. All other columns are those of the segment
    that takes the others in, but for text, which is joined.
    """
    o, job = options or SegmentOptions(), ["job_id"]
    length = F.col("end_ms") - F.col("start_ms")
    met = length >= F.when(F.col("entity_id").isNotNull(), o.min_named_ms).otherwise(o.min_broll_ms)
    rows = carry(segments.withColumn("_met", met), job, "from_word", {"_before": ("before", F.col("_met"))}, long=long)
    begins = F.col("_before").isNull() | (F.col("_met") & F.col("_before"))
    rows = carry(rows, job, "from_word", {"_run": ("last", F.when(begins, F.col("from_word")))}, long=long).drop("_met", "_before")
    schema = segments.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[dict] = []
        held: list[dict] = []

        def table():
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], kinds[f.name]) for f in schema.fields], names=schema.names)

        for b in batches:
            kinds = {f.name: f.type for f in b.schema}
            for row in b.to_pylist():
                if held and (held[0]["job_id"], held[0]["_run"]) != (row["job_id"], row["_run"]):
                    out += enforce_floors_rows(held, o.min_named_ms, o.min_broll_ms) if len(held) > 1 else held
                    held = []
                    if len(out) >= 10_000:
                        yield table()
                        out = []
                held.append(row)
        if held:
            out += enforce_floors_rows(held, o.min_named_ms, o.min_broll_ms)
            yield table()

    return rows.repartition("job_id", "_run").sortWithinPartitions("job_id", "_run", "from_word").mapInArrow(run, schema)


# words of one job

#: Words in a block.
BLOCK = 128


def _block_size() -> int:
    return max(3, min(BLOCK, stretches.STRETCH))


def word_blocks(words: DataFrame) -> DataFrame:
    """Words (word_index from 0 without holes, in order of time) as blocks, so that steps move a row for a few hundred words.

    Lists of raw, start (ms), stop (ms) and clause (the word a clause begins with that the word tells of) hold a block's words and,
    where there are any, the two before and the one after; the first is word number `first`. `own` is the first that is not of the block before.
    """
    size, i = _block_size(), F.col("word_index")
    clause = F.when(F.regexp_like("raw", F.lit("[,;:—–-]$")), i + 1).when(F.col("norm").isin(*CONNECTORS), i)
    at = F.floor(i / F.lit(size))
    both = F.when((i > 0) & (i % size == 0), F.array(at - 1, at)).when(i % size >= size - 2, F.array(at, at + 1)).otherwise(F.array(at))
    rows = words.select("job_id", F.explode(both).alias("block"), "word_index", "raw", "start_ms", "end_ms", clause.cast("long").alias("clause"))
    schema = "job_id string, block long, first long, own long, raw array<string>, start array<long>, stop array<long>, clause array<long>"

    def lists(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def put(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
            """A row for each run of rows up to the next of ends."""
            begins, offsets = pa.array(ends[:-1]), pa.array(ends, pa.int32())
            one = lambda name: rows[name].combine_chunks()
            block, first = one("block").take(begins), one("word_index").take(begins)
            found = [pa.ListArray.from_arrays(offsets, one(name)) for name in ("raw", "start_ms", "end_ms", "clause")]
            out = pa.RecordBatch.from_arrays([one("job_id").take(begins), block, first, pc.multiply(block, size), *found], names=["job_id", "block", "first", "own", "raw", "start", "stop", "clause"])
            # words at a job's end were told to a block that has none of its own
            return out.filter(pc.greater(pc.add(first, pc.list_value_length(found[0])), out["own"]))

        held = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows])
            new = pc.or_(pc.not_equal(rows["job_id"][1:], rows["job_id"][:-1]), pc.not_equal(rows["block"][1:], rows["block"][:-1]))
            at = np.flatnonzero(new.to_numpy()) + 1
            if at.size:
                yield put(rows.slice(0, at[-1]), np.r_[0, at])
            held = rows.slice(at[-1] if at.size else 0)
        if held is not None and held.num_rows:
            yield put(held, np.array([0, held.num_rows]))

    return rows.repartition("job_id", "block").sortWithinPartitions("job_id", "block", "word_index").mapInArrow(lists, schema)


def _within(word: Column | str) -> Column:
    """Where in its block's lists a word stands."""
    return ((F.col(word) if isinstance(word, str) else word) - F.col("first")).cast("int")


def look_up(rows: DataFrame, blocks: DataFrame, word: str, found: dict[str, str], back: int = 0) -> DataFrame:
    """rows with columns {name: list of blocks} of the word whose number is in column `word`, less `back`; rows whose word there is not are left out."""
    i = F.col(word) - back
    held = blocks.select("job_id", "block", "first", *found.values())
    both = rows.withColumn("block", F.floor(i / F.lit(_block_size()))).join(held, ["job_id", "block"])
    return both.select(*rows.columns, *[F.get(c, _within(i)).alias(name) for name, c in found.items()]).dropna(subset=list(found))


def _own_words(blocks: DataFrame) -> DataFrame:
    """The blocks' words, each once, as word_index, and pos in the lists."""
    rows = blocks.select("*", F.posexplode("raw").alias("pos", "word")).withColumn("word_index", F.col("first") + F.col("pos"))
    return rows.filter((F.col("word_index") >= F.col("own")) & (F.col("word_index") < F.col("own") + _block_size()))


def place_spans(blocks: DataFrame, jobs: DataFrame, long: DataFrame, mentions: DataFrame, reach: int = 5) -> DataFrame:
    """from_word and to_word of what each change of entity covers, with its entity_id, confidence, trigger_surface and said_until; b-roll before the first.

    jobs: job_id and n, the number of its words. A mention is cut at the clause that holds it, if that began at most `reach` words before and after
    the cut before; else at itself. Which of the two depends on which of the two the cut before took. Most mentions settle it whatever
    that was, and the others do as the one before: so the last mention that settles it decides.
    """
    job = ["job_id"]
    heard = mentions.select("job_id", "word_index", "surface", F.col("end_ms").alias("said_until"), "entity_id", F.col("confidence").cast("double").alias("confidence"))
    heard = carry(heard, job, "word_index", {"_was": ("before", F.struct("entity_id"))}, long=long)
    changes = stage(heard.filter(~F.col("entity_id").eqNullSafe(F.col("_was.entity_id"))).drop("_was"), "heard")
    clauses = _own_words(blocks.select("job_id", "first", "own", "raw", "clause")).select("job_id", F.col("word_index").alias("i"), F.get("clause", F.col("pos")).alias("c")).filter("c is not null")
    before = changes.filter("word_index > 0").select("job_id", "word_index", F.explode(F.expr(f"sequence(greatest(0, word_index - {reach}), word_index - 1)")).alias("i"))
    hits = before.join(clauses, ["job_id", "i"]).groupBy("job_id", "word_index").agg(F.max("i").alias("i"), F.max_by("c", "i").alias("c"))
    hits = hits.select("job_id", "word_index", F.struct("i", "c").alias("hit"))
    rows = stage(changes.join(hits, ["job_id", "word_index"], "left"), "changes")
    rows = carry(rows, job, "word_index", {"_prev": ("before", F.struct("word_index", "hit"))}, long=long)
    free_late = F.coalesce(F.col("_prev.word_index") + 1, F.lit(0))  # where the cut before was at its mention
    free_early = F.coalesce(F.col("_prev.hit.c") + 1, free_late)
    settled = F.when(F.col("hit").isNull() | (free_early > F.col("hit.i")), "mention").when(free_late <= F.col("hit.i"), "clause")
    rows = stage(carry(rows, job, "word_index", {"_at": ("last", settled)}, long=long), "settled")
    rows = rows.withColumn("from_word", F.when(F.col("_at") == "clause", F.col("hit.c")).otherwise(F.col("word_index")).cast("long"))
    rows = stage(carry(rows, job, "word_index", {"to_word": ("next", F.col("from_word"))}, long=long), "cuts")
    ends = jobs.select("job_id", "n")
    named = rows.filter("to_word is not null").unionByName(rows.filter("to_word is null").drop("to_word").join(ends, job).withColumnRenamed("n", "to_word"))
    named = named.select("job_id", "from_word", "to_word", "entity_id", "confidence", F.col("surface").alias("trigger_surface"), "said_until", F.lit("named").alias("source"))
    first = rows.filter("_prev is null").select("job_id", F.col("from_word").alias("to_word"))
    whole = ends.join(first.select("job_id"), job, "left_anti").select("job_id", F.col("n").alias("to_word"))
    broll = first.unionByName(whole).filter("to_word > 0").select(
        "job_id", F.lit(0).cast("long").alias("from_word"), "to_word", F.lit(None).cast("string").alias("entity_id"), F.lit(0.0).alias("confidence"),
        F.lit(None).cast("string").alias("trigger_surface"), F.lit(None).cast("long").alias("said_until"), F.lit("broll").alias("source"),
    )
    return named.unionByName(broll)


def hold_ends(blocks: DataFrame, long: DataFrame, spans: DataFrame, options: SegmentOptions) -> DataFrame:
    """job_id, from_word and hold: where in a span (from_word, to_word, said_until) the narration stops referring to who was named; spans it holds to their end have no row.

    Sentences begin with the span and behind each sentence's end. The first one ever after that comes too late, or
    refers to nobody, ends it. Only words that begin a sentence or refer back are told from. What refers back has three words at most: `since` is
    the last word a text may begin with that refers back with this one.
    """
    back = lambda k: F.get("raw", F.col("pos") - k)
    refers = F.when(~may_refer_back(F.col("word")), None).when(refers_back(F.col("word")), 0).when(refers_back(F.concat_ws(" ", back(1), "word")), 1).when(refers_back(F.concat_ws(" ", back(2), back(1), "word")), 2)
    rows = _own_words(blocks.select("job_id", "first", "own", "raw", "start"))
    told = rows.select("job_id", "word_index", F.when(ends_sentence(back(1)), F.get("start", F.col("pos"))).alias("onset"), (F.col("word_index") - refers).alias("since"))
    told = stage(told.filter("onset is not null or since is not null"), "told")
    none = F.lit(None).cast("long")
    span = F.struct("from_word", "said_until")
    at = spans.select("job_id", F.col("from_word").alias("word_index"), none.alias("onset"), none.alias("since"), span.alias("_span"))
    rows = told.withColumn("_span", F.lit(None).cast(at.schema["_span"].dataType)).unionByName(at)
    begins = F.col("_span").isNotNull() | F.col("onset").isNotNull()
    # a span's row comes before its first word's own
    rows = carry(rows.withColumn("_k", F.when(F.col("_span").isNull(), 1).otherwise(0)), ["job_id"], "word_index", {"_span": ("last", F.col("_span")), "_from": ("last", F.when(begins, F.col("word_index")))}, ["_k"], long=long)
    rows = rows.filter("_span is not null and _from > _span.from_word")
    sentence = rows.groupBy("job_id", F.col("_span.from_word").alias("from_word"), "_from").agg(
        F.coalesce(F.max("since") >= F.col("_from"), F.lit(False)).alias("refers"), F.max(F.col("onset") - F.col("_span.said_until")).alias("pause")
    )
    over = sentence.filter(~(F.col("refers") & (F.col("pause") <= options.carry_forward_ms)))
    return over.groupBy("job_id", "from_word").agg(F.min("_from").alias("hold"))


def _onsets_in_blocks(blocks: DataFrame, long: DataFrame, targets: DataFrame) -> DataFrame:
    """words.nearest_onset over blocks, for targets of at least one word, which all exist.

    Targets meet blocks, not words, in order of time; the rest is told from the lists of the block a target falls into.
    """
    size, job = _block_size(), ["job_id"]
    asked = look_up(look_up(targets, blocks, "from_word", {"_from_ms": "start"}), blocks, "to_word", {"_to_ms": "start"}, back=1)
    at = F.least(F.greatest(F.col("target_ms"), "_from_ms"), "_to_ms").cast("double")
    opens = blocks.select("job_id", "block", F.get("start", _within("own")).cast("double").alias("_at"), F.lit(0).alias("_k"))
    asks = F.struct("target_id", "from_word", "to_word", F.col("target_ms").cast("double").alias("ms"))
    both = opens.unionByName(asked.select("job_id", at.alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("block"), asks.alias("_asks")), allowMissingColumns=True)
    met = carry(both, job, "_at", {"block": ("last", F.col("block"))}, ["_k", "block"], stretches.MS_STRETCH, long).filter("_k = 1").select("job_id", "block", "_at", "_asks.*")
    # words of one onset may begin in a block before: where the last words before this block's began to
    last = F.least(F.col("own") + size, F.col("first") + F.size("start")) - 1
    began = F.col("first") + F.array_position("start", F.get("start", _within(last))) - 1
    before = F.get("start", _within(F.col("own") - 1))
    new = F.when((began > F.col("own")) | ((began == F.col("own")) & (before.isNull() | (before < F.get("start", _within("own"))))), began)
    runs = carry(blocks.select("job_id", "block", new.alias("_new")), job, "block", {"_same": ("before", F.col("_new"))}, long=long).select("job_id", "block", "_same")
    same = blocks.select("job_id", "block", "first", "own", "start").join(runs, ["job_id", "block"])
    rows = met.withColumn("_until", F.floor("_at").cast("long")).join(same, ["job_id", "block"])
    heard = F.size(F.filter("start", lambda x: x <= F.col("_until")))
    rows = rows.withColumn("_heard", heard).withColumn("_low_ms", F.get("start", F.col("_heard") - 1)).withColumn("_word", F.col("first") + F.array_position("start", F.col("_low_ms")) - 1)
    rows = rows.withColumn("_low", F.greatest(F.when(F.col("_word") >= F.col("own"), F.col("_word")).otherwise(F.col("_same")), "from_word"))
    high, high_ms = F.col("first") + F.col("_heard"), F.get("start", F.col("_heard"))
    later = (high < F.col("to_word")) & (high_ms - F.col("ms") < F.col("ms") - F.col("_low_ms"))
    found = rows.select("job_id", "target_id", F.when(F.coalesce(later, F.lit(False)), high).otherwise(F.col("_low")).alias("word_index"), "from_word", "to_word")
    return found.filter("word_index >= from_word and word_index < to_word").select("job_id", "target_id", "word_index")


def split_on_onsets(segments: DataFrame, blocks: DataFrame, long: DataFrame, most: int) -> DataFrame:
    """Segments longer than `most`, of four words at least, in equal parts that begin at the nearest word each.

    A part begins at its word or, where the part before got that far, at the word behind the one that did: that is a running
    maximum. Parts that find no word left are none. Only first parts keep a trigger; but for the last one's, ends are open.
    """
    length = F.col("end_ms") - F.col("start_ms")
    is_long = (length > most) & (F.col("to_word") - F.col("from_word") >= 4)
    parts = F.ceil(length / F.lit(most)).cast("long")
    cut = segments.filter(is_long).withColumns({"_parts": parts, "_length": length}).withColumn("p", F.explode(F.expr("sequence(1L, _parts - 1)")))
    aim = F.col("start_ms") + F.col("_length") / F.col("_parts") * F.col("p")
    targets = cut.select("job_id", F.struct("from_word", "p").alias("target_id"), (F.col("from_word") + 1).alias("from_word"), "to_word", aim.alias("target_ms"))
    near = stage(_onsets_in_blocks(blocks, long, targets).select("job_id", F.col("target_id.from_word").alias("_seg"), F.col("target_id.p").alias("p"), "word_index"), "onsets")
    far = carry(near, ["job_id", "_seg"], "p", {"_far": ("max", F.col("word_index") - F.col("p"))})
    begins = far.select("job_id", "_seg", (F.col("_far") + F.col("p")).alias("_begin"), "p")
    found = segments.filter(is_long).withColumnRenamed("from_word", "_seg").join(begins, ["job_id", "_seg"]).filter("_begin < to_word")
    found = look_up(found, blocks, "_begin", {"_onset": "start"})
    later = found.select(*[F.col("_begin").alias(c) if c == "from_word" else F.col("_onset").alias(c) if c == "start_ms" else F.lit(None).cast("string").alias(c) if c == "trigger_surface" else F.col(c) for c in segments.columns])
    every = carry(segments.unionByName(later), ["job_id"], "from_word", {"_next": ("next", F.col("from_word"))}, long=long)
    return every.withColumn("to_word", F.coalesce("_next", "to_word")).drop("_next")


def segment_texts(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """job_id, from_word and text: each segment's words. Only segments of several blocks are put together from pieces."""
    size = _block_size()
    block = lambda i: F.floor(i / F.lit(size))
    one = block(F.col("from_word")) == block(F.col("to_word") - 1)
    asked = segments.select("job_id", "from_word", "to_word", F.explode(F.sequence(block(F.col("from_word")), block(F.col("to_word") - 1))).alias("block"), one.alias("_one"))
    low, high = F.greatest("from_word", "own"), F.least(F.col("to_word"), F.col("own") + size)
    piece = F.array_join(F.slice("raw", _within(low) + 1, (high - low).cast("int")), " ")
    pieces = asked.join(blocks.select("job_id", "block", "first", "own", "raw"), ["job_id", "block"]).select("job_id", "from_word", "block", "_one", piece.alias("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda t: t["text"]), " ")
    return pieces.filter("_one").select("job_id", "from_word", "text").unionByName(pieces.filter("not _one").groupBy("job_id", "from_word").agg(text.alias("text")))


SEGMENTS = "job_id string, seg_index long, start_ms long, end_ms long, duration_ms long, entity_id string, source string, confidence double, text string, from_word long, to_word long, trigger_surface string"
_COLUMNS = [c.split()[0] for c in SEGMENTS.split(", ")]


def _tiled(parts: DataFrame, totals: DataFrame, long: DataFrame) -> DataFrame:
    """parts without gaps, from 0 to the total (or the last end, if later than the last start)."""
    ways = {"_next": ("next", F.col("start_ms")), "_seen": ("before", F.lit(1))}
    rows = carry(parts, ["job_id"], "start_ms", ways, ["from_word"], stretches.MS_STRETCH, long)
    start = F.when(F.col("_seen").isNull(), F.lit(0).cast("long")).otherwise(F.col("start_ms"))
    rows = stage(rows.withColumn("start_ms", start), "starts")
    ends = totals.filter("total_ms > 0").groupBy("job_id").agg(F.max("total_ms").alias("_total"))
    last = rows.filter("_next is null").join(ends, "job_id", "left")  # a row for each job
    last = last.withColumn("end_ms", F.greatest(F.coalesce("_total", "end_ms"), F.col("start_ms") + 1)).drop("_total")
    return rows.filter("_next is not null").withColumn("end_ms", F.col("_next")).unionByName(last).drop("_next", "_seen")


def build_segments(words: DataFrame, mentions: DataFrame, totals: DataFrame, options: SegmentOptions | None = None) -> DataFrame:
    """Segments of each job of totals (job_id, total_ms); jobs without words are one stretch of b-roll.

    words have word_index from 0 without holes, in order of time. They are read once, into blocks.
    """
    o, job, size = options or SegmentOptions(), ["job_id"], _block_size()
    blocks = stage(word_blocks(words.filter("job_id is not null")), "blocks")
    sizes = blocks.groupBy("job_id").agg(F.max(F.col("first") + F.size("start")).alias("n"), F.min(F.get("start", F.lit(0))).alias("first_ms"), F.max(F.element_at("stop", -1)).alias("last_ms"))
    jobs = stage(sizes.join(totals.groupBy("job_id").agg(F.max("total_ms").alias("total_ms")), job, "left"), "jobs")
    # what no stretch but the first holds rows of, in words and in time, needs no look at other stretches
    long = jobs.filter((F.col("n") >= stretches.STRETCH) | (F.greatest("last_ms", "total_ms") >= stretches.MS_STRETCH) | (F.col("first_ms") < 0)).select("job_id")
    spans = stage(place_spans(blocks, jobs, long, mentions), "spans")
    named = spans.filter("source = 'named'")
    hold = hold_ends(blocks, long, named, o) if o.carry_forward else named.select("job_id", "from_word", (F.col("from_word") + 1).alias("hold"))
    until = F.coalesce("hold", "to_word")
    part = lambda a, b, *rest: F.struct(a.alias("from_word"), b.alias("to_word"), *[c.alias(n) for c, n in zip(rest, ("entity_id", "source", "confidence", "trigger_surface"), strict=True)])
    none = F.lit(None).cast("string")
    kept = part(F.col("from_word"), until, F.col("entity_id"), F.col("source"), F.col("confidence"), F.col("trigger_surface"))
    rest = part(until, F.col("to_word"), none, F.lit("broll"), F.lit(0.0), none)
    rows = spans.join(hold, ["job_id", "from_word"], "left").select("job_id", F.explode(F.array(kept, rest)).alias("s")).select("job_id", "s.*").filter("from_word < to_word")
    rows = look_up(look_up(rows, blocks, "from_word", {"start_ms": "start"}), blocks, "to_word", {"end_ms": "stop"}, back=1)
    merged = stage(merge_adjacent(stage(rows, "held"), long).drop("duration_ms"), "merged")
    floored = stage(enforce_floors(merged, o, long), "floored")
    parts = stage(split_on_onsets(floored, blocks, long, o.max_duration_ms), "parts")
    tiles = split_long(_tiled(parts, totals, long), o.max_duration_ms)
    silent = totals.filter("total_ms > 0").select("job_id", "total_ms").join(jobs.select("job_id"), job, "left_anti").select(
        "job_id", F.lit(0).cast("long").alias("start_ms"), F.col("total_ms").cast("long").alias("end_ms"), none.alias("entity_id"), F.lit("broll").alias("source"), F.lit(0.0).alias("confidence"),
        F.lit(0).cast("long").alias("from_word"), F.lit(0).cast("long").alias("to_word"), none.alias("trigger_surface"), F.lit(0).cast("long").alias("part"),
    )
    every = numbered(tiles.unionByName(silent), job, "start_ms", "seg_index", ["from_word", "part"], stretches.MS_STRETCH, long)
    every = every.join(segment_texts(parts, blocks), ["job_id", "from_word"], "left")
    first = F.col("part") == 0
    every = every.withColumns({"text": F.when(first, F.coalesce("text", F.lit(""))).otherwise(""), "trigger_surface": F.when(first, F.col("trigger_surface"))})
    return every.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms")).filter("duration_ms > 0").select(*_COLUMNS)
