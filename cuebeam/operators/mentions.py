"""The cast read off clip names, and where the words mention it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuebeam.functions.names import edit_budget_col, letters_and_sounds_udf, similarity, similarity_udf, token_keys, token_keys_udf
from cuebeam.functions.text import COMMON_WORDS, filename_tokens, guess_kind, lower, normalize_word, slug, title_case, tokens

#: Tokens of a known name under this length must be heard exactly.
FUZZY_FROM = 4


def clip_readings(clips: DataFrame) -> DataFrame:
    """What each clip (job_id, clip_ord, clip_id, filename, tags) may be called: its tags if it has any, else its file name.

    readings is an array of arrays of normalized tokens; tagged says where they are from.
    """
    words = lambda t: F.filter(F.transform(tokens(lower(t)), normalize_word), lambda w: w != "")
    tagged = F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0
    of_tags = F.filter(F.transform("tags", words), lambda r: F.size(r) > 0)
    return clips.select("job_id", "clip_ord", "clip_id", "filename", tagged.alias("tagged"), F.when(tagged, of_tags).otherwise(F.array(filename_tokens(F.col("filename")))).alias("readings"))


#: Pairs of known and heard tokens of one job and first letter up to which all meet; of more, those that share a key do. Both ways find
#: the same. Where all meet, a pair costs a look at its letters and sounds; a token has up to 64 keys, so two tokens may meet that often.
MOST_PAIRS = 20_000_000


def token_candidates(known: DataFrame, heard: DataFrame, phonetic: bool = True) -> DataFrame:
    """(job_id, known, heard) of different tokens of a job that may be similar: of one first letter, nearly a length and few edits apart.

    Most jobs have few tokens that begin alike: there each known one meets each. Where they are more than MOST_PAIRS pairs, tokens are
    posted under their keys (see token_keys) and meet those that share one. Tokens of different jobs never meet.
    """
    by, letter = ["job_id", "letter"], lambda c: F.substring(c, 1, 1)
    left = known.select("job_id", "known").filter(F.length("known") >= FUZZY_FROM).distinct().withColumn("letter", letter("known"))
    right = heard.select("job_id", "heard").filter("heard <> ''").distinct().withColumn("letter", letter("heard"))
    like = left.groupBy(*by).agg((F.min(F.length("known")) - 3).alias("low"), (F.max(F.length("known")) + 3).alias("high"), F.count(F.lit(1)).alias("n"))
    near = right.join(like, by).filter("length(heard) between low and high").select(*by, "heard", "n")
    many = near.groupBy(*by).agg((F.count(F.lit(1)) * F.first("n")).alias("pairs")).filter(F.col("pairs") > MOST_PAIRS).select(*by)
    # tokens are small and their keys are not: dealt by number, so that few bytes do not end up in few tasks
    tasks = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # most pairs are told apart by the letters they have and by their sounds, which are told once a token
    traits = lambda df, c: df.withColumn(f"{c}_is", letters_and_sounds_udf(F.col(c)))
    keyed = lambda df, c: traits(df.join(many, by, "left_semi").repartition(tasks, "job_id", c), c).select("job_id", c, f"{c}_is", F.explode(token_keys_udf(F.col(c), phonetic)).alias("key")).withColumn("key", F.xxhash64("key"))
    near_letters = (F.abs(F.length("known") - F.length("heard")) <= 3) & (F.bit_count(F.col("known_is.letters").bitwiseXOR(F.col("heard_is.letters"))) <= F.col("most"))
    met = traits(near.join(many, by, "left_anti"), "heard").join(traits(left, "known"), by).withColumn("most", _most_edits(phonetic)).filter(near_letters).select("job_id", "known", "heard", "most")
    met = met.unionByName(keyed(left, "known").join(keyed(near, "heard"), ["job_id", "key"]).withColumn("most", _most_edits(phonetic)).filter(near_letters).select("job_id", "known", "heard", "most").distinct())
    edits = F.levenshtein(lower(F.col("known")), lower(F.col("heard")), 10 if phonetic else 6)
    return met.filter("known <> heard").filter((edits >= 0) & (edits <= F.col("most"))).drop("most")


def _most_edits(phonetic: bool) -> Column:
    """How many edits without swaps, and bits of letters, similarity() lets known and heard be apart: an edit that swaps neighbours is two, one that
    replaces a letter changes two bits, and what differs by plurals alone is three apart at most. Only tokens that sound alike get the wider budget."""
    budget = edit_budget_col(F.greatest(F.length("known"), F.length("heard")))
    if phonetic:
        same = lambda c: (F.col(f"known_is.{c}") != "") & ((F.col(f"known_is.{c}") == F.col("heard_is.primary")) | (F.col(f"known_is.{c}") == F.col("heard_is.alternate")))
        budget = budget + F.when(same("primary") | same("alternate"), 2).otherwise(0)
    return F.greatest(F.lit(3), 2 * budget)


def token_pairs(known: DataFrame, heard: DataFrame, fuzzy: bool = True, phonetic: bool = True) -> DataFrame:
    """(job_id, known, heard, score): tokens that name the same."""
    left, right = known.filter("known <> ''").distinct(), heard.filter("heard <> ''").distinct()
    equal = left.join(right, (left["job_id"] == right["job_id"]) & (F.col("known") == F.col("heard"))).select(left["job_id"], "known", "heard", F.lit(1.0).alias("score"))
    if not fuzzy:
        return equal
    alike = token_candidates(left, right, phonetic).withColumn("s", similarity_udf(F.col("known"), F.col("heard"), phonetic)).filter("s.match")
    return equal.unionByName(alike.select("job_id", "known", "heard", F.col("s.score").alias("score")))


def phrase_hits(phrases: DataFrame, words: DataFrame, fuzzy: bool = True, phonetic: bool = True) -> DataFrame:
    """Every place where a phrase (job_id, phrase_id, tokens) is spoken: word_index, word_count and confidence.

    Each token of a phrase meets the words it may be; a place counts when all tokens meet in a row there.
    """
    parts = phrases.filter(F.size("tokens") > 0).select("job_id", "phrase_id", F.size("tokens").alias("word_count"), F.posexplode("tokens").alias("k", "known"))
    pairs = token_pairs(parts.select("job_id", "known"), words.select("job_id", F.col("norm").alias("heard")), fuzzy, phonetic)
    met = parts.join(pairs, ["job_id", "known"]).join(words.select("job_id", "word_index", F.col("norm").alias("heard")), ["job_id", "heard"])
    starts = met.groupBy("job_id", "phrase_id", "word_count", (F.col("word_index") - F.col("k")).alias("word_index")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("confidence"))
    return starts.filter("n = word_count").drop("n")


def _cast(spoken: dict[tuple[str, ...], int], clips, declared, common: frozenset[str], phonetic: bool = True):
    members: list[dict] = []
    posted: dict[str, set[int]] = {}  # members by keys of their aliases' tokens: any two similar tokens share one

    def alike(m, name):
        for alias in m["aliases"]:
            parts = alias.split(" ")
            if len(parts) == len(name) and all(similarity(p, t, phonetic)[0] for p, t in zip(parts, name, strict=True)):
                return True
        return len(name) == 1 and len(name[0]) >= 3 and any(len(p) >= 3 and similarity(p, name[0], phonetic)[0] for a in m["aliases"] for p in a.split(" "))

    def find(name):
        near = set().union(*[posted.get(k, ()) for k in token_keys(name[0], phonetic)])
        return next((members[k] for k in sorted(near) if alike(members[k], name)), None)

    def join(name, shown, clip_id, auto):
        m = find(name)
        if m is None:
            m = {"number": len(members), "canonical": shown, "aliases": {}, "clips": [], "auto": auto}
            members.append(m)
        elif clip_id is not None:
            m["auto"] = True
        else:
            return
        if " ".join(name) not in m["aliases"]:
            m["aliases"][" ".join(name)] = None
            for key in {k for t in name for k in token_keys(t, phonetic)}:
                posted.setdefault(key, set()).add(m["number"])
        if clip_id is not None:
            m["clips"].append(clip_id)

    for shown, name in declared:
        if len(name):
            join(tuple(name), shown, None, False)
    for clip_id, tagged, readings in clips:
        for reading in readings:
            reading = tuple(reading)
            options = [reading[:k] for k in range(min(4, len(reading)), 0, -1)]
            name = next((o for o in options if spoken.get(o, 0) and not (len(o) == 1 and o[0] in common)), None)
            if name is None and tagged and reading:
                name = reading[:3]
            if name:
                join(name, None, clip_id, True)
                break
    return members


def build_cast(clips: DataFrame, words: DataFrame, declared: DataFrame | None = None, common_words: frozenset[str] = COMMON_WORDS, phonetic: bool = True) -> DataFrame:
    """entity_ord, entity_id, canonical, aliases, auto, kind and clip_ids of each job's cast.

    clips: job_id, clip_ord, clip_id, filename, tags; declared: job_id, name_ord, name. A clip's name is the
    longest beginning of its reading (up to four tokens) that the words contain. Which beginnings are
    spoken is found for all jobs at once; only the clustering of names into people, which
    depends on their order, walks a job's clips one after the other.
    """
    readings = clip_readings(clips)
    reading = readings.select("job_id", F.explode("readings").alias("r")).filter(F.size("r") > 0)
    prefixes = reading.select("job_id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size("r"))), lambda k: F.slice("r", 1, k))).alias("tokens")).distinct()
    prefixes = prefixes.withColumn("phrase_id", F.array_join("tokens", " "))
    hits = phrase_hits(prefixes, words, phonetic=phonetic).groupBy("job_id", "phrase_id").agg(F.count(F.lit(1)).alias("hits"))
    spoken = hits.groupBy("job_id").agg(F.collect_list(F.struct("phrase_id", "hits")).alias("spoken"))
    by_job = readings.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("clip_ord", "clip_id", "tagged", "readings"))).alias("clips"))
    jobs = by_job.join(spoken, "job_id", "left")
    if declared is not None:
        name = F.filter(F.transform(tokens(lower("name")), normalize_word), lambda w: w != "")
        names = declared.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("name_ord", F.trim("name").alias("name"), name.alias("tokens")))).alias("declared"))
        jobs = jobs.join(names, "job_id", "full")
    else:
        jobs = jobs.withColumn("declared", F.lit(None).cast("array<struct<name_ord:bigint,name:string,tokens:array<string>>>"))

    def some(x):
        return [] if x is None else list(x)

    def run(batches):
        for pdf in batches:
            out = []
            for job in pdf.itertuples():
                said = {tuple(s["phrase_id"].split(" ")): s["hits"] for s in some(job.spoken)}
                members = _cast(said, [(c["clip_id"], c["tagged"], c["readings"]) for c in some(job.clips)], [(d["name"], d["tokens"]) for d in some(job.declared)], common_words, phonetic)
                out += [(job.job_id, k, m["canonical"], list(m["aliases"]), m["auto"], m["clips"]) for k, m in enumerate(members)]
            yield pd.DataFrame(out, columns=["job_id", "entity_ord", "shown", "seeds", "auto", "clip_ids"])

    cast = jobs.mapInPandas(run, "job_id string, entity_ord long, shown string, seeds array<string>, auto boolean, clip_ids array<string>")
    canonical = F.coalesce("shown", title_case(F.get("seeds", F.lit(0))))
    cast = cast.withColumn("canonical", canonical).withColumn("_slug", slug(canonical))
    # the first entity of a name has it as its id, later ones get a number
    n = F.row_number().over(Window.partitionBy("job_id", "_slug").orderBy("entity_ord"))
    cast = cast.withColumn("entity_id", F.when(n == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("-"), n)))
    return cast.select("job_id", "entity_ord", "entity_id", "canonical", expand_aliases(F.col("seeds"), F.col("canonical"), common_words).alias("aliases"), "auto", guess_kind(canonical).alias("kind"), "clip_ids")


#: How many names a job may declare, and how long each may be.
MOST_NAMES, LONGEST_NAME = 60, 80


def declared_bounds(declared: DataFrame) -> DataFrame:
    """names, longest and admitted of each job's declared names (job_id, name_ord, name)."""
    sizes = declared.groupBy("job_id").agg(F.count(F.lit(1)).alias("names"), F.max(F.coalesce(F.length("name"), F.lit(0))).cast("long").alias("longest"))
    return sizes.withColumn("admitted", (F.col("names") <= MOST_NAMES) & (F.col("longest") <= LONGEST_NAME))


def known_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions of entities that a job has."""
    return mentions.join(entities.select("job_id", "entity_id"), ["job_id", "entity_id"], "left_semi")


def expand_aliases(seeds: Column, canonical: Column, common_words: frozenset[str] = COMMON_WORDS) -> Column:
    """Seeds and the name itself, with the first word, the last word and the initials of each of several words.

    At least two characters, no common words; most words first, then the longest.
    """
    keep = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: lower(F.trim(x))), lambda x: (F.length(x) >= 2) & ~x.isin(*sorted(common_words))))
    whole = keep(F.concat(seeds, F.array(canonical)))
    parts = lambda x: tokens(x)
    short = F.transform(
        F.filter(whole, lambda x: F.size(parts(x)) >= 2),
        lambda x: F.array(F.get(parts(x), F.lit(0)), F.element_at(parts(x), -1), F.array_join(F.transform(parts(x), lambda p: F.substring(p, 1, 1)), "")),
    )
    every = keep(F.concat(whole, F.flatten(short)))
    ranked = F.transform(every, lambda x, i: F.struct((-F.size(tokens(x))).alias("w"), (-F.length(x)).alias("l"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(ranked), lambda r: r["x"])


def greedy_spans(spans: DataFrame, partition: list[str], start: str = "word_index", count: str = "word_count") -> DataFrame:
    """Spans taken from left to right, each that does not begin inside the last one taken.

    Spans of a partition start at different places. Where a span can't overlap its successor no order
    matters, so only runs of overlapping spans are walked: a run is folded in the JVM.
    """
    w = Window.partitionBy(*partition).orderBy(start)
    reach = F.max(F.col(start) + F.col(count)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_run", F.sum(F.coalesce((F.col(start) >= reach).cast("int"), F.lit(1))).over(w))
    rest = [c for c in spans.columns if c not in (*partition, start, count)]
    runs = rows.groupBy(*partition, "_run").agg(F.sort_array(F.collect_list(F.struct(start, count, *rest))).alias("all"))
    first = F.struct(F.lit(0).cast("long").alias("free"), F.filter("all", lambda x: F.lit(False)).alias("taken"))
    step = lambda acc, x: F.when(x[start] >= acc["free"], F.struct((x[start] + x[count]).cast("long").alias("free"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)
    # whole spans are folded: joined back to their places, all spans would be found a second time
    taken = F.when(F.size("all") == 1, F.col("all")).otherwise(F.aggregate("all", first, step, lambda acc: acc["taken"]))
    return runs.select(*partition, F.explode(taken).alias("_span")).select(*[c if c in partition else F.col(f"_span.{c}") for c in spans.columns])


def find_mentions(words: DataFrame, entities: DataFrame, phonetic: bool = True) -> DataFrame:
    """entity_id, word_index, word_count, start_ms, end_ms, confidence, surface and corrected of each mention.

    At a word the longest alias wins, then the surest, then the first by entity and alias; mentions
    never overlap, earlier ones go first.
    """
    names = entities.select("job_id", "entity_ord", "entity_id", "canonical", F.posexplode("aliases").alias("alias_ord", "alias"))
    phrases = names.withColumns({"phrase_id": F.struct("entity_ord", "alias_ord", "entity_id", "canonical"), "tokens": tokens(F.col("alias"))})
    hits = phrase_hits(phrases.select("job_id", "phrase_id", "tokens"), words, phonetic=phonetic)
    rank = F.struct("word_count", "confidence", (-F.col("phrase_id.entity_ord")).alias("e"), (-F.col("phrase_id.alias_ord")).alias("a"))
    best = hits.groupBy("job_id", "word_index").agg(F.max_by(F.struct("word_count", "confidence", "phrase_id"), rank).alias("b")).select("job_id", "word_index", "b.word_count", "b.confidence", "b.phrase_id.*")
    chosen = greedy_spans(best, ["job_id"])
    bare = F.regexp_replace(F.regexp_replace("raw", r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}']+$", "")
    covered = chosen.withColumn("_i", F.explode(F.sequence(F.col("word_index"), F.col("word_index") + F.col("word_count") - 1)))
    covered = covered.join(words.select("job_id", F.col("word_index").alias("_i"), "norm", "start_ms", "end_ms", bare.alias("bare")), ["job_id", "_i"])
    known = F.transform(tokens(lower(F.col("canonical"))), normalize_word)
    rows = covered.groupBy("job_id", "word_index", "word_count", "entity_id", "confidence", "canonical").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "_i").alias("end_ms"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "bare"))), lambda x: x["bare"]), " ").alias("surface"),
        F.max((~F.array_contains(known, F.col("norm"))).cast("int")).alias("_other"),
    )
    return rows.select("job_id", "entity_id", "word_index", "word_count", "start_ms", "end_ms", "confidence", "surface", ((F.col("confidence") < 1) | (F.col("_other") == 1)).alias("corrected"))


def surface_variants(mentions: DataFrame) -> DataFrame:
    """mention_count and variants (text, count; most frequent first, then first seen) of each entity."""
    counts = mentions.groupBy("job_id", "entity_id", "surface").agg(F.count(F.lit(1)).alias("n"), F.min("word_index").alias("first"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "surface", "n")))
    return counts.groupBy("job_id", "entity_id").agg(F.sum("n").alias("mention_count"), F.transform(ranked, lambda v: F.struct(v["surface"].alias("text"), v["n"].alias("count"))).alias("variants"))


def observe(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """entities with mention_count and variants, shown as most often spoken if that is seen twice and no shorter."""
    seen = entities.join(surface_variants(mentions), ["job_id", "entity_id"], "left")
    best = F.get("variants", F.lit(0))
    better = (best["count"] >= 2) & (F.size(tokens(best["text"])) >= F.size(tokens(F.col("canonical"))))
    none = F.array().cast("array<struct<text:string,count:bigint>>")
    return seen.withColumns({"canonical": F.when(better, best["text"]).otherwise(F.col("canonical")), "mention_count": F.coalesce("mention_count", F.lit(0)), "variants": F.coalesce("variants", none)})


def bind_clips(clips: DataFrame, entities: DataFrame) -> DataFrame:
    """clips with entity_ids: the entity that claims each, or none (b-roll)."""
    claims = entities.select("job_id", "entity_id", "entity_ord", F.explode("clip_ids").alias("clip_id"))
    last = claims.groupBy("job_id", "clip_id").agg(F.max_by("entity_id", "entity_ord").alias("e"))
    return clips.drop("entity_ids").join(last, ["job_id", "clip_id"], "left").withColumn("entity_ids", F.when(F.col("e").isNull(), F.array().cast("array<string>")).otherwise(F.array("e"))).drop("e")


__all__ = ["bind_clips", "build_cast", "clip_readings", "declared_bounds", "expand_aliases", "find_mentions", "greedy_spans", "known_mentions", "observe", "phrase_hits", "surface_variants", "token_candidates", "token_pairs"]
