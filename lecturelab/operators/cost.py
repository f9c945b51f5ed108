"""Usage, prices and processing time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecturelab.functions.text import short_title
from lecturelab.functions.timecode import format_duration, format_num, round_even, to_timecode

# Stages that are billed by the model provider, and the order of all stages.
BILLED_STAGES = ("board_reading", "compose")
STAGES = ("ingest", "asr", "boards", "board_reading", "segmentation", "compose")
FREE_MODEL = "codex"


def usage_rows(stage_usage: DataFrame, ledger: DataFrame, default_model: str) -> DataFrame:
    """Billed stages with calls and all ledger rows; an empty model becomes the default one, flagged."""
    cols = ["lecture_id", "stage", "model", "calls", "input_tokens", "output_tokens"]
    billed = stage_usage.where(F.col("stage").isin(*BILLED_STAGES) & (F.coalesce("calls", F.lit(0)) > 0)).select(*cols)
    rows = billed.unionByName(ledger.select(*cols))
    unknown = F.coalesce("model", F.lit("")) == ""
    return rows.withColumns({
        "model_assumed": unknown, "model": F.when(unknown, F.lit(default_model)).otherwise(F.col("model"))})


def rate_lookup(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds `rate_in, rate_out` in dollars per million tokens; an unknown model costs 0.

    The price list is tiny next to usage; Spark broadcasts it after looking at its size.
    """
    joined = rows.join(rates.select("model", "rate_in", "rate_out"), "model", "left")
    price = lambda c: F.when(F.col("model") == FREE_MODEL, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))
    return joined.withColumns({"rate_in": price("rate_in"), "rate_out": price("rate_out")})


def usage_cost(rows: DataFrame, rates: DataFrame) -> DataFrame:
    priced = rate_lookup(rows, rates)
    cost = (F.col("input_tokens") * F.col("rate_in") + F.col("output_tokens") * F.col("rate_out")) / 1e6
    return priced.withColumn("cost_usd", cost)


def run_cost(priced: DataFrame, timings: DataFrame, lectures: DataFrame) -> DataFrame:
    """One row per recording. Usage and timings are aggregated apart, so neither multiplies the other."""
    used = priced.groupBy("lecture_id").agg(
        F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"), F.bool_or("model_assumed").alias("model_assumed"),
        F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))
    timed = timings.groupBy("lecture_id").agg(
        F.sum("seconds").alias("processing_seconds"),
        F.sum(F.when(F.col("stage").isin("ingest", "asr"), F.col("seconds")).otherwise(0.0)).alias("transcription_seconds"))
    out = lectures.select("lecture_id", F.coalesce("duration", F.lit(0.0)).alias("duration")).join(
        used, "lecture_id", "left").join(timed, "lecture_id", "left")
    out = out.fillna(0, ["calls", "input_tokens", "output_tokens"]).fillna(
        0.0, ["cost_usd", "processing_seconds", "transcription_seconds"]).fillna({"models": "", "model_assumed": False})
    hours = F.col("duration") / 3600
    return out.withColumns({
        "tokens": F.col("input_tokens") + F.col("output_tokens"),
        "hours": hours,
        "cost_per_hour": F.col("cost_usd") / F.nullif(hours, F.lit(0.0)),
        "realtime_factor": F.nullif("duration", F.lit(0.0)) / F.nullif("processing_seconds", F.lit(0.0)),
    })


SCALED = ("calls", "input_tokens", "output_tokens", "cost_usd", "processing_seconds", "transcription_seconds")


def scale_cost(runs: DataFrame, minutes: float) -> DataFrame:
    """Linear projection to a recording of `minutes`; recordings without a duration drop out."""
    k = F.lit(minutes * 60) / F.col("duration")
    return runs.where(F.col("duration") > 0).select(
        "lecture_id", "duration", *[(F.col(c) * k).alias(c) for c in SCALED])


PLAN_FIELDS = ("key", "kind", "price_per_month", "included_hours", "price_per_page")


def analog_prices(plans: list[tuple], sizes: DataFrame, workload_hours: float) -> DataFrame:
    """Price of each plan for each `(lecture_id, minutes, boards)`; null where it cannot be told.

    `plans` is the parsed price file, a handful of `PLAN_FIELDS` tuples. It is unfolded from a
    literal, so the recordings are neither shuffled nor joined.
    """
    types = ("string", "string", "double", "double", "double")
    listed = F.array(*[
        F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(plan, PLAN_FIELDS, types)]) for plan in plans])
    spread = sizes.select("lecture_id", "minutes", "boards", F.inline(listed))
    return spread.select("lecture_id", "minutes", "boards", "key", "kind", _plan_price(workload_hours).alias("usd_per_lecture"))


def _plan_price(workload_hours: float) -> Column:
    covered = F.coalesce("included_hours", F.lit(workload_hours))
    monthly = F.coalesce("price_per_month", F.lit(0.0))
    return (
        F.when(F.col("kind") == "subscription", monthly / F.nullif(covered, F.lit(0.0)) * (F.col("minutes") / 60))
        .when(F.col("kind") == "per-page", F.coalesce("price_per_page", F.lit(0.0)) * F.col("boards"))
        .when(F.col("kind") == "self-hosted", F.lit(0.0))
    )


def asr_prices(rates: list[tuple[str, float]], sizes: DataFrame) -> DataFrame:
    """`lecture_id, key, price_per_hour, usd_per_lecture` of each service for each recording (`lecture_id, duration` in seconds)."""
    listed = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(float(v)).alias("price_per_hour")) for k, v in rates])
    spread = sizes.select("lecture_id", "duration", F.inline(listed))
    return spread.select("lecture_id", "key", "price_per_hour", (F.col("price_per_hour") * F.col("duration") / 3600).alias("usd_per_lecture"))


def exclude_synthetic(lectures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(real recordings, one row with the number of test runs left out)."""
    fake = F.coalesce("asr_model", F.lit("")) == "fake"
    return lectures.where(~fake), lectures.agg(F.count_if(fake).alias("skipped"))


def runs_table(lectures: DataFrame, runs: DataFrame) -> DataFrame:
    """`lectures`: lecture_id, title, source, segments, boards."""
    name = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(file_stem(F.col("source")))
    return lectures.join(runs, "lecture_id").select(
        "lecture_id", F.substring(name, 1, 34).alias("title"), to_timecode(F.col("duration")).alias("length"), "segments", "boards",
        "calls", "input_tokens", "output_tokens", format_num(F.col("cost_usd"), 4).alias("cost"))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def perf_table(timings: DataFrame, runs: DataFrame) -> DataFrame:
    """Seconds per stage as columns, total, minutes of work per recorded hour, speed."""
    wide = timings.groupBy("lecture_id").pivot("stage", list(STAGES)).agg(F.sum("seconds"))
    out = runs.select("lecture_id", "duration", "hours", "processing_seconds", "realtime_factor").join(wide, "lecture_id", "left")
    per_hour = F.when(F.col("hours") > 0, F.col("processing_seconds") / 60 / F.col("hours")).otherwise(0.0)
    return out.select(
        "lecture_id", to_timecode(F.col("duration")).alias("length"),
        *[format_num(F.coalesce(s, F.lit(0.0)), 1).alias(s) for s in STAGES],
        format_num(F.col("processing_seconds"), 1).alias("total"), format_num(per_hour, 1).alias("minutes_per_hour"),
        F.when(F.col("realtime_factor").isNotNull(), F.concat(F.lit("×"), round_even(F.col("realtime_factor"), 1).cast("decimal(38,1)").cast("string")))
        .otherwise(F.lit("—")).alias("speed"))


def scaled_table(runs: DataFrame, minutes: float) -> DataFrame:
    s = scale_cost(runs.where((F.col("calls") > 0) & (F.col("duration") > 0)), minutes)
    return s.select(
        "lecture_id", format_num(F.col("calls"), 1).alias("calls"),
        *[round_even(F.col(c), 0).cast("long").alias(c) for c in ("input_tokens", "output_tokens")],
        format_num(F.col("cost_usd"), 3).alias("cost"), format_duration(F.col("processing_seconds")).alias("processing"),
        format_duration(F.col("transcription_seconds")).alias("transcription"))


def analog_comparison(plans: list[tuple], runs: DataFrame, lectures: DataFrame, minutes: float, workload_hours: float) -> DataFrame:
    """Plan prices for a recording of `minutes`; pay-per-use takes the longest billed recording, scaled.

    The basis is one row found by an aggregate; equal lengths go by the lower id.
    """
    billed = runs.where(F.col("calls") > 0).join(lectures.select("lecture_id", "boards"), "lecture_id")
    k = F.lit(minutes * 60) / F.nullif("duration", F.lit(0.0))
    basis = billed.agg(F.min_by(
        F.struct((F.col("cost_usd") * k).alias("own"), F.coalesce(round_even(F.col("boards") * k, 0), F.lit(0.0)).alias("boards")),
        F.struct(-F.col("duration"), F.col("lecture_id"))).alias("b"))
    # the own price travels in the place of the id: one row, no join
    size = basis.select(
        F.col("b.own").alias("lecture_id"), F.lit(minutes).alias("minutes"), F.coalesce("b.boards", F.lit(0.0)).alias("boards"))
    return analog_prices(plans, size, workload_hours).withColumnRenamed("lecture_id", "own").select(
        "key", "kind", F.when(F.col("kind") == "pay-per-use", F.col("own")).otherwise(F.col("usd_per_lecture")).alias("usd_per_lecture"))


def cost_by_stage(priced: DataFrame) -> DataFrame:
    """Per recording, stage and model, and one total row per recording (stage and model null)."""
    return priced.withColumn("_part", F.struct("stage", "model")).groupingSets(
        [["lecture_id", "_part"], ["lecture_id"]], "lecture_id", "_part").agg(
        F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"),
    ).select("lecture_id", "_part.stage", "_part.model", "calls", "input_tokens", "output_tokens", "cost_usd")


def bench_table(measured: DataFrame) -> DataFrame:
    """Milliseconds per item and found against expected, from measurement rows."""
    return measured.withColumn("ms_per_item", round_even(F.col("seconds") * 1000 / F.nullif("items", F.lit(0)), 2)).withColumn(
        "complete", F.col("found") == F.col("expected"))


# The log lines of a run.
STAGE_EVENT = r"\[(\w+)\] (running|done in|cache hit)"
STAGE_SECONDS = r"\[(\w+)\] done in ([\d.]+)s"


def stage_events(lines: DataFrame) -> DataFrame:
    """`run, line_no, stage, state, seconds` of the log lines that report a stage."""
    found = lines.select(
        "run", "line_no", F.regexp_extract("line", STAGE_EVENT, 1).alias("stage"), F.regexp_extract("line", STAGE_EVENT, 2).alias("event"),
        F.regexp_extract("line", STAGE_SECONDS, 2).try_cast("double").alias("seconds"))
    return found.where(F.col("stage") != "").select(
        "run", "line_no", "stage", F.when(F.col("event") == "running", "running").otherwise("done").alias("state"), "seconds")


def stage_status(lines: DataFrame) -> DataFrame:
    """`run, stage, state, seconds, is_current, progress`: the last event of each stage of each run."""
    events = stage_events(lines)
    per = events.groupBy("run", "stage").agg(
        F.max_by("state", "line_no").alias("state"), F.max_by("seconds", F.when(F.col("seconds").isNotNull(), F.col("line_no"))).alias("seconds"))
    current = events.where("state = 'running'").groupBy("run").agg(F.max_by("stage", "line_no").alias("current"))
    said = lines.where(F.col("line").contains("progress")).groupBy("run").agg(
        F.trim(F.regexp_extract(F.max_by("line", "line_no"), r"([^|]*)$", 1)).alias("progress"))
    return per.join(current, "run", "left").join(said, "run", "left").select(
        "run", "stage", "state", "seconds", F.coalesce(F.col("stage") == F.col("current"), F.lit(False)).alias("is_current"),
        F.coalesce("progress", F.lit("")).alias("progress"))


def job_progress(status: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """`run, done, wanted, elapsed`; `jobs`: run, until, started, finished."""
    rank = F.create_map(*[v for i, s in enumerate(STAGES) for v in (F.lit(s), F.lit(i + 1))])
    wanted = F.coalesce(F.get(F.map_values(F.map_filter(rank, lambda k, v: k == F.col("until"))), F.lit(0)), F.lit(len(STAGES)))
    finished = status.where("state = 'done'").groupBy("run").agg(F.collect_set("stage").alias("finished_stages"))
    joined = jobs.join(finished, "run", "left")
    ordered = F.array(*[F.lit(s) for s in STAGES])
    want = F.slice(ordered, F.lit(1), wanted)
    done = F.size(F.array_intersect(want, F.coalesce("finished_stages", F.array().cast("array<string>"))))
    return joined.select(
        "run", done.alias("done"), F.size(want).alias("wanted"),
        F.greatest(F.coalesce("finished", now) - F.col("started"), F.lit(0.0)).alias("elapsed"))


def stage_usage_rollup(calls: DataFrame) -> DataFrame:
    """Calls and tokens per stage and model; failed calls (with an error) add nothing."""
    return calls.where(F.col("error").isNull()).groupBy("lecture_id", "stage", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def lecture_header(
    lectures: DataFrame, segments: DataFrame, boards: DataFrame, utterances: DataFrame, timings: DataFrame, priced: DataFrame
) -> DataFrame:
    """Counts per recording; every child table is counted before it is joined."""
    def counted(df, name):
        return df.groupBy("lecture_id").agg(F.count(F.lit(1)).alias(name))

    timed = timings.groupBy("lecture_id").agg(F.sum("seconds").alias("processing"))
    paid = priced.groupBy("lecture_id").agg(F.sum("calls").alias("calls"), F.sum("cost_usd").alias("cost_usd"))
    out = lectures.select("lecture_id", "duration")
    for df in (counted(segments, "segments"), counted(boards, "boards"), counted(utterances, "utterances"), timed, paid):
        out = out.join(df, "lecture_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "lecture_id", to_timecode(F.col("duration")).alias("length"), zero("segments"), zero("boards"), zero("utterances"),
        F.when(F.col("processing") > 0, F.col("processing")).alias("processing"), F.when(F.col("calls") > 0, F.col("cost_usd")).alias("cost_usd"))


def missing_stages(counts: DataFrame) -> DataFrame:
    """`missing`: stages without a result; `counts`: utterances, boards, bodies per recording."""
    gap = lambda c, s: F.when(F.coalesce(c, F.lit(0)) == 0, F.lit(s))
    return counts.select("lecture_id", F.array_compact(F.array(gap("utterances", "asr"), gap("boards", "boards"), gap("bodies", "compose"))).alias("missing"))


def unique_labels(runs: DataFrame) -> DataFrame:
    """Short titles; the second and later run of a title (newest first) also shows four characters of its id.

    Only the newest run of a title keeps it bare, which is an aggregate: no title, however
    common, is ranked in one task.
    """
    base = runs.withColumn("base", short_title(F.col("title")))
    newest = base.groupBy("base").agg(F.min_by("run", F.struct(-F.col("mtime"), F.col("run"))).alias("_first"))
    return base.join(newest, "base").select(
        "run", F.when(F.col("run") == F.col("_first"), F.col("base"))
        .otherwise(F.concat("base", F.lit(" · "), F.substring("run", 1, 4))).alias("label"))
