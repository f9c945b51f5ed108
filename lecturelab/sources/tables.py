"""Recordings derived from the sample tables: who said what and when, boards, usage, masks.

Every view is a lazy transformation of whole tables. Indexes inside a recording are
numbered block by block (see `operators.ordered`), so one huge source is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lecturelab.functions.text import strip, word_count
from lecturelab.operators.ordered import block_of, dense_index, running

WORD_MS, PAUSE_MS = 400, 300
ID_BLOCK = 4096  # unique ids: a block never holds more rows than this
BOARD_SECONDS = 60
SENTENCE = r"[^.!?\n]+[.!?]*"
EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, by: str = "lecture_id") -> DataFrame:
    """The document texts with `lecture_id`, dealt out by it: taking texts apart is the costly step, and the files say little
    about how evenly. What is counted by recording afterwards stays where it is; `by` names another column to deal by."""
    return table(spark, sf, "documents").withColumn("lecture_id", _lecture_of_document()).repartition(by)


def _lecture_of_document() -> F.Column:
    return F.concat(F.lit("d"), F.col("doc_id").cast("string"))


def _sentences() -> F.Column:
    found = F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))
    return F.array_remove(F.transform(found, strip), "")


def sums_before(numbers: str, slice_rows: int | None = None) -> F.Column:
    """For each element of an array column the sum of those before it, then the sum of all.

    Slices are summed first, then each slice on its own: appending copies an array, so one long
    array would cost the square of its length. Slices are as long as there are slices, if nothing else is said.
    """
    grow = lambda of, start: F.aggregate(of, F.array(start), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    total = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.greatest(F.size(numbers), F.lit(1))
    width = F.ceil(F.sqrt(n)).cast("int") if slice_rows is None else F.lit(slice_rows)
    starts = F.sequence(F.lit(1), n, width)
    slices = F.transform(starts, lambda at: F.slice(numbers, at, width))
    offsets = grow(F.transform(slices, total), F.lit(0).cast("long"))
    inside = F.zip_with(F.slice(offsets, F.lit(1), F.size(starts)), slices, lambda start, of: F.slice(grow(of, start), F.lit(1), F.size(of)))
    return F.array_append(F.flatten(inside), F.element_at(offsets, -1))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Texts and words of `speech` without their times, dealt out by `doc_id`."""
    rows = documents(spark, sf, "doc_id").select("doc_id", F.explode(_sentences()).alias("text"))
    return rows.select("doc_id", "text", word_count(F.col("text")).alias("words"))


def _weighed(docs: DataFrame) -> DataFrame:
    """`lecture_id`, sentences `s`, their words `w` and the words before each."""
    docs = docs.select("lecture_id", _sentences().alias("s"))
    return docs.withColumn("w", F.transform("s", word_count)).withColumn("before", sums_before("w"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed where the texts have been dealt out by recording: the labels do not pass through the driver, and no text is sorted."""
    return table(spark, sf, "labels").select(_lecture_of_document().alias("lecture_id"), "doc_id", F.col("quality").alias("q")).hint("shuffle_hash")


def speech(spark: SparkSession, sf: str, with_boards: bool = False) -> DataFrame:
    """One recording per document, one utterance per sentence; narrow, no shuffle beyond the dealing out.

    `with_boards`: only recordings that have boards; the other texts are not taken apart.
    """
    docs = documents(spark, sf)
    docs = _weighed(docs.join(_labelled(spark, sf).select("lecture_id").hint("shuffle_hash"), "lecture_id", "left_semi") if with_boards else docs)
    timed = F.transform(
        "s",
        lambda x, i: F.struct(
            i.alias("uid"), x.alias("text"), F.get("w", i).alias("words"),
            (F.get("before", i) * WORD_MS + i * PAUSE_MS).alias("start_ms"),
        ),
    )
    rows = docs.select("lecture_id", F.inline(timed))
    return rows.select(
        "lecture_id", "uid",
        (F.col("start_ms") / 1000.0).alias("start_s"),
        ((F.col("start_ms") + F.col("words") * WORD_MS) / 1000.0).alias("end_s"),
        "text", "words",
    )


def talks(spark: SparkSession, sf: str) -> DataFrame:
    """One short recording per conversation, one utterance per turn."""
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("lecture_id"),
        F.col("turn").cast("int").alias("uid"), "text", word_count(F.col("text")).alias("words"),
    )
    turns = turns.withColumn("dur", (F.col("words") * WORD_MS + PAUSE_MS).cast("long"))
    timed = running(turns, ["lecture_id"], ["uid"], block_of(F.col("uid")), {"cum": ("sum", F.col("dur"))})
    return timed.select(
        "lecture_id", "uid",
        ((F.col("cum") - F.col("dur")) / 1000.0).alias("start_s"),
        ((F.col("cum") - PAUSE_MS) / 1000.0).alias("end_s"),
        "text", "words",
    )


def library(spark: SparkSession, sf: str) -> DataFrame:
    """One very long recording per source, one utterance per whole document, 20 s grid.

    The numbering deals the texts out by source and block, so they are not dealt out by id before.
    """
    docs = table(spark, sf, "documents").select(F.col("source").alias("lecture_id"), "doc_id", "text", "lang")
    docs = dense_index(docs, ["lecture_id"], ["doc_id"], block_of(F.col("doc_id"), ID_BLOCK), "uid")
    return docs.select(
        "lecture_id", "uid",
        (F.col("uid") * 20.0).alias("start_s"), (F.col("uid") * 20.0 + 18.0).alias("end_s"),
        "text", "lang",
    )


def passage_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the passages of `library`: a document has that of its own number, if there is one."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("lecture_id"), "doc_id")
    docs = dense_index(docs, ["lecture_id"], ["doc_id"], block_of(F.col("doc_id"), ID_BLOCK), "row_id")
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(own, "doc_id").select("lecture_id", "row_id", "embedding")


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vector with the question's number."""
    own = table(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("query_id"), "embedding")
    return questions(spark, sf).select("lecture_id", "query_id").join(own, "query_id").select("lecture_id", "query_id", "embedding")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark text is a question put to one source."""
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("lecture_id"),
        F.col("item_id").cast("int").alias("query_id"), F.col("text").alias("question"),
    )


def asr_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Raw recogniser output per user; events arrive in `event_id` order."""
    ev = table(spark, sf, "events")
    start = F.expr(f"cast(timestampdiff(MICROSECOND, {EPOCH}, ts) as double) / 1e6D")
    rows = ev.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("lecture_id"), "event_id",
        start.alias("start_s"), (start + F.col("value")).alias("end_s"),
        F.when(F.col("event_type") == "error", F.lit("da da da da da da da"))
        .when(F.col("event_type") == "view", F.lit("   "))
        .when(F.col("event_type") == "signup", F.concat("event_type", F.lit(" and then")))
        .otherwise(F.concat("event_type", F.lit(" ok."))).alias("text"),
        (-F.col("value") / 100).alias("avg_logprob"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("no_speech_prob"),
    )
    return dense_index(rows, ["lecture_id"], ["event_id"], block_of(F.col("event_id"), ID_BLOCK), "seq").drop("event_id")


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Utterances `n` and `seconds` of each document recording, with `doc_id, lecture_id, source, lang`; dealt out by recording."""
    docs = documents(spark, sf)
    return _sized(docs, "doc_id", "lecture_id", "source", "lang")


def _sized(docs: DataFrame, *columns: str) -> DataFrame:
    docs = docs.select(*columns, _sentences().alias("s"))
    total = F.aggregate("s", F.lit(0), lambda a, x: a + word_count(x)).cast("long")
    return docs.select(*columns, F.size("s").alias("n"), ((total * WORD_MS + (F.size("s") - 1) * PAUSE_MS) / 1000.0).alias("seconds"))


def boards(spark: SparkSession, sf: str, sized: DataFrame | None = None) -> DataFrame:
    """A board every minute of each labelled document recording; read only when the label is good."""
    # only labelled texts are taken apart
    labels = _labelled(spark, sf)
    if sized is None:
        docs = _sized(documents(spark, sf).select("lecture_id", "text").join(labels, "lecture_id"), "doc_id", "lecture_id", "q")
    else:
        docs = sized.select("lecture_id", "n", "seconds").join(labels, "lecture_id")
    rows = docs.where("n > 0").select(
        "lecture_id", "doc_id", "q", F.explode(F.sequence(F.lit(0), F.floor(F.col("seconds") / BOARD_SECONDS).cast("int"))).alias("bid"))
    start = F.col("bid") * float(BOARD_SECONDS)
    good = F.col("q") == 1
    return rows.select(
        "lecture_id", "bid", start.alias("start_s"), (start + 60.0).alias("end_s"), (start + 45.0).alias("key_ts"),
        F.concat(F.lit("frames/board_"), F.col("bid").cast("string"), F.lit(".png")).alias("frame_path"),
        F.when(good & (F.col("bid") % 3 != 2), F.concat(F.lit("$x_{"), F.col("doc_id").cast("string"), F.lit("}$"))).alias("latex"),
        F.when(good, F.lit("derivation")).alias("caption"),
        F.when(good, F.lit(0.9)).otherwise(F.when(F.col("bid") % 2 == 0, F.lit(0.4)).otherwise(F.lit(0.2))).alias("confidence"),
    )


SEGMENT_UTTERANCES = 12


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed runs of utterances standing for topic segments."""
    docs = _weighed(documents(spark, sf)).where(F.size("s") > 0)
    n, size = F.size("s"), SEGMENT_UTTERANCES

    def run(sid):
        first, last = sid * size, F.least((sid + 1) * size, n) - 1
        # before an utterance lie the words and pauses of those before it; it ends with its own words
        start_ms = F.get("before", first) * WORD_MS + first * PAUSE_MS
        end_ms = F.get("before", last) * WORD_MS + last * PAUSE_MS + F.get("w", last) * WORD_MS
        return F.struct(sid.alias("sid"), (start_ms / 1000.0).alias("start_s"), (end_ms / 1000.0).alias("end_s"), F.sequence(first, last).alias("ids"))

    runs = docs.select("lecture_id", F.inline(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), run)))
    # texts with the same id are one recording
    agg = runs.groupBy("lecture_id", "sid").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sort_array(F.flatten(F.collect_list("ids"))).alias("utterance_ids"))
    return agg.select(
        "lecture_id", "sid", "start_s", "end_s",
        F.when(F.col("sid") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("Part "), F.col("sid").cast("string"))).alias("title"),
        F.when(F.col("sid") % 3 == 1, F.lit("")).otherwise(
            F.concat(F.lit("\\section{Part} see \\ts{0"), (F.col("sid") % 10).cast("string"), F.lit(":30} now"))).alias("body"),
        "utterance_ids",
    )


def lectures(spark: SparkSession, sf: str, sized: DataFrame | None = None) -> DataFrame:
    """One row per document recording."""
    docs = sizes(spark, sf) if sized is None else sized
    seconds = F.greatest(F.lit(0.0), F.col("seconds"))
    return docs.select(
        "doc_id", "lecture_id", F.concat(F.lit("/video/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("source"),
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.concat(F.lit("Lecture "), F.col("source"), F.lit("  in  "), F.col("lang"))).alias("title"),
        seconds.alias("duration"), F.when(F.col("lang") == "es", F.lit("fake")).otherwise(F.lit("small")).alias("asr_model"),
    )


def usage(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("lecture_id"), F.col("event_type").alias("stage"),
        F.when(F.col("event_type") == "click", F.lit("")).when(F.col("event_type") == "error", F.lit("m-unknown"))
        .when(F.col("event_type") == "view", F.lit("m-small")).otherwise(F.lit("m-large")).alias("model"),
        F.lit(1).cast("long").alias("calls"), F.floor(F.col("value") * 100).cast("long").alias("input_tokens"),
        (F.get_json_object("props", "$.k").cast("long") * 10).alias("output_tokens"), "ts",
    )


# Event type of the sample data -> processing stage.
STAGE_OF_EVENT = {"signup": "ingest", "view": "asr", "error": "boards", "click": "board_reading", "purchase": "compose"}


def stage_timings(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds per recording and stage, as a long table."""
    ev = table(spark, sf, "events")
    stage = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(s)) for e, s in STAGE_OF_EVENT.items()])
    return ev.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("lecture_id"), stage.alias("stage"), F.col("value").alias("seconds"))


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user recording: title and duration for the reports over usage and timings."""
    ev = table(spark, sf, "events")
    per = ev.groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 10).cast("long")).alias("ds"))
    return per.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("lecture_id"),
        F.concat(F.lit("Recording of user number "), F.col("user_id").cast("string"), F.lit(" about analysis")).alias("title"),
        F.when(F.col("user_id") % 17 == 0, F.lit(0.0)).otherwise(F.col("ds") / 10.0).alias("duration"),
        (F.col("user_id") % 7).cast("int").alias("boards"), (F.col("user_id") % 5).cast("int").alias("segments"),
        F.when(F.col("user_id") % 11 == 0, F.lit("fake")).otherwise(F.lit("small")).alias("asr_model"),
    )


MASK_SIDE = 8


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings").select(
        F.concat(F.lit("l"), F.col("label").cast("string")).alias("lecture_id"), "vec_id", "embedding")
    return dense_index(emb, ["lecture_id"], ["vec_id"], block_of(F.col("vec_id"), ID_BLOCK), "frame_idx")


def mask_px(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse 8x8 ink pixels: a positive vector component is an inked pixel."""
    px = _frames(spark, sf).select("lecture_id", "frame_idx", F.posexplode("embedding").alias("pos", "v")).where("v > 0")
    return px.select(
        "lecture_id", "frame_idx", F.floor(F.col("pos") / MASK_SIDE).cast("int").alias("y"), (F.col("pos") % MASK_SIDE).alias("x"))


def masks(spark: SparkSession, sf: str) -> DataFrame:
    """The same masks bit-packed, 32 pixels per word, one frame per row (no shuffle after numbering)."""
    word = lambda lo: F.aggregate(
        F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"),
        lambda acc, b: acc + F.when(F.get("embedding", b + lo) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")),
    )
    return _frames(spark, sf).select(
        "lecture_id", "frame_idx", F.col("frame_idx").cast("double").alias("ts"), F.lit(MASK_SIDE**2).alias("n_px"),
        F.array(word(0), word(32)).alias("words"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("l"), F.col("label").cast("string")).alias("lecture_id"), F.col("vec_id").cast("int").alias("cid"), "embedding")


def boundary_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Per source and row: where the language changes, and where every seventh row starts."""
    from lecturelab.operators.ordered import shifted
    rows = shifted(library(spark, sf).select("lecture_id", "uid", "lang"), ["lecture_id"], "uid", {"prev": ("lang", -1)})
    return rows.select(
        "lecture_id", F.col("uid").alias("pos"),
        F.coalesce(F.col("prev") != F.col("lang"), F.lit(False)).cast("int").alias("ref"),
        ((F.col("uid") % 7 == 0) & (F.col("uid") > 0)).cast("int").alias("hyp"))
