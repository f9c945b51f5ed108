"""Scores of generated notes and of segmentations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecturelab.functions.mathtext import WRAPPERS, extract_math, term_words
from lecturelab.operators.intervals import with_prf
from lecturelab.operators.ordered import BLOCK_ROWS, block_of, running, top_n


def formulas(notes: DataFrame, wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """Distinct `doc_id, formula` from `doc_id, text`; macros named in `wrappers` are unwrapped."""
    return notes.select("doc_id", F.explode(F.array_distinct(extract_math(F.col("text"), wrappers))).alias("formula")).distinct()


def terms(notes: DataFrame, min_count: int = 1) -> DataFrame:
    """`doc_id, term, n` for terms used at least `min_count` times in all rows of a document."""
    words = notes.select("doc_id", F.explode(term_words(F.col("text"))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def overlap_counts(generated: DataFrame, reference: DataFrame, item: str) -> DataFrame:
    """`doc_id, matched, n_gen, n_ref` of two distinct item tables, counted side by side in one shuffle."""
    tagged = generated.select("doc_id", item, F.lit(1).alias("g"), F.lit(0).alias("r")).unionByName(
        reference.select("doc_id", item, F.lit(0).alias("g"), F.lit(1).alias("r")))
    return _overlaps(tagged, item)


def _overlaps(tagged: DataFrame, item: str) -> DataFrame:
    """Counts of `doc_id, item, g, r` (1 where that side has the item, repeats allowed)."""
    per = tagged.groupBy("doc_id", item).agg(F.max("g").alias("g"), F.max("r").alias("r"))
    return per.groupBy("doc_id").agg(
        F.sum(F.col("g") * F.col("r")).cast("long").alias("matched"), F.sum("g").cast("long").alias("n_gen"),
        F.sum("r").cast("long").alias("n_ref"))


def formula_prf(generated: DataFrame, reference: DataFrame, wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """`doc_id, matched, n_gen, n_ref, precision, recall, f1` over distinct formulas."""
    counts = overlap_counts(formulas(generated, wrappers), formulas(reference, wrappers), "formula")
    return with_prf(counts, "matched", "n_gen", "n_ref")


def formula_prf_by_row(notes: DataFrame, wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """`formula_prf` of notes that have both sides in a row (`doc_id, generated, reference`): they are read once, and
    notes that are dealt out by `doc_id` are not shuffled."""
    def side(text: str, g: int) -> Column:
        found = F.array_distinct(extract_math(F.col(text), wrappers))
        return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda f: F.struct(f.alias("formula"), F.lit(g).alias("g"), F.lit(1 - g).alias("r")))

    tagged = notes.select("doc_id", F.inline(F.concat(side("generated", 1), side("reference", 0))))
    return with_prf(_overlaps(tagged, "formula"), "matched", "n_gen", "n_ref")


def term_coverage(generated: DataFrame, reference: DataFrame) -> DataFrame:
    """Share of the reference's terms (used twice or more) that the generated notes use at all."""
    counts = overlap_counts(terms(generated, 1), terms(reference, 2), "term")
    return counts.select(
        "doc_id", "matched", "n_ref",
        F.when(F.col("n_ref") > 0, F.col("matched") / F.col("n_ref")).otherwise(F.lit(0.0)).alias("coverage"))


def missing_terms(generated: DataFrame, reference: DataFrame, top: int = 25) -> DataFrame:
    """The first `top` reference terms, in order, that the generated notes lack."""
    lacking = terms(reference, 2).join(terms(generated, 1), ["doc_id", "term"], "left_anti")
    return top_n(lacking.select("doc_id", "term"), ["doc_id"], [F.asc("term")], top, "pos", spread=["term"])


def ablation_delta(generated: DataFrame, baseline: DataFrame, reference: DataFrame, wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """Recall of the notes, of the transcript alone, and the difference."""
    system = lambda df, name: formula_prf(df, reference, wrappers).select("doc_id", F.lit(name).alias("system"), "recall")
    both = system(generated, "pipeline").unionByName(system(baseline, "transcript"))
    wide = both.groupBy("doc_id").pivot("system", ["pipeline", "transcript"]).agg(F.max("recall"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return wide.select(
        "doc_id", zero("pipeline").alias("pipeline"), zero("transcript").alias("transcript"),
        (zero("pipeline") - zero("transcript")).alias("delta"))


def window_errors(flags: DataFrame, k: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`lecture_id, length, k, pk, window_diff` from `lecture_id, pos, ref, hyp` (0/1 flags, dense `pos`).

    Counts inside a window are differences of running sums; the far end of the window is
    fetched by an equi-join. Default `k` is half the mean reference segment, at least 2.
    """
    sizes = flags.groupBy("lecture_id").agg(F.count(F.lit(1)).alias("length"), F.sum("ref").alias("_refs"))
    default = F.greatest(F.lit(2), F.rint(F.col("length") / (2 * (F.col("_refs") + 1))).cast("int"))
    sizes = sizes.select("lecture_id", "length", (F.lit(k) if k is not None else default).alias("k"))
    sums = running(flags, ["lecture_id"], ["pos"], block_of(F.col("pos"), block_rows),
                   {"sref": ("sum", F.col("ref").cast("long")), "shyp": ("sum", F.col("hyp").cast("long"))})
    starts = sums.join(sizes, "lecture_id").where(F.col("pos") < F.col("length") - F.col("k")).select(
        "lecture_id", (F.col("pos") + F.col("k") - 1).alias("pos"), (F.col("sref") - F.col("ref")).alias("r0"), (F.col("shyp") - F.col("hyp")).alias("h0"))
    spans = starts.join(sums.select("lecture_id", "pos", "sref", "shyp"), ["lecture_id", "pos"]).select(
        "lecture_id", (F.col("sref") - F.col("r0")).alias("r"), (F.col("shyp") - F.col("h0")).alias("h"))
    wrong = spans.groupBy("lecture_id").agg(
        F.avg(((F.col("r") == 0) != (F.col("h") == 0)).cast("double")).alias("pk"),
        F.avg((F.col("r") != F.col("h")).cast("double")).alias("window_diff"))
    return sizes.join(wrong, "lecture_id", "left").select(
        "lecture_id", "length", "k", F.coalesce("pk", F.lit(0.0)).alias("pk"), F.coalesce("window_diff", F.lit(0.0)).alias("window_diff"))
