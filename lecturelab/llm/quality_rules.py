"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every figure is a column expression over the text of its own row, so nothing is shuffled and a row of any
source costs what its own text costs.

Edge cases: a null or empty text has no words, all its figures are 0 and it fails the length rule; a very long
text is taken whole (memory grows with that one text); repeated rows are judged alike, each for itself; an empty
table gives an empty result. Columns of the input named like a result column are replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lecturelab.llm.common import GAP, SPACE, text_or_empty, where_computed, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8  # a power of two: window hashes are doubled up
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of the languages the corpus is expected to hold. A parameter: pass your own for others.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not this are or from at which but have "
    "der die das und ist nicht ein eine den dem von zu mit auf für im sich des auch "
    "le la les de des et est un une que qui dans pour pas sur en du au il "
    "el los las y es una por con no se del para su como lo"
).split()


@dataclass(frozen=True)
class Rule:
    """`100 * part / whole` must lie in `[low, high]`; a bound of None is open. A whole of 0 breaks no rule."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


#: The base rules decide first; these only ever turn a kept row into a rejected one.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 2000),
    Rule("symbols", "n_symbols", "word_chars", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("short_lines", "n_lines", "n_words", None, 60),
)


def _repeat_places(ordered: Column) -> Column:
    """Places of windows whose hash occurs twice or more; `ordered` holds (hash, place) sorted."""
    twice = F.filter(
        ordered,
        lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]))
    return F.array_sort(F.transform(twice, lambda x: x["i"]))


def _paired(hashes: str, ahead: int) -> Column:
    """Each hash combined with the one `ahead` places on: windows of twice the words."""
    n = F.greatest(F.size(hashes) - ahead, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, ahead + 1, n), lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the figures the rules speak of."""
    t = text_or_empty(F.col(text))
    step = docs.withColumns({
        "_w": words(F.col(text)),
        "_lines": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        "word_chars": F.char_length(F.regexp_replace(t, GAP, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long"),
    })
    stop = [form for w in STOP_WORDS for form in (w, w.capitalize())]
    step = step.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda x: x.isin(*stop))).cast("long"),
        "_h": F.transform("_w", lambda x: F.xxhash64(x)),
    }).drop("_w", "_lines")
    ahead = 1
    while ahead < WINDOW:
        step = step.withColumn("_h", _paired("_h", ahead))
        ahead *= 2
    # sorting is for texts that repeat a window at all, which few do
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).otherwise(none)).drop("_h")
    step = step.withColumn("_p", _repeat_places(F.col("_s"))).drop("_s")
    covered = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.get("_p", k + 1) - p).cast("long"))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", total).drop("_p")


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with the figures, `base_failed`, `failed_rules` (names, comma-joined) and `kept`."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))

    def broken(rule: Rule) -> Column:
        part, whole = 100 * F.col(rule.part), F.col(rule.whole)
        bounds = [F.lit(False)]
        if rule.low is not None:
            bounds.append(part < rule.low * whole)
        if rule.high is not None:
            bounds.append(part > rule.high * whole)
        return reduce(lambda a, b: a | b, bounds)

    names = F.concat_ws(",", *[F.when(broken(r), F.lit(r.name)) for r in rules])
    return measured(docs, text).withColumns({"base_failed": base, "failed_rules": names}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "failed_rules")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its key, the figures and the verdict. A filter or join on a figure finds it computed."""
    slim = docs.select(F.col(key), F.col(text).alias("_text"))
    return where_computed(judged(slim, "_text", rules), F.lit(True)).select(key, *FIGURES)


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns only."""
    own = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return where_computed(judged(own, "_text", rules), F.col("kept")).select("_row.*")


def oracle() -> str:
    """The same figures and verdict as SQL for DuckDB."""
    gap = r"[^\x20\x09-\x0D]+"
    stop = ", ".join(f"'{form}'" for w in dict.fromkeys(STOP_WORDS) for form in (w, w.capitalize()))

    def broken(rule: Rule) -> str:
        bounds = [f"100 * {rule.part} {op} {bound} * {rule.whole}" for op, bound in (("<", rule.low), (">", rule.high)) if bound is not None]
        return f"case when {' or '.join(bounds)} then '{rule.name}' end"

    return f"""
with base as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
split as (select rid, doc_id, t, regexp_extract_all(t, '{gap}') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{gap}')) as ls from base),
windows as (select rid, i, list_slice(w, i, i + {WINDOW - 1}) as g from (
    select rid, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from split where len(w) >= {WINDOW})),
twice as (select rid, i from windows qualify count(*) over (partition by rid, g) > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + {WINDOW})) as p from twice) group by rid),
figures as (select doc_id, len(w)::bigint as n_words,
    length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
    len(list_filter(w, lambda x: x in ({stop})))::bigint as n_stop_words
    from split left join covered using (rid)),
named as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
    concat_ws(',', {', '.join(broken(r) for r in RULES)}) as failed_rules from figures)
select *, not base_failed and failed_rules = '' as kept from named"""
