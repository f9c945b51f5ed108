"""Column helpers over words and short strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode word character, Unicode white space, sentence end.
WORD_CHAR = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The same white space for Spark: as a class that an ASCII letter leaves after two looks, and as characters.
_GAP = r"[ \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x{85}\x{A0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]+"
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# What may be white space other than a space: all but characters that surely are not.
_ODD = r"[^ -~\x{A1}-\x{167F}]"
SENTENCE_END = r"[.!?…]['\"»)\]]?\s*$"


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Whitespace separated words; empty for null or blank text."""
    own = F.coalesce(text, F.lit(""))
    # a split by one character needs no pattern, which would be compiled for each text
    return F.array_remove(F.when(own.rlike(_ODD), F.split(own, _GAP)).otherwise(F.split(own, " ")), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text))


def truncate_words(text: Column, limit: int | Column) -> Column:
    """Unchanged up to `limit` words, else the first `limit` joined by one space and ` …`."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    words = words_of(text)
    cut = F.concat(F.array_join(F.slice(words, F.lit(1), limit), " "), F.lit(" …"))
    return F.when(F.size(words) <= limit, text).otherwise(cut)


def squeeze(text: Column) -> Column:
    """Runs of whitespace become one space; ends trimmed."""
    return F.trim(F.regexp_replace(text, _GAP, " "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def word_tokens(text: Column, min_chars: int = 1) -> Column:
    """Lower-case Unicode word tokens of at least `min_chars` characters."""
    pattern = WORD_CHAR + ("+" if min_chars <= 1 else "{%d,}" % min_chars)
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def uni_and_bigrams(text: Column) -> Column:
    """Tokens of two or more characters, then pairs of neighbouring tokens, repeats kept."""
    def grams(tokens):
        pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
        firsts, nexts = F.slice(tokens, F.lit(1), pairs), F.slice(tokens, F.lit(2), pairs)
        return F.concat(tokens, F.zip_with(firsts, nexts, lambda a, b: F.concat(a, F.lit(" "), b)))

    return let(word_tokens(text, 2), grams)


def looks_degenerate(text: Column, min_words: int = 6, ratio: float = 0.6) -> Column:
    """True when one word makes up at least `ratio` of at least `min_words` words.

    A word with more than half of all tokens must hold the middle of the sorted tokens, so
    only that one candidate is counted; lower ratios count every distinct word.
    """
    def check(tokens):
        total = F.size(tokens)
        if ratio > 0.5:
            most = let(F.get(tokens, F.floor(total / 2).cast("int")), lambda mid: F.size(F.filter(tokens, lambda x: x == mid)))
        else:
            most = F.array_max(
                F.transform(F.array_distinct(tokens), lambda x: F.size(F.filter(tokens, lambda y: y == x))))
        return (total >= min_words) & (most / total >= ratio)

    return let(F.sort_array(word_tokens(text)), check)


def short_title(title: Column, limit: int = 26) -> Column:
    flat = squeeze(title)
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def safe_filename(title: Column, fallback: str = "конспект", limit: int = 80) -> Column:
    spaced = F.translate(F.coalesce(title, F.lit("")), '<>:"/\\|?*', "         ")
    trimmed = F.regexp_replace(squeeze(spaced), r"^[ .]+|[ .]+$", "")
    return F.substring(F.when(trimmed == "", F.lit(fallback)).otherwise(trimmed), 1, limit)


def stable_key(*parts: Column) -> Column:
    """12 hex characters identifying the values of `parts`."""
    packed = F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(packed, 256), 1, 12)


def latex_escape(text: Column) -> Column:
    """The ten special characters of LaTeX, escaped. Pieces between backslashes are escaped apart."""
    def piece(x):
        marked = F.regexp_replace(x, r"([&%$#_{}])", r"\\$1")
        return F.replace(
            F.replace(marked, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\textasciicircum{}"))

    return F.array_join(F.transform(F.split(text, r"\\"), piece), "\\textbackslash{}")
