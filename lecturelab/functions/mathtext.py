"""Formulas and terms of notes as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lecturelab.functions.text import let

# Math delimiters, literal rewrites in this order, wrappers to unwrap, term shape, stop words.
MATH_PATTERNS = (
    r"(?s)\$\$(.+?)\$\$",
    r"(?s)\\\[(.+?)\\\]",
    r"(?s)\\begin\{(?:equation\*?|align\*?|gather\*?)\}(.+?)\\end\{[^}]+\}",
    r"(?<!\$)\$([^$]+?)\$(?!\$)",
)
# What a text must hold for the pattern of that place to match.
MATH_OPENINGS = ("$$", "\\[", "\\begin{", "$")
REWRITES = (
    ("\\left", ""), ("\\right", ""), ("\\limits", ""), ("\\!", ""), ("\\,", " "), ("\\;", " "), ("\\:", " "),
    ("\\quad", " "), ("\\qquad", " "), ("\\displaystyle", ""), ("\\mathbb", "\\mathbf"), ("\\hat", "\\widehat"),
    ("\\tilde", "\\widetilde"),
)
COMMON = ("\\mathbb", "\\mathbf")
RARE = "|".join(re.escape(old) for old, _ in REWRITES if old != COMMON[0])
WRAPPERS = ("label", "tag", "text", "mathrm")
TERM = r"[А-Яа-яЁёA-Za-z][А-Яа-яЁёA-Za-z\-]{4,}"
STOP_WORDS = (
    "который", "которая", "которые", "поэтому", "например", "значит", "будем", "можно", "нужно", "также", "здесь",
    "тогда", "таким", "образом", "просто", "этого", "этому", "потому", "давайте", "получаем", "получается",
)


def normalise_math(expr: Column, wrappers: tuple[str, ...] = WRAPPERS) -> Column:
    """One spelling per formula: rewrites in order, wrappers unwrapped, braces and spaces dropped."""
    # One look tells whether a text needs more than the commonest rewrite, which makes none of the others possible.
    def rewritten(f: Column) -> Column:
        every = f
        for old, new in REWRITES:
            every = F.replace(every, F.lit(old), F.lit(new))
        return F.when(f.rlike(RARE), every).otherwise(F.replace(f, F.lit(COMMON[0]), F.lit(COMMON[1])))

    def unwrapped(f: Column) -> Column:
        return F.regexp_replace(let(f, rewritten), r"\\(?:" + "|".join(wrappers) + r")\{([^}]*)\}", "$1")

    # all rewrites and wrappers start with a backslash, and most spaces are plain ones: patterns meet few texts
    one = let(expr, lambda f: F.when(f.contains("\\"), unwrapped(f)).otherwise(f))
    return F.regexp_replace(F.replace(one, F.lit(" "), F.lit("")), r"[{}\s]+", "")


def extract_math(tex: Column, wrappers: tuple[str, ...] = WRAPPERS) -> Column:
    """Normalised formulas of at least three characters, by kind of delimiter, repeats kept."""
    none = F.array().cast("array<string>")
    every = lambda t, opening, p: F.when(~t.contains(opening), none).otherwise(F.regexp_extract_all(t, F.lit(p), F.lit(1)))
    found = lambda t: F.flatten(F.array(*[every(t, *kind) for kind in zip(MATH_OPENINGS, MATH_PATTERNS, strict=True)]))
    formulas = let(tex, lambda t: F.transform(found(t), lambda f: normalise_math(f, wrappers)))
    return F.filter(formulas, lambda f: F.length(f) >= 3)


def term_words(text: Column) -> Column:
    """Lower-case words of five or more letters without stop words, repeats kept."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
