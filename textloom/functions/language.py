"""Language detection as one native expression: script first, then stop-word hits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import STOP_WORD_LANGUAGES, stop_words

#: Scripts that settle the language, by letters that only it has.
_SCRIPTS = (("he", r"\p{IsHebrew}"), ("ar", r"\p{IsArabic}"), ("el", r"\p{IsGreek}"), ("uk", "[іїєґ]"), ("bg", "ъ[а-я]{0,3}т[а-я]?(?![а-яё])"), ("ru", r"\p{IsCyrillic}"), ("vi", "[ơưăđ]"))


def stop_word_hits(words: Column, language: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*stop_words(language))))


def detect_language(text: Column, supported: Iterable[str], default: str) -> Column:
    """The supported language with most stop-word hits (ties: alphabetical order); the default for null, empty or undecided texts."""
    codes = sorted(set(supported))
    lowered = F.lower(text)
    listed = [c for c in codes if c in STOP_WORD_LANGUAGES and c != "ru"]
    every = sorted({w for c in listed for w in stop_words(c)})

    def scored(words: Column) -> Column:
        return F.array_max(F.array(*[F.struct(stop_word_hits(words, c).alias("n"), F.lit(-i).alias("order"), F.lit(c).alias("code")) for i, c in enumerate(listed)]))

    if listed:
        # the words that are in any list, bound once: the text is split once, not once a language
        kept = F.filter(F.split(lowered, r"[^\p{L}\p{N}]+"), lambda w: w.isin(*every))
        best = F.element_at(F.transform(F.array(kept), scored), 1)
    else:
        best = F.struct(F.lit(0).alias("n"), F.lit(0).alias("order"), F.lit(default).alias("code"))
    chosen = F.when(best["n"] > 0, best["code"])
    for code, letters in _SCRIPTS:
        if code in codes:
            chosen = chosen.when(lowered.rlike(letters), F.lit(code))
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(F.coalesce(chosen, F.lit(default)))
