"""Transliteration by a table that is made once on the driver from the ICU library in Spark's class path.

The table has single characters and, for scripts whose letters change beside one another (vowel signs, doubled and
long kana, Greek diphthongs), the pairs and triples that ICU writes otherwise than their parts; the longest one counts.
Han characters are set apart by blanks as ICU does it. Out of reach are rules that look further:
conjuncts of Indic scripts but Devanagari, the reordered vowels of Thai and Lao, hyphens between Hangul syllables.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY_LATIN_ASCII = "Any-Latin; Latin-ASCII"
EMOJI_REMOVER = "Emoji-Remover"
_EMOJI = regex.compile(r"[\p{Emoji_Presentation}\p{Extended_Pictographic}][\p{Emoji_Modifier}️]?")
#: Scripts whose letters are tried in pairs, and for the last one in triples.
_NEIGHBOURS = ((0x370, 0x400), (0x531, 0x588), (0x620, 0x653), (0x900, 0x970), (0x980, 0xA00), (0x3041, 0x30FF))
_HAN = regex.compile(r"(?<=[\p{L}\p{N}。．！？])(?=\p{Han})")
_BLOCKS = ((0x80, 0x3100), (0x3100, 0x3400), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xFB00, 0xFE00), (0xFF00, 0xFFEF))


def remove_emoji(text: str) -> str:
    """Every emoji, with its skin tone, becomes as many spaces as it has UTF-16 units."""
    return _EMOJI.sub(lambda m: " " * (len(m.group().encode("utf-16-le")) // 2), text)


def strip_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _icu(transliterator_id: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a transliteration table needs a session")
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(transliterator_id)

    def lines(texts: list[str]) -> list[str] | None:
        """Each text by itself; None where a line end went astray."""
        made = icu.transliterate("\n".join(texts)).split("\n") if texts else []
        return made if len(made) == len(texts) else None

    return lines


@lru_cache(8)
def _table(transliterator_id: str) -> dict[int, str]:
    lines = _icu(transliterator_id)
    table: dict[int, str] = {}
    for begin, end in _BLOCKS:
        points = [c for c in range(begin, end) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Zl", "Zp") and chr(c) != "\x85"]
        made = lines([chr(c) for c in points])
        if made:
            table |= {c: new.strip() if not chr(c).isspace() else " " for c, new in zip(points, made, strict=True) if new != chr(c)}
    return table


@lru_cache(8)
def _groups(transliterator_id: str) -> dict[str, str]:
    """Pairs and triples that aren't written as their parts are."""
    lines, table, found = _icu(transliterator_id), _table(transliterator_id), {}
    one = lambda c: table.get(ord(c), c)
    for begin, end in _NEIGHBOURS:
        letters = [chr(c) for c in range(begin, end) if unicodedata.category(chr(c))[0] in "LM"]
        pairs = [a + b for a in letters for b in letters]
        own = {p: new for p, new in zip(pairs, lines(pairs) or (), strict=False) if new != one(p[0]) + one(p[1])}
        if (begin, end) == _NEIGHBOURS[-1]:
            seconds = {p[1] for p in own if len([q for q in own if q[1] == p[1]]) > 20}
            longer = [p + c for p in own for c in sorted(seconds)]
            own |= {t: new for t, new in zip(longer, lines(longer) or (), strict=False) if new != own[t[:2]] + one(t[2])}
        found |= own
    return found


def conversion_ids() -> list[str]:
    spark = SparkSession.getActiveSession()
    found, ids = [], spark._jvm.com.ibm.icu.text.Transliterator.getAvailableIDs()
    while ids.hasMoreElements():
        found.append(ids.nextElement())
    return sorted(found)


def transliterate_string(text: str, transliterator_id: str = ANY_LATIN_ASCII) -> str:
    """On the driver, by the same table as ``transliterator``."""
    return _apply(text, _parts(transliterator_id))


_Parts = tuple[bool, dict[int, str], dict[str, str], bool]


def _parts(transliterator_id: str) -> _Parts:
    """Whether emoji go, the tables of characters and groups, whether Han characters are set apart."""
    parts = [p.strip() for p in transliterator_id.split(";") if p.strip()]
    rest = "; ".join(p for p in parts if p != EMOJI_REMOVER)
    latin = "Any-Latin" in parts
    return EMOJI_REMOVER in parts, _table(rest) if rest else {}, _groups(rest) if latin else {}, latin


@lru_cache(8)
def _pattern(groups: tuple[str, ...]) -> regex.Pattern:
    """Any of the groups, long ones first: the first characters by what may follow them."""
    after: dict[str, set[str]] = {}
    for g in groups:
        after.setdefault(g[0], set()).add(g[1:])
    arms = (f"{regex.escape(a)}(?:{'|'.join(map(regex.escape, sorted(b, key=lambda x: (-len(x), x))))})" for a, b in sorted(after.items()))
    return regex.compile("|".join(arms) or r"(?!)")


def _apply(text: str, parts: _Parts) -> str:
    emoji, table, groups, han = parts
    if emoji:
        text = remove_emoji(text)
    if text.isascii() or not table:
        return text
    text = unicodedata.normalize("NFC", text)
    if groups and max(text) >= "\u0370":
        text = _HAN.sub(" ", text) if han else text
        text = _pattern(tuple(groups)).sub(lambda m: groups[m.group()], text)
    return text.translate(table)


def any_to_latin(text: str) -> str:
    return transliterate_string(text, "Any-Latin")


def latin_to_ascii(text: str) -> str:
    return transliterate_string(text, "Latin-ASCII")


def any_to_ascii(text: str) -> str:
    return transliterate_string(text, ANY_LATIN_ASCII)


def transliterator(spark: SparkSession, transliterator_id: str = ANY_LATIN_ASCII):
    """Vectorised column function; null stays null. The tables have one entry a character, some 60,000 at most, and some 10,000 groups."""
    shared = spark.sparkContext.broadcast(_parts(transliterator_id))

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _apply(t, shared.value) if isinstance(t, str) else None)

    return run
