"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text is built on the driver. A text is cut greedily into phrases,
each the longest match in that language's text; the language that needs the fewest phrases, each priced at the
logarithm of its reference length, wins. Texts are lower-cased, runs of anything but letters become one
separator, and every text is parsed whole, in blocks of ``BLOCK`` characters that each begin a phrase, so that
all blocks of a batch walk the automata in lockstep.

Every letter of every reference sample keeps a code of its own, in whatever script. The transitions of all
automata share one table: a state is a place in it, its transition by a code lies that many entries further and
names the state it belongs to, and rows are interleaved so that hardly an entry stays empty. That takes some
20 bytes a character of the samples, whatever the alphabet.

The reference sample is bounded by ``DOCS_PER_LANG``, ``CHARS_PER_DOC`` (a stretch of the text, from a place
that its hash picks), ``CHARS_PER_LANG``, and ``CHARS_IN_ALL``, which the languages share evenly where they are many;
so what each worker gets stays below some 100 MB for any number of languages.

Defined results: a text that is null, empty or has no letter is ``und`` with score 0, and so is every text when
nothing was learned; ties go to the language first in alphabetical order; repeated rows are answered alike; a
row without an id is never learned from and not held out; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import random
import sys
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import doc_crc
from textloom.sources.io import read_table

UNKNOWN = "und"
BLOCK = 256
DOCS_PER_LANG, CHARS_PER_DOC, CHARS_PER_LANG, CHARS_IN_ALL = 64, 1500, 48_000, 4_000_000
_SEGMENT = 1 << 20
_LOW = 0 if sys.byteorder == "little" else 1  # where the lower half of a 64-bit number lies


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``codes``; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def interleave(rows: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows in one table, and the table: whose entry it is (-1: nobody's), and the place of the row it leads to.

    Rows of several entries go to random places where all of these are free, long rows first; the others, which are
    most, fill what is left from the beginning. No two rows share a place.
    """
    widest = max((max(r) for r in rows if r), default=0) + 2
    total = sum(map(len, rows))
    size = total + total // 4 + 2 * widest + len(rows) // 8
    used, started, place = bytearray(size), bytearray(size), [0] * len(rows)
    draw = random.Random(7).random
    for s in sorted((s for s in range(len(rows)) if len(rows[s]) > 1), key=lambda s: -len(rows[s])):
        codes, tries = list(rows[s]), 0
        at = int(draw() * (size - widest))
        while started[at] or any(used[at + c] for c in codes):
            tries += 1
            if tries > 1000:  # too full for long rows
                used, started, size, tries = used + bytes(size), started + bytes(size), 2 * size, 0
            at = int(draw() * (size - widest))
        place[s] = at
        started[at] = 1
        for c in codes:
            used[at + c] = 1
    at = 0
    for s, row in enumerate(rows):
        if len(row) == 1:
            (code,) = row
            at = used.find(0, max(at, code))
            while at < 0 or started[at - code]:
                if at < 0:
                    at = size - 1
                    used, started, size = used + bytes(size), started + bytes(size), 2 * size
                at = used.find(0, at + 1)
            place[s] = at - code
            started[at - code] = used[at] = 1
        elif not row:
            place[s] = started.index(0)
            started[place[s]] = 1
    sources = np.repeat(np.array(place, np.int64), [len(r) for r in rows])
    entries = sources + np.array([c for r in rows for c in r], np.int64)
    size = max(max(place), int(entries.max(initial=0))) + 1
    owner, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    owner[entries] = sources
    target[entries] = np.array(place, np.int64)[np.array([t for r in rows for t in r.values()], np.int64)]
    return np.array(place), owner, target


@lru_cache(2)
def _codes_of(letters: str) -> np.ndarray:
    """Code of each code point: 0 for what is no letter, the last one for letters that no sample has."""
    lut = np.array([len(letters) + 1 if chr(i).isalpha() else 0 for i in range(sys.maxunicode + 1)], np.int32)
    lut[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    return lut


class CrossParser:
    """The automata of all languages in one interleaved table."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(k for k, texts in samples.items() if any(any(c.isalpha() for c in t) for t in texts))
        lowered = {lang: [t.lower() for t in samples[lang]] for lang in self.langs}
        self.letters = "".join(sorted({c for own in lowered.values() for t in own for c in t if c.isalpha()}))
        self.width = len(self.letters) + 2
        owners, targets, self.root, self.bits, self.alphabet, at = [], [], [], [], [], 0
        for lang in self.langs:
            codes = np.concatenate([np.append(self._fold(t), 0) for t in lowered[lang]])
            place, owner, target = interleave(suffix_automaton(codes))
            owners.append(np.where(owner >= 0, owner + at, -1))
            targets.append(target + at)
            self.root.append(int(place[0]) + at)
            self.bits.append(math.log2(max(2, len(codes))))
            self.alphabet.append(len(np.unique(codes)))
            at += len(owner)
        pad = np.full(self.width, -1, np.int32)  # a step from the last place stays in the table
        owner, target = np.concatenate([*owners, pad]).astype(np.int64), np.concatenate([*targets, pad]).astype(np.int64)
        self.table = owner << 32 | target & 0xFFFFFFFF  # both parts of an entry in one look

    @property
    def owner(self) -> np.ndarray:
        return (self.table >> 32).astype(np.int32)

    @property
    def target(self) -> np.ndarray:
        return self.table.astype(np.int32)

    @property
    def keys(self) -> np.ndarray:
        """Entries of the table that hold a transition."""
        return np.flatnonzero(self.owner >= 0)

    @property
    def lut(self) -> np.ndarray:
        return _codes_of(self.letters)

    def _fold(self, lowered: str) -> np.ndarray:
        points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.lut[points]
        if not len(codes):
            return codes
        keep = np.ones(len(codes), bool)
        keep[0] = codes[0] != 0
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        return codes[keep]

    def phrases(self, blocks: list[np.ndarray]) -> np.ndarray:
        """(languages, blocks) counts of phrases; no block is longer than ``BLOCK``."""
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        lengths = sizes[order]
        width = int(lengths[0])
        grid = np.zeros((width, len(blocks)), np.int32)
        flat = np.concatenate([blocks[i] for i in order])
        column = np.repeat(np.arange(len(blocks)), lengths)
        grid[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), column] = flat
        langs, table = len(self.langs), self.table
        # by block and then by language, so that the blocks still under way are one stretch of memory
        root = np.tile(np.array(self.root, np.int32), len(blocks))
        state, count = root.copy(), np.zeros(len(root), np.int32)
        active = langs * np.searchsorted(-lengths, -np.arange(width), "left")  # blocks longer than k
        for k in range(width):
            n = active[k]
            now = state[:n]
            at = now + np.repeat(grid[k, : n // langs], langs)
            entry = table.take(at).view(np.int32)
            to = entry[_LOW::2].copy()
            ends = np.flatnonzero(entry[1 - _LOW :: 2] != now)
            if len(ends):  # a phrase ends; a letter that the language lacks is one of its own
                here, before = root.take(ends), now.take(ends)
                entry = table.take(here + at.take(ends) - before).view(np.int32)
                known = entry[1 - _LOW :: 2] == here
                to[ends] = np.where(known, entry[_LOW::2], here)
                count[ends] += (before != here).astype(np.int32) + ~known
            state[:n] = to
        count += state != root
        out = np.zeros((langs, len(blocks)), np.int32)
        out[:, order] = count.reshape(-1, langs).T
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.measure(texts)[:2]

    def measure(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and whether its language explains it: see ``keep_known_languages``."""
        langs, scores, explained = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.langs:
            return langs, scores, explained
        sizes = np.zeros(len(texts))
        totals = np.zeros((len(self.langs), len(texts)))
        blocks: list[np.ndarray] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if blocks:
                found = self.phrases(blocks)
                for k in range(len(self.langs)):
                    totals[k] += np.bincount(owner, found[k], len(texts))
            blocks.clear()
            owner.clear()
            held = 0

        for i, text in enumerate(texts):
            lowered = (text or "").lower()
            for at in range(0, len(lowered), _SEGMENT):
                codes = self._fold(lowered[at : at + _SEGMENT])
                if codes.any():
                    sizes[i] += len(codes)
                    for b in range(0, len(codes), BLOCK):
                        blocks.append(codes[b : b + BLOCK])
                        owner.append(i)
                    held += len(codes)
                if held > 1 << 20:
                    flush()
        flush()
        cost = totals * np.array(self.bits)[:, None]
        best = cost.argmin(axis=0)
        weight = np.exp2(-np.minimum(cost - cost.min(axis=0), 1000.0))
        share = weight.max(axis=0) / weight.sum(axis=0)
        plain = sizes * np.log2(np.array(self.alphabet))[best]
        explained = (sizes > 0) & (cost.min(axis=0) < plain + 2 * np.array(self.bits)[best])
        for i in np.flatnonzero(totals.sum(axis=0) > 0).tolist():
            langs[i], scores[i] = self.langs[best[i]], share[i]
        return langs, scores, explained


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC, chars_per_lang: int = CHARS_PER_LANG, chars_in_all: int = CHARS_IN_ALL) -> CrossParser:
    """Fits on a bounded sample of labelled rows whose id's crc32 leaves no 1 when divided by 3.

    Of each language the ``4 * docs_per_lang`` different texts of smallest hash are candidates, however often each occurs;
    they are taken in that order until they have ``chars_per_lang`` characters, or the language's share of ``chars_in_all``.
    """
    rows = docs.where((doc_crc() % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    smallest = rows.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= 4 * docs_per_lang)
    last = {r["lang"]: r["last"] for r in smallest.groupBy("lang").agg(F.max("h").alias("last")).collect()}
    if not last:
        return CrossParser({})
    share = min(chars_per_lang, max(1, chars_in_all // len(last)))
    bound = F.create_map(*[F.lit(x) for item in last.items() for x in item])
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - chars_per_doc, F.lit(0)) + 1) + 1
    stretch = F.substr("text", begin.cast("int"), F.lit(chars_per_doc))
    picked = rows.where(F.col("h") <= bound[F.col("lang")]).select("lang", "h", stretch.alias("text")).distinct().collect()
    samples: dict[str, list[str]] = {}
    used: dict[str, int] = {}
    for r in sorted(picked, key=lambda r: (r["h"], r["text"])):
        if used.get(r["lang"], 0) < share:
            samples.setdefault(r["lang"], []).append(r["text"])
            used[r["lang"]] = used.get(r["lang"], 0) + len(r["text"])
    return CrossParser(samples)


def predictor(spark, parser: CrossParser):
    """Column function: text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(parser)

    @F.pandas_udf("lang_pred string, score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict([x if isinstance(x, str) else None for x in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return identify


def identify_languages(docs: DataFrame, parser: CrossParser | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    parser = parser or learn(docs)
    found = docs.select("doc_id", predictor(docs.sparkSession, parser)("text").alias("found"))
    return found.select("doc_id", F.coalesce(doc_crc() % 3 == 1, F.lit(False)).alias("held_out"), "found.lang_pred", "found.score")


def keep_known_languages(docs: DataFrame, parser: CrossParser | None = None) -> DataFrame:
    """The documents whose language is recognised, columns as they are.

    Rejected are ``und`` and texts that their best language doesn't explain: whose phrases cost as much as spelling
    them letter by letter would, and two phrases more. Ties between languages are no reason to reject.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser or learn(docs))

    @F.pandas_udf("boolean")
    def explained(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.measure([x if isinstance(x, str) else None for x in texts])[2])

    return docs.where(explained("text"))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
