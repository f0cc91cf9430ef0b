"""Text operators on DataFrames: cleaning with a small plan, acronym inventories and lists, word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X


def with_clean_text(df: DataFrame, column: str, output: str, acronyms: dict[str, str] | None = None) -> DataFrame:
    """Adds the cleaned text. Every step is a projection of its own over the one before, so that a text is tested for a sign before a costly step rewrites it; rows that mention no acronym take a short cut."""
    # the optimizer doesn't merge a projection into one that uses its costly result several times, so each step runs once
    made = df.withColumn(output, F.col(column))
    for name, pattern, new in X.RULES:
        made = made.withColumn(output, X.guarded_rule(F.col(output), name, pattern, new))
        if name.startswith("blanks"):
            made = made.withColumn(output, F.when(F.col(output).contains("  "), F.regexp_replace(output, " {2,}", " ")).otherwise(F.col(output)))
    if not acronyms:
        return made
    return made.withColumn(output, F.when(X.mentions_acronym(F.col(output), acronyms), X.expand_acronyms(F.col(output), acronyms)).otherwise(F.col(output)))


def detect_acronyms(sources: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(text, language, acronym), a row per acronym of each (frame, text column, language column, words column)."""
    parts = [
        df.select(F.col(text).alias("text"), F.col(language).alias("language"), X.find_acronyms(F.col(words)).alias("acronyms")).where(F.col("acronyms").isNotNull()).select("text", "language", F.explode("acronyms").alias("acronym"))
        for df, text, language, words in sources
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


def acronym_texts(found: DataFrame) -> DataFrame:
    """(acronym, language, text), each once: all that an inventory holds, in rows, however often an acronym occurs."""
    return found.distinct()


def acronym_counts(found: DataFrame, examples: int = 20) -> DataFrame:
    """(acronym, languages, n_texts, examples, expansion): how many different texts, and those of them with the smallest MD5 digests.

    Nothing grows with a frequent acronym: texts are ranked by their digests, at most ``examples`` a task move.
    """
    once = found.select("acronym", "text").distinct().withColumn("digest", F.md5("text"))
    first = Window.partitionBy("acronym").orderBy("digest")
    chosen = once.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= examples)
    chosen = chosen.groupBy("acronym").agg(F.transform(F.array_sort(F.collect_list(F.struct("digest", "text"))), lambda x: x["text"]).alias("examples"))
    counts = found.groupBy("acronym").agg(F.array_sort(F.collect_set("language")).alias("languages"), F.count_distinct("text").alias("n_texts"))
    return counts.join(chosen, "acronym").withColumn("expansion", F.lit("")).orderBy("languages", "acronym")


def acronym_inventory(found: DataFrame) -> DataFrame:
    """(acronym, languages, texts, expansion): what to fill in, sorted. A row holds every text of its acronym, so this is for short texts or ids; see ``acronym_counts`` and ``acronym_texts``."""
    grouped = found.groupBy("acronym").agg(F.array_sort(F.collect_set("language")).alias("languages"), F.array_sort(F.collect_set("text")).alias("texts"))
    return grouped.withColumn("expansion", F.lit("")).orderBy("languages", "acronym")


def stringify_inventory(inventory: DataFrame) -> DataFrame:
    joined = {c: F.array_join(c, " ||| ") for c in ("languages", "texts")}
    return inventory.withColumns(joined)


def sanitized_expansions(df: DataFrame, column: str = "expansion") -> DataFrame:
    words = F.filter(F.split(F.col(column), r"[^\p{Lu}\p{Ll}0-9]"), lambda w: w != "")
    return df.withColumn(column, F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " "))


def acronym_csv_to_parquet(io, source: str, target: str) -> DataFrame:
    """Reads (acronym, expansion), sanitises the expansions and stores them."""
    table = sanitized_expansions(io.read_csv(source))
    io.write_frame(table, target)
    return table


def load_acronyms(io=None, name: str = "acronyms") -> dict[str, str]:
    """Stored Parquet, else a CSV under the data root, else the built-in list: a small table of settings."""
    if io is not None:
        if io.exists(f"{name}.parquet"):
            return {r["acronym"]: r["expansion"] for r in io.read_frame(name).collect()}
        if io.exists(f"{name}.csv"):
            return {r["acronym"]: r["expansion"] for r in sanitized_expansions(io.read_csv(f"{name}.csv")).collect()}
    return X.builtin_acronyms()


def vocabulary(frames: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Distinct (language, word), in lower case, of (frame, language column, words column); null arrays are passed over."""
    parts = [df.where(F.col(words).isNotNull()).select(F.col(language).alias("language"), F.explode(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).alias("word")) for df, language, words in frames]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.distinct()
