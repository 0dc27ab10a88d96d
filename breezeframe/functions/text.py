"""Text checks and repairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that a briefing must not use.
HEDGES = ("generally", "more or less", "it seems", "perhaps")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def trim_words(text: Column, limit: int) -> Column:
    """The first words; cut back to the last whole sentence if there is one, else marked with dots."""
    w = words(text)
    head = F.array_join(F.slice(w, 1, limit), " ")
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.size(w) <= limit, F.array_join(w, " ")).when(whole != "", whole).otherwise(F.concat(head, F.lit("...")))


def whole_sentences(text: Column, limit: int) -> Column:
    """A text of at most `limit` words as it is; else its first whole sentences that fit together, or cut to words if not even the first fits."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    sizes = F.transform(sentences, lambda s: F.size(words(s)))
    # A running sum never falls, so sentences are taken until it passes the limit.
    step = lambda s, n: F.struct((s["sum"] + n).alias("sum"), (s["kept"] + (s["sum"] + n <= limit).cast("int")).alias("kept"))
    kept = F.aggregate(sizes, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("kept")), step)["kept"]
    return F.when(F.size(words(text)) <= limit, text).when(kept > 0, F.trim(F.array_join(F.slice(sentences, F.lit(1), kept), " "))).otherwise(trim_words(text, limit))


def answer_parts(response: Column) -> Column:
    """The answer in a model's JSON response as (text, finish, error): the parts that are no thought, each trimmed, of the first candidate.

    Text is NULL where `error` says why: no candidates, a thought alone, or nothing.
    """
    part = "struct<text: string, thought: boolean>"
    r = F.from_json(response, f"struct<candidates: array<struct<content: struct<parts: array<{part}>>, finishReason: string>>, promptFeedback: struct<blockReason: string>>")
    first = F.get(r["candidates"], 0)
    parts = F.coalesce(first["content"]["parts"], F.array().cast(f"array<{part}>"))
    thought = lambda p: F.coalesce(p["thought"], F.lit(False))
    answer = F.trim(F.array_join(F.transform(F.filter(parts, lambda p: ~thought(p)), lambda p: F.trim(F.coalesce(p["text"], F.lit("")))), ""))
    error = F.when(first.isNull(), F.lit("no candidates")).when(answer != "", F.lit(None)).when(F.exists(parts, thought), F.lit("a thought alone")).otherwise(F.concat(F.lit("empty: "), F.coalesce(r["promptFeedback"]["blockReason"], F.lit("no reason"))))
    return F.struct(F.when(error.isNull(), answer).alias("text"), F.when(error.isNull(), F.coalesce(F.nullif(first["finishReason"], F.lit("")), F.lit("UNKNOWN"))).alias("finish"), error.alias("error"))


def drop_sentences(text: Column, phrases: tuple[str, ...]) -> Column:
    """Sentences that hold one of the phrases between spaces go; runs of spaces become one."""
    pattern = r"(?i)[^.!?]* (?:" + "|".join(phrases) + r") [^.!?]*[.!?]"
    return F.trim(F.regexp_replace(F.regexp_replace(text, pattern, ""), r"\s+", " "))


def article(noun: Column) -> Column:
    return F.concat(F.when(F.lower(noun).rlike("^[aeiou]"), F.lit("an ")).otherwise(F.lit("a ")), noun)


def vague_count(n: Column) -> Column:
    return F.when(n >= 100, F.lit("many")).when(n >= 20, F.lit("several")).when(n >= 2, F.lit("a few")).otherwise(F.lit("one"))


def numbers(text: Column) -> Column:
    """Numbers that stand alone in a text."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)"), F.lit(1))


def defects(text: Column, low: int = 35, high: int = 80) -> Column:
    """Codes of the contract that a text breaks, in order: length, hedging, shouting, numbers beyond 500."""
    n = F.size(words(text))
    return F.array_compact(
        F.array(
            F.when(n < low, F.lit("too_short")),
            F.when(n > high, F.lit("too_long")),
            F.when(F.lower(text).rlike(r"(?<![0-9A-Za-z_])(" + "|".join(HEDGES) + r")(?![0-9A-Za-z_])"), F.lit("hedging")),
            F.when(F.contains(text, F.lit("!!")), F.lit("shouting")),
            F.when(F.exists(numbers(text), lambda x: x.cast("double") > 500), F.lit("number_out_of_range")),
        )
    )
