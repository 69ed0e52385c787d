"""Names, queries and formatted values. Everything is native but the similarity of last resort."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

CN_DIGITS = "零一二三四五六七八九"


def canonical(name: Column) -> Column:
    """Lower-cased, without white space and punctuation."""
    return F.lower(F.regexp_replace(name, r"[\s\p{Punct}、，。（）·]+", ""))


def numerals_to_digits(s: str) -> str:
    """Chinese numerals from 零 to 九十九 as digits; other runs stay."""
    digit = {c: i for i, c in enumerate(CN_DIGITS)} | {"两": 2}

    def value(match: re.Match) -> str:
        run = match[0]
        if "十" in run:
            tens, _, ones = run.partition("十")
            return str((digit.get(tens, 1)) * 10 + digit.get(ones, 0))
        return str(digit[run]) if len(run) == 1 else run

    return re.sub(f"[{CN_DIGITS}两十]+", value, s)


@F.pandas_udf(StringType())
def normalise_numerals(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else numerals_to_digits(s))


def _digits_aligned(part: Column, whole: Column) -> Column:
    """Part is in whole and no number is cut at either end of it."""
    at = F.instr(whole, part)
    before, after = F.substring(whole, at - 1, F.lit(1)), F.substring(whole, at + F.length(part), F.lit(1))
    digit = lambda c: c.rlike("^[0-9]$")
    cut_left = digit(F.substring(part, 1, 1)) & (at > 1) & digit(before)
    cut_right = digit(F.right(part, F.lit(1))) & digit(after)
    return (at > 0) & ~cut_left & ~cut_right


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def similarity_tier(a: Column, b: Column) -> Column:
    """1 for equal names, 0.9 and 0.85 for containment either way, else null."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(empty | a.isNull() | b.isNull(), 0.0).when(x == y, 1.0).when(_digits_aligned(y, x), 0.9).when(_digits_aligned(x, y), 0.85)


def similarity(df, a: str, b: str, out: str = "score"):
    """Tiers natively, and the sequence ratio only for the rows that no tier decides."""
    tiered = df.withColumn(out, similarity_tier(F.col(a), F.col(b)))
    undecided = F.col(out).isNull()
    lowered = lambda c: F.when(undecided, F.lower(F.trim(F.col(c))))
    return tiered.withColumn(out, F.coalesce(out, sequence_ratio(lowered(a), lowered(b))))


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str | None = None) -> Column:
    """Name of the first rule of which any term occurs."""
    out = None
    for name, terms in rules:
        hit = text.rlike("|".join(map(re.escape, terms)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def human_distance(m: Column) -> Column:
    """Spoken distance: at once below 15 m, else rounded to 10 m (5 m below 100 m), halves to even."""
    step = F.when(m >= 100, 10).otherwise(5)
    return F.when(m < 15, "now").otherwise(F.format_string("about %d m", (F.bround(m / step) * step).cast("long")))


def season(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("winter", "winter", "spring", "spring", "spring", "summer", "summer", "summer", "autumn", "autumn", "autumn", "winter"))), month)


def text_list(raw: Column) -> Column:
    """A list written as JSON or with single quotes, or a bare scalar as a list of one; null stays null."""
    listed = F.from_json(F.translate(raw, "'", '"'), "array<string>")
    return F.when(raw.isNull(), None).when(F.trim(raw).startswith("["), F.coalesce(listed, F.array(raw))).otherwise(F.array(raw))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, n), " ")
