"""What a text query asks for: dates, people, and words to look for."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a visual query does without.
STOP_WORDS = ["a", "an", "and", "at", "by", "for", "from", "in", "near", "of", "on", "the", "to", "with"]
LAST_YEAR = r"(?i)\blast year\b"
YEARS_AGO = r"(?i)\b(\d{1,2})\s+years\s+ago\b"
YEAR = r"\b((?:19|20)\d{2})\b"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _escaped(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), text, F.lit(r"\E"))


def date_intent(query: Column, today: date | Column) -> Column:
    """struct(visual_query, date_from, date_to, phrase): last year, else N years ago, else the only year named."""
    text = F.trim(F.coalesce(query, F.lit("")))
    now = F.year(today if isinstance(today, Column) else F.lit(today))
    ago = F.regexp_extract(text, YEARS_AGO, 1)
    named = F.regexp_extract(text, YEAR, 1)
    once = F.regexp_count(text, F.lit(YEAR)) == 1
    year = F.when(text.rlike(LAST_YEAR), now - 1).when(ago != "", now - ago.try_cast("int")).when(once, named.try_cast("int"))
    rest = F.when(text.rlike(LAST_YEAR), F.regexp_replace(text, LAST_YEAR, " ")).when(ago != "", F.regexp_replace(text, YEARS_AGO, " ")).when(once, F.regexp_replace(text, YEAR, " ")).otherwise(text)
    phrase = F.when(text.rlike(LAST_YEAR), F.regexp_extract(text, r"(?i)\b(last year)\b", 1)).when(ago != "", F.regexp_extract(text, r"(?i)\b(\d{1,2}\s+years\s+ago)\b", 1)).when(once, named)
    bound = lambda tail: F.when(year.isNotNull(), F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit(tail)))
    return F.struct(_squeezed(rest).alias("visual_query"), bound("-01-01").alias("date_from"), bound("-12-31").alias("date_to"), phrase.alias("phrase"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))


def visual_tokens(text: Column) -> Column:
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(tokens(text), lambda t: ~F.array_contains(stop, t))


def by_length(names: Column) -> Column:
    """Distinct names that aren't blank, the longest first, equally long ones by name."""
    kept = F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != ""))
    keyed = F.transform(kept, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))
    return F.transform(F.array_sort(keyed), lambda s: s["n"])


def decompose(query: Column, names: Column) -> Column:
    """struct(visual_query, people, residual_tokens): known ``names`` are taken out of the query, the longest first."""
    text = F.trim(F.coalesce(query, F.lit("")))
    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("people"))

    def take(state: Column, name: Column) -> Column:
        pattern = F.concat(F.lit(r"(?i)\b"), _escaped(name), F.lit(r"\b"))
        found = F.regexp_like(state["rest"], pattern)
        return F.struct(
            F.when(found, F.regexp_replace(state["rest"], pattern, F.lit(" "))).otherwise(state["rest"]).alias("rest"),
            F.when(found, F.concat(state["people"], F.array(name))).otherwise(state["people"]).alias("people"),
        )

    done = F.aggregate(by_length(names), start, take)
    rest = _squeezed(done["rest"])
    words = F.array_join(visual_tokens(rest), " ")
    return F.struct(F.when(words != "", words).otherwise(text).alias("visual_query"), done["people"].alias("people"), tokens(rest).alias("residual_tokens"))


def face_names(faces: Column) -> Column:
    """Lower-case names from a text like 'Kumar (0.98), John': a trailing bracket goes, blanks go."""
    parts = F.filter(F.transform(F.split(F.coalesce(faces, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.lower(F.trim(F.regexp_replace(p, r"\s*\([^)]*\)\s*$", ""))))
