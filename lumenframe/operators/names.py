"""Known names in many texts at once.

All names go into one automaton with failure links, so a text is read once whatever the number of names.
Where the names are more than a worker should hold, texts and names are joined by a run of letters instead,
and each text gets an automaton over the few names that share one with it; the rows are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import query_text

#: Characters of names that go out as one automaton (some 60 bytes each in a worker).
MOST_CHARS = 4_000_000
TAKEN = T.StructType([T.StructField("rest", T.StringType()), T.StructField("people", T.ArrayType(T.StringType()))])


def _folded(text: str) -> str:
    """Lower case, a character for each."""
    return text.lower() if text.isascii() else "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Names:
    """Names in the order they are looked for: the longest first, equally long ones by name."""

    def __init__(self, names: list[str]):
        self.names = sorted({n.strip(" ") for n in names if n and n.strip(" ")}, key=lambda n: (-len(n), n))
        self.found = ahocorasick.Automaton()
        for rank in range(len(self.names) - 1, -1, -1):  # of names that differ in case only the first counts
            self.found.add_word(_folded(self.names[rank]), rank)
        if self.names:
            self.found.make_automaton()
        #: A name could span the blank that another leaves, even if that one stood between other signs.
        self.spans = any(n[k] == " " and not _word(n[k - 1]) and not _word(n[k + 1]) for n in self.names for k in range(1, len(n) - 1))

    def _spots(self, text: str, after: int) -> list[tuple[int, int, int]]:
        if not self.names:
            return []
        hits = ((rank, end + 1 - len(self.names[rank]), end + 1) for end, rank in self.found.iter(_folded(text)))
        return sorted(h for h in hits if h[0] > after)

    def taken(self, text: str) -> tuple[str, list[str]]:
        """``text`` with a blank for each name, one name after the other, and the names that were there."""
        people: list[str] = []
        after, spots = -1, self._spots(text, -1)
        while spots:
            gone, cut, at = bytearray(len(text)), [], 0
            inside = lambda i: 0 <= i < len(text) and not gone[i] and _word(text[i])  # noqa: B023, E731
            again = False
            while at < len(spots) and not again:
                rank, upto, here = spots[at][0], 0, []
                while at < len(spots) and spots[at][0] == rank:
                    _, a, z = spots[at]
                    at += 1
                    if a >= upto and not any(gone[a:z]) and inside(a - 1) != inside(a) and inside(z - 1) != inside(z):
                        here.append((a, z))
                        upto = z
                for a, z in here:
                    gone[a:z] = b"\1" * (z - a)
                if here:
                    name = self.names[rank]
                    cut += here
                    people.append(name)
                    after, again = rank, self.spans or not (_word(name[0]) and _word(name[-1]))
            pieces, upto = [], 0
            for a, z in sorted(cut):
                pieces += [text[upto:a], " "]
                upto = z
            text = "".join([*pieces, text[upto:]])
            spots = self._spots(text, after) if again else []
        return text, people


def _by_automaton(names: list[str], spark) -> Callable[[Column], Column]:
    shipped = spark.sparkContext.broadcast(names)

    @F.pandas_udf(TAKEN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Names(shipped.value)
        for batch in batches:
            yield pd.DataFrame([known.taken(t) for t in batch], columns=["rest", "people"])

    return run


@F.pandas_udf(TAKEN)
def _by_own_names(texts: pd.Series, names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([Names(list(n)).taken(t) for t, n in zip(texts, names, strict=True)], columns=["rest", "people"])


def _runs(text: Column) -> Column:
    """The runs of letters and digits, in lower case; a name without any has the empty run."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.lower))


def decomposed(queries: DataFrame, names: DataFrame, text: str = "q", most_chars: int = MOST_CHARS) -> DataFrame:
    """``queries`` with visual_query, people and residual_tokens.

    ``names``: a column name, in any number. Names are whole words in any case and are taken out one after
    the other, the longest first (equally long ones by name); people lists them in that order. Null and
    blank names don't count; a null text is empty. If no word but stop words is left, visual_query is the
    text as it was.
    """
    spark = queries.sparkSession
    known = names.where(F.trim("name") != "").select(F.trim("name").alias("name")).distinct()
    asked = queries.withColumn("__text", F.trim(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    if (known.agg(F.sum(F.length("name")).alias("n")).first()["n"] or 0) <= most_chars:
        found = asked.withColumn("__taken", _by_automaton([r["name"] for r in known.collect()], spark)("__text"))
    else:
        found = _joined(asked, known)
    rest = F.trim(F.regexp_replace("__taken.rest", r"\s+", " "))
    words = F.array_join(query_text.visual_tokens(rest), " ")
    out = {"visual_query": F.when(words != "", words).otherwise(F.col("__text")), "people": F.col("__taken.people"), "residual_tokens": query_text.tokens(rest)}
    return found.withColumns(out).drop("__text", "__taken")


def _joined(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Each different text with the names whose longest run it holds. Taking names out never cuts a run, so no name is missed."""
    longest = F.array_sort(F.transform(_runs(F.col("name")), lambda r: F.struct((-F.length(r)).alias("k"), r.alias("r"))))
    keyed = known.select("name", F.coalesce(F.try_element_at(longest, F.lit(1))["r"], F.lit("")).alias("__run"))
    texts = asked.select("__text").distinct()
    probes = texts.select("__text", F.explode(F.concat(_runs(F.col("__text")), F.array(F.lit("")))).alias("__run"))
    own = probes.join(keyed, "__run").groupBy("__text").agg(F.collect_set("name").alias("__names"))
    taken = texts.join(own, "__text", "left").withColumn("__names", F.coalesce("__names", F.array().cast("array<string>")))
    return asked.join(taken.select("__text", _by_own_names("__text", "__names").alias("__taken")), "__text")
