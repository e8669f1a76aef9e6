"""Quality rules of documents, and verdicts on the hosts they come from.

``RULES`` are what a document can fail: few_words, repeated (too large a share of its words in
repeated ``WINDOW``-word windows), symbols (too many for its letters) and same_lines (too many
repeated lines for its words). The first two, ``BASE``, reject the document itself; all four count
against its host (``host_verdicts``): the documents that fail a rule are summed by host and rule, each
rule's rates are shrunk by a beta prior of its own, fitted to the rates of all hosts (method of
moments, weighted by documents), and a host is rejected when for any rule the lower end of its
posterior rate, two standard deviations below the mean, is above ``max_rate``. A document is kept if
it passes ``BASE`` and its host isn't rejected.

Null texts have no words and fail. A null host is a host of its own that is never rejected: such
documents share no origin. Repeated rows are measured and counted row by row. An empty table has no
hosts. A very long text is a slice of its own, of some 100 bytes a word. Further columns of ``docs``
stay as they are unless they are named like a measure or verdict; ``kept_rows`` keeps those too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import storage

WINDOW = 8
SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICTS = ["base_failed", "host_rate", "host_rule", "host_rejected", "kept"]
#: What fails a document, as SQL over ``MEASURES``.
RULES = {"few_words": "n_words < 20", "repeated": "100 * n_repeat_words > 30 * n_words", "symbols": "10 * n_symbols > word_chars", "same_lines": "10 * n_dup_lines > n_words"}
BASE = ["few_words", "repeated"]


def repeated_words(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words stand in a window of ``WINDOW`` words that occurs again in the same text.

    ``ids``: word numbers of all texts; ``bounds``: the end of each text. Windows are compared
    exactly, by numbering pairs of words, pairs of pairs, and pairs of those.
    """
    n, covered = len(ids), np.zeros(len(ids) + 1, np.int64)
    if n < WINDOW:
        return covered[:-1] > 0
    text = np.repeat(np.arange(len(bounds)), np.diff(bounds, prepend=0))
    number, width = ids, 1
    while width < WINDOW:
        pairs = number[:-width] * (int(number.max()) + 1) + number[width:]
        number = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    first = np.flatnonzero(text[: len(number)] == text[WINDOW - 1 :])
    key = number[first] * (int(text[-1]) + 1) + text[first]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    again = first[times[which] > 1]
    covered[again] += 1
    np.subtract.at(covered, again + WINDOW, 1)
    return np.cumsum(covered)[:-1] > 0


def measures_of(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """``MEASURES`` of UTF-8 texts; words are what stands between ASCII white space."""
    out = {m: np.zeros(len(texts), np.int64) for m in MEASURES}
    ids: list[int] = []
    seen: dict[bytes, int] = {}
    for k, text in enumerate(texts):
        if not text:
            continue
        words = text.split()
        ids += [seen.setdefault(w, len(seen)) for w in words]
        out["n_words"][k] = len(words)
        squeezed = np.frombuffer(b"".join(words), np.int8)
        out["word_chars"][k] = int((squeezed >= -64).sum())  # all bytes but the later ones of a character
        out["n_symbols"][k] = len(text.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        out["n_dup_lines"][k] = len(lines) - len(set(lines))
    bounds = np.cumsum(out["n_words"])
    hit = np.concatenate([[0], np.cumsum(repeated_words(np.array(ids, np.int64), bounds))])
    out["n_repeat_words"] = np.diff(hit[bounds], prepend=0)
    return out


def measure(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``docs`` with ``MEASURES`` and base_failed added, and without their text if not ``with_text``; row by row."""
    kept = [c for c in docs.columns if c not in [*MEASURES, "base_failed"]]
    out = kept if with_text else [c for c in kept if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in storage.by_size(batch, "text"):
                got = measures_of(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), *(pa.array(got[m]) for m in MEASURES)], names=[*out, *MEASURES])

    schema = T.StructType([*docs.select(*out).schema, *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return storage.in_small_batches(docs.select(*kept)).mapInArrow(work, schema).withColumn("base_failed", F.expr(" OR ".join(RULES[r] for r in BASE)))


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """A row per non-null host: n_docs, n_<rule> for each rule, host_rate (the highest of its shrunk failure rates), host_rule (whose it is), host_rejected.

    A prior's mean m is the rule's rate over all documents of these hosts; its weight is the number
    of documents that makes the spread of host rates what it is beyond chance (at least 1, at most 1e6).
    """
    failed = [F.count_if(F.expr(rule)).alias(f"n_{name}") for name, rule in RULES.items()]
    hosts = storage.cut(measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *failed))
    n = F.col("n_docs").cast("double")
    x = {name: F.col(f"n_{name}").cast("double") for name in RULES}
    sums = hosts.agg(F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count("*").alias("h"), *(f(v).alias(f"{k}_{name}") for name, v in x.items() for k, f in (("x", F.sum), ("xx", lambda v: F.sum(v * v / n))))).first()
    rates = []
    for name, v in x.items():
        mean, weight = beta_prior(sums["n"], sums[f"x_{name}"], sums["nn"], sums[f"xx_{name}"], sums["h"])
        rate = (v + mean * weight) / (n + weight)
        low = rate - 2 * F.sqrt(rate * (1 - rate) / (n + weight + 1))
        rates.append(F.struct(rate.alias("rate"), F.lit(name).alias("rule"), (low > max_rate).alias("rejects")))
    every = F.array(*rates)
    return hosts.select("host", "n_docs", *(f"n_{name}" for name in RULES), F.array_max(every)["rate"].alias("host_rate"), F.array_max(every)["rule"].alias("host_rule"), F.exists(every, lambda r: r["rejects"]).alias("host_rejected"))


def beta_prior(n: float | None, x: float, nn: float, xx: float, hosts: int) -> tuple[float, float]:
    """Mean and weight of the prior from sums over hosts: documents n, failures x, n squared, x squared by n."""
    if not n:
        return 0.0, 1.0
    mean = x / n
    chance, size = mean * (1 - mean), n - nn / n
    between = (xx - n * mean * mean - (hosts - 1) * chance) / size if size > 0 else 0.0
    return mean, min(1e6, max(1.0, chance / between - 1)) if between > 0 else 1e6


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5, with_text: bool = True) -> DataFrame:
    """``docs`` with ``MEASURES`` and ``VERDICTS``.

    With their texts, documents are measured twice, once to sum up the hosts and once for the
    result, rather than shuffled or stored; without, the measures are stored and read twice. Hosts
    are looked up by broadcast while they are few, else by a join.
    """
    plain = docs.drop(*(c for c in [*MEASURES, *VERDICTS] if c != host))
    place = f"__lf_c{plain.columns.index(host)}"
    return storage.with_safe_names(plain, ["text"], lambda d: _judged(d.withColumn("__lf_host", F.col(place)), max_rate, with_text).drop("__lf_host"))


def _judged(docs: DataFrame, max_rate: float, with_text: bool) -> DataFrame:
    host = "__lf_host"
    measured = measure(docs) if with_text else storage.written(measure(docs, with_text=False))
    hosts = host_verdicts(measure(docs.select("text", host), with_text=False) if with_text else measured, host, max_rate)
    few = hosts.count() <= 200_000
    right = hosts.select(F.col("host").alias("__lf_name"), "host_rate", "host_rule", "host_rejected")
    found = measured.join(F.broadcast(right) if few else right, F.col(host) == F.col("__lf_name"), "left").drop("__lf_name")
    rejected = F.coalesce(F.col("host_rejected"), F.lit(False))
    return found.withColumn("host_rejected", rejected).withColumn("kept", ~F.col("base_failed") & ~rejected)


def kept_rows(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns, whatever those are named."""
    own = {c: c if c == "text" else f"__lf_c{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(storage.quoted(c)).alias(name) for c, name in own.items()), F.col(storage.quoted(host)).alias("__lf_host"))
    return _judged(renamed, max_rate, True).where("kept").select(*(F.col(name).alias(c) for c, name in own.items()))


#: Measures and verdicts by comparing all windows as texts; one row a doc_id.
SQL = r"""
WITH parts AS (
    SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), stretches AS (
    SELECT doc_id, a, array_to_string(w[a : a + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS a FROM parts WHERE len(w) >= 8)
), again AS (
    SELECT doc_id, a FROM (SELECT doc_id, a, count(*) OVER (PARTITION BY doc_id, s) AS k FROM stretches) WHERE k > 1
), repeated AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(a, a + 7)) AS p FROM again) GROUP BY doc_id
), measured AS (
    SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM parts LEFT JOIN repeated r USING (doc_id)
), failed AS (
    SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 10 * n_symbols > word_chars AS f3, 10 * n_dup_lines > n_words AS f4 FROM measured
), hosts AS (
    SELECT source AS host, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (f) AS DOUBLE) AS x
    FROM (SELECT source, unnest(['few_words', 'repeated', 'symbols', 'same_lines']) AS rule, unnest([f1, f2, f3, f4]) AS f FROM failed WHERE source IS NOT NULL) GROUP BY ALL
), sums AS (
    SELECT rule, sum(n) AS n, sum(x) AS x, sum(n * n) AS nn, sum(x * x / n) AS xx, count(*) AS h, sum(x) / sum(n) AS m FROM hosts GROUP BY rule
), spread AS (
    SELECT rule, m, m * (1 - m) AS c, CASE WHEN n - nn / n > 0 THEN (xx - n * m * m - (h - 1) * m * (1 - m)) / (n - nn / n) ELSE 0 END AS b FROM sums
), prior AS (
    SELECT rule, m, CASE WHEN b > 0 THEN least(1e6, greatest(1, c / b - 1)) ELSE 1e6 END AS w FROM spread
), rates AS (
    SELECT host, rule, CAST(n AS BIGINT) AS n_docs, CAST(x AS BIGINT) AS n_failed, n, w, (x + m * w) / (n + w) AS rate FROM hosts JOIN prior USING (rule)
), verdicts AS (
    SELECT host, max(rate) AS rate, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (n + w + 1)) > 0.5) AS rejected FROM rates GROUP BY host
)
"""

SQL_DOCUMENTS = SQL + r"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT coalesce(rejected, false) AS kept, source, round(rate, 6) AS host_rate, coalesce(rejected, false) AS host_rejected
FROM failed LEFT JOIN verdicts ON source = host
"""

#: The hosts' verdicts where the short texts of a language are a host of their own.
SQL_HOSTS = SQL.replace("FROM documents", "FROM (SELECT * REPLACE (coalesce(lang, '') || CASE WHEN n_chars < 160 THEN '/short' ELSE '/long' END AS source) FROM documents)") + r"""SELECT host, max(n_docs) AS n_docs, max(n_failed) FILTER (rule = 'few_words') AS n_few_words, max(n_failed) FILTER (rule = 'repeated') AS n_repeated, max(n_failed) FILTER (rule = 'symbols') AS n_symbols,
    max(n_failed) FILTER (rule = 'same_lines') AS n_same_lines, round(max(v.rate), 6) AS host_rate, bool_or(rejected) AS host_rejected FROM rates JOIN verdicts v USING (host) GROUP BY host
"""
