"""Quality rules with verdicts on whole hosts, in DataFrame functions only.

Every text gets counts and base rules.  Failures are aggregated by host, each
host's failure rate is shrunk towards the rate of all hosts by a beta prior
whose strength is estimated from the spread between hosts (moments), and a host
whose shrunk rate is above ``max_rate`` by ``sigmas`` posterior deviations
loses all its documents.

Nulls: a null or empty text has no words and fails the base rules; rows with a
null host share one host.  Repeated rows count each and stay each.  A table
without rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SPACE = r"[\x20\x09-\x0D]+"


def _with_features(docs: DataFrame, text: Column) -> DataFrame:
    """docs and the counts of each text; intermediate columns start with two underscores and go again.

    Windows are compared by a 64-bit hash of their three words.  Texts without
    a repeated window, nearly all, skip the sort of the windows' positions.
    """
    out = docs.withColumn("__t", F.coalesce(text, F.lit("")))
    out = out.withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
    out = out.withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long"))
    out = out.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    windows = F.transform("__w", lambda w, i: F.xxhash64(w, F.get(F.col("__w"), i + 1), F.get(F.col("__w"), i + 2)))
    out = out.withColumn("__h", F.when(F.col("n_words") >= 3, F.slice(windows, F.lit(1), F.size("__w") - 2)))
    out = out.withColumn("__r", F.size(F.array_distinct("__h")) < F.size("__h"))
    out = out.withColumn("__s", F.when(F.col("__r"), F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.filter(F.transform("__s", lambda x, k: F.when((x["h"] == F.get(F.col("__s"), k - 1)["h"]) | (x["h"] == F.get(F.col("__s"), k + 1)["h"]), x["i"])), lambda x: x.isNotNull())
    out = out.withColumn("__p", F.sort_array(at))
    covered = F.aggregate(F.transform("__p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("__p"), k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("__t", "__w", "__l", "__h", "__r", "__s", "__p")


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def host_verdicts(failures: DataFrame, *, max_rate: float = 0.5, sigmas: float = 3.0) -> DataFrame:
    """One row for each host of (host, failed): n, failures, the shrunk rate and whether it is rejected."""
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    prior = hosts.agg(F.sum("f").alias("sf"), F.sum("n").alias("sn"), F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("inv"))
    # Moments of a beta distribution over hosts: the variance of the rates less what sampling n documents a host explains.
    m = F.least(F.greatest(F.coalesce("mean", F.lit(0.0)), F.lit(1e-4)), F.lit(1 - 1e-4))
    between = F.greatest(F.coalesce("var", F.lit(0.0)) - m * (1 - m) * F.col("inv"), F.lit(1e-6))
    strength = F.least(F.greatest(m * (1 - m) / between - 1, F.lit(2.0)), F.lit(1000.0))
    prior = prior.select((m * strength).alias("a"), ((1 - m) * strength).alias("b"))
    out = hosts.join(F.broadcast(prior))  # one row
    total = F.col("n") + F.col("a") + F.col("b")
    shrunk = (F.col("f") + F.col("a")) / total
    out = out.withColumn("rate", shrunk).withColumn("deviation", F.sqrt(shrunk * (1 - shrunk) / (total + 1)))
    return out.select("host", "n", "f", "rate", (F.col("rate") - sigmas * F.col("deviation") > max_rate).alias("rejected"))


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", with_text: bool = False, **verdict) -> DataFrame:
    """Every document's counts, base_failed and kept; with_text: also __id, __text, __rest of ``shared.packed``.

    The counts are made once and written to the shared folder, since hosts must
    be known before any document is judged.  Verdicts are one row a host; the
    join back to documents is left to adaptive execution, which broadcasts them
    only while they are small.
    """
    host = F.col(f"`{host_col}`").cast("string")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)], F.lit(True).alias("__here"))
    wide = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), host.alias("host"), *([rest.alias("__rest")] if with_text else []))
    made = _with_features(wide, F.col("__text"))
    made = shared.written(made if with_text else made.drop("__text"), "quality")
    hosts = host_verdicts(made.select("host", F.col("base_failed").alias("failed")), **verdict)
    hosts = hosts.where("rejected").select(F.col("host").alias("__host"), F.lit(True).alias("__out"))
    judged = made.join(hosts, F.col("host").eqNullSafe(F.col("__host")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("__out").isNull()).drop("__host", "__out")


def op6_host_rules(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The digest of the quality rules over all documents."""
    return assess(docs).select(F.col("__id").alias("doc_id"), *FEATURES, "kept")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT doc_id, len(l) - len(list_distinct(l)) AS n_dup_lines FROM (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words)
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words)
), often AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c >= 2
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM often) GROUP BY doc_id
), base AS (
  SELECT words.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM failed GROUP BY source
), prior AS (
  SELECT m * s AS a, (1 - m) * s AS b FROM (
    SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-6) - 1, 2.0), 1000.0) AS s FROM (
      SELECT least(greatest(avg(f / n), 1e-4), 1 - 1e-4) AS m, var_pop(f / n) AS v, avg(1 / n) AS inv FROM hosts))
), verdicts AS (
  SELECT source, (f + a) / (n + a + b) AS rate, n + a + b AS total FROM hosts, prior
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT (rate - 3 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5) AS kept
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""
