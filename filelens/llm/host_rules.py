"""Quality rules per document and per host. DataFrame functions only.

A document fails by itself if it is short or repeats itself. Failures are then
counted by host, each host's rate is shrunk towards the rate of all hosts with a beta
prior fitted to them by its moments, and the documents of hosts whose shrunk rate is
above ``most`` are not kept either.

Rows: null texts have no words; every row gives a row (repeated rows too); a row
without a host is judged by itself alone; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelens.session import keep

SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 10
REPEATED_PERCENT = 20
WINDOW = 5
PARTS = 64  # that the rows of each host are dealt to
MOST = 0.5  # shrunk share of failing documents above which a host is rejected


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _covered(starts: Column, width: int) -> Column:
    """How many positions lie in windows of ``width`` that begin at sorted starts."""
    following = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.lit(2**31 - 1)))
    new = F.zip_with(starts, following, lambda a, b: F.least(b - a, F.lit(width)))
    return F.aggregate(new, F.lit(0).cast("long"), lambda total, n: total + n)


def features(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Counts per row, computed inside the row: (doc_id, host, n_words, ...)."""
    text = F.coalesce("text", F.lit(""))
    words = docs.select(
        "doc_id", F.col("source").alias("host"), text.alias("_text"), F.array_remove(F.split(text, SPACE), "").alias("_words")
    )
    # Hashes of single words, then of windows: a repeat of words is a repeat of both.
    hashed = words.select(
        "doc_id",
        "host",
        "_text",
        F.size("_words").cast("long").alias("n_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    last = F.size("_hashes") - width + 1
    windows = F.slice("_hashes", F.lit(1), F.greatest(last, F.lit(0)))
    for by in range(1, width):
        shifted = F.slice("_hashes", F.lit(by + 1), F.greatest(last, F.lit(0)))
        windows = F.zip_with(windows, shifted, lambda a, b: F.xxhash64(a, b))
    hashed = hashed.withColumn("_windows", windows).drop("_hashes")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(
        repeats,
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    hashed = hashed.withColumn("_placed", placed).drop("_windows")
    # Equal windows are neighbours now: both of each pair of neighbours repeat.
    pairs = F.zip_with(
        F.slice("_placed", F.lit(1), F.size("_placed") - 1),
        F.slice("_placed", F.lit(2), F.size("_placed") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    starts = F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))
    hashed = hashed.withColumn("_starts", starts).drop("_placed")
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(_without(line, SPACES)) > 0)
    hashed = hashed.withColumn("_lines", lines)
    return hashed.select(
        "doc_id",
        "host",
        "n_words",
        F.length(_without(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.col("_starts"), width), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed(least_words: int = LEAST_WORDS, percent: int = REPEATED_PERCENT) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > percent * F.col("n_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate). The prior's mean and weight come from
    the hosts' own rates: weight = m(1-m)/v - 1, held between 1 and 1e6."""
    hosts = (
        judged.where("host IS NOT NULL")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("base_failed"), 1)).alias("n_failed"))
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("_mean"), F.var_pop(rate).alias("_var"))
    weight = F.when(
        F.col("_var") > 0, F.least(F.greatest(F.col("_mean") * (1 - F.col("_mean")) / F.col("_var") - 1, F.lit(1.0)), F.lit(1e6))
    ).otherwise(F.lit(1e6))
    prior = prior.select("_mean", weight.alias("_weight"))
    shrunk = (F.col("n_failed") + F.col("_mean") * F.col("_weight")) / (F.col("n_docs") + F.col("_weight"))
    # The prior is one row, an aggregate without keys.
    return hosts.join(F.broadcast(prior)).withColumn("shrunk_rate", shrunk).drop("_mean", "_weight")


def judge(docs: DataFrame, most: float = MOST) -> DataFrame:
    """One row per row of ``docs``: its counts, ``base_failed`` and ``kept``."""
    judged = keep(features(docs).withColumn("base_failed", base_failed()))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("_part")
    rejected = host_rates(judged).where(F.col("shrunk_rate") > most).select("host", F.lit(True).alias("_rejected"), every)
    dealt = judged.withColumn("_part", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(PARTS)))
    return (
        dealt.join(rejected, ["host", "_part"], "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("_rejected").isNull())
        .drop("_rejected", "_part")
    )
