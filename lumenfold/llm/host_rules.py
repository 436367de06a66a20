"""Quality rules by host: failures of each rule by host, shrunk with an empirical beta prior, decide about hosts.

Everything is built-in functions.  A text is measured where it is read; only a few numbers of each document go on.

* Measures of a document come from arrays of its own words.  Windows of eight words are hashes of hashes (two, four,
  eight words), so a text of n words takes n log n whatever it repeats; windows count as equal when their 64-bit
  hashes are, within one text.
* Failures are summed by host (combined before the shuffle, so a hot host costs one row a task), and a rule's rates
  over all hosts, weighted by their documents, give a beta prior by their moments.  A host fails a rule when its shrunk rate passes ``LIMIT``: a
  host of few documents stays near the rate of all, a large one near its own.
* Hosts that fail join back to the documents; they are broadcast when few, and shuffled else.

Defined cases: a null text has no words and fails; a null host is a host of its own; repeated rows count one by one
and come out one by one; an empty table gives no rows; further columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import small, stage, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A host fails a rule when more than half of its documents do, after shrinking.
LIMIT = 0.5
#: Bounds of the prior's weight in documents, for rates that differ more than any prior allows, or not at all.
LEAST, MOST = 2.0, 1e6


def rules(m: Column) -> dict[str, Column]:
    """The rules of a document with measures ``m``; true where it fails."""
    return {
        "few_words": m.n_words < 20,
        "repeats": 100 * m.n_repeat_words > 30 * m.n_words,
        "symbols": 10 * m.n_symbols > m.n_words,
        "duplicate_lines": 100 * m.n_dup_lines > 30 * m.n_lines,
        "short_words": m.word_chars < 2 * m.n_words,
    }


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _pairs(hashes: Column, apart: int) -> Column:
    """Hashes of windows twice as long, from those that start ``apart`` words later."""
    return F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - apart, F.lit(0))), F.slice(hashes, 1 + apart, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """Rows (row: the named columns of a row of ``docs``, m: its measures)."""
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    df = df.withColumn("words", F.regexp_extract_all("t", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    df = df.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.translate(x, SPACES, "") != ""))
    plain = [
        F.size("words").cast("long").alias("n_words"), _without(F.col("t"), SPACES).cast("long").alias("word_chars"),
        (F.length("t") - _without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ]
    df = df.select("row", *plain, F.transform("words", lambda w: F.xxhash64(w)).alias("w1"))
    for apart in (1, 2, 4):
        df = df.withColumn(f"w{2 * apart}", _pairs(F.col(f"w{apart}"), apart)).drop(f"w{apart}")
    # windows in order of hash and place; nothing to sort where all differ
    same = F.size(F.array_distinct("w8")) == F.size("w8")
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("sorted", F.when(same, nothing).otherwise(F.array_sort(F.transform("w8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("w8")
    n = F.size("sorted")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(F.col("sorted.h"), 1, F.greatest(n - 1, F.lit(0))))
    df = df.withColumn("near", F.arrays_zip(F.col("sorted"), before.alias("before"), F.slice(F.col("sorted.h"), 2, n).alias("after")))
    twice = F.filter("near", lambda x: (x["sorted"]["h"] == x["before"]) | (x["sorted"]["h"] == x["after"]))
    df = df.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["sorted"]["i"])))
    covered = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda x, y: x + y))
    return df.select("row", F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines").alias("m"))


def host_rates(rows: DataFrame) -> DataFrame:
    """Rows (host, rule, n, n_failed, rate, shrunk) of documents (host, failed: one boolean a rule)."""
    names = rows.schema["failed"].dataType.names
    sums = rows.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"failed.{r}").cast("long")).alias(r) for r in names))
    by_rule = sums.select("host", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_failed")) for r in names))).alias("of")).select("host", "n", "of.rule", "of.n_failed")
    by_rule = by_rule.withColumn("rate", F.col("n_failed") / F.col("n"))
    mean, spread = F.col("mean"), F.col("spread")
    whole = F.sum("n").cast("double")
    moments = by_rule.groupBy("rule").agg((F.sum("n_failed") / whole).alias("mean"), (F.sum(F.col("n") * F.col("rate") * F.col("rate")) / whole).alias("square"), (F.count("*") / whole).alias("noise"))
    # what the hosts differ by, beyond the chance of their own numbers of documents
    prior = moments.withColumn("spread", F.col("square") - mean * mean - mean * (1 - mean) * F.col("noise"))
    weight = F.when(spread > 0, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), mean * (1 - mean) / spread - 1))).otherwise(MOST)
    prior = prior.select("rule", "mean", weight.alias("weight"))  # one row a rule
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    return by_rule.join(F.broadcast(prior), "rule").select("host", "rule", "n", "n_failed", "rate", shrunk.alias("shrunk"))


def judged(docs: DataFrame, columns: list[str] | None = None, host: str = "source", limit: float = LIMIT) -> DataFrame:
    """Rows (row: the named columns of a row of ``docs``, all if none are named, m: its measures, base_failed,
    host_failed, kept); ``host`` is one of the columns."""
    base = lambda f: f["few_words"] | f["repeats"]
    rows = measured(docs, columns or docs.columns)
    rows = rows.withColumn("failed", F.struct(*(c.alias(r) for r, c in rules(F.col("m")).items()))).withColumn("host", F.col("row").getField(host))
    rows = stage(rows, "host-rules")
    bad = stage(host_rates(rows).where(F.col("shrunk") > limit).select("host").distinct(), "bad-hosts")
    bad = small(bad.select(F.col("host").alias("bad_host"), F.lit(True).alias("bad")))
    rows = rows.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    rows = rows.select("row", "m", base(F.col("failed")).alias("base_failed"), F.coalesce("bad", F.lit(False)).alias("host_failed"))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, as they are."""
    return judged(docs).where("kept").select("row.*")


# --------------------------------------------------------------------------- query


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all ``documents`` and the verdict about each."""
    docs = table(spark, sf_dir, "documents")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(docs, ["doc_id", "source"]).select("row.doc_id", *(f"m.{c}" for c in names), "base_failed", "kept")
