"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, SPACES, text_of

#: Cells of either multinomial; n-grams are hashed into them, so both stay this small at any input size.
BUCKETS = 1 << 18
#: Pseudo-count of a cell in either multinomial, dealt to the target in its share of all n-grams: a ratio starts from nothing
#: and grows with the evidence, however many cells there are and however small the corpus is.
SMOOTHING = 10.0
#: A document is rejected when its mean log ratio per n-gram is below this.
THRESHOLD = -0.25
#: The target is learned from at most about so many labelled documents, chosen by a hash of doc_id beyond that.
TRUSTED_ROWS = 400_000
MIN_WORDS = 50
SYMBOLS = "[#*$%&|<>]"
#: Log ratios are kept as integers of 1 / SCALE, so that sums do not depend on their order.
SCALE = 10_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _with_ngrams(rows: DataFrame) -> DataFrame:
    """Adds __g, the cells of a text's n-grams: its words and its pairs of neighbouring words, whole."""
    n = F.size("__w")
    pairs = F.transform(F.slice("__w", 2, F.greatest(n - 1, F.lit(0))), lambda w, i: _bucket(F.get("__w", i), w))
    return rows.withColumn("__g", F.concat(F.transform("__w", lambda w: _bucket(w)), pairs))


def trusted_ids(labels: DataFrame, bound: int = TRUSTED_ROWS) -> DataFrame:
    """(__id): documents labelled of good quality and not toxic, at most about `bound` of them; proven small, as counted here."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    share = min(1.0, bound / max(1, good.count()))
    return good if share == 1.0 else good.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[int]:
    """SCALE * log(p_target / p_raw) of each cell, over the n-grams of all documents; zeros where nothing is trusted."""
    good = F.broadcast(trusted_ids(labels))  # at most about TRUSTED_ROWS ids
    rows = docs.select("doc_id", text_of().alias("text")).join(good, F.col("doc_id") == F.col("__id"), "left")
    rows = _with_ngrams(rows.select(F.col("__id").isNotNull().cast("long").alias("good"), _words(F.col("text")).alias("__w")))
    # The outer form: the plain one would infer a filter on the array and push copies of its expressions into it.
    counts = rows.select("good", F.explode_outer("__g").alias("g")).where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # at most BUCKETS rows
        raw[r["g"]], target[r["g"]] = r["raw"], r["target"]
    if not sum(target):
        return [0] * BUCKETS
    share = sum(target) / sum(raw)
    return [round(SCALE * math.log((t + SMOOTHING * share) / (share * (r + SMOOTHING)))) if r else 0 for r, t in zip(raw, target, strict=True)]


def base_features(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with `text` and the words `__w`."""
    n = F.size("__w")
    windows = F.when(n >= 3, F.transform(F.slice("__w", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)).alias("h"), i.alias("i"))))
    # Windows meet their equals by sorting 64-bit hashes within one text.
    rows = rows.withColumn("__s", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))))
    same = lambda a, b: F.coalesce(F.get("__s", a)["h"] == F.get("__s", b)["h"], F.lit(False))
    twice = F.filter("__s", lambda x, k: same(k, k - 1) | same(k, k + 1))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NON_SPACE))
    rows = rows.withColumn("__l", lines).withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("__s", "__l")


def _judged(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Each row of docs as the struct `__row`, with the base features, llr and kept beside it."""
    table = ",".join(map(str, log_ratios(docs, labels)))
    ratios = F.split(F.lit(table), ",").cast("array<int>")  # folded to one literal of BUCKETS numbers
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), text_of().alias("text"))
    rows = _with_ngrams(base_features(rows.withColumn("__w", _words(F.col("text")))).drop("text"))
    total = F.aggregate("__g", F.lit(0).cast("long"), lambda a, g: a + F.get(ratios, g))
    llr = F.coalesce(total / F.nullif(F.size("__g"), F.lit(0)), F.lit(0.0)) / SCALE
    rows = rows.withColumn("llr", F.round(llr, 6)).drop("__g", "__w")
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    # A filter on a result stays above this generator, which gives one row each; below it, it would be a copy of all that the
    # result is computed from. The outer form, as the plain one would infer such a filter itself.
    return rows.select("__row", F.explode_outer(F.array(F.struct(*FEATURES))).alias("__f")).select("__row", "__f.*")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    llr is the text's sum of log ratios over its number of n-grams; a text without words has llr 0 and fails the base
    rules. Null texts count as empty. Repeated rows get equal decisions. Without trusted labels all ratios are 0. Only
    doc_id and text are read.
    """
    rows = _judged(docs.select("doc_id", "text"), labels, threshold)
    return rows.select(F.col("__row.doc_id").alias("doc_id"), *FEATURES)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; decided row by row, without a join."""
    return _judged(docs, labels, threshold).where("kept").select("__row.*")
