"""Operator 1: base rules, and hashed n-gram log-likelihood ratio of trusted and raw multinomials.

Only DataFrame expressions run here. One pass over the texts counts hashed n-grams of all documents
into a fixed number of buckets, one those of all trusted documents, one judges every document. Texts
are shuffled once, by id, to meet the trusted ids; besides them only bucket counts are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_prefix, table

BLANKS = " \t\n\u000b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]+"
SYMBOL_CLASS = r"[#*$%&|<>]"
PUNCTUATION = r"[!-/:-@\[-`{-~]+"


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_CLASS))


def _head(array: Column, drop: int) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - drop, F.lit(0)))


def _tail(array: Column, drop: int) -> Column:
    return F.slice(array, F.lit(drop + 1), F.greatest(F.size(array) - drop, F.lit(0)))


def _repeat_words(starts: Column) -> Column:
    """Words covered by windows of three that begin at these ascending places."""
    following = _tail(starts, 1)
    overlap = F.zip_with(_head(starts, 1), following, lambda a, b: F.greatest(F.lit(3) - (b - a), F.lit(0)))
    return (F.size(starts) * 3 - F.aggregate(overlap, F.lit(0), lambda s, x: s + x)).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null and empty texts have no words and fail. Columns of these names are replaced, all others kept.
    """
    own = free_prefix(docs)
    words, lines, hashes, placed, places = (f"{own}{n}" for n in ("words", "lines", "windows", "placed", "starts"))
    t = F.coalesce("text", F.lit(""))
    out = docs.withColumn(words, words_of(t)).withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    w = F.col(words)
    windows = F.transform(F.arrays_zip(_head(w, 2).alias("a"), _head(_tail(w, 1), 1).alias("b"), _tail(w, 2).alias("c")), lambda s: F.xxhash64(s))
    out = out.withColumn(hashes, windows)
    # places of windows whose hash another window has too: neighbours in the sorted list
    h, p = F.col(hashes), F.col(placed)
    in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(placed, F.when(F.size(F.array_distinct(h)) < F.size(h), in_order).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.zip_with(_head(p, 1), _tail(p, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    starts = F.sort_array(F.array_distinct(F.flatten(twice)))
    out = out.withColumn(places, F.when(F.size(p) > 0, starts).otherwise(F.array().cast("array<int>")))
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": (F.size(F.split(t, SYMBOL_CLASS, -1)) - 1).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(F.col(places)),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(words, lines, hashes, placed, places)


def _pieces_of(text: Column) -> Column:
    """A text's runs of ASCII punctuation and runs of anything else but blanks."""
    return words_of(F.regexp_replace(F.coalesce(text, F.lit("")), PUNCTUATION, " $0 "))


def hashed_ngrams(docs: DataFrame, buckets: int, name: str = "_grams") -> DataFrame:
    """Adds the buckets of the 1- and 2-grams of a text's pieces, as a column of this name."""
    own = free_prefix(docs) + "pieces"
    pieces = F.col(own)
    pairs = F.arrays_zip(_head(pieces, 1).alias("a"), _tail(pieces, 1).alias("b"))
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")
    # pieces are a column of their own, so that the splitting isn't repeated for each use
    return docs.withColumn(own, _pieces_of(F.col("text"))).withColumn(name, F.concat(F.transform(pieces, slot), F.transform(pairs, slot))).drop(own)


def ngram_ratios(docs: DataFrame, trusted: DataFrame, buckets: int) -> list[float]:
    """log(p_trusted / p_raw) of each bucket. trusted: any number of doc_ids.

    Raw counts cover all documents and trusted counts all of trusted's; the trusted multinomial is drawn towards the raw one by as many
    pseudo-counts as there are buckets, so without trusted documents every ratio is 0. Collected:
    one row per bucket.
    """
    pieces = F.col("_pieces")
    slot = lambda *x: F.pmod(F.xxhash64(*x), F.lit(buckets)).cast("int")
    # the last piece has no pair
    both = F.when(F.col("b").isNull(), F.array(slot("a"))).otherwise(F.array(slot("a"), slot(F.struct("a", "b"))))

    # the ids grow with the input, so they are dealt with the texts and not broadcast; null ids meet nothing
    texts = docs.select("doc_id", "text")
    good = trusted.select("doc_id").distinct().withColumn("good", F.lit(1)).hint("shuffle_hash")
    marked = texts.where("doc_id is not null").join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))
    marked = marked.unionByName(texts.where("doc_id is null").select("text", F.lit(0).alias("good")))
    rows = marked.select("good", _pieces_of(F.col("text")).alias("_pieces")).select("good", F.inline(F.arrays_zip(pieces.alias("a"), _tail(pieces, 1).alias("b"))))
    rows = rows.select("good", F.explode(both).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()
    n_raw, n_good = sum(r["raw"] for r in rows), sum(r["good"] for r in rows)
    ratios = [0.0] * buckets
    for r in rows:
        p_raw = r["raw"] / n_raw
        ratios[r["bucket"]] = round(math.log((r["good"] + buckets * p_raw) / (n_good + buckets) / p_raw), 4)
    return ratios


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = 8192, threshold: float = -0.25) -> DataFrame:
    """docs plus the base counts, base_failed, llr (double) and kept (boolean).

    llr is the mean log-ratio of a document's hashed n-grams, 0 without any; a document is kept if
    the base rules pass and llr >= threshold, so a tie with it is kept. Null doc_ids are judged as
    others but never trusted; repeated rows are judged alike, very long texts whole. Other columns pass
    through, but for those of the names added here. Empty tables give no rows, and without trusted
    documents every llr is 0.
    """
    ratios = ngram_ratios(docs, trusted, buckets)
    lookup = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to a constant
    own = free_prefix(docs) + "grams"
    out = hashed_ngrams(base_rules(docs), buckets, own)
    grams = F.col(own)
    total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(lookup, b))
    out = out.withColumn("llr", F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))).drop(own)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def keep(judged: DataFrame) -> DataFrame:
    """The rows that quality_rules keeps.

    The filter also reads a row number. It is always true, but keeps the optimizer from moving the
    filter below the projections, where their expressions would be written out many times over.
    """
    row = free_prefix(judged) + "row"
    return judged.withColumn(row, F.monotonically_increasing_id()).where(F.col("kept") & (F.col(row) >= 0)).drop(row)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids labelled as good; an id whose labels disagree isn't."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules(docs, trusted_ids(table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go.

    Null and empty texts fail the base rules, so they go. Rows with a null id and repeated rows are judged
    by their texts as all others; other columns may be null. An empty table stays empty.
    """
    trusted = trusted_ids(table(spark, sf_dir, "labels"))
    judged = quality_rules(docs.select("doc_id", "text", "lang", "source", "n_chars"), trusted)
    return keep(judged).select("doc_id", "text", "lang", "source", "n_chars")


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES: dict[str, str] = {}
