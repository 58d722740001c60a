"""Quality rules: base statistics of each text, and lines that too many documents of a host share.

DataFrame functions only.  Lines are normalised (lower case, runs of white space and of digits made one
blank or 0) and hashed; a document counts once for a line.  A line goes from all documents but the first that holds it (smallest
doc_id), if more than ``max_docs`` documents of the host hold it, and more than ``max_share`` of them: a line that a
thousandth of a large host shares is no template yet.  A document is rejected as depleted if
the lines that stay hold less than ``min_left`` of its words; so of a page copied beyond the limits the first stays.
Only counts for each host, line and document are shuffled, and hot lines are summed before they are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castflow.llm import common as C

#: Words are runs of what is not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\u000b\f\r"


def base_statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """docs(doc_id, source, text) with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    A null text has no words.  Windows of words are compared by a 64-bit hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_text", text)
    out = out.withColumn("_words", F.transform(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    word_at = lambda i: [F.get(F.col("_words"), i + j) for j in range(window)]
    out = out.withColumn("_windows", F.when(F.col("n_words") >= window, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - window), lambda i: F.xxhash64(*word_at(i)))).otherwise(F.array().cast("array<bigint>")))
    # only texts with a window that comes back are sorted; the rest have none
    out = out.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, j: (F.get("_sorted", j - 1)["h"] == e["h"]) | (F.get("_sorted", j + 1)["h"] == e["h"])
    out = out.withColumn("_places", F.array_sort(F.transform(F.filter("_sorted", lambda e, j: F.coalesce(same(e, j), F.when(j == 0, F.get("_sorted", j + 1)["h"] == e["h"]).otherwise(F.get("_sorted", j - 1)["h"] == e["h"]))), lambda e: e["i"])))
    covered = F.aggregate(F.transform("_places", lambda p, j: F.least(F.lit(window), F.coalesce(F.get("_places", j + 1), p + window) - p)), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    out = out.withColumn("_lines", lines)
    return out.select(
        *docs.columns,
        "n_words",
        F.length(F.translate("_text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed(min_words: int = 20, max_repeat: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, host, pos, line_hash, words) of every line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select("doc_id", _host(), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    each = each.where(F.col("line").rlike(WORD))
    return each.select("doc_id", "host", "pos", F.xxhash64(normal_line(F.col("line"))).alias("line_hash"), F.size(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("words"))


def boilerplate(docs: DataFrame, max_docs: int = 30, max_share: float = 0.001) -> DataFrame:
    """(host, line_hash, n_docs, first_doc): lines above both limits, and the document that keeps its copy."""
    return _above(lines(docs), docs, max_docs, max_share)


def _above(each: DataFrame, docs: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    per = each.where("doc_id is not null").groupBy("host", "line_hash", "doc_id").agg(F.lit(1)).groupBy("host", "line_hash")
    counts = per.agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    hosts = docs.select(_host(), "doc_id").where("doc_id is not null").groupBy("host", "doc_id").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("host_docs"))
    often = counts.where(F.col("n_docs") > max_docs).join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs"))
    return often.select("host", "line_hash", "n_docs", "first_doc")


def removed_lines(docs: DataFrame, max_docs: int = 30, max_share: float = 0.001) -> DataFrame:
    """(doc_id, host, pos, words) of each line that goes; the document that holds it first keeps it.  Written once."""
    with C.Scratch(docs.sparkSession) as held:
        each = held.save(lines(docs), "lines")  # lines are cut and hashed once, then counted and joined back
        often = held.save(_above(each, docs, max_docs, max_share), "often")  # its size is known then
        return C.save(each.join(often, ["host", "line_hash"]).where(F.col("doc_id") != F.col("first_doc")).select("doc_id", "host", "pos", "words"), "removed")


def judge(docs: DataFrame, max_docs: int = 30, max_share: float = 0.001, min_left: float = 0.2) -> DataFrame:
    """docs(doc_id, source, text, ...) with the base statistics, base_failed, removed_words, removed_lines and kept.

    Null and empty texts have no words and fail the base rules.  A null source is the host ''.  A null doc_id
    has no removed lines.  Rows that repeat a doc_id are one document to the line rule: each counts the words removed from all.
    """
    return _judged(docs, removed_lines(docs, max_docs, max_share), min_left)


def _judged(docs: DataFrame, removed: DataFrame, min_left: float) -> DataFrame:
    # written, as a filter on these columns would be pushed below them and evaluate the window search for each element
    base = C.save(base_statistics(docs.select("doc_id", "text")).drop("text"), "base").withColumn("base_failed", base_failed())
    gone = removed.groupBy("doc_id").agg(F.sum("words").cast("long").alias("removed_words"), F.count("*").alias("removed_lines"))
    out = base.join(gone, "doc_id", "left").fillna(0, ["removed_words", "removed_lines"])
    depleted = F.col("n_words") - F.col("removed_words") < min_left * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, max_docs: int = 30, max_share: float = 0.001, min_left: float = 0.2) -> DataFrame:
    """The documents that are kept, without the lines above the limits; all columns stay."""
    removed = removed_lines(docs, max_docs, max_share)
    verdict = _judged(docs, removed, min_left).select("doc_id", "kept")
    places = removed.groupBy("doc_id").agg(F.collect_set("pos").alias("_gone"))
    out = docs.join(verdict.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").join(places, "doc_id", "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)
