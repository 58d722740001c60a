"""Notes: templates, sections, corrections and search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castflow.functions.text import words
from castflow.schemas import KEY


#: The most (word, template) pairs that are sent to the tasks; of more templates than that, words are joined.
MOST_PAIRS = 1_000_000
#: Counters that a task holds at once.
COUNTERS = 1 << 22


def _joined_scores(of_text: DataFrame, of_template: DataFrame) -> DataFrame:
    """Shared words by a join: for template tables of any size."""
    rows = of_text.select(*KEY, F.explode("words").alias("word"))
    return rows.join(of_template, "word").groupBy(*KEY, "template_id").agg(F.count("*").alias("score"))


def _counted_scores(of_text: DataFrame, pairs: pa.Table) -> DataFrame:
    """(feed_id, episode_id, template_id, score): each transcript's best template, where it shares a word with one.

    The words of a batch become numbers of the templates' words at once, each number adds one to the counters of the templates that hold it; rows
    stay one for each transcript, and nothing is shuffled.
    """
    ids = np.array(sorted(set(pairs.column("template_id").to_pylist())), object)
    known = pc.unique(pairs.column("word").combine_chunks())
    word = pc.index_in(pairs.column("word"), value_set=known).to_numpy()
    template = np.searchsorted(ids, np.array(pairs.column("template_id").to_pylist(), object))
    order = np.argsort(word, kind="stable")
    holders, n = template[order], np.bincount(word, minlength=len(known))
    first = np.cumsum(n) - n
    step = max(1, COUNTERS // len(ids))

    def best(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        place = pc.index_in(words.flatten(), value_set=known)
        row = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
        row, place = row[hit], place.drop_null().to_numpy()
        count = n[place]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[place], count)
        counters = np.bincount(np.repeat(row, count) * len(ids) + holders[at], minlength=len(words) * len(ids)).reshape(len(words), len(ids))
        return counters.argmax(axis=1), counters.max(axis=1)  # the first of equal ones: the lowest id

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                which, score = best(some.column("words"))
                found = pa.record_batch([some.column(0), some.column(1), pa.array(ids[which], pa.string()), pa.array(score.astype(np.int64))], [*KEY, "template_id", "score"])
                yield found.filter(pa.array(score > 0))

    return of_text.mapInArrow(run, "feed_id string, episode_id string, template_id string, score long")


def pick_template(transcripts: DataFrame, templates: DataFrame, scorer: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(feed_id, episode_id, template_id, score): the best template for each transcript, ties by template id.

    The default score counts the distinct words that a transcript shares with style and description; words of
    all templates don't tell them apart, but count.  A transcript without a match gets the lowest id and score 0.
    scorer(transcripts, templates) gives (feed_id, episode_id, template_id, score) instead.  The templates' words are read when this is called: up to MOST_PAIRS
    of them go to the tasks, which then count without a shuffle; more are joined.
    """
    if scorer:
        scores = scorer(transcripts, templates)
    else:
        of_template = templates.select("template_id", F.explode(words(F.concat_ws(" ", "style", "description"))).alias("word"))
        of_text = transcripts.select(*KEY, words(F.coalesce("text", F.lit(""))).alias("words"))
        pairs = of_template.limit(MOST_PAIRS + 1).toArrow()
        scores = _joined_scores(of_text, of_template) if pairs.num_rows > MOST_PAIRS or not pairs.num_rows else _counted_scores(of_text, pairs)
    best = scores.groupBy(*KEY).agg(F.min(F.struct((-F.col("score")).alias("minus"), "template_id")).alias("b"))
    lowest = F.broadcast(templates.agg(F.min("template_id").alias("_lowest")))  # one row
    out = transcripts.select(*KEY).distinct().join(best, KEY, "left").join(lowest)
    return out.select(*KEY, F.coalesce("b.template_id", "_lowest").alias("template_id"), F.coalesce(-F.col("b.minus"), F.lit(0)).cast("long").alias("score"))


def build_notes(content: DataFrame, templates: DataFrame) -> DataFrame:
    """NOTES of content(feed_id, episode_id, template_id, mode, title, text): a heading for each required section.

    The text stands in the first section; the others are left for the model or the reader.
    """
    sections = F.transform("required_sections", lambda s, i: F.concat(F.lit("## "), s, F.when(i == 0, F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise("")))
    markdown = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.array_join(sections, "\n"))
    return content.join(templates.select("template_id", "required_sections"), "template_id").select(*KEY, "template_id", "mode", markdown.alias("markdown"))


def _headings(markdown: Column) -> Column:
    return F.transform(F.regexp_extract_all(markdown, F.lit(r"(?m)^## (.*)$"), F.lit(1)), lambda x: F.trim(x))


def missing_sections(notes: DataFrame, templates: DataFrame) -> DataFrame:
    """(feed_id, episode_id, section): required sections without a heading in the note."""
    need = notes.join(templates.select("template_id", "required_sections"), "template_id")
    return need.select(*KEY, F.explode(F.array_except("required_sections", _headings(F.coalesce("markdown", F.lit(""))))).alias("section"))


def note_sections(notes: DataFrame) -> DataFrame:
    """(feed_id, episode_id, section, ord, line): the lines under each heading, headings themselves left out.

    Lines before the first heading have no section.
    """
    lines = notes.select(*KEY, F.posexplode(F.split("markdown", "\r?\n")).alias("ord", "line"))
    heading = F.when(F.col("line").rlike("^## "), F.trim(F.substring("line", 4, 1_000_000)))
    w = Window.partitionBy(*KEY).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, True).over(w)).where(~F.col("line").rlike("^#{1,2} ")).select(*KEY, "section", "ord", "line")


def _with_corrections(transcripts: DataFrame, corrections: DataFrame) -> DataFrame:
    """With the pairs of each transcript, the longest first.  A correction without a wrong word fails the job when it runs."""
    wrong = F.when(F.coalesce("wrong", F.lit("")) == "", F.raise_error(F.lit("a correction needs a wrong word"))).otherwise(F.col("wrong"))
    corrections = corrections.withColumn("wrong", wrong)
    pairs = F.array_sort(F.collect_set(F.struct((-F.length("wrong")).alias("o"), F.col("wrong").alias("w"), F.coalesce("right", F.lit("")).alias("r"))))
    return transcripts.join(corrections.groupBy(*KEY).agg(pairs.alias("_c")), KEY, "left")


def apply_corrections(transcripts: DataFrame, corrections: DataFrame) -> DataFrame:
    """transcripts with all wrong words replaced, the longest first, then by text; in one pass over the pairs."""
    out = _with_corrections(transcripts, corrections)
    text = F.aggregate(F.coalesce("_c", F.array().cast("array<struct<o:int,w:string,r:string>>")), F.col("text"), lambda t, c: F.replace(t, c["w"], c["r"]))
    out = out.withColumn("text", text).drop("_c")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def correction_report(transcripts: DataFrame, corrections: DataFrame) -> DataFrame:
    """(feed_id, episode_id, wrong, right, hits): what was replaced, counted in the text as it was just before."""
    zero = F.struct(F.col("text").alias("t"), F.array().cast("array<struct<wrong:string,right:string,hits:bigint>>").alias("done"))

    def step(state, c):
        without = F.replace(state["t"], c["w"], F.lit(""))
        hits = F.floor((F.length(state["t"]) - F.length(without)) / F.length(c["w"])).cast("long")
        return F.struct(F.replace(state["t"], c["w"], c["r"]).alias("t"), F.concat(state["done"], F.array(F.struct(c["w"].alias("wrong"), c["r"].alias("right"), hits.alias("hits")))).alias("done"))

    rows = _with_corrections(transcripts, corrections).where("_c is not null and text is not null")
    return rows.select(*KEY, F.explode(F.aggregate("_c", zero, step, lambda s: s["done"])).alias("d")).select(*KEY, "d.*").where("hits > 0")


#: Parts in which the queries of a word are gathered.
QUERY_PARTS = 16


def search_notes(notes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, feed_id, episode_id, hits, rank): the k notes with most distinct words of each query(query_id, text).

    Queries that ask the same word are one row of it, so a note's words are filtered by the asked ones before they meet the
    queries, and a common word is dealt by word and note, never by word alone.
    """
    asked = queries.select("query_id", F.explode(words("text")).alias("word"))
    by_word = asked.groupBy(F.col("word"), F.pmod(F.xxhash64("query_id"), F.lit(QUERY_PARTS)).alias("part")).agg(F.collect_set("query_id").alias("_asked"))
    held = notes.select(*KEY, F.explode(words("markdown")).alias("word"))
    hits = held.join(by_word, "word").select(*KEY, F.explode("_asked").alias("query_id")).groupBy("query_id", *KEY).agg(F.count("*").alias("hits"))
    w = Window.partitionBy("query_id").orderBy(F.desc("hits"), *KEY)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
