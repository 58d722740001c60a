"""Model work: summaries, MAP and REDUCE, with a callable for batches of text or an extractive default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castflow.functions.storage import Staged, stored
from castflow.functions.text import first_sentence, tokens
from castflow.schemas import KEY

Model = Callable[[list[str]], list[str]]

#: Errors of the service, not of a text: the batch isn't asked again in parts.
SERVICE_ERRORS = (ConnectionError, TimeoutError)


def answers(model: Model, texts: list[str]) -> list[tuple[str | None, str]]:
    """(result, status) for each text.  A batch that fails is asked again in halves until the bad text stands alone.

    A batch of n with one bad text takes at most 1 + 2 * log2(n) calls, rounded up; with b bad ones b times as many at most.
    """
    try:
        found = list(model(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        if odd := [x for x in found if not isinstance(x, str)]:
            raise TypeError(f"{type(odd[0]).__name__} for a text")
        return [(x, "ok") for x in found]
    except Exception as e:  # noqa: BLE001  whatever the model raises
        if len(texts) == 1 or isinstance(e, SERVICE_ERRORS):
            return [(None, f"{type(e).__name__}: {e}"[:500])] * len(texts)
    half = len(texts) // 2
    return answers(model, texts[:half]) + answers(model, texts[half:])


def _bounded(texts: list[str], most_items: int, most_chars: int) -> Iterator[list[str]]:
    """The texts in batches of at most so many items and characters; a longer text is alone."""
    batch, size = [], 0
    for text in texts:
        if batch and (len(batch) >= most_items or size + len(text) > most_chars):
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


def apply_model(df: DataFrame, column: str, model: Model, out: str = "summary", concurrency: int | None = None, most_items: int = 100, most_chars: int = 200_000) -> DataFrame:
    """df with the model's text for each row and its status, ``ok`` or the error that the row's own text causes.

    The model is called with at most most_items texts of at most most_chars characters together.  A failing batch is halved until the bad texts stand
    alone (``answers``), so they don't take their neighbours with them.  Errors are results, not failures: the rows go to the retry list.  The
    concurrency bounds the tasks that call at once.  A null text is asked as the empty one.  Write the result before it is used
    twice, and keep speculation off, or the model is called again.
    """
    df = df.repartition(concurrency) if concurrency else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string, status string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if t is not None else "" for t in batch[column]]
            found = [x for some in _bounded(texts, most_items, most_chars) for x in answers(model, some)]
            yield batch.assign(**{out: [x for x, _ in found], "status": [s for _, s in found]})

    return df.mapInPandas(run, schema)


def summarize(episodes: DataFrame, model: Model | None = None, concurrency: int | None = None) -> DataFrame:
    """(feed_id, episode_id, summary, status): one sentence for each episode from its description."""
    rows = episodes.select(*KEY, "description")
    if model:
        return apply_model(rows, "description", model, concurrency=concurrency).drop("description")
    return rows.select(*KEY, first_sentence("description").alias("summary"), F.lit("ok").alias("status"))


def map_chunks(chunks: DataFrame, model: Model | None = None, concurrency: int | None = 4, attempt: int = 1) -> DataFrame:
    """CHUNK_RESULTS: a summary for each chunk on its own. The chunks of an episode are spread over tasks."""
    rows = chunks.select(*KEY, "chunk_no", "text")
    out = apply_model(rows, "text", model, concurrency=concurrency) if model else rows.withColumn("summary", first_sentence("text")).withColumn("status", F.lit("ok"))
    return out.select(*KEY, "chunk_no", F.lit(attempt).alias("attempt"), "status", "summary")


def _good(results: DataFrame) -> DataFrame:
    """The latest good summary of each chunk."""
    return results.where("status = 'ok'").groupBy(*KEY, "chunk_no").agg(F.max_by("summary", "attempt").alias("summary"))


def reduce_chunks(chunks: DataFrame, results: DataFrame, model: Model | None = None, concurrency: int | None = None) -> DataFrame:
    """(feed_id, episode_id, n_chunks, document, status): summaries in order, blank lines between them.

    Only episodes all of whose chunks have a good result are given.  The model gets the joined summaries, once
    an episode; where they may be longer than it can read, use ``reduce_levels``.  Only summaries are gathered, never chunk texts.
    """
    want = chunks.groupBy(*KEY).agg(F.count_distinct("chunk_no").alias("n_chunks"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", F.coalesce("summary", F.lit("")).alias("s"))))
    have = _good(results).groupBy(*KEY).agg(F.count("*").alias("n_ok"), F.array_join(F.transform(ordered, lambda x: x["s"]), "\n\n").alias("document"))
    out = want.join(have, KEY).where("n_ok = n_chunks").select(*KEY, "n_chunks", "document")
    if model:
        return apply_model(out, "document", model, "reduced", concurrency).drop("document").withColumnRenamed("reduced", "document")
    return out.withColumn("status", F.lit("ok"))


# --- reduction by levels --------------------------------------------------------------------------

LEVEL = "feed_id string, episode_id string, group_no int, input long, status string, summary string"


def _groups(items: DataFrame, budget: int) -> DataFrame:
    """(feed_id, episode_id, was, group_no, n_groups, n_tokens, text, input): neighbours of items(.., no, text, was) joined within the budget.

    What fits in one budget is one group.  Else items of more than a quarter of it are cut at tokens, and a group takes the pieces that begin in one window of
    three quarters, counted from the episode's start: no piece waits for the one before, and no group holds more than the budget.
    """
    part = max(1, budget // 4)
    window = max(1, budget - part)
    cut = items.select(*KEY, "was", "no", tokens(F.coalesce("text", F.lit(""))).alias("_t"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_t") - 1, F.lit(0)), F.lit(part))
    pieces = F.posexplode(F.transform(starts, lambda s: F.slice("_t", s + 1, part))).alias("piece", "_p")
    rows = cut.select(*KEY, "was", "no", pieces).select(*KEY, "was", "no", "piece", F.array_join("_p", "").alias("text"), F.size("_p").cast("long").alias("n"))
    of = Window.partitionBy(*KEY)
    order = of.orderBy("no", "piece")
    # empty items add nothing; the first stays, so that an episode without a word has a group
    rows = rows.withColumn("_first", F.row_number().over(order)).where("n > 0 or _first = 1")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_k", F.when(F.sum("n").over(of) <= budget, F.lit(0)).otherwise(F.floor(before / window))).withColumn("group_no", F.dense_rank().over(of.orderBy("_k")) - 1)
    ordered = F.array_sort(F.collect_list(F.struct("no", "piece", "text")))
    joined = F.array_join(F.transform(ordered, lambda x, i: F.concat(F.when((i > 0) & (x["piece"] == 0), "\n\n").otherwise(""), x["text"])), "")
    groups = rows.groupBy(*KEY, "group_no").agg(F.max("was").alias("was"), F.sum("n").alias("n_tokens"), joined.alias("text"))
    return groups.withColumn("n_groups", F.count("*").over(of)).withColumn("input", F.xxhash64("text"))


def reduce_levels(chunks: DataFrame, results: DataFrame, budget: int, path: str, model: Model | None = None, concurrency: int | None = None) -> DataFrame:
    """(feed_id, episode_id, n_chunks, n_levels, document, status): chunk summaries reduced level by level, no call over ``budget`` tokens.

    Neighbouring summaries are joined within the budget and summarised; the results are the next level's summaries, until an episode has one group, whose
    summary is its document.  Each level is written under ``path``/level=n as it comes: a run that is broken off or repeated calls the
    model only for groups without a good result for the same text.  Episodes all of whose chunks are good are given, those with a failed
    group with status ``waiting`` and no document; run again to retry these groups.  A level that leaves an episode no fewer groups than the one before gives
    the status ``not shorter``.  Without a model a group's first sentence stands for it.
    """
    spark, path = chunks.sparkSession, path.rstrip("/")
    want = chunks.groupBy(*KEY).agg(F.count_distinct("chunk_no").alias("n_chunks"))
    good = _good(results).join(chunks.select(*KEY, "chunk_no").distinct(), [*KEY, "chunk_no"], "left_semi")
    whole = good.groupBy(*KEY).agg(F.count("*").alias("n_ok")).join(want, KEY).where("n_ok = n_chunks").select(*KEY, "n_chunks")
    finals = spark.createDataFrame([], "feed_id string, episode_id string, n_levels int, document string, status string")
    with Staged(spark) as staged:
        whole = staged.save(whole, "reduce-episodes")
        items = good.join(whole, KEY).select(*KEY, F.col("chunk_no").alias("no"), F.col("summary").alias("text"), F.lit(None).cast("long").alias("was"))
        level, more = 0, True
        while more:
            level += 1
            store = f"{path}/level={level}"
            groups = staged.save(_groups(items, budget), "reduce-groups")
            stuck = groups.where("n_groups >= was").select(*KEY).distinct()
            asked = groups.where("was is null or n_groups < was")
            same = [*KEY, "group_no", "input"]
            todo = asked.join(stored(spark, "parquet", LEVEL, store).where("status = 'ok'").select(*same).distinct(), same, "left_anti").select(*same, "text")
            if todo.take(1):
                made = apply_model(todo, "text", model, concurrency=concurrency) if model else todo.withColumn("summary", first_sentence("text")).withColumn("status", F.lit("ok"))
                made.select(*[c.split()[0] for c in LEVEL.split(", ")]).write.mode("append").parquet(store)
            have = stored(spark, "parquet", LEVEL, store).where("status = 'ok'").groupBy(*same).agg(F.min("summary").alias("summary"))
            done = staged.save(asked.join(have, same).withColumn("_ok", F.count("*").over(Window.partitionBy(*KEY))), "reduce-done")
            ready = done.where("_ok = n_groups")
            last = ready.where("n_groups = 1").select(*KEY, F.lit(level).alias("n_levels"), F.col("summary").alias("document"), F.lit("ok").alias("status"))
            failed = asked.select(*KEY).distinct().join(ready.select(*KEY).distinct(), KEY, "left_anti").withColumn("status", F.lit("waiting"))
            failed = failed.unionByName(stuck.withColumn("status", F.lit("not shorter"))).withColumn("n_levels", F.lit(level))
            finals = finals.unionByName(last).unionByName(failed, allowMissingColumns=True)
            items = ready.where("n_groups > 1").select(*KEY, F.col("group_no").alias("no"), F.col("summary").alias("text"), F.col("n_groups").alias("was"))
            more = bool(items.take(1))
        out = f"{path}/documents"
        whole.join(finals, KEY).select(*KEY, "n_chunks", "n_levels", "document", "status").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
