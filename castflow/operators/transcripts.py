"""Segments to transcripts: completeness, assembly, length routes and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castflow.functions.text import tokens
from castflow.schemas import KEY

#: Characters from which a transcript goes by map-reduce.
THRESHOLD = 50_000


def check_duration(segments: DataFrame, audio: DataFrame, min_ratio: float = 0.95, max_gap_ms: int | None = None) -> DataFrame:
    """(feed_id, episode_id, duration_ms, covered_ms, max_gap_ms, complete, missing, gap) for each audio.

    covered_ms: the length of the union of the segments within the audio, so nested and overlapping ones count once and silence doesn't.
    max_gap_ms: the longest stretch that no segment covers, also before the first and after the last.  complete: covered_ms is at least min_ratio of
    the duration.  missing: no segments, covered_ms is null.  gap: a stretch of more than max_gap_ms (null: never).  A segment that ends
    before it starts covers nothing; an audio without a duration is covered to its last end.
    """
    spans = segments.select(*KEY, "start_ms", "end_ms").join(audio.select(*KEY, "duration_ms"), KEY)
    start, end = F.greatest("start_ms", F.lit(0)), F.least("end_ms", F.coalesce("duration_ms", "end_ms"))
    spans = spans.select(*KEY, start.alias("s"), F.when(end > start, end).alias("e"))
    # islands by the running maximum of the ends: a span adds what lies behind all ends before it
    before = F.coalesce(F.max("e").over(Window.partitionBy(*KEY).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("_before", before).withColumns({"_new": F.greatest(F.col("e") - F.greatest("s", "_before"), F.lit(0)), "_gap": F.when(F.col("e").isNotNull(), F.col("s") - F.col("_before"))})
    per = spans.groupBy(*KEY).agg(F.coalesce(F.sum("_new"), F.lit(0)).alias("covered_ms"), F.max("_gap").alias("_gap"), F.coalesce(F.max("e"), F.lit(0)).alias("_last"))
    out = audio.select(*KEY, "duration_ms").join(per, KEY, "left")
    longest = F.when(F.col("covered_ms").isNotNull(), F.greatest(F.col("_gap"), F.col("duration_ms") - F.col("_last"), F.lit(0)))
    out = out.select(*KEY, "duration_ms", "covered_ms", longest.alias("max_gap_ms"))
    gap = F.coalesce(F.col("max_gap_ms") > F.lit(max_gap_ms), F.lit(False)) if max_gap_ms is not None else F.lit(False)
    return out.withColumn("complete", F.coalesce(F.col("covered_ms") >= min_ratio * F.col("duration_ms"), F.lit(False))).withColumn("missing", F.col("covered_ms").isNull()).withColumn("gap", gap)


def assemble_transcripts(segments: DataFrame, separator: str = "\n") -> DataFrame:
    """TRANSCRIPTS: the segments of each episode in order as one text, with its characters."""
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", F.coalesce("text", F.lit("")).alias("t"))))
    out = segments.groupBy(*KEY).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), separator).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def decide_mode(transcripts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """transcripts with mode: ``skill`` below the threshold of characters, else ``map-reduce``."""
    return transcripts.withColumn("mode", F.when(F.coalesce("n_chars", F.lit(0)) < threshold, "skill").otherwise("map-reduce"))


def mode_report(transcripts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return decide_mode(transcripts, threshold).groupBy("mode").agg(F.count("*").alias("n"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))


def chunk_transcripts(transcripts: DataFrame, budget: int) -> DataFrame:
    """CHUNKS of each text, in order, of at most ``budget`` tokens; joined they are the text. An empty text has none."""
    if budget < 1:
        raise ValueError("a chunk needs a token at least")
    cut = transcripts.select(*KEY, tokens(F.coalesce("text", F.lit(""))).alias("_t")).where(F.size("_t") > 0)
    starts = F.sequence(F.lit(0), F.size("_t") - 1, F.lit(budget))
    pieces = F.transform(starts, lambda s: F.slice("_t", s + 1, budget))
    out = cut.select(*KEY, F.posexplode(F.transform(pieces, lambda p: F.struct(F.array_join(p, "").alias("text"), F.size(p).cast("long").alias("n_tokens")))).alias("chunk_no", "p"))
    return out.select(*KEY, "chunk_no", "p.text", "p.n_tokens")


def chunk_segments(segments: DataFrame, budget: int, separator: str = "\n") -> DataFrame:
    """CHUNKS of whole segments: a segment belongs to the chunk in which the tokens before it end; numbers are gapless."""
    if budget < 1:
        raise ValueError("a chunk needs a token at least")
    order = Window.partitionBy(*KEY).orderBy("seg_no")
    rows = segments.select(*KEY, "seg_no", F.coalesce("text", F.lit("")).alias("t"), F.size(tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_k", F.floor(before / budget)).withColumn("chunk_no", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("_k")) - 1)
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", "t")))
    return rows.groupBy(*KEY, "chunk_no").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), separator).alias("text"), F.sum("n").alias("n_tokens"))
