"""From segments to notes, as a run that can be repeated: what is finished is never made again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castflow import schemas
from castflow.functions.storage import Staged
from castflow.operators import enrich, notes, transcripts, work
from castflow.schemas import KEY
from castflow.sources import files
from castflow.sources.merged import MergedTable


def chunk_results(spark: SparkSession, path: str) -> MergedTable:
    """The summaries of chunks that earlier runs left."""
    return MergedTable(spark, f"{path.rstrip('/')}/chunks", schemas.CHUNK_RESULTS, [*KEY, "chunk_no"])


def write_pending_notes(texts: DataFrame, templates: DataFrame, path: str, work_path: str, budget: int, threshold: int = transcripts.THRESHOLD, reduce_budget: int | None = None, model: enrich.Model | None = None, max_attempts: int = 3) -> None:
    """Merges a note into the notes at ``path`` for each of the TRANSCRIPTS that has none yet.

    Long ones go by chunks: only chunks without a good summary from an earlier run are asked, then the summaries are reduced by levels.  An
    episode with a failed chunk or group has no note after the run, and is tried again by the next, which asks only for what failed.  A transcript that
    changed under the same key keeps its note.  Notes stand under ``path``, what is between them and the texts under ``work_path``.
    """
    spark = texts.sparkSession
    with Staged(spark) as staged:
        pending = work.pending_work(texts, files.read_notes(spark, path))
        pending = staged.save(transcripts.decide_mode(pending, threshold).select(*KEY, "text", "mode"), "pending")
        chunks = staged.save(transcripts.chunk_transcripts(pending.where("mode = 'map-reduce'"), budget), "chunks")
        results = chunk_results(spark, work_path)
        again = staged.save(work.chunks_to_retry(chunks, results.read(), max_attempts), "chunks-to-do")
        if again.take(1):
            tried = again.select(*KEY, "chunk_no", (F.col("attempt") + 1).cast("int").alias("attempt"))
            made = enrich.map_chunks(again.drop("attempt"), model).drop("attempt").join(tried, [*KEY, "chunk_no"])
            results.merge(made)
        reduced = enrich.reduce_levels(chunks, results.read(), reduce_budget or budget, f"{work_path.rstrip('/')}/levels", model)
        long = pending.where("mode = 'map-reduce'").join(reduced.where("status = 'ok'"), KEY).select(*KEY, "mode", F.substring_index("text", "\n", 1).alias("title"), F.col("document").alias("text"))
        short = pending.where("mode = 'skill'").select(*KEY, "mode", F.substring_index("text", "\n", 1).alias("title"), "text")
        content = short.unionByName(long).join(notes.pick_template(pending, templates).drop("score"), KEY)
        files.write_notes(notes.build_notes(content, templates), path)
