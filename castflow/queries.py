"""The library's queries on the driver's tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castflow import fixtures as X
from castflow.functions.storage import empty, scratch
from castflow.operators import download, enrich, increment, note_index, notes, request_log, review, subscribe, transcripts, work
from castflow.plans import notes_flow
from castflow.schemas import KEY
from castflow.sources import feed_items, feeds, files, state_files
from castflow.streaming.increment import found_episodes, run_batch, seen_table, start_increment_stream

#: Transcript threshold and chunk budgets of the queries; no document of the test tables is long enough for the default.
LONG, BUDGET, SEGMENT_BUDGET = 4000, 300, 120

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- tables that the SQL repeats ------------------------------------------------------------------

EP = """ep AS (SELECT source AS feed_id, CAST(doc_id AS VARCHAR) AS episode_id, doc_id, split_part(text, chr(10), 1) AS title,
    text AS description, text, n_chars, 'https://cdn-' || (doc_id % 7) || '.example/' || source || '/' || doc_id || '.mp3' AS enclosure_url FROM documents)"""
ST = """st AS (SELECT d.source AS feed_id, CAST(d.doc_id AS VARCHAR) AS episode_id, d.doc_id, split_part(d.text, chr(10), 1) AS title,
    CASE WHEN coalesce(l.quality, 0) <> 1 THEN 'pending' WHEN l.toxic = 1 THEN 'converted' ELSE 'confirmed' END AS zone,
    coalesce(l.quality, 0) = 1 OR d.doc_id % 5 = 0 AS checked FROM documents d LEFT JOIN labels l USING (doc_id))"""
SEG = """seg0 AS (SELECT conv_id, turn, text, length(text) * 66 AS ms, CAST(sum(length(text) * 66 + CASE WHEN turn % 3 = 2 THEN 5000 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_ms FROM conversations),
    seg AS (SELECT CAST(conv_id AS VARCHAR) AS episode_id, conv_id, CAST(turn AS INTEGER) AS seg_no, end_ms - ms AS start_ms, end_ms, text FROM seg0)"""
TOK = r"""regexp_extract_all({}, '\p{{Han}}\s*|[^\s\p{{Han}}]+\s*|^\s+')"""
WORDS = "list_distinct(list_filter(list_transform(" + TOK + ", lambda w: trim(w, ' ' || chr(9) || chr(10) || chr(13))), lambda w: w <> ''))"
SENTENCE = "substr(regexp_extract({}, '^[^.!?。！？\n]*[.!?。！？]?'), 1, 80)"
RQ = "rq AS (SELECT user_id % 3 AS run_id, event_id, user_id, ts, epoch_us(ts) AS us, value AS latency_s, CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status FROM events)"


# --- A: sources and sinks -------------------------------------------------------------------------


def _stored_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "feeds")
    feeds.write_feed_docs(X.feed_docs(X.episodes(spark, sf_dir)), path)
    return feeds.read_feed_docs(spark, path)


@query(f"WITH {EP} SELECT feed_id, episode_id, title, enclosure_url, CAST(length(description) AS BIGINT) AS n_chars FROM ep")
def parse_feeds(spark, sf_dir):
    found = feeds.parse_feeds(_stored_feeds(spark, sf_dir))
    return found.select(*KEY, "title", "enclosure_url", F.length("description").cast("long").alias("n_chars"))


@query("SELECT DISTINCT source AS feed_id FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 5 = 0")
def rejected_feeds(spark, sf_dir):
    docs = X.feed_docs(X.episodes(spark, sf_dir))
    half = F.expr("substring(xml, 1, cast(length(xml) / 2 as int))")
    cut = docs.withColumn("xml", F.when(F.substring("feed_id", 4, 10).cast("int") % 5 == 0, half).otherwise(F.col("xml")))
    return feeds.rejected_feeds(cut).select("feed_id").distinct()


@query(f"WITH {EP} SELECT feed_id, episode_id, title, enclosure_url, CAST(length(description) AS BIGINT) AS n_chars FROM ep")
def parse_foreign_feeds(spark, sf_dir):
    """Documents as bytes in three encodings, some with a broken tail: all whole items."""
    found = feed_items.parse_feed_bytes(X.feed_bytes(X.feed_docs(X.episodes(spark, sf_dir))))
    return found.select(*KEY, "title", "enclosure_url", F.length("description").cast("long").alias("n_chars"))


@query("SELECT DISTINCT source AS feed_id FROM documents WHERE CAST(substr(source, 4) AS INTEGER) % 5 = 0")
def broken_feeds(spark, sf_dir):
    return feed_items.broken_feeds(X.feed_bytes(X.feed_docs(X.episodes(spark, sf_dir)))).select("feed_id").distinct()


@query(f"WITH {EP} SELECT episode_id, enclosure_url FROM ep")
def metadata_json(spark, sf_dir):
    path = scratch(spark, "metadata")
    files.write_metadata(X.episodes(spark, sf_dir), path)
    return files.read_metadata(spark, path).select("episode_id", "enclosure_url")


@query(f"""WITH {ST} SELECT feed_id, episode_id, zone, checked,
    row_number() OVER (PARTITION BY feed_id ORDER BY CASE zone WHEN 'pending' THEN 0 WHEN 'confirmed' THEN 1 ELSE 2 END, doc_id) AS line_no FROM st""")
def state_round_trip(spark, sf_dir):
    path = scratch(spark, "state")
    state_files.write_state(X.state(spark, sf_dir), path)
    return state_files.read_state(spark, path).select(*KEY, "zone", "checked", F.col("line_no").cast("long").alias("line_no"))


@query(f"WITH {SEG} SELECT episode_id, seg_no, start_ms, end_ms, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM seg")
def segments_read(spark, sf_dir):
    path = scratch(spark, "segments")
    files.write_segments(X.segments(spark, sf_dir), path)
    return files.read_segments(spark, path).select("episode_id", "seg_no", "start_ms", "end_ms", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("SELECT source AS feed_id, count(*) AS n_notes, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def notes_written(spark, sf_dir):
    path = scratch(spark, "notes")
    made = X.transcripts(spark, sf_dir).select(*KEY, F.lit("1").alias("template_id"), F.lit("skill").alias("mode"), F.col("text").alias("markdown"))
    files.write_notes(made, path)
    return files.read_notes(spark, path).groupBy("feed_id").agg(F.count("*").alias("n_notes"), F.sum(F.length("markdown")).cast("long").alias("n_chars"))


@query("""SELECT source AS feed_id, CAST(d.doc_id AS VARCHAR) AS episode_id, CASE WHEN l.doc_id IS NULL OR l.toxic = 1 THEN 'second' ELSE 'first' END AS mode,
    md5(CASE WHEN l.doc_id IS NULL OR l.toxic = 1 THEN 'new ' ELSE '' END || text) AS markdown_md5 FROM documents d LEFT JOIN labels l USING (doc_id)""")
def notes_merged(spark, sf_dir):
    """A run for the labelled documents, and one for all others and, again, for the toxic ones."""
    path = scratch(spark, "notes")
    made = X.transcripts(spark, sf_dir).select(*KEY, F.lit("1").alias("template_id"), F.lit("first").alias("mode"), F.col("text").alias("markdown"))
    known = X.labelled(spark, sf_dir, "toxic")
    files.write_notes(made.join(known, KEY).drop("toxic"), path)
    again = made.join(known.where("toxic <> 1 or toxic is null"), KEY, "left_anti")
    files.write_notes(again.withColumns({"mode": F.lit("second"), "markdown": F.concat(F.lit("new "), "markdown")}), path)
    return files.read_notes(spark, path).select(*KEY, "mode", F.md5("markdown").alias("markdown_md5"))


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS episode_id, CASE WHEN l.doc_id IS NULL OR l.toxic = 1 THEN split_part(text, chr(10), 1) || '!' ELSE split_part(text, chr(10), 1) END AS title FROM documents d LEFT JOIN labels l USING (doc_id)""")
def metadata_merged(spark, sf_dir):
    """As notes_merged, for metadata."""
    path = scratch(spark, "metadata")
    made, known = X.episodes(spark, sf_dir), X.labelled(spark, sf_dir, "toxic")
    files.write_metadata(made.join(known.drop("toxic"), KEY, "left_semi"), path)
    files.write_metadata(made.join(known.where("toxic <> 1 or toxic is null"), KEY, "left_anti").withColumn("title", F.concat("title", F.lit("!"))), path)
    return files.read_metadata(spark, path).select("episode_id", "title")


@query(f"""WITH {SEG} SELECT episode_id, seg_no, end_ms, CASE WHEN conv_id % 3 = 0 THEN md5('again ' || text) ELSE md5(text) END AS text_md5 FROM seg WHERE conv_id % 3 <> 0 OR seg_no > 0""")
def segments_merged(spark, sf_dir):
    """All transcripts, then a third of them anew with a segment less."""
    path = scratch(spark, "segments")
    first = X.segments(spark, sf_dir)
    files.write_segments(first, path)
    files.write_segments(first.where("cast(episode_id as long) % 3 = 0 and seg_no > 0").withColumn("text", F.concat(F.lit("again "), "text")), path)
    return files.read_segments(spark, path).select("episode_id", "seg_no", "end_ms", F.md5("text").alias("text_md5"))


@query("SELECT CAST(item_id AS VARCHAR) AS template_id, 's' || (item_id % 3) AS style, trim(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g')) AS description, CAST(2 AS BIGINT) AS n_sections FROM benchmark")
def templates_read(spark, sf_dir):
    path = scratch(spark, "templates")
    files.write_templates(X.templates(spark, sf_dir), path)
    return files.read_templates(spark, path).select("template_id", "style", "description", F.size("required_sections").cast("long").alias("n_sections"))


# --- B: subscriptions -------------------------------------------------------------------------------

LK = "lk AS (SELECT page_id, CASE WHEN page_id % 2 = 1 THEN url ELSE 'https://podcasts.apple.com/cn/podcast/x/id' || page_id || '?i=1' END AS url FROM pages)"


@query(f"WITH {LK} SELECT page_id AS link_id, CASE WHEN page_id % 2 = 0 THEN 'apple' WHEN regexp_matches(url, '^https?://[^/?#]') THEN 'feed' ELSE 'invalid' END AS kind FROM lk")
def classify_links(spark, sf_dir):
    return subscribe.classify_links(X.links(spark, sf_dir)).select("link_id", "kind")


@query(f"""WITH {LK} SELECT page_id AS link_id, CASE WHEN page_id % 2 = 1 THEN lk.url WHEN page_id % 6 <> 0 THEN p.url END AS feed_url, page_id % 2 = 1 OR page_id % 6 <> 0 AS resolved
    FROM lk JOIN pages p USING (page_id)""")
def resolve_links(spark, sf_dir):
    return subscribe.resolve_links(X.links(spark, sf_dir), X.directory(spark, sf_dir)).select("link_id", "feed_url", "resolved")


@query("SELECT 'http://' || source AS feed_url, min(doc_id) AS first_doc FROM documents GROUP BY source")
def upsert_subscriptions(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("feed_id"), F.concat(F.lit("http://"), F.col("source")).alias("feed_url"), F.col("source").alias("title"), F.lit("link").alias("source_link"), F.timestamp_seconds("doc_id").alias("subscribed_at"))
    labels = X.table(spark, sf_dir, "labels").select(F.timestamp_seconds("doc_id").alias("subscribed_at"))
    snapshot = subscribe.upsert_subscriptions(rows.join(labels, "subscribed_at", "left_semi").select(*rows.columns), rows)
    return snapshot.select("feed_url", F.unix_seconds("subscribed_at").alias("first_doc"))


# --- C: increment -------------------------------------------------------------------------------------


@query(f"WITH {EP} SELECT feed_id, episode_id FROM ep WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_episodes(spark, sf_dir):
    return increment.new_episodes(X.episodes(spark, sf_dir), X.labelled(spark, sf_dir)).select(*KEY)


@query(f"WITH {EP} SELECT feed_id, episode_id, title || '!' AS title FROM ep")
def dedupe_episodes(spark, sf_dir):
    once = X.episodes(spark, sf_dir)
    newer = once.withColumn("title", F.concat("title", F.lit("!"))).withColumn("pub_date", F.col("pub_date") + F.expr("interval 1 day"))
    return increment.dedupe_episodes(newer.unionByName(once)).select(*KEY, "title")


@query(f"WITH {EP} SELECT feed_id, episode_id FROM ep")
def increment_stream(spark, sf_dir):
    drops, state, checkpoint = (scratch(spark, f"stream-{n}") for n in ("drops", "state", "checkpoint"))
    eps = X.episodes(spark, sf_dir)
    for part in (eps.join(X.labelled(spark, sf_dir), KEY, "left_semi"), eps):
        feeds.write_feed_docs(X.feed_docs(part), drops)
        start_increment_stream(feeds.read_feed_docs(spark, drops, stream=True), state, checkpoint).awaitTermination()
    return found_episodes(spark, state).select(*KEY)


@query(f"WITH {EP} SELECT feed_id, episode_id, l.doc_id IS NULL AS late, CAST(1 AS BIGINT) AS n FROM ep LEFT JOIN labels l USING (doc_id)")
def increment_compacted(spark, sf_dir):
    """The labelled episodes, then all, the second batch run twice, and all buckets put together after each."""
    state, drops, eps, buckets = scratch(spark, "buckets"), scratch(spark, "drops"), X.episodes(spark, sf_dir), 4
    for batch_id, some in enumerate((eps.join(X.labelled(spark, sf_dir), KEY, "left_semi"), eps)):
        X.feed_docs(some).write.parquet(f"{drops}/{batch_id}")
        for _ in range(batch_id + 1):
            run_batch(spark.read.parquet(f"{drops}/{batch_id}"), batch_id, state, buckets)
        empty(spark, f"{drops}/{batch_id}")
        for bucket in range(buckets):
            seen_table(spark, state, buckets).compact(bucket)
    keys = seen_table(spark, state, buckets).all().select(*KEY).distinct()
    return found_episodes(spark, state).join(keys, KEY).groupBy(*KEY).agg((F.max("batch_id") > 0).alias("late"), F.count("*").alias("n"))


@query(f"WITH {ST} SELECT feed_id, episode_id, CASE WHEN l.doc_id IS NOT NULL THEN zone ELSE 'pending' END AS zone, l.doc_id IS NOT NULL AND checked AS checked FROM st LEFT JOIN labels l USING (doc_id)")
def add_pending(spark, sf_dir):
    known = X.state(spark, sf_dir).join(X.labelled(spark, sf_dir), KEY, "left_semi")
    return increment.add_pending(known, X.episodes(spark, sf_dir)).select(*KEY, "zone", "checked")


# --- D, E: summaries and review -------------------------------------------------------------------


@query(f"WITH {ST} SELECT feed_id, episode_id, zone, checked, CASE WHEN l.doc_id IS NULL THEN {SENTENCE.format('d.text')} END AS summary FROM st JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)")
def attach_summaries(spark, sf_dir):
    some = enrich.summarize(increment.new_episodes(X.episodes(spark, sf_dir), X.labelled(spark, sf_dir)))
    return review.attach_summaries(X.state(spark, sf_dir), some).select(*KEY, "zone", "checked", "summary")


@query(f"WITH {ST} SELECT feed_id, episode_id, zone, checked FROM st WHERE checked AND zone <> 'converted'")
def picked(spark, sf_dir):
    return review.picked(X.state(spark, sf_dir)).select(*KEY, "zone", "checked")


@query(f"""WITH {ST} SELECT feed_id, episode_id, CASE WHEN zone = 'pending' AND checked THEN 'confirmed' WHEN zone = 'confirmed' AND doc_id % 3 = 0 THEN 'converted' ELSE zone END AS zone, checked FROM st""")
def advance_zones(spark, sf_dir):
    return review.advance_zones(X.state(spark, sf_dir), X.transcribed(spark, sf_dir)).select(*KEY, "zone", "checked")


@query("SELECT CAST(doc_id AS VARCHAR) AS episode_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_work(spark, sf_dir):
    return work.pending_work(X.episodes(spark, sf_dir), X.labelled(spark, sf_dir)).select("episode_id")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS episode_id, {SENTENCE.format('text')} AS summary FROM documents")
def summarize(spark, sf_dir):
    return enrich.summarize(X.episodes(spark, sf_dir)).select("episode_id", "summary")


#: A model in the queries, where its text must be sayable in SQL.
def _model(texts: list[str]) -> list[str]:
    return [f"{len(t)}: {t[:40]}" for t in texts]


@query("SELECT CAST(doc_id AS VARCHAR) AS episode_id, 'ok' AS status, length(text) || ': ' || substr(text, 1, 40) AS summary FROM documents")
def summarize_with_model(spark, sf_dir):
    return enrich.summarize(X.episodes(spark, sf_dir), _model).select("episode_id", "status", "summary")


def _picky(texts: list[str]) -> list[str]:
    """A model that refuses a whole batch for one text of an odd number of characters divisible by 7."""
    if any(len(t) % 14 == 7 for t in texts):
        raise ValueError("no such text")
    return _model(texts)


@query("""SELECT CAST(doc_id AS VARCHAR) AS episode_id, CASE WHEN length(text) % 14 = 7 THEN 'ValueError: no such text' ELSE 'ok' END AS status,
    CASE WHEN length(text) % 14 <> 7 THEN length(text) || ': ' || substr(text, 1, 40) END AS summary FROM documents""")
def summarize_with_bad_texts(spark, sf_dir):
    return enrich.summarize(X.episodes(spark, sf_dir), _picky).select("episode_id", "status", "summary")


# --- F: downloads ------------------------------------------------------------------------------------


@query(f"""WITH {ST} SELECT episode_id, 'cdn-' || (doc_id % 7) || '.example' AS host, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY feed_id, episode_id) AS seq,
    (row_number() OVER (PARTITION BY doc_id % 7 ORDER BY feed_id, episode_id) - 1) * 30 AS offset_s FROM st WHERE checked AND zone <> 'converted' AND doc_id % 4 = 0 AND doc_id % 3 <> 0""")
def download_manifest(spark, sf_dir):
    plan = download.download_manifest(review.picked(X.state(spark, sf_dir)), X.episodes(spark, sf_dir), X.audio(spark, sf_dir), X.transcribed(spark, sf_dir), 30)
    return plan.select("episode_id", "host", F.col("seq").cast("long").alias("seq"), F.col("offset_s").cast("long").alias("offset_s"))


@query("SELECT CAST(doc_id AS VARCHAR) AS episode_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 3 = 0")
def cleanup_candidates(spark, sf_dir):
    return download.cleanup_candidates(X.audio(spark, sf_dir), X.transcribed(spark, sf_dir)).select("episode_id")


@query(f"WITH {EP} SELECT episode_id, enclosure_url FROM ep WHERE doc_id % 3 = 0 AND doc_id % 4 = 0")
def redownload_list(spark, sf_dir):
    return download.redownload_list(X.transcribed(spark, sf_dir), X.episodes(spark, sf_dir), X.audio(spark, sf_dir)).select("episode_id", "enclosure_url")


# --- G: transcripts ----------------------------------------------------------------------------------

#: The union of the segments within the audio, by the running maximum of the ends; from seg and au(episode_id, duration_ms).
UNION = """sp AS (SELECT episode_id, duration_ms, greatest(start_ms, 0) AS s, CASE WHEN least(end_ms, duration_ms) > greatest(start_ms, 0) THEN least(end_ms, duration_ms) END AS e FROM kept JOIN au USING (episode_id)),
    bf AS (SELECT *, coalesce(max(e) OVER (PARTITION BY episode_id ORDER BY s, e NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sp),
    cov AS (SELECT episode_id, CAST(sum(CASE WHEN e IS NULL THEN 0 ELSE greatest(e - greatest(s, b), 0) END) AS BIGINT) AS covered_ms, max(CASE WHEN e IS NOT NULL THEN s - b END) AS g, coalesce(max(e), 0) AS last FROM bf GROUP BY episode_id),
    ck0 AS (SELECT episode_id, covered_ms, CASE WHEN covered_ms IS NOT NULL THEN greatest(coalesce(g, 0), duration_ms - last, 0) END AS max_gap_ms, coalesce(covered_ms >= 0.95 * duration_ms, false) AS complete, covered_ms IS NULL AS missing FROM au LEFT JOIN cov USING (episode_id)),
    ck AS (SELECT *, coalesce(max_gap_ms > 4000, false) AS gap FROM ck0)"""
CHECK = f"""{SEG}, au AS (SELECT episode_id, conv_id, CASE WHEN conv_id % 5 = 0 THEN CAST(floor(max(end_ms) * 1.25) AS BIGINT) ELSE max(end_ms) END AS duration_ms FROM seg GROUP BY episode_id, conv_id),
    kept AS (SELECT * FROM seg WHERE conv_id % 11 <> 0), {UNION}"""


def _checked(spark, sf_dir):
    segs = X.segments(spark, sf_dir)
    found = X.segment_audio(segs)
    return found, transcripts.check_duration(X.kept_segments(segs), found, 0.95, 4000)


@query(f"WITH {CHECK} SELECT * FROM ck")
def check_duration(spark, sf_dir):
    return _checked(spark, sf_dir)[1].select("episode_id", "covered_ms", "max_gap_ms", "complete", "missing", "gap")


#: Segments that lie in others, overlap, end before they start, begin before the audio or end after it; some episodes have only the last one.
ODD = f"""{SEG}, au AS (SELECT episode_id, conv_id, max(end_ms) AS duration_ms FROM seg GROUP BY episode_id, conv_id),
    kept AS (SELECT episode_id, CASE seg_no % 4 WHEN 0 THEN start_ms - 3000 WHEN 1 THEN end_ms ELSE start_ms END AS start_ms, CASE seg_no % 4 WHEN 0 THEN end_ms + 9000 WHEN 1 THEN start_ms WHEN 2 THEN start_ms + 500 ELSE end_ms END AS end_ms
        FROM seg JOIN au USING (episode_id) WHERE au.conv_id % 7 <> 0 OR end_ms = duration_ms), {UNION}"""


@query(f"WITH {ODD} SELECT * FROM ck")
def check_duration_overlaps(spark, sf_dir):
    segs = X.segments(spark, sf_dir)
    odd, turn = X.segment_audio(segs).drop("duration_ms"), F.col("seg_no") % 4
    last = segs.groupBy(*KEY).agg(F.max("end_ms").alias("duration_ms"))
    some = segs.join(last, KEY).where("cast(episode_id as long) % 7 <> 0 or end_ms = duration_ms").drop("duration_ms")
    start = F.when(turn == 0, F.col("start_ms") - 3000).when(turn == 1, F.col("end_ms")).otherwise(F.col("start_ms"))
    end = F.when(turn == 0, F.col("end_ms") + 9000).when(turn == 1, F.col("start_ms")).when(turn == 2, F.col("start_ms") + 500).otherwise(F.col("end_ms"))
    found = transcripts.check_duration(some.withColumns({"start_ms": start, "end_ms": end}), odd.join(last, KEY), 0.95, 4000)
    return found.select("episode_id", "covered_ms", "max_gap_ms", "complete", "missing", "gap")


@query(f"WITH {CHECK} SELECT episode_id FROM ck WHERE NOT complete")
def transcription_worklist(spark, sf_dir):
    return work.transcription_worklist(*_checked(spark, sf_dir)).select("episode_id")


@query("SELECT CAST(conv_id AS VARCHAR) AS episode_id, CAST(length(string_agg(text, chr(10) ORDER BY turn)) AS BIGINT) AS n_chars, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def assemble_transcripts(spark, sf_dir):
    return transcripts.assemble_transcripts(X.segments(spark, sf_dir)).select("episode_id", "n_chars", F.md5("text").alias("text_md5"))


# --- H: notes -------------------------------------------------------------------------------------------


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS episode_id, CASE WHEN n_chars < {LONG} THEN 'skill' ELSE 'map-reduce' END AS mode, CASE WHEN n_chars < 50000 THEN 'skill' ELSE 'map-reduce' END AS default_mode FROM documents""")
def decide_mode(spark, sf_dir):
    rows = transcripts.decide_mode(X.transcripts(spark, sf_dir)).withColumnRenamed("mode", "default_mode")
    return transcripts.decide_mode(rows, LONG).select("episode_id", "mode", "default_mode")


@query(f"SELECT CASE WHEN n_chars < {LONG} THEN 'skill' ELSE 'map-reduce' END AS mode, count(*) AS n, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM documents GROUP BY 1")
def mode_report(spark, sf_dir):
    return transcripts.mode_report(X.transcripts(spark, sf_dir), LONG)


CHUNKS = f"""tk AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents WHERE n_chars >= {LONG}),
    ch AS (SELECT doc_id, k AS chunk_no, list_slice(t, k * {BUDGET} + 1, (k + 1) * {BUDGET}) AS p FROM tk, unnest(range(0, CAST(ceil(len(t) / {BUDGET}) AS BIGINT))) AS r(k))"""


def _chunks(spark, sf_dir):
    long = transcripts.decide_mode(X.transcripts(spark, sf_dir), LONG).where("mode = 'map-reduce'")
    return transcripts.chunk_transcripts(long, BUDGET)


@query(f"WITH {CHUNKS} SELECT CAST(doc_id AS VARCHAR) AS episode_id, chunk_no, CAST(len(p) AS BIGINT) AS n_tokens, md5(array_to_string(p, '')) AS text_md5 FROM ch")
def chunk_transcripts(spark, sf_dir):
    return _chunks(spark, sf_dir).select("episode_id", F.col("chunk_no").cast("long").alias("chunk_no"), "n_tokens", F.md5("text").alias("text_md5"))


@query(f"""WITH n AS (SELECT conv_id, turn, text, len({TOK.format('text')}) AS n FROM conversations),
    b AS (SELECT *, floor(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {SEGMENT_BUDGET}) AS k FROM n),
    c AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS chunk_no FROM b)
    SELECT CAST(conv_id AS VARCHAR) AS episode_id, chunk_no, CAST(sum(n) AS BIGINT) AS n_tokens, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5 FROM c GROUP BY conv_id, chunk_no""")
def chunk_segments(spark, sf_dir):
    made = transcripts.chunk_segments(X.segments(spark, sf_dir), SEGMENT_BUDGET)
    return made.select("episode_id", F.col("chunk_no").cast("long").alias("chunk_no"), "n_tokens", F.md5("text").alias("text_md5"))


@query(f"""WITH {CHUNKS}, s AS (SELECT doc_id, chunk_no, {SENTENCE.format("array_to_string(p, '')")} AS summary FROM ch)
    SELECT CAST(doc_id AS VARCHAR) AS episode_id, count(*) AS n_chunks, md5(string_agg(summary, chr(10) || chr(10) ORDER BY chunk_no)) AS document_md5 FROM s GROUP BY doc_id""")
def map_reduce(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return enrich.reduce_chunks(chunks, enrich.map_chunks(chunks)).select("episode_id", "n_chunks", F.md5("document").alias("document_md5"))


@query(f"""WITH {CHUNKS}, s AS (SELECT doc_id, chunk_no, array_to_string(p, '') AS t FROM ch), j AS (SELECT doc_id, count(*) AS n_chunks, string_agg(length(t) || ': ' || substr(t, 1, 40), chr(10) || chr(10) ORDER BY chunk_no) AS d FROM s GROUP BY doc_id)
    SELECT CAST(doc_id AS VARCHAR) AS episode_id, n_chunks, 'ok' AS status, md5(length(d) || ': ' || substr(d, 1, 40)) AS document_md5 FROM j""")
def map_reduce_with_model(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return enrich.reduce_chunks(chunks, enrich.map_chunks(chunks, _model), _model).select("episode_id", "n_chunks", "status", F.md5("document").alias("document_md5"))


#: Small, so that summaries of six characters take several levels: tokens of a chunk, and of a call.
SMALL_CHUNK, SMALL_CALL, LEVELS = 60, 16, 9


def _brief(texts: list[str]) -> list[str]:
    if any(len(re.findall(r"[\u3400-\u9fff]|[^\s\u3400-\u9fff]+", t)) > max(SMALL_CALL, SMALL_CHUNK) for t in texts):
        raise ValueError("over the budget")
    return [f"{len(t)}: {t[:6]}" for t in texts]


def _levels_sql(source: str, chunk: int, call: int) -> str:
    """CTEs i1 (chunk summaries) to fin(doc_id, n_levels, document), from source(doc_id, text); each level as the library groups it."""
    part, window = call // 4, call - call // 4
    brief = "length(text) || ': ' || substr(text, 1, 6)"
    out = f"""t0 AS (SELECT doc_id, {TOK.format('text')} AS t FROM {source}), c0 AS (SELECT doc_id, k AS no, array_to_string(list_slice(t, k * {chunk} + 1, (k + 1) * {chunk}), '') AS text FROM t0, unnest(range(0, CAST(ceil(len(t) / {chunk}) AS BIGINT))) AS r(k)),
    i1 AS (SELECT doc_id, no, {brief} AS text FROM c0)"""
    for n in range(1, LEVELS + 1):
        out += f""", t{n} AS (SELECT doc_id, no, {TOK.format('text')} AS t FROM i{n}), p{n} AS (SELECT doc_id, no, k AS piece, list_slice(t, k * {part} + 1, (k + 1) * {part}) AS p FROM t{n}, unnest(range(0, greatest(1, CAST(ceil(len(t) / {part}) AS BIGINT)))) AS r(k)),
    w{n} AS (SELECT *, len(p) AS n, coalesce(sum(len(p)) OVER (PARTITION BY doc_id ORDER BY no, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len(p)) OVER (PARTITION BY doc_id) AS total FROM p{n}),
    k{n} AS (SELECT *, CASE WHEN total <= {call} THEN 0 ELSE before // {window} END AS k FROM w{n} WHERE n > 0),
    j{n} AS (SELECT doc_id, k, string_agg(CASE WHEN rn > 1 AND piece = 0 THEN chr(10) || chr(10) ELSE '' END || array_to_string(p, ''), '' ORDER BY no, piece) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY no, piece) AS rn FROM k{n}) GROUP BY doc_id, k),
    g{n} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS no, count(*) OVER (PARTITION BY doc_id) AS n_groups, {brief} AS text FROM j{n}), i{n + 1} AS (SELECT doc_id, no, text FROM g{n} WHERE n_groups > 1)"""
    return out + ", fin AS (" + " UNION ALL ".join(f"SELECT doc_id, {n} AS n_levels, text AS document FROM g{n} WHERE n_groups = 1" for n in range(1, LEVELS + 1)) + ")"


LEVELS_SQL = _levels_sql(f"(SELECT doc_id, text FROM documents WHERE n_chars >= {LONG})", SMALL_CHUNK, SMALL_CALL)


@query(f"""WITH {LEVELS_SQL}, n AS (SELECT doc_id, count(*) AS n_chunks FROM c0 GROUP BY doc_id)
    SELECT CAST(doc_id AS VARCHAR) AS episode_id, n_chunks, n_levels, 'ok' AS status, document FROM fin JOIN n USING (doc_id)""")
def reduce_in_levels(spark, sf_dir):
    """Chunk summaries reduced by a model that reads sixteen tokens; the second call finds all levels written."""
    long = transcripts.decide_mode(X.transcripts(spark, sf_dir), LONG).where("mode = 'map-reduce'")
    chunks, path = transcripts.chunk_transcripts(long, SMALL_CHUNK), scratch(spark, "levels")
    out = enrich.reduce_levels(chunks, enrich.map_chunks(chunks, _brief), SMALL_CALL, path, _brief)
    return out.select("episode_id", "n_chunks", "n_levels", "status", "document")


@query("""WITH a AS (SELECT user_id, event_id % 10 AS chunk_no, event_type, row_number() OVER (PARTITION BY user_id, event_id % 10 ORDER BY ts, event_id) AS attempt FROM events),
    l AS (SELECT user_id, chunk_no, max(attempt) AS attempt, arg_max(event_type, attempt) AS last FROM a GROUP BY user_id, chunk_no),
    u AS (SELECT user_id, c AS chunk_no FROM (SELECT DISTINCT user_id FROM events), range(0, 11) r(c))
    SELECT CAST(user_id AS VARCHAR) AS episode_id, chunk_no, CAST(coalesce(attempt, 0) AS BIGINT) AS attempt FROM u LEFT JOIN l USING (user_id, chunk_no) WHERE attempt IS NULL OR (last = 'error' AND attempt < 12)""")
def chunks_to_retry(spark, sf_dir):
    results = X.chunk_results(spark, sf_dir)
    chunks = results.select(*KEY).distinct().withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.lit(10))))
    again = work.chunks_to_retry(chunks, results, 12)
    return again.select("episode_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("attempt").cast("long").alias("attempt"))


PICK = f"""tw AS (SELECT item_id, unnest({WORDS.format("lower('s' || (item_id % 3) || ' ' || text)")}) AS word FROM benchmark),
    dw AS (SELECT doc_id, unnest({WORDS.format('lower(text)')}) AS word FROM documents),
    sc AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS template_id, count(*) AS score FROM dw JOIN tw USING (word) GROUP BY ALL),
    best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template_id) = 1),
    pk AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS episode_id, coalesce(template_id, (SELECT min(CAST(item_id AS VARCHAR)) FROM benchmark)) AS template_id, coalesce(score, 0) AS score FROM documents d LEFT JOIN best USING (doc_id))"""
NOTE = f"""{PICK}, nt AS (SELECT doc_id, episode_id, template_id, CASE WHEN n_chars < {LONG} THEN 'skill' ELSE 'map-reduce' END AS mode,
    '# ' || split_part(text, chr(10), 1) || chr(10) || '## TL;DR' || chr(10) || text || chr(10) || '## Topics s' || (CAST(template_id AS BIGINT) % 3) AS markdown FROM pk JOIN documents USING (doc_id))"""


@query(f"WITH {PICK} SELECT episode_id, template_id, score FROM pk")
def pick_template(spark, sf_dir):
    return notes.pick_template(X.transcripts(spark, sf_dir), X.templates(spark, sf_dir)).select("episode_id", "template_id", "score")


def _notes(spark, sf_dir):
    texts, known = X.transcripts(spark, sf_dir), X.templates(spark, sf_dir)
    content = transcripts.decide_mode(texts, LONG).join(notes.pick_template(texts, known), KEY).withColumn("title", F.substring_index("text", "\n", 1))
    return notes.build_notes(content, known), known


@query(f"WITH {NOTE} SELECT episode_id, mode, template_id, md5(markdown) AS markdown_md5 FROM nt")
def build_notes(spark, sf_dir):
    return _notes(spark, sf_dir)[0].select("episode_id", "mode", "template_id", F.md5("markdown").alias("markdown_md5"))


@query(f"""WITH {PICK}, {LEVELS_SQL} SELECT source AS feed_id, pk.episode_id, CASE WHEN n_chars < {LONG} THEN 'skill' ELSE 'map-reduce' END AS mode, template_id,
    md5('# ' || split_part(text, chr(10), 1) || chr(10) || '## TL;DR' || chr(10) || coalesce(document, text) || chr(10) || '## Topics s' || (CAST(template_id AS BIGINT) % 3)) AS markdown_md5
    FROM pk JOIN documents d USING (doc_id) LEFT JOIN fin USING (doc_id)""")
def notes_in_two_runs(spark, sf_dir):
    """The whole way from texts to notes for the labelled documents, then for all: the second run makes only what is pending."""
    path, between = scratch(spark, "flow-notes"), scratch(spark, "flow-work")
    texts, known = X.transcripts(spark, sf_dir), X.templates(spark, sf_dir)
    for some in (texts.join(X.labelled(spark, sf_dir), KEY, "left_semi"), texts):
        notes_flow.write_pending_notes(some, known, path, between, SMALL_CHUNK, LONG, SMALL_CALL, _brief)
    return files.read_notes(spark, path).select(*KEY, "mode", "template_id", F.md5("markdown").alias("markdown_md5"))


@query(f"WITH {PICK} SELECT episode_id, 'Topics s' || (CAST(template_id AS BIGINT) % 3) AS section FROM pk JOIN documents USING (doc_id) WHERE n_chars < {LONG}")
def missing_sections(spark, sf_dir):
    made, known = _notes(spark, sf_dir)
    cut = F.when(F.col("mode") == "skill", F.regexp_replace("markdown", "\n## Topics[^\n]*$", "")).otherwise(F.col("markdown"))
    return notes.missing_sections(made.withColumn("markdown", cut), known).select("episode_id", "section")


@query(f"""WITH {NOTE}, ln AS (SELECT episode_id, string_split(markdown, chr(10)) AS l FROM nt), ex AS (SELECT episode_id, unnest(l) AS line, CAST(unnest(range(0, len(l))) AS BIGINT) AS ord FROM ln)
    SELECT episode_id, 'TL;DR' AS section, ord, md5(line) AS line_md5 FROM ex WHERE NOT regexp_matches(line, '^#{{1,2}} ')""")
def note_sections(spark, sf_dir):
    rows = notes.note_sections(_notes(spark, sf_dir)[0])
    return rows.select("episode_id", "section", F.col("ord").cast("long").alias("ord"), F.md5("line").alias("line_md5"))


FIX = """fx AS (SELECT doc_id, source AS feed_id, text, CASE lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'und' WHEN 'fr' THEN 'les' ELSE 'que' END AS w1, CASE lang WHEN 'en' THEN 'th' ELSE 'en' END AS w2 FROM documents),
    f1 AS (SELECT *, replace(text, w1, upper(w1)) AS t1 FROM fx), f2 AS (SELECT *, replace(t1, w2, upper(w2)) AS t2 FROM f1)"""


def _corrections(spark, sf_dir):
    lang = F.col("lang")
    one = F.when(lang == "en", "the").when(lang == "de", "und").when(lang == "fr", "les").otherwise("que")
    two = F.when(lang == "en", "th").otherwise("en")
    rows = X.table(spark, sf_dir, "documents").select(F.col("source").alias("feed_id"), F.col("doc_id").cast("string").alias("episode_id"), F.explode(F.array(one, two)).alias("wrong"))
    return rows.withColumn("right", F.upper("wrong"))


@query(f"WITH {FIX} SELECT CAST(doc_id AS VARCHAR) AS episode_id, md5(t2) AS text_md5, CAST(length(t2) AS BIGINT) AS n_chars FROM f2")
def apply_corrections(spark, sf_dir):
    out = notes.apply_corrections(X.transcripts(spark, sf_dir), _corrections(spark, sf_dir))
    return out.select("episode_id", F.md5("text").alias("text_md5"), "n_chars")


@query(f"""WITH {FIX}, h AS (SELECT doc_id, w1 AS wrong, (length(text) - length(replace(text, w1, ''))) // length(w1) AS hits FROM f2 UNION ALL SELECT doc_id, w2, (length(t1) - length(replace(t1, w2, ''))) // length(w2) FROM f2)
    SELECT CAST(doc_id AS VARCHAR) AS episode_id, wrong, CAST(hits AS BIGINT) AS hits FROM h WHERE hits > 0""")
def correction_report(spark, sf_dir):
    return notes.correction_report(X.transcripts(spark, sf_dir), _corrections(spark, sf_dir)).select("episode_id", "wrong", "hits")


SEARCH = f"""WITH q AS (SELECT item_id AS query_id, unnest({WORDS.format('lower(text)')}) AS word FROM benchmark), d AS (SELECT source, doc_id, unnest({WORDS.format('lower(text)')}) AS word FROM documents),
    h AS (SELECT query_id, source, CAST(doc_id AS VARCHAR) AS episode_id, count(*) AS hits FROM d JOIN q USING (word) GROUP BY ALL)
    SELECT query_id, episode_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, source, episode_id) AS rank FROM h QUALIFY rank <= 5"""


@query(SEARCH)
def search_notes(spark, sf_dir):
    made = X.transcripts(spark, sf_dir).withColumnRenamed("text", "markdown")
    asked = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return notes.search_notes(made, asked, 5).select("query_id", "episode_id", "hits", F.col("rank").cast("long").alias("rank"))


@query(SEARCH)
def search_index(spark, sf_dir):
    """The same rows from a stored index: the labelled notes, some with a first text that the second batch replaces, then all."""
    made = X.transcripts(spark, sf_dir).withColumnRenamed("text", "markdown")
    index = note_index.NoteIndex(spark, scratch(spark, "index"), 16)
    first = made.join(X.labelled(spark, sf_dir, "quality"), KEY)
    index.add(first.withColumn("markdown", F.when(F.col("quality") == 1, F.col("markdown")).otherwise("an older text")))
    index.add(made)
    asked = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return index.search(asked, 5).select("query_id", "episode_id", "hits", F.col("rank").cast("long").alias("rank"))


# --- J: request log -----------------------------------------------------------------------------------


@query(f"""WITH {RQ}, g AS (SELECT run_id, event_id AS item_id, us - lag(us) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS gap_us FROM rq) SELECT * FROM g WHERE gap_us < 5000000""")
def spacing_violations(spark, sf_dir):
    return request_log.spacing_violations(X.requests(spark, sf_dir), 5.0).select("run_id", "item_id", "gap_us")


@query(f"""WITH {RQ}, e AS (SELECT run_id, us AS t, 1 AS d FROM rq UNION ALL SELECT run_id, us + CAST(round(latency_s * 1000000) AS BIGINT), -1 FROM rq),
    s AS (SELECT run_id, t, sum(d) AS d FROM e GROUP BY run_id, t), n AS (SELECT run_id, sum(d) OVER (PARTITION BY run_id ORDER BY t) AS n FROM s) SELECT run_id, CAST(max(n) AS BIGINT) AS peak FROM n GROUP BY run_id""")
def peak_concurrency(spark, sf_dir):
    return request_log.peak_concurrency(X.requests(spark, sf_dir))


@query(f"""WITH {RQ}, c AS (SELECT run_id, event_id AS item_id, coalesce(sum(CASE WHEN status = 429 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM rq)
    SELECT run_id, item_id, CAST(CASE WHEN e = 0 THEN 20 WHEN e = 1 THEN 15 ELSE 10 END AS BIGINT) AS allowed FROM c""")
def allowed_concurrency(spark, sf_dir):
    return request_log.allowed_concurrency(X.requests(spark, sf_dir)).select("run_id", "item_id", F.col("allowed").cast("long").alias("allowed"))


@query(f"""WITH {RQ}, i AS (SELECT *, sum(CASE WHEN status <> 429 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM rq),
    l AS (SELECT user_id, island, sum(CASE WHEN status = 429 THEN 1 ELSE 0 END) AS streak, max(us) AS us FROM i GROUP BY user_id, island), k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY island DESC) = 1)
    SELECT user_id AS item_id, CAST(streak AS BIGINT) AS streak, CAST(2 * pow(2, streak - 1) AS DOUBLE) AS delay_s, us + CAST(2000000 * pow(2, streak - 1) AS BIGINT) AS next_us FROM k WHERE streak > 0""")
def retry_schedule(spark, sf_dir):
    return request_log.retry_schedule(X.requests(spark, sf_dir, by_user=True), 2.0)


# --- the flagship ---------------------------------------------------------------------------------------


@query(f"""WITH {EP}, n AS (SELECT * FROM ep WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    SELECT feed_id, count(*) AS n_entries, md5('# ' || feed_id || chr(10) || '## 待确认' || chr(10) || string_agg('- [ ] ' || replace(title, ' — ', ' - ') || ' — ' || replace({SENTENCE.format('text')}, ' — ', ' - ') || ' <!-- id:' || episode_id || ' -->', chr(10) ORDER BY episode_id)
    || chr(10) || '## 确认' || chr(10) || '## 已转化') AS markdown_md5 FROM n GROUP BY feed_id""")
def state_documents(spark, sf_dir):
    entries = _pending_state(spark, sf_dir)
    counts = entries.groupBy("feed_id").agg(F.count("*").alias("n_entries"))
    return state_files.render_state(entries).join(counts, "feed_id").select("feed_id", "n_entries", F.md5("markdown").alias("markdown_md5"))


def _pending_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored feeds, deduped, less what was seen, as pending entries with their summaries."""
    fresh = increment.new_episodes(increment.dedupe_episodes(feeds.parse_feeds(X.feed_docs(X.episodes(spark, sf_dir)))), X.labelled(spark, sf_dir))
    empty = X.state(spark, sf_dir).limit(0)
    return review.attach_summaries(increment.add_pending(empty, fresh), enrich.summarize(fresh))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feed_id, markdown): the state document of each source."""
    return state_files.render_state(_pending_state(spark, sf_dir))
