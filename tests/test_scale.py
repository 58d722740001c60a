"""What grows with a pull or a part, not with all that was ever seen."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from castflow import schemas
from castflow.fixtures import feed_docs
from castflow.functions import scan
from castflow.operators import note_index, notes, request_log
from castflow.plans.checks import physical_plan, scanned_bytes
from castflow.schemas import KEY
from castflow.streaming import seen
from castflow.streaming.increment import found_episodes, run_batch, seen_table

LOG = "run_id long, kind string, item_id long, ts timestamp, latency_s double, status int"


def keys(spark, feeds, n=20, first=0):
    return spark.createDataFrame([(f, str(i)) for f in feeds for i in range(first, first + n)], "feed_id string, episode_id string")


def pairs(df):
    return {(r.feed_id, r.episode_id) for r in df.collect()}


def test_a_pull_reads_the_buckets_of_its_feeds(spark, tmp_path):
    """Ten times the history in other feeds, and what a pull reads stays within a bucket's share."""
    table = seen.SeenTable(spark, str(tmp_path / "seen"), 64)
    pulled = keys(spark, ["mine"], 30)
    assert pairs(table.new(pulled)) == pairs(pulled)
    table.add(keys(spark, ["mine", *(f"a{i}" for i in range(100))]), 0)
    before = scanned_bytes(table.among(pulled))
    table.add(keys(spark, [f"b{i}" for i in range(1000)]), 1)
    after, whole = scanned_bytes(table.among(pulled)), scanned_bytes(table.all())
    assert after < 4 * before and after < whole / 20
    plan = physical_plan(table.among(pulled))
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "feed_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert pairs(table.new(pulled)) == {("mine", str(i)) for i in range(20, 30)}
    many = keys(spark, [f"a{i}" for i in range(60)], 21)
    assert pairs(table.new(many)) == {(f"a{i}", "20") for i in range(60)}


def test_more_feeds_than_are_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "NAMED_FEEDS", 3)
    table = seen.SeenTable(spark, str(tmp_path / "seen"), 4)
    table.add(keys(spark, [f"a{i}" for i in range(10)]), 0)
    assert pairs(table.new(keys(spark, [f"a{i}" for i in range(10)], 21))) == {(f"a{i}", "20") for i in range(10)}


def test_compaction_beside_readers_and_broken_off(spark, tmp_path, monkeypatch):
    table = seen.SeenTable(spark, str(tmp_path / "seen"), 1)
    everything = set()
    for batch in range(6):
        some = keys(spark, ["f", "g"], 5, 5 * batch)
        table.add(some, batch)
        everything |= pairs(some)
        if batch in (2, 4):
            reader = table.all()
            assert table.compact(0)
            assert pairs(reader) == everything == pairs(table.all())  # who began before still finds its files
    with monkeypatch.context() as m:

        def stop(*_):
            raise KeyboardInterrupt

        m.setattr(seen, "empty", stop)
        with pytest.raises(KeyboardInterrupt):
            table.compact(0)
    assert pairs(table.all()) == everything
    while table.compact(0):
        pass
    assert pairs(table.all()) == everything and table.all().count() == len(everything) == table._stored().count()
    assert sorted(r.batch_id for r in table.all().select("batch_id").distinct().collect()) == [-5, 5]  # the last batch may be run again


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    state = str(tmp_path / "state")
    eps = spark.createDataFrame([(f"s{i % 3}", str(i), str(i), f"t{i}", "d", dt.datetime(2024, 1, 1), 60, "http://x/1.mp3") for i in range(30)], schemas.EPISODES)
    for batch, some in ((0, eps.where("cast(episode_id as int) < 20")), (1, eps), (1, eps), (2, eps)):
        run_batch(feed_docs(some), batch, state, 8)
    got = [(r.episode_id, r.batch_id) for r in found_episodes(spark, state).collect()]
    assert sorted(got) == sorted((str(i), int(i >= 20)) for i in range(30))
    assert len(pairs(seen_table(spark, state, 8).all())) == 30 == seen_table(spark, state, 8).all().count()
    run_batch(feed_docs(eps).limit(0), 3, state, 8)
    assert found_episodes(spark, state).count() == 30


def random_log(spark, n, seed):
    rng, t = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = [(rng.choice([0, 0, 0, 1, 2]), "n", i, t + dt.timedelta(milliseconds=rng.choice([1, 500]) * rng.randrange(60_000)), rng.choice([0.0, 0.5, 90.0]), rng.choice([200, 200, 429])) for i in range(n)]
    return spark.createDataFrame(rows + [(3, "n", 10**6, None, 1.0, 200), (3, "n", 10**6 + 1, t, 1.0, 429), (4, "n", 10**6 + 2, t, None, 200)], LOG)


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_scans_equal_windows_by_run(spark, n):
    log = random_log(spark, n, n).cache()
    us, w = F.unix_micros("ts"), Window.partitionBy("run_id").orderBy("ts", "item_id")
    plain = log.withColumn("gap_us", us - F.lag(us).over(w)).where("gap_us < 40000")
    assert sorted(map(str, request_log.spacing_violations(log, 0.04).collect())) == sorted(map(str, plain.collect()))
    errors = F.coalesce(F.sum(F.when(F.col("status") == 429, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = {r.item_id: (20, 15, 10)[min(2, r.e // 2)] for r in log.withColumn("e", errors).collect()}
    assert {r.item_id: r.allowed for r in request_log.allowed_concurrency(log, errors_per_step=2).collect()} == want
    edges = [(r.run_id, t, d) for r in log.collect() if r.ts and r.latency_s is not None for t, d in ((r.ts, 1), (r.ts + dt.timedelta(seconds=r.latency_s), -1))]
    peaks = {}
    for run in {e[0] for e in edges}:
        now, best = 0, 0
        for t in sorted({e[1] for e in edges if e[0] == run}):
            now += sum(d for q, s, d in edges if q == run and s == t) if n < 10 else 0
            best = max(best, now)
        peaks[run] = best
    got = {r.run_id: r.peak for r in request_log.peak_concurrency(log.where("ts is not null and latency_s is not null")).collect()}
    if n < 10:
        assert got == peaks
    else:
        per = log.where("ts is not null and latency_s is not null").select("run_id", F.explode(F.array(F.struct(us.alias("t"), F.lit(1).alias("d")), F.struct((us + F.round(F.col("latency_s") * 1000000).cast("long")).alias("t"), F.lit(-1).alias("d")))).alias("e")).groupBy("run_id", "e.t").agg(F.sum("e.d").alias("d"))
        running = per.withColumn("s", F.sum("d").over(Window.partitionBy("run_id").orderBy("t"))).groupBy("run_id").agg(F.max("s").alias("peak"))
        assert got == {r.run_id: r.peak for r in running.collect()}
    log.unpersist()


def test_one_run_is_spread_evenly(spark):
    log = spark.range(40_000).select(F.lit(1).alias("run_id"), F.timestamp_micros(F.col("id") * F.col("id")).alias("ts"))
    sizes = [r.n for r in scan.in_parts(log, F.unix_micros("ts"), 16).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.1 * 40_000 / 16


def test_templates_by_counters_and_by_join(spark, monkeypatch):
    """Both ways give the same rows: ties, repeated keys, null texts, more templates than counters."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["播", "客"]
    some = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 62])]) for _ in range(n))
    texts = spark.createDataFrame([(f"f{i % 3}", str(i), some(rng.randrange(1, 40)), 1) for i in range(200)] + [("f0", "0", "w1 w2", 1), ("f9", "1", None, 0), ("f9", "2", "", 0), ("f9", "3", "zzz", 0)], schemas.TRANSCRIPTS)
    known = spark.createDataFrame([(str(i), f"s{i % 2}", some(20), ["A"], "") for i in range(30)], schemas.TEMPLATES)
    rows = lambda: sorted(tuple(r) for r in notes.pick_template(texts, known).where("episode_id <> '0'").collect())
    counted = rows()
    monkeypatch.setattr(notes, "COUNTERS", 90)
    assert rows() == counted
    monkeypatch.setattr(notes, "MOST_PAIRS", 10)
    assert rows() == counted and len(counted) == 202 and ("f9", "3", "0", 0) in counted
    assert notes.pick_template(texts, known.limit(0)).where("template_id is not null or score <> 0").count() == 0
    assert notes.pick_template(texts.limit(0), known).count() == 0


def test_a_search_reads_the_asked_words(spark, tmp_path, monkeypatch):
    made = spark.createDataFrame([("f", str(i), f"common w{i} w{i + 1}\nx{i % 7}") for i in range(300)], "feed_id string, episode_id string, markdown string")
    index = note_index.NoteIndex(spark, str(tmp_path / "index"), 32)
    asked = spark.createDataFrame([(1, "w7 W8 common"), (2, "x3"), (3, "none"), (4, "")], "query_id long, text string")
    assert index.search(asked, 3).count() == 0
    index.add(made.where("cast(episode_id as int) < 100"))
    index.add(made)
    index.add(made.where("episode_id = '7'").withColumn("markdown", F.lit("quite other words")))
    index.add(made.where("episode_id <> '7'"))  # nothing new
    now = made.withColumn("markdown", F.when(F.col("episode_id") == "7", "quite other words").otherwise(F.col("markdown")))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", *KEY, "hits", "rank").collect())
    assert rows(index.search(asked, 3)) == rows(notes.search_notes(now, asked, 3)) != []
    one = spark.createDataFrame([("w250",)], "word string")
    everything = spark.createDataFrame([(f"w{i}",) for i in range(300)], "word string")
    assert scanned_bytes(index.postings(one)) < scanned_bytes(index.postings(everything)) / 8
    plan = physical_plan(index.postings(one))
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "word" in plan.split("PushedFilters: [")[1].split("]")[0]
    monkeypatch.setattr(note_index, "NAMED_WORDS", 1)
    assert rows(index.search(asked, 3)) == rows(notes.search_notes(now, asked, 3))


def test_a_batch_of_the_index_that_is_broken_off(spark, tmp_path, monkeypatch):
    made = spark.createDataFrame([("f", "1", "a b"), ("f", "2", "b c")], "feed_id string, episode_id string, markdown string")
    asked = spark.createDataFrame([(1, "b")], "query_id long, text string")
    index = note_index.NoteIndex(spark, str(tmp_path / "index"), 2)
    index.add(made.limit(1))
    found = {r.episode_id for r in index.search(asked, 9).collect()}

    def stop(*_):
        raise KeyboardInterrupt

    broken = made.withColumn("markdown", F.concat("markdown", F.lit(" zz yy xx ww")))
    with monkeypatch.context() as m:
        m.setattr(note_index.Staged, "__exit__", lambda *_: None)
        m.setattr(note_index.NoteIndex, "_list", stop)  # after the words, before the list of notes
        with pytest.raises(KeyboardInterrupt):
            index.add(broken)
    assert {r.episode_id for r in index.search(asked, 9).collect()} == found and len(found) == 1
    index.add(made)
    assert sorted((r.episode_id, r.hits) for r in index.search(asked, 9).collect()) == [("1", 1), ("2", 1)]
    stale = spark.createDataFrame([(1, "zz yy xx ww")], "query_id long, text string")
    assert index.search(stale, 9).count() == 0  # though some rows of the broken batch may stand under the same number
