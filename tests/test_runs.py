"""Runs that are repeated, broken off, or meet bad texts: what is there stays, what is finished is not made again."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from castflow import schemas
from castflow.operators import enrich, transcripts
from castflow.plans import notes_flow
from castflow.plans.checks import physical_plan
from castflow.sources import files
from castflow.sources.merged import MergedTable


def note(feed, episode, text):
    return (feed, episode, "t", "skill", text)


def notes_at(spark, path):
    return {(r.feed_id, r.episode_id): r.markdown for r in files.read_notes(spark, path).collect()}


def test_notes_of_a_second_run_join_the_first(spark, tmp_path):
    path = str(tmp_path / "notes")
    assert notes_at(spark, path) == {}
    files.write_notes(spark.createDataFrame([note("f", "1", "a"), note("f", "2", "b"), note("g", "1", "c")], schemas.NOTES), path)
    files.write_notes(spark.createDataFrame([note("f", "2", "B"), note("f", "3", "d"), note("f", "3", "d")], schemas.NOTES), path)
    want = {("f", "1"): "a", ("f", "2"): "B", ("f", "3"): "d", ("g", "1"): "c"}
    assert notes_at(spark, path) == want and files.read_notes(spark, path).count() == 4
    files.write_notes(spark.createDataFrame([], schemas.NOTES), path)
    assert notes_at(spark, path) == want


def test_a_broken_off_write_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "notes")
    files.write_notes(spark.createDataFrame([note("f", "1", "a"), note("g", "1", "c")], schemas.NOTES), path)
    more = spark.createDataFrame([note("f", "1", "A"), note("f", "2", "b")], schemas.NOTES)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(MergedTable, "_commit", stop)  # after the rows, before the switch
        with pytest.raises(KeyboardInterrupt):
            files.write_notes(more, path)
    assert notes_at(spark, path) == {("f", "1"): "a", ("g", "1"): "c"}
    before = files.read_notes(spark, path)
    files.write_notes(more, path)
    want = {("f", "1"): "A", ("f", "2"): "b", ("g", "1"): "c"}
    assert notes_at(spark, path) == want
    assert {r.markdown for r in before.collect()} == {"a", "c"}  # a reader keeps what it began with
    files.write_notes(spark.createDataFrame([note("g", "2", "d")], schemas.NOTES), path)
    assert files.notes_table(spark, path).vacuum() == 2  # the first run's and the broken one's
    assert notes_at(spark, path) == want | {("g", "2"): "d"}
    files.write_notes(spark.createDataFrame([note("g", "3", "e")], schemas.NOTES), path)
    assert notes_at(spark, path) == want | {("g", "2"): "d", ("g", "3"): "e"}


def test_a_merge_reads_only_the_feeds_at_hand(spark, tmp_path):
    path = str(tmp_path / "notes")
    files.write_notes(spark.createDataFrame([note(f"f{i}", "1", "x" * 1000) for i in range(30)], schemas.NOTES), path)
    for i in range(3):
        files.write_notes(spark.createDataFrame([note("f7", str(i + 2), "y")], schemas.NOTES), path)
    runs = [d for d in os.listdir(tmp_path / "notes" / "data") if d.startswith("run=")]
    assert sorted(len(os.listdir(tmp_path / "notes" / "data" / r)) > 10 for r in runs) == [False, False, False, True]
    assert len(notes_at(spark, path)) == 33 and "dynamicpruning" in physical_plan(files.read_notes(spark, path)).lower()


@pytest.mark.parametrize("form", ["text", "json"])
def test_a_new_transcript_replaces_all_segments_of_its_episode(spark, tmp_path, form):
    path = str(tmp_path / form)
    files.write_segments(spark.createDataFrame([("f", "1", i, i, i + 1, "old\n\\") for i in range(3)] + [("f", "2", 0, 0, 1, "x")], schemas.SEGMENTS), path, form)
    files.write_segments(spark.createDataFrame([("f", "1", 0, 0, 3, "new"), ("f", "1", 1, 3, 4, "n2")], schemas.SEGMENTS), path, form)
    assert sorted((r.episode_id, r.seg_no, r.text) for r in files.read_segments(spark, path, form).collect()) == [("1", 0, "new"), ("1", 1, "n2"), ("2", 0, "x")]


def picky(bad, calls):
    def model(texts):
        calls.append(len(texts))
        if any(t in bad for t in texts):
            raise ValueError("bad text")
        return [t.upper() for t in texts]

    return model


@pytest.mark.parametrize("n,bad", [(1, 0), (1, 1), (100, 0), (100, 1), (100, 3), (97, 97)])
def test_bad_texts_stand_alone(n, bad):
    texts, calls = [f"t{i}" for i in range(n)], []
    gone = set(texts[:: max(1, n // max(bad, 1))][:bad])
    got = enrich.answers(picky(gone, calls), texts)
    assert got == [(None, "ValueError: bad text") if t in gone else (t.upper(), "ok") for t in texts]
    assert len(calls) <= 1 + max(1, bad) * 2 * math.ceil(math.log2(n) if n > 1 else 0) or bad == n and len(calls) == 2 * n - 1


def test_service_errors_and_odd_results():
    calls = []

    def down(texts):
        calls.append(len(texts))
        raise ConnectionError("down")

    assert enrich.answers(down, ["a"] * 50) == [(None, "ConnectionError: down")] * 50 and calls == [50]  # a service that is down isn't asked again
    assert enrich.answers(lambda ts: [None if t == "b" else t for t in ts], ["a", "b", "c"]) == [("a", "ok"), (None, "TypeError: NoneType for a text"), ("c", "ok")]
    assert [s for _, s in enrich.answers(lambda ts: ts[:1], ["a", "b"])] == ["ok", "ok"]  # fewer results than texts: asked one by one


def test_batches_are_bounded(spark):
    eps = spark.createDataFrame([("f", str(i), str(i), "t", "d" * (300 if i == 5 else 10), None, 1, None) for i in range(40)], schemas.EPISODES).coalesce(1)

    def model(texts):
        if len(texts) > 7 or len(texts) > 1 and sum(map(len, texts)) > 60:
            raise ConnectionError("too much at once")  # would not be asked in parts
        return texts

    rows = enrich.apply_model(eps.select("episode_id", "description"), "description", model, most_items=7, most_chars=60).collect()
    assert {r.status for r in rows} == {"ok"} and len(rows) == 40


N_TOKENS = re.compile(r"[㐀-鿿]|[^\s㐀-鿿]+")


def counted(log, bad=()):
    """A model that writes down each text it reads."""

    def model(texts):
        with open(log, "a") as f:
            f.writelines(f"{len(N_TOKENS.findall(t))}\n" for t in texts)
        if any(b in t for t in texts for b in bad):
            raise ValueError("bad")
        return [" ".join(N_TOKENS.findall(t)[:3]) for t in texts]

    return model


def read(log):
    try:
        with open(log) as f:
            return [int(x) for x in f.read().split()]
    except FileNotFoundError:
        return []


def test_levels_keep_the_budget_and_resume(spark, tmp_path):
    rows = [("f", e, i, "ok", f"e{e} part{i} " + "w " * (i % 5) + ("poison" if (e, i) == ("2", 7) else "")) for e, n in (("1", 40), ("2", 20), ("3", 1), ("4", 3)) for i in range(n)]
    rows += [("f", "5", 0, "ok", "long " * 100), ("f", "6", 0, "ok", None), ("f", "7", 0, "ok", "x"), ("f", "7", 1, "failed", None)]
    results = spark.createDataFrame([(f, e, i, 1, s, t) for f, e, i, s, t in rows], schemas.CHUNK_RESULTS)
    chunks = results.select("feed_id", "episode_id", "chunk_no", F.lit("c").alias("text"), F.lit(1).cast("long").alias("n_tokens"))
    path, one, two, three = (str(tmp_path / x) for x in ("levels", "one", "two", "three"))
    got = {r.episode_id: r for r in enrich.reduce_levels(chunks, results, 12, path, counted(one, ["poison"])).collect()}
    assert {e: r.status for e, r in got.items()} == {"1": "ok", "2": "waiting", "3": "ok", "4": "ok", "5": "ok", "6": "ok"}  # 7 waits for its chunk
    assert got["1"].n_levels >= 3 and got["1"].document == "e1 part0 e1" and got["3"].n_levels == 1 and got["6"].document == "" and got["2"].document is None
    assert max(read(one)) <= 12
    again = {r.episode_id: r for r in enrich.reduce_levels(chunks, results, 12, path, counted(two)).collect()}
    assert again["2"].status == "ok" and again["1"].document == got["1"].document
    assert 0 < len(read(two)) < 12 and max(read(two)) <= 12  # the failed group and what comes after it
    enrich.reduce_levels(chunks, results, 12, path, counted(three))
    assert read(three) == []
    stuck = enrich.reduce_levels(chunks, results.where("episode_id = '1'"), 12, str(tmp_path / "stuck"), lambda ts: ["a b c d e f g h i j k l"] * len(ts)).collect()
    assert [r.status for r in stuck] == ["not shorter"]


def test_the_flow_is_repeated_without_calls(spark, tmp_path):
    long = lambda e, extra="": f"title {e}\n" + " ".join(f"w{i}" for i in range(60)) + extra
    texts = spark.createDataFrame([("f", "1", "short one", 9), ("f", "2", long(2), 300), ("g", "3", long(3, " poison"), 300)], schemas.TRANSCRIPTS)
    known = spark.createDataFrame([("a", "s", "w1 w2", ["TL;DR", "More"], "")], schemas.TEMPLATES)
    path, between = str(tmp_path / "notes"), str(tmp_path / "work")
    logs = [str(tmp_path / f"log{i}") for i in range(3)]
    notes_flow.write_pending_notes(texts, known, path, between, 20, 100, 12, counted(logs[0], ["poison"]))
    first = notes_at(spark, path)
    assert set(first) == {("f", "1"), ("f", "2")}  # one chunk of the third failed
    notes_flow.write_pending_notes(texts, known, path, between, 20, 100, 12, counted(logs[1]))
    second = notes_at(spark, path)
    assert {k: second[k] for k in first} == first and second["g", "3"].startswith("# title 3\n## TL;DR\ntitle 3 w0")
    assert 0 < len(read(logs[1])) < len(read(logs[0])) / 2  # its failed chunk and its levels
    notes_flow.write_pending_notes(texts, known, path, between, 20, 100, 12, counted(logs[2]))
    assert read(logs[2]) == [] and notes_at(spark, path) == second


@pytest.mark.parametrize("spans,covered,longest", [
    ([(99_000, 100_000)], 1000, 99_000),  # the last second alone
    ([(0, 100_000), (1000, 2000), (90_000, 100_000)], 100_000, 0),  # nested: no silence
    ([(0, 40_000), (30_000, 60_000), (50_000, 55_000)], 60_000, 40_000),  # overlaps, silence at the end
    ([(60_000, 100_000), (0, 10_000)], 50_000, 50_000),  # not in order
    ([(50_000, 40_000), (20_000, 20_000)], 0, 100_000),  # no length
    ([(-5000, 10_000), (90_000, 200_000)], 20_000, 80_000),  # beyond the audio
])
def test_silence_is_not_covered(spark, spans, covered, longest):
    audio = spark.createDataFrame([("f", "1", 100_000), ("f", "2", 5), ("f", "3", None)], "feed_id string, episode_id string, duration_ms long")
    segs = spark.createDataFrame([("f", e, i, a, b, "x") for e in "13" for i, (a, b) in enumerate(spans)], schemas.SEGMENTS)
    got = {r.episode_id: r for r in transcripts.check_duration(segs, audio, 0.95, 30_000).collect()}
    one = got["1"]
    assert (one.covered_ms, one.max_gap_ms, one.complete, one.missing, one.gap) == (covered, longest, covered >= 95_000, False, longest > 30_000)
    assert got["2"].missing and got["2"].covered_ms is None and not got["2"].complete and not got["3"].complete
