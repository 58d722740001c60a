"""Laws and edge cases that the SQL does not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from castflow import schemas
from castflow.functions import storage
from castflow.operators import download, enrich, increment, notes, request_log, review, subscribe, transcripts, work
from castflow.plans.checks import physical_plan
from castflow.sources import feeds, files, state_files


def episodes(spark, rows):
    return spark.createDataFrame(rows, schemas.EPISODES)


def ep(feed="f", id_="1", title="t", when=None):
    return (feed, id_, id_, title, "One. Two.", when, 60, f"http://h.example/{id_}.mp3")


XML = '<rss><channel><title>c</title><item><guid isPermaLink="false">g1</guid><title><![CDATA[A & B]]></title><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><itunes:duration>01:02:03</itunes:duration><enclosure url="http://x/1.mp3"/></item><item><title>no guid</title></item></channel></rss>'


def test_feeds_keys_and_rejects(spark):
    docs = spark.createDataFrame([("a", None, XML), ("b", None, XML[:80]), ("c", None, ""), ("d", None, "<html><p>x</p></html>"), ("e", None, "<rss><channel><title>t</title></channel></rss>"), ("f", None, None)], schemas.FEED_DOCS)
    got = feeds.parse_feeds(docs).orderBy("episode_id").collect()
    assert {g.feed_id for g in got} == {"a"} and len(got) == 2 and all(g.episode_id for g in got)
    one = next(g for g in got if g.guid == "g1")
    assert (one.title, one.duration_s, one.enclosure_url, one.pub_date) == ("A & B", 3723, "http://x/1.mp3", dt.datetime(2024, 1, 1, 10))
    assert {r.feed_id for r in feeds.rejected_feeds(docs).collect()} == {"b", "c", "d", "f"}
    assert {r.feed_id for r in feeds.rejected_feeds(docs, most_chars=100).collect()} == {"a", "b", "c", "d", "f"}


def test_state_file_by_hand(spark, tmp_path):
    folder = tmp_path / "feed_id=s"
    folder.mkdir()
    (folder / "x.txt").write_text("# s\r\n## 待确认\r\n- [X] Title — Sum <!-- id:1 -->\r\n-  [ ] odd <!-- id:2 -->\n## 其他\n- [ ] t <!-- id:3 -->\n## 已转化\n  - [x] z <!-- id:4 -->\n")
    got = state_files.read_state(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(g.episode_id, g.zone, g.checked, g.title, g.summary) for g in got] == [("1", "pending", True, "Title", "Sum"), ("4", "converted", True, "z", None)]
    assert sorted(r.line for r in state_files.rejected_lines(spark, str(tmp_path)).collect()) == ["## 其他", "-  [ ] odd <!-- id:2 -->", "- [ ] t <!-- id:3 -->"]


def test_second_pull_adds_nothing(spark):
    old = dt.datetime(2024, 1, 1)
    pulled = episodes(spark, [ep(when=old), ep(title="new", when=old + dt.timedelta(1)), ep(id_="2")])
    once = increment.dedupe_episodes(pulled)
    assert {(r.episode_id, r.title) for r in once.collect()} == {("1", "new"), ("2", "t")}
    assert increment.new_episodes(once, once).count() == 0
    state = increment.add_pending(spark.createDataFrame([("f", "1", "confirmed", True, 1, "t", None)], schemas.STATE), pulled)
    assert {(r.episode_id, r.zone, r.checked) for r in state.collect()} == {("1", "confirmed", True), ("2", "pending", False)}
    assert sorted(map(tuple, increment.add_pending(state, pulled).collect())) == sorted(map(tuple, state.collect()))


def test_zones_never_go_back(spark):
    state = spark.createDataFrame([("f", str(i), z, c, i, "t", None) for i, (z, c) in enumerate([("pending", False), ("pending", True), ("confirmed", True), ("converted", True)])], schemas.STATE)
    done = spark.createDataFrame([("f", "2"), ("f", "3")], "feed_id string, episode_id string")
    once = review.advance_zones(state, done)
    assert [r.zone for r in once.orderBy("line_no").collect()] == ["pending", "confirmed", "converted", "converted"]
    twice = review.advance_zones(once, done.limit(0))
    assert [r.zone for r in twice.orderBy("line_no").collect()] == ["pending", "confirmed", "converted", "converted"]


def test_links(spark):
    links = spark.createDataFrame([(1, "https://podcasts.apple.com/x/id7?i=1"), (2, "http://a.example/feed"), (3, "nonsense"), (4, None), (5, "https://podcasts.apple.com/x"), (6, "https://podcasts.apple.com/x/id8")], "link_id long, url string")
    got = subscribe.resolve_links(links, spark.createDataFrame([("7", "http://f/7"), (None, "y")], "show_id string, feed_url string")).orderBy("link_id").collect()
    assert [g.kind for g in got] == ["apple", "feed", "invalid", "invalid", "invalid", "apple"]
    assert [g.feed_url for g in got] == ["http://f/7", "http://a.example/feed", None, None, None, None]


@pytest.mark.parametrize("n,mode", [(49_999, "skill"), (50_000, "map-reduce"), (50_001, "map-reduce")])
def test_mode_at_the_threshold(spark, n, mode):
    assert transcripts.decide_mode(spark.createDataFrame([("f", "1", "", n)], schemas.TRANSCRIPTS)).first().mode == mode


def test_chunks_join_to_the_text(spark):
    text = "  播客 notes 是 好 的 。 and   words\n"
    rows = spark.createDataFrame([("f", "1", text, 1), ("f", "2", "", 0), ("f", "3", None, 0)], schemas.TRANSCRIPTS)
    for budget in (1, 3, 100):
        got = transcripts.chunk_transcripts(rows, budget).orderBy("chunk_no").collect()
        assert "".join(g.text for g in got) == text and {g.episode_id for g in got} == {"1"} and all(1 <= g.n_tokens <= budget for g in got)
    segs = spark.createDataFrame([("f", "1", i, 0, 1, t) for i, t in enumerate(["a b c d e", "x", "y", None])], schemas.SEGMENTS)
    got = transcripts.chunk_segments(segs, 2).orderBy("chunk_no").collect()
    # a chunk ends where the tokens before a segment reach the next multiple of the budget; no segment is cut
    assert [(g.chunk_no, g.text) for g in got] == [(0, "a b c d e"), (1, "x"), (2, "y\n")]


def test_model_errors_go_to_the_retry_list(spark):
    chunks = spark.createDataFrame([("f", "1", i, t, 1) for i, t in enumerate("abc")], schemas.CHUNKS)

    def model(texts):
        if "b" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    results = enrich.map_chunks(chunks, model, concurrency=3).cache()
    good = {r.chunk_no for r in results.where("status = 'ok'").collect()}
    assert 1 not in good
    assert enrich.reduce_chunks(chunks, results).count() == 0
    again = work.chunks_to_retry(chunks, results, 3)
    assert {r.chunk_no for r in again.collect()} == {0, 1, 2} - good
    fixed = results.unionByName(enrich.map_chunks(again.drop("attempt"), lambda ts: [t.upper() for t in ts], attempt=2))
    assert enrich.reduce_chunks(chunks, fixed).first().document == "A\n\nB\n\nC"
    assert work.chunks_to_retry(chunks, fixed, 3).count() == 0


def test_corrections_longest_first(spark):
    text = spark.createDataFrame([("f", "1", "ab abc ab", 9), ("f", "2", None, 0)], schemas.TRANSCRIPTS)
    wrong = spark.createDataFrame([("f", "1", "ab", "X"), ("f", "1", "abc", "Y"), ("f", "1", "q", "Z")], "feed_id string, episode_id string, wrong string, right string")
    assert notes.apply_corrections(text, wrong).where("episode_id = '1'").first().text == "X Y X"
    assert {(r.wrong, r.hits) for r in notes.correction_report(text, wrong).collect()} == {("abc", 1), ("ab", 2)}
    for bad in ("", None):
        with pytest.raises(Exception, match="a correction needs a wrong word"):
            notes.apply_corrections(text, wrong.withColumn("wrong", F.lit(bad).cast("string"))).collect()


def test_templates_go_to_the_texts_and_texts_are_never_crossed(spark):
    texts = spark.createDataFrame([("f", "1", "alpha beta", 10), ("f", "2", None, 0)], schemas.TRANSCRIPTS)
    known = spark.createDataFrame([("b", "s", "beta alpha", ["A"], ""), ("a", "s", "gamma", ["A"], "")], schemas.TEMPLATES)
    got = notes.pick_template(texts, known)
    assert {(r.episode_id, r.template_id, r.score) for r in got.collect()} == {("1", "b", 2), ("2", "a", 0)}
    assert "MapInArrow" in physical_plan(got) and "CartesianProduct" not in physical_plan(got)
    asked = spark.createDataFrame([(1, "alpha"), (2, "ALPHA beta alpha"), (3, "none")], "query_id long, text string")
    found = notes.search_notes(texts.withColumnRenamed("text", "markdown"), asked, 1)
    assert {(r.query_id, r.episode_id, r.hits, r["rank"]) for r in found.collect()} == {(1, "1", 1, 1), (2, "1", 2, 1)}
    plan = physical_plan(found)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_request_log(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "n", i, t + dt.timedelta(seconds=s), 3.0, c) for i, (s, c) in enumerate([(0, 200), (1, 429), (3, 429), (10, 200)])]
    log = spark.createDataFrame(rows, "run_id long, kind string, item_id long, ts timestamp, latency_s double, status int")
    assert [r.item_id for r in request_log.spacing_violations(log, 2.0).collect()] == [1]
    assert request_log.peak_concurrency(log).first().peak == 2  # the first call ends as the third begins
    assert [r.allowed for r in request_log.allowed_concurrency(log).orderBy("ts").collect()] == [20, 20, 15, 10]
    one = log.withColumn("item_id", F.lit(7)).where("status = 429")
    assert (lambda r: (r.streak, r.delay_s))(request_log.retry_schedule(one).first()) == (2, 4.0)


def test_manifest_has_a_lane_for_each_host(spark):
    eps = episodes(spark, [ep(id_=str(i)) for i in range(4)] + [("f", "9", "9", "t", "d", None, 1, None)])
    keys = eps.select("feed_id", "episode_id")
    plan = download.download_manifest(keys, eps, keys.where("episode_id = '1'"), keys.where("episode_id = '2'"), 10).orderBy("seq").collect()
    assert [(p.episode_id, p.seq, p.offset_s) for p in plan] == [("0", 1, 0), ("3", 2, 10)]


def test_segments_and_metadata_files(spark, tmp_path):
    rows = [("f", "1", 0, 0, 5, "a\\n\nb\\"), ("f", "1", 1, 5, 9, "")]
    segs = spark.createDataFrame(rows, schemas.SEGMENTS)
    for form in ("text", "json"):
        files.write_segments(segs, str(tmp_path / form), form)
        assert sorted(map(tuple, files.read_segments(spark, str(tmp_path / form), form).select("feed_id", "episode_id", "seg_no", "start_ms", "end_ms", "text").collect())) == rows
    made = spark.createDataFrame([("f", "1", "t", "skill", "x"), ("g", "1", "t", "skill", "y")], schemas.NOTES)
    files.write_notes(made, str(tmp_path / "notes"))
    files.write_notes(made.where("feed_id = 'g'").withColumn("markdown", F.lit("z")), str(tmp_path / "notes"))
    assert {(r.feed_id, r.markdown) for r in files.read_notes(spark, str(tmp_path / "notes")).collect()} == {("f", "x"), ("g", "z")}


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Conf(dict):
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch(Session, "x")


def test_entry_survives_missing_modules(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    def fail(name):
        raise ModuleNotFoundError(f"No module named '{name}'")

    monkeypatch.setattr(importlib, "import_module", fail)
    with pytest.warns(UserWarning, match="without the queries"):
        assert "parse_feeds" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
