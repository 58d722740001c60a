"""Feeds as bytes: encodings, length, breaks."""

import codecs

import pytest

from castflow.sources import feed_items, feeds
from castflow.streaming.increment import found_episodes, start_increment_stream

BYTES = "feed_id string, fetched_at timestamp, content binary"
ITEM = '<item><guid isPermaLink="false">{0}</guid><title><![CDATA[播客 & {0}]]></title><description> a &lt;b&gt; &#233; </description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><itunes:duration>01:02:03</itunes:duration><enclosure url="http://x/{0}.mp3?a=1&amp;b=2" length="1"/></item>'


def feed(n, encoding=None, tail="</channel></rss>"):
    head = f'<?xml version="1.0" encoding="{encoding}"?>\n' if encoding else ""
    return head + "<rss><channel><title>c</title>" + "\n".join(ITEM.format(i) for i in range(n)) + tail


def split(content):
    found = list(feed_items.items_of(content))
    return [x for x in found if isinstance(x, dict)], [x for x in found if isinstance(x, str)]


@pytest.mark.parametrize("encoding,python", [(None, "utf-8"), ("UTF-8", "utf-8"), ("gbk", "gbk"), ("GB2312", "gbk"), ("UTF-16", "utf-16"), (None, "utf-16"), ("utf-16", "utf-16-be"), ("Big5", "big5"), ("utf-8", "utf-8-sig"), ("Shift_JIS", "shift_jis")])
def test_encodings(encoding, python):
    text = feed(3, encoding).replace("播客", "中文").replace("&#233;", "e" if python != "utf-8" else "é")
    items, wrong = split(text.encode(python))
    assert wrong == [] and [i["guid"] for i in items] == ["0", "1", "2"]
    assert items[0]["title"] == "中文 & 0" and items[0]["description"] == f"a <b> {'é' if python == 'utf-8' else 'e'}" and items[0]["url"] == "http://x/0.mp3?a=1&b=2"


def test_chunks_cut_anywhere(monkeypatch):
    for encoding in ("utf-8", "gb18030", "utf-16"):
        content = feed(5, encoding).encode(encoding)
        whole = split(content)
        for chunk in (1, 2, 3, 7, 50):
            monkeypatch.setattr(feed_items, "CHUNK", chunk)
            assert split(content) == whole
        monkeypatch.undo()


@pytest.mark.parametrize("content,n,error", [
    (feed(4, tail="<item><title>cut").encode(), 4, "no element found"),  # cut off
    (feed(4, tail="<item></wrong></channel></rss>").encode(), 4, "mismatched tag"),
    (feed(2).encode()[:-40] + b"\xff\xfe" + feed(2).encode(), 1, "codec can't decode"),  # bytes that are no text
    (feed(1, "no-such-code").encode(), 0, "unknown encoding"),
    (b"<html><p>x</p></html>", 0, "no channel"), (b"", 0, "no element"), (None, 0, "no element"), (b"plain", 0, "syntax error"),
    (b"<rss><channel><title>t</title></channel></rss>", 0, None),
    (b"<rss><channel><item/><item><title>t</title><title>u</title><media:x><title>no</title></media:x></item></channel></rss>", 2, None),
])
def test_whole_items_stay(content, n, error):
    items, wrong = split(content)
    assert len(items) == n and (wrong == [] if error is None else len(wrong) == 1 and error in wrong[0])


def test_a_large_feed_and_a_table(spark):
    rows = [("big", None, feed(100_000).encode()), ("gbk", None, feed(3, "gbk", "<item><guid>9").replace("&#233;", "").encode("gbk")), ("none", None, None), ("page", None, b"<html/>")]
    docs = spark.createDataFrame(rows, BYTES)
    got = feed_items.parse_feed_bytes(docs)
    assert {(r.feed_id, r["count"]) for r in got.groupBy("feed_id").count().collect()} == {("big", 100_000), ("gbk", 3)}
    assert got.where("feed_id = 'big'").select("episode_id").distinct().count() == 100_000
    assert {r.feed_id for r in feed_items.broken_feeds(docs).collect()} == {"gbk", "none", "page"}
    plain = spark.createDataFrame([("f", None, feed(7))], "feed_id string, fetched_at timestamp, xml string")
    bytes_ = spark.createDataFrame([("f", None, feed(7).encode())], BYTES)
    assert sorted(map(tuple, feeds.parse_feeds(plain).collect())) == sorted(map(tuple, feed_items.parse_feed_bytes(bytes_).collect()))
    assert feed_items.feed_items(docs.limit(0)).count() == 0


def test_a_stream_of_bytes(spark, tmp_path):
    for name, content in (("f", codecs.BOM_UTF16_LE + feed(3).encode("utf-16-le")), ("g", feed(2, "gbk", "<item>").replace("&#233;", "").encode("gbk"))):
        (tmp_path / "in" / f"feed_id={name}").mkdir(parents=True)
        (tmp_path / "in" / f"feed_id={name}" / "x.xml").write_bytes(content)
    state = str(tmp_path / "state")
    for _ in range(2):
        start_increment_stream(feed_items.read_feed_bytes(spark, str(tmp_path / "in"), stream=True), state, str(tmp_path / "check"), 4).awaitTermination()
    assert sorted((r.feed_id, r.episode_id) for r in found_episodes(spark, state).collect()) == [("f", "0"), ("f", "1"), ("f", "2"), ("g", "0"), ("g", "1")]
