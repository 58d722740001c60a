"""The items of feed documents as bytes: any declared encoding, documents of any length, and the whole items before a break."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castflow.sources.feeds import episodes_of

#: Bytes that are decoded and parsed at once.
CHUNK = 1 << 20
#: Names under which bytes of a larger character set are sent.
WIDER = {"gb2312": "gb18030", "gbk": "gb18030", "iso-8859-1": "cp1252", "ascii": "utf-8", "us-ascii": "utf-8"}
MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"), (b"<\0", "utf-16-le"), (b"\0<", "utf-16-be"))
FIELDS = ("guid", "title", "description", "pubDate", "itunes:duration")
ITEMS = "feed_id string, fetched_at timestamp, item_no int, guid string, title string, description string, pubDate string, `itunes:duration` string, url string, error string"


def read_feed_bytes(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(feed_id, fetched_at, content) of files under ``path``/feed_id=.../; with stream, as a stream."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile")
    files = reader.schema("path string, modificationTime timestamp, length long, content binary, feed_id string").load(path)
    return files.select("feed_id", F.col("modificationTime").alias("fetched_at"), "content")


def encoding_of(content: bytes) -> str:
    """The encoding that the first bytes show or declare; UTF-8 where they say nothing."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return name
    declared = re.match(rb"\s*<\?xml[^>]*?encoding\s*=\s*[\"']([\w.:-]+)[\"']", content[:500])
    name = declared[1].decode("ascii").lower() if declared else "utf-8"
    return WIDER.get(name, name)


def _texts(content: bytes) -> Iterator[str]:
    """The decoded document, a chunk at a time; what stands before bytes that are no text comes first."""
    decoder = codecs.getincrementaldecoder(encoding_of(content))()
    for at in range(0, len(content), CHUNK):
        some = content[at : at + CHUNK]
        try:
            yield decoder.decode(some, at + CHUNK >= len(content))
        except UnicodeDecodeError as e:
            # the error counts in what was left of the chunk before and this one
            yield e.object[: e.start].decode(e.encoding, "ignore")
            raise


class _Reader:
    """Gathers items as the parser meets their parts; holds one item only."""

    def __init__(self):
        self.path, self.item, self.done, self.text, self.channel = [], None, [], None, False

    def start(self, name: str, attributes: dict[str, str]) -> None:
        self.path.append(name)
        if self.path == ["rss", "channel"]:
            self.channel = True
        elif self.path == ["rss", "channel", "item"]:
            self.item = {}
        elif self.item is not None and len(self.path) == 4:
            self.text = [] if name in FIELDS else None
            if name == "enclosure":
                self.item.setdefault("url", attributes.get("url"))

    def characters(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def end(self, name: str) -> None:
        if self.item is not None and len(self.path) == 4 and self.text is not None:
            self.item.setdefault(name, "".join(self.text).strip())
            self.text = None
        elif self.path == ["rss", "channel", "item"]:
            self.done.append(self.item)
            self.item = None
        self.path.pop()


def items_of(content: bytes | None) -> Iterator[dict | str]:
    """The items of a document in order, then what is wrong with it, if anything.

    A field that an item has twice counts once, the first time.  Markup inside a field counts as its text.
    """
    reader, parser = _Reader(), expat.ParserCreate()  # prefixes stay as they are written, declared or not
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.characters
    try:
        for text in _texts(content or b""):
            parser.Parse(text, False)
            yield from reader.done
            reader.done.clear()
        parser.Parse("", True)
        wrong = None if reader.channel else "no channel"
    except (expat.ExpatError, UnicodeError, LookupError) as e:
        wrong = f"{type(e).__name__}: {e}"[:200]
    yield from reader.done  # whole items before the break
    if wrong:
        yield wrong


def feed_items(feed_bytes: DataFrame) -> DataFrame:
    """A row for each item of (feed_id, fetched_at, content), and one with ``error`` alone for each document that is broken, cut off or no feed.

    A document is parsed as it is decoded, so a large one takes no more room than its bytes and a batch of its items.  Null and empty
    documents have an error and no items.
    """
    names = [c.split()[0].strip("`") for c in ITEMS.split(", ")]
    types = [pa.string(), pa.timestamp("us", "UTC"), pa.int32(), *[pa.string()] * 7]

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r.get(n) for r in found], t) for n, t in zip(names, types, strict=True)], names)

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for feed, when, content in zip(*(batch.column(c) for c in ("feed_id", "fetched_at", "content")), strict=True):
                of = {"feed_id": feed.as_py(), "fetched_at": when.as_py()}
                for number, item in enumerate(items_of(content.as_py())):
                    held.append(of | ({"error": item} if isinstance(item, str) else item | {"item_no": number}))
                    size += len(item if isinstance(item, str) else item.get("description") or "") + 200
                    if size > CHUNK:
                        yield rows(held)
                        held, size = [], 0
            if held:
                yield rows(held)

    return feed_bytes.select("feed_id", F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.col("content").cast("binary").alias("content")).mapInArrow(run, ITEMS)


def parse_feed_bytes(feed_bytes: DataFrame) -> DataFrame:
    """EPISODES, one row for each whole item, also of documents with a broken tail."""
    return episodes_of(feed_items(feed_bytes).where("error is null"))


def broken_feeds(feed_bytes: DataFrame) -> DataFrame:
    """(feed_id, fetched_at, error): the documents that are broken, cut off or no feed; their whole items are in parse_feed_bytes all the same."""
    return feed_items(feed_bytes).where("error is not null").select("feed_id", "fetched_at", "error")
