"""Links, feed addresses and subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APPLE = "podcasts.apple.com"


def _host(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), F.try_parse_url(url, F.lit("HOST")))


def classify_links(links: DataFrame) -> DataFrame:
    """links with kind: ``apple`` (a page with a show id), ``feed`` (any other web address) or ``invalid``."""
    url = F.trim("url")
    apple = _host(url) == APPLE
    kind = F.when(apple & url.rlike("/id[0-9]+"), "apple").when(~apple & (F.coalesce(_host(url), F.lit("")) != ""), "feed").otherwise("invalid")
    return links.withColumn("kind", kind)


def resolve_links(links: DataFrame, directory: DataFrame) -> DataFrame:
    """links with kind, feed_url and resolved; a page's show id is looked up in directory(show_id, feed_url).

    Invalid links and pages of unknown shows stay, unresolved.
    """
    shows = directory.where("show_id is not null").groupBy(F.col("show_id").cast("string").alias("_show")).agg(F.min("feed_url").alias("_feed"))
    some = classify_links(links).withColumn("_show", F.when(F.col("kind") == "apple", F.regexp_extract("url", "/id([0-9]+)", 1)))
    feed = F.when(F.col("kind") == "feed", F.trim("url")).when(F.col("kind") == "apple", F.col("_feed"))
    return some.join(shows, "_show", "left").withColumn("feed_url", feed).withColumn("resolved", F.col("feed_url").isNotNull()).drop("_show", "_feed")


def upsert_subscriptions(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each feed address; of several the one that was first subscribed stays. A new snapshot, to be written elsewhere."""
    both = current.unionByName(incoming, allowMissingColumns=True).where("feed_url is not null")
    order = F.struct(F.coalesce("subscribed_at", F.lit("9999-01-01").cast("timestamp")), F.xxhash64(*both.columns))
    return both.groupBy("feed_url").agg(F.min_by(F.struct(*both.columns), order).alias("s")).select("s.*")
