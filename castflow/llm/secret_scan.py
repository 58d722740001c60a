"""Secret scans: patterns that name a secret alone, and weak parts that count only together.

DataFrame functions only.  Base kinds are found on their own.  A credential has three parts: an identifier (``access``, or
an ``account`` like a mail address), a secret (``assign``, ``hex``, or a long token, ``key_part``) and an ``endpoint`` (a web address or IPv4 address).
account, key_part and endpoint are weak: everyday text holds them.  They are reported only if, within the scope of ``scope`` code points, a
complement stands (``COMPLEMENTS``): a key part needs an identifier or an endpoint, an account a secret, an
endpoint a secret or an access identifier.  Spans are joined by interval: each goes to its bucket of the
document and the complement to its own and both neighbours, so that no document's spans are all paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castflow.llm import common as C

#: Patterns of the base kinds; access and hex have the least length in the pattern, where that finds the same matches.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY_PART = r"[A-Za-z0-9/+_=-]{32,}"
ENDPOINT = r"https?://[A-Za-z0-9._:/-]{4,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?"
ACCOUNT = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
KINDS = ("assign", "access", "hex", "key_part", "endpoint", "account")
BASE = KINDS[:3]
#: What a weak kind needs nearby.
COMPLEMENTS = {"key_part": ("access", "account", "endpoint"), "endpoint": ("access", "assign", "hex", "key_part"), "account": ("assign", "hex", "key_part")}
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def found(text: Column, pattern: str, kind: str, keep=lambda match: F.lit(True)) -> Column:
    """Spans of the leftmost non-overlapping matches that pass, in code points: array of (start, rank, kind, end).

    What stands between the matches and the matches themselves give the places; texts without a match are not cut.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        one = F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(keep(part["match"]), F.concat(state["spans"], F.array(one))).otherwise(state["spans"]).alias("spans"))

    parts = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(matches), F.lit(0))), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(text.rlike(pattern), F.aggregate(parts, zero, step, lambda s: s["spans"])).otherwise(zero["spans"])


def _random_like(match: Column) -> Column:
    """Letters and digits, but not hexadecimal alone, which is a kind of its own."""
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & ~match.rlike("^[0-9a-f]+$")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, key_part, endpoint, account): the spans of each kind in each text."""
    text = F.col("_text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return rows.select(
        "doc_id",
        found(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("assign"),
        found(text, ACCESS, "access").alias("access"),
        found(text, HEX, "hex").alias("hex"),
        found(text, KEY_PART, "key_part", _random_like).alias("key_part"),
        found(text, ENDPOINT, "endpoint").alias("endpoint"),
        F.when(F.contains(text, F.lit("@")), found(text, ACCOUNT, "account")).otherwise(F.array().cast(SPANS)).alias("account"),
    )


def linked(rows: DataFrame, scope: int) -> DataFrame:
    """(row, span): weak spans with a complement whose gap to them is at most the scope.

    rows: (row, the kinds); only rows with two kinds of spans are cut into spans.
    """
    some = rows.where(sum((F.when(F.size(k) > 0, 1).otherwise(0) for k in KINDS), F.lit(0)) >= 2)
    spans = some.select("row", F.explode(F.concat(*KINDS)).alias("span"))
    # a span covers all buckets from its start to its end; its complement looks one bucket further each way
    bucket = lambda c: F.floor(c / scope)
    held = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.col("span.start")), bucket(F.col("span.end")))))
    wants = F.lit(None).cast("array<string>")
    for kind, needs in COMPLEMENTS.items():
        wants = F.when(F.col("span.kind") == kind, F.array(*map(F.lit, needs))).otherwise(wants)
    weak = spans.withColumn("wants", wants).where("wants is not null")
    weak = weak.withColumn("bucket", F.explode(F.sequence(bucket(F.col("span.start")) - 1, bucket(F.col("span.end")) + 1)))
    other = held.select("row", "bucket", F.col("span").alias("other"))
    near = F.array_contains("wants", F.col("other.kind")) & (F.col("other.start") <= F.col("span.end") + scope) & (F.col("span.start") <= F.col("other.end") + scope)
    # spans that overlap are one token seen as two kinds
    apart = (F.col("other.end") <= F.col("span.start")) | (F.col("span.end") <= F.col("other.start"))
    return weak.join(other, (weak["row"] == other["row"]) & (weak["bucket"] == other["bucket"]) & near & apart, "left_semi").select("row", "span").distinct()


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs(doc_id, text).

    spans lists ``kind:start:end`` of all spans by start and kind.  A null text counts as empty: no spans.
    Rows are scanned on their own, also if they repeat a doc_id.
    """
    # written once: the plain rows and both sides of the join would scan all texts again
    rows = C.save(candidates(docs.select("doc_id", "text")), "spans").withColumn("base", F.concat(*BASE))
    weak = sum((F.size(k) for k in COMPLEMENTS), F.lit(0)) > 0
    # a row is named by its document and a hash of its spans: rows of one doc_id with equal spans get equal results
    rows = rows.withColumn("row", F.when(weak, F.struct("doc_id", F.xxhash64(*KINDS).alias("h"))))
    added = linked(rows.where(weak).select("row", *KINDS), scope).groupBy("row").agg(F.collect_list("span").alias("added"))
    plain = rows.where(~weak).select("doc_id", *BASE, "base", F.lit(None).cast(SPANS).alias("added"))
    out = plain.unionByName(rows.where(weak).join(added, "row", "left").select("doc_id", *BASE, "base", "added"))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, BASE), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", F.coalesce("added", F.array().cast(SPANS)))).alias("spans"))
