"""Chat formatting: whole conversations rendered, encoded once with offsets, and masked by turn spans.

``<|im_start|>role<|im_sep|>text<|im_end|>`` marks a turn.  Marks are single tokens added to the vocabulary, so token
borders always fall on text borders.  In roles and texts every ``<|`` gets one backslash more between its two
characters, with those that stand there already, so no text can hold a mark and unescaping gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castflow.llm import common as C

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARKS = (START, SEP, END)
FORMATTED = "conv_id long, formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"

_tokenizers: dict[str, object] = {}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def tokenizer(path: str):
    """The vocabulary with the marks as tokens of their own, offsets untrimmed."""
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_file(path)
        made.post_processor = _no_trim()
        made.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])
        _tokenizers[path] = made
    return _tokenizers[path]


def _no_trim():
    from tokenizers.processors import ByteLevel

    return ByteLevel(trim_offsets=False)


def render(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted) of rows(conv_id, turn, role, text): turns by turn, role and text; null role and text count as empty."""
    text = lambda c: _escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    one = F.concat(F.lit(START), text("role"), F.lit(SEP), text("text"), F.lit(END + "\n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), one.alias("one"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["one"]), "").alias("formatted"))


_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END), re.S)


def _spans(formatted: str, role: str) -> tuple[list[int], list[int]]:
    found = [m.span(2) for m in _TURN.finditer(formatted) if unescape(m[1]) == role]
    return [a for a, _ in found], [b for _, b in found]


def encode(rendered: DataFrame, vocabulary: str, role: str = "assistant") -> DataFrame:
    """FORMATTED: each conversation encoded once; a token bears loss if it lies in a text of the role.

    Turn spans are sorted, so the one that can hold a token is found by binary search.
    """

    def run(batch):
        size = 64  # conversations encoded together
        for at in range(0, batch.num_rows, size):
            some = batch.slice(at, size)
            texts = some.column("formatted").to_pylist()
            ids, lo, hi, loss = [], [], [], []
            for text, code in zip(texts, tokenizer(vocabulary).encode_batch(texts, add_special_tokens=False), strict=True):
                a, b = np.array(_spans(text, role), np.int64).reshape(2, -1)
                offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
                turn = np.searchsorted(a, offsets[:, 0], "right") - 1
                inside = (turn >= 0) & (offsets[:, 1] <= b[turn]) & (offsets[:, 0] < offsets[:, 1]) if len(a) else np.zeros(len(offsets), bool)
                ids.append(np.array(code.ids, np.int32))
                lo.append(offsets[:, 0].astype(np.int32))
                hi.append(offsets[:, 1].astype(np.int32))
                loss.append(inside)
            n = np.array([len(x) for x in ids], np.int64)
            yield pa.record_batch([some.column("conv_id"), some.column("formatted"), *(C.lists(np.concatenate(x), n) for x in (ids, lo, hi, loss))], ["conv_id", "formatted", "ids", "token_starts", "token_ends", "loss"])

    return C.per_batch(rendered, run, FORMATTED)


def write(rows: DataFrame, path: str, vocabulary: str, role: str = "assistant") -> None:
    """Formats rows(conv_id, turn, role, text) and writes FORMATTED to ``path``.

    A conversation is rendered whole, so it is the unit of work; a null conv_id is one conversation.
    Turns that repeat a number are put in order by role and text.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    encode(render(rows), vocabulary, role).write.parquet(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens from what was written.

    Turns are parsed from the formatted text; loss text is what the tokens under the mask cover.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"

    def run(batch):
        out = []
        for i in range(batch.num_rows):
            text = batch.column("formatted")[i].as_py()
            mask = batch.column("loss")[i].values.to_numpy(zero_copy_only=False).astype(bool)
            lo, hi = (batch.column(k)[i].values.to_numpy(zero_copy_only=False)[mask] for k in ("token_starts", "token_ends"))
            turns = _TURN.findall(text)
            whole = hashlib.sha256("".join(f"{unescape(r)}\n{unescape(t)}\n" for r, t in turns).encode()).hexdigest()
            # tokens of one character, or of neighbouring ones, form a run; runs are apart where a mark stands between them
            new = np.ones(len(lo), bool)
            new[1:] = lo[1:] > np.maximum.accumulate(hi)[:-1] if len(lo) else new[1:]
            first = np.flatnonzero(new)
            runs = [unescape(text[a:b]) for a, b in zip(lo[first].tolist(), np.maximum.reduceat(hi, first).tolist(), strict=True)] if len(first) else []
            loss = "".join(runs)
            out.append((batch.column("conv_id")[i].as_py(), len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(mask), int(mask.sum())))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
        kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return C.per_batch(spark.read.schema(FORMATTED).parquet(path).select("conv_id", "formatted", "token_starts", "token_ends", "loss"), run, schema)
