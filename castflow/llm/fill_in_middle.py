"""Fill-in-the-middle: each text is cut at two token boundaries and its parts change places.

A token is a run of letters or one other character, so every character belongs to a token.  The ends of a text's tokens are a set of
code point offsets, held as a compressed set in the manner of Roaring: a container for each 65,536 offsets, as sorted array,
bitmap or runs, whichever is smallest, and the cumulative cardinalities of the containers.  The end of the k-th token is found by
binary search for the container, then by a select inside it; no list of tokens is ever made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from castflow.llm import common as C

#: Offsets of one container.
SPAN = 1 << 16
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class OffsetSet:
    """A set of offsets, added in order a container's range at a time; ``select(k)`` is its k-th member, from 0."""

    def __init__(self):
        self.kinds, self.held, self.before = [], [], [0]

    def add(self, inside: np.ndarray) -> None:
        """inside: whether each of the next SPAN offsets (fewer at the end) is a member."""
        members = np.flatnonzero(inside)
        starts = members[np.diff(members, prepend=-2) > 1]
        n, runs = len(members), len(starts)
        if 4 * runs < min(2 * n, SPAN // 8):
            ends = members[np.diff(members, append=SPAN + 1) > 1]
            held = "run", (starts.astype(np.uint16), np.cumsum(ends - starts + 1))
        elif n <= SPAN // 16:
            held = "array", members.astype(np.uint16)
        else:
            bits = np.packbits(inside, bitorder="little")
            bits = np.pad(bits, (0, -len(bits) % 8)).view(np.uint64)
            held = "bitmap", (bits, np.cumsum(np.bitwise_count(bits), dtype=np.int64))
        self.kinds.append(held[0])
        self.held.append(held[1])
        self.before.append(self.before[-1] + n)

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, k: int) -> int:
        box = int(np.searchsorted(self.before, k, "right")) - 1
        return box * SPAN + self._inside(self.kinds[box], self.held[box], k - self.before[box])

    @staticmethod
    def _inside(kind: str, held, k: int) -> int:
        if kind == "array":
            return int(held[k])
        first, total = held
        at = int(np.searchsorted(total, k, "right"))  # the run or the word that holds the member
        k -= int(total[at - 1]) if at else 0
        if kind == "run":
            return int(first[at]) + k
        return at * 64 + int(np.flatnonzero(np.unpackbits(first[at : at + 1].view(np.uint8), bitorder="little"))[k])


def boundaries(text: str) -> OffsetSet:
    """The offset of the last character of each token of the text, in code points."""
    found = OffsetSet()
    for at in range(0, len(text), SPAN):
        points = np.frombuffer(text[at : at + SPAN + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        lower = points | np.uint32(32)
        letter = (lower >= 97) & (lower <= 122)
        here = min(SPAN, len(text) - at)
        more = np.append(letter[1:], False)[:here]
        found.add(~(letter[:here] & more))
    return found


def _draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits that the seed and the document's id decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arrange(text: str, draws: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, prefix length, middle length, output) of one text; lengths are null in the plain form."""
    ends = boundaries(text)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (ends.select(k - 1) + 1 if k else 0 for k in sorted(x % (n + 1) for x in draws[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text of an output; texts that hold a mark are plain, so the first of each mark is the true one."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs(doc_id, text).

    n: the text's tokens.  rate: per cent of the texts that are cut; spm: per cent of these with the suffix first.  A null text is the empty one, which stays
    plain, as does a text that holds a mark.  Rows that repeat a doc_id are cut each on its own, by the same numbers; a null doc_id draws
    as an empty one.  Other columns are not read.
    """

    names, kinds = zip(*(c.split() for c in SCHEMA.split(", ")), strict=True)
    types = [{"long": pa.int64(), "string": pa.string()}[k] for k in kinds]

    def rows(made):
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], names)

    def run(batch):
        made, size = [], 0
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            doc_id = doc_id.as_py()
            made.append((doc_id, *arrange(text.as_py() or "", _draws(seed, doc_id), rate, spm)))
            size += len(made[-1][-1])
            if size >= C.CHUNK_BYTES:  # long texts are not held together
                yield rows(made)
                made, size = [], 0
        if made:
            yield rows(made)

    return C.per_batch(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, SCHEMA)


def digests(made: DataFrame) -> DataFrame:
    """What ``transform`` made, with the hashes of output and text rebuilt from it in place of the output."""

    def run(batch):
        pairs = zip(batch.column("output"), batch.column("form"), strict=True)
        rebuilt = pa.array([hashlib.sha256(restored(o.as_py(), f.as_py()).encode()).hexdigest() for o, f in pairs], pa.string())
        output = pa.array([hashlib.sha256(o.as_buffer() or b"").hexdigest() for o in batch.column("output")], pa.string())
        keep = batch.schema.names[:-1]
        yield pa.record_batch([*(batch.column(c) for c in keep), output, rebuilt], [*keep, "output_sha256", "restored_sha256"])

    return C.per_batch(made, run, SCHEMA.replace("output string", "output_sha256 string, restored_sha256 string"))
