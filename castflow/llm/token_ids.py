"""Ids of whole texts by a vocabulary file of the tokenizers library, a batch at a time.

Where the file is a lower-casing byte-pair vocabulary with word ends whose pieces never reach over white space,
words are encoded once for a worker and remembered by a hash of their bytes; else each text is encoded
as it is.  Both give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

from castflow.llm import common as C

#: Words that a worker remembers at most (about 50 bytes each), and parts of words (about 200 bytes each).
MEMORY, PARTS = 1_000_000, 300_000
#: Bytes of text whose words are looked up together.
BLOCK = 4 << 20
#: What the fast way needs to be true of the file (fixed values of the format).
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of printable ASCII and Latin-1 letters, and how the file's pattern splits these once they are lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of this worker process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as a letter: printable bytes as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [(n["type"], n.get("pattern"), n.get("behavior"), n.get("invert"), n.get("add_prefix_space")) for n in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = (
            normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and cuts == [("Split", {"Regex": _SPLIT}, "Removed", True, None), ("ByteLevel", None, None, None, False)]
            and all(a["content"].startswith("<|") and not (a["lstrip"] or a["rstrip"]) for a in spec.get("added_tokens", []))
        )
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.parts.clear()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            shown = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            tokens = self.tokenizer.model.tokenize(shown)
            ids = self.parts[part] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        odd: list[int] = []
        known = self.parts.get
        for i, word in enumerate(words):
            # most words are letters that some word has had before, perhaps with a full stop or comma
            low = word.lower()
            ids = known(low)
            if ids is None and low[-1] in ".," and low[-2:-1].isalpha() and (ids := known(low[:-1])) is not None:
                ids = ids + self._part(low[-1])
            if ids is not None:
                out.append(ids)
            elif _PLAIN.fullmatch(word) and "<|" not in word:
                out.append(b"".join(map(self._part, _PARTS.findall(low))))
            else:
                out.append(b"")
                odd.append(i)
        if odd:
            for i, found in zip(odd, self.tokenizer.encode_batch([words[i] for i in odd], add_special_tokens=False), strict=True):
                out[i] = struct.pack(f"<{len(found.ids)}I", *found.ids)
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.keys) + len(keys) > MEMORY:
            self._forget()
        ids = self._words(words)
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = len(self.ids) + np.cumsum(count) - count
        at = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.first, self.count = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, flat])

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, rows = C.spans(data, offsets)
        n = len(offsets) - 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        hashes = C.hash_spans(data, starts, ends)
        keys, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > MEMORY:
                new[:] = True
                self._forget()
            raw = data.tobytes()
            self._learn(keys[new], [raw[a:b].decode() for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        first, count = self.first[at][which], self.count[at][which]
        before = np.cumsum(count) - count
        flat = self.ids[np.arange(int(count.sum())) + np.repeat(first - before, count)]
        return flat, np.bincount(rows, weights=count, minlength=n).astype(np.int64)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); a null text has none."""
        data, offsets = C.texts_of(column)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for row, end, some, at in C.chunks(data, offsets, BLOCK):
            if self.by_word:
                flat, n = self._block(some, at)
            else:
                raw = some.tobytes()
                each = [e.ids for e in self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], add_special_tokens=False)]
                n = np.fromiter(map(len, each), np.int64, len(each))
                flat = np.fromiter((x for e in each for x in e), np.uint32, int(n.sum()))
            ids.append(flat)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1
