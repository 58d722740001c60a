"""Hard negatives, SimHash near duplicates and fill-in-the-middle against brute force and round trips, and on odd tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from castflow.llm import common, fill_in_middle, hard_negatives, simhash
from castflow.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id long, label int, vector array<double>, rank int, score long, block string"


def print_of(text, k=3):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def parts(prints):
    """The least fingerprint reachable from each by steps of at most three bits, from all pairs."""
    prints = sorted(set(prints))
    every, root = np.array(prints, np.uint64), {p: p for p in prints}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(every[i + 1 :] ^ every[i]) <= 3):
            a, b = find(p), find(prints[i + 1 + int(j)])
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def signed(p):
    return int(np.uint64(p).view(np.int64))


@pytest.mark.parametrize("table", ["corpus", "documents"])
def test_simhash_against_all_pairs(spark, corpus, table):
    docs = corpus if table == "corpus" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    prints = {r.doc_id: print_of(r.text) for r in docs.collect()}
    root, least, first = parts(prints.values()), {}, {}
    for i in sorted(prints):
        least.setdefault(root[prints[i]], i)
        first.setdefault(prints[i], i)
    got = {r.doc_id: (r.fingerprint, r.class_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", first[p], least[root[p]]) for i, p in prints.items()}
    assert table == "documents" or 1 < len(least) < len(first) < len(prints)


@pytest.mark.parametrize("small", [0, 5, 64, 10**6])
def test_simhash_links_of_crowded_cells(spark, small):
    """Dense groups, whose cells are large, give the same parts by pairs and by places, and no link without a chain of true ones."""
    rng, prints = random.Random(5), {0, 7, 15, (1 << 64) - 1, 1 << 63, 1 << 62 | 1 << 63 | 1}
    for size in (3, 40, 150, 250, 250):
        base, free = rng.getrandbits(64), rng.sample(range(64), rng.choice([4, 8, 10, 14]))
        prints |= {base ^ sum(1 << b for b in free if rng.random() < 0.4) for _ in range(size)}
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    with common.Scratch(spark) as held:
        links = [(r.a, r.b) for r in simhash.links(df, held, small).collect()]
    root = {signed(p): signed(p) for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = parts(prints)
    mine = {p: find(signed(p)) for p in prints}
    assert len(set(want.values())) == len(set(mine.values())) == len({(want[p], mine[p]) for p in prints}) and 5 < len(set(want.values())) < len(prints)


def test_simhash_on_odd_tables(spark, odd_docs):
    rows, got = odd_docs.collect(), simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(rows) and all((r.component_id is None) == (r.doc_id is None) for r in got)
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (0, 1, 2)} == {("0" * 16, 0)}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert simhash.keep_one(odd_docs).columns == odd_docs.columns and simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    long_text = " ".join(f"w{i * 7919 % 5003}" for i in range(300_000))  # more shingles than are counted at once
    twice = spark.createDataFrame([(1, "a b c d"), (1, "x y z"), (2, "X  Y\tz"), (3, "q"), (9, long_text)], "doc_id long, text string")
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(twice).collect()} == {(1, f"{print_of('a b c d'):016x}", 1), (1, f"{print_of('x y z'):016x}", 1), (2, f"{print_of('x y z'):016x}", 1), (3, f"{print_of('q'):016x}", 3), (9, f"{print_of(long_text):016x}", 9)}


def best_negatives(rows, every, n_positives=5, n_negatives=10, low=30, high=90):
    """All scores of each anchor, sorted."""
    dims = max(len(v) for *_, v in rows)
    vectors = [[math.floor(256 * x) for x in v] + [0] * (dims - len(v)) for *_, v in rows]
    out = set()
    for a, (anchor, label, _) in enumerate(rows):
        if anchor % every:
            continue
        score = [sum(x * y for x, y in zip(vectors[a], v, strict=True)) for v in vectors]
        order = sorted(range(len(rows)), key=lambda j: (-score[j], rows[j][0]))
        for p in [j for j in order if j != a and rows[j][1] == label][:n_positives]:
            fits = [j for j in order if rows[j][1] != label and low * score[p] <= 100 * score[j] <= high * score[p]]
            out |= {(anchor, rows[p][0], r + 1, rows[j][0], score[p], score[j]) for r, j in enumerate(fits[:n_negatives])}
    return out


@pytest.mark.parametrize("scale", [0.1, 1e4, 3e5])
def test_hard_negatives_against_all_scores(spark, scale):
    """Ragged vectors, ties of many copies, scores beyond doubles; rows that take no part; repeated ids."""
    rng, rows = random.Random(2), []
    for i in range(300):
        v = [rng.gauss(0, scale) * (4 if d < 5 else 1) for d in range(rng.choice([3, 40]))]
        rows.append((i - 50, rng.choice([0, 0, 0, 1, 2]), rows[0][2] if i % 4 == 3 else v))
    rows.append((6000, 1, []))
    odd = [(9000, None, [1.0]), (None, 1, [1.0]), (9100, 1, None), (9200, 1, [1.0, None]), (9300, 1, [math.nan]), (9400, 1, [math.inf]), (9500, 1, [1e30]), rows[7], (rows[8][0], 2 + rows[8][1], rows[8][2])]
    df = spark.createDataFrame([(*r, 1, 2, "b") for r in rows + odd], VECTORS)
    got = [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()]
    want = best_negatives(rows, 10)
    assert len(got) == len(want) > 500 and set(got) == want


def test_hard_negatives_in_blocks(spark, monkeypatch):
    """Anchors in several blocks, few together, and an index that omits much give the same rows."""
    for name, value in (("ANCHORS", 4), ("TOGETHER", 3), ("ROWS", 16), ("STEP", 4), ("OMITTED", 0.8)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(0, 0.2) / (d + 1) for d in range(12)]) for i in range(120)]
    df = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], VECTORS).repartition(3)
    got = {tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, 2, 4, 10, 80).collect()}
    assert got == best_negatives(rows, 10, 2, 4, 10, 80)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0 == hard_negatives.hard_negatives(df, F.lit(False)).count()


def test_offset_set_selects():
    """All three kinds of containers, at their borders."""
    rng, kinds = random.Random(1), set()
    for text in ("", "a", "é漢字 abc\n\n..", "x" * 70_000 + " " + "." * 200_000, "ab " * 50_000, "".join(rng.choice("ab .é") for _ in range(150_000)), "ab" * 32_768 + "c d", "a" * 65_536, "." * 65_536 + "a", "🙂a" * 40_000):
        want = [m.end() - 1 for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        found = fill_in_middle.boundaries(text)
        assert len(found) == len(want)
        asked = range(len(want)) if len(want) < 500 else [0, len(want) - 1, *rng.sample(range(len(want)), 500)]
        assert all(found.select(k) == want[k] for k in asked)
        kinds |= set(found.kinds)
    assert kinds == {"array", "bitmap", "run"}


def cut(doc_id, text):
    """The rule on a list of tokens."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    spm = h[3] % 100 < 20
    return len(tokens), "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_against_lists(spark, odd_docs):
    more = [(1000 + i, t) for i, t in enumerate(["a<", "<S", "x <S> y", "<P", "S><M", "🙂 é é\n", "\x00 a\r\n"] * 12)] + [(5000, "long " * 200_000)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows, sha = docs.collect(), lambda t: hashlib.sha256(t.encode()).hexdigest()
    key = lambda r: tuple(str(x) for x in r)
    made = fill_in_middle.transform(odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True))
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted(((r.doc_id, *cut(r.doc_id, r.text)) for r in rows), key=key)
    got = sorted((tuple(r) for r in fill_in_middle.digests(made).collect()), key=key)
    assert got == sorted(((r.doc_id, *(c := cut(r.doc_id, r.text))[:4], sha(c[4]), sha(r.text or "")) for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"} and fill_in_middle.transform(odd_docs.limit(0)).count() == 0


def test_simhash_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = Q.op12_simhash_near_dedup(spark, sf)
    assert got.columns[:1] == ["doc_id"] and {"fingerprint", "component_id"} <= set(got.columns)
    assert {(r.doc_id, r.fingerprint) for r in got.collect()} == {(r.doc_id, f"{print_of(r.text):016x}") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
