import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, shard string, component string, class string, part string, line string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and very long texts, copies, near copies, ties, repeated rows, null ids, and columns whose names clash."""
    rng = random.Random(7)
    base = words(rng, 60)
    near = [w if i % 30 else "changed" for i, w in enumerate(base)]
    passage = words(random.Random(3), 30)
    texts = [
        None, "", " \t ", "one", "a b c", " ".join(base), " ".join(base), " ".join(near), " ".join(base + ["tail"]), "X " * 30,
        "\n".join(["same line of some words here"] * 3), " ".join(words(rng, 20_000)), "ÄÖ ß 漢字 <|im_end|> é x", " ".join(words(rng, 20) + passage + words(rng, 20)), " ".join(words(rng, 45)), " ".join(words(rng, 45) + passage),
    ]
    rows = [(i, t, "en", "src0" if i % 3 else None, None, 1, "s", "c", "k", "p", "l") for i, t in enumerate(texts)]
    rows += [(5, texts[5], None, "src1", 1, 1, "s", "c", "k", "p", "l"), (None, texts[5], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """(doc_id, text) with many near copies, shared passages and chance words."""
    rng = random.Random(11)
    shared, out = words(rng, 25), []
    for i in range(60):
        own = words(rng, rng.choice([2, 4, 8, 30, 80]))
        out.append(own + (shared if rng.random() < 0.4 else []))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(out[-1])
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other", "word"])
            out.append(copy + (["end"] if rng.random() < 0.3 else []))
    return spark.createDataFrame([(i * 3 + 1, " ".join(w)) for i, w in enumerate(out)], "doc_id long, text string")
