import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls, empty and blank texts, repeats, a long text, and columns whose names clash."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    rows = [(1, None), (None, "a b c d e f"), (None, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "a b c d e f"), (5, "a b c d e f"), (5, "other words in here today"), (6, long), (7, "é ñ\n\n日本 # $ <b>")]
    return spark.createDataFrame([(i, t, "x", None, 0, 1, 2, 3, "k") for i, t in rows], DOCS + ", list int, digest int, kept int, host string")


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def prose(rnd, n, vocab=400):
    return " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))


def edited(rnd, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
    return " ".join(w)


def rng(seed=1):
    return random.Random(seed)
