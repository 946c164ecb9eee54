"""Small inputs with the awkward cases, and brute-force versions of the base rules."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, n int, items string, component string, at int"
AWKWARD = [None, "", " \n\t ", "one", "one two three", "The quick brown fox", "the QUICK brown fox", "éé ß ñandú   \U0001f600 x", "a b c d e f g h i j", "A b c d e f g h i j k", "x" * 3000, "tie tie tie tie tie tie"]


def frame(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), "s", len(t or ""), 1, "k", 2, "z", "c", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{int(r.random() ** 2 * vocabulary)}" for _ in range(n))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}
