"""Small document tables with awkward rows."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
WORDS = [a + b for a in ("st", "er", "on", "th", "ing", "re", "an", "ou") for b in ("a", "e", "il", "or", "um", "ent", "ish", "Ü")]


def sentence(dice, words):
    return " ".join(dice.choice(WORDS) for _ in range(words))


def edited(dice, text, share):
    return " ".join(dice.choice(WORDS) if dice.random() < share else w for w in text.split(" "))


def awkward_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    dice = random.Random(3)
    base = sentence(dice, 60)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base.upper(), None, None, None),
        (4, edited(dice, base, 0.02), "en", "a", 1),
        (5, None, "en", "a", None),
        (6, "", None, "b", 0),
        (7, " \t\n ", "en", "b", 4),
        (8, "one", "en", "b", 3),
        (9, "One", "en", "b", 3),
        (10, "a b c", "en", None, 5),
        (11, sentence(dice, 30_000), "en", "c", 1),
        (12, "x" * 70_000, "en", "c", 1),
        (13, "spam " * 9_000, "en", "c", 1),
        (14, "bob@mail.example.com +1 (555) 555-0199 4111 1111 1111 1111 10.0.0.255 \U0001f600 ü", "de", "d", 1),
        (15, 'token: "abcdefgh12" AKIAABCDEFGHIJKL 0123456789abcdef0123456789abcdef', "de", "d", 1),
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
    ]
    rows += [(100 + k, sentence(dice, dice.randrange(5, 200)), "en", f"s{k % 3}", k) for k in range(25)]
    rows += [(200 + k, edited(dice, rows[20][1], 0.01 * k), "en", "hot", k) for k in range(8)]
    return rows


def awkward(spark, clashing=True):
    df = spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)
    if clashing:
        names = ("vnode", "shard", "bucket", "score", "spans", "d", "e", "component", "fingerprint", "at", "gram", "path", "blob", "used", "head")
        df = df.withColumns({n: F.lit("other") for n in names})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
