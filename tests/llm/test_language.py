import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from faultlens.llm import language
from tests.llm import samples

SOUNDS = {"aa": ("ka", "lo", "mi", "tu", "ne"), "bb": ("scht", "ung", "ver", "ein", "zu"), "cc": ("ção", "lh", "nh", "os", "eira"), "dd": ("пере", "ов", "ить", "на", "ка")}


def text_of(dice, name, words):
    return " ".join("".join(dice.choice(SOUNDS[name]) for _ in range(dice.randrange(1, 4))) for _ in range(words))


def corpus(dice, count=400, words=(5, 60)):
    return [(k, text_of(dice, name := dice.choice(list(SOUNDS)), dice.randrange(*words)), name, "s", 1) for k in range(count)]


def brute(texts, languages):
    """Every text encoded whole, window by window, with each dictionary."""
    found = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text) or not languages.names:
            found.append("und")
            continue
        data = language.letters(text)
        sizes = [sum(len(e.compress(data[k : k + 512])) for k in range(0, len(data), 512)) for e in languages.encoders()]
        found.append(languages.names[sizes.index(min(sizes))])
    return found


def test_held_out_accuracy_and_brute_force(spark):
    rows = corpus(random.Random(1))
    df = spark.createDataFrame(rows, samples.SCHEMA).repartition(4)
    out = {r.doc_id: r for r in language.languages_of(df).collect()}
    languages = language.learned(df)
    want = brute([r[1] for r in rows], languages)
    assert [out[k].lang_pred for k in range(400)] == want and sorted(languages.names) == sorted(SOUNDS)
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in out)
    right = [out[r[0]].lang_pred == r[2] for r in rows if out[r[0]].held_out]
    assert len(right) > 60 and np.mean(right) > 0.97
    sure = [out[r[0]].lang_pred == r[2] for r in rows if not out[r[0]].rejected]
    assert np.mean(sure) >= np.mean([out[r[0]].lang_pred == r[2] for r in rows])
    assert all(0 <= r.score <= 1 for r in out.values())


def test_only_text_decides(spark):
    """Held-out labels, source and doc_id change nothing; taught labels do."""
    rows = corpus(random.Random(2), 200)
    df = spark.createDataFrame(rows, samples.SCHEMA)
    one = {r.doc_id: r for r in language.languages_of(df).collect()}
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    spoiled = df.withColumn("lang", F.when(out, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    two = {r.doc_id: r for r in language.languages_of(spoiled).collect()}
    assert one == two


def test_whole_texts_count(spark):
    dice = random.Random(3)
    rows = corpus(dice)
    late = text_of(dice, "aa", 40) + " " + text_of(dice, "bb", 30_000)
    df = spark.createDataFrame([*rows, (402, late, None, "s", 1)], samples.SCHEMA)
    assert {r.doc_id: r for r in language.languages_of(df).collect()}[402].lang_pred == "bb"


def test_copies_and_rare_languages(spark):
    """A text that most rows of a language share does not crowd out the others, nor a frequent language a rare one."""
    dice = random.Random(4)
    rows = corpus(dice, 60) + [(1000 + k, "ka lo ka lo ka", "aa", "hot", 1) for k in range(900)]
    rows += [(5000 + k, "xyq wqz " + "qyx " * (k + 1), "rare", "s", 1) for k in range(4)]
    languages = language.learned(spark.createDataFrame(rows, samples.SCHEMA).repartition(7), size=8)
    taught = [r for r in rows if r[2] == "aa" and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    content = languages.dictionaries[languages.names.index("aa")]
    assert languages.names[0] == "aa" and "rare" in languages.names
    assert content.count(b"ka lo ka lo ka") <= 1 and sum(language.letters(r[1]) in content for r in taught) >= min(7, len(taught))


def test_awkward_rows(spark):
    rows = samples.awkward_rows()
    out = language.languages_of(samples.awkward(spark)).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score", "margin", "rejected"}
    by_id = {r.doc_id: r for r in out}
    assert by_id[5].lang_pred == by_id[6].lang_pred == by_id[7].lang_pred == "und" and by_id[5].score == 0 and by_id[5].rejected
    assert by_id[13].lang_pred in ("en", "de") and None in by_id
    digits = samples.plain(spark, ["12 34", "Ω", "abc"]).withColumn("lang", F.lit("x"))
    assert [r.lang_pred for r in sorted(language.languages_of(digits).collect())] == ["und", "x", "x"]


def test_nothing_learned(spark):
    assert language.languages_of(samples.empty(spark)).count() == 0
    unknown = samples.plain(spark, ["some text"]).withColumn("lang", F.lit(None).cast("string"))
    assert [(r.lang_pred, r.score) for r in language.languages_of(unknown).collect()] == [("und", 0.0)]


def test_ties_go_to_the_more_frequent():
    best, share, lead = language.decision(np.array([20, 20, 21]))
    assert best == 0 and 0.3 < share < 0.5 and lead == 0
    assert language.decision(np.array([7])) == (0, 1.0, 1.0)
