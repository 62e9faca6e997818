import random
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from faultlens.llm import pii, toxicity
from tests.llm import samples
from tests.llm.test_minmax import brute as near_groups
from tests.llm.test_toxicity import labelled


def write(spark, folder, docs, labels=None, items=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = labels if labels is not None else spark.createDataFrame([], "doc_id LONG, toxic INT")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id LONG, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean and toxic texts, near copies, a copied benchmark item and personal data."""
    dice = random.Random(4)
    rows = labelled(120, seed=3)
    texts = {i: t for i, t, _ in rows}
    toxic = {i: x for i, _, x in rows}
    item = samples.sentence(dice, 40)
    clean = [i for i, x in toxic.items() if not x and len(texts[i].split()) > 60]
    extra = {200 + k: samples.edited(dice, texts[clean[0]], 0.005 * k) for k in range(4)}
    extra |= {300: samples.sentence(dice, 30) + " zz " + item + " zz " + samples.sentence(dice, 30)}
    extra |= {301: samples.sentence(dice, 30) + " mail bob@mail.example.com or +1 (555) 555-0199."}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in (texts | extra).items()], samples.SCHEMA)
    labels = spark.createDataFrame([(i, x) for i, x in toxic.items()], "doc_id LONG, toxic INT")
    return write(spark, tmp_path_factory.mktemp("corpus"), docs, labels, [(1, item)])


def test_each_stage_on_its_own_input(spark, corpus):
    folder, docs = corpus
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.store(stage(spark, docs, folder), name)
        after = docs.collect()
        kept[name] = {r.doc_id for r in after}
        if name == "toxicity":
            sample = toxicity.training_sample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            network = toxicity.train(*sample)
            score = {i: network.document_scores(toxicity.pa.array([r.text]))[0][0] for i, r in before.items()}
            assert kept[name] == {i for i, s in score.items() if s < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            groups = near_groups([(i, r.text) for i, r in before.items()], size=5)
            assert kept[name] == {i for i, (_, component) in groups.items() if i == component}
            assert len(kept[name]) < len(before)
        elif name == "decontamination":
            assert set(before) - kept[name] == {300}
        elif name == "personal_data":
            texts = {r.doc_id: r for r in after}
            assert "bob@" not in texts[301].text and "<EMAIL>" in texts[301].text and "<PHONE>" in texts[301].text
            assert all(r.n_chars == len(r.text) and not pii.base_spans(r.text) for r in after)
            assert kept[name] == set(before)
        if name != "packing":
            assert docs.columns == columns
    assert kept["packing"] == kept["personal_data"]


def test_run_gives_packed_sequences(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus[0]).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_awkward_rows(spark, tmp_path):
    folder, docs = write(spark, tmp_path, samples.awkward(spark), items=[(1, "no such words here at all")])
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.store(stage(spark, docs, folder), "stage")
    rows = docs.collect()
    # The row without an id goes as a copy of row 1; the one without id and text is like no other.
    assert [r.text for r in rows if r.doc_id is None] == [None]
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {1, 5, 6, 7, 8, 10, 11, 12, 13} <= set(ids)
    assert not {2, 3, 9} & set(ids)
    assert corpus_pipeline.STAGES[4][1](spark, docs, folder).count() >= len(rows)


def test_rows_are_told_apart_by_id_and_text(spark, tmp_path):
    """Missing and repeated ids: decisions hit the rows they were made for."""
    dice = random.Random(6)
    item, clean, other, base = (samples.sentence(dice, 50) for _ in range(4))
    leak = samples.sentence(dice, 20) + " " + item
    rows = [(None, leak), (None, clean), (7, other), (7, leak + " x"), (8, base), (9, base), (9, samples.sentence(dice, 60)), (None, base), (7, other), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], samples.SCHEMA).repartition(3)
    folder, docs = write(spark, tmp_path, docs, items=[(1, item)])
    stages = dict(corpus_pipeline.STAGES)
    apart = stages["near_duplicates"](spark, docs, folder)
    assert apart.columns == docs.columns
    left = sorted(map(str, ((r.doc_id, r.text) for r in apart.collect())))
    # Both texts with the item are near copies of each other at most; base stays once, with its smallest id.
    assert left == sorted(map(str, [(7, leak + " x"), (None, clean), (7, other), (8, base), (9, rows[6][1]), (None, None)]))
    kept = stages["decontamination"](spark, docs, folder).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [r for r in rows if item not in (r[1] or "")]))


def test_empty(spark, tmp_path):
    folder, _ = write(spark, tmp_path, samples.empty(spark))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_entry_without_the_text_operators(tmp_path):
    """Without the folder and the pipeline, the other queries are still there."""
    import subprocess

    root = Path(__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "checks"):
        (tmp_path / name).symlink_to(root / name)
    (tmp_path / "faultlens").mkdir()
    for part in (root / "faultlens").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "faultlens" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not any(k.startswith('op') for k in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
