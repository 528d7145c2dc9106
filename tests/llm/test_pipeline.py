"""The pipeline's stages in order against brute force on a small corpus, and their shape on the driver's tables."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
import pytest
from test_llm_operators import brute_components

from windlass.llm import mixing, quality, registry
from windlass.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == names, name
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("NOT lossless").count() == 0 and last.count() == docs.count()


def test_near_and_exact_stages_drop_all_but_one(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "other ")
    rows = [(1, base), (2, base + " "), (3, near), (4, " ".join(f"v{i}" for i in range(200))), (5, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact_stage(spark, docs, SF)
    assert {r.doc_id for r in exact.collect()} == {2, 3, 4, 5}
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, exact, SF).collect()} == {2, 4, 5}


def test_stages_decide_rows_without_an_id_of_their_own(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "other ")
    lone = " ".join(f"v{i}" for i in range(200))
    rows = [(None, base), (None, base), (7, base), (7, base), (7, lone), (None, near), (None, near), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact_stage(spark, docs, SF)
    assert exact.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in exact.collect()) == sorted([("7", base), ("7", lone), ("None", near), ("8", "None")])
    left = corpus_pipeline.near_stage(spark, docs, SF).collect()
    assert sorted(str(r.text) for r in left) == sorted([base, lone, "None", "None"])  # rows without words have no links


def test_run_equals_brute_force(spark, tmp_path):
    """All stages on documents with nulls, repeats, copies, near copies and long texts, each held against its plain form."""
    r = random.Random(12)
    pool = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(pool) for _ in range(r.randint(55, 300))) for _ in range(20)]
    near = [b.replace(" ", " x ", 1) for b in base[:6]]
    texts = [*base, *near, base[0] + "  ", base[1], None, "", "few words only", " ".join(["again"] * 90), " ".join(r.choice(pool) for _ in range(20_000))]
    rows = [(i, t, "en", ["a", "b", None][i % 3], 1) for i, t in enumerate(texts)] + [(3, base[3], "en", "a", 1), (None, base[4], "en", "b", 1), (None, "lone " + base[5][::-1], "en", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 20, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    steps, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, str(tmp_path)))
        steps.append(now.collect())

    good = {(x.doc_id, x.llr) for x in quality.quality_rules(docs, labels).where("kept").collect()}
    assert len(steps[0]) == sum(x.kept for x in quality.quality_rules(docs, labels).collect()) and {x.doc_id for x in steps[0]} == {i for i, _ in good}
    bare = lambda t: "".join((t or "").split())
    assert sorted(bare(x.text) for x in steps[1]) == sorted({bare(x.text) for x in steps[0]})
    for x in steps[1]:
        assert len(x.text) == max(len(y.text) for y in steps[0] if bare(y.text) == bare(x.text))
    numbered = list(enumerate(x.text for x in sorted(steps[1], key=lambda x: (x.doc_id is None, x.doc_id or 0))))
    groups = brute_components(numbered, 5, 8, 10)
    assert len(steps[2]) == len({g for _, g in groups.values()}) < len(steps[1])
    text_of = {}
    for i, t in numbered:
        text_of.setdefault(groups[i][1], set()).add(t)
    assert all(sum(x.text in g for x in steps[2]) == 1 for g in text_of.values())
    copies = {(x.doc_id, x.size): x.copies for x in mixing.mix_sources(spark.createDataFrame(steps[2], docs.schema)).collect()}
    want = sorted((str(x.doc_id), x.text) for x in steps[2] for _ in range(copies[x.doc_id, len(x.text.split())]))
    assert sorted((str(x.doc_id), x.text) for x in steps[3]) == want
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((str(x.doc_id), x.text_sha256) for x in steps[4]) == sorted((i, digest(t)) for i, t in want) and all(x.lossless for x in steps[4])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, steps[4]))


def test_run_on_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    import compare

    said = compare.compare(spark, compare.views(SF), name, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert ": same " in said, said
