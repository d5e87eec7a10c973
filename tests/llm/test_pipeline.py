from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidecue.llm import quality, queries, toxicity

from .conftest import SCHEMA, make_docs
from .test_dedup import brute_lines, brute_near, brute_substrings


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(9)
    docs = [(i, t, lang, s, n) for i, t, lang, s, n in make_docs(seed=11, n=60)]
    junk = [(5000 + i, " ".join(f"{rng.choice('ABCDEFG')}{rng.choice('XYZ')}!!" for _ in range(60)), "en", "s", 0) for i in range(40)]
    spark.createDataFrame(docs + junk, SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int(r[0] < 5000), 0) for r in docs + junk if r[1] and len(r[1]) > 30]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_equal_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    plain = lambda df: sorted((r["doc_id"], r["text"] or "") for r in df.collect())
    (names, stages) = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality", "lines", "near_duplicates", "substrings", "packing")

    good = stages[0](spark, docs, tables).cache()
    labels = spark.read.parquet(f"{tables}/labels.parquet").where(~toxicity.held_out())
    m = quality.fit(spark, docs, quality.ratings(labels), 3)
    graded = {r["doc_id"] for r in quality.grade_documents(docs, m).where("kept").collect()}
    assert {i for i, _ in plain(good)} == graded
    assert not any(i >= 5000 for i, _ in plain(good)) and good.where("doc_id < 5000").count() > 60

    lines = stages[1](spark, good, tables).cache()
    drop = brute_lines(plain(good), 1)
    words = lambda t: len(re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower()))

    def cut(i, t):
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in drop)
        return left if words(left) >= words(t) / 2 else t

    assert plain(lines) == [(i, cut(i, t)) for i, t in plain(good)] and drop
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0

    near = stages[2](spark, lines, tables).cache()
    kept = {i for i, (_, _, k) in brute_near(plain(lines), 5).items() if k}
    assert plain(near) == [x for x in plain(lines) if x[0] in kept]

    cuts = stages[3](spark, near, tables).cache()
    want = {x[0]: (x[1] - x[2]) for x in brute_substrings(plain(near), 13)}
    assert {i: len(t.split()) for i, t in plain(cuts)} == want
    for df in (good, lines, near, cuts):
        assert df.columns == docs.columns

    packed = stages[4](spark, cuts, tables).toPandas()
    assert dict(zip(packed.doc_id, packed.n_tokens, strict=True)) == want


def test_run_is_the_last_stage_and_takes_clashing_columns(spark, tables, tmp_path):
    out = corpus_pipeline.run(spark, tables)
    assert "batch" in out.columns and out.count() > 60
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({"bucket": F.lit(1), "digest": F.lit("x"), "sig": F.lit("y"), "group": F.lit("z"), "gone": F.lit(0)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns[-5:] == ["bucket", "digest", "sig", "group", "gone"]
    assert docs.limit(0).columns and docs.count() > 60


def test_stages_take_empty_tables_and_nulls(spark, tables):
    for rows in ([], [(None, None, None, None, None), (1, None, "en", "s", None), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, tables)
        assert docs.count() <= len(rows)


def test_every_query_runs_on_the_smallest_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    for name, query in queries.QUERIES.items():
        if name != "op9_pieces" or os.path.isdir(queries.TOKENIZERS):
            assert query(spark, "/root/testdata/sf0.001").count() > 0, name
