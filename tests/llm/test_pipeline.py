"""The registered queries against SQL, and the pipeline's stages on planted cases."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tallyline.llm.oracles import ORACLES
from tallyline.llm.queries import QUERIES

TABLES = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(TABLES), reason="given tables are not here")


@given
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, TABLES)
    result = connection.execute(ORACLES[name])
    columns = [entry[0] for entry in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(result.fetchall())


@given
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document(spark, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in QUERIES[name](spark, TABLES).select("doc_id").collect()) == ids


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, and one case of each kind that a stage removes."""
    random = np.random.default_rng(2)
    words = np.array(["".join(random.choice(list("aeioulnrst"), random.integers(3, 9))) for _ in range(900)])
    prose = lambda n: " ".join(random.choice(words, n))
    rows = [(n, "\n".join(prose(30) for _ in range(3))) for n in range(400)]
    labels = []
    for n in range(400):
        toxic = n % 4 == 0
        if toxic:
            text = rows[n][1].split(" ")
            for at in (3, 25, 50, 70):
                text[at] = "idiot" if at % 2 else "scumbag"
            rows[n] = (n, " ".join(text))
        labels.append((n, 1, int(toxic)))
    passage = prose(60)
    rows[1] = (1, rows[1][1] + "\n" + passage)
    rows[2] = (2, rows[2][1] + "\n" + passage)  # a passage in two documents
    rows.append((1000, rows[3][1]))  # an exact copy
    rows.append((1001, rows[5][1].replace("\n", " ")))  # a copy in one line
    item = prose(14)
    rows.append((1002, prose(20) + " " + item + " " + prose(20)))
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(n, t, "en", "src0", len(t)) for n, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept, texts = docs.columns, [], []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus).cache()
        rows = docs.collect()
        kept.append({r.doc_id for r in rows})
        texts.append({r.doc_id: r.text for r in rows} if "text" in docs.columns else rows)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    clean = {n for n in range(400) if n % 4} | {1000, 1001, 1002}
    assert len(kept[0] ^ clean) <= 4
    assert 1000 in kept[0] - kept[1]  # all of its lines are in the document it copies
    lines = [line for text in texts[1].values() for line in text.split("\n") if len(line.split()) >= 5]
    assert len(lines) == len(set(lines))
    assert not kept[2] & {1001} and kept[1] - kept[2] == {1001}
    assert kept[2] - kept[3] == {1002}
    assert kept[4] == kept[3] and all(r.decodes and r.n_tokens * 4 == len(r.tokens) for r in texts[4])


def test_run(spark, corpus):
    found = corpus_pipeline.run(spark, corpus)
    assert found.columns == ["doc_id", "n_tokens", "tokens", "decodes"] and 250 < found.count() < 305


def test_stages_of_nothing(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0
        assert stage(spark, odd, corpus).count() <= 2
