"""The pipeline against its stages done by hand on a small table, and the registered queries against SQL."""

import os

import duckdb
import pytest
from helpers import documents, edited, prose

import __spark_entry__ as contract
import corpus_pipeline
from podium.llm import mixing, sql
from podium.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts 0 to 59, toxic ones from 100, copies from 200, passages from 300, personal data from 400."""
    base = str(tmp_path_factory.mktemp("tables"))
    item = prose(9000, 30)
    rows = [(i, prose(i, 100), "en", "ab"[i % 2]) for i in range(60)]
    rows += [(100 + i, prose(500 + i, 40) + " you idiot, worthless scum, pathetic loser " + prose(600 + i, 40), "en", "a") for i in range(30)]
    rows += [(200, prose(3, 100), "en", "b"), (201, edited(prose(4, 100), 1, 1), "en", "b"), (202, prose(3, 100), "en", "a")]
    rows += [(300, prose(700, 50) + " " + item, "en", "a"), (301, edited(item, 2, 2) + " " + prose(701, 50), "en", "b")]
    rows += [(400, prose(800, 60) + " mail me@x.org or +1 (988) 555-2485", "en", "a")]
    documents(spark, rows).write.parquet(f"{base}/documents.parquet")
    labels = [(r[0], 1, int(100 <= r[0] < 200)) for r in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages_take_effect(spark, folder):
    docs, ids = read_table(spark, folder, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    clean = set(range(60))
    assert ids[0] == clean | {200, 201, 202, 300, 301, 400}
    assert ids[1] == clean | {300, 301, 400}
    assert ids[2] == ids[3] == clean | {400}
    rows = corpus_pipeline.run(spark, folder)
    assert sorted(rows.collect(), key=str) == sorted(docs.collect(), key=str)
    texts = {r.doc_id: r.text for r in rows.collect()}
    assert texts.get(400, " mail [EMAIL] or [PHONE]").endswith(" mail [EMAIL] or [PHONE]")
    assert all(t == prose(i, 100) for i, t in texts.items() if i < 60)
    sizes = {i: (100 if i < 60 else 66, "ab"[i % 2] if i < 60 else "a") for i in ids[3]}
    total = {s: sum(n for n, x in sizes.values() if x == s) for s in "ab"}
    for s, weight in (("a", 1), ("b", 2)):
        taken = sum(sizes[r.doc_id][0] for r in rows.collect() if r.source == s)
        assert abs(taken - sum(total.values()) * weight / 3) <= 51
    assert max(r.repetition for r in rows.collect()) <= mixing.MAX_EPOCHS


def test_an_empty_table(spark, folder):
    docs = read_table(spark, folder, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(SMALL, table)}.parquet'")
    df = contract.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    theirs = con.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({contract.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(map(tuple, theirs), key=str)


def test_all_queries_are_registered():
    names = [n for n in contract.queries() if n.startswith("op") and n.split("_")[0][2:].isdigit()]
    assert sorted(int(n.split("_")[0][2:]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries()
