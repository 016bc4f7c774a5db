"""The queries on the smallest tables: their columns, and their SQL where they have it."""

import pytest

pytest.importorskip("affinis.llm")
duckdb = pytest.importorskip("duckdb")

from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from affinis.llm import bpe, langid, linededup, mixing, simhash_gray
from affinis.llm.common import table
from affinis.llm.queries import QUERIES, SQL, bpe_files

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
COLUMNS = {
    1: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    2: ["doc_id", "size", "source_size", "target", "taken"],
    3: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    4: ["query_id", "rank", "vec_id", "score"],
    5: ["doc_id", "fingerprint", "component_id"],
    7: ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    8: ["doc_id", "held_out", "lang_pred", "score"],
    9: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    10: ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    n = int(name[2:].split("_")[0])
    assert df.columns[: len(COLUMNS.get(n, []))] == COLUMNS.get(n, [])
    got = df.toPandas()
    if n != 4:
        assert sorted(got["doc_id"]) == sorted(r.doc_id for r in table(spark, DATA, "documents").select("doc_id").collect())
    if name in SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        want = con.execute(SQL[name]).fetchdf()
        key = sorted(want.columns)
        assert sorted(got.columns) == key
        assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()


def test_pipeline_is_its_stages(spark):
    """run() against the operators' plain decisions, on driver-side rows."""
    docs = table(spark, DATA, "documents")
    got = corpus_pipeline.run(spark, DATA)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mixing", "tokens"]
    pred = {r.doc.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, ["doc_id"]).collect()}
    kept = docs.where(F.col("doc_id").isin([i for i, (lang, s) in pred.items() if lang != "und" and s >= 0.5]))
    lines = {r.doc.doc_id: r for r in linededup.drop_repeated_lines(kept, ["doc_id", "source"]).collect()}
    rows = spark.createDataFrame([(i, r.text, r.doc.source) for i, r in lines.items()], "doc_id long, text string, source string")
    near = {r.id: r.component_id for r in simhash_gray.near_duplicates(rows).collect()}
    stays = rows.where(F.col("doc_id").isin([i for i, c in near.items() if i == c]))
    copies = {r.doc.doc_id: r["copies"] for r in mixing.plan_mix(stays, ["doc_id"]).collect()}
    path, pattern = bpe_files()
    own = bpe.Tokenizer(bpe.load_ranks(path), pattern)
    want = []
    for r in stays.collect():
        want += [(r.doc_id, tuple(next(own.encode_batch([r.text]))))] * copies[r.doc_id]
    assert sorted(want) == sorted((r.doc_id, tuple(r.ids)) for r in got.collect())


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns; no rows at all; and what is left in the shared folder."""
    from test_operators import SCHEMA, prose, rows

    from affinis.llm import common

    data = rows() + rows()[3:6] + [(None, None, None, None, None, "x", "y", "z", "w"), (200, prose("fr", 60_000, 4), "fr", "s1", None, None, None, None, None)]
    for name, some in (("odd", data), ("none", [])):
        spark.createDataFrame(some, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
    left = len(common._TABLES)
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert len(common._TABLES) == left
    assert not {r.doc_id for r in got} & {100, 101, 102, 103} and {104, 200} & {r.doc_id for r in got}
    assert all(r.n_tokens == len(r.ids) for r in got)
    docs = table(spark, str(tmp_path / "odd"), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "odd"))
        assert docs.columns == SCHEMA.replace(",", "").split()[::2]
        docs = common.cut_table(docs)
    per = {(r.doc_id, r.source): r["count"] for r in docs.groupBy("doc_id", "source").count().collect()}
    counted = {}
    for r in got:
        counted[r.doc_id, r.source] = counted.get((r.doc_id, r.source), 0) + 1
    assert counted == per and max(counted.values()) <= 4
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
