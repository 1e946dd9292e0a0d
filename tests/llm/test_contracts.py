"""Each query's columns, and a row for each row of its table, over the smallest tables."""

import hashlib
import os

import duckdb
import pytest

from larkspur.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    1: "page_id url text n_chars",
    2: "doc_id n_shingles component_id kept",
    3: "doc_id size source_size target taken",
    4: "doc_id held_out n_tokens n_known train_tokens base_score score",
    5: "doc_id held_out score predicted",
    6: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    7: "doc_id held_out score predicted",
    8: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    9: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    10: "slot shard record byte_offset n_ids ids_crc32 doc_ids",
}


@pytest.mark.parametrize("name", QUERIES)
def test_contract(spark, name):
    n = int(name[2:].split("_")[0])
    df = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[n].split()) <= set(df.columns)
    rows = df.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    if n == 1:
        assert len(rows) == spark.read.parquet(f"{FOLDER}/pages.parquet").count() and all(r.text for r in rows)
    elif n == 6:
        assert {r.doc_id for r in rows} == set(docs)
    elif n == 10:
        assert {d for r in rows for d in r.doc_ids} == set(docs)
    else:
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if n == 4:
        held = [r for r in rows if r.held_out]
        assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    if n == 9:
        ids = sorted(docs)
        for r in rows:
            t, nxt = docs[r.doc_id].text, docs[ids[(ids.index(r.doc_id) + 1) % len(ids)]].text
            k = len(t) // 4
            assert r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    if name in SQL:
        c = duckdb.connect()
        for f in os.listdir(FOLDER):
            c.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
        cur = c.execute(SQL[name])
        cols = [d[0] for d in cur.description]
        key = lambda r, at: tuple(str(at(r, x)) for x in sorted(cols))
        assert sorted(key(r, lambda r, x: r[cols.index(x)]) for r in cur.fetchall()) == sorted(key(r, lambda r, x: r[x]) for r in rows)
