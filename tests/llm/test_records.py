"""Revisits, preference pairs and the pipeline."""

from __future__ import annotations

import gzip
import os

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import chat, queries, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_warc_revisits", "op8_preference_format"])
def test_query_equals_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(x[i] for i in at) for x in rel.fetchall()), key=repr)


H = [("Content-Type", "text/html"), ("ETag", "a")]
RECORDS = [
    (1, "response", 10, "http://www.X.com/p/?b=2&a=1&utm_source=z#f", 200, '"a"', None, "d1", H),
    (2, "revisit", 20, "https://x.com/p?a=1&b=2", 304, 'W/"a"', None, None, [("ETag", "a2"), ("Set-Cookie", "no"), ("Date", "now")]),
    (3, "response", 30, "x.com/p?a=1&b=2", 200, '"c"', "m", "d3", H),
    (4, "revisit", 40, "http://x.com/p?a=1&b=2", 304, '"a"', None, None, None),
    (5, "revisit", 40, "http://x.com/p?a=1&b=2", 304, None, None, None, []),
    (6, "revisit", 5, "http://x.com/p?a=1&b=2", 304, '"a"', None, None, []),
    (7, "revisit", None, "http://x.com/p?a=1&b=2", 304, '"a"', None, None, []),
    (8, "revisit", 50, None, 304, '"a"', None, None, []),
    (9, "response", 45, "x.com/p?a=1&b=2", 404, '"z"', None, "d9", []),
    (10, "revisit", 50, "x.com/p?a=1&b=2", 304, None, "m", "d3", [("vary", None)]),
    (10, "revisit", 50, "x.com/p?a=1&b=2", 304, None, "m", "d3", [("vary", None)]),
]
SCHEMA = f"record_id long, type string, ts long, url string, status int, etag string, last_modified string, digest string, headers {warc.HEADERS}"


@pytest.mark.parametrize("buckets", [2, 7])
def test_revisits(spark, buckets):
    out = warc.resolve_revisits(spark.createDataFrame(RECORDS, SCHEMA), buckets).collect()
    assert sorted((r["record_id"], r["status"], r["refers_to"]) for r in out) == sorted(
        [(2, "resolved", 1), (4, "mismatch", None), (5, "unverified", None), (6, "missing", None), (7, "missing", None), (8, "missing", None), (10, "resolved", 3), (10, "resolved", 3)], key=lambda x: x[0])
    two = next(r for r in out if r["record_id"] == 2)
    assert [(h["name"], h["value"]) for h in two["headers"]] == [("Content-Type", "text/html"), ("ETag", "a2"), ("Date", "now")]
    assert two["canonical"] == "x.com/p?a=1&b=2" and two["digest"] == "d1"


def test_revisits_of_one_url_equal_brute_force(spark):
    import random

    rng = random.Random(7)
    rows = [(i, rng.choice(["response", "revisit"]), rng.randrange(60), "h.com/a" if rng.random() < 0.8 else f"h.com/{i % 5}", 200, rng.choice(["x", "y", None]), None, rng.choice(["d", "e", None]), []) for i in range(400)]
    got = {r["record_id"]: r["refers_to"] for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA), 9).collect()}
    for r in rows:
        if r[1] == "revisit":
            old = max(((o[2], o[0], o) for o in rows if o[1] == "response" and o[7] and o[3] == r[3] and (o[2], o[0]) < (r[2], r[0])), default=None, key=lambda x: x[:2])
            want = None
            if old:
                pairs = [(a, b) for a, b in ((r[5], old[2][5]), (r[7], old[2][7])) if a and b]
                if pairs and all(a == b for a, b in pairs):
                    want = old[1]
            assert got[r[0]] == want


def test_warc_files(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    rec = lambda kind, body, n: b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Date: 2020-01-01T00:00:%02dZ\r\nWARC-Target-URI: http://a.com/\r\nWARC-Payload-Digest: sha1:Q\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, n, n, len(body), body)
    data = gzip.compress(rec(b"response", http, 1)) + gzip.compress(rec(b"revisit", b"HTTP/1.1 304 Not Modified\r\nETag: \"a\"\r\n\r\n", 2))
    (tmp_path / "x.warc.gz").write_bytes(data)
    df = warc.read_warc(spark, str(tmp_path))
    assert [bytes(r["payload"]) for r in df.where("type = 'response'").collect()] == [b"<p>hi</p>"]
    assert warc.resolve_revisits(df).first()["status"] == "resolved"


TURNS = "array<struct<role:string,text:string>>"


def test_preferences(spark):
    u, a, b = ("user", "q"), ("assistant", "good"), ("assistant", "bad")
    rows = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, None, [u]), (4, [], []), (5, [u, a, u], [u, a]), (6, [(None, None)], [("user", "")]), (7, [a], [u])]
    df = spark.createDataFrame([(i, c, r, "x") for i, c, r in rows], f"pair long, chosen {TURNS}, rejected {TURNS}, prompt string")
    got = {r["pair"]: r for r in chat.format_preferences(df).collect()}
    assert [got[i]["n_prefix"] for i in range(1, 8)] == [1, 2, 0, 0, 2, 1, 0]
    assert got[1]["prompt"] == "<|im_start|>user\nq<|im_end|>\n"
    assert got[1]["chosen_completion"] == "<|im_start|>assistant\ngood<|im_end|>\n"
    for r in got.values():
        for side in ("chosen", "rejected"):
            assert "".join(s["text"] for s in r[f"{side}_segments"]) == r[f"{side}_completion"]
    assert [s["text"] for s in got[1]["rejected_segments"] if s["train"]] == ["bad<|im_end|>\n"]
    assert got[2]["chosen_completion"] == "" and got[2]["chosen_segments"] == []


def test_conversations_with_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["turns"] for r in chat.conversations(df).collect()}
    assert [(t["role"], t["text"]) for t in got[1]] == [("user", ""), ("user", "a"), ("user", "a")] and len(got[None]) == 1
    assert chat.format_preferences(chat.with_earlier_reply(chat.conversations(df))).count() == 2
    assert chat.conversations(df.limit(0)).count() == 0


def test_preferences_run_in_the_jvm_alone(spark):
    plan = queries.op8_preference_format(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    seen, kept = docs, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        seen = stage(spark, seen, SF).cache()
        assert seen.columns == docs.columns, name
        kept.append(seen.count())
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] >= kept[4] > 0.7 * kept[0]
    out = p.STAGES[-1][1](spark, seen, SF)
    assert out.count() == kept[-1] and out.agg(F.min("n_tokens")).first()[0] > 0


def test_near_duplicate_stage_cuts_lineage_by_tables(spark, monkeypatch):
    """checkpoint() keeps the estimated size of the plan before it; its digits grow with each round of components in the driver."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    chain = [" ".join(f"w{k}" for k in range(6 * i, 6 * i + 80)) for i in range(20)]
    rows = [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(chain)]
    every = docs.union(spark.createDataFrame(rows, docs.schema))
    monkeypatch.setattr(type(docs), "checkpoint", lambda *a, **b: pytest.fail("checkpoint() of a table in a loop"))
    kept = [r["doc_id"] for r in p.drop_near_duplicates(spark, every, SF).collect()]
    assert 1000 in kept and len(kept) == len({*kept})


def test_pipeline_drops_texts_that_share_four_fifths_of_their_shingles(spark):
    import random

    import corpus_pipeline as p

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rng = random.Random(6)
    rows, alike = [], []
    for i in range(60):
        words = [f"{rng.choice('bcdfg')}{rng.randrange(4000)}" for _ in range(rng.randint(60, 200))]
        edited = list(words)
        for _ in range(1 + i % 8):
            edited[rng.randrange(len(words))] = "edited"
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, edited))
        alike.append(len(a & b) / len(a | b))
        rows += [(i, " ".join(words), "en", "s", 1), (1000 + i, " ".join(edited), "en", "s", 1)]
    kept = {r["doc_id"] for r in p.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), SF).collect()}
    assert kept >= set(range(60)) and sum(x >= 0.8 for x in alike) > 10
    assert not [i for i in range(60) if alike[i] >= 0.8 and 1000 + i in kept]
    assert all(1000 + i in kept for i in range(60) if alike[i] < 0.5)


def test_pipeline_with_odd_rows(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "The and of the with", None, "s", 3), (10**9, "", "en", "s", 0), (10**9 + 1, "123 456", "en", "s", 7)], docs.schema)
    rows = docs.union(odd).union(docs.limit(3))
    n = {}
    for name, stage in p.STAGES[:-1]:
        rows = stage(spark, rows, SF).cache()
        n[name] = rows.count()
    assert rows.where("text is null or doc_id >= 1000000000").isEmpty()
    ids = [r["doc_id"] for r in rows.collect()]
    assert len(ids) == len(set(ids)) and None in ids
