"""Every registered query beside its SQL, on the smallest tables."""

from __future__ import annotations

import os

import compare
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from brindle.plans import catalog

catalog.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_like_sql(spark, sf_dir, con, name):
    assert compare.differences(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf_dir) == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_approximate_neighbours(spark, sf_dir):
    exact = {(r["query"], r["id"]) for r in catalog.QUERIES["q_knn_exact"](spark, sf_dir).collect()}
    found = {(r["query"], r["id"]) for r in catalog.QUERIES["q_knn_ivf"](spark, sf_dir).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_codes_find_most(spark, sf_dir):
    exact = {(r["query"], r["id"]) for r in catalog.QUERIES["q_knn_exact"](spark, sf_dir).collect()}
    found = {(r["query"], r["id"]) for r in catalog.QUERIES["q_knn_codes"](spark, sf_dir).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)


def test_passages_of_every_hit(spark, sf_dir):
    """Each document that a query hits is looked at, and a passage that is near enough stays whatever its document's rank."""
    from brindle.plans import retrieval_plans as plans

    pairs = {(r["query"], r["doc_id"]) for r in plans.hits(spark, sf_dir).collect()}
    rows = plans.passages(spark, sf_dir).collect()
    assert {(r["query"], r["doc_id"]) for r in rows} == pairs
    near = {(r["query"], r["doc_id"], r["chunk_id"]) for r in rows if r["score"] >= 0.7}
    assert {(r["query"], r["doc_id"], r["chunk_id"]) for r in catalog.QUERIES["q_score_threshold_all"](spark, sf_dir).collect()} == near
    for name in ("q_doc_passages_all", "q_threshold_or_topk_all"):
        assert {(r["query"], r["doc_id"]) for r in catalog.QUERIES[name](spark, sf_dir).collect()} == pairs


@pytest.fixture(scope="module")
def odd_dir(sf_dir, tmp_path_factory):
    """The tables, of whose documents a few are left, with some that have no word, ids that are null or stand twice, and one whose greatest weight, 323 / 640, is midway between two of 6 places."""
    place = tmp_path_factory.mktemp("odd")
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(f"{sf_dir}/{name}", place / name)
    docs = pq.read_table(f"{sf_dir}/documents.parquet")
    # Words of eight buckets, whose counts' squares sum to 640 squared.
    tie = " ".join(w for w, n in (("w0", 323), ("w1", 322), ("w2", 322), ("w3", 312), ("w5", 23), ("w6", 5), ("w7", 2), ("w8", 1)) for _ in range(n))
    texts = [(9001, "#$%&*"), (9002, " \n "), (9003, ""), (9004, None), (9005, tie), (9006, "two two three"), (9006, "three four"), (9006, None), (9007, "two two three"), (None, "one text"), (None, "one other text")]
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": "src1", "n_chars": len(t or "")} for i, t in texts]
    pq.write_table(pa.concat_tables([docs.slice(0, 20), pa.Table.from_pylist(rows, schema=docs.schema)]), place / "documents.parquet")
    return str(place)


@pytest.mark.parametrize("name", ["q_embed", "q_embed_cache"])
def test_embeddings_of_odd_documents_are_like_sql(spark, odd_dir, name):
    assert compare.differences(spark, compare.duck(odd_dir), catalog.QUERIES[name], catalog.ORACLE_SQL[name], odd_dir) == []
