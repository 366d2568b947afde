"""Operators on small rows of known outcome."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import shutil
import signal
import sqlite3
import time
import tracemalloc
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import batches, chunking, health, history, library, models, neighbours, retrieval, sections, text_index, usage, vector_index
from brindle.operators.text_index import TextIndex
from brindle.operators.vector_index import VectorIndex
from brindle.sources import batch_files, library_files
from brindle.sources.store import Conflict, Store, replay, stage
from brindle.streaming import ingest
from brindle.streaming.ingest import stream_ingest


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_fixed_chunks(spark):
    docs = spark.createDataFrame([(1, "0123456789"), (2, "abcdefghijkl"), (3, ""), (4, "é🎉é")], "doc long, text string")
    found = rows(chunking.fixed(docs, "doc", "text", 5), "doc", "chunk_id", "chunk_count", "content", "byte_start", "byte_end")
    assert found == [
        (1, 1, 2, "01234", 0, 5), (1, 2, 2, "56789", 5, 10),
        (2, 1, 3, "abcde", 0, 5), (2, 2, 3, "fghij", 5, 10), (2, 3, 3, "kl", 10, 12), (4, 1, 1, "é🎉é", 0, 8),
    ]


def test_chunks_of_sections_lose_what_precedes_them(spark):
    text = "x" * 10 + "Ä" * 7 + "b" * 20
    docs = spark.createDataFrame([(1, text, len(text.encode()), 1)], "doc long, text string, n_bytes long, page_count long")
    found = spark.createDataFrame([(1, 0, 10, 0, 0), (1, 1, 24, 0, 0)], "doc long, section int, byte_index long, page_number long, level int")
    cut = rows(chunking.by_sections(sections.with_spans(found, docs), docs, 15), "chunk_id", "chunk_count", "content", "byte_start", "byte_end", "page_start", "page_end")
    assert cut == [(1, 3, "Ä" * 7, 10, 24, 1, 1), (2, 3, "b" * 15, 24, 39, 1, 1), (3, 3, "b" * 5, 39, 44, 1, 1)]


def test_body_font_takes_the_last_of_equal_runs(spark):
    marks = spark.createDataFrame([(1, 0, 0, 20.0, "A"), (1, 10, 1, 9.0, "A"), (1, 20, 1, 10.0, "A"), (1, 30, 1, 30.0, "A")], "doc long, byte_index long, page_number long, font_size double, font_name string")
    assert rows(sections.body_font(marks)) == [(1, 1, 10.0)]
    assert rows(sections.headings(marks), "byte_index") == [(30,)]


def test_sections_of_positions(spark):
    found = spark.createDataFrame([(1, 0, 10), (1, 1, 20)], "doc long, section int, byte_index long")
    asked = spark.createDataFrame([(1, 0), (1, 10), (1, 19), (1, 20), (1, 99), (2, 5)], "doc long, position long")
    assert rows(sections.section_of_positions(asked, found)) == [(1, 0, 0), (1, 10, 0), (1, 19, 0), (1, 20, 1), (1, 99, 1)]


def test_attribute_tables_are_not_broadcast(spark, sf_dir):
    """But for fields and types: files of the others are small and their rows many."""
    from brindle.plans import library_plans

    found = library.items(library_plans.attribute_tables(spark, sf_dir), library_plans.TYPES)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 4


def test_keep_first_and_removed(spark):
    items = spark.createDataFrame([("id1", "unique_a", 1), ("id2", "dup", 2), ("id3", "unique_b", 3), ("id4", "dup", 4)], "id string, title string, n int")
    assert rows(library.drop_duplicates_by_key(items, "title", "id", "n"), "id") == [("id1",), ("id2",), ("id3",)]
    assert library.duplicates_removed(items, "title").first()["n_removed"] == 1
    assert library.duplicates_removed(items.limit(0), "title").first()["n_removed"] == 0


def test_merge_never_updates(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert rows(library.insert_merge(old, new, "k", "v")) == [("a", 1), ("b", 3)]
    assert rows(library.insert_merge(None, new, "k", "v")) == rows(new)
    with pytest.raises(ValueError):
        library.delete_keys(old, new, "missing")
    with pytest.raises(ValueError):
        library.lookup(old, "missing", 1, "k")


def test_store_replay_and_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert not store.exists()
    with pytest.raises(ValueError):
        store.stats()
    new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    stage(new, str(tmp_path / "staged"))
    replay(store, str(tmp_path / "staged"), "k", "v")
    stage(new, str(tmp_path / "staged"))
    replay(store, str(tmp_path / "staged"), "k", "v")
    assert replay(store, str(tmp_path / "staged"), "k", "v") == 2
    assert rows(store.read()) == [("a", 1), ("b", 2)]
    assert store.insert(new.limit(0), "k", "v") == store.version() == 2
    store.delete(spark.createDataFrame([("a",)], "k string"), "k")
    assert rows(store.read()) == [("b", 2)]
    # Data without its metadata row is not seen.
    new.write.parquet(str(tmp_path / "store/data/unfinished"))
    assert store.version() == 3
    # What was staged went when it was stored.
    assert not (tmp_path / "staged").exists()
    assert rows(store.stats(), "n_rows", "version") == [(1, 3)]


def test_inserts_add_and_deletions_touch_what_they_must(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    part = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) as k", "id as v")
    store.commit(part(0, 10))
    first = store.last()[1]
    store.insert(part(5, 20), "k", "v")
    second = store.last()[1]
    assert second[:1] == first and len(second) == 2 and spark.read.parquet(f"{store.path}/{second[1]}").count() == 10
    store.delete(part(12, 14), "k")
    third = store.last()[1]
    assert third[0] == first[0] and third[1] not in second
    assert rows(store.read("v")) == sorted([(i,) for i in range(20) if i not in (12, 13)], key=repr)
    before = store.last()[1]
    store.delete(part(100, 101), "k")
    assert store.last()[1] == before
    with pytest.raises(ValueError):
        store.delete(part(0, 1), "v2")
    # Older versions' folders are still there, and many folders become one.
    assert rows(spark.read.parquet(f"{store.path}/{second[1]}"), "v") == sorted([(i,) for i in range(10, 20)], key=repr)
    assert store.compact(many=3) == store.version() and len(store.last()[1]) == 2
    store.compact(many=2)
    assert len(store.last()[1]) == 1 and store.read().count() == 18


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that comes second starts again from what the first left, and nothing is lost."""
    one, two = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    part = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) as k", "id as v")
    one.commit(part(0, 3))
    write, done = Store._write, []

    def slow(self, rows):
        found = write(self, rows)
        if not done:
            done.append(True)
            two.insert(part(2, 5), "k", "v")
        return found

    monkeypatch.setattr(Store, "_write", slow)
    assert one.insert(part(4, 7), "k", "v") == 3
    assert rows(one.read("v")) == [(i,) for i in range(7)]
    with pytest.raises(Conflict):
        one._publish(3, one.last()[1])


def test_report_of_broken_stores(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    found = health.report(store, 2)
    assert found.first()["directory_exists"] is False and rows(health.doctor(found), "symptom") == [("no store",)]
    (tmp_path / "empty").mkdir()
    assert rows(health.doctor(health.report(Store(spark, str(tmp_path / "empty")), 2)), "symptom") == [("the table cannot be read",)]
    good = Store(spark, str(tmp_path / "good"))
    good.commit(spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], ""), (3, [1.0], "c"), (4, None, "d")], "id long, vector array<double>, text string"))
    found = health.report(good, 2, {"text": str(tmp_path / "text"), "here": str(tmp_path / "good")})
    got = found.first()
    assert (got["accessible"], got["n_rows"], got["n_zero"], got["n_wrong"], got["n_empty"], got["indexes"], got["stored_version"], got["live_version"], got["errors"]) == (True, 4, 1, 2, 1, ["here"], 1, 1, {})
    assert got["n_bytes"] > 0
    assert rows(health.doctor(found), "symptom") == [("vectors of another dimension",), ("zero vectors",)]
    # A folder of the version is gone.
    shutil.rmtree(tmp_path / "good/data")
    broken = health.report(good, 2)
    assert broken.first()["accessible"] is False and "table" in broken.first()["errors"]
    assert rows(health.doctor(broken), "symptom") == [("the table cannot be read",)]


def test_kept_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish"), (3, "")], "id long, text string")
    index = TextIndex(spark, str(tmp_path / "text"), "id")
    assert index.create(docs, "text") and not index.create(docs.limit(0), "text")
    assert rows(index.postings(), "term", "id", "tf", "length") == [("blue", 2, 1, 3), ("fish", 1, 1, 2), ("fish", 2, 2, 3), ("red", 1, 1, 2)]
    assert rows(index.postings(spark.createDataFrame([("fish",), ("none",)], "term string")), "id") == [(1,), (2,)]
    queries = spark.createDataFrame([(7, "Fish? red")], "query long, query_text string")
    pairs = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "query long, id long")
    plain = rows(models.bm25(pairs, queries, docs, "id", "query", "query_text", "text"))
    assert rows(models.bm25(pairs, queries, docs, "id", "query", "query_text", "text", index)) == plain and plain[0][2] > plain[1][2] > plain[2][2] == 0


def plain_bm25(texts: dict[int, str], queries: list[tuple[int, str]], k: int) -> list[tuple]:
    """The best k of all documents, counted plainly."""
    cut = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in texts.items()}
    average, out = sum(map(len, cut.values())) / len(cut), []
    df = Counter(w for ws in cut.values() for w in set(ws))
    for q, text in queries:
        scores = []
        for i, ws in cut.items():
            own = [t for t in set(re.findall("[a-z0-9]+", text.lower())) if t in ws]
            if own:
                gains = (math.log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5)) * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / average)) for t in own)
                scores.append((-round(sum(gains), 6), i))
        out += [(q, i, rank) for rank, (_, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_text_index_skips_blocks_and_sees_what_changes(spark, tmp_path, monkeypatch):
    """As plain BM25 over all documents, and after a fifth was added and a twentieth went, and again; most blocks of rare words beside frequent ones are skipped."""
    monkeypatch.setattr(text_index, "RANGE", 8)
    rng = random.Random(5)
    made = lambda: " ".join(["the"] * rng.randrange(1, 4) + [f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(rng.randrange(3, 40))])
    texts = {i: made() for i in range(1000)}
    queries = [(q, " ".join(["The", *texts[q * 37].split()[4:9]])) for q in range(12)] + [(90, "nowhere"), (91, ""), (92, "the")]
    asked = spark.createDataFrame(queries, "query long, query_text string")
    frame = lambda held: spark.createDataFrame(sorted(held.items()), "id long, text string").repartition(3)
    index = TextIndex(spark, str(tmp_path / "index"), "id")
    index._add(frame({i: t for i, t in texts.items() if i < 800}).select("id", "text"), "text", 0)
    for held in (dict(list(texts.items())[:800]), {i: t for i, t in texts.items() if i % 20 != 3}, {i: t for i, t in texts.items() if i % 20 != 7}):
        index.sync(frame(held), "text")
        found = index.search(asked, 10, seeds=6)
        assert sorted(rows(found, "query", "id", "rank")) == plain_bm25(held, queries, 10)
        assert index.sync(frame(held), "text") == (0, 0)
        assert index.totals().first()["n_docs"] == len(held)
    found, report = index.search(asked, 1, seeds=2, with_report=True)
    assert sorted(rows(found, "query", "id")) == sorted(r[:2] for r in plain_bm25(held, queries, 1))
    of = {r["query"]: r.asDict() for r in report.collect()}
    assert sum(r["blocks_read"] for q, r in of.items() if q < 90) < 0.5 * sum(r["blocks"] for q, r in of.items() if q < 90)


def test_blocks_are_short_and_in_parts(spark, tmp_path):
    """A word of every document is a block for each range, in several folders."""
    index = TextIndex(spark, str(tmp_path / "index"), "id")
    index.create(spark.range(5000).selectExpr("id", "concat('every ', cast(id as string)) as text").repartition(2), "text")
    word = spark.createDataFrame([("every",)], "term string")
    held = index.rows(word).select("n", "part").collect()
    assert sum(r["n"] for r in held) == 5000 and max(r["n"] for r in held) <= text_index.RANGE and len({r["part"] for r in held}) > 1
    assert index.frequencies(word).first()["df"] == 5000


def test_blocks_of_a_range_are_few_rows(spark, tmp_path, monkeypatch):
    """However many words there are, a range is a row for each folder and one of its documents; terms and documents that are too many to be broadcast are found too."""
    monkeypatch.setattr(text_index, "RANGE", 8)
    texts = {i: [f"w{(i * 7 + j * j) % 997}" for j in range(60)] for i in range(100)}
    index = TextIndex(spark, str(tmp_path / "index"), "id")
    index.create(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string").repartition(2), "text")
    stored = spark.read.parquet(f"{index.path}/blocks/segment=0")
    ranges, parts = index.totals().first()["n_docs"] / 8, int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert stored.count() <= (ranges + 2) * (parts + 1) < index.rows().count()
    asked, some = texts[3][:20], [3, 50, 99]
    terms, keys = spark.createDataFrame([(t,) for t in asked], "term string"), spark.createDataFrame([(i,) for i in some], "id long")
    wanted = sorted({(t, i, texts[i].count(t), 60) for t in asked for i in some if t in texts[i]}, key=repr)
    df = sorted((t, sum(t in x for x in texts.values())) for t in set(asked))
    assert rows(index.postings(terms, keys), "term", "id", "tf", "length") == wanted and rows(index.frequencies(terms), "term", "df") == df
    monkeypatch.setattr(text_index, "FEW", 1)
    assert rows(index.postings(terms, keys), "term", "id", "tf", "length") == wanted and rows(index.frequencies(terms), "term", "df") == df


def test_a_search_keeps_few_documents_of_each_query(spark, tmp_path, monkeypatch):
    """Documents that all have a frequent word: no table of a search has a row for each query and document, and queries may be dealt to blocks."""
    index = TextIndex(spark, str(tmp_path / "index"), "id")
    index.create(spark.range(3000).selectExpr("id", "concat('every ', cast(id as string)) as text").repartition(2), "text")
    queries = spark.createDataFrame([(q, "every") for q in range(40)], "query long, query_text string")
    counts = []
    monkeypatch.setattr(text_index, "kept", lambda rows, keep=text_index.kept: (out := keep(rows), counts.append(out.count()))[0])
    found = rows(index.search(queries, 10), "query", "rank", "id")
    assert sorted(found) == [(q, r, r - 1) for q in range(40) for r in range(1, 11)]
    assert counts and max(counts) <= 40 * 11 * 4
    monkeypatch.setattr(text_index, "QUERIES", 7)
    assert sorted(rows(index.search(queries, 10), "query", "rank", "id")) == sorted(found)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_few_and_many_queries_find_the_same(spark, metric):
    rng = np.random.default_rng(3)
    vectors = [(int(i) % 150, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(400)]
    corpus = spark.createDataFrame(vectors, "id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v) for i, v in vectors[:30]], "query long, vector array<double>")
    few = rows(neighbours.nearest(queries, corpus, 7, metric), "query", "id", "score", "rank")
    assert few == rows(neighbours.nearest(queries, corpus, 7, metric, few=0), "query", "id", "score", "rank")
    assert len(few) == 210 and {r[3] for r in few} == set(range(1, 8))
    assert neighbours.nearest(queries.limit(0), corpus, 7, metric).count() == neighbours.nearest(queries, corpus.limit(0), 7, metric).count() == 0


def test_embedding_counts_words(spark):
    docs = spark.createDataFrame([(1, "One one, TWO"), (2, ""), (3, None), (4, "é 123 -- é")], "id long, text string")
    found = {r["id"]: r["vector"] for r in models.embed(docs, ["id"], "text").collect()}
    want = np.zeros(models.BUCKETS)
    for w in ("one", "one", "two"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:3], 16) % models.BUCKETS] += 1
    assert np.allclose(found[1], want / np.linalg.norm(want)) and found[2] == found[3] == [0.0] * models.BUCKETS
    assert np.isclose(np.linalg.norm(found[4]), 1) and models.embed(docs.limit(0), ["id"], "text").count() == 0


def test_what_an_embedding_task_holds_is_bounded(spark, monkeypatch):
    """Batches on their way to Python are bounded in bytes, and words that are counted at once in number."""
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    held = spark.range(0, 8000, 1, 1).selectExpr("split(repeat('word ', 800), ' ') as words").mapInArrow(sizes, "n long")
    assert held.agg(F.max("n")).first()[0] < 12 << 20
    monkeypatch.setattr(models, "WORDS", 10)
    lists = pa.array([["a"] * n for n in (4, 5, 2, 30, 0, 9)] + [None], pa.list_(pa.string()))
    parts = list(models.slices_of_words(pa.RecordBatch.from_arrays([lists], ["words"]), 0))
    assert [p.num_rows for p in parts] == [2, 1, 1, 3] and pa.concat_arrays([p.column(0) for p in parts]) == lists


def test_pieces_take_time_in_proportion(spark):
    text = "añ🎉b\n" * 100_000
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc long, text string")
    found = [r["content"] for r in chunking.fixed(docs, "doc", "text", 512).orderBy("chunk_id").collect()]
    assert "".join(found) == text and {len(x) for x in found[:-1]} == {512}
    start = time.time()
    spark.range(1).selectExpr("0L as doc", "repeat('abcdefghij', 800000) as text").select(F.size(chunking.pieces("text", 512)).alias("n")).first()
    assert time.time() - start < 20


def test_passages_and_their_sections(spark):
    """Errors as rows; a passage counts where its text first stands; what widens to nothing stays as it is."""
    queries = spark.createDataFrame([(1, "red fish swim")], "query long, query_text string")
    chunks = spark.createDataFrame([(10, 0, 100, "red fish swim"), (10, 1, 101, "blue bird"), (10, 1, 102, "red fish swim"), (20, 0, 200, "nothing alike"), (30, 0, 300, "red")], "doc long, section int, id long, content string")
    pairs = spark.createDataFrame([(1, 10), (1, 20), (1, 30)], "query long, doc long")
    failed = spark.createDataFrame([(30, "damaged")], "doc long, error string")
    found = retrieval.passages(pairs, queries, chunks, failed)
    got = {(r["doc"], r["id"]): (r["position"], r["error"]) for r in found.collect()}
    assert got == {(10, 100): (1, None), (10, 102): (2, None), (20, 200): (1, None), (30, None): (None, "damaged")}
    docs = spark.createDataFrame([(10, "red fish swim blue bird red fish swim"), (20, "nothing alike")], "doc long, text string").withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    sections = spark.createDataFrame([(10, 0, 0, None), (10, 1, 14, None)], "doc long, section int, byte_index long, parent int")
    assert rows(retrieval.first_occurrences(found, chunks, docs, sections), "doc", "id", "section") == [(10, 100, 0), (10, 102, 0)]
    wide = rows(retrieval.expanded(found, chunks, docs, sections), "doc", "section", "text")
    assert wide == [(10, 0, "red fish swim "), (20, None, "nothing alike")]
    summaries = docs.select("doc", F.lit("about").alias("summary"))
    prompt = {r["doc"]: r["prompt"] for r in retrieval.refine_prompts(found, queries, chunks, summaries).collect()}
    assert "red fish swim\n-----\nred fish swim" in prompt[10] and "about" in prompt[20] and 30 not in prompt


def test_places_in_text():
    text = "é" * 5 + "abcab🎉 abc" + "x" * 10
    assert retrieval.places_in_text(text, ["abc", "bcab", "🎉", "ab", "", "none", "é", "abc"]) == [10, 11, 15, 10, 0, None, 0, 10]
    assert retrieval.places_in_text("", ["a"]) == [None] and retrieval.places_in_text("a", []) == []


def test_many_passages_take_one_pass(spark):
    """A text of two megabytes and a thousand passages: time is that of one pass, not of a thousand."""
    body = " ".join(f"word{i % 9973}" for i in range(250_000))
    cut = [body[i : i + 2000] for i in range(0, len(body), 2000)]
    start = time.time()
    places = retrieval.places_in_text(body, cut)
    assert places == [body.find(c) for c in cut] and time.time() - start < 20
    docs = spark.createDataFrame([(1, "one two one"), (2, None)], "doc long, text string")
    found = spark.createDataFrame([(1, 7, "one"), (1, 8, "two"), (1, 9, "none"), (2, 6, "x")], "doc long, id long, content string")
    assert rows(retrieval.first_places(found, docs), "doc", "id", "position") == [(1, 7, 0), (1, 8, 4)]


def test_passages_of_long_pages(spark, sf_dir):
    """Pages of several thousand bytes are taken apart like others, and have passages from far on."""
    from brindle.plans import retrieval_plans as plans
    from brindle.sources import views

    pages = plans.asked_pages(spark, sf_dir)
    long = {r["doc"] for r in views.markers(spark, sf_dir).where("page_number >= 2").select("doc").distinct().collect()}
    found = pages.passages().collect()
    assert {(r["query"], r["doc"]) for r in found} == {(r["query"], r["doc"]) for r in pages.pairs.collect()}
    assert sum(r["doc"] in long and r["error"] is None for r in found) > 20


def test_refined_sections(spark):
    """One call a document; the answer is cut at its marks; without a section the passages stay, and a failing call is its row."""
    wide = spark.createDataFrame([(1, 10, 2, 5, 9, "second"), (1, 10, 0, 0, 5, "first "), (1, 20, None, None, None, "bare"), (1, 20, None, None, None, "also"), (2, 30, 0, 0, 1, "fails")], "query long, doc long, section int, start long, end long, text string")
    queries = spark.createDataFrame([(1, "what"), (2, "why")], "query long, query_text string")
    summaries = spark.createDataFrame([(10, "about"), (20, "more"), (30, "less")], "doc long, summary string")

    def model(prompt: str) -> str:
        if "fails" in prompt:
            raise RuntimeError("refused")
        assert prompt.index("first \n-----\nsecond") > prompt.index("about")
        return " one\n-----\n \u00a0 -----two-----"

    found = retrieval.refined(wide, queries, summaries, model)
    assert rows(found.where("error is null"), "query", "doc", "piece", "text") == [(1, 10, 0, "one"), (1, 10, 1, "two"), (1, 20, 0, "also"), (1, 20, 1, "bare")]
    assert rows(found.where("error is not null"), "query", "doc", "error") == [(2, 30, "RuntimeError: refused")]


def test_histories(spark):
    said = [(1, 0, '[{"Text": "hi"}, {"ToolCallRequest": {"id": "a", "tool_name": "find", "args": "x"}}]'), (1, 1, '[{"ToolCallRequest": {"id": "b", "tool_name": "get", "args": "y"}}]'), (1, 2, '[{"ToolCallResponse": {"id": "a", "tool_name": "find", "result": "z"}}]'), (1, 3, "broken")]
    items = history.contents(spark.createDataFrame(said, "c long, turn long, content string"), ["c", "turn"], "content")
    assert rows(items, "turn", "at", "kind", "id", "body") == [(0, 0, "Text", None, "hi"), (0, 1, "ToolCallRequest", "a", "x"), (1, 0, "ToolCallRequest", "b", "y"), (2, 0, "ToolCallResponse", "a", "z")]
    assert rows(history.tool_pairs(items, "c"), "id", "tool_name", "request", "response") == [("a", "find", "x", "z"), ("b", "get", "y", None)]


def test_values_of_tools(spark):
    """Any JSON is a value; what is no item is kept apart, one by one."""
    good = '{"ToolCallRequest": {"id": "a", "tool_name": "find", "args": {"deep": [1, {"x": "y"}]}}}'
    said = [(0, f'[{{"Text": "hi"}}, {good}, 7, {{"Text": 5}}, {{"Other": "x"}}, {{"ToolCallRequest": {{"id": 1, "tool_name": "f", "args": 2}}}}, {{"Text": "a", "Other": 1}}]')]
    said += [(1, '[{"ToolCallResponse": {"id": "a", "tool_name": "find", "result": null}}, {"ToolCallResponse": {"id": "b", "tool_name": "find"}}]'), (2, "broken ["), (3, '{"Text": "no array"}'), (4, None), (5, "[]"), (6, "[null]")]
    items = history.values(spark.createDataFrame(said, "turn long, content string").withColumn("c", F.lit(1)), ["c", "turn"], "content")
    found = {(r["turn"], r["at"]): (r["kind"], r["text"], r["v"], r["unreadable"] is not None) for r in items.withColumn("v", F.to_json("value")).collect()}
    assert found == {
        (0, 0): ("Text", "hi", None, False), (0, 1): ("ToolCallRequest", None, '{"deep":[1,{"x":"y"}]}', False), **{(0, k): (None, None, None, True) for k in range(2, 7)},
        (1, 0): ("ToolCallResponse", None, "null", False), (1, 1): (None, None, None, True), (2, None): (None, None, None, True), (3, None): (None, None, None, True), (6, 0): (None, None, None, True),
    }
    pair = history.value_pairs(items, "c").select("id", F.try_variant_get("args", "$.deep[1].x", "string").alias("x"), F.is_variant_null("result").alias("none")).collect()
    assert [tuple(r) for r in pair] == [("a", "y", True)]
    assert {(r["kind"], r["n"]) for r in history.value_schemas(items).collect()} == {("ToolCallRequest", 1), ("ToolCallResponse", 1)}


def test_conversations_are_saved_each_under_a_name(spark, tmp_path):
    messages = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    for day in ("2024-01-01", "2024-01-02"):
        batch_files.save_conversations(messages, F.timestamp_add("MINUTE", F.col("conv_id"), F.lit(f"{day} 00:00:00").cast("timestamp")), str(tmp_path / "saved"))
    assert len([p for p in (tmp_path / "saved").iterdir() if p.name.startswith("save=conversation_17")]) == 4
    assert rows(batch_files.conversations(spark, str(tmp_path / "saved")).groupBy("conv_id").count()) == [(1, 2), (2, 2)]


def test_library_files(spark, tmp_path):
    """Read in ranges of row ids, filtered by SQLite, with what cannot be read as rows."""
    folder = tmp_path / "library"
    rows_of = {"items": spark.range(1000).selectExpr("id as itemID", "concat('K', id) as key", "id % 3 as itemTypeID").repartition(2), "fields": spark.createDataFrame([(1, "title"), (2, None)], "fieldID int, fieldName string").coalesce(1)}
    assert library_files.write_library(rows_of, f"file://{folder}") == 3 == len(list(folder.iterdir()))
    (folder / "damaged.sqlite").write_bytes(b"no such thing" * 100)
    sqlite3.connect(folder / "other.sqlite").execute("CREATE TABLE elsewhere (x)")
    odd = sqlite3.connect(folder / "odd.sqlite")
    odd.execute("CREATE TABLE items (itemID, key, itemTypeID)")
    odd.executemany("INSERT INTO items VALUES (?, ?, ?)", [(5000, "good", 1), ("text", "bad", 1), (5001, None, None)])
    odd.commit()
    library_files.register(spark)
    read = spark.read.format("library_files").option("table", "items").option("partRows", 100).load(str(folder))
    assert read.rdd.getNumPartitions() >= 10
    good = read.where("_error is null").drop("_file", "_error")
    assert rows(good) == rows(rows_of["items"].unionByName(spark.createDataFrame([(5000, "good", 1), (5001, None, None)], "itemID long, key string, itemTypeID long")))
    failed = {(r["_file"].rsplit("/", 1)[1], r["_error"].split(":")[0]) for r in read.where("_error is not null").collect()}
    assert failed == {("damaged.sqlite", "DatabaseError"), ("other.sqlite", "OperationalError"), ("odd.sqlite", "ArrowInvalid")}
    some = good.where("itemID >= 10 and itemID < 20 and key is not null and itemTypeID in (0, 2) and key like 'K%' and length(key) = 3")
    assert rows(some, "itemID") == [(i,) for i in range(10, 20) if i % 3 != 1]
    # What is left to Spark: neither comparisons nor membership.
    left = re.search(r"Filter \((.*)\)\n", some._jdf.queryExecution().executedPlan().toString())[1]
    assert "itemID" not in left and "itemTypeID" not in left and "StartsWith" in left
    tables, errors = library_files.library_tables(spark, str(folder))
    assert rows(tables["fields"]) == [(1, "title"), (2, None)] and errors.where("table = 'items'").count() == 3


def test_authors_of_some_items(spark):
    creators = spark.createDataFrame([(1, 2, "B", "b"), (1, 1, "A", "a"), (2, 1, "C", None)], "item long, place int, last_name string, first_name string")
    assert rows(library.authors(creators)) == [(1, ["A, a", "B, b"]), (2, ["C"])]
    assert rows(library.authors(creators, spark.createDataFrame([(2,), (2,)], "item long"))) == [(2, ["C"])]


def test_hash_cache(spark):
    cache = spark.createDataFrame([("same", "p", "m", 1), ("later", "p", "m", 9), ("model", "p", "x", 9), ("other", "p", "m", 1)], "hash string, provider string, model string, seq long")
    items = spark.createDataFrame([("same",), ("later",), ("model",), ("new",)], "hash string")
    inserted = spark.createDataFrame([("new",), ("model",)], "hash string")
    merged = rows(batches.merged_cache(cache, items, inserted, 5, "p", "m"))
    assert merged == [("later", "p", "m", 9), ("model", "p", "m", 5), ("new", "p", "m", 5), ("other", "p", "m", 1), ("same", "p", "m", 5)]


def test_result_lines(spark, tmp_path):
    lines = [
        '{"custom_id": "a", "response": {"body": {"data": [{"embedding": [1.0, 2.0]}, {"embedding": [9.0]}]}}}', '{"custom_id": "b", "error": {"message": "no"}}',
        '{"custom_id": "c", "response": {"body": {"data": []}}}', "not json", '{"custom_id": ',
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    good, bad = batch_files.read_results(spark, str(tmp_path / "r.jsonl"))
    assert rows(good) == [("a", [1.0, 2.0]), ("c", [])] and rows(bad) == [("b", "no")]


def test_batch_logs(spark, tmp_path):
    log = '{"batch_id": "%s", "provider": "p", "model": "m", "items": [{"library_key": "1"}]}'
    for name, content in (("batch_2.log", log % "two"), ("batch_10.log", log % "ten"), ("notes.log", log % "no"), ("batch_3.log", "broken")):
        (tmp_path / name).write_text(content)
    assert [(r["seq"], r["batch_id"]) for r in batch_files.pending(spark, str(tmp_path)).collect()] == [(10, "ten"), (2, "two")]


def test_long_conversations_are_saved_in_runs(spark, tmp_path):
    messages = spark.range(2500).selectExpr("7L as conv_id", "id as turn", "'user' as role", "'hi' as text")
    saved = batch_files.saved(messages, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    saved.write.json(f"{tmp_path}/conversations")
    found = batch_files.conversations(spark, f"{tmp_path}/conversations").collect()
    assert sorted((r["part"], len(r["history"])) for r in found) == [(0, 1000), (1, 1000), (2, 500)]
    assert sorted(m["turn"] for r in found for m in r["history"]) == list(range(2500))


def test_text_functions(spark):
    cases = {"Compare @symbols.pdf with @subtables.pdf": ["symbols.pdf", "subtables.pdf"], '@"two words.pdf" x': ["two words.pdf"], "me@mail.com": [], "@ @": [], '@"open': ['"open'], '@"open name x': ['"open'], '@"" @a\u3000@b': ["a", "b"], '@"x@y" z': ["x@y"], '@a"b" @"c"d': ['a"b"', "c"]}
    for text, want in cases.items():
        assert spark.createDataFrame([(text,)], "t string").select(T.mentions(F.col("t"))).first()[0] == want
    none, two = [], [0, 300]
    ends = [("a INTRODUCTION b", none, 2), ("x" * 1200, none, 1000), ("é" * 600, none, 1000), ("x" + "é" * 600, none, 999), ("short", none, 5), ("x" * 1200, two, 300), ("x" * 1100 + "introduction", none, 1000), ("🎉" * 300 + "x", none, 1000), ("x" + "🎉" * 300, none, 997)]
    for text, starts, want in ends:
        df = spark.createDataFrame([(text, starts)], "t string, s array<bigint>")
        assert df.select(T.summary_end(F.col("t"), F.col("s"))).first()[0] == want, text[:5]
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1536: "1.5 KB", 5 << 20: "5.0 MB", 3 << 30: "3.0 GB", 2 << 40: "2.0 TB"}
    for n, want in sizes.items():
        assert spark.range(1).select(T.bytes_text(F.lit(n))).first()[0] == want
    assert spark.range(1).select(T.after_scheme(F.lit("storage:a:b")), T.after_scheme(F.lit("plain"))).first()[:] == ("a:b", "plain")


def test_cost(spark):
    led = spark.createDataFrame([("m", "p", 1000, 500, 0, 0), ("local", "ollama", 9, 9, 0, 0), ("n", "q", 10, 0, 8, 8), ("none", "p", 1, 1, 0, 0)], "model string, provider string, input_tokens long, output_tokens long, read_tokens long, written_tokens long")
    prices = spark.createDataFrame([("m", 3e-6, 1.5e-5, None, None), ("q/n", 1.0, 1.0, 2.0, None), ("none", None, 1.0, 1.0, 1.0)], "name string, p_in double, p_out double, p_written double, p_read double")
    found = {r["model"]: r["c"] for r in usage.with_prices(led, prices).select("model", usage.cost().alias("c")).collect()}
    assert found["m"] == pytest.approx(0.0105) and found["local"] == 0 and found["n"] == 16 and found["none"] is None


def test_embedding_model_errors(spark):
    docs = spark.createDataFrame([(1, "good"), (2, "bad"), (3, " "), (4, None)], "id long, text string").coalesce(1)

    def model(texts):
        if "bad" in texts:
            raise ValueError("bad text")
        return [[float(len(t)), 1.0] for t in texts]

    found = {r["id"]: (r["vector"], r["status"]) for r in models.embed_with(docs, "text", model, 2, batch=1).collect()}
    assert found == {1: ([4.0, 1.0], "ok"), 2: ([0.0, 0.0], "rejected: bad text"), 3: ([0.0, 0.0], "blank"), 4: ([0.0, 0.0], "blank")}


def test_calls_under_way_are_bounded_and_rows_keep_their_order(spark, tmp_path):
    """A provider that answers late calls first: several at once, never more than allowed; rows come in order; rejected batches, blanks and counts."""
    docs = spark.createDataFrame([(i, None if i % 50 == 3 else "bad" if i == 77 else f"text {i}") for i in range(200)], "id long, text string").coalesce(1)

    def model(texts):
        number = uuid.uuid4().hex
        (tmp_path / f"{number}.begun").write_text("")
        at_once = len(list(tmp_path.glob("*.begun")))
        (tmp_path / f"{number}.seen").write_text(str(at_once))
        time.sleep(random.random() * 0.05)
        (tmp_path / f"{number}.begun").unlink()
        if "bad" in texts:
            raise ValueError("no such text")
        return [[float(t.split()[1])] for t in texts]

    found = models.embed_with(docs, "text", model, 1, batch=3, in_flight=4, tasks=1)
    kept_rows = found.collect()
    full = [r for r in kept_rows if r["status"] != "blank"]
    seen = [int(p.read_text()) for p in tmp_path.glob("*.seen")]
    assert 2 <= max(seen) <= 4 and len(seen) == 66
    bad = [r["id"] for r in full if r["status"].startswith("rejected")]
    assert len(bad) == 3 and 77 in bad and all(r["vector"] == [0.0 if r["id"] in bad else float(r["id"])] for r in full)
    # Rows of one task keep their order.
    ids = [r["id"] for r in full]
    plain = [r["id"] for r in docs.where("text is not null").repartition(1).collect()]
    assert ids == plain
    assert models.embedding_report(spark.createDataFrame(kept_rows, found.schema)).first().asDict() == {"n_embedded": 193, "n_failed": 3, "n_blank": 4, "errors": ["rejected: no such text"]}


def test_a_rate_is_shared_by_tasks(spark, tmp_path):
    """Twelve calls at 240 a minute take two and a half seconds or more, by one task or by three."""
    docs = spark.range(12).selectExpr("id", "cast(id as string) as text")

    def model(texts):
        (tmp_path / uuid.uuid4().hex).write_text(str(time.time()))
        return [[1.0]] * len(texts)

    for tasks in (1, 3):
        assert models.embed_with(docs, "text", model, 1, batch=1, in_flight=2, tasks=tasks, per_minute=240).count() == 12
        at = sorted(float(p.read_text()) for p in tmp_path.iterdir())[-12:]
        assert at[-1] - at[0] >= 2.0
    with pytest.raises(ValueError, match="share"):
        models.embed_with(docs, "text", model, 1, per_minute=5)
    assert models.embed_by(docs, "text", model, 1, "cohere").count() == 12


def test_an_answer_of_another_length_fails(spark):
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception, match="another number or length"):
        models.embed_with(docs, "text", lambda texts: [[1.0]], 2).collect()


def test_reranker_and_generator(spark):
    rows_ = spark.createDataFrame([(1, "q", 10, "a"), (1, "q", 11, "b")], "query long, query_text string, key long, text string")
    out = models.rerank_with(rows_, "query", lambda q, texts: [1, 7, 0], "key", "query long, key long, rank long")
    assert rows(out) == [(1, 10, 2), (1, 11, 1)]

    def fails(prompt):
        if prompt == "b":
            raise RuntimeError("no")
        return prompt.upper()

    got = rows(models.generate_with(rows_.select("key", "text"), "text", fails), "key", "answer", "error")
    assert got == [(10, "A", None), (11, None, "RuntimeError: no")]


def test_threshold_or_top(spark):
    data = [(1, i, s) for i, s in enumerate((0.9, 0.1, 0.8))] + [(2, i, i / 100) for i in range(12)]
    found = retrieval.threshold_or_top(spark.createDataFrame(data, "q long, chunk_id long, score double"), ["q"], "chunk_id")
    assert rows(found, "q", "chunk_id", "position")[:2] == [(1, 0, 1), (1, 2, 2)]
    assert sorted((r["position"], r["chunk_id"]) for r in found.where("q = 2").collect()) == [(i, 12 - i) for i in range(1, 9)]


def test_unknown_document(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "name string")
    assert rows(retrieval.documents_asked(docs, None, "name")) == [("a",), ("b",)]
    with pytest.raises(ValueError, match="zzz"):
        retrieval.documents_asked(docs, spark.createDataFrame([("a",), ("zzz",)], "name string"), "name")


def test_stream_is_like_one_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(6)], "doc_id long, text string")
    store, source = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    for part in (docs.where("doc_id < 4"), docs.where("doc_id >= 2")):
        part.write.mode("append").parquet(source)
        stream_ingest(spark, store, source, docs.schema, str(tmp_path / "checkpoint"), 100)
    n = store.read().count()
    stream_ingest(spark, store, source, docs.schema, str(tmp_path / "checkpoint"), 100)
    assert store.read().count() == n == sum(-(-len(r["text"]) // 100) for r in docs.collect())
    assert store.read("chunk_key").distinct().count() == n


def test_a_micro_batch_reads_the_partitions_of_its_keys(spark, tmp_path):
    """A hundred documents in, then twenty single ones: each reads the keys of one partition of 64; the rows are those of one insert; folders are made one in between."""
    docs = spark.range(120).selectExpr("id as doc_id", "repeat(concat('word', cast(id as string), ' '), 200) as text")
    store = Store(spark, str(tmp_path / "keyed"), keyed_by="doc_id")
    ingest.ingest(store, docs.where("doc_id < 100"), 512)
    for i in range(100, 120):
        one = docs.where(F.col("doc_id") == i)
        held = store.held(one, "doc_id")
        # Pruned before any file is opened: the filter is one of partitions, of one bucket.
        assert re.search(r"PartitionFilters: \[[^]]*_bucket#[0-9]+ = [0-9]+", held._jdf.queryExecution().executedPlan().toString())
        assert len({re.search("_bucket=([0-9]+)", r[0])[1] for r in held.select(F.input_file_name()).collect()}) <= 1 and held.count() < 40
        ingest.ingest(store, one, 512)
        ingest.ingest(store, one, 512)
        store.compact(8)
    assert len(store.last()[1]) < 20
    plain = Store(spark, str(tmp_path / "plain"))
    ingest.ingest(plain, docs, 512)
    assert rows(store.read("doc_id", "chunk_key", "content")) == rows(plain.read("doc_id", "chunk_key", "content")) and "_bucket" not in store.read().columns
    store.delete(docs.where("doc_id >= 10").select("doc_id"), "doc_id")
    assert {r["doc_id"] for r in store.read("doc_id").collect()} == set(range(10))
    ingest.ingest(store, docs.where("doc_id < 20"), 512)
    assert {r["doc_id"] for r in store.read("doc_id").collect()} == set(range(20))


def test_extractor_errors(spark):
    files = spark.createDataFrame([(1, "a.PDF", b"good"), (2, "b.pdf", b"bad"), (3, "c.txt", b"x"), (4, None, b"x"), (5, "d.pdf", None)], "id long, path string, content binary")

    def extractor(data):
        if data == b"bad":
            raise ValueError("no text")
        return data.decode().upper()

    found = library.extract_with(files, "path", "content", extractor)
    assert rows(found, "id", "status", "text", "error") == [(1, "ok", "GOOD", None), (2, "error", None, "ValueError: no text"), (3, "wrong_type", None, None), (4, "bad_path", None, None), (5, "bad_path", None, None)]
    assert rows(library.ingest_report(found)) == [("bad_path", 2), ("error", 1), ("ok", 1), ("wrong_type", 1)]


def test_extractors_that_die_or_hang(spark, tmp_path):
    """Each takes its own row with it and no other: the process ends, is killed, does not answer, or takes too much memory."""
    for i in range(12):
        (tmp_path / f"{i}.pdf").write_bytes({3: b"exit", 5: b"kill", 7: b"hang", 9: b"grow"}.get(i, b"text %d" % i))
    (tmp_path / "other.txt").write_bytes(b"exit")

    def extractor(data):
        if data == b"exit":
            os._exit(7)
        if data == b"kill":
            os.kill(os.getpid(), signal.SIGKILL)
        if data == b"hang":
            time.sleep(600)
        if data == b"grow":
            return "x" * (1 << 36)
        return data.decode()

    files = library.raw_files(spark, str(tmp_path)).coalesce(2)
    start = time.time()
    found = {r["path"].rsplit("/", 1)[1]: (r["status"], r["text"], r["error"]) for r in library.extract_with(files, "path", "content", extractor, seconds=3, most_mb=8000).collect()}
    assert time.time() - start < 60 and len(found) == 13
    assert found["3.pdf"] == ("crash", None, "the process ended with 7") and found["5.pdf"] == ("crash", None, "the process ended with -9")
    assert found["7.pdf"] == ("crash", None, "no answer within 3 seconds") and found["9.pdf"][0] == "error" and "MemoryError" in found["9.pdf"][2]
    assert found["other.txt"][0] == "wrong_type" and all(found[f"{i}.pdf"] == ("ok", f"text {i}", None) for i in range(12) if i not in (3, 5, 7, 9))
    assert library.raw_files(spark, str(tmp_path), "*.txt").count() == 1


def grouped(n: int, groups: int, width: int = 24, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, width))[rng.integers(groups, size=n)] * 4 + rng.normal(size=(n, width)) * 0.3


def of_vectors(spark, ids, vectors, name: str = "id"):
    return spark.createDataFrame([(int(i), [float(x) for x in vectors[i]]) for i in ids], f"{name} long, vector array<double>").repartition(3)


def test_vector_index_follows_its_corpus(spark, tmp_path):
    """A fifth is added and a twentieth goes, twice: all lists are exact, fewer find nine in ten, nothing that went is found, and what no list has yet is searched beside them."""
    vectors = grouped(1200, 12)
    near = lambda found: {(r["query"], r["rank"], r["id"]) for r in found.collect()}
    own = of_vectors(spark, range(0, 1200, 40), vectors, "query")
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.create(of_vectors(spark, range(800), vectors), 8) and not index.create(own.withColumnRenamed("query", "id"), 3)
    for ids in (range(800), [i for i in range(960) if i % 20 != 3], [i for i in range(1200) if i % 20 != 7]):
        corpus = of_vectors(spark, ids, vectors)
        exact = near(neighbours.nearest(own, corpus, 10))
        if ids[-1] > 800:
            # Not in the index yet, but found; what went may still be found until the index is told.
            with_tail = index.nearest(own, 10, 8, corpus=corpus).where(F.col("id").isin(list(ids)))
            assert {r["id"] for r in with_tail.collect() if r["id"] >= 960} or ids[-1] < 960
        index.sync(corpus)
        assert index.sync(corpus) == (0, 0) and index.lists().count() == len(ids)
        assert near(index.nearest(own, 10, 8)) == exact
        assert near(index.nearest_exact(own, 10)) == exact
        few, coded = near(index.nearest(own, 10, 3)), near(index.nearest_by_codes(own, 10, 3))
        wanted = {(q, i) for q, _, i in exact}
        assert len({(q, i) for q, _, i in few} & wanted) >= 0.9 * len(wanted) and len({(q, i) for q, _, i in coded} & wanted) >= 0.9 * len(wanted)
    assert len(index.segments()) == 3 and index.compact() == 3 and len(index.segments()) == 1
    assert near(index.nearest(own, 10, 8)) == exact and index.lists().count() == len(ids)
    index.sync(of_vectors(spark, ids[:500], vectors))
    assert near(index.nearest_exact(own, 10)) == near(neighbours.nearest(own, of_vectors(spark, ids[:500], vectors), 10))


def test_exact_search_reads_few_lists_of_grouped_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector_index, "VECTOR_BLOCK", 50)
    vectors = grouped(3000, 30)
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.create(of_vectors(spark, range(3000), vectors), 30)
    own = of_vectors(spark, range(0, 3000, 50), vectors, "query")
    found, report = index.nearest_exact(own, 10, with_report=True)
    assert rows(found, "query", "rank", "id") == rows(neighbours.nearest(own, of_vectors(spark, range(3000), vectors), 10), "query", "rank", "id")
    read = report.agg(F.sum("vectors_read").alias("read"), F.sum("vectors").alias("all")).first()
    assert read["all"] == 60 * 3000 and read["read"] < 0.25 * read["all"]
    coded = {(r["query"], r["id"]) for r in index.nearest_by_codes(own, 10, 30).collect()}
    assert len(coded & {(r["query"], r["id"]) for r in found.collect()}) >= 0.9 * 600


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_what_a_vector_task_holds_is_bounded(metric):
    """Fitting typical values, putting vectors into lists and a full pair of blocks take a few MB beside their input, and find what a plain sort does."""
    rng = np.random.default_rng(5)

    def peak(run):
        tracemalloc.start()
        try:
            return run(), tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    values, mb = peak(lambda: vector_index.typical_values(rng.normal(size=(50_000, 4)), 256, 1, rounds=2))
    assert values.shape == (256, 4) and mb < 40
    vectors = rng.normal(size=(8192, 64))
    fitted = vector_index.Fitted(vectors[:16], [vectors[:256, a:b] for a, b in vector_index.cut(64, 16)])
    (lists, gaps, _), mb = peak(lambda: fitted.placed(vectors))
    assert np.array_equal(gaps, np.linalg.norm(vectors - fitted.centres[lists], axis=1)) and mb < 25
    assert (gaps[:500] <= np.linalg.norm(vectors[:500, None] - fitted.centres, axis=2).min(axis=1) + 1e-9).all()
    vectors[rng.choice(8192, 2000)] = vectors[0]
    queries, ids = np.concatenate([vectors[:3], rng.normal(size=(1021, 64))]), rng.permutation(8192)
    (name, found, score), mb = peak(lambda: neighbours.best_of_block(np.arange(1024) + 7, queries, ids, vectors, 10, metric))
    assert mb < 40 and np.array_equal(name, np.repeat(np.arange(1024) + 7, 10))
    order = np.argsort(ids)
    for q in (0, 1, 2, 3, 500, 1023):
        all_ = neighbours.scores(queries[q : q + 1], vectors[order], metric)[0]
        top = np.argsort(-all_, kind="stable")[:10]
        mine = slice(10 * q, 10 * q + 10)
        assert found[mine].tolist() == top.tolist() and np.allclose(score[mine], all_[top], atol=2e-9)


def test_odd_vectors_in_an_index(spark, tmp_path):
    """Equal vectors, fewer than lists or neighbours asked for, null elements that read as 0, and nothing at all."""
    index = VectorIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError, match="no vectors"):
        index.create(spark.createDataFrame([], "id long, vector array<double>"), 2)
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [None, 2.0])], "id long, vector array<double>")
    assert index.create(corpus, 2)
    own = spark.createDataFrame([(9, [1.0, 0.0])], "query long, vector array<double>")
    for found in (index.nearest(own, 5, 2), index.nearest_exact(own, 5), index.nearest_by_codes(own, 5, 2)):
        assert rows(found, "id", "rank", "score") == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, -5.0)]
        assert index.nearest(own.limit(0), 5, 2).count() == 0
    index.sync(corpus.limit(0))
    assert index.nearest(own, 5, 2).count() == 0 and index.sync(corpus) == (3, 0) and index.nearest_exact(own, 5).count() == 3
