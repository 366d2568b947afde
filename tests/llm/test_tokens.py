"""Operators 4, 6, 8 and 10 beside the tokenizer libraries."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm import batches, byte_bpe, packing, queries, token_counts, token_store, word_ids

RANKS, VOCABULARY = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
KNOWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
BPE = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), P.PATTERN)
LIBRARY = Tokenizer.from_file(VOCABULARY)
WORDS = word_ids.WordIds(word_ids.read_vocabulary(VOCABULARY))


def u32(ids) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def library_ids(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .,'\n\t\r 　 Éßx1½🎉́!<|>s")), max_size=40))
def test_any_text_as_the_libraries(text):
    assert BPE.encode([text.encode()])[0] == u32(KNOWN.encode_ordinary(text))
    assert WORDS.encode([text.encode()])[0] == u32(library_ids(text))


@pytest.mark.parametrize("piece", ["a" * 3000, "ab" * 700, "xyz" * 100 + "é" * 400, "qwertzuiop" * 60])
def test_long_pieces(piece):
    assert BPE.encode([piece.encode()])[0] == u32(KNOWN.encode_ordinary(piece))


def test_caches_may_be_emptied(monkeypatch):
    for held in (BPE.pieces, BPE.chunks, WORDS.known):
        monkeypatch.setattr(held, "budget", 600)
    for text in ("one two three four five", "six seven eight nine", "one six ten"):
        assert BPE.encode([text.encode()])[0] == u32(KNOWN.encode_ordinary(text))
        assert WORDS.encode([text.encode()])[0] == u32(library_ids(text))


def test_slices_are_looked_up_together(monkeypatch):
    """A piece that many slices have is looked up once for all of them, up to so many bytes; ids and their order are those of each text alone."""
    texts = ["".join(map(chr, range(0xC0, 0x100))), *(f"Über straße çà, naïve Ÿ ÿ × ÷ w{i % 4}" for i in range(9)), None, "", "日本 x"]
    looked_up, find = Counter(), batches.Cache.find
    monkeypatch.setattr(batches.Cache, "find", lambda self, keys: looked_up.update(keys) or find(self, keys))
    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), dtypes=[("doc_id", "bigint")], mapInArrow=lambda run, schema: run)
    docs.select = lambda *_: docs
    run = token_store.encode_chunks(docs, VOCABULARY, 1, "doc_id", "text")
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = {r["doc_id"]: r["n"] for b in run(iter([whole.slice(0, 5), whole.slice(5)])) for r in b.to_pylist() if r["is_recipe"]}
    assert got == {i: len(library_ids(t or "")) + 1 for i, t in enumerate(texts)}
    assert not {k: n for k, n in looked_up.items() if k and n > 1}
    coded = list(WORDS.encode_slices([[(t or "").encode() for t in texts[a : a + 2]] for a in range(0, len(texts), 2)]))
    assert [c for some in coded for c in some] == [u32(library_ids(t or "")) for t in texts] and list(WORDS.encode_slices([])) == []
    assert [len(run) for run in batches.runs_of_slices([whole] * 5, 1, most=2 * whole.nbytes)] == [2, 2, 1]


def test_op4(odd_docs, odd_rows):
    out = byte_bpe.byte_bpe(odd_docs, RANKS, P.PATTERN)
    got = Counter(tuple(r) for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = Counter()
    for i, t in odd_rows:
        ids = KNOWN.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want
    assert byte_bpe.byte_bpe(odd_docs.limit(0), RANKS, P.PATTERN).count() == 0


def check_store(rows, found):
    start = 0
    for (doc_id, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0])), sorted(found, key=lambda r: r["start"]), strict=True):
        ids = [*library_ids(text), 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(u32(ids)))
        start += len(ids)


def test_op8(spark, odd_docs, odd_rows):
    store = token_store.write_store(odd_docs, VOCABULARY, end_id=1)
    found = token_store.read_documents(spark, store).collect()
    check_store(odd_rows, found)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in found)
    chunks = spark.table(store.chunks)
    assert chunks.count() == chunks.select("digest").distinct().count()
    empty = token_store.write_store(odd_docs.limit(0), VOCABULARY)
    assert token_store.read_documents(spark, empty).count() == 0


def test_op8_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check_store([(r["doc_id"], r["text"] or "") for r in docs], queries.queries()["op8_token_store"](spark, sf_dir).collect())


def test_op8_hot_chunks(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(token_store, "HOT_USES", 1)
    shared = spark.createDataFrame([(1000 + i, "word " * 3000 + f"own {i}") for i in range(12)], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in shared.collect()]
    store = token_store.write_store(shared, VOCABULARY)
    check_store(rows, token_store.read_documents(spark, store).collect())
    monkeypatch.setattr(token_store, "BROADCAST_HOT", 0)
    check_store(rows, token_store.read_documents(spark, store).collect())


def test_op8_notices_damage(spark, odd_docs):
    store = token_store.write_store(odd_docs, VOCABULARY)
    other = spark.table(store.chunks).selectExpr("digest", "n_ids", "first(payload) over () as payload")
    other.write.saveAsTable(f"{store.chunks}_bad")
    with pytest.raises(Exception, match="damaged|decompress"):
        token_store.read_documents(spark, token_store.Store(store.path, f"{store.chunks}_bad", "doc_id")).collect()


def test_chunks_meet_again_after_an_insertion():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 40_000, 20_000).astype("<u4")

    def cuts(x):
        return token_store.cuts(x, np.array([len(x)]))[0]

    def parts(x):
        ends = cuts(x)
        return {x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    assert cuts(ids)[-1] == len(ids)
    changed = np.concatenate([ids[:7000], [7], ids[7000:]]).astype("<u4")
    assert len(parts(ids) & parts(changed)) >= len(parts(ids)) - 4
    assert max(np.diff([0, *cuts(np.zeros(30_000, "<u4"))])) <= token_store.MOST


def check_packing(rows, found, capacity):
    got, bins = Counter(), defaultdict(list)
    for r in found:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for doc_id, text in rows:
        ids = [*library_ids(text), 0]
        for k in range(0, len(ids), capacity):
            want[doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(u32(ids[k : k + capacity]))] += 1
    assert got == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(k[3] * n for k, n in want.items())


def test_op10(odd_docs, odd_rows):
    check_packing(odd_rows, packing.pack_documents(odd_docs, VOCABULARY, capacity=64).collect(), 64)
    assert packing.pack_documents(odd_docs.limit(0), VOCABULARY).count() == 0


def test_op10_on_the_tables(spark, sf_dir):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    bins, ids = check_packing(docs, queries.queries()["op10_best_two_fit"](spark, sf_dir).collect(), 2048)
    assert bins <= -(-ids // 2048) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_two_fit(lengths):
    bins, offsets = packing.best_two_fit(np.array(lengths, dtype=np.int64), 50)
    held = defaultdict(list)
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths, strict=True):
        held[b].append((o, n))
    assert all(sum(n for _, n in x) <= 50 for x in held.values())
    assert all([o for o, _ in sorted(x)] == list(np.cumsum([0, *(n for _, n in sorted(x))])[:-1]) for x in held.values())


def test_two_replace_the_shortest():
    # Greedily 7 and 2 leave 1 of 10 empty; 3 documents fill a bin when two take the place of the 2.
    bins, _ = packing.best_two_fit(np.array([7, 2, 4, 4, 1, 2]), 10)
    assert len(set(bins.tolist())) == 2


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(rule):
    starts, ends = np.array([0, 2, 4, 9]), np.array([2, 4, 9, 12])
    low, high = np.array([0, 3, 5, 5]), np.array([3, 5, 5, 10])
    got = token_counts.attributed(starts, ends, low, high, rule).tolist()
    assert got == ([2, 0, 0, 2] if rule == "most" else [2, 1, 0, 1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.tuples(st.integers(-2, 20), st.integers(-2, 24)), max_size=6), st.sampled_from(token_counts.RULES))
def test_attribution_to_any_sections(sizes, sections, rule):
    ends = np.cumsum(sizes).astype(np.int64)
    starts = ends - np.array(sizes, dtype=np.int64)
    want = [0] * len(sections)
    for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
        claims = [(min(b, y) - max(a, x) if rule == "most" else int(a <= x < b)) if a < b else 0 for a, b in sections]
        if claims and max(claims) > 0:
            want[claims.index(max(claims))] += 1
    low, high = (np.array([s[k] for s in sections], dtype=np.int64) for k in (0, 1))
    assert token_counts.attributed(starts, ends, low, high, rule).tolist() == want


def plain_counts(text: str):
    """Line counts, token by token."""
    data, lines, at = text.encode(), text.split("\n"), 0
    edges = []
    for k, line in enumerate(lines):
        size = len(line.encode()) + (k < len(lines) - 1)
        if size or k == 0:
            edges.append((at, at + size))
        at += size
    counts, at = [0] * len(edges), 0
    for i in KNOWN.encode_ordinary(text):
        size = len(KNOWN.decode_single_token_bytes(i))
        share = [min(b, at + size) - max(a, at) for a, b in edges]
        counts[share.index(max(share))] += 1
        at += size
    assert at == len(data)
    return [(k, len(data[:a].decode()), len(data[:b].decode()), n) for k, ((a, b), n) in enumerate(zip(edges, counts, strict=True))]


def test_op6(odd_docs, odd_rows):
    found = token_counts.token_counts(odd_docs, RANKS, P.PATTERN)
    got = Counter(tuple(r) for r in found.select("doc_id", "section", "start", "end", "n_tokens").collect())
    assert got == Counter((i, *row) for i, t in odd_rows for row in plain_counts(t))
    assert token_counts.token_counts(odd_docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_op6_on_the_tables(spark, sf_dir):
    found = queries.queries()["op6_token_counts"](spark, sf_dir).groupBy("doc_id").agg({"n_tokens": "sum", "n_document": "max"})
    assert all(r[1] == r[2] for r in found.collect())


def test_op6_given_sections(spark):
    docs = spark.createDataFrame([(1, "Über die Stadt", [(0, 4), (4, 8)]), (2, "x", None), (3, "x", [])], "doc_id long, text string, s array<struct<start: bigint, end: bigint>>")
    got = token_counts.token_counts(docs, RANKS, P.PATTERN, sections="s").collect()
    assert [(r["doc_id"], r["section"], r["start"], r["end"]) for r in got] == [(1, 0, 0, 4), (1, 1, 4, 8)]
    assert sum(r["n_tokens"] for r in got) <= got[0]["n_document"]


def test_op6_odd_sections(spark):
    """Null, half-null, reversed, overlapping and far-out sections, in texts of one and of more bytes a character."""
    kind = "doc_id long, text string, s array<struct<start: bigint, end: bigint>>"
    odd = [(0, 4), None, (None, 3), (2, None), (5, 1), (-7, 2), (3, 900), (600, 900), (0, 4)]
    docs = spark.createDataFrame([(1, "Über die Stadt", odd), (2, "Over the towns", odd), (3, None, odd)], kind)
    for rule in token_counts.RULES:
        rows = token_counts.token_counts(docs, RANKS, P.PATTERN, sections="s", rule=rule).collect()
        assert len(rows) == 3 * len(odd)
        for r in rows:
            want = odd[r["section"]] or (None, None)
            assert (r["start"], r["end"]) == ((None, None) if None in want else want)
            if None in want or r["section"] in (4, 7, 8) or r["doc_id"] == 3:
                assert r["n_tokens"] == 0
        for doc in (1, 2):
            own = [r for r in rows if r["doc_id"] == doc]
            assert sum(r["n_tokens"] for r in own) == own[0]["n_document"]


def long_text(words: int) -> str:
    rng = np.random.default_rng(11)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 10))) for _ in range(words))


def test_long_texts(spark):
    """Texts of a megabyte and more, beside short ones."""
    texts = [long_text(250_000), "short", "x" * 1_200_000, "a b\n" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [KNOWN.encode_ordinary(t) for t in texts]
    found = {r["doc_id"]: r for r in byte_bpe.byte_bpe(docs, RANKS, P.PATTERN).collect()}
    assert [found[i]["ids_sha256"] for i in range(4)] == [hashlib.sha256(u32(x)).hexdigest() for x in ids]
    counts = token_counts.token_counts(docs, RANKS, P.PATTERN).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"]: (r["lines"], r["n"]) for r in counts} == {i: (t.count("\n") + (not t.endswith("\n")), len(x)) for i, (t, x) in enumerate(zip(texts, ids, strict=True))}
    check_packing(list(enumerate(texts)), packing.pack_documents(docs, VOCABULARY).collect(), 2048)
    check_store(list(enumerate(texts)), token_store.read_documents(spark, token_store.write_store(docs, VOCABULARY)).collect())


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": ["a" * 10, None, "b" * 10, "c" * 50, "", "d", None]})
    parts = list(batches.slices(batch, 1, rows=3, most=20))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(7))
    assert [p.num_rows for p in parts] == [3, 1, 3]
    assert not list(batches.slices(batch.slice(0, 0), 1))


def test_cache_is_bounded_and_keeps_what_is_used():
    held = batches.Cache(40_000)
    for n in range(3000):
        held.ids_of([b"used", b"%d" % n], lambda new: [b"v" + k for k in new])
        assert len(held) * batches.ENTRY_BYTES < 41_000
    assert held.find([b"used"]) == [b"vused"]
    assert held.ids_of([b"x" * 300, b""], lambda new: [b"y" for _ in new]) == [b"y", b""]
    assert held.find([b"x" * 300]) == [None]


def test_manifest_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(token_store, "RUN", 3)
    rows = spark.createDataFrame([(p, i, bytes([p, i]), 1) for p in range(2) for i in range(20 * (p + 1))], "part int, at long, root binary, n_tokens long")
    tree = [r.asDict() for r in token_store.manifest(rows).collect()]
    assert max(r["n_documents"] for r in tree if r["level"] == 0) == 3
    top = max(r["level"] for r in tree)
    assert sorted((r["part"], r["n_documents"]) for r in tree if r["level"] == top) == [(0, 20), (1, 40)]


def test_store_can_be_removed(spark, odd_docs):
    store = token_store.write_store(odd_docs, VOCABULARY)
    token_store.remove(spark, store)
    assert not spark.catalog.tableExists(store.chunks)


def test_a_pattern_that_spans_spaces_is_not_cut():
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), r"[^,]+|,")
    other = tiktoken.Encoding("spans", pat_str=r"[^,]+|,", mergeable_ranks=ranks, special_tokens={})
    assert BPE.cuts and not bpe.cuts
    assert bpe.encode([b"one two, three four"])[0] == u32(other.encode_ordinary("one two, three four"))
