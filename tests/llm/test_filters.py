"""Operators 2, 3, 7 and 9, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import ngram_join, queries, quality_rules, sql, toxicity, url_filter, warc

from .conftest import words


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_like_sql(spark, sf_dir, name):
    assert compare.differences(spark, compare.duck(sf_dir), queries.queries()[name], queries.oracle_sql()[name], sf_dir) == []


def plain_measures(text: str | None) -> tuple:
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    spans = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if spans[tuple(w[i : i + 8])] > 1 for k in range(8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_op3_measures(spark, odd_docs):
    rng = random.Random(9)
    some = " ".join(words(rng, 30))
    more = [f"{some} {some}", f"{some} x {some[:80]} {some}", "\n".join([some, some, " ", "", "a # $ <b>"]), "a " * 50, "\x0b\x0c ", "é \x1c ü " * 9]
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t, "en", "h0", 1, "x") for i, t in enumerate(more)], odd_docs.schema))
    texts = {(r["doc_id"], r["text"]): plain_measures(r["text"]) for r in docs.collect()}
    found = quality_rules.quality_rules(docs, columns=("doc_id", "text", "n_tokens")).collect()
    assert len(found) == docs.count()
    for r in found:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == texts[r["doc_id"], r["text"]], r["doc_id"]
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_op3_bad_hosts_go(spark):
    rng = random.Random(4)
    good = lambda: " ".join(words(rng, 40, 5000))
    rows = [(i, "few words", "bad") for i in range(95)] + [(200 + i, good(), "bad") for i in range(5)] + [(1000 + i, good(), f"ok{i % 7}") for i in range(700)] + [(5000, "short", "tiny"), (5001, good(), "tiny"), (5002, good(), None)]
    found = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(found[200 + i] for i in range(5))
    assert all(found[1000 + i] for i in range(700)) and found[5002]


def hosted(seed: int) -> list[tuple]:
    """Documents of hosts that differ: failing base rules, full of symbols, or of repeated lines; two are bad, and one too small to tell."""
    rng = random.Random(seed)
    kinds = [lambda: "few words", lambda: " ".join(words(rng, 30, 5000)) + " " + "#$" * 30, lambda: "\n".join([" ".join(words(rng, 30, 5000)), *["one line again"] * 4])]
    rows = []
    for h in range(30):
        share = {3: 0.7, 8: 0.6}.get(h, rng.random() * 0.2)
        for _ in range(4 if h == 5 else rng.randrange(30, 90)):
            bad = rng.random() < (0.75 if h == 5 else share)
            kind = {3: kinds[0], 8: kinds[1]}.get(h) or rng.choice(kinds)
            rows.append((len(rows), kind() if bad else " ".join(words(rng, 40, 5000)), f"h{h}"))
    return [*rows, (-1, "few words", None), (None, None, "h1")]


def plain_verdicts(rows: list[tuple]) -> set[str]:
    """Hosts that are rejected, worked out host by host."""
    hosts = defaultdict(list)
    for _, text, host in rows:
        n, chars, symbols, same, _, failed = plain_measures(text)
        lines = sum(1 for x in (text or "").split("\n") if x.strip("\x20\t\n\x0b\x0c\r"))
        if host is not None:
            hosts[host].append((failed, symbols > chars / 10, 100 * same > 30 * lines))
    total, bad = sum(map(len, hosts.values())), set()
    for rule in range(3):
        sums = {h: sum(x[rule] for x in found) for h, found in hosts.items()}
        m = sum(sums.values()) / total
        v = sum(len(hosts[h]) * (f / len(hosts[h]) - m) ** 2 for h, f in sums.items()) / total
        b = (v - m * (1 - m) * (len(hosts) - 1) / total) / (1 - sum((len(x) / total) ** 2 for x in hosts.values()))
        s = max(1.0, min(1e6, m * (1 - m) / b - 1)) if b > 1e-9 else 1e6
        for h, f in sums.items():
            alpha, beta = f + m * s, len(hosts[h]) - f + (1 - m) * s
            mean, variance = alpha / (alpha + beta), alpha * beta / (alpha + beta) ** 2 / (alpha + beta + 1)
            if mean - 2 * variance**0.5 > max(0.2, 2 * m):
                bad.add(h)
    return bad


@pytest.mark.parametrize("seed", [1, 2])
def test_op3_host_verdicts(spark, tmp_path, seed):
    """Bad hosts go with their good documents, as a plain count and the SQL say; a small host is not judged by four documents."""
    rows = hosted(seed)
    bad = plain_verdicts(rows)
    assert bad == {"h3", "h8"}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = quality_rules.quality_rules(docs, columns=("doc_id", "source")).collect()
    assert len(found) == len(rows)
    assert all(r["kept"] == (not r["base_failed"] and r["source"] not in bad) for r in found)
    assert any(r["source"] in bad and not r["base_failed"] for r in found)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert compare.differences(spark, compare.duck(str(tmp_path)), queries.queries()["op3_quality_rules"], sql.OP3, str(tmp_path)) == []


def test_op3_equal_hosts_stay(spark):
    """Hosts that differ by chance only: the prior is as strong as can be, and none goes."""
    rng = random.Random(3)
    rows = [(i, "few words" if rng.random() < 0.3 else " ".join(words(rng, 40, 5000)), f"h{i % 60}") for i in range(600)]
    found = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in found)


def labelled(spark, n: int = 600):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        w, bad = words(rng, rng.randrange(20, 80)), i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vilefool", "Vilefools!", "grimcad"])
        docs.append((i, " ".join(w), "en", f"h{i % 5}", None))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_op2(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(7001, None, None, None, None), (7002, "", "en", "h0", 1.0), (None, "vilefool", "en", "h0", 1.0), (1, "w1 w2", "en", "h0", 1.0), (1, "w1 w2", "en", "h0", 1.0)], docs.schema)
    odd_labels = spark.createDataFrame([(0, 1, None), (None, 1, 1), (9999, 1, 1), (0, 1, 1)], labels.schema)
    found = toxicity.toxicity(docs.unionByName(odd), labels.unionByName(odd_labels)).collect()
    assert len(found) == 605
    for r in found:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] > 1]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)


def plain_features(text: str, lexicon: toxicity.Lexicon) -> list[float]:
    """Features word by word, by regular expressions over characters."""
    tokens = [x for x in re.split(r"[.,;:?()\[\]{}<>\"'`~^&*+=\-_/\\#%\x20\t\n\r\x0b\x0c]+", text.lower()) if x]
    known, starts = {w.decode() for w in lexicon.words}, {s.decode() for s in lexicon.stems}
    second = {w.decode() for w in toxicity.SECOND_PERSON}
    bare = [x.rstrip("!") for x in tokens]
    hits = [i for i, x in enumerate(bare) if x in known]
    begun = [x for x in bare if x[:5] in starts]
    people = [i for i, x in enumerate(bare) if x in second]
    near = [i for i in hits if any(abs(i - j) <= 5 for j in people)]
    ascii_letters, upper = len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text))
    shouted = [x for x in re.split("[\x20\t\n\r\x0b\x0c]+", text) if len(x.encode()) > 3 and re.fullmatch("[^a-z]*[A-Z][^a-z]*", x)]
    marks = re.findall(r"[.,;:?()\[\]{}<>\"'`~^&*+=\-_/\\#%\n\t\r\x0b\x0c]", text)
    stood = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
    veiled = sum(1 for x in tokens if x.isascii() and not x.isalpha() and x not in known and "".join(stood.get(c, c) for c in x) in known)
    unveiled = sum(1 for x in tokens if x.isascii() and not x.isalpha() and x in known and "".join(stood.get(c, c) for c in x) not in known)
    mixed = len(re.findall(r"(?<![a-zA-Z])[a-zA-Z]+[013457@$!|*#.\-_]{1,3}[a-zA-Z]+", text))
    n, size = max(1, len(tokens)), max(1, len(text.encode()))
    return [len(hits) / n, min(20, len(hits)), len(begun) / n, min(20, len(begun)), len(near) / n, len(people) / n, upper / max(1, ascii_letters), len(shouted) / n, text.count("!") / size, len(marks) / size, mixed / n, min(20, veiled - unveiled), math.log(1 + len(tokens))]


LEXICON = toxicity.Lexicon(frozenset(b"vilefool grimcad w00f stra\xc3\x9fe".split()), frozenset(b"vilef grimc".split()))


def test_features_as_counted_plainly():
    rng = random.Random(12)
    parts = ["you", "vilefool", "VILEFOOL!!", "v1lefool", "vil3f00l", "grimcad,", "w00f", "straße", "STRASSE", "Du", "tú", "SHOUT", "ABC1", "a.b", "x!!", "don't", "(yourself)", "é", "\n", "\t", "vilefoolish", "grim-cad", "", "日本", "you!"]
    texts = ["", " ", "vilefool", "you vilefool", "vilefool a b c d you", "vilefool a b c d e you", "you a b c d e f vilefool x vilefool", "YOU VILEFOOL"] + [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    for t in texts:
        assert toxicity.features(t.encode(), LEXICON) == pytest.approx(plain_features(t, LEXICON), abs=1e-12), t


def plain_score(model: toxicity.Model, text: str) -> float:
    """The score by walking each tree and reading the curve between its points."""
    x = toxicity.features(text.encode(), model.lexicon)

    def leaf(node):
        while "Internal" in node.getClass().getSimpleName():
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    margin = sum(w * leaf(t._call_java("rootNode")) for w, t in zip(model.trees.treeWeights, model.trees.trees, strict=True))
    curve = np.interp(margin, model.curve.boundaries.toArray(), model.curve.predictions.toArray())
    return 0.99 * min(1.0, max(0.0, curve)) + 0.01 / (1 + math.exp(-2 * margin))


@pytest.mark.parametrize("made", [True, False])
def test_op2_scores_as_walked_plainly(spark, sf_dir, made):
    docs, labels = labelled(spark, 400) if made else (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    for r in rows[:120]:
        assert found[r["doc_id"]] == pytest.approx(plain_score(model, r["text"]), abs=1e-9)
    assert len({round(x, 6) for x in found.values()}) >= 2


def test_op2_learns_rare_but_sure_words(spark):
    """A word of ten toxic texts and no clean one is learned, however many toxic texts there are; words that chance put there are not."""
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        w, bad = words(rng, 30), i % 10 == 0
        if bad:
            w[3] = "raregrim" if i < 100 else "vilefool"
        if i in (1, 2, 3, 200, 210, 220, 230):
            w[5] = "seldom"
        rows.append((" ".join(w), int(bad)))
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert found.words == {b"vilefool", b"raregrim"}


def test_op2_does_not_learn_held_out_labels(spark):
    docs, labels = labelled(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda rows: sorted((r["doc_id"], round(r["score"], 9)) for r in rows.collect())
    assert key(toxicity.toxicity(docs, labels)) == key(toxicity.toxicity(docs, turned))


def test_op2_without_labels(spark):
    docs, labels = labelled(spark, 20)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_op2_on_held_out_rows(spark):
    """Accuracy on the tables themselves; labels carry some noise."""
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.queries()["op2_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)


def plain_host(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host, path = re.match("([^/?#]*)([^?#]*)", rest, re.DOTALL).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(r), r, a) for a, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_op7(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://Www.EXAMPLE.org/es/1", "https://example.org/en/1", "https://example.org/en/2", "http://badexample.org/es/", "https://a.b.com/fr/x?q=/de/", "https://com/de/", "https://x.com/de#/fr/",
        "https://x.net/a", "http://www.x.net/a/", "https://X.net/a.html#t", "https://x.net/b", "http://x.org?x", "http://x.org", "http://ÄB.com/de/", "a://b://c/d", "http://u@h.com:80/de/\n", "https://x.net/a", "://x.net/index.html", "://x.net/",
    ]
    pages = spark.createDataFrame([(i if i else None, u, 1, "r") for i, u in enumerate(urls)], "page_id long, url string, n int, rule string")
    found = url_filter.url_filter(pages, [url_filter.Rule(*r) for r in queries.URL_RULES], url_filter.repeated_addresses(pages)).collect()
    keys = defaultdict(set)
    canon = lambda h, p: re.sub(r"^www\.", "", h) + re.sub(r"(/index)?(\.html?)?/?\Z", "", p) if h else ""
    for u in urls:
        keys[canon(*plain_host(u))].add(u)
    want = []
    for i, u in enumerate(urls):
        host, path = plain_host(u)
        rule, action = plain_rule(host, path)
        listed = host and len(keys[canon(host, path)]) > 1
        want.append((i or None, host, path, rule, action or ("block" if listed else "allow")))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    none = pages.limit(0)
    assert url_filter.url_filter(none, [], url_filter.repeated_addresses(none)).count() == 0


def test_bloom_filter_never_misses(spark):
    listed = spark.range(5000).selectExpr("concat('k', id) as canonical")
    for blocks in (1, 64, 1024):
        bloom = url_filter.bloom_filter(listed, "canonical", blocks)
        assert bloom.count() <= blocks
        for most in (1024, 0):
            assert url_filter.possible_hits(listed, "canonical", bloom, blocks, most).where("not _possible").count() == 0
    other = spark.range(5000).selectExpr("concat('z', id) as canonical")
    assert url_filter.possible_hits(other, "canonical", bloom, 1024, 0).where("_possible").count() < 100


def test_op7_filter_grows_with_its_list(spark):
    """As many false hits for each size of list, and the same verdicts where the filter is dealt out as where it is broadcast."""
    others = spark.range(100_000).selectExpr("concat('other', id) as canonical")
    for n in (4000, 64_000):
        blocks = 1
        while blocks * url_filter.KEYS_PER_BLOCK < n:
            blocks *= 2
        bloom = url_filter.bloom_filter(spark.range(n).selectExpr("concat('k', id) as canonical"), "canonical", blocks)
        assert url_filter.possible_hits(others, "canonical", bloom, blocks, 0).where("_possible").count() < 300
    pages = spark.range(20_000).selectExpr("id as page_id", "concat('https://h', cast(id % 3000 as string), '.net/p') as url")
    listed = spark.range(2000).selectExpr("concat('h', cast(id as string), '.net/p') as canonical")
    found = [sorted(url_filter.url_filter(pages, [], listed, most_blocks=m).collect()) for m in (1024, 1)]
    assert found[0] == found[1] and sum(r["verdict"] == "block" for r in found[0]) == sum(i % 3000 < 2000 for i in range(20_000))
    with pytest.raises(ValueError, match="rules"):
        url_filter.url_filter(pages, [url_filter.Rule("allow", f"h{i}.net/") for i in range(url_filter.MOST_RULES + 1)], listed)


def test_op9_takes_whole_numbers(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        warc.archive_pages(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"))


def test_op9(spark, tmp_path):
    big, other = "<p>äöü</p>" * 120, "y" * 1000
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (None, "http://a/\r\nX: y", big), (7, "http://a/7", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (11, "u", other), (12, "u", "x" * 999), (13, "u", "x" * 999), (14, "u", "z" * 200_000), (15, "u", "line\r\n\r\nWARC/1.1\r\n" * 90), (16, "u", other), (16, "u", other)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    files = warc.write_warc(pages, f"file://{tmp_path}/out")
    assert files.agg({"n_records": "sum"}).first()[0] == len(rows)
    for r in files.collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            assert int.from_bytes(f.read(4), "little") == warc.SKIPPABLE
    found = warc.read_warc(spark, files, payloads=True).collect()
    owner = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= 1000:
            owner[t] = max(owner.get(t) or -1, -1 if i is None else i)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        first = t not in owner or owner[t] == i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else owner[t], data if first else None))
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found), key=repr) == sorted(want, key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_warc(pages, f"file://{tmp_path}/out").first()["path"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data = data[: len(data) - 9]
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="cut short|zstd|WARC|damaged"):
        warc.read_warc(spark, spark.createDataFrame([(f"file://{path}", 20)], "path string, n_records long")).collect()


def test_pipeline(spark, sf_dir):
    """The whole run against each stage's own query, done plainly."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [r for r in docs.collect() if not plain_measures(r["text"])[5]]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality_rules"](spark, docs, sf_dir)
    assert first.columns == docs.columns and sorted(r["doc_id"] for r in first.collect()) == sorted(r["doc_id"] for r in kept)
    civil = stages["toxicity"](spark, first, sf_dir).collect()
    model = toxicity.fit(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(r["doc_id"] for r in civil) == sorted(r["doc_id"] for r in kept if model is None or plain_score(model, r["text"]) < 0.5)
    from .test_joins import brute, components_of

    rows = sorted((r["doc_id"], r["text"]) for r in civil)
    named = components_of(brute(rows))
    one = {rows[i][0] for i, root in named.items() if root == i}
    unique = stages["ngram_jaccard_join"](spark, spark.createDataFrame(civil, docs.schema), sf_dir)
    assert unique.columns == docs.columns and {r["doc_id"] for r in unique.collect()} == one
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in found} == one
    assert all(n <= 2048 for n in Counter({k: sum(r["length"] for r in found if r["sequence_id"] == k) for k in {r["sequence_id"] for r in found}}).values())


def test_stages_bear_odd_rows(spark, odd_docs, sf_dir):
    docs = odd_docs.select("doc_id", "text", "lang", "source", F.col("n_tokens").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            stage(spark, rows, sf_dir).count()
    once = corpus_pipeline.keep_one_of_group(spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in once)[3] == 1 and None in {r["doc_id"] for r in once}


def test_stages_bear_any_names(spark, sf_dir):
    """Columns with every name that an operator uses, its own and internal ones, come through as they were."""
    import inspect

    from brindle.llm import shared

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    code = "".join(inspect.getsource(m) for m in (quality_rules, toxicity, ngram_join, shared, corpus_pipeline))
    used = {*re.findall('["`]([A-Za-z_][A-Za-z0-9_]*)["`]', code), *"kept n_words base_failed predicted score held_out row _row _id _text _host _margin _mark _n mark group class_id n_links rep home".split()}
    names = sorted(n for n in {u.lower(): u for u in used}.values() if n.lower() not in docs.columns)
    assert len(names) > 80
    more = docs.select("*", *(F.lit(7.5).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, more, sf_dir)
        assert found.columns == more.columns
        plain = stage(spark, docs, sf_dir)
        assert sorted(found.select(*docs.columns).collect()) == sorted(plain.collect()), name
        assert found.where(" and ".join(f"`{n}` = 7.5" for n in names)).count() == plain.count()
    assert corpus_pipeline.packed(spark, more, sf_dir).count() == corpus_pipeline.packed(spark, docs, sf_dir).count()


def test_kept_columns_may_not_have_the_names_of_results(spark):
    docs = spark.createDataFrame([(1, "text", "h", 7.5, 8.5)], "doc_id long, text string, source string, score double, kept double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for call in (lambda: toxicity.toxicity(docs, labels, keep=("score",)), lambda: quality_rules.quality_rules(docs, columns=("doc_id", "kept"))):
        with pytest.raises(ValueError, match="of its own"):
            call()
    assert toxicity.toxicity(docs, labels, keep=("kept", "text", "doc_id")).first().asDict() == {"doc_id": 1, "kept": 8.5, "text": "text", "held_out": toxicity.toxicity(docs, labels).first()["held_out"], "score": 0.0, "predicted": 0}


@pytest.mark.parametrize("most", [1000, 0])
def test_one_of_group_keeps_other_texts_of_an_id(spark, monkeypatch, most):
    """A copy under an id does not take that id's other text with it, and one row of each group stays, whether what goes is broadcast or not."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", most)
    rng = random.Random(11)
    a, b, c = (words(rng, 100) for _ in range(3))
    near = lambda w: " ".join([*w[:50], "new", *w[51:]])
    rows = [(1, " ".join(a)), (5, near(a)), (5, " ".join(b)), (7, " ".join(c)), (7, near(c)), (8, ""), (8, "two words"), (8, "two words"), (None, near(c))]
    kept = corpus_pipeline.keep_one_of_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    found = [(r["doc_id"], r["text"]) for r in kept]
    assert sum(r[0] == 7 for r in found) == 1
    assert sorted((r for r in found if r[0] != 7), key=str) == sorted([rows[0], rows[2], rows[5], rows[6], rows[8]], key=str)


def test_sql_names():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and sql.OP1


def test_long_texts_in_filters(spark):
    """Texts of a megabyte: of words, of one word, of repeated lines; two of them near copies."""
    rng = random.Random(21)
    w = words(rng, 190_000, 60_000)
    near = [*w[:1000], "changed", *w[1001:]]
    texts = [" ".join(w), " ".join(near), "x" * 1_100_000, "one line again and again\n" * 42_000, "short"]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in quality_rules.quality_rules(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_measures(texts[r["doc_id"]])
    made, labels = labelled(spark, 200)
    model = toxicity.fit(made, labels)
    assert {r["doc_id"]: round(r["score"], 9) for r in toxicity.scored(docs, model).collect()} == {i: round(plain_score(model, t), 9) for i, t in enumerate(texts)}
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert found == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0), 4: (4, 0)}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), "text").alias("url"), F.col("text").alias("html"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in warc.archive_pages(pages).collect()}
    assert got == {i: (len(t), hashlib.sha1(t.encode()).hexdigest()) for i, t in enumerate(texts)}
    rules = [url_filter.Rule(*r) for r in queries.URL_RULES]
    named = url_filter.url_filter(pages, rules, url_filter.repeated_addresses(pages)).collect()
    assert {r["page_id"]: len(r["path"]) for r in named} == {i: len(t) + 1 for i, t in enumerate(texts)}
