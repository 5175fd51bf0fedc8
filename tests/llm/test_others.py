"""Nearest neighbours, WARC archive, URL filters and the pipeline on small fixtures."""

import base64
import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import ann, langid, url_filters, warc
from corpusmill.llm.common import shared_folder
from corpusmill.llm.queries import ORACLES, URL_RULES


def brute_neighbours(ids, x, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            near = sorted((-float((q * v).sum()), j) for j, v in zip(ids, x, strict=True) if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


@pytest.mark.parametrize(("kind", "n"), [("clustered", 3000), ("random", 3000), ("clustered", 400), ("random", 400), ("clustered", 9000)])
def test_recall(spark, kind, n):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 16))
    if kind == "clustered":
        x = rng.normal(size=(40, 16))[rng.integers(0, 40, n)] + 0.2 * x
    x = x.astype(np.float32).astype(float)
    got = ann.search(spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, part string"))
    got = got.toPandas().sort_values(["query_id", "rank"])
    want = brute_neighbours(range(n), x, 20)
    hits = sum(len(set(g.vec_id) & {j for j, _ in want[q]}) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) >= 0.9 and (got.groupby("query_id").size() == 20).all()
    for q, g in got.groupby("query_id"):
        assert list(g["rank"]) == list(range(1, 21)) and list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
        assert np.allclose(g.score, x[g.vec_id] @ x[q], rtol=1e-12)


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [0.0, 2.0]), (5, [0.0, 3.0]), (None, [1.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (140, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = ann.search(df).toPandas().sort_values(["query_id", "rank"])
    assert [tuple(r) for r in got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False)] == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (0, 4, 5, 0.0), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0), (20, 4, 5, 0.0)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 40")).count() == 0


def test_equal_vectors_of_one_part(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5000)], "vec_id long, embedding array<float>")
    got = ann.search(df).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for i in range(21) if i != 20]


PAGES = [(1, "http://a.com/x", "<p>é</p>", "x"), (2, "http://a.com/y", "<p>é</p>", "x"), (3, "u\r\nX: 1", None, "x"), (4, None, "", "x"), (5, "http://b.org", "z" * 100_000, "x"), (None, "n", "<p>é</p>", "x"), (2, "http://a.com/y", "<p>é</p>", "x"), (7, "q", "only", "x")]
PAGE_SCHEMA = "page_id long, url string, html string, payload string"


def test_warc(spark):
    a = warc.write(spark.createDataFrame(PAGES, PAGE_SCHEMA).repartition(3), shared_folder(spark, "warc"))
    got = warc.contents(a, spark).collect()
    assert len(got) == len(PAGES) and a.payloads(spark).count() == 4
    first = {"<p>é</p>": 1, "": 3, "z" * 100_000: 5, "only": 7}
    want = []
    for i, _, html, _ in PAGES:
        data = (html or "").encode()
        of = first[html or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == of else "revisit", None if i == of else of))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    ids = [r.record_id for r in warc.parsed(warc.records(a, spark)).collect()]
    assert len(set(ids)) == len(PAGES)
    for r in warc.records(a, spark).collect():
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and len(rest) == n + 4 and rest.endswith(b"\r\n\r\n") and b"\nX: 1" not in head
        body = rest[:-4].split(b"\r\n\r\n", 1)[1]
        html = next(p[2] or "" for p in PAGES if p[0] == r.page_id)
        assert body == (html.encode() if r.page_id == first[html] else b"")
    least = warc.write(spark.createDataFrame(PAGES, PAGE_SCHEMA), shared_folder(spark, "warc"), least_bytes=5)
    assert warc.contents(least, spark).where("record_type = 'revisit'").count() == 3
    assert warc.contents(warc.write(spark.createDataFrame([], PAGE_SCHEMA), shared_folder(spark, "warc")), spark).count() == 0


def test_a_damaged_payload_stops_the_query(spark):
    a = warc.write(spark.createDataFrame(PAGES, PAGE_SCHEMA), shared_folder(spark, "warc"))
    a.payloads(spark).selectExpr("payload_key", "cast(concat(cast(payload as string), '!') as binary) as payload").write.parquet(f"{a.folder}-bad/payloads")
    a.headers(spark).write.parquet(f"{a.folder}-bad/headers")
    with pytest.raises(Exception, match="doesn't match"):
        warc.contents(warc.Archive(f"{a.folder}-bad"), spark).collect()
    a.headers(spark).withColumn("header", F.regexp_replace("header", r"Content-Length: (\d+)", "Content-Length: 1$1")).write.parquet(f"{a.folder}-worse/headers")
    a.payloads(spark).write.parquet(f"{a.folder}-worse/payloads")
    with pytest.raises(Exception, match="doesn't match its header"):
        warc.contents(warc.Archive(f"{a.folder}-worse"), spark).collect()


def test_url_filters(spark):
    rows = [(1, "http://good.com/a", '<a href="http://mid.org/x">', "x"), (2, "http://mid.org/", '<a href="//far.org/">', "x"), (3, "http://bad.net/es/1", "", "x"), (4, "http://shady.org/q", "<A class=x HREF=http://bad.net/es/1>", "x"), (5, "http://far.org", None, "x"), (6, None, None, "x")]
    rows += [(7, "HTTP://X.Example.COM/en/a?b#c", "", "x"), (8, "http://www.example.com/en/", "x", "x"), (9, "nourl", "", "x"), (None, "a://b://c/d", "", "x"), (8, "http://www.example.com/en/", "x", "x"), (10, "http://" + "é" * 20_000 + "/p", "", "x"), (11, "http://evil-example.com/en/", "", "x"), (12, "http://net/es/", "", "x"), (13, "http://com?x", "", "x")]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string, rule string"), URL_RULES).collect()}
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {1: ("com/", "allow"), 2: (None, "allow"), 3: ("net/es/", "block"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"), 7: ("example.com/en/", "block"), 8: ("www.example.com/en/", "allow"), 9: (None, "allow"), None: (None, "allow"), 10: (None, "allow"), 11: ("com/", "allow"), 12: ("net/es/", "block"), 13: (None, "allow")}
    assert (got[7].host, got[7].path) == ("x.example.com", "/en/a") and (got[None].host, got[None].path) == ("b:", "//c/d") and got[13].path == "" and got[2].trust > got[5].trust > 0
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [r[:3] for r in rows if r[0] is not None])
    assert {r[0]: r[1:] for r in con.execute(ORACLES["op10_url_filters"]).fetchall()} == {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items() if i is not None}
    assert got[2].trust == pytest.approx(0.85 * got[1].trust, rel=1e-6) and got[4].distrust == pytest.approx(0.85 * got[3].distrust, rel=1e-6)  # as far as masses settle
    assert url_filters.judge(spark.createDataFrame([], PAGE_SCHEMA), URL_RULES).count() == 0


def test_trust_and_distrust_converge(spark):
    chain = [f"h{i}.org" for i in range(12)]  # each links to the one before, the first to a blocked host
    links = {h: [("bad.net", *chain)[i]] for i, h in enumerate(chain)} | {"good.com": ["a.org"], "a.org": ["b.org", "bad.net"], "b.org": ["a.org", "good.com", "h3.org"], "bad.net": []}
    pages = [(i, f"http://{h}/es/", "".join(f'<a href="http://{t}/">' for t in to)) for i, (h, to) in enumerate(links.items())]
    got = {r.host: r for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()}
    hosts = list(links)
    a = np.array([[float(t in links[h]) for t in hosts] for h in hosts])
    for name, m, seed in (("trust", a, "good.com"), ("distrust", a.T, "bad.net")):
        share = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        start = np.array([float(h == seed) for h in hosts])
        share[m.sum(axis=1) == 0] = start  # what lies at hosts without links onward goes back to the seeds
        want = np.linalg.solve(np.eye(len(hosts)) - 0.85 * share.T, 0.15 * start)
        assert [getattr(got[h], name) for h in hosts] == pytest.approx(list(want), rel=1e-4, abs=1e-12)
    assert got["h11.org"].distrust > 0 and all(got[h].verdict == "block" for h in chain[4:])


def test_many_languages_are_kept(spark):
    import corpus_pipeline

    assert [corpus_pipeline.least_language_score(n) for n in (0, 1, 4)] == [1, 1, 0.3]
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(40)]  # each language has two words, most shared with others
    rows = [(i, " ".join(rng.choice(words[k % 40 :: 7][:2] + [f"{k}x"], 3)), f"l{k:02}", "s", 1) for i, k in enumerate(np.repeat(np.arange(66), 60).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.learn(docs)
    scores = [r.score for r in langid.predict(docs, model, keep_columns=True).where("lang_pred <> 'und'").collect()]
    least = corpus_pipeline.least_language_score(66)
    assert len(model.languages) == 66 and min(scores) < 0.3
    assert corpus_pipeline.known_language(spark, docs, "").count() == sum(s >= least for s in scores) > sum(s >= 0.3 for s in scores)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("stone", "water", "light", "under") for b in ("ed", "ing", "s", "ly", "er")]
    clean = [" ".join(rng.choice(words, 80)) for _ in range(30)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(clean)] + [(50, clean[3], "en", "s", 1), (51, clean[4] + " tail", "en", "s", 1), (52, "what an idiot and moron " + clean[5], "en", "s", 1), (53, None, "en", "s", 1), (54, "123 !!", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in docs.collect()) == list(range(30))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(30))
