"""Golden cases of the engine's functions and operators."""

import importlib
import math
import shutil
import sqlite3
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import catalogue
from corpusmill.functions import stemming
from corpusmill.functions import text as T
from corpusmill.operators import fuzzy, graph, metrics, quality, retrieval, segment
from corpusmill.sources import files, html, xml
from corpusmill.streaming.resume import pending


def one(spark, expr, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("expr", "text", "want"), [
    (T.locator_parts, "83B(5)(b)(i)", ["83B", "5", "b", "i"]), (T.locator_parts, "5", ["5"]), (T.locator_parts, "", []),
    (T.ancestors, "D__schedule-4-paragraph-1-1", ["D__schedule-4-paragraph-1", "D__schedule-4-paragraph", "D__schedule-4", "D__schedule"]),
    (T.query_terms, "What is the", ["What", "is", "the"]), (T.query_terms, "the tender x rules", ["tender", "rules"]),
    (T.with_aliases, "PCR 2015 reg 72", "PCR 2015 reg 72 Public Contracts Regulations 2015"), (T.with_aliases, "nothing", "nothing"),
    (T.drop_reason, "", "empty"), (T.drop_reason, "Back to top", "chrome"), (T.drop_reason, "hello", "thin_no_substance"), (T.drop_reason, "You must register.", None),
    (T.dedupe_url, "https://www.site.uk/ukpga/2023/54/data.akn", "site.uk/ukpga/2023/54"), (T.norm_locator, "(a).", "A"), (T.norm_locator, "-", None),
    (T.clean, " a \t b \n c ", "a b \n c"), (T.repaired, "the\nend of  it\n\n\n\nNew", "the end of it\n\nNew"), (T.est_tokens, "ab", 1), (T.safe_id, "//", "UNKNOWN"),
    (T.predicted_classes, "is an FOI request a treaty state matter", ["OFFICIAL_REGULATOR_GUIDANCE", "OFFICIAL_TECHNICAL_GUIDANCE"]),
])
def test_text_functions(spark, expr, text, want):
    assert one(spark, expr(F.col("t")), t=text) == want


def test_lane_and_weights(spark):
    df = spark.createDataFrame([("PRIMARY_LEGISLATION",), (None,), ("X",)], "a string")
    assert [tuple(r) for r in df.select(T.lane(F.col("a")), T.authority_weight(F.col("a"))).collect()] == [("legislation", 1.0), ("other", 0.6), ("other", 0.6)]


def test_normalised(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 2.0), (2, 2.0)], "q int, v double")
    got = sorted(r.n for r in df.select(retrieval.normalised("v", ["q"]).alias("n")).collect())
    assert got == pytest.approx(sorted([(math.tanh(-1) + 1) / 2, (math.tanh(1) + 1) / 2, 0.5, 0.5]))


def test_bm25_agrees_with_sqlite(spark):
    texts = ["apple banana apple", "banana cherry", "apple", "date egg fig grape apple banana", "egg"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", enumerate(texts))
    want = {r: -s for r, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH 'cherry OR egg OR apple'")}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame([(1, "cherry"), (1, "egg"), (1, "apple")], "query_id long, term string")
    got = {r.doc_id: r.bm25 for r in retrieval.bm25(retrieval.tokenized(docs, T.words(F.col("text"))), terms).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def small_corpus(spark, folder, texts, items):
    docs = [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_queries_use_every_content_word(spark, tmp_path):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    texts = [" ".join(words[i % 10] for i in range(a, a + n)) for a, n in ((0, 3), (8, 1), (9, 2), (4, 5), (7, 4), (2, 9))]
    sf = small_corpus(spark, tmp_path, texts, ["The alpha alpha alpha alpha alpha alpha alpha alpha of India", " ".join(words)])
    avg, want = sum(len(t.split()) for t in texts) / len(texts), {}
    for q, terms in enumerate((["alpha", "india"], words)):
        for d, t in enumerate(texts):
            w = t.split()
            idf = {x: max(math.log((len(texts) - n + 0.5) / (n + 0.5)), 1e-6) for x in terms for n in [sum(x in u.split() for u in texts)]}
            if set(w) & set(terms):
                want[q, d] = sum(idf[x] * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for x in terms)
    got = {(r.query_id, r.doc_id): r.bm25 for r in catalogue.QUERIES["bm25_topk"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-6) and (0, 1) in got


def test_candidates_reach_the_reference_depths(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(12)]
    sf = small_corpus(spark, tmp_path, [" ".join(rng.choice(words, 9)) for _ in range(900)], [" ".join(words[:5]), "w7 w9"])
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 6)))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{sf}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    for name, k in (("two_lane_search", 100), ("rank_movement", 300), ("weight_sweep", 300), ("hybrid_fusion", 100)):
        assert f"r <= {k} UNION" in catalogue.ORACLES[name]
        want = con.execute(catalogue.ORACLES[name])
        df = catalogue.QUERIES[name](spark, sf)
        want = {tuple(x[[d[0] for d in want.description].index(c)] for c in df.columns) for x in want.fetchall()}
        got, flat = {tuple(r) for r in df.collect()}, lambda rows: [x for r in sorted(rows, key=repr) for x in r]
        assert len(got) == len(want) and flat(got) == pytest.approx(flat(want), abs=2e-6), name


def test_stems_agree_with_sqlite():
    words = "procurement applies bodies running hopping hoped falling relational conditional rational digitizer operator feudalism decisiveness hopefulness formality sensitivity triplicate formative formalize electrical goodness revival allowance inference airliner adjustable defensible irritant replacement adoption communism activate effective rate cease controll roll sky happy agreed plastered caresses ponies cats motoring sized".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", enumerate(words))
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab('f', 'instance')")
    want = {d: t for t, d in con.execute("SELECT term, doc FROM v")}
    assert {i: stemming.porter_stem(w) for i, w in enumerate(words)} == want


def test_fuzzy(spark):
    vocab = spark.createDataFrame([("procurement",), ("tender",), ("lender",)], "term string")
    got = fuzzy.variants(spark.createDataFrame([("procurment",), ("tend",), ("tendre",)], "term string"), vocab).collect()
    assert {(r.term, r.variant) for r in got} >= {("procurment", "procurement"), ("tendre", "tender")} and all(r.term != "tend" for r in got)
    assert stemming.indel_ratio("abcd", "abd") == pytest.approx(600 / 7)


def test_fuzzy_finds_all_short_variants(spark):
    rng = np.random.default_rng(7)
    known = ["word", "girl", "calm", "this", "form"] + ["".join(rng.choice(list("abcde"), n)) for n in rng.integers(1, 10, 300)]
    asked = ["wrod", "gril", "clam", "tihs", "from"] + ["".join(rng.choice(list("abcde"), n)) for n in rng.integers(4, 10, 60)]
    words = lambda x: spark.createDataFrame([(w,) for w in sorted(set(x))], "term string")
    for cutoff in (72, 60):
        want = {}
        for t in sorted(set(asked) - {"from"}):  # a stop word
            if not any(k.startswith(t) for k in known):
                near = [(-r, k) for k in sorted(set(known)) for r in [stemming.indel_ratio(t, k)] if r >= cutoff]
                want |= {(t, k): -r for r, k in sorted(near)[:3]}
        got = {(r.term, r.variant): r.ratio for r in fuzzy.variants(words(asked), words(known), cutoff).collect()}
        assert got == pytest.approx(want) and ("wrod", "word") in got


def test_swapped_four_letters_are_looked_up(spark, tmp_path):
    sf = small_corpus(spark, tmp_path, ["girl word", "stone"], ["girl words"])
    assert {(r.term, r.variant) for r in catalogue.QUERIES["fuzzy_variants"](spark, sf).collect()} == {("gilr", "girl")}


def test_chunk_defects(spark):
    rows = [("s", 1, "the supplier"), ("s", 2, "must pay:"), ("s", 3, "(a) an item, or"), ("s", 4, None)]
    got = {r.chunk_ordinal: r.defects for r in quality.assessed(spark.createDataFrame(rows, "s string, chunk_ordinal int, text string"), ["s"], metadata=False).collect()}
    assert "SEVERED_SENTENCE" in got[1] and "SEVERED_LIST_STEM" in got[2] and {"SEVERED_ENUMERATION", "ORPHAN_LIST_ITEM"} <= set(got[3]) and got[4] == ["EMPTY_TEXT"]


def test_segments(spark):
    df = spark.createDataFrame([(1, ["aaaa", "bb", "cccc", "d"])], "id int, b array<string>")
    assert [(r.chunk_ordinal, r.text) for r in segment.chunked(df, "b", 5).orderBy("chunk_ordinal").collect()] == [(1, "aaaa\nbb"), (2, "cccc\nd")]
    plan = lambda *p: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(z).alias("end")) for a, z in p))
    ids = F.array(*(F.lit(x) for x in "xyz"))
    assert [one(spark, segment.plan_is_valid(ids, p), t=1) for p in (plan(("x", "y"), ("z", "z")), plan(("x", "y"), ("y", "z")), plan(("x", "x"), ("z", "z")))] == [True, False, False]


def test_windows(spark):
    text = "1. " + "a" * 20 + "\n2. " + "b" * 20 + "\n3. " + "c" * 90
    got = [r.text for r in segment.windows(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), 30).orderBy("window").collect()]
    assert "".join(got) == text and max(map(len, got)) <= 48 and got[0].startswith("1.") and got[0].endswith("\n")
    kids = lambda *k: F.array(*map(F.lit, k)).cast("array<string>")
    assert [one(spark, segment.exclusive_text(F.col("t"), k), t="head one two one") for k in (kids("one", "two"), kids("x"), kids())] == ["head   one", "", "head one two one"]


def test_score_against_pool(spark):
    cols = "q int, doc_id long, bm25 double, dense double, authority_weight double, jurisdiction_weight double"
    pool = spark.createDataFrame([(1, i, float(i), i / 10, 0.6, 1.0) for i in range(5)], cols)
    extra = spark.createDataFrame([(1, 9, 3.5, 0.35, 0.6, 1.0)], cols)
    r = retrieval.scored_against_pool(pool, extra, ["q"]).first()
    assert (r.doc_id, r.rank_if_inserted) == (9, 2)
    ranked = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "authority_class string, ce_score double")
    assert [x.ce_score for x in retrieval.category_boosted(ranked, F.array(F.lit("A")), 1.5).collect()] == [0.75, 0.5]


def test_graph(spark):
    nodes = spark.createDataFrame([("D__section-1",), ("D__section-2-1",)], "node_id string")
    edges = spark.createDataFrame([("D__section-1", "D__section-2-1-4", "REFERENCES", 0.9), ("D__section-1", "D__section-1-3", "REFERENCES", 0.9), ("D__section-1", "E__section-9", "REFERENCES", 0.5)], "source_id string, target_id string, relation string, confidence double")
    got = {r.target_id: (r.retrieval_target_id, r.retrieval_resolution) for r in graph.densified(edges, nodes).collect()}
    assert got == {"D__section-2-1-4": ("D__section-2-1", "ANCESTOR"), "D__section-1-3": (None, "SELF_LOOP"), "E__section-9": (None, "UNRESOLVABLE")}
    refs = graph.references(spark.createDataFrame([("n", "see section 2(1) and regulation 7A")], "node_id string, text string")).withColumn("source_document_id", F.lit("D"))
    assert {(r.reference_type, r.status, r.target_node_id) for r in graph.resolved(refs, nodes).collect()} == {("SECTION", "EXACT_INTERNAL", "D__section-2-1"), ("REGULATION", "DOCUMENT_ONLY", None)}


def test_references_of_all_types(spark, tmp_path):
    pages = [(1, "<p>Sections 83B(5)(b)(i) and\nregulation 7A, PART 2</p> part 3"), (2, "schedule 4(1), apart 5, section x"), (3, None), (4, "none")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r)[:4] + (tuple(r.parts),) for r in catalogue.QUERIES["page_references"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, "SECTION", "83B(5)(b)(i)", ("83B", "5", "b", "i")), (1, 1, "REGULATION", "7A", ("7A",)), (1, 2, "PART", "2", ("2",)), (1, 3, "PART", "3", ("3",)), (2, 0, "SCHEDULE", "4(1)", ("4", "1"))}
    con = duckdb.connect()
    for t in ("pages", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert {r[:4] + (tuple(r[4]),) for r in con.execute(catalogue.ORACLES["page_references"]).fetchall()} == got
    counts = {tuple(r) for r in catalogue.QUERIES["reference_counts"](spark, str(tmp_path)).collect()}
    assert counts == {(1, "SECTION", 1), (1, "REGULATION", 1), (1, "PART", 2), (2, "SCHEDULE", 1)}


def test_each_order_expands_by_itself(spark, tmp_path):
    rows = {"nation": ([(1, 0)], "n_nationkey long, n_regionkey long"), "customer": ([(c, 1) for c in range(60)], "c_custkey long, c_nationkey long")}
    orders = [(1000 * i, i % 60, "FO"[i % 2]) for i in range(1, 91)]  # the same remainder of 1000
    rows["orders"] = ([*orders, (7, 1, "F")], "o_orderkey long, o_custkey long, o_orderstatus string")
    rows["lineitem"] = ([(k, 5 * k + i) for k, _, _ in orders for i in range(45 if k == 1000 else 2)], "l_orderkey long, l_partkey long")
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = [(r.query_id, r.node) for r in catalogue.QUERIES["graph_expand_1hop"](spark, str(tmp_path)).collect()]
    parts = lambda k: sorted(f"P{5 * k + i}" for i in range(45 if k == 1000 else 2))[:39]
    assert sorted(got) == sorted((k, n) for k, c, _ in orders for n in (f"C{c}", *parts(k)))
    two = catalogue.QUERIES["graph_expand_2hop"](spark, str(tmp_path)).where("hop = 2").collect()
    assert sorted((r.query_id, r.node) for r in two) == [(k, "N1") for k, _, _ in orders]


def test_metrics(spark):
    s = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.1, False), (None, False)], "v double, y boolean").withColumn("g", F.lit(1))
    assert metrics.auc(s, "v", "y", ["g"]).first().auc == pytest.approx(5 / 6)
    assert metrics.mcnemar(0, 0) == 1.0 and metrics.mcnemar(1, 9) == pytest.approx(2 * 11 / 1024)
    assert metrics.mann_whitney(s, "v", "y").first().u == 3.0
    pairs = spark.createDataFrame([(1, 0.0, 1.0)] * 30, "c int, a double, b double")
    r = metrics.paired_bootstrap(pairs, ["c"], 500).first()
    assert (r.mean_diff, r.lo, r.hi) == (1.0, 1.0, 1.0) and r.p_sign_flip < 0.01


def test_html(spark):
    page = '<title>t</title><nav><a href="/n">no</a></nav><h1>A</h1><p>x <a href="/l">go</a></p><h2>B</h2><li>i<h2>C</h2>'
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [(r.block_type, r.text) for r in html.blocks(pages).orderBy("ordinal").collect()] == [("h1", "A"), ("p", "x go [[LINK_0002]]"), ("h2", "B"), ("li", "i"), ("h2", "C")]
    assert [r.raw_href for r in html.links(pages).orderBy("occurrence").collect()] == ["/n", "/l"]
    assert [r.heading_path for r in html.headings(html.blocks(pages)).orderBy("ordinal").collect()] == [["A"], ["A", "B"], ["A", "C"]]


def test_xml(spark):
    akn = '<akn xmlns="x"><body><section eId="section-1"><num>1</num><heading>Scope</heading><subsection><num>(2)</num><p>text</p></subsection></section></body></akn>'
    rows = xml.nodes(spark.createDataFrame([("D", akn), ("E", "<broken"), ("F", None)], "document_id string, xml string")).orderBy("ordinal").collect()
    assert [(r.node_id, r.parent_node_id, r.node_type, r.number, r.heading, r.depth) for r in rows] == [("D__section-1", None, "section", "1", "Scope", 0), ("D__subsection-2", "D__section-1", "subsection", "(2)", None, 1)]


def test_files(spark, tmp_path):
    assert files.read_jsonl(spark, f"{tmp_path}/none", "a long").count() == 0
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    files.write_jsonl(df, f"{tmp_path}/j")
    back = files.read_jsonl(spark, f"{tmp_path}/j", "a long, b string")
    assert sorted(map(tuple, back.collect())) == [(1, "x"), (2, "y")]
    new = spark.createDataFrame([(2, "z"), (3, "w")], "a long, b string")
    assert sorted(map(tuple, files.insert_or_ignore(df, new, ["a"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert sorted(map(tuple, files.insert_or_replace(df, new, ["a"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert [r.a for r in pending(df, new, ["a"]).collect()] == [1] and files.manifest(spark, f"{tmp_path}/j").count() >= 1


def test_queries_are_registered():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and catalogue.FLAGSHIP in catalogue.QUERIES


def test_the_rest_stands_alone(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "corpusmill", tmp_path / "corpusmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/local/bin:/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert importlib.import_module("__spark_entry__").queries().keys() >= catalogue.QUERIES.keys()
