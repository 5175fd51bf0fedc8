"""Rules, resolution, index and segment operators on small fixtures."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import rules as U
from corpusmill.operators import index as I
from corpusmill.operators import metrics as M
from corpusmill.operators import resolve as S
from corpusmill.operators import search as X
from corpusmill.operators import segment as G
from corpusmill.sources import files

NODES = [("UKPGA_2023_54__section-18", "x"), ("UKPGA_2023_54__section-45-7", "x"), ("UKSI_2024_692__regulation-5", "x"), ("UKSI_2024_692__regulation-6", "see regulation 5(2), section 45(7) and section 18 of the Procurement Act 2023; regulation 9 of the Utilities Order; part 3")]


def test_references_resolve_by_the_ladder(spark):
    nodes = spark.createDataFrame(NODES, "node_id string, text string")
    text, source = NODES[3][1], NODES[3][0]
    def ref(kind, locator, matched, doc="UKSI_2024_692"):
        at = text.index(matched)
        return (doc, source, kind, locator, matched, at, at + len(matched))
    refs = [ref("REGULATION", "5", "regulation 5"), ref("REGULATION", "5(2)", "regulation 5(2)"), ref("SECTION", "45(7)", "section 45(7)"), ref("SECTION", "18", "section 18"), ref("PART", "3", "part 3"), ref("CLAUSE", "3", "part 3"), ref("SECTION", "99", "part 3")]
    got = S.resolve_regex(spark.createDataFrame(refs, "source_document_id string, source_node_id string, reference_type string, locator string, matched_text string, start_char int, end_char int"), nodes).collect()
    by = {(r.reference_type, r.locator): (r.result.status, r.result.target_node_id, r.result.confidence) for r in got}
    assert by["SECTION", "18"] == ("EXACT_CROSS_DOCUMENT", "UKPGA_2023_54__section-18", 0.9)
    assert by["CLAUSE", "3"][0] == "UNRESOLVED" and by["PART", "3"] == ("DOCUMENT_ONLY", None, 0.4)
    assert by["SECTION", "99"][0] == "EXTERNAL_INSTRUMENT_REFERENCE"
    plain = spark.createDataFrame([("UKSI_2024_692", "q", k, x, "", None, None) for k, x in (("REGULATION", "5"), ("REGULATION", "5(2)"), ("SECTION", "45(7)"), ("SECTION", "18(1)"))], "source_document_id string, source_node_id string, reference_type string, locator string, matched_text string, start_char int, end_char int")
    found = {r.locator: (r.result.status, r.result.confidence) for r in S.resolve_regex(plain, nodes).collect()}
    assert found == {"5": ("EXACT_INTERNAL", 0.95), "5(2)": ("NEAREST_ANCESTOR", 0.75), "45(7)": ("EXACT_CROSS_DOCUMENT", 0.8), "18(1)": ("NEAREST_ANCESTOR", 0.65)}
    hrefs = spark.createDataFrame([("UKPGA_2023_54", h, None) for h in ("section-18", "section-45-7-a", "schedule", "key-9", "http://www.legislation.gov.uk/uksi/2024/692/regulation/5", "odd")], "source_document_id string, raw_href string, absolute_url string")
    docs = spark.createDataFrame([], "document_id string, source_url string")
    assert {r.raw_href: r.result.status for r in S.resolve_structured(hrefs, nodes, docs).collect()} == {"section-18": "EXACT_INTERNAL", "section-45-7-a": "NEAREST_ANCESTOR", "schedule": "DOCUMENT_ONLY", "key-9": "UNRESOLVED", "http://www.legislation.gov.uk/uksi/2024/692/regulation/5": "EXACT_URL", "odd": "UNRESOLVED"}


def test_cross_references_suppress_overlaps(spark):
    spans = S.cross_reference_spans("see sections 5(1), 6 and 7 and section 9(2); subsection (3)(a); paragraph 2 of Schedule 3, Schedule 4 and Part 2", "section", "12")
    assert [(s[0], s[2]) for s in spans] == [("LIST", ["5", "1"]), ("LIST", ["6"]), ("LIST", ["7"]), ("EXPLICIT", ["9", "2"]), ("LOCAL", ["12", "3", "a"]), ("SCHEDULE_PARAGRAPH", ["3", "paragraph", "2"]), ("SCHEDULE", ["4"]), ("PART", ["2"])]
    nodes = spark.createDataFrame([("D__section-12", "D", "section 12, sections 5 and 6, section 99", "12"), ("D__section-5", "D", None, "5")], "node_id string, document_id string, text string, own_number string")
    got = {(r.target_locator, r.target_node_id, r.review) for r in S.cross_references(nodes, "section").collect()}
    assert got == {("section-5", "D__section-5", False), ("section-6", None, True), ("section-99", None, True)}


def test_provision_keys_and_placeholders(spark):
    nodes = spark.createDataFrame([("D", "a", "regulation", "5."), ("D", "b", "section", "7"), ("D", "c", "section", "7"), ("D", "d", "part", None)], "document_id string, node_id string, node_type string, number string")
    keys = S.provision_keys(nodes)
    assert {r.key for r in keys.collect()} == {"D|regulation|5", "D|article|5"}
    refs = spark.createDataFrame([("D", "article", "5"), ("D", "section", "7")], "document_id string, kind string, locator string")
    assert {r.kind: r.node_id for r in S.exact_provisions(refs, keys).collect()} == {"article": "a", "section": None}
    chunks = spark.createDataFrame([("c1", "s", "x [[LINK_0001]] [[LINK_0002]]")], "chunk_id string, source_id string, text string")
    links = spark.createDataFrame([("s", "[[LINK_0001]]", "http://a", "t")], "source_id string, placeholder string, absolute_url string, anchor_text string")
    assert {r.placeholder: (r.url, r.reason) for r in S.placeholder_links(chunks, links).collect()} == {"[[LINK_0001]]": ("http://a", None), "[[LINK_0002]]": (None, "missing link")}
    a, b = (spark.createDataFrame([("s", "R", "5", m)], "source_id string, relation string, locator string, method string") for m in ("XML", "REGEX"))
    assert S.merged_references(a, b).first().method == "XML"


def test_addresses_join_as_the_library_does(spark):
    base = "http://a.org/b/c/d?q=1#f"
    hrefs = ["g", "./g", "g/", "/g", "//h.org/x", "?y", "g?y", "#s", "g#s", "..", "../", "../g", "../../g", "", "mailto:x@y", "https://z/1", "g/../h", "./"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "base string, href string")
    got = {r.href: r.u for r in df.select("href", U.joined_url(F.col("base"), F.col("href")).alias("u")).collect()}
    assert got == {h: urljoin(base, h) if h else base.split("#")[0] for h in hrefs}


def test_small_rules(spark):
    one = spark.range(1)
    say = lambda c: one.select(c.alias("x")).first().x
    assert say(U.normalized_lines(F.lit("  a\t b \n\n\n c\n\n"))) == "a b\n\nc"
    assert say(U.canonical_doc_id(F.lit("ukpga"), F.lit("2023"), F.lit("54"))) == "UKPGA_2023_54"
    assert [say(U.segment_citation(F.lit("T"), F.lit(n), F.lit("section"), F.lit(k))) for n, k in (("D__schedule-2-paragraph-3", "3."), ("D__regulation-9", "9."), ("D__schedule-6", "SCHEDULE 6"), ("D__section-1", "SECTION 1"))] == ["T Sch 2 para 3", "T reg 9", "T Sch 6", "T s 1"]
    assert say(U.dated_notes(F.lit("24 February 2025 First. 1 March 2024 x"))) == ["24 February 2025", "1 March 2024"]
    assert say(U.file_name(F.lit('a/b:c?.pdf'))) == "a_b_c_.pdf" and say(U.enriched_text(F.lit("c"), F.lit(None), F.lit("s"), F.lit("a"), F.lit(None), F.lit("t"))) == "c. . s. a. . t"
    assert say(U.keywords(F.array(F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>"), F.array(F.lit("c")), F.lit(None).cast("array<string>"), F.array(F.lit("d")))) == "a b c d"
    assert [say(U.review_tag(F.lit(d), F.lit("old"))) for d in ("DISCARD", "KEEP")] == ["HUMAN_REVIEW_DISCARD", None] and say(U.review_tag(F.lit(None).cast("string"), F.lit("old"))) == "old"
    assert say(U.expansion_gate(F.lit("q"), F.lit("e"), F.array(F.lit("w")))) == "e" and say(U.expansion_gate(F.lit("q"), F.lit("e"), F.array().cast("array<string>"))) == "q"
    assert say(I.canonical_variant(F.lit(5), F.lit(9), F.lit(10))) == "original" and say(I.canonical_variant(F.lit(6), F.lit(9), F.lit(10))) == "latest"


def test_gold_targets(spark):
    item = lambda s, c, a=None: {"acceptable_chunk_ids": a, "resolution": {"status": s, "chunk_id": c}}
    gold = [{"scenario_id": "s", "requirements": [
        {"requirement_id": "r1", "mandatory": None, "required_evidence_roles": ["x"], "essential_evidence": [item("MATCHED", "c1", ["c2"]), item("NOT_IN_CORPUS", "c3", ["c4"])], "strong_supporting_evidence": [item("FUZZY_MATCHED", "c5")], "wrong_regime_evidence": [item(None, None, ["c6"])]},
        {"requirement_id": "r2", "mandatory": False, "essential_evidence": [item("MATCHED", "c7")]}]}]
    df = spark.read.schema(I.GOLD_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(g) for g in gold]))
    ids = lambda d: sorted(r.chunk_id for r in d.collect())
    assert ids(I.gold_targets(df)) == ["c1", "c2"] and ids(I.essential_targets(df)) == ["c1", "c7"] and ids(I.gold_chunks(df)) == ["c1", "c5", "c7"] and ids(I.wrong_regime_chunks(df)) == ["c6"]


def test_index_operators(spark):
    e = lambda rows: spark.createDataFrame(rows, "source_id string, relation string, target_id string")
    v1 = e([("a", "CONTAINS", "b"), ("a", "REFERENCES", "c")])
    none = e([])
    assert sorted(r.origin for r in I.edge_families(v1, none, none).collect()) == ["reference_v1", "structural_v1"]
    assert sorted(r.origin for r in I.edge_families(v1, e([("a", "X", "z")]), e([("g", "X", "z")])).collect()) == ["guidance_refs", "reference_v2", "structural_v1"]
    scen = spark.createDataFrame([(f"s{i}", "a" if i < 7 else "b", "r") for i in range(12)], "scenario_id string, suite string, regime string")
    split = I.split_scenarios(scen).join(scen, "scenario_id").groupBy("suite", "split").count().collect()
    assert {(r.suite, r.split): r["count"] for r in split} == {("a", "dev"): 4, ("a", "test"): 3, ("b", "dev"): 2, ("b", "test"): 3}
    held = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "a int, b string, v int")
    new = spark.createDataFrame([(2, "z", 5), (2, "q", 9), (3, "w", 1)], "a int, b string, v int")
    assert sorted(map(tuple, files.insert_or_replace(held, new, ["a"], "v").collect())) == [(1, "x", 1), (2, "q", 9), (3, "w", 1)]
    variants = spark.createDataFrame([("k", "a", 2, 10, 5, 9), ("k", "b", 3, 1, 0, 1)], "key string, name string, top_count int, node_count int, reference_count int, byte_count int")
    assert I.best_variant(variants, ["key"]).first().name == "b"


def test_segments_and_plans(spark):
    blocks = [("B1", "p", None, "x" * 50), ("B2", "h1", 1, "Head"), ("B3", "p", None, "y" * 40), ("B4", "p", None, "[[LINK_0001]]" + "z" * 50)]
    docs = spark.createDataFrame([("D", blocks)], "document_id string, blocks array<struct<block_id:string,block_type:string,heading_level:int,text:string>>")
    seg = G.grouped_blocks(docs, 100).orderBy("segment_ordinal").collect()
    assert [[b.original_block_id for b in s.blocks] for s in seg] == [["B1"], ["B2", "B3"], ["B4"]] and seg[1].segment_id == "D__SEG_0002" and seg[1].blocks[0].block_id == "B0001"
    s = spark.createDataFrame([(f"s{i}", "h", [("B1", "a [[LINK_0001]]"), ("B2", "b")]) for i in range(4)], "segment_id string, segment_sha256 string, blocks array<struct<block_id:string,text:string>>")
    p = spark.createDataFrame([("s0", "h", [("B1", "B1"), ("B2", "B2")]), ("s1", "other", [("B1", "B2")]), ("s2", "h", [("B2", "B2")])], "segment_id string, segment_sha256 string, plan array<struct<start:string,end:string>>")
    chunks, status = G.materialised(s, p)
    assert {r.segment_id: r.status for r in status.collect()} == {"s0": "PASS", "s1": "INPUT_HASH_MISMATCH", "s2": "INVALID_BOUNDARIES", "s3": "MISSING_BOUNDARIES"}
    assert sorted((r.chunk_id, r.text) for r in chunks.collect()) == [("s0__CH_001", "a [[LINK_0001]]"), ("s0__CH_002", "b")]
    text = spark.createDataFrame([("# Title\n\nsome  text\n \nmore",)], "t string").select(G.text_blocks(F.col("t")).alias("b")).first().b
    assert [(b.block_type, b.heading_level, b.text) for b in text] == [("heading", 1, "Title"), ("paragraph", None, "some text"), ("paragraph", None, "more")]
    nodes = spark.createDataFrame([("D", "D__section-1", None, "section", "1", 1, "one sub rest"), ("D", "D__section-1-a", "D__section-1", "para", "a", 2, "sub"), ("D", "D__part-1", None, "part", "1", 0, "p")], "document_id string, node_id string, parent_node_id string, node_type string, number string, ordinal int, text string")
    legal = G.legal_segments(nodes).collect()
    assert [(r.segment_id, [(b.source_node_id, b.text) for b in r.blocks]) for r in legal] == [("D__SEG_0001", [("D__section-1", "one rest"), ("D__section-1-a", "sub")])]
    prov = spark.createDataFrame([("D__schedule-1", "schedule", 1, "t"), ("D__schedule-1-paragraph-1", "section", 2, "p"), ("D__schedule-2", "schedule", 3, "table"), ("D__schedule-2", "schedule", 4, "again"), ("D__section-9", "section", 5, " ")], "parent_node_id string, node_type string, ordinal int, text string")
    assert sorted((r.parent_node_id, r.text) for r in G.provision_nodes(prov).collect()) == [("D__schedule-1-paragraph-1", "p"), ("D__schedule-2", "table")]


def test_metrics(spark):
    rows = spark.createDataFrame([(q, s, 3, t, 3) for q, s, t in (("a", 3, 1), ("b", 2, 1), ("c", 1, 1))], "query_id string, sat_a int, tot_a int, sat_b int, tot_b int").withColumn("c", F.lit("x"))
    r = M.clustered(rows, ["c"], replicates=500).first()
    assert r.diff == pytest.approx(1 / 3) and r.lo <= r.diff <= r.hi and 0 <= r.p_swap <= 1
    n = spark.createDataFrame([(float(v), v % 3 + 1) for v in range(500)], "v double, n int")
    got = {r.v: r.before for r in M.values_before(n, "v", buckets=16).collect()}
    assert got == {float(v): sum(u % 3 + 1 for u in range(v)) for v in range(500)}
    assert [r.ok for r in M.checked(spark.createDataFrame([("a", 0.8129, "0.813"), ("b", 0.8, "0.813")], "name string, value double, reported string")).orderBy("name").collect()] == [True, False]
    h = lambda x: spark.createDataFrame([("q", "r1", x), ("q", "r2", True)], "query_id string, requirement_id string, hit boolean")
    assert tuple(M.rescued_and_harmed(h(False), h(True)).first()) == (1, 0, 1, 0)
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id int, rank int")
    assert M.candidate_recall(ranked, spark.createDataFrame([("q", 1), ("q", 9)], "query_id string, doc_id int"), 2).first().recall == 0.5


def test_missing_terms_are_searched_by_similar_words(spark):
    vocab = spark.createDataFrame([("procurement", 3), ("procurements", 1), ("tender", 2)], "term string, df long")
    terms = spark.createDataFrame([(1, "procurment"), (1, "tender")], "query_id long, term string")
    got = X.blended_terms(terms, vocab).collect()
    assert {(r.phrase, r.term) for r in got} == {("procurment", "procurment"), ("tender", "tender"), ("~procurment", "procurement"), ("~procurment", "procurements")}
    assert all(0.9 < r.weight < 1 for r in got if r.phrase.startswith("~"))
