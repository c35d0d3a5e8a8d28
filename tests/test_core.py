"""Hand-made cases of the core operators, with nulls, empty tables and ties."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import calculations, chunking, citations, corrective, dense, filings, fusion, hybrid, lexical, metrics, runs, units
from quarrylight.settings import Settings
from quarrylight.sources import files, vector_store
from quarrylight.streaming import events


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first()["x"]


def test_terms_and_forms(spark):
    assert one(spark, T.terms(F.col("t")), t="PP&E – 10−K, Straße 1.5") == ["pp&e", "10-k", "strasse", "1.5"]
    assert one(spark, T.terms(F.col("t").cast("string")), t=None) == []
    assert one(spark, T.keyword_query(F.col("t")), t="What was the FY2018 capex amount of 3M?") == "FY2018 capex 3M"
    forms = one(spark, T.query_variants(F.col("t")), t="Free cash flow of 3M")
    assert forms[0] == "Free cash flow of 3M" and len(forms) == 3 and forms[1] == "Free cash flow 3M"
    assert one(spark, T.years(F.col("t")), t="FY2018 against 2017 and 2018, 20199") == [2017, 2018]
    assert one(spark, T.conditional_zero(F.col("t")), t="Answer 0 if it is not shown.")


def test_headings_and_types(spark):
    assert one(spark, T.heading(F.col("t"), F.lit(30)), t="## **ITEM 1A. RISK FACTORS**") == "Risk Factors"
    assert one(spark, T.heading(F.col("t"), F.lit(3)), t="ITEM 1A. RISK FACTORS ..... 12") is None
    assert one(spark, T.heading(F.col("t"), F.lit(3).cast("int")), t="Balance Sheets for obligor group") is None
    assert one(spark, T.body_section(F.col("t")), t="Total current assets | 5") == "Balance Sheet"
    assert one(spark, T.content_type(F.col("t"), F.lit("x")), t="a|b|c\nd|e|f\ng|h|i") == "table"
    assert one(spark, T.content_type(F.col("t"), F.lit("x")), t="  ") == "unknown"
    assert one(spark, T.content_type(F.col("t"), F.lit("x")), t="see Note 12b") == "footnote"
    assert one(spark, T.doc_type(F.col("t")), t=" 10k-annualreport ") == "10K_ANNUAL"


def test_bm25_against_a_loop(spark):
    import math
    import random

    random.seed(3)
    words = [f"w{i}" for i in range(30)]
    texts = {f"c{i:02d}": " ".join(random.choices(words, k=random.randint(0, 40))) for i in range(40)}
    chunks = spark.createDataFrame([(c, t, None, "X", 2020) for c, t in texts.items()], "chunk_id string, text string, context_header string, company string, fiscal_year int")
    docs = lexical.corpus(chunks.unionByName(chunks.limit(5)))
    queries = {"q1": "w1 w2 w2 w29", "q2": "w3", "q3": "none"}
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.best_matches(spark.createDataFrame(list(queries.items()), "query_id string, query string"), lexical.Index.build(docs), 99).collect()}
    tok = {c: t.split() for c, t in texts.items()}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    df = {w: sum(w in t for t in tok.values()) for w in words if any(w in t for t in tok.values())}
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    for q, text in queries.items():
        for c, t in tok.items():
            want = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split())
            assert got.get((q, c), 0.0) == pytest.approx(want, abs=1e-9)


def test_lexical_on_empty_tables(spark):
    none = spark.createDataFrame([], "chunk_id string, text string, context_header string, company string, fiscal_year int")
    q = spark.createDataFrame([("q", "a b", "a b")], "query_id string, question string, query string")
    index = lexical.Index.build(lexical.corpus(none))
    assert lexical.best_matches(q, index, 5).count() == 0
    assert lexical.best_matches(q.limit(0), index, 5).count() == 0
    assert lexical.infer_filters(q, none).first().company is None


def test_filters_and_relaxation(spark):
    rows = [("c1", "cash", None, "Acme Inc", 2019), ("c2", "x", None, "Acme Inc", None), ("c3", "cash", None, "Beta Acme Works", 2020), (None, "cash", None, "Acme Inc", 2020)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, context_header string, company string, fiscal_year int")
    q = spark.createDataFrame([("a", "cash of ACME INC in 2020"), ("b", "cash of acme in 2019"), ("c", "cash 2018")], "query_id string, query string")
    f = {r.query_id: (r.company, r.fiscal_year) for r in lexical.infer_filters(q, chunks).collect()}
    assert f == {"a": ("Acme Inc", 2020), "b": ("Beta Acme Works", 2019), "c": (None, 2018)}
    index = lexical.Index.build(lexical.corpus(chunks))
    hits = {(r.query_id, r.tier, r.chunk_id) for r in lexical.relaxed_top_k(q, index, lexical.infer_filters(q, chunks), 5).collect()}
    assert {("a", 1, "c1"), ("a", 1, "c2"), ("b", 1, "c3"), ("c", 2, "c1"), ("c", 2, "c2"), ("c", 2, "c3")} == hits
    odd = spark.createDataFrame([("日本電機",), ("The Group",)], "company string")
    asked = spark.createDataFrame([("j", "Umsatz von 日本電機 2020"), ("g", "sales of the group")], "query_id string, query string")
    assert {r.query_id: r.company for r in lexical.infer_filters(asked, odd).collect()} == {"j": "日本電機", "g": "The Group"}
    stated = spark.createDataFrame([("a", "", 2021), ("b", "Nobody", None), ("c", None, None)], "query_id string, company string, fiscal_year int")
    merged = {r.query_id: (r.company, r.fiscal_year, r.explicit) for r in lexical.merged_filters(stated, lexical.infer_filters(q, chunks)).collect()}
    assert merged == {"a": ("Acme Inc", 2021, True), "b": ("Nobody", 2019, True), "c": (None, 2018, False)}


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rows = [(f"c{i}", f"w{i % 7} w{i % 3} all", None, "AB"[i % 2], 2020) for i in range(50)]
    index = lexical.Index.build(lexical.corpus(spark.createDataFrame(rows, "chunk_id string, text string, context_header string, company string, fiscal_year int")))
    q = spark.createDataFrame([(f"q{i}", f"w{i} all", "a" if i % 2 else None) for i in range(9)], "query_id string, query string, company string")
    whole = sorted(map(tuple, lexical.best_matches(q, index, 4).collect()))
    monkeypatch.setattr(lexical, "BLOCK", 2)
    assert sorted(map(tuple, lexical.best_matches(q, index, 4).collect())) == whole and len(whole) == 36


def test_index_is_kept(spark, tmp_path):
    rows = [("a", "net income", None, "A", 2020), ("b", "cash", None, "B", None), ("c", "debt", None, "B", None)]
    index = lexical.Index.build(lexical.corpus(spark.createDataFrame(rows, "chunk_id string, text string, context_header string, company string, fiscal_year int")))
    index.write(str(tmp_path / "index"))
    again = lexical.Index.read(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([("q", "cash")], "query_id string, query string")
    assert again.avgdl == index.avgdl and lexical.best_matches(q, again, 1).first().chunk_id == "b"


def test_dense_ties_and_dirt(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "b", [2.0, 0.0]), (3, "c", [0.0, 1.0]), (4, "d", None), (5, "e", [0.0, 0.0]), (6, "f", [float("nan"), 1.0]), (7, "g", [1.0])]
    v = dense.usable_vectors(spark.createDataFrame(rows, "vec_id long, chunk_id string, embedding array<float>"), 2)
    q = spark.createDataFrame([("q", [3.0, 0.0])], "query_id string, embedding array<float>")
    assert [(r.chunk_id, r["rank"]) for r in dense.nearest(q, v, 2, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert dense.nearest(q.limit(0), v, 2, 2).count() == 0


def test_fusion_and_diversity(spark):
    lists = spark.createDataFrame([("q", 0, 1, "a"), ("q", 0, 2, "a"), ("q", 1, 1, "b"), ("q", 1, 2, "a")], "query_id string, list_no int, rank int, chunk_id string")
    got = {r.chunk_id: (round(r.score, 9), r.seen) for r in fusion.reciprocal_rank_fusion(lists).collect()}
    assert got == {"a": (round(1 / 61 + 1 / 62, 9), 1), "b": (round(1 / 61, 9), 10001)}
    placed = [("q", i, f"c{i}", "d", 1 if i < 7 else None, "table" if i in (3, 4) else "narrative") for i in range(1, 9)]
    rows = spark.createDataFrame(placed, "query_id string, place int, chunk_id string, doc_id string, page int, content_type string")
    assert [r.chunk_id for r in fusion.diversify(rows, 12).orderBy("rank").collect()] == ["c1", "c3", "c7", "c2", "c8"]


def test_page_neighbours(spark):
    fused = spark.createDataFrame([("q", "a", 0.5, 1, "d", 2), ("q", "n", 0.4, 2, "d", None)], "query_id string, chunk_id string, score double, place int, doc_id string, page int")
    docs = spark.createDataFrame([("d", 2, "a"), ("d", 2, "s"), ("d", 3, "t"), ("d", 5, "far"), ("x", 2, "other")], "doc_id string, page int, chunk_id string")
    got = {r.chunk_id: round(r.score, 6) for r in fusion.page_neighbours(fused, docs, 5).collect()}
    assert got == {"s": 0.4999, "t": 0.4995}


def test_rank_metrics(spark):
    rows = [(1, ["a", "b"], ["x", "a", "a", "b"]), (2, ["a"], []), (3, [], ["a"])]
    s = spark.createDataFrame(rows, "sample_id int, gold array<string>, got array<string>")
    m = {r.sample_id: r for r in metrics.sample_metrics(s, "gold", "got").collect()}
    assert set(m) == {1, 2}
    assert (m[1].mrr, m[1].recall_3, m[1].precision_5, m[1].hit_rate_1) == (0.5, 1.0, 0.4, 0.0)
    assert m[2].mrr == 0.0 and metrics.mean_metrics(metrics.sample_metrics(s.limit(0), "gold", "got")).first().n_scored == 0


def test_citations(spark):
    c = "array<struct<company:string,filing:string,source_url:string,page:int,chunk_id:string,section:string,text_snippet:string>>"
    cite = lambda i: ("A", "A_2020", "", 4, i, "", "")
    rows = [
        (1, "Rose 5% [1]. Fell 3%.", [cite("c1")], ["c1"], ["a2020"], ["a2020#p5"], {"c1": "a2020#p5"}),
        (2, "No numbers here.", [], [], [], [], {}),
        (3, None, [], [], [], [], {}),
        (4, "Up 7 [CAFE_p001; 9]", [cite("cafe_p001")], ["z"], [], [], {}),
    ]
    schema = f"sample_id int, answer string, citations {c}, retrieved_chunk_ids array<string>, gold_doc_keys array<string>, gold_page_keys array<string>, chunk_key_index map<string,string>"
    s = spark.createDataFrame(rows, schema)
    assert {r.sample_id: r.coverage for r in citations.coverage(s).collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 1.0}
    assert {r.sample_id: r.validity for r in citations.validity(s).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_calculations(spark):
    rows = [(1, "percentage_change", 3.0, -2.0), (2, "ratio", 2.675, 1.0), (3, "margin", 1.0, 0.0), (4, "nope", 1.0, 1.0), (5, "ratio", None, 1.0), (6, "gross_margin", 10.0, 4.0)]
    got = {r.plan_id: (r.result, r.status) for r in calculations.dispatch(spark.createDataFrame(rows, "plan_id int, operation string, a double, b double")).collect()}
    assert got == {1: (250.0, "ok"), 2: (2.67, "ok"), 3: (None, "division by zero"), 4: (None, "unknown operation"), 5: (None, "missing argument"), 6: (60.0, "ok")}


def test_formula_answer_settings_report(spark, monkeypatch):
    row = calculations.dispatch(spark.createDataFrame([(1, "absolute_change", 3.0, 1.5)], "plan_id int, operation string, a double, b double")).first()
    assert row.formula == "3.0 - 1.5"
    assert [one(spark, calculations.written(F.col("x")), x=x) for x in (12345678.5, -1e7, 0.5, 1e15)] == ["12345678.5", "-10000000.0", "0.5", "1000000000000000.0"]
    cases = {"<|channel|>analysis<|message|>x": "", "a<|channel|>final<|message|> b <|return|>c": "b", "<think>x\ny</think> z": "z", "p<|im_end|>": "p"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.cleaned_answer(F.col("t")).alias("c"))
    assert {r.t: r.c for r in rows.collect()} == cases
    monkeypatch.setenv("QUARRY_MAX_HOPS", "3")
    assert Settings.from_environment().max_hops == 3
    with pytest.raises(ValueError):
        Settings(chunk_size=10, chunk_overlap=10)
    assert files.console_report(spark.createDataFrame([("b", 0.5), ("a", None)], "metric string, value double")) == "a: n/a\nb: 0.500"


def test_number_normalisation(spark):
    cases = {"(1,234)": (-1234.0, ""), "$5.2 million": (5.2, "USD millions"), "12%": (12.0, "percentage"), "—": (None, ""), "N/A": (None, ""), "3 billion USD": (3.0, "USD billions"), "text": (None, "")}
    rows = spark.createDataFrame([(k,) for k in cases], "source string").select("source", calculations.normalized_number(F.col("source")).alias("n"))
    assert {r.source: (r.n.value, r.n.unit) for r in rows.collect()} == cases


def test_units(spark):
    measures = spark.createDataFrame([("revenue", "money", "own"), ("tax", "share", "bp"), ("land", "area", "sqm"), ("oil", "volume", "bbl")], "name string, quantity_kind string, common_unit string")
    cases = [
        (1, "revenue", 3.0, "USD billions", "Total 3", ("USD", 3_000_000_000)),
        (2, "revenue", None, "", "TEUR 2.792.896,54", ("EUR", 2_792_896_540)),
        (3, "revenue", 294.0, "USD", "Total 294 thousand", ("USD", 294_000)),
        (4, "revenue", -1.12, "USD", "| (US$ billions) | 1.12- |", ("USD", -1_120_000_000)),
        (5, "revenue", None, None, "(USD 1.09) B", ("USD", -1_090_000_000)),
        (6, "tax", 87.38, " PERCENT ", None, ("bp", 8738)),
        (7, "land", None, None, "1 395 acres", ("sqm", 5_645_365)),
        (8, "oil", 42.0, "US gallons", None, ("bbl", 1)),
        (9, "revenue", 5.0, "MMbbl", None, None),
        (10, "revenue", float("nan"), "USD", "n.m.", None),
        (11, "revenue", 5.0, None, "see note 7", None),
        (12, "revenue", 5e6, "USD", "USD 5 million", ("USD", 5_000_000)),
        (13, "revenue", 2.0, "Rs. crore", "", ("INR", 20_000_000)),
        (14, "unknown", 2.0, "USD", "", None),
        (None, "revenue", 2.0, "USD", "", None),
    ]
    rows = spark.createDataFrame([c[:5] for c in cases], "input_id long, name string, value double, unit string, source_text string")
    got = {r.id: (r.common_unit, round(r.amount)) for r in units.common_amounts(rows.unionByName(rows), measures).collect()}
    assert got == {c[0]: c[5] for c in cases if c[5]}
    assert units.common_amounts(rows.limit(0), measures).count() == 0


def test_units_by_identities(spark):
    kinds = {"eps_diluted": "per_share", "shares_outstanding": "shares", "net_income": "money", "revenue": "money", "cost_of_revenue": "money", "gross_margin": "share"}
    measures = spark.createDataFrame([(n, k, "x") for n, k in kinds.items()], "name string, quantity_kind string, common_unit string")
    rows = [
        # 2 USD a share x 3 million shares = 6 million USD; the income's column unit lacks the scale that its text gives
        (1, "eps_diluted", 2.0, "USD/share", None, "p"), (2, "shares_outstanding", 3e6, "shares", None, "p"), (3, "net_income", 6.0, "USD", "Net income 6 million", "p"),
        (4, "revenue", 10.0, "USD million", None, "q"), (5, "cost_of_revenue", 7.0, "USD million", None, "q"), (6, "gross_margin", 30.0, "%", None, "q"),
        (7, "revenue", 10.0, "USD", None, "r"), (8, "cost_of_revenue", 9.0, "USD", None, "r"), (9, "gross_margin", 30.0, "%", None, "r"),
        (10, "revenue", 10.0, "USD", None, None), (11, "revenue", 1.0, "USD", None, "s"),
    ]
    df = spark.createDataFrame(rows, "input_id long, name string, value double, unit string, source_text string, chunk_id string")
    got = {r.chunk_id: r for r in units.joint_amounts(df.unionByName(df), measures, ["chunk_id"]).collect()}
    assert set(got) == {"p", "q", "r"}
    assert (got["p"].amounts, got["p"].ids, got["p"].residual, got["p"].not_unique, got["p"].holds) == ([200.0, 3e6, 6e6], [1, 2, 3], 0.0, False, True)
    assert got["q"].amounts == [7e6, 3000.0, 10e6] and got["q"].holds and not got["r"].holds
    assert units.joint_amounts(df.limit(0), measures, ["chunk_id"]).count() == 0


def test_every_record_of_a_name_meets_its_partners(spark):
    kinds = {"eps_diluted": "per_share", "shares_outstanding": "shares", "net_income": "money"}
    measures = spark.createDataFrame([(n, k, "x") for n, k in kinds.items()], "name string, quantity_kind string, common_unit string")
    rows = [
        (1, "eps_diluted", 9.0, "USD/share", None, "p"), (2, "eps_diluted", 2.0, "USD/share", None, "p"), (3, "shares_outstanding", 3e6, "shares", None, "p"),
        (4, "shares_outstanding", 5e6, "shares", None, "p"), (5, "net_income", 1.0, "USD", None, "p"), (6, "net_income", 6e6, "USD", None, "p"),
        (7, "eps_diluted", -2.0, "USD/share", None, "loss"), (8, "shares_outstanding", 3e6, "shares", None, "loss"), (9, "net_income", -6e6, "USD", None, "loss"),
        (10, "net_income", 6e6, "USD", None, "loss"), (11, "net_income", 6e6, "USD", None, None), (None, "net_income", 6e6, "USD", None, "p"),
        *[(100 + i, "eps_diluted", 1.0 + i, "USD/share", None, "many") for i in range(30)], (200, "shares_outstanding", 1e6, "shares", None, "many"), (201, "net_income", 30e6, "USD", None, "many"),
    ]
    df = spark.createDataFrame(rows, "input_id long, name string, value double, unit string, source_text string, chunk_id string")
    got = {tuple(r.ids): r for r in units.joint_amounts(df.unionByName(df), measures, ["chunk_id"]).collect()}
    assert set(got) == {(a, b, c) for a in (1, 2) for b in (3, 4) for c in (5, 6)} | {(7, 8, 9), (7, 8, 10)} | {(100 + i, 200, 201) for i in range(30)}
    assert [k for k, r in sorted(got.items()) if r.holds] == [(2, 3, 6), (7, 8, 9), (129, 200, 201)]
    assert (got[7, 8, 10].residual, got[7, 8, 10].amounts, got[7, 8, 10].solutions, got[7, 8, 10].not_unique) == (None, None, 0, False)
    assert got[7, 8, 9].amounts == [-200.0, 3e6, -6e6] and got[7, 8, 9].residual == 0.0 and got[7, 8, 9].chunk_id == "loss"


def test_filings(spark):
    log = spark.createDataFrame(
        [("a", "p", 1, 1200, 150, "", "complete", 3, "", "p3", 1.0), ("a", "p", 1, 1200, 150, "", "failed", 0, "x", "p3", 2.0), ("b", "q", 1, 1200, 150, "", "complete", 3, "", "p3", 1.0)],
        "doc_id string, pdf_path string, pdf_mtime_ns long, chunk_size int, chunk_overlap int, cache_path string, status string, chunk_count int, error string, parser_version string, updated_at double",
    )
    state = filings.latest_state(log)
    assert {r.doc_id: r.status for r in state.collect()} == {"a": "failed", "b": "complete"}
    wanted = spark.createDataFrame([("a", "p", 1, 1200, 150, "p3"), ("b", "q", 1, 1200, 150, "p3"), ("c", None, None, 1200, 150, "p3")], "doc_id string, pdf_path string, pdf_mtime_ns long, chunk_size int, chunk_overlap int, parser_version string")
    assert {r.doc_id: r.reason for r in filings.stale_documents(state, wanted).collect()} == {"a": "failed", "c": "new"}
    assert filings.stale_documents(filings.upsert(state, state), wanted.filter("doc_id = 'b'")).count() == 0
    docs = spark.createDataFrame([("X_2020_10K", "X", "Xeno Co", "10K", 2020), ("y-1", "Y", "Yar", "10Q", 2019), ("none", "N", "N", "8K", None), ("gone", "ZZ", "Zed Ltd", "10K", 2018)], "doc_id string, ticker string, company string, doc_type string, fiscal_year int")
    paths = spark.createDataFrame([("d/X_2020_10K.pdf",), ("d/Y1.pdf",), ("d/ZED_LTD_2018_10K_v2.pdf",)], "path string")
    assert {r.doc_id: r.tier for r in filings.resolved_paths(docs, paths).collect()} == {"X_2020_10K": 1, "y-1": 2, "gone": 4}


def test_sections_carry_forward(spark):
    pages = spark.createDataFrame([("d", 1, "intro"), ("d", 20, "RISK FACTORS\nx\nConsolidated Balance Sheets"), ("d", 21, None), ("e", 1, "")], "doc_id string, page int, text string")
    got = {(r.doc_id, r.page): r.section for r in filings.page_headings(pages).collect()}
    assert got == {("d", 1): "Unknown", ("d", 20): "Balance Sheet", ("d", 21): "Balance Sheet", ("e", 1): "Unknown"}


def test_chunking(spark):
    text = "First sentence here. " * 120
    assert all(len(p) <= 1200 for p in chunking.split_recursively(text, 1200, 150))
    assert "".join(chunking.split_recursively(text, 500, 0)) == text
    assert chunking.chunk_texts("", 10, 1) == []
    pages = spark.createDataFrame([("d", 1, None, text, ["| a |", " "]), ("d", 2, "Business", None, None), (None, 1, None, "x", None)], "doc_id string, page int, section string, text string, tables array<string>")
    rows = chunking.chunk_pages(pages).collect()
    assert sum(r.content_type == "table" for r in rows) == 1 and any("_n001_c000" in r.chunk_id for r in rows)
    with pytest.raises(ValueError):
        chunking.chunk_pages(pages, 100, 100)
    boxed = spark.createDataFrame([("abTTcd", [("table", 2, 4)]), ("x", None)], "markdown string, boxes array<struct<class:string,start:int,stop:int>>")
    assert {(r.text, tuple(r.tables)) for r in chunking.separate_tables(boxed).collect()} == {("abcd", ("TT",)), ("x", ())}


def test_verdicts_and_routes(spark):
    c = spark.createDataFrame([("a", 0, "X"), ("a", 1, "Y"), ("b", 0, "P"), ("b", 1, "Q"), ("c", 0, "R")], "query_id string, pos int, chunk_id string")
    i = spark.createDataFrame([("a", 0, " x", "Relevant ", 0.9), ("a", 1, "x", "irrelevant", 0.1), ("b", 0, "m", "relevant", 0.8), ("b", 1, "n", "ambiguous", 0.4)], "query_id string, pos int, chunk_id string, verdict string, score double")
    got = {(r.query_id, r.chunk_id): (r.verdict, r.score) for r in corrective.join_verdicts(c, i).collect()}
    assert got == {("a", "X"): ("irrelevant", 0.1), ("a", "Y"): ("ambiguous", 0.5), ("b", "P"): ("relevant", 0.8), ("b", "Q"): ("ambiguous", 0.4), ("c", "R"): ("ambiguous", 0.5)}
    step = lambda *v: one(spark, corrective.next_step(*[F.lit(x) for x in v]))
    assert [step(0, 0, 0, 0, 2), step(0, 2, 0, 0, 2), step(1, 0, 1, 0, 2), step(1, 0, 1, 1, 2), step(0, 2, 1, 0, 2)] == ["rewrite", "aggregate", "advance", "aggregate", "advance"]
    assert one(spark, corrective.negative_evidence(F.lit("Give 0 if not shown in 2019"), F.lit(" Income Statement"), F.lit(2019)))


CHUNKS = "chunk_id string, text string, context_header string, company string, fiscal_year int, section string, page int, doc_id string, doc_type string, source_url string, content_type string"
VECTORS = "vec_id long, chunk_id string, embedding array<float>"


def test_loop_states(spark):
    rows = [
        ("c1", "Net income was 5 million dollars in the period against 4. More text.", None, "A", 2020, "x", None, None, "10K", None, "narrative"),
        ("c2", "Income of the zoo.", None, "A", 2021, "Income Statement", 1, "d", "10K", None, "table"),
    ]
    corpus = hybrid.Corpus.build(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([(1, "c1", [1.0] * 64)], VECTORS))
    q = spark.createDataFrame([("yes", "net income million dollars period ratio"), ("no", "zebra quantum")], "query_id string, question string")
    got = {r.query_id: r for r in corrective.answer_all(q, corpus).collect()}
    yes, no = got["yes"], got["no"]
    assert (yes.status, yes.n_evidence, yes.hops, yes.retries) == ("answer", 1, 1, 0)
    assert yes.citations[0].filing == "2020 10K" and yes.calculation == "\\frac{5.0}{4.0} = 1.25" and "[1]" in yes.answer
    assert yes.log[0].top and (no.status, no.n_evidence, no.retries, no.calculation) == ("abstain", 0, 2, None) and len(no.log) == 3
    # a draft without markers is repaired while a retry is left
    p = corrective.Providers(answer=lambda question, evidence, computed: F.lit("Net income was 5."))
    assert {r.query_id: (r.status, r.answer, r.retries) for r in corrective.answer_all(q.filter("query_id = 'yes'"), corpus, p).collect()} == {"yes": ("answer", "Net income was 5 [1].", 1)}
    assert corrective.answer_all(q.limit(0), corpus).count() == 0


def test_replies_and_goals(spark):
    read = lambda t: one(spark, corrective.classified(F.col("t").cast("string")), t=t)
    good = read('x {no}\n```json\n{"reasoning_type": "numerical", "question_reasoning": "Numerical reasoning", "requires_calculation": true}\n```')
    assert tuple(good) == ("numerical", ["Numerical reasoning"], True, False)
    assert tuple(read("no object")) == ("information_extraction", ["Information extraction"], False, False)
    assert tuple(read(None)) == ("information_extraction", ["Information extraction"], False, False)
    assert tuple(read('{"question_reasoning": ["Logical reasoning", "Guessing"]}')) == ("information_extraction", ["Logical reasoning"], False, False)
    parts = F.expr("array(named_struct('question', ' ', 'evidence_goal', 'x'), named_struct('question', 'b', 'evidence_goal', CAST(NULL AS string)))")
    assert [tuple(p) for p in one(spark, corrective.parts_of(F.col("q"), parts, 2), q="a")] == [("b", "numeric_table")]
    v = lambda *x: tuple(one(spark, corrective.validation(*[F.lit(y) for y in x])))
    assert [v(True, 1, 0), v(False, 1, 0), v(False, 1, 2), v(True, 0, 0)] == [("answer", False), ("answer", True), ("abstain", False), ("abstain", False)]


def test_stated_filters_are_kept(spark):
    rows = [(f"c{i}", "cash flow text", None, "AB"[i % 2], 2020 + i % 3, "x", i, "d", "10K", None, "table") for i in range(12)]
    corpus = hybrid.Corpus.build(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([(i, f"c{i}", [float(i + 1)] + [1.0] * 63) for i in range(12)], VECTORS))
    q = spark.createDataFrame([("a", "cash", "b", None), ("b", "cash", "Nobody", None), ("c", "cash", None, 1990), ("d", "cash 2021", None, None)], "query_id string, question string, company string, fiscal_year int")
    lists = hybrid.candidates(q, corpus, 12, Settings()).select("query_id", "chunk_id").collect()
    got = {k: {r.chunk_id for r in lists if r.query_id == k} for k in "abcd"}
    assert got["a"] == {f"c{i}" for i in range(1, 12, 2)} and got["b"] == set() and len(got["c"]) == 12 and got["d"] == {"c1", "c4", "c7", "c10"}
    ranked = hybrid.search(q, corpus, 2, scorer=lambda question, text: F.length(text)).filter("query_id = 'a'").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2]


def test_json_sources_and_report(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    good = {"question_id": "1", "question": "q", "evidence": [{"doc_name": "d", "evidence_page_num": "", "evidence_text": None}]}
    path.write_text(json.dumps(good) + "\n\nnot json\n")
    rows = files.read_questions(spark, str(path)).collect()
    assert [(r.financebench_id, r.company, r.evidence[0].evidence_page_num, r.evidence[0].evidence_text) for r in rows] == [("1", "", None, "")]
    assert files.read_json_lines(spark, str(path), files.QUESTION)[1].count() == 1
    docs = tmp_path / "d.jsonl"
    docs.write_text(json.dumps({"doc_name": "X", "doc_period": "2019", "document_type": "10k"}))
    assert [(r.doc_id, r.fiscal_year) for r in files.read_documents(spark, str(docs)).collect()] == [("X", 2019)]
    report = spark.read.parquet("/root/testdata/sf0.001/eval_samples.parquet")
    files.write_report(report, str(tmp_path / "r"))
    assert files.read_report(spark, str(tmp_path / "r"), report.schema).count() == report.count()
    header = next((tmp_path / "r" / "samples.csv").glob("part-*")).read_text().splitlines()[0].split(",")
    assert len(header) == 15 and header[:3] == ["question_id", "question", "status"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pdf").write_bytes(b"one")
    (tmp_path / "p" / "b.pdf").write_bytes(b"bad")

    def parse(content):
        if content == b"bad":
            raise ValueError("broken")
        return [(1, content.decode(), ["t"])]

    assert {(r.error, r.text) for r in files.read_pages(spark, str(tmp_path / "p"), parse).collect()} == {(None, "one"), ("broken", None)}


def test_kept_tables(spark, tmp_path):
    store = vector_store.Collection(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        store.rows()
    assert not store.exists() and store.create().count() == 0 and store.exists()
    rows = spark.createDataFrame([("a", 1, [1.0], "m"), ("b", 2, [1.0], "m")], vector_store.SCHEMA)
    store.upsert(rows)
    store.upsert(rows.filter("chunk_id = 'a'").withColumn("model", F.lit("n")))
    assert {r.chunk_id: r.model for r in store.rows().collect()} == {"a": "n", "b": "m"}
    with pytest.raises(ValueError):
        store.upsert(rows.unionByName(rows))
    assert store.reset().count() == 0
    chunks = spark.createDataFrame([("a", "d"), ("b", "e")], "chunk_id string, doc_id string")
    files.write_chunk_cache(chunks, str(tmp_path / "cache"))
    files.write_chunk_cache(chunks.filter("doc_id = 'd'").withColumn("chunk_id", F.lit("a2")), str(tmp_path / "cache"))
    assert {r.chunk_id for r in files.read_chunk_cache(spark, str(tmp_path / "cache"), chunks).collect()} == {"a2", "b"}
    m = filings.manifest(chunks, "doc_id", "k")
    assert {r.rebuild for r in filings.manifest_changes(files.read_manifest(spark, str(tmp_path / "m"), m), m, "doc_id").collect()} == {True}
    files.write_manifest(m, str(tmp_path / "m"))
    assert {r.rebuild for r in filings.manifest_changes(files.read_manifest(spark, str(tmp_path / "m"), m), m, "doc_id").collect()} == {False}
    assert set(filings.empty_state(spark).columns) == {"doc_id", *filings.STATE_DEFAULTS} and filings.empty_state(spark).count() == 0


def test_second_pass_and_judge(spark):
    s = spark.createDataFrame([(1, "q1"), (2, "q9")], "sample_id int, question_id string")
    q = spark.createDataFrame([("q1", "yes", [("d", 1, "t"), ("d", 2, None)]), ("q2", None, None)], "financebench_id string, answer string, evidence array<struct<doc_name:string,evidence_page_num:int,evidence_text:string>>")
    assert [(r.sample_id, r.reference, r.reference_contexts) for r in runs.second_pass(s, q).collect()] == [(1, "yes", ["t"])]
    with pytest.raises(ValueError):
        runs.second_pass(s.filter("sample_id = 2"), q)
    judge = spark.createDataFrame([("q1", 1, 0.5), ("q1", 2, float("nan"))], "question_id string, turn int, faithfulness double")
    assert {r.sample_id: r.faithfulness for r in runs.judged(s, judge, ["faithfulness"]).collect()} == {1: None, 2: None}
    assert [r.place for r in runs.numbered(spark.createDataFrame([("fb_00002",), ("fb_00001",), ("zz",)], "k string"), "k").orderBy("k").collect()] == [0, 1, 2]


def test_json_values(spark):
    rows = spark.createDataFrame([("a {b [1, 2] {\"c\": \"}\"}",), ("none",), (None,), ("{\"x\": {\"y\": [1]}} tail",)], "t string")
    assert [r.found for r in calculations.first_json(rows, "t", "found").collect()] == ["[1, 2]", None, None, '{"x": {"y": [1]}}']


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = events.append_batches(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    total = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0]
    assert total == spark.read.parquet(source).count()
    windows = events.windowed_counts(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    windows.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == total
    held = events.sessions(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("s").outputMode("complete").trigger(availableNow=True).start()
    held.awaitTermination(120)
    assert spark.table("s").agg(F.sum("n")).first()[0] == total
