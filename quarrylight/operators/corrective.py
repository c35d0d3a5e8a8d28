"""The corrective question-answering loop as operations on a table of loop states.

One row per query is the state; a bounded driver loop applies retrieval,
grading and routing to the rows that are still active.  Model calls sit behind
``Providers``; the offline ones are deterministic column expressions and keep
the control flow, not the quality, of a language model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import calculations, citations, hybrid
from quarrylight.operators.fusion import term_overlap
from quarrylight.session import materialise
from quarrylight.settings import Settings

RELEVANT, AMBIGUOUS = 0.5, 0.25  # offline grader: share of the question's terms in a chunk
LAST_RESORT = 0.4  # ambiguous evidence from this score on is accepted at the last retry
GRADED, SEEN = 8, 2000  # candidates shown to the grader, and characters of each text
LOGGED, CITED, SNIPPET = 5, 5, 200
ABSTENTION = "The available evidence is not sufficient to answer this question."
# Labels that a classifier may give, and goals that evidence can have.
REASONING = ["Information extraction", "Numerical reasoning", "Logical reasoning"]
GOALS = ["numeric_table", "narrative_explanation", "cross_reference"]
MAX_RETRIES, MAX_HOPS = Settings().max_retries, Settings().max_hops


def offline_reply(question: Column) -> Column:
    """A classifier's reply by the question's wording, as JSON text."""
    folded = T.fold(question)
    computes = folded.rlike("ratio|margin|percent|change|growth|difference")
    compares = (F.size(T.years(question)) > 1) | folded.rlike("improved|increase|decrease|since")
    kind = F.when(computes, "numerical_reasoning").when(compares, "logical_reasoning").otherwise("information_extraction")
    labels = F.array_compact(F.array(F.lit(REASONING[0]), F.when(computes, REASONING[1]), F.when(compares, REASONING[2])))
    return F.to_json(
        F.struct(
            kind.alias("reasoning_type"),
            labels.alias("question_reasoning"),
            computes.alias("requires_calculation"),
            compares.alias("requires_multi_year_comparison"),
        )
    )


def offline_parts(question: Column) -> Column:
    """The question itself, or one part per year where it names several."""
    goal = F.when(T.prefers_tables(question), GOALS[0]).otherwise(GOALS[1])
    part = lambda text: F.struct(text.alias("question"), goal.alias("evidence_goal"))
    years = T.years(question)
    by_year = F.transform(years, lambda y: part(F.concat(question, F.lit(" ("), y.cast("string"), F.lit(")"))))
    return F.when(F.size(years) > 1, by_year).otherwise(F.array(part(question)))


def offline_plan(question: Column, text: Column) -> Column:
    """``(operation, a, b)`` from the first two figures of the evidence, or null."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(""))
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"(?<![\w.])(\d{1,15}(?:\.\d{1,6})?)(?![\w])"), F.lit(1)), lambda x: x.cast("double"))
    folded = T.fold(question)
    operation = F.when(folded.contains("ratio"), "ratio").when(folded.contains("margin"), "margin").otherwise("percentage_change")
    return F.when(F.size(found) > 1, F.struct(operation.alias("operation"), found[0].alias("a"), found[1].alias("b")))


def first_sentence(question: Column, evidence: Column, computed: Column) -> Column:
    """The first sentence of the first evidence and the computed result if there is one, with markers."""
    stated = F.coalesce(F.try_element_at(T.sentences(F.element_at(evidence, 1)["text"]), F.lit(1)), F.lit("See the evidence."))
    return F.concat(cite_first(stated), F.coalesce(F.concat(F.lit(" Computed: "), computed.cast("string"), F.lit(" [1].")), F.lit("")))


def cite_first(draft: Column) -> Column:
    """The draft with a marker of the first evidence behind every sentence that has none."""
    return F.array_join(F.transform(T.sentences(draft), lambda s: F.when(F.size(T.markers(s)) > 0, s).otherwise(F.regexp_replace(s, r"(?s)^(.*?)([.!?]*)$", "$1 [1]$2"))), " ")


@dataclass(frozen=True)
class Providers:
    """Replaceable model calls; each maps columns to a column."""

    classify: Callable[[Column], Column] = offline_reply
    decompose: Callable[[Column], Column] = offline_parts
    score: Callable[[Column, Column], Column] = term_overlap
    rewrite: Callable[[Column], Column] = T.keyword_query
    plan: Callable[[Column, Column], Column] = offline_plan
    answer: Callable[[Column, Column, Column], Column] = first_sentence
    repair: Callable[[Column], Column] = cite_first


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply: of its fenced block if it has one, from the first { to the last }; or null."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    inner = F.when(reply.rlike(fence), F.regexp_extract(reply, fence, 1)).otherwise(reply)
    found = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    return F.nullif(found, F.lit(""))


def classified(reply: Column) -> Column:
    """``(question_type, reasoning, requires_calculation, multi_year)`` read from a classifier's reply.

    Labels that are not allowed are dropped, a single label counts as a list; a
    reply without a readable object gives information_extraction.
    """
    schema = "reasoning_type string, question_type string, question_reasoning string, requires_calculation boolean, requires_multi_year_comparison boolean, broken string"
    read = F.from_json(json_object(reply), schema, {"columnNameOfCorruptRecord": "broken"})
    bad = read.isNull() | read["broken"].isNotNull()
    many = F.coalesce(F.from_json(read["question_reasoning"], "array<string>"), F.array(read["question_reasoning"]))
    allowed = F.filter(many, lambda x: x.isin(*REASONING))
    return F.struct(
        F.when(bad, "information_extraction").otherwise(F.coalesce(read["reasoning_type"], read["question_type"], F.lit("information_extraction"))).alias("question_type"),
        F.when(bad, F.array(F.lit(REASONING[0]))).otherwise(F.coalesce(allowed, F.expr("CAST(array() AS array<string>)"))).alias("reasoning"),
        F.coalesce(F.when(~bad, read["requires_calculation"]), F.lit(False)).alias("requires_calculation"),
        F.coalesce(F.when(~bad, read["requires_multi_year_comparison"]), F.lit(False)).alias("multi_year"),
    )


def parts_of(question: Column, parts: Column, limit: int) -> Column:
    """Array of ``(question, evidence_goal)``, at most ``limit``: blank parts are dropped, without parts the question is the only one."""
    default = F.lit(GOALS[0])
    good = F.filter(parts, lambda p: F.trim(F.coalesce(p["question"], F.lit(""))) != "")
    filled = F.transform(good, lambda p: F.struct(p["question"].alias("question"), F.coalesce(p["evidence_goal"], default).alias("evidence_goal")))
    whole = F.array(F.struct(question.alias("question"), default.alias("evidence_goal")))
    return F.slice(F.when(F.size(F.coalesce(filled, F.expr("CAST(array() AS array<struct<question:string,evidence_goal:string>>)"))) > 0, filled).otherwise(whole), 1, limit)


def active_goal(goals: Column, hop: Column) -> Column:
    """What evidence the hop looks for; a table of numbers where nothing says so."""
    return F.coalesce(F.try_element_at(goals, hop + 1), F.lit(GOALS[0]))


def citation_of(company: Column, doc_id: Column, year: Column, kind: Column, url: Column, page: Column, chunk_id: Column, section: Column, text: Column) -> Column:
    """A chunk as a citation; without a document id the filing is named by year and type."""
    named = F.concat_ws(" ", F.coalesce(year.cast("string"), F.lit("?")), F.coalesce(kind, F.lit("?")))
    return F.struct(
        F.coalesce(company, F.lit("Unknown")).alias("company"),
        F.coalesce(F.nullif(doc_id, F.lit("")), named).alias("filing"),
        F.coalesce(url, F.lit("")).alias("source_url"),
        page.alias("page"),
        chunk_id.alias("chunk_id"),
        F.coalesce(section, F.lit("")).alias("section"),
        F.substring(F.coalesce(text, F.lit("")), 1, SNIPPET).alias("text_snippet"),
    )


def validation(passed: Column, n_evidence: Column, retry: Column, max_retries: int = MAX_RETRIES) -> Column:
    """``(status, repaired)`` of a draft: repaired once while a retry is left, which then counts as passed.

    Without evidence, and after a failure at the last retry, the answer is an abstention.
    """
    repairs = ~passed & (retry < max_retries) & (n_evidence > 0)
    status = F.when(n_evidence == 0, "abstain").when(passed | repairs, "answer").otherwise("abstain")
    return F.struct(status.alias("status"), repairs.alias("repaired"))


def verdict(score: Column) -> Column:
    return F.when(score >= RELEVANT, "relevant").when(score >= AMBIGUOUS, "ambiguous").otherwise("irrelevant")


def join_verdicts(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """``(query_id, pos, chunk_id, verdict, score)`` of candidates with the grader's items.

    Both sides have ``query_id, pos, chunk_id`` (items also ``verdict, score``).
    Items meet candidates by chunk id without case and blanks, the last of
    equal ids counting; a query none of whose items meets any candidate, but
    with as many items as candidates, is joined by place; what is left is
    ambiguous at 0.5.
    """
    key = lambda c: F.lower(F.trim(c))
    last = items.withColumn("k", key("chunk_id")).groupBy("query_id", "k").agg(F.max_by(F.struct("verdict", "score"), "pos").alias("named"))
    c = candidates.withColumn("k", key("chunk_id")).join(last, ["query_id", "k"], "left")
    c = c.join(items.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_items")), "query_id", "left")
    w = W.partitionBy("query_id")
    c = c.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("met", F.count("named").over(w))
    placed = items.select("query_id", "pos", F.struct("verdict", "score").alias("placed"))
    c = c.join(placed, ["query_id", "pos"], "left")
    by_place = F.when((F.col("met") == 0) & (F.col("n") == F.col("n_items")), F.col("placed"))
    v = F.coalesce("named", by_place)
    return c.select(
        "query_id", "pos", "chunk_id", F.coalesce(key(v["verdict"]), F.lit("ambiguous")).alias("verdict"), F.coalesce(v["score"], F.lit(0.5)).alias("score")
    )


def negative_evidence(question: Column, section: Column, fiscal_year: Column) -> Column:
    """Whether a chunk can show that a requested row is absent from an income statement."""
    asked = F.regexp_extract_all(question, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1))
    in_year = (F.size(asked) == 0) | F.coalesce(F.array_contains(asked, fiscal_year.cast("string")), F.lit(False))
    return T.conditional_zero(question) & (F.lower(F.trim(section)) == "income statement") & in_year


def accepted(graded: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The graded chunks (with ``retry``) that become evidence.

    Relevant ones; where a query has none at its last retry, ambiguous ones
    from ``LAST_RESORT`` on.
    """
    good = F.col("verdict") == "relevant"
    none = F.sum(good.cast("int")).over(W.partitionBy("query_id")) == 0
    rescued = none & (F.col("retry") >= max_retries) & (F.col("verdict") == "ambiguous") & (F.col("score") >= LAST_RESORT)
    return graded.withColumn("kept", good | rescued).filter("kept").drop("kept")


def next_step(accepted_n: Column, retry: Column, evidence_n: Column, hop: Column, hops: Column, max_retries: int = MAX_RETRIES) -> Column:
    """Where a state goes after grading."""
    return (
        F.when((accepted_n == 0) & (retry < max_retries), "rewrite")
        .when((accepted_n == 0) & (evidence_n == 0), "aggregate")
        .when(hop + 1 < hops, "advance")
        .otherwise("aggregate")
    )


def distinct_evidence(rows: DataFrame) -> DataFrame:
    """Evidence ``(query_id, pos, chunk_id, ...)`` without repeated chunk ids, the first kept; a null id is one id."""
    w = W.partitionBy("query_id", F.coalesce("chunk_id", F.lit(""))).orderBy("pos")
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def graded(hits: DataFrame, docs: DataFrame, asked: DataFrame, providers: Providers) -> DataFrame:
    """The first hits of each query with the grader's score and verdict.

    ``asked`` has ``query_id, active, retry``; the grader sees the beginning of
    the chunk's text, without its header.
    """
    shown = docs.select("chunk_id", F.substring("text", 1, SEEN).alias("seen"), "section", "fiscal_year")
    rows = hits.filter(F.col("rank") <= GRADED).select("query_id", "rank", "chunk_id").join(shown, "chunk_id").join(asked, "query_id")
    raw = providers.score(F.col("active"), F.coalesce("seen", F.lit("")))
    zero = F.coalesce(negative_evidence(F.col("active"), F.col("section"), F.col("fiscal_year")), F.lit(False))
    score = F.when(zero, F.greatest(raw, F.lit(0.8))).otherwise(raw)
    return rows.withColumn("score", F.round(score, 6)).withColumn("verdict", F.when(zero, "relevant").otherwise(verdict(F.col("score"))))


def answer_all(questions: DataFrame, corpus: hybrid.Corpus, providers: Providers | None = None, settings: Settings | None = None) -> DataFrame:
    """The response to every question.

    ``questions`` has ``query_id, question`` and may have stated filters
    (``company``, ``fiscal_year``).  At most hops x (retries + 1) rounds of the
    hybrid search run; the state keeps chunk ids, not texts, and is written to
    the shared folder after each round.  Columns: ``query_id, status, answer,
    question_type, hops, retries, n_evidence, citations, chunks, calculation,
    log``; ``chunks`` are the hits of the last round, ``log`` the first hits of
    every round.
    """
    p, s = providers or Providers(), settings or Settings.from_environment()
    docs = corpus.docs
    for name, kind in (("company", "string"), ("fiscal_year", "int")):
        if name not in questions.columns:
            questions = questions.withColumn(name, F.lit(None).cast(kind))
    ids = F.expr("CAST(array() AS array<string>)")
    log_type = "array<struct<hop:int,retry:int,query:string,chunks:int,top:array<string>>>"
    asked = questions.select("query_id", "question", "company", "fiscal_year").withColumn("c", classified(p.classify(F.col("question"))))
    asked = asked.withColumn("parts", parts_of(F.col("question"), p.decompose(F.col("question")), s.max_hops))
    state = asked.select(
        "query_id", "question", "company", "fiscal_year", F.col("c.question_type").alias("question_type"),
        F.col("c.requires_calculation").alias("calculates"),
        F.transform("parts", lambda x: x["question"]).alias("subs"),
        F.transform("parts", lambda x: x["evidence_goal"]).alias("goals"),
        F.lit(0).alias("hop"), F.lit(0).alias("retry"), F.lit("retrieve").alias("step"),
        F.lit(False).alias("same"), ids.alias("evidence"), ids.alias("chunks"), F.expr(f"CAST(array() AS {log_type})").alias("log"),
    )
    state = materialise(state.withColumn("active", F.element_at("subs", 1)), "state")
    hits = None  # of the round before: a query that its rewriting leaves as it was needs no second search
    for _ in range(s.max_hops * (s.max_retries + 1)):
        running = state.filter(F.col("step") == "retrieve")
        if running.isEmpty():
            break
        wanted = running.filter("NOT same").select("query_id", F.col("active").alias("question"), "company", "fiscal_year", active_goal(F.col("goals"), F.col("hop")).alias("goal"))
        kept = hits.join(running.filter("same").select("query_id"), "query_id", "left_semi") if hits is not None else None
        if kept is None or not wanted.isEmpty():
            news = hybrid.search(wanted, corpus, settings=s)
            kept = news if kept is None else news.unionByName(kept)
        hits = materialise(kept, "hits")
        judged = graded(hits, docs, running.select("query_id", "active", "retry"), p)
        new = accepted(judged, s.max_retries).groupBy("query_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("new")
        )
        found = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("found"))
        joined = running.join(new, "query_id", "left").join(found, "query_id", "left").withColumns({"new": F.coalesce("new", ids), "found": F.coalesce("found", ids)})
        joined = joined.withColumn("added", F.array_except("new", "evidence"))
        entry = F.struct(
            F.col("hop").alias("hop"), F.col("retry").alias("retry"), F.col("active").alias("query"),
            F.size("found").alias("chunks"), F.slice("found", 1, LOGGED).alias("top"),
        )
        moved = joined.withColumns({"evidence": F.concat("evidence", "added"), "log": F.concat("log", F.array(entry)), "chunks": F.col("found")})
        moved = moved.withColumn("go", next_step(F.size("added"), F.col("retry"), F.size("evidence"), F.col("hop"), F.size("subs"), s.max_retries))
        rewrite, advance = F.col("go") == "rewrite", F.col("go") == "advance"
        changed = moved.withColumns(
            {
                "same": rewrite & (p.rewrite(F.col("active")) == F.col("active")),
                "active": F.when(rewrite, p.rewrite(F.col("active"))).when(advance, F.try_element_at("subs", F.col("hop") + 2)).otherwise(F.col("active")),
                "retry": F.when(rewrite, F.col("retry") + 1).when(advance, 0).otherwise(F.col("retry")),
                "hop": F.when(advance, F.col("hop") + 1).otherwise(F.col("hop")),
                "step": F.when(rewrite | advance, "retrieve").otherwise("aggregate"),
            }
        ).select(*state.columns)
        state = materialise(state.filter(F.col("step") != "retrieve").unionByName(changed), "state")
    return responses(state, docs, p, s)


def responses(state: DataFrame, docs: DataFrame, p: Providers, s: Settings) -> DataFrame:
    """Calculation, draft, check of its citations with one repair, and the response of finished loop states."""
    meta = docs.select("chunk_id", "company", "doc_id", "fiscal_year", "doc_type", "source_url", "page", "section", "text")
    held = state.select("query_id", F.posexplode("evidence").alias("pos", "chunk_id")).join(meta, "chunk_id")
    cite = citation_of(*[F.col(c) for c in ("company", "doc_id", "fiscal_year", "doc_type", "source_url", "page", "chunk_id", "section", "text")])
    texts = held.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_id", "text"))), lambda x: F.struct(x["chunk_id"], x["text"])).alias("texts"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", cite.alias("c")))), lambda x: x["c"]).alias("citations"),
    )
    full = state.join(texts, "query_id", "left")
    plan = p.plan(F.col("question"), F.element_at("texts", 1)["text"])
    plans = full.filter(F.col("calculates") & (F.size("texts") > 0)).select(F.col("query_id").alias("plan_id"), plan.alias("plan")).filter("plan IS NOT NULL")
    done = calculations.dispatch(plans.select("plan_id", "plan.*")).select(F.col("plan_id").alias("query_id"), "operation", "formula", "result", F.col("status").alias("calc"))
    drafted = full.join(done, "query_id", "left").withColumn("n_evidence", F.size("evidence"))
    drafted = drafted.withColumn("draft", F.when(F.col("n_evidence") > 0, p.answer(F.col("question"), F.col("texts"), F.col("result"))))
    drafted = materialise(drafted, "drafts")
    cover = citations.coverage(drafted.select(F.col("query_id").alias("sample_id"), F.col("draft").alias("answer"), "citations"))
    checked = drafted.join(cover.withColumnRenamed("sample_id", "query_id"), "query_id").withColumn(
        "v", validation(F.col("coverage") == 1, F.col("n_evidence"), F.col("retry"), s.max_retries)
    )
    answer = F.when(F.col("n_evidence") == 0, ABSTENTION).when(F.col("v.repaired"), p.repair(F.col("draft"))).otherwise(F.col("draft"))
    computed = F.when(F.col("calc") == "ok", F.concat_ws(" = ", "formula", F.col("result").cast("string")))
    return checked.select(
        "query_id", F.col("v.status").alias("status"), answer.alias("answer"), "question_type", (F.col("hop") + 1).alias("hops"),
        (F.col("retry") + F.col("v.repaired").cast("int")).alias("retries"), "n_evidence",
        F.slice(F.coalesce("citations", F.expr("CAST(array() AS array<struct<company:string,filing:string,source_url:string,page:int,chunk_id:string,section:string,text_snippet:string>>)")), 1, CITED).alias("citations"),
        "chunks", computed.alias("calculation"), "log",
    )
