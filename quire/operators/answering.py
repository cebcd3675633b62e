"""Question routing, guards, sentence attribution and answer evaluation as Column and DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_tokens, sentences
from ..session import cut

# Patterns that decide routes, guards and answer shapes.
GREETING = r"(?i)^\s*(hi|hello|hey|thanks|thank you|ok|okay|yo|cool|great)\b[\s!.?]*$"
META = r"(?i)\b(what can you do|who are you|how do you work|what are you|help me use)\b"
MULTI = (
    r"(?i)\b(compare|comparison|versus|vs\.?|difference(?:s)? between|differ|both|each (?:of|document|doc|file)|across (?:all|the|every)|every document|"
    r"all (?:the )?(?:documents|invoices|docs|files|policies|certificates)|as well as|and also)\b"
)
FOLLOWUP = r"(?i)\b(?:this|that|these|those|it|they|them|the\s+(?:first|second|last|above|previous|same|other|former|latter|one|ones|following))\b"
DESTRUCTIVE = (
    r"(?i)\b(delete|remove|erase|wipe|destroy|purge|drop|clear)\b[\w\s]{0,20}"
    r"\b(document|doc|docs|file|files|everything|all|data|workspace)\b"
)
COMPARE = r"(?i)\b(compare|comparison|across all|each of|all (?:my|the)|list all|every|both|side by side|which is (?:my|the) (?:oldest|newest|largest|highest|lowest))\b"
OF_KIND = r"(?i)\b(which|list|show|how many|do (?:i|any))\b.{0,40}?\b(documents?|invoices?|ids?|passports?|statements?|reports?|certificates?|receipts?|licen[cs]es?|policies|contracts?|forms?|bills?)\b"
SINGLE = r"(?i)\b(what(?:'s| is)|how much|how many|when(?:'s| is)|balance|total|amount|due|date|number|value|price|rate|expir|valid (?:until|through|to))\b"
ATTRIBUTE = r"(?i)\b(who(?:'s| is)?|whose|name(?:d)?|applicant|holder|owner|issued to|payee|patient|beneficiary|employer|employee|landlord|tenant|buyer|seller|vendor|account holder|policyholder|insured)\b"
SENTINEL = "INSUFFICIENT_EVIDENCE"
# How answers say that they have nothing.
DECLINES = (
    "insufficient_evidence", "insufficient evidence", "not found in the retrieved evidence", "i don't have", "i do not have", "cannot find", "no evidence",
    "not in this document", "not in the document", "not mentioned", "not stated", "not provided", "not specified", "does not contain", "doesn't contain", "no information",
)


def route(question: Column) -> Column:
    q = F.trim(F.coalesce(question, F.lit("")))
    return F.when((q == "") | q.rlike(GREETING) | q.rlike(META), "no_retrieval").when(q.rlike(MULTI), "multi_hop").otherwise("single_hop")


def followup(question: Column) -> Column:
    """Three words or fewer, or a word that points back."""
    q = F.trim(F.coalesce(question, F.lit("")))
    return (q != "") & ((F.size(F.split(q, r"\s+")) <= 3) | q.rlike(FOLLOWUP))


def fragments(question: Column) -> Column:
    """Answer shapes a question asks for, strongest first."""
    q = F.coalesce(question, F.lit(""))
    compare = q.rlike(COMPARE)
    return F.array_compact(F.array(F.when(compare, "compare"), F.when(q.rlike(OF_KIND), "of_kind"), F.when(q.rlike(SINGLE) & ~compare, "single"), F.when(q.rlike(ATTRIBUTE), "attribute")))


def expected_format(question: Column) -> Column:
    f = fragments(question)
    has = lambda x: F.array_contains(f, x)
    return F.when(has("compare"), "table").when(has("of_kind"), "filtered-list").when(has("single"), "one-line").when(has("attribute"), "attribute").otherwise("free")


def declines(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    out = F.lit(False)
    for m in DECLINES:
        out = out | low.contains(m)
    return out


def abstain(hits: DataFrame, key: str, score: str, min_hits: int = 1, floor: float | None = None) -> DataFrame:
    """(key, n, top, abstain): too few passages, or the best numeric score below the floor."""
    per = hits.groupBy(key).agg(F.count("*").alias("n"), F.max(score).alias("top"))
    weak = F.lit(False) if floor is None else F.coalesce(F.col("top") < floor, F.lit(False))
    return per.withColumn("abstain", (F.col("n") < min_hits) | weak)


def attribute(answers: DataFrame, passages: DataFrame, least: float = 0.5) -> DataFrame:
    """(answer, pos, support, supported, passage): each sentence's best passage of the same answer.

    ``answers``: answer, text; ``passages``: answer, passage, text.  Support is the share of the sentence's
    content words in the passage; the first of equal passages wins, and none below ``least``.
    """
    s = answers.select("answer", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).select("answer", "pos", content_tokens(F.col("sentence")).alias("s"))
    p = passages.select("answer", "passage", content_tokens(F.col("text")).alias("p"))
    met = s.join(p, "answer", "left")
    shared = F.size(F.array_intersect("s", F.coalesce("p", F.array().cast("array<string>"))))
    scored = met.withColumn("support", F.when(F.size("s") > 0, shared / F.size("s")).otherwise(0.0))
    first = F.row_number().over(Window.partitionBy("answer", "pos").orderBy(F.desc("support"), F.asc("passage")))
    best = scored.withColumn("k", first).filter("k = 1")
    ok = (F.col("support") >= least) & (F.col("support") > 0)
    return best.select("answer", "pos", F.round("support", 3).alias("support"), ok.alias("supported"), F.when(ok, F.col("passage")).alias("passage"))


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), r"\s+", " "))


def facts_present(facts: Column, text: Column) -> Column:
    """Share of facts that the text holds; null without facts."""
    held = F.filter(F.coalesce(facts, F.array().cast("array<string>")), lambda f: F.coalesce(f, F.lit("")) != "")
    hits = F.filter(held, lambda f: (_norm(f) != "") & _norm(text).contains(_norm(f)))
    return F.when(F.size(held) > 0, F.size(hits) / F.size(held))


def score_cases(cases: DataFrame) -> DataFrame:
    """Adds faithfulness_proxy, answer_correctness_proxy, citation_recall and abstention to evaluation cases."""
    did, should = declines(F.col("answer")), F.coalesce(F.col("should_abstain"), F.lit(False))
    must = F.array_distinct(F.coalesce("must_cite", F.array().cast("array<string>")))
    recall = F.when(F.size(must) > 0, F.size(F.array_intersect(F.coalesce("citations", F.array().cast("array<string>")), must)) / F.size(must))
    return cases.withColumns({
        "faithfulness_proxy": facts_present(F.col("expected"), F.array_join("contexts", "\n")),
        "answer_correctness_proxy": facts_present(F.col("expected"), F.col("answer")),
        "citation_recall": recall,
        "abstention": F.when(should & did, "correct_abstain").when(should, "missed_abstain").when(did, "over_abstain").otherwise("answered"),
    })


def summary(scored: DataFrame) -> DataFrame:
    """Mean scores of evaluation cases, and how often they abstained rightly, too seldom or too often."""
    mean = lambda c: F.round(F.avg(c), 4)
    n = lambda v: F.count_if(F.col("abstention") == v).alias(v)
    return scored.agg(mean("faithfulness_proxy").alias("faithfulness"), mean("answer_correctness_proxy").alias("correctness"), mean("citation_recall").alias("citation"), n("correct_abstain"), n("missed_abstain"), n("over_abstain"))


def answer_chain(questions: DataFrame, handlers: list[tuple[str, Column, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(qid, handler, answer) of every question: the first handler that answers wins, null where none does.

    A handler is a name, a guard over the question's columns and a function from questions to (qid, answer).  One pass
    tells which guards each question passes; a handler then sees only the questions that pass its guard and have no
    answer yet, and none that no question passes is run.  Null answers leave a question open.
    """
    plays = F.array_compact(F.array(*(F.when(guard, F.lit(i)) for i, (_, guard, _) in enumerate(handlers))))
    marked = cut(questions.withColumn("_plays", plays))
    asked = {r[0] for r in marked.select(F.explode("_plays")).distinct().collect()}  # a row for each handler at most
    done = None
    for i, (name, _, answer) in enumerate(handlers):
        if i not in asked:
            continue
        still = marked.filter(F.array_contains("_plays", i)).drop("_plays")
        still = still if done is None else still.join(done.select("qid"), "qid", "left_anti")
        said = answer(still).filter("answer IS NOT NULL").groupBy("qid").agg(F.min("answer").alias("answer"))
        said = cut(said.select("qid", F.lit(name).alias("handler"), "answer"))
        done = said if done is None else done.unionByName(said)
    if done is None:
        return questions.select("qid", F.lit(None).cast("string").alias("handler"), F.lit(None).cast("string").alias("answer"))
    return questions.select("qid").join(done, "qid", "left")
