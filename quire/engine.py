"""One entry point over a session and a scope: the operators under the names a user asks for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import answering, documents, graph, insights, reconcile, records, retrieval, views
from .session import Scope
from .sources import readers

#: Model-backed steps and their defaults without a model; replace an entry to plug one in.
HOOKS: dict[str, Callable] = {
    "embed": lambda df, key, column: documents.embed(df, key, column),
    "rerank": lambda hits: hits,
    "rewrite": lambda question: question,
    "decompose": lambda question: [question],
    "summarise": lambda text: "",
    "translate": lambda text, language: text,
    "categorise": lambda merchant: "Other",
}


@dataclass
class Engine:
    spark: SparkSession
    scope: Scope = field(default_factory=Scope)
    hooks: dict[str, Callable] = field(default_factory=lambda: dict(HOOKS))

    def scoped(self, df: DataFrame) -> DataFrame:
        """Rows in scope; tables without a scope column pass only an open scope."""
        return self.scope.apply(df)

    def ingest(self, path: str) -> DataFrame:
        return readers.parse(readers.files(self.spark, path))

    def chunks(self, docs: DataFrame, key: str = "doc_id", column: str = "text", **options) -> DataFrame:
        return documents.chunks(self.scoped(docs), key, column, **options)

    def redact(self, docs: DataFrame, key: str = "doc_id", column: str = "text", **options) -> DataFrame:
        return documents.redact(self.scoped(docs), key, column, **options)

    def search(self, queries: DataFrame, docs: DataFrame, k: int = 12, pool: int = 200) -> DataFrame:
        """Fused lexical and vector ranking of ``docs`` (doc, text) for ``queries`` (qid, text)."""
        docs = self.scoped(docs)
        lexical = retrieval.bm25(queries, docs, pool)
        q, d = self.hooks["embed"](queries, "qid", "text"), self.hooks["embed"](docs, "doc", "text")
        vector = retrieval.cosine_topk(q, d.select(F.col("doc").alias("vid"), "vec"), pool).withColumnRenamed("vid", "doc")
        return self.hooks["rerank"](retrieval.fused_top(retrieval.rrf(lexical, vector), k))

    def insights(self, expense: DataFrame, party: str = "party", amount: str = "amount") -> DataFrame:
        return insights.concentration(self.scoped(expense), party, amount)

    def payments(self, receipts: DataFrame, lines: DataFrame) -> DataFrame:
        return reconcile.match_payments(self.scoped(receipts), lines)

    def alerts(self, docs: DataFrame, as_of: str) -> DataFrame:
        return records.alerts(self.scoped(docs), as_of)

    def view(self, docs: DataFrame, spec: dict, as_of: str) -> DataFrame:
        return views.view(self.scoped(docs), spec, as_of)

    def identities(self, mentions: DataFrame) -> DataFrame:
        return graph.identities(self.scoped(mentions))

    def attribute(self, answers: DataFrame, passages: DataFrame) -> DataFrame:
        return answering.attribute(answers, passages)

    def evaluate(self, cases: DataFrame) -> DataFrame:
        return answering.score_cases(cases)
