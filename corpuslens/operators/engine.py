"""The search entry points: one query string in, hydrated hits out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import search

MODES = ("KEYWORD", "VECTOR", "HYBRID")


class EmbeddingUnavailable(ValueError):
    """A vector search was asked for, and there is no embedder."""


@dataclass
class Engine:
    """Searches over one index: postings, vectors (key, embedding), documents (key, text, folder, enabled, ...)."""

    postings: DataFrame
    documents: DataFrame
    vectors: DataFrame | None = None
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    key: str = "doc_id"

    def _keyword(self, query: str, k: int) -> DataFrame:
        hits = search.search_clauses(self.postings, query, self.key).withColumn("query_id", F.lit(0))
        return self._live(search.top(hits, k, self.key))

    def _vector(self, query: str, k: int) -> DataFrame:
        if self.embedder is None or self.vectors is None:
            raise EmbeddingUnavailable("no embedding model")
        q = self.documents.sparkSession.createDataFrame([(0, [float(x) for x in self.embedder([query])[0]])], "query_id int, embedding array<float>")
        return self._live(search.vector_topk(self.vectors, q, k, self.key))

    def _live(self, hits: DataFrame) -> DataFrame:
        return search.rerank(search.hydrate(hits, self.documents, self.key).select("query_id", self.key, "score", "rank"))

    def search(self, query: str | None, mode: str | None = None, k: int | None = None) -> DataFrame:
        """Hits with their documents and previews, best first; a blank query has none.

        Without an embedder VECTOR and HYBRID raise.
        """
        mode, k, query = mode or "HYBRID", search.clamp_k(k), (query or "").strip()
        if mode not in MODES:
            raise ValueError(mode)
        if not query:
            hits = self.documents.limit(0).select(F.lit(0).alias("query_id"), self.key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        elif mode == "KEYWORD":
            hits = self._keyword(query, k)
        elif mode == "VECTOR":
            hits = self._vector(query, k)
        else:
            most = search.candidates(k)
            vec = self._vector(query, most)
            hits = search.fuse(self._keyword(query, most), vec, k, self.key).select("query_id", self.key, "score", "rank")
        return self.documents.join(F.broadcast(hits.drop("query_id")), self.key).withColumn("preview", T.preview("text")).orderBy("rank")

    def retrieve(self, query: str, mode: str = "HYBRID", k: int | None = None, rewrite: Callable[[str], str | None] | None = None) -> tuple[DataFrame, str, str]:
        """Sources for an answer: (hits, mode that was used, query that was used).

        Without an embedder it falls back to KEYWORD; if nothing is found, the rewritten query is tried once.
        """
        if mode != "KEYWORD" and (self.embedder is None or self.vectors is None):
            mode = "KEYWORD"
        hits = self.search(query, mode, k)
        if rewrite is not None and hits.isEmpty():
            again = (rewrite(query) or "").strip()
            if again and again != query:
                return self.search(again, mode, k), mode, again
        return hits, mode, query
