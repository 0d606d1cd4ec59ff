"""The query surface as plain calls: health, search and ask over one index. A web server maps its requests to Service.handle()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .operators import answering, search
from .operators.steps import dropped
from .sources.index_store import IndexStore


class Service:
    """Chunks and their postings, made once and shared by all calls."""

    def __init__(self, chunks: DataFrame, model: Callable | None = None, tables: dict[str, DataFrame] | None = None):
        """`tables` are those of answering.indexes(), or of a stored index; term statistics are worked out here if they lack them."""
        self.chunks, self.model = chunks.persist(), model
        self.tables = {k: t.persist() for k, t in (answering.indexes(self.chunks) if tables is None else tables).items()}
        with dropped(chunks.sparkSession):
            if "terms" not in self.tables:
                self.tables["terms"] = search.idf(self.tables["tf"]).persist()
            self.tables["terms"].count()  # from now on in memory, so that no call works them out

    @classmethod
    def of_store(cls, store: IndexStore, model: Callable | None = None) -> Service:
        """A service over the newest version of a stored index; texts are read for what is shown only."""
        return cls(store.chunks(), model, store.tables())

    def close(self) -> None:
        """Give back what is kept in memory."""
        for table in (self.chunks, *self.tables.values()):
            table.unpersist()

    def __enter__(self) -> Service:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def health(self) -> dict:
        return {"status": "ok", "domains": sorted(r["domain"] for r in self.chunks.select("domain").distinct().collect())}

    def search(self, question: str, domain: str, doc_ids: str | None = None, top_k: int = 10, options: dict | None = None) -> list[dict]:
        """Ranked evidence; doc_ids separated by commas, top_k from 1 to 30."""
        if not 1 <= int(top_k) <= 30:
            raise ValueError("top_k must be from 1 to 30")
        ids = [d.strip() for d in doc_ids.split(",") if d.strip()] if doc_ids else None
        q = self.chunks.sparkSession.createDataFrame([("q", domain, question, options or {}, ids)], "qid string, domain string, question string, options map<string,string>, doc_ids array<string>")
        with dropped(self.chunks.sparkSession):
            return [r.asDict() for r in search.search(self.chunks, q, int(top_k), **self.tables).orderBy("rank").collect()]

    def ask(self, question: dict) -> dict:
        with dropped(self.chunks.sparkSession):
            return answering.ask(self.chunks, question, self.model, self.tables)

    def handle(self, method: str, path: str, params: dict) -> tuple[int, object]:
        """(status, body) of GET /health, GET or POST /search and POST /ask."""
        try:
            if (method, path) == ("GET", "/health"):
                return 200, self.health()
            if path == "/search" and method in ("GET", "POST"):
                return 200, self.search(**params)
            if (method, path) == ("POST", "/ask"):
                return 200, self.ask(params)
        except (TypeError, ValueError, KeyError) as e:
            return 422, {"error": str(e)}
        return 404, {"error": "not found"}
