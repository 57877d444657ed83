"""A thin client over the operators: distil, remember, search and compact for one user and agent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import distill, memory, session
from .operators.memory import MemoryStore


class Client:
    def __init__(self, spark: SparkSession, store: MemoryStore, profile: str = "balanced", user_id: str | None = None, agent_id: str | None = None):
        self.spark, self.memories, self.profile, self.user_id, self.agent_id = spark, store, profile, user_id, agent_id

    def process(self, data: list[str], rate: float = 0.4) -> DataFrame:
        rows = self.spark.createDataFrame([(0, data)], "request_id int, data array<string>")
        return distill.results(distill.distill(distill.requests(rows), self.profile, rate))

    def search_memory(self, query: str, top_k: int = 5, category: str | None = None, vector: list[float] | None = None) -> DataFrame:
        more = [vector] if vector is not None else []
        return memory.tool_rows(self.memories.search(query, top_k, self.user_id, self.agent_id, category, *more))

    def store_memory(self, content: str, source: str = "", category: str = "fact", metadata: str = "{}") -> None:
        row = (self.user_id or "", self.agent_id or "", content, source, category, metadata, 0)
        self.memories.store(self.spark.createDataFrame([row], "user_id string, agent_id string, content string, source string, category string, metadata string, pos bigint"))

    def update_memory(self, id: int, content: str) -> None:
        self.memories.update(self.spark.createDataFrame([(id, self.user_id, self.agent_id, content)], "id bigint, user_id string, agent_id string, content string"))

    def forget_memory(self, id: int) -> None:
        self.memories.forget(self.spark.createDataFrame([(id, self.user_id, self.agent_id)], "id bigint, user_id string, agent_id string"))

    def get_memory(self, source: str) -> DataFrame:
        """The memory of a source, or a row whose error is `Not found`."""
        return memory.found_or_error(self.memories.get(source, self.user_id, self.agent_id))

    def list_memories(self, category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return memory.tool_rows(self.memories.list(self.user_id, self.agent_id, category, limit, offset))

    def session_summary(self, transcripts: DataFrame, session_id: str, strategy: str = "lingua", **how) -> DataFrame:
        """session_id, summary of the newest transcript, or a note that there is none or an empty one."""
        return session.summaries(transcripts, self.spark.createDataFrame([(session_id,)], "session_id string"), strategy, **how)

    def context_compact(self, messages: DataFrame, threshold: int = 4000, **how) -> DataFrame:
        return session.auto_compact(session.micro_compact(messages), threshold, **how)
