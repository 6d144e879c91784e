"""Message memory over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import memory as M
from tessella.plans.registry import query


@query("memory_window", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def memory_window(t):
    return M.window(t("conversations"), 3).select("conv_id", "turn", "role", "text")


@query("memory_last_n", "SELECT turn, role, text FROM conversations WHERE conv_id = 1 ORDER BY turn DESC LIMIT 2")
def memory_last_n(t):
    return M.last(t("conversations"), 1, 2).select("turn", "role", "text")


@query("memory_size", "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id")
def memory_size(t):
    return M.sizes(t("conversations"))


@query("memory_transcript", "SELECT conv_id, string_agg('[' || role || ']: ' || text || chr(10), '' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def memory_transcript(t):
    return M.transcripts(t("conversations"))


STATE = "s AS (SELECT conv_id, role AS key, length(text) AS value, turn FROM conversations)"


@query("agent_state", f"WITH {STATE} SELECT conv_id, key, max_by(value, turn * 1000000 + value) AS value, count(*) AS changes FROM s GROUP BY conv_id, key")
def agent_state(t):
    return M.state(t("conversations").select("conv_id", F.col("role").alias("key"), F.length("text").cast("long").alias("value"), "turn"))


@query("agent_history", f"WITH {STATE} SELECT conv_id, key, value, turn, lag(value) OVER (PARTITION BY conv_id, key ORDER BY turn, value) AS before FROM s")
def agent_history(t):
    return M.history(t("conversations").select("conv_id", F.col("role").alias("key"), F.length("text").cast("long").alias("value"), "turn")).select("conv_id", "key", "value", "turn", "before")
