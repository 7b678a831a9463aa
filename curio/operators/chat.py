"""H21 ``render_chat_prompt``: chat turns -> model prompts.

The first user turn of a conversation carries the system prompt when one
exists and is non-empty; every other user turn is wrapped on its own.
Per-conversation facts (system text, first user turn) are one grouped
aggregate joined back -- no window holds a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# --- fixed values -----------------------------------------------------------
SYSTEM_TEMPLATE = "[INST] <<SYS>>\n%s\n<</SYS>>\n\n%s [/INST]"
USER_TEMPLATE = "[INST] %s [/INST]"
# ---------------------------------------------------------------------------


def render_chat_prompt(chat: DataFrame, conv: str = "conv_id", turn: str = "turn",
                       role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, prompt)`` for every user turn."""
    facts = chat.groupBy(conv).agg(
        F.min_by(F.when(F.col(role) == "system", F.col(text)),
                 F.when(F.col(role) == "system", F.col(turn))).alias("__sys"),
        F.min(F.when(F.col(role) == "user", F.col(turn))).alias("__first_user"))
    users = chat.filter(F.col(role) == "user").join(facts, conv, "left")
    with_sys = (F.col(turn) == F.col("__first_user")) & F.col("__sys").isNotNull() \
        & (F.col("__sys") != "")
    prompt = F.when(with_sys, F.format_string(SYSTEM_TEMPLATE, F.col("__sys"), F.col(text))) \
        .otherwise(F.format_string(USER_TEMPLATE, F.col(text)))
    return users.select(conv, turn, prompt.alias("prompt"))
