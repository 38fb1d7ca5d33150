"""Training text and prompts from validated records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """A chat template as data: text before and after a message, per role."""

    before: dict[str, str]
    after: dict[str, str]


# The public ChatML layout.
CHATML = ChatTemplate(
    before={r: f"<|im_start|>{r}\n" for r in ("system", "user", "assistant")},
    after={r: "<|im_end|>\n" for r in ("system", "user", "assistant")},
)


def _pick(role: Column, table: dict[str, str]) -> Column:
    """The template's text for a role; a role it lacks fails the job."""
    out = None
    for name, text in table.items():
        test = role == name
        out = F.when(test, text) if out is None else out.when(test, text)
    missing = F.raise_error(F.concat(F.lit("the chat template has no role "), role))
    return out.otherwise(missing.cast("string"))


def segment(role: Column, content: Column, template: ChatTemplate = CHATML) -> Column:
    """Rendered text of one message."""
    return F.concat(_pick(role, template.before), content, _pick(role, template.after))


def render_chat(records: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Replace ``messages`` by the rendered ``text`` of the record."""
    text = F.array_join(
        F.transform("messages", lambda m: segment(m["role"], m["content"], template)), ""
    )
    return records.withColumn("text", text).drop("messages")


def render_turns(turns: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Add ``segment``: the text of a conversation is its segments in turn order.

    A conversation of any length stays spread over its rows.
    """
    return turns.withColumn("segment", segment(F.col("role"), F.col("text"), template))


def render_task(records: DataFrame, eos: str | None = None) -> DataFrame:
    """Add the training ``text`` of a task record."""
    return records.withColumn(
        "text",
        F.concat(
            F.lit("Task: "),
            "task",
            F.lit("\nInput: "),
            "input",
            F.lit("\nOutput: "),
            "expected_output",
            F.lit(eos or ""),
        ),
    )


def prompts(suite: DataFrame) -> DataFrame:
    """Add the evaluation ``prompt`` of a task record."""
    return suite.withColumn(
        "prompt", F.concat(F.lit("Task: "), "task", F.lit("\nInput: "), "input", F.lit("\nOutput:"))
    )


def explode_messages(records: DataFrame) -> DataFrame:
    """One row per message with its 0-based position."""
    rest = [c for c in records.columns if c != "messages"]
    return records.select(*rest, F.posexplode("messages").alias("at", "message")).select(
        *rest, "at", "message.role", "message.content"
    )
