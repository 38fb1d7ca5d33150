"""Queries over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions.digest import hash_sum, row_hash, sha256_hex
from corpusgate.operators.completeness import members
from corpusgate.operators.render import explode_messages, prompts, render_chat, render_turns
from corpusgate.operators.rules import first_violation, valid_records, validate
from corpusgate.plans.tables import damaged_chat_lines, table
from corpusgate.sources.turns import assemble_chat, chat_lines, reply_tasks

SEGMENT = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"


def sql_hash(*texts: str) -> str:
    """The 60-bit row hash in DuckDB."""
    body = " || ".join(f"'s' || length({t}) || ':' || {t}" for t in texts)
    return f"('0x' || substr(sha256({body}), 1, 15))::BIGINT"


def chat_assemble_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered length and ordered fingerprint of every conversation.

    Each turn is rendered where it lies; a conversation is reduced by mergeable
    sums, so its length does not matter.
    """
    turns = render_turns(table(spark, sf_dir, "conversations"))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.sum(F.length("segment")).alias("n_chars"),
        hash_sum(row_hash([F.col("turn"), F.col("segment")])).alias("digest"),
    )


CHAT_ASSEMBLE_RENDER = f"""
SELECT conv_id, count(*) AS n_messages, sum(length(seg))::BIGINT AS n_chars,
       sum({sql_hash('turn::VARCHAR', 'seg')})::VARCHAR AS digest
FROM (SELECT conv_id, turn, {SEGMENT} AS seg FROM conversations) GROUP BY conv_id
"""


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training text of every assembled record."""
    records = assemble_chat(table(spark, sf_dir, "conversations"))
    sized = records.withColumn("n_messages", F.size("messages").cast("bigint"))
    return render_chat(sized).withColumn("text_sha256", sha256_hex(F.col("text")))


CHAT_RECORDS = f"""
SELECT conv_id, part, n_messages, text, sha256(text) AS text_sha256 FROM (
  SELECT conv_id, CAST(0 AS BIGINT) AS part, count(*) AS n_messages,
         string_agg({SEGMENT}, '' ORDER BY turn) AS text
  FROM conversations GROUP BY ALL)
"""


def chat_message_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and characters per role and position, through JSON lines."""
    lines = chat_lines(assemble_chat(table(spark, sf_dir, "conversations")))
    messages = explode_messages(valid_records(validate(lines, "chat")))
    return messages.groupBy("role", F.col("at").cast("bigint").alias("at")).agg(
        F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")
    )


CHAT_MESSAGE_PROFILE = f"""
SELECT role, pos AS "at", count(*) AS n, sum(length(text))::BIGINT AS chars FROM (
  SELECT role, text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM conversations) GROUP BY role, pos
"""

_RULE = """
CASE conv_id % 16
  WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'unexpected_keys' WHEN 2 THEN 'missing_messages'
  WHEN 3 THEN 'messages_not_list' WHEN 4 THEN 'messages_empty' WHEN 5 THEN 'role_invalid'
  WHEN 6 THEN 'content_not_string' WHEN 7 THEN 'role_missing' WHEN 8 THEN 'content_missing'
  WHEN 9 THEN 'invalid_json' WHEN 10 THEN 'role_not_string' WHEN 11 THEN 'message_not_object'
  WHEN 12 THEN 'content_not_string' WHEN 13 THEN 'not_object' END
"""
_MESSAGE = """
CASE conv_id % 16
  WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'unexpected keys [''extra''] in chat record'
  WHEN 2 THEN 'missing required key "messages"'
  WHEN 3 THEN '"messages" must be a list, got str' WHEN 4 THEN '"messages" list is empty'
  WHEN 5 THEN 'messages[' || n || ']["role"] ''tool'' is not a valid role'
  WHEN 6 THEN 'messages[' || n || ']["content"] must be a string, got int'
  WHEN 7 THEN 'messages[' || n || '] missing required key "role"'
  WHEN 8 THEN 'messages[' || n || '] missing required key "content"'
  WHEN 9 THEN 'invalid JSON'
  WHEN 10 THEN 'messages[' || n || ']["role"] must be a string, got list'
  WHEN 11 THEN 'messages[' || n || '] must be a JSON object, got int'
  WHEN 12 THEN 'messages[' || n || ']["content"] must be a string, got NoneType'
  WHEN 13 THEN 'expected a JSON object, got list' END
"""
_RECORDS = f"""
(SELECT conv_id, CAST(0 AS BIGINT) AS part, count(*) AS n FROM conversations GROUP BY ALL)
"""


def validate_chat_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First failing rule and message of every damaged chat line."""
    return validate(damaged_chat_lines(spark, sf_dir), "chat").select(
        "conv_id", "part", "rule", "message"
    )


VALIDATE_CHAT_RULES = f"""
SELECT conv_id, part, {_RULE} AS rule, {_MESSAGE} AS message FROM {_RECORDS}
"""


def chat_first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bad record per record length, in conversation order."""
    judged = validate(damaged_chat_lines(spark, sf_dir), "chat")
    return first_violation(judged, ["n"], ["conv_id", "part"]).drop("remediation")


CHAT_FIRST_VIOLATION = f"""
SELECT n, conv_id, part, rule, message FROM (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY conv_id, part) AS rn FROM (
    SELECT conv_id, part, n, {_RULE} AS rule, {_MESSAGE} AS message FROM {_RECORDS})
  WHERE rule IS NOT NULL) WHERE rn = 1
"""


def role_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required roles a conversation lacks and roles it has."""
    found = members(
        table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["user", "assistant"], ["system"]
    )
    return found.select(
        "conv_id",
        F.array_join("missing", ",").alias("missing"),
        F.array_join("present", ",").alias("present"),
    )


ROLE_COMPLETENESS = """
SELECT conv_id,
       concat_ws(',', CASE WHEN NOT u THEN 'user' END, CASE WHEN NOT a THEN 'assistant' END) AS missing,
       concat_ws(',', CASE WHEN u THEN 'user' END, CASE WHEN a THEN 'assistant' END,
                 CASE WHEN s THEN 'system' END) AS present
FROM (SELECT conv_id, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a,
             bool_or(role = 'system') AS s FROM conversations GROUP BY conv_id)
"""

REPLIES = """
(SELECT u.conv_id, u.turn, 'reply' AS task, u.text AS input, a.text AS expected_output
 FROM conversations u JOIN conversations a
   ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
 WHERE u.role = 'user' AND a.role = 'assistant')
"""


def eval_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation prompts from user turns that got a reply."""
    suite = reply_tasks(table(spark, sf_dir, "conversations"))
    return prompts(suite).select("conv_id", "turn", "prompt", "expected_output")


EVAL_PROMPT = f"""
SELECT conv_id, turn, 'Task: ' || task || chr(10) || 'Input: ' || input || chr(10) || 'Output:'
       AS prompt, expected_output FROM {REPLIES}
"""

QUERIES = {
    "chat_assemble_render": (chat_assemble_render, CHAT_ASSEMBLE_RENDER),
    "chat_records": (chat_records, CHAT_RECORDS),
    "chat_message_profile": (chat_message_profile, CHAT_MESSAGE_PROFILE),
    "validate_chat_rules": (validate_chat_rules, VALIDATE_CHAT_RULES),
    "chat_first_violation": (chat_first_violation, CHAT_FIRST_VIOLATION),
    "role_completeness": (role_completeness, ROLE_COMPLETENESS),
    "eval_prompt": (eval_prompt, EVAL_PROMPT),
}
