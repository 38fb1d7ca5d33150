"""Rule ids with their messages and hints, as data."""

from __future__ import annotations

# The closed sets of the two schemas.
ROLES = ["system", "user", "assistant"]
CHAT_KEYS = ["messages"]
TASK_KEYS = ["task", "input", "expected_output"]
SCHEMAS = ["chat", "task"]

# Message texts. {at} is the message index, {got} the offending
# type, keys or value.
MESSAGES = {
    "invalid_json": "invalid JSON",
    "not_object": "expected a JSON object, got {got}",
    "unexpected_keys": "unexpected keys {got} in {schema} record",
    "missing_messages": 'missing required key "messages"',
    "messages_not_list": '"messages" must be a list, got {got}',
    "messages_empty": '"messages" list is empty',
    "message_not_object": "messages[{at}] must be a JSON object, got {got}",
    "role_missing": 'messages[{at}] missing required key "role"',
    "content_missing": 'messages[{at}] missing required key "content"',
    "role_not_string": 'messages[{at}]["role"] must be a string, got {got}',
    "role_invalid": 'messages[{at}]["role"] {got} is not a valid role',
    "content_not_string": 'messages[{at}]["content"] must be a string, got {got}',
    "missing_key": 'missing required key "{key}"',
    "key_not_string": '"{key}" must be a string, got {got}',
}

HINTS = {
    "invalid_json": "Write one JSON value per non-blank line.",
    "not_object": "Write each record as a JSON object.",
    "unexpected_keys": "Keep only the keys of the schema.",
    "missing_messages": "Add a list of messages under this key.",
    "messages_not_list": "Use a JSON array of message objects.",
    "messages_empty": "Give at least one message.",
    "message_not_object": "Write each message as an object with role and content.",
    "role_missing": "Name the speaker: system, user or assistant.",
    "content_missing": "Add the text of the message.",
    "role_not_string": "Use one of: assistant, system, user.",
    "role_invalid": "Use one of: assistant, system, user.",
    "content_not_string": "Use a plain string.",
    "missing_key": "Give task, input and expected_output.",
    "key_not_string": "Use a plain string.",
}
