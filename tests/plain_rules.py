"""A plain line checker, written from the rule table, as a second opinion."""

import json

ROLES = ("system", "user", "assistant")


def parse(line):
    try:
        return True, json.loads(line.strip())
    except ValueError:
        return False, None


def chat_rule(line):
    ok, value = parse(line)
    if not ok:
        return "invalid_json"
    if not isinstance(value, dict):
        return "not_object"
    if set(value) - {"messages"}:
        return "unexpected_keys"
    if not value:
        return "missing_messages"
    messages = value["messages"]
    if not isinstance(messages, list):
        return "messages_not_list"
    if not messages:
        return "messages_empty"
    return next((rule for rule in map(message_rule, messages) if rule), None)


def message_rule(message):
    if not isinstance(message, dict):
        return "message_not_object"
    for key in ("role", "content"):
        if key not in message:
            return f"{key}_missing"
    if not isinstance(message["role"], str):
        return "role_not_string"
    if message["role"] not in ROLES:
        return "role_invalid"
    return None if isinstance(message["content"], str) else "content_not_string"


def task_rule(line):
    ok, value = parse(line)
    if not ok:
        return "invalid_json"
    if not isinstance(value, dict):
        return "not_object"
    keys = ("task", "input", "expected_output")
    if set(value) - set(keys):
        return "unexpected_keys"
    for key in keys:
        if key not in value:
            return f"missing_key:{key}"
        if not isinstance(value[key], str):
            return f"key_not_string:{key}"
    return None


def schema_of(line):
    ok, value = parse(line)
    if not ok or not isinstance(value, dict):
        return None
    if "messages" in value:
        return "chat"
    return "task" if "task" in value and set(value) <= {"task", "input", "expected_output"} else None
