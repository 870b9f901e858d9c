"""A plain-Python evaluator of the condition law, for brute-force comparisons in tests.

Written from the documented semantics (SURVEY section 2.3), operating on dicts.
"""
import re

ORDER = ("contains", "regex", "in", "eq", "ne", "gt", "lt")


def lookup(event, field):
    if field in event:
        return event[field]
    node = event
    for part in field.split("."):
        if not isinstance(node, dict) or node.get(part) is None:
            return None
        node = node[part]
    return node


def as_float(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def holds(value, cond):
    if value is None:
        return False
    text = str(value)
    if isinstance(cond, (str, int, float, bool)):
        return text.lower() == str(cond).lower()
    if not isinstance(cond, dict):
        return False
    op = next((o for o in ORDER if o in cond), None)
    if op is None:
        return False
    arg = cond[op]
    if op == "contains":
        return str(arg).lower() in text.lower()
    if op == "regex":
        try:
            return re.search(arg, text, re.IGNORECASE) is not None
        except re.error:
            return False
    if op == "in":
        return text in {str(m) for m in arg}
    if op == "eq":
        return text.lower() == str(arg).lower()
    if op == "ne":
        return text.lower() != str(arg).lower()
    a, b = as_float(value), as_float(arg)
    if a is None or b is None:
        return False
    return a > b if op == "gt" else a < b


def rule_matches(event, rule):
    if not rule.get("enabled", True):
        return False
    conds = rule.get("conditions", {})
    return bool(conds) and all(holds(lookup(event, f), c) for f, c in conds.items())
