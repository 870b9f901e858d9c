"""Deterministic generator of detection rules over the ECS fields (bench and tests).

Rules are drawn from the value domains of the event table with every operator form, so
rule-set size can be scaled (5 / 50 / 500 / ...) without hand-written tables.
"""

from __future__ import annotations

import random

from vigilark.schema import ACTION_LOOKUP, PORTS, SEVERITIES, USER_NAMES

ACTIONS = tuple(ACTION_LOOKUP)
OUTCOMES = ("success", "failure")
CATEGORIES = tuple(sorted({m[0] for m in ACTION_LOOKUP.values()}))


def _condition(rng: random.Random):
    kind = rng.randrange(12)
    if kind == 0:
        return "event.action", rng.choice(ACTIONS).upper() if rng.random() < 0.3 else rng.choice(ACTIONS)
    if kind == 1:
        return "event.action", {"in": rng.sample(ACTIONS, rng.randint(1, 3))}
    if kind == 2:
        return "event.severity", {"eq": rng.choice(SEVERITIES)}
    if kind == 3:
        return "event.severity", {"ne": rng.choice(SEVERITIES)}
    if kind == 4:
        return "event.outcome", rng.choice(OUTCOMES)
    if kind == 5:
        return "user.name", {"in": rng.sample(USER_NAMES, rng.randint(1, 2))}
    if kind == 6:
        return "destination.port", rng.choice(PORTS) if rng.random() < 0.5 else str(rng.choice(PORTS))
    if kind == 7:
        op = rng.choice(("gt", "lt"))
        return "destination.port", {op: rng.choice(PORTS)}
    if kind == 8:
        return "source.ip", {"regex": rf"^10\.0\.0\.{rng.randint(1, 9)}\d?$"}
    if kind == 9:
        return "message", {"contains": rng.choice(("scan", "LOGIN", "file", "process"))}
    if kind == 10:
        return "hour", {rng.choice(("gt", "lt")): rng.randint(0, 23)}
    return "event.category", rng.choice(CATEGORIES)


def generated_rules(n: int, seed: int = 42, max_conditions: int = 3) -> list[dict]:
    rng = random.Random(seed)
    rules = []
    for i in range(n):
        conds = {}
        for _ in range(rng.randint(1, max_conditions)):
            f, c = _condition(rng)
            conds.setdefault(f, c)
        rules.append({"name": f"gen_rule_{i:05d}", "description": f"generated rule {i}",
                      "severity": rng.choice(SEVERITIES), "enabled": rng.random() > 0.05, "conditions": conds})
    return rules
