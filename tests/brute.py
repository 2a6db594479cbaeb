"""Plain-Python answers for small random histories with one dominant user."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict


def history(seed: int, users: int = 40, others: int = 200) -> list[dict]:
    """Orders over some months; user 0 holds a third of them. Coarse times make
    ties common."""
    draw = random.Random(seed)
    start = dt.datetime(2025, 11, 3)
    result = []
    for number in range(others + others // 2):
        user = 0 if number < others // 2 else draw.randrange(1, users)
        result.append(
            {
                "order_id": number,
                "user_id": user,
                "order_ts": start + dt.timedelta(hours=6 * draw.randrange(4 * 150)),
                "is_late": draw.choice([0, 0, 1, None]),
                "status": draw.choice(["delivered"] * 6 + ["cancelled"]),
            }
        )
    draw.shuffle(result)
    return result


def firsts(orders):
    found = {}
    for order in orders:
        if order["status"] == "delivered":
            user = order["user_id"]
            found[user] = min(found.get(user, order["order_ts"]), order["order_ts"])
    return found


def repeat_flags(orders, as_of, days):
    span = dt.timedelta(days=days)
    result = {}
    for user, first in firsts(orders).items():
        if first <= as_of - span:
            result[user] = int(
                any(
                    o["user_id"] == user
                    and o["status"] == "delivered"
                    and first < o["order_ts"] <= first + span
                    for o in orders
                )
            )
    return result


def months_between(first, later):
    return (later.year - first.year) * 12 + later.month - first.month


def cohort_matrix(orders):
    start = firsts(orders)
    active, size = defaultdict(set), defaultdict(set)
    for order in orders:
        if order["status"] == "delivered":
            first = start[order["user_id"]]
            cohort = first.strftime("%Y-%m")
            size[cohort].add(order["user_id"])
            active[cohort, months_between(first, order["order_ts"])].add(order["user_id"])
    return {key: (len(users), len(size[key[0]])) for key, users in active.items()}


def late_curve(orders):
    start = firsts(orders)
    flags = defaultdict(list)
    for order in orders:
        if start.get(order["user_id"]) == order["order_ts"] and order["is_late"] is not None:
            flags[order["user_id"]].append(order["is_late"])
    late = {user: max(values) for user, values in flags.items()}
    active = defaultdict(set)
    for order in orders:
        user = order["user_id"]
        if order["status"] == "delivered" and user in late:
            active[late[user], months_between(start[user], order["order_ts"])].add(user)
    sizes = {flag: sum(1 for value in late.values() if value == flag) for flag in (0, 1)}
    return {key: (len(users), sizes[key[0]]) for key, users in active.items()}


def sequence(orders):
    result = {}
    per_user = defaultdict(list)
    for order in orders:
        per_user[order["user_id"]].append((order["order_ts"], order["order_id"]))
    for placed in per_user.values():
        for number, (_, order_id) in enumerate(sorted(placed), 1):
            result[order_id] = number
    return result
