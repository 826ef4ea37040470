"""Codes of a table against plain loops."""

from __future__ import annotations

import re

from quartzfolio.operators import taxonomy as tx

CODES = [("30", "Office machines and supplies", False), ("30.1", "Office machines", False), ("30.1.2", "Photocopiers and printing machines", False), ("72", "IT services", True), ("72.2", "Software programming services", True), ("72.2.1", "Software", None), ("99", None, None), ("98", "", True)]
ITEMS = [(1, "printing machines for the office", None), (2, "software programming", True), (3, "software programming", False), (4, None, None), (5, "", True), (6, "SOFTWARE software", None), (7, "nothing fits", None), (8, "printing machines for the office", None)]


def bag(t):
    return {w for w in re.split("[^a-z0-9#]+", (t or "").lower()) if len(w) > 2}


def best(text, service, bonus):
    found = []
    for code, description, kind in CODES:
        own = bag(description)
        n = len(own & bag(text))
        if n and (service is None or kind is None or service == kind):
            score = int((n / len(own) + bonus * len(code.split("."))) * 1e6 + 0.5) / 1e6
            if score >= 0.3:
                found.append((-score, code))
    return min(found, default=None)


def test_best_codes_and_rollup(spark):
    codes = spark.createDataFrame(CODES, "code string, description string, service boolean")
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "id long, text string, service boolean, code string")
    for bonus in (0.05, 0.1):
        matched = tx.best_codes(items, codes, bonus)
        want = {i: (b[1], -b[0]) for i, t, s in ITEMS if (b := best(t, s, bonus))}
        assert {r["id"]: (r["code"], r["score"]) for r in matched.collect()} == want
    up = {}
    for code, _ in want.values():
        parts = code.split(".")
        for n in range(1, len(parts) + 1):
            up[".".join(parts[:n]), n] = up.get((".".join(parts[:n]), n), 0) + 1
    assert {(r["code"], r["level"]): r["items"] for r in tx.rolled_up(matched).collect()} == up
    assert len(up) > 3
    assert tx.best_codes(items.limit(0), codes, 0.05).count() == 0
    assert tx.best_codes(items, codes.limit(0), 0.05).count() == 0


def test_search_codes(spark):
    codes = spark.createDataFrame(CODES + [(f"50.{i}", f"kind {i} of software", None) for i in range(30)], "code string, description string, service boolean")
    got = tx.search_codes(codes, spark.createDataFrame([("Software",), ("office machines",), ("",), (None,), ("unknown",)], "query string")).collect()
    assert [(r["code"], r["score"]) for r in sorted(got, key=lambda r: r["place"]) if r["query"] == "office machines"] == [("30.1", 1.0), ("30", round(15 / 28, 6))]
    found = [r for r in got if r["query"] == "software"]
    assert len(found) == 10 and {r["code"] for r in found if r["place"] == 1} == {"72.2.1"}
    assert {r["query"] for r in got} == {"software", "office machines"}
