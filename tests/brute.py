"""Plain Python answers for small inputs."""

from __future__ import annotations

import math


def inside(p, b):
    return b["x_min"] <= p["x"] <= b["x_max"] and b["y_min"] <= p["y"] <= b["y_max"]


def range_join(points, boxes):
    return {(b["qid"], p["pid"]) for p in points for b in boxes if inside(p, b)}


def moving_join(points, versions):
    """Per query id the latest version at the point's time."""
    out = set()
    for p in points:
        for qid in {v["qid"] for v in versions}:
            past = [v for v in versions if v["qid"] == qid and v["ts"] <= p["ts"]]
            if past:
                v = max(past, key=lambda v: (v["ts"], v["x_min"], v["y_min"]))
                if inside(p, v):
                    out.add((qid, p["pid"], v["ts"]))
    return out


def knn(objects, queries):
    out = set()
    for q in queries:
        near = sorted(
            (math.sqrt((o["x"] - q["fx"]) ** 2 + (o["y"] - q["fy"]) ** 2), o["oid"])
            for o in objects
        )
        out |= {(q["qid"], oid, i + 1) for i, (_, oid) in enumerate(near[: q["k"]])}
    return out


def close_pairs(rows, r):
    return {
        (a["id"], b["id"], a["ts"], b["ts"])
        for a in rows
        for b in rows
        if a["id"] != b["id"] and math.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) < r
    }
