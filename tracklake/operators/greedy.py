"""Greedy operators whose choices depend on those before: suppression, filters, display ids."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tracklake.operators.folds import ordered_fold


def _iou(a: dict, b: dict) -> float:
    w = max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]))
    h = max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h
    return w * h / union if union > 0 else 0.0


def suppress_boxes(boxes: DataFrame, frame_keys: list[str], min_iou: float = 0.55, margin: float = 0.05) -> DataFrame:
    """Boxes (box_id, class_name, confidence, x1..y2) of a frame, surest first; one that overlaps a kept one
    goes. If classes differ and neither is surer by the margin, the kept one's is unresolved."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        kept: list[dict] = []
        gone = []
        for r in sorted(rows, key=lambda b: (-b["confidence"], b["box_id"])):
            over = next((k for k in kept if _iou(k, r) >= min_iou), None)
            if over is None:
                kept.append(dict(r, role=r["class_name"]))
                continue
            if over["class_name"] != r["class_name"] and over["confidence"] - r["confidence"] < margin:
                over["role"] = "unresolved"
            gone.append(r["box_id"])
        for k in kept:
            yield k["box_id"], k["role"], True
        for g in gone:
            yield g, None, False

    return ordered_fold(boxes, frame_keys, ["box_id"], fold, "box_id long, role string, kept boolean")


def suppress_points(points: DataFrame, frame_keys: list[str], radius: float = 20.0, keep: int = 3) -> DataFrame:
    """The surest points of a frame that are no nearer than the radius to each other."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        kept: list[dict] = []
        for r in sorted(rows, key=lambda p: (-p["confidence"], p["x"], p["y"])):
            if len(kept) < keep and all(math.hypot(r["x"] - k["x"], r["y"] - k["y"]) >= radius for k in kept):
                kept.append(r)
        for k in kept:
            yield k["x"], k["y"], k["confidence"]

    return ordered_fold(points, frame_keys, ["x"], fold, "x double, y double, confidence double")


def pitch_filter(positions: DataFrame, keys: list[str], process: float = 0.35, noise: float = 0.8, dead_m: float = 1.6, dead_speed: float = 0.55, max_speed: float = 12.0, hold: int = 8, fps: float = 25.0) -> DataFrame:
    """Kalman-filtered pitch positions (frame_id, x, y, may be NULL): small moves of a standing player
    are held back, speed is bounded, and a player missed too long is forgotten."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        s = None  # x, y, vx, vy, p, misses
        for r in rows:
            if s is not None:
                s = [s[0] + s[2] / fps, s[1] + s[3] / fps, s[2], s[3], s[4] + process, s[5]]
            if r["x"] is None or r["y"] is None:
                if s is not None:
                    s[5] += 1
                    s = None if s[5] > hold else s
            elif s is None:
                s = [r["x"], r["y"], 0.0, 0.0, noise, 0]
            else:
                dx, dy = r["x"] - s[0], r["y"] - s[1]
                gain = s[4] / (s[4] + noise)
                if math.hypot(dx, dy) < dead_m and math.hypot(s[2], s[3]) < dead_speed:
                    gain *= 0.1
                vx, vy = s[2] + gain * dx * fps * 0.1, s[3] + gain * dy * fps * 0.1
                v = math.hypot(vx, vy)
                k = max_speed / v if v > max_speed else 1.0
                s = [s[0] + gain * dx, s[1] + gain * dy, vx * k, vy * k, (1 - gain) * s[4], 0]
            yield r["frame_id"], *(s[:2] if s else (None, None)), s is not None

    return ordered_fold(positions, keys, ["frame_id"], fold, "frame_id long, x double, y double, valid boolean")


def foot_points(rows: DataFrame, keys: list[str], alpha: float = 0.22) -> DataFrame:
    """Smoothed foot points; ankles are preferred to the lower edge of the box."""

    def fold(items: Iterator[dict]) -> Iterator[tuple]:
        at = None
        for r in items:
            ankle = r["ankle_x"] is not None and r["ankle_y"] is not None
            x, y = (r["ankle_x"], r["ankle_y"]) if ankle else (r["foot_x"], r["foot_y"])
            at = (x, y) if at is None else (alpha * x + (1 - alpha) * at[0], alpha * y + (1 - alpha) * at[1])
            yield r["frame_id"], *at, "ankle" if ankle else "bbox"

    return ordered_fold(rows, keys, ["frame_id"], fold, "frame_id long, x double, y double, source string")


def assign_teams(rows: DataFrame, keys: list[str], history: int = 30, lock_after: int = 15, switch_after: int = 8) -> DataFrame:
    """Team of a track frame by frame: the mode of its last labels, locked after a while; a lock only
    gives way to a long streak of the other team."""

    def fold(items: Iterator[dict]) -> Iterator[tuple]:
        seen: deque = deque(maxlen=history)
        lock, streak = None, 0
        for r in items:
            if r["label"] is not None:
                seen.append(r["label"])
            best = min(Counter(seen).items(), key=lambda x: (-x[1], x[0]))[0] if seen else None
            if lock is None and len(seen) >= lock_after:
                lock = best
            elif lock is not None and r["label"] is not None:
                streak = streak + 1 if r["label"] != lock else 0
                if streak >= switch_after:
                    lock, streak = r["label"], 0
            yield r["frame_id"], lock or best, lock is not None

    return ordered_fold(rows, keys, ["frame_id"], fold, "frame_id long, team_id string, locked boolean")


def display_ids(tracks: DataFrame, match: list[str], max_gap_ms: float = 4000.0, slack_m: float = 3.0, max_speed: float = 10.0) -> DataFrame:
    """Stable display ids: tracks (track_id, team_id, start_ms, end_ms, first x, y, last x, y), in order of
    start, take over the id of the nearest player of their team who was lost just before and could have run there."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        people: list[dict] = []
        for r in rows:
            fits = []
            for k, p in enumerate(people):
                gap = r["start_ms"] - p["end_ms"]
                far = math.hypot(r["first_x"] - p["last_x"], r["first_y"] - p["last_y"])
                if p["team_id"] == r["team_id"] and 0 < gap <= max_gap_ms and far <= slack_m + max_speed * gap / 1000:
                    fits.append((far, k))
            k = min(fits)[1] if fits else len(people)
            if not fits:
                people.append({"team_id": r["team_id"]})
            people[k] |= {"end_ms": r["end_ms"], "last_x": r["last_x"], "last_y": r["last_y"]}
            yield r["track_id"], k + 1

    return ordered_fold(tracks, match, ["start_ms", "track_id"], fold, "track_id long, display_id long")


def demote_surplus(players: DataFrame, team_keys: list[str], max_on_field: int = 11) -> DataFrame:
    """Players (global_id, start_ms, end_ms, visible_seconds) of a team, longest seen first; one who would make
    more than the maximum at once is demoted."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        kept: list[dict] = []
        for r in sorted(rows, key=lambda p: (-p["visible_seconds"], p["global_id"])):
            near = [k for k in kept if k["start_ms"] <= r["end_ms"] and r["start_ms"] <= k["end_ms"]]
            edges = sorted({max(r["start_ms"], k["start_ms"]) for k in near})
            full = any(sum(k["start_ms"] <= t <= k["end_ms"] for k in near) >= max_on_field for t in edges)
            if not full:
                kept.append(r)
            yield r["global_id"], not full

    return ordered_fold(players, team_keys, ["global_id"], fold, "global_id long, validated boolean")
