"""Ordered folds of a bounded group (a track or match), and the state machines that need them.

Only operators whose next state depends on what was accepted before are here; all others are
plain DataFrame plans.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


#: Rows of a key that are Python objects at a time.
FOLD_ROWS = 8192


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """Runs fold over the rows of each key in order; gives the keys and what it yields. A key's rows are sorted as an
    Arrow table; only FOLD_ROWS at a time become Python objects, and results go back to Arrow as often."""
    fields = T.StructType.fromDDL(schema)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in order])
        out = fold(r for b in t.to_batches(max_chunksize=FOLD_ROWS) for r in b.to_pylist())
        parts: list[list[pa.Array]] = [[pa.array([], x)] for x in types]
        n = 0
        while rows := list(islice(out, FOLD_ROWS)):
            n += len(rows)
            for k, (part, x) in enumerate(zip(parts, types, strict=True)):
                part.append(pa.array([r[k] for r in rows], x))
        same = [pa.array([t[k][0].as_py()] * n, t.schema.field(k).type) for k in keys]
        return pa.Table.from_arrays([*same, *(pa.chunked_array(p) for p in parts)], names=[*keys, *fields.names])

    return df.groupBy(*keys).applyInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


@dataclass(frozen=True)
class BallRules:
    max_gap_ms: float = 700.0
    max_gap_frames: int = 20
    short_frames: int = 3
    max_speed: float = 3000.0
    max_acceleration: float = 40000.0
    min_confidence: float = 0.1
    decay: float = 0.85
    airborne_ratio: float = 1.6
    history: int = 12
    blend: float = 0.6
    kalman: bool = False
    process_noise: float = 200.0
    measurement_noise: float = 4.0


@dataclass
class Axis:
    """Constant-velocity Kalman filter of one coordinate."""

    x: float
    q: float
    r: float
    v: float = 0.0
    p: tuple[float, float, float] = (1.0, 0.0, 1000.0)

    def predict(self, dt: float) -> None:
        a, b, c = self.p
        self.x += self.v * dt
        self.p = a + 2 * dt * b + dt * dt * c + self.q * dt**4 / 4, b + dt * c + self.q * dt**3 / 2, c + self.q * dt * dt

    def update(self, z: float) -> None:
        a, b, c = self.p
        s = a + self.r
        gain, slope, off = a / s, b / s, z - self.x
        self.x, self.v = self.x + gain * off, self.v + slope * off
        self.p = (1 - gain) * a, (1 - gain) * b, c - slope * b


@dataclass
class BallMachine:
    """One ball from a frame's candidates: gated, filtered, predicted over short gaps, never revised."""

    rules: BallRules = field(default_factory=BallRules)

    def __post_init__(self) -> None:
        self.sizes: deque = deque(maxlen=self.rules.history)
        self.reset()

    def reset(self) -> None:
        self.at = self.velocity = self.time = self.axes = None
        self.sizes.clear()

    def _passes(self, c: dict, dt: float) -> bool:
        if c["confidence"] < self.rules.min_confidence:
            return False
        if self.at is None:
            return True
        v = (c["x"] - self.at[0]) / dt, (c["y"] - self.at[1]) / dt
        if math.hypot(*v) > self.rules.max_speed:
            return False
        return self.velocity is None or math.hypot(v[0] - self.velocity[0], v[1] - self.velocity[1]) / dt <= self.rules.max_acceleration

    def step(self, frame: int, t: float, candidates: list[dict], cut: bool) -> tuple:
        """(x, y, state, confidence, vx, vy)."""
        r = self.rules
        if cut:
            self.reset()
        dt = max((t - self.time[1]) / 1000.0, 1e-3) if self.time else 1e-3
        good = [c for c in candidates if self._passes(c, dt)]
        if not good:
            return self._predict(frame, t)
        c = max(good, key=lambda k: k["confidence"]) if self.at is None else min(good, key=lambda k: math.hypot(k["x"] - self.at[0], k["y"] - self.at[1]))
        state, size = "detected", c.get("size")
        if size is not None:
            median = sorted(self.sizes)[len(self.sizes) // 2] if len(self.sizes) >= 3 else 0.0
            if median > 0 and size / median >= r.airborne_ratio:
                state = "airborne"
            else:
                self.sizes.append(size)
        x, y = c["x"], c["y"]
        if r.kalman:
            if self.axes is None:
                self.axes = Axis(x, r.process_noise, r.measurement_noise), Axis(y, r.process_noise, r.measurement_noise)
            else:
                for axis, z in zip(self.axes, (x, y), strict=True):
                    axis.predict(dt)
                    axis.update(z)
            x, y = self.axes[0].x, self.axes[1].x
            self.velocity = self.axes[0].v, self.axes[1].v
        elif self.at is not None:
            raw = (x - self.at[0]) / dt, (y - self.at[1]) / dt
            self.velocity = raw if self.velocity is None else tuple(r.blend * n + (1 - r.blend) * o for n, o in zip(raw, self.velocity, strict=True))
        self.at, self.time, self.confidence = (x, y), (frame, t), c["confidence"]
        return x, y, state, c["confidence"], *(self.velocity or (None, None))

    def _predict(self, frame: int, t: float) -> tuple:
        unknown = (None, None, "unknown", 0.0, None, None)
        if self.time is None:
            return unknown
        gap, ms = frame - self.time[0], t - self.time[1]
        if ms > self.rules.max_gap_ms or gap > self.rules.max_gap_frames:
            self.reset()
            return unknown
        v = self.velocity or (0.0, 0.0)
        state = "occluded_short" if gap <= self.rules.short_frames else "predicted"
        return self.at[0] + v[0] * ms / 1000, self.at[1] + v[1] * ms / 1000, state, self.confidence * self.rules.decay ** max(gap, 1), *(self.velocity or (None, None))


BALL_SCHEMA = "frame_id long, timestamp_ms double, x double, y double, state string, confidence double, velocity_x double, velocity_y double"


def ball_trajectory(frames: DataFrame, keys: list[str], rules: BallRules = BallRules()) -> DataFrame:
    """frames: keys, frame_id, timestamp_ms, candidates (x, y, confidence, size), scene_cut."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        ball = BallMachine(rules)
        for r in rows:
            yield r["frame_id"], r["timestamp_ms"], *ball.step(r["frame_id"], r["timestamp_ms"], r["candidates"] or [], bool(r["scene_cut"]))

    return ordered_fold(frames, keys, ["frame_id"], fold, BALL_SCHEMA)


def wrong_object_filter(detections: DataFrame, keys: list[str], fps: float = 25.0, max_speed: float = 2800.0, max_ratio: float = 4.0, min_confidence: float = 0.12, max_missing: int = 8) -> DataFrame:
    """Detections (frame_id, x, y, size, confidence) with kept and reason: a jump in speed or size ends
    the track, and only a confident detection starts another before it has expired."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        last = None
        for r in rows:
            if last and r["frame_id"] - last["frame_id"] > max_missing:
                last = None
            reason = None
            if r["confidence"] < min_confidence:
                reason = "low_confidence"
            elif last:
                dt = max(r["frame_id"] - last["frame_id"], 1) / fps
                big, small = max(r["size"], last["size"]), max(min(r["size"], last["size"]), 1e-6)
                if math.hypot(r["x"] - last["x"], r["y"] - last["y"]) / dt > max_speed:
                    reason = "pixel_speed"
                elif big / small > max_ratio:
                    reason = "size_jump"
            if reason is None:
                last = r
            yield r["frame_id"], r["x"], r["y"], r["size"], r["confidence"], reason is None, reason

    return ordered_fold(detections, keys, ["frame_id"], fold, "frame_id long, x double, y double, size double, confidence double, kept boolean, reason string")


def smoothed_boxes(boxes: DataFrame, keys: list[str], alpha: float = 0.35, size_alpha: float = 0.25, max_jump: float = 80.0) -> DataFrame:
    """Exponentially smoothed centre and size; a jump or scene cut starts anew."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        s = None
        for r in rows:
            now = ((r["bbox_x1"] + r["bbox_x2"]) / 2, (r["bbox_y1"] + r["bbox_y2"]) / 2, r["bbox_x2"] - r["bbox_x1"], r["bbox_y2"] - r["bbox_y1"])
            if s is None or r["scene_cut"] or math.hypot(now[0] - s[0], now[1] - s[1]) > max_jump:
                s = now
            else:
                s = tuple((a * n + (1 - a) * o) for n, o, a in zip(now, s, (alpha, alpha, size_alpha, size_alpha), strict=True))
            yield r["frame_id"], s[0] - s[2] / 2, s[1] - s[3] / 2, s[0] + s[2] / 2, s[1] + s[3] / 2

    return ordered_fold(boxes, keys, ["frame_id"], fold, "frame_id long, x1 double, y1 double, x2 double, y2 double")


def sticky_roles(rows: DataFrame, keys: list[str], keep: float = 0.75, enter: float = 0.6) -> DataFrame:
    """Role by smoothed scores; a goalkeeper stays one."""

    def fold(items: Iterator[dict]) -> Iterator[tuple]:
        ref = keeper = 0.0
        role = "unknown"
        for r in items:
            ref = keep * ref + (1 - keep) * (r["referee_score"] or 0.0)
            keeper = keep * keeper + (1 - keep) * (r["goalkeeper_score"] or 0.0)
            if role != "goalkeeper":
                role = "goalkeeper" if keeper >= enter and keeper >= ref else "referee" if ref >= enter else "player"
            yield r["frame_id"], role, ref, keeper

    return ordered_fold(rows, keys, ["frame_id"], fold, "frame_id long, role string, referee_score double, goalkeeper_score double")


def calibration_states(frames: DataFrame, keys: list[str], max_frozen: int = 45, max_jump: float = 40.0, min_confidence: float = 0.35) -> DataFrame:
    """MEASURED, FILTERED (a jump or weak measurement is held back), FROZEN for some frames after the
    last measurement, else INVALID; a scene cut or other shot forgets it. frames: frame_id, shot_type,
    scene_cut, measured, confidence, corner_jump (px, from the frame before)."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        age = None
        for r in rows:
            live = r["shot_type"] in ("wide", "tactical")
            if r["scene_cut"] or not live:
                age = None
            if live and r["measured"] and r["confidence"] >= min_confidence and (age is None or (r["corner_jump"] or 0.0) <= max_jump):
                age, state = 0, "MEASURED"
            elif live and age is not None and age < max_frozen:
                age += 1
                state = "FILTERED" if r["measured"] else "PROPAGATED" if age <= 5 else "FROZEN"
            else:
                age, state = None, "INVALID"
            yield r["frame_id"], state, age

    return ordered_fold(frames, keys, ["frame_id"], fold, "frame_id long, state string, age int")


def propagate_calibration(frames: DataFrame, keys: list[str], max_frames: int = 25, max_jump: float = 35.0) -> DataFrame:
    """Fills frames without calibration from the nearest measured one of the same shot, unless it is
    too far from what stands before it, filled rows included. frames: frame_id, scene_cut, valid, px, py."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        rows = list(rows)
        segment, segments = 0, []
        for r in rows:
            segment += bool(r["scene_cut"])
            segments.append(segment)
        ahead: list[int | None] = [None] * len(rows)
        nxt = None
        for k in range(len(rows) - 1, -1, -1):
            nxt = k if rows[k]["valid"] else nxt
            ahead[k] = nxt
        back, prev = None, None
        for k, r in enumerate(rows):
            if r["valid"]:
                back, prev = k, (r["px"], r["py"])
                yield r["frame_id"], True, "measured", r["px"], r["py"]
                continue
            near = [j for j in (back, ahead[k]) if j is not None and segments[j] == segments[k] and abs(rows[j]["frame_id"] - r["frame_id"]) <= max_frames]
            near.sort(key=lambda j: (abs(rows[j]["frame_id"] - r["frame_id"]), rows[j]["frame_id"]))
            at = (rows[near[0]]["px"], rows[near[0]]["py"]) if near else None
            if at and (prev is None or math.hypot(at[0] - prev[0], at[1] - prev[1]) <= max_jump):
                prev = at
                yield r["frame_id"], True, "propagated", *at
            else:
                yield r["frame_id"], False, None, None, None

    return ordered_fold(frames, keys, ["frame_id"], fold, "frame_id long, valid boolean, source string, px double, py double")


def participation(votes: DataFrame, keys: list[str], confirm: float = 0.6, demote: int = 30) -> DataFrame:
    """On-pitch state by ordered role votes (frame_id, role, share, on_pitch, substituted): a goalkeeper
    is only demoted after many contrary votes, and substituted_off is final."""

    def fold(rows: Iterator[dict]) -> Iterator[tuple]:
        state, contrary = "unknown", 0
        for r in rows:
            if state != "substituted_off":
                if r["substituted"]:
                    state = "substituted_off"
                elif r["role"] == "goalkeeper" and r["share"] >= confirm:
                    state, contrary = "active_goalkeeper", 0
                elif state == "active_goalkeeper":
                    contrary += 1
                    state, contrary = ("active_player", 0) if contrary >= demote else (state, contrary)
                elif r["role"] in ("player", "goalkeeper"):
                    state = "active_player" if r["on_pitch"] else "bench"
                elif r["role"] in ("referee", "staff"):
                    state = "not_a_player"
            yield r["frame_id"], state, contrary

    return ordered_fold(votes, keys, ["frame_id"], fold, "frame_id long, state string, contrary int")
