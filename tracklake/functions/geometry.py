"""Boxes, points and homographies as Column expressions (NULL in, NULL out)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PITCH_LENGTH, PITCH_WIDTH = 105.0, 68.0
Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "bbox_") -> Box:
    """The columns <prefix>x1, y1, x2, y2."""
    return F.col(f"{prefix}x1"), F.col(f"{prefix}y1"), F.col(f"{prefix}x2"), F.col(f"{prefix}y2")


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def finite(*values: Column) -> Column:
    """Whether all values are known numbers, neither NaN nor infinite."""
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return out


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def valid(b: Box) -> Column:
    return finite(*b) & (width(b) > 0) & (height(b) > 0)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def clip(b: Box, frame_width: float, frame_height: float) -> Box:
    def to(v: Column, top: float) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(float(top)))

    return to(b[0], frame_width), to(b[1], frame_height), to(b[2], frame_width), to(b[3], frame_height)


def visible_fraction(b: Box, frame_width: float, frame_height: float) -> Column:
    return F.when(area(b) > 0, area(clip(b, frame_width, frame_height)) / area(b)).otherwise(F.lit(0.0))


def foot_point(b: Box) -> tuple[Column, Column]:
    """Middle of the lower edge."""
    return (b[0] + b[2]) / 2, b[3]


def foot_confidence(b: Box, frame_width: float, frame_height: float) -> Column:
    """0 where the lower edge is out of the frame, else the visible share of the width."""
    seen = F.greatest(F.least(b[2], F.lit(float(frame_width))) - F.greatest(b[0], F.lit(0.0)), F.lit(0.0))
    return F.when((b[3] < 0) | (b[3] > frame_height) | (width(b) <= 0), F.lit(0.0)).otherwise(seen / width(b))


def crop_quality(b: Box, frame_width: float, frame_height: float) -> Column:
    """Least of visible share and foot confidence; 0 for an invalid box."""
    return F.when(valid(b), F.least(visible_fraction(b, frame_width, frame_height), foot_confidence(b, frame_width, frame_height))).otherwise(F.lit(0.0))


def ankle_point(b: Box) -> Column:
    """Struct: middle point at 92% of the height, and points 15% of the width to either side of it."""
    x, y = (b[0] + b[2]) / 2, b[1] + height(b) * 0.92
    return F.struct(x.alias("x"), y.alias("y"), (x - width(b) * 0.15).alias("left_x"), (x + width(b) * 0.15).alias("right_x"))


def torso_crop(b: Box, frame_width: int, frame_height: int, top: float = 0.15, bottom: float = 0.55, side: float = 0.2) -> Column:
    """Whole-pixel crop of the upper body within the frame; NULL where under 2 pixels remain."""
    x1 = F.greatest(F.floor(b[0] + width(b) * side), F.lit(0))
    x2 = F.least(F.ceil(b[2] - width(b) * side), F.lit(frame_width))
    y1 = F.greatest(F.floor(b[1] + height(b) * top), F.lit(0))
    y2 = F.least(F.ceil(b[1] + height(b) * bottom), F.lit(frame_height))
    return F.when((x2 - x1 >= 2) & (y2 - y1 >= 2), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def crop_score(b: Box, confidence: Column, frame_width: float, frame_height: float, full_area: float = 20_000.0) -> Column:
    """Weights .45 area, .25 nearness to the centre, .20 confidence, .10 distance from the border."""
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    half = distance(F.lit(0.0), F.lit(0.0), F.lit(frame_width / 2), F.lit(frame_height / 2))
    centre = F.greatest(F.lit(0.0), 1 - distance(cx, cy, F.lit(frame_width / 2), F.lit(frame_height / 2)) / half)
    border = F.when((b[0] <= 2) | (b[1] <= 2) | (b[2] >= frame_width - 2) | (b[3] >= frame_height - 2), F.lit(0.0)).otherwise(F.lit(1.0))
    return 0.45 * F.least(area(b) / full_area, F.lit(1.0)) + 0.25 * centre + 0.20 * confidence + 0.10 * border


Matrix = Sequence[Sequence[Column]]


def matrix(json: Column) -> Matrix:
    """Nine Columns of a 3x3 matrix in JSON, over its last value; NULL where that is 0 or not finite."""
    m = F.from_json(json, "array<array<double>>")
    cell = [[F.get(F.get(m, F.lit(r)), F.lit(c)) for c in range(3)] for r in range(3)]
    scale = F.when(F.abs(cell[2][2]) > 1e-12, cell[2][2])
    return [[cell[r][c] / scale for c in range(3)] for r in range(3)]


def cells(m: Matrix) -> Column:
    """The nine values as one array, so that a plan keeps them in a column instead of repeating their expressions."""
    return F.array(*[v for row in m for v in row])


def from_cells(column: Column) -> Matrix:
    return [[F.get(column, F.lit(3 * r + c)) for c in range(3)] for r in range(3)]


def determinant(m: Matrix) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def inverse(m: Matrix) -> Matrix:
    """Inverse over its last value; NULL where singular."""
    det = F.when(F.abs(determinant(m)) > 1e-12, determinant(m))

    def minor(r: int, c: int) -> Column:
        a, b = [k for k in range(3) if k != r]
        x, y = [k for k in range(3) if k != c]
        return m[a][x] * m[b][y] - m[a][y] * m[b][x]

    raw = [[(minor(c, r) if (r + c) % 2 == 0 else -minor(c, r)) / det for c in range(3)] for r in range(3)]
    scale = F.when(F.abs(raw[2][2]) > 1e-12, raw[2][2])
    return [[raw[r][c] / scale for c in range(3)] for r in range(3)]


def project(m: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography; NULL where the denominator is about 0."""
    w = m[2][0] * x + m[2][1] * y + m[2][2]
    w = F.when(F.abs(w) > 1e-9, w)
    return (m[0][0] * x + m[0][1] * y + m[0][2]) / w, (m[1][0] * x + m[1][1] * y + m[1][2]) / w


def to_pitch(m: Matrix, x: Column, y: Column, ok: Column, margin: float | None = 0.0, flip: bool = False) -> Column:
    """Struct x, y in metres; NULL where not ok or, unless margin is None, outside the pitch and margin."""
    px, py = project(m, x, y)
    if flip:
        px, py = PITCH_LENGTH - px, PITCH_WIDTH - py
    inside = F.lit(True) if margin is None else px.between(-margin, PITCH_LENGTH + margin) & py.between(-margin, PITCH_WIDTH + margin)
    return F.when(ok & inside & px.isNotNull() & py.isNotNull(), F.struct(px.alias("x"), py.alias("y")))


def round_trip_error(m: Matrix, back: Matrix, x: Column, y: Column) -> Column:
    """Distance of a point from its image under the matrix and then `back`, its inverse."""
    bx, by = project(back, *project(m, x, y))
    return distance(x, y, bx, by)


def corner_jump(a: Matrix, b: Matrix, frame_width: float = 1920.0, frame_height: float = 1080.0) -> Column:
    """Mean distance between the images of the frame's corners."""
    total = F.lit(0.0)
    for x, y in ((0.0, 0.0), (frame_width, 0.0), (frame_width, frame_height), (0.0, frame_height)):
        total = total + distance(*project(a, F.lit(x), F.lit(y)), *project(b, F.lit(x), F.lit(y)))
    return total / 4
