"""Labels, zones, statuses and formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklake.functions.geometry import PITCH_LENGTH, PITCH_WIDTH

PENALTY_DEPTH, PENALTY_WIDTH = 16.5, 40.32


def tri_state(value: Column) -> Column:
    """true/1/yes/y/t, false/0/no/n/f or empty, anything else NULL."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "1", "yes", "y", "t", "1.0"), F.lit(True)).when(v.isin("false", "0", "no", "n", "f", "0.0", ""), F.lit(False))


def known_team(team: Column) -> Column:
    return F.when(~F.trim(team).isin("", "unknown", "None"), team)


def team_index(team: Column) -> Column:
    last = F.right(team, F.lit(1))
    return F.when(last.isin("0", "1"), last.cast("int"))


def attack_sign(team: Column, team0_sign: int = 1) -> Column:
    """+1 or -1: team_1 attacks the other way; unknown counts as team_0."""
    return F.when(F.coalesce(team_index(team), F.lit(0)) == 1, F.lit(-team0_sign)).otherwise(F.lit(team0_sign))


def zone_third(x: Column, team: Column, team0_sign: int = 1) -> Column:
    progress = F.when(attack_sign(team, team0_sign) > 0, x).otherwise(PITCH_LENGTH - x)
    return F.when(progress < PITCH_LENGTH / 3, F.lit("zone_1")).when(progress < 2 * PITCH_LENGTH / 3, F.lit("zone_2")).when(x.isNotNull(), F.lit("zone_3"))


def in_own_penalty(x: Column, y: Column, team: Column, team0_sign: int = 1) -> Column:
    deep = F.when(attack_sign(team, team0_sign) > 0, x.between(0.0, PENALTY_DEPTH)).otherwise(x.between(PITCH_LENGTH - PENALTY_DEPTH, PITCH_LENGTH))
    return (F.abs(y - PITCH_WIDTH / 2) <= PENALTY_WIDTH / 2) & deep


def in_opponent_penalty(x: Column, y: Column, team: Column, team0_sign: int = 1) -> Column:
    return in_own_penalty(x, y, team, -team0_sign)


def channel(y: Column) -> Column:
    return F.when(y < PITCH_WIDTH / 3, F.lit("right_channel")).when(y < 2 * PITCH_WIDTH / 3, F.lit("central_channel")).when(y.isNotNull(), F.lit("left_channel"))


def zone_labels(x: Column, y: Column, team: Column, team0_sign: int = 1) -> Column:
    zone = zone_third(x, team, team0_sign)
    return F.struct(
        zone.alias("zone"), (zone == "zone_3").alias("final_third"), in_own_penalty(x, y, team, team0_sign).alias("own_penalty_area"),
        in_opponent_penalty(x, y, team, team0_sign).alias("opponent_penalty_area"), channel(y).alias("channel"),
        ((channel(y) != "central_channel") & (zone != "zone_1")).alias("half_space"),
    )


def bin_of(value: Column, extent: float, bins: int) -> Column:
    return F.least(F.greatest(F.floor(value / extent * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 1))


def action_status(confidence: Column, confirmed: float = 0.65, candidate: float = 0.40) -> Column:
    return F.when(confidence >= confirmed, F.lit("confirmed")).when(confidence >= candidate, F.lit("candidate")).otherwise(F.lit("unresolved"))


def evidence_status(score: Column, corroborated: Column, confirm: float = 0.85, candidate: float = 0.45, floor: float = 0.15) -> Column:
    """NULL: nothing is emitted."""
    return F.when((score >= confirm) & corroborated, F.lit("auto_confirmed")).when(score >= candidate, F.lit("candidate_review_required")).when(score >= floor, F.lit("unresolved"))


def confirmed(status: Column) -> Column:
    return status.isin("auto_confirmed", "manually_confirmed")


def replay_shot(shot_type: Column) -> Column:
    return shot_type.rlike("(?i)replay|close|graphic")


def excluded_role(role: Column) -> Column:
    return F.coalesce(F.lower(role).rlike("referee|official|staff|assistant"), F.lit(False))


def role_family(role: Column) -> Column:
    r = F.lower(role)
    return F.when(r.contains("goalkeeper"), F.lit("goalkeeper")).when(r.rlike("referee|official|assistant"), F.lit("official")).when(r.contains("staff"), F.lit("staff")).when(r.contains("player"), F.lit("player")).otherwise(F.lit("unknown"))


def role_mismatch(a: Column, b: Column) -> Column:
    """A goalkeeper against an outfield player."""
    x, y = role_family(a), role_family(b)
    return ((x == "goalkeeper") & (y == "player")) | ((x == "player") & (y == "goalkeeper"))


def hue_distance(a: Column, b: Column) -> Column:
    """Circular distance on a hue circle of 180."""
    d = F.abs(a - b)
    return F.least(d, 180 - d)


def hsv_close(a: Column, b: Column, hue: float = 12, saturation: float = 50, value: float = 50) -> Column:
    return (hue_distance(a["h"], b["h"]) <= hue) & (F.abs(a["s"] - b["s"]) <= saturation) & (F.abs(a["v"] - b["v"]) <= value)


def accept_match(best: Column, second: Column, floor: float, strong: float, margin: float) -> Column:
    """Struct accepted, reason: absolute and relative test of a best against a second similarity."""
    lead = best - F.coalesce(second, F.lit(-1.0))
    reason = F.when(best.isNull() | (best < floor), F.lit("below_floor")).when(best >= strong, F.lit("strong")).when(lead >= margin, F.lit("relative_margin")).otherwise(F.lit("ambiguous"))
    return F.struct(reason.isin("strong", "relative_margin").alias("accepted"), reason.alias("reason"))


def rejection_category(reason: Column) -> Column:
    """Category of a calibration's rejection, by the first of these that its text has."""
    r = F.lower(reason)
    out = F.when(reason.isNull(), F.lit(None).cast("string"))
    for words, name in (("scene|cut", "scene_cut"), ("replay|close", "non_live_shot"), ("reproj", "reprojection_error"), ("coverage", "low_coverage"), ("confidence", "low_confidence"), ("point|correspond", "insufficient_points"), ("orient", "orientation"), ("homography|matrix|singular", "invalid_homography")):
        out = out.when(r.rlike(words), F.lit(name))
    return out.otherwise(F.lit("other"))


def traffic_light(quality: Column) -> Column:
    return F.when(quality.isNull(), F.lit("none")).when(quality >= 0.75, F.lit("green")).when(quality >= 0.5, F.lit("amber")).otherwise(F.lit("red"))


def srt_timestamp(seconds: Column) -> Column:
    ms = F.greatest(F.floor(seconds * 1000 + 0.5), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def clock(ms: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(ms / 60_000), F.floor(ms / 1000) % 60)


def jersey_text(value: Column) -> Column:
    """Digits of a jersey number of 0 to 99; NULL for anything else."""
    v = F.regexp_replace(F.trim(value.cast("string")), r"\.0+$", "")
    return F.when(v.rlike("^[0-9]{1,2}$"), v.cast("int").cast("string"))


def side(team: Column) -> Column:
    return F.when(team_index(team) == 0, F.lit("left")).when(team_index(team) == 1, F.lit("right"))


def jersey_class(label: Column) -> Column:
    """Class of a jersey label: its number, 100 where unknown (-1); others are an error."""
    return F.when(label == -1, F.lit(100)).when(label.between(0, 99), label).otherwise(F.raise_error(F.concat(F.lit("no jersey label: "), label.cast("string"))).cast("int"))


def fingerprint(*values: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*values)), 256)


def frame_of(seconds: Column, fps: float, frames: int) -> Column:
    return F.least(F.greatest(F.floor(seconds * fps + 0.5), F.lit(0)), F.lit(frames - 1)).cast("long")


def time_of(frame: Column, fps: float) -> Column:
    return frame / F.lit(float(fps))


def shot_label(green: Column, flow: Column, edges: Column, texture: Column, players: Column, largest: Column) -> Column:
    """Shot type by an ordered list of rules over picture features."""
    return (
        F.when((edges >= 0.22) & (green < 0.18), F.lit("graphic")).when(largest >= 0.35, F.lit("close_up")).when(green >= 0.32, F.when(flow > 0.025, F.lit("tactical")).otherwise(F.lit("wide")))
        .when(green >= 0.18, F.lit("medium")).when(texture >= 0.12, F.lit("crowd")).when(players >= 2, F.lit("bench")).otherwise(F.lit("unknown"))
    )


def quality_words(flags: Column) -> Column:
    return F.when(F.size(flags) == 0, F.lit("validated")).otherwise(F.array_join(F.array_sort(flags), ", "))
