"""Engineered features (survey 2.C): pure column expressions, one projection, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions import clip, np_round
from .ordered import exact_quantile_rows


def attendance_risk(att="attendance_percentage", high=cfg.ATTENDANCE_HIGH,
                    medium=cfg.ATTENDANCE_MEDIUM) -> F.Column:
    """2 if att >= 85, 1 if >= 75, else 0 (NULL -> 0)."""
    a = F.col(att)
    return F.when(a >= high, 2).when(a >= medium, 1).otherwise(0)


def assignment_completion_ratio(asn="assignment_score") -> F.Column:
    """round(clip(assignment, 0, 100) / 100, 4)."""
    return np_round(clip(asn, 0, 100) / 100, 4)


def engagement_score(lms="lms_activity", videos="videos_watched", disc="discussion_participation",
                     weights=cfg.ENGAGEMENT_WEIGHTS, videos_cap=cfg.VIDEOS_CAP,
                     disc_cap=cfg.DISCUSSION_CAP) -> F.Column:
    """round(0.40 lms + 0.30 videos% + 0.30 discussion%, 2), same operation order as pandas."""
    vid_norm = clip(videos, 0, videos_cap) / videos_cap * 100
    disc_norm = clip(disc, 0, disc_cap) / disc_cap * 100
    lms_c = clip(lms, 0, 100)
    return np_round(F.lit(weights[lms]) * lms_c + F.lit(weights[videos]) * vid_norm
                    + F.lit(weights[disc]) * disc_norm, 2)


def performance_trend(mid="midterm_marks", asn="assignment_score", quiz="quiz_score") -> F.Column:
    """C4: round(midterm - (assignment + quiz) / 2, 2)."""
    return np_round(F.col(mid) - (F.col(asn) + F.col(quiz)) / 2, 2)


def overall_academic_score(columns, weights=cfg.SCORE_WEIGHTS) -> F.Column:
    """round(clip(sum of weight * column over present columns, 0, 100), 2); no renormalising."""
    terms = [F.col(c) * F.lit(w) for c, w in weights.items() if c in columns]
    total = reduce(lambda a, b: a + b, terms, F.lit(0.0))
    return np_round(clip(total, 0, 100), 2)


def add_features(df: DataFrame) -> DataFrame:
    """C1-C5 in one projection (stays inside one whole-stage-codegen span)."""
    return df.withColumns({
        "attendance_risk": attendance_risk(),
        "assignment_completion_ratio": assignment_completion_ratio(),
        "engagement_score": engagement_score(),
        "performance_trend": performance_trend(),
        "overall_academic_score": overall_academic_score(df.columns),
    })


def describe_features(df: DataFrame, features=cfg.ENGINEERED_FEATURES) -> DataFrame:
    """Count, mean, std (n-1), min, 25/50/75 %, max per feature, one row per feature.

    One scan for the moments and two for the quartiles (``exact_quantile_rows``) read the features, which are held
    for them (memory, then disk) and released. A feature without values has no row.
    """
    cols = [c for c in features if c in df.columns]
    held = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kinds = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        number = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
        row = held.agg(*[f(number[c]).alias(f"{c}__{k}") for c in cols for k, f in kinds.items()]).first() if cols else {}
        quartiles = {(c, p): q for c, p, q, _ in exact_quantile_rows(held, cols, [0.25, 0.5, 0.75])}
    finally:
        held.unpersist()
    rows = [(c, *[row[f"{c}__{k}"] for k in ("count", "mean", "std", "min")], *[quartiles[c, p] for p in (0.25, 0.5, 0.75)], row[f"{c}__max"])
            for c in cols if row[f"{c}__count"]]
    return df.sparkSession.createDataFrame(rows, "feature string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def profile_axes(df: DataFrame, key: str = cfg.ID_COLUMN, axes=cfg.PROFILE_AXES,
                 target=cfg.PROFILE_TARGET) -> DataFrame:
    """Seven-axis profile per student in long form (student, axis, value, target).

    The last axis is videos scaled to 0-100 (``min(videos / 60 * 100, 100)``);
    absent values read as 0.
    """
    structs = []
    for i, (label, col) in enumerate(axes):
        v = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
        if col == "videos_watched":
            v = F.least(v / cfg.VIDEOS_CAP * 100, F.lit(100.0))
        structs.append(F.struct(F.lit(i).alias("axis_no"), F.lit(label).alias("axis"), v.alias("value")))
    return df.select(key, F.explode(F.array(*structs)).alias("a")).select(
        key, "a.axis_no", "a.axis", "a.value", F.lit(float(target)).alias("target"))
