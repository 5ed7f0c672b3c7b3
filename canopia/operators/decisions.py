"""The decision on a measurement, as one chain of conditions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("observe", "recommend", "auto_radius")


@dataclass(frozen=True)
class Rules:
    """Limits of the decision; lengths in millimetres."""

    mode: str = "recommend"
    detect_removal: bool = True
    apply_removal: bool = False
    least_absent: int = 2
    auto_confidence: float = 0.8
    least_increase: float = 3.0
    least_decrease: float = 3.0
    auto_reduction_percent: float = 25.0
    single_update_percent: float = 50.0
    daily_growth: float = 10.0

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode {self.mode!r}")


def decide(rules: Rules) -> Column:
    """dec1: struct(decision, confidence) of a row with calibrated, absent, age_days, current_mm, proposed_mm,
    seen_before, streak, confidence, misaligned, ambiguous and days; the first rule that holds decides."""
    c = F.col
    auto, watch = rules.mode == "auto_radius", rules.mode == "observe"
    shrink = c("proposed_mm") < c("current_mm")
    percent = 100 * F.abs(c("proposed_mm") - c("current_mm")) / F.greatest(c("current_mm"), F.lit(1.0))
    too_small = F.abs(c("proposed_mm") - c("current_mm")) < F.when(shrink, rules.least_decrease).otherwise(rules.least_increase)
    too_much = percent > rules.auto_reduction_percent
    noted = F.when(too_small, 0.05).otherwise(c("confidence"))
    cap = F.least(1 - percent / 100, F.lit(rules.auto_confidence - 0.01))
    sure = F.when(shrink & too_much, F.greatest(F.lit(0.05), F.least(noted, cap))).otherwise(noted)
    removed = F.when(F.lit(auto and rules.apply_removal) & (c("confidence") >= rules.auto_confidence), "removed").otherwise("removal_recommended")
    absence = (
        F.when(F.lit(not rules.detect_removal) | c("age_days").isNull() | (c("age_days") <= 30) | (c("current_mm") <= 50) | ~c("seen_before"), "observed")
        .when((c("streak") < rules.least_absent) & ~((c("confidence") >= 0.9) & c("misaligned")), "observed")
        .when(F.lit(watch), "observed")
        .otherwise(removed)
    )
    jump = (percent > rules.single_update_percent) | (c("proposed_mm") - c("current_mm") > rules.daily_growth * F.greatest(c("days"), F.lit(1)))
    doubtful = F.lit(auto) & (F.when(shrink, too_much).otherwise(jump) | (sure < rules.auto_confidence))
    change = F.when(F.lit(watch), "observed").when(doubtful, "uncertain").otherwise("applied" if auto else "recommended")
    same = c("proposed_mm") == c("current_mm")
    decision = F.when(~c("calibrated"), "observed").when(c("absent"), absence).when(c("ambiguous"), "uncertain").when(same, "retain").otherwise(change)
    untouched = ~c("calibrated") | c("absent") | c("ambiguous") | same
    return F.struct(decision.alias("decision"), F.when(untouched, c("confidence")).otherwise(sure).alias("confidence"))
