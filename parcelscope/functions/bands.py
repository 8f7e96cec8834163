"""Interval labels. Each report keeps its own edges, labels and closed side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: band edges and labels
AGE_EDGES = [18, 30, 45, 60, 100]
AGE_LABELS = ["18-29", "30-44", "45-59", "60+"]
AGE_LABELS_DASH = ["18–29", "30–44", "45–59", "60+"]
TIER_EDGES = [0, 25, 50, 100]
TIER_LABELS_EXPORT = ["Rookie (≤25 trips)", "Intermediate (26–50 trips)", "Experienced (51+ trips)"]
TIER_LABELS_COHORT = ["Novice (≤25 trips)", "Intermediate (26–50)", "Experienced (51+)"]
TIER_LABELS_REPORT = ["Rookie (<=25)", "Intermediate (26-50)", "Experienced (51+)"]
PERIOD_EDGES = [-1, 5, 11, 17, 23]
PERIOD_LABELS_EXPORT = ["Overnight (0–5h)", "Morning (6–11h)", "Afternoon (12–17h)", "Evening (18–23h)"]
PERIOD_LABELS_REPORT = ["Overnight (0-5h)", "Morning (6-11h)", "Afternoon (12-17h)", "Evening (18-23h)"]
PERIOD_LABELS_MODEL = ["overnight", "morning", "afternoon", "evening"]
SIZE_EDGES = [0, 5, 10, 20, 100]
SIZE_LABELS = ["Small (1–5)", "Medium (6–10)", "Large (11–20)", "Extra (21+)"]
AMOUNT_EDGES = [0, 100, 250, 400, 10000]
AMOUNT_LABELS = ["< $100", "$100–$250", "$250–$400", "> $400"]
FAILURE_GROUPS_EXPORT = ["0 — No failure", "1 — One failure", "2 — Two failures", "3+ — Multiple failures"]
FAILURE_GROUPS_COHORT = ["0 failures", "1 failure", "2 failures", "3+ failures"]
VALUE_SEGMENTS = ["Low Value", "Medium Value", "High Value", "VIP"]
QUADRANTS_EXPORT = {
    "chronic": "Chronic — Disciplinary Action",
    "unstable": "Unstable — Coaching",
    "reference": "Reference — Best Practices",
    "monitor": "Monitor — Low Risk",
    "low_volume": "Insufficient Volume (<5)",
}
QUADRANTS_COHORT = {
    "chronic": "High Risk / Consistent (Chronic)",
    "unstable": "High Risk / Unstable (Coaching)",
    "reference": "Low Risk / Consistent (Reference)",
    "monitor": "Low Risk / Unstable (Monitor)",
}


def band(value: Column, edges: Sequence[float], labels: Sequence[str], right_closed: bool = True) -> Column:
    """Label of the interval holding `value`; NULL outside all intervals."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (value > low) & (value <= high) if right_closed else (value >= low) & (value < high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def label_order(label: Column, labels: Sequence[str]) -> Column:
    """Position of a label in its band, first = 1; NULL label gives NULL."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), label).cast("int")


def age_band_left(age: Column) -> Column:
    return band(age, AGE_EDGES, AGE_LABELS, right_closed=False)


def age_band_right(age: Column, labels: Sequence[str] = AGE_LABELS) -> Column:
    return band(age, AGE_EDGES, labels)


def age_band_sql(age: Column) -> Column:
    """Bounded bands with everything else, NULL included, in the last one."""
    return (F.when(age.between(18, 29), AGE_LABELS[0]).when(age.between(30, 44), AGE_LABELS[1])
            .when(age.between(45, 59), AGE_LABELS[2]).otherwise(AGE_LABELS[3]))


def experience_tier(trips: Column, labels: Sequence[str] = TIER_LABELS_EXPORT) -> Column:
    return band(trips, TIER_EDGES, labels)


def period_of_day(hour: Column, labels: Sequence[str] = PERIOD_LABELS_EXPORT) -> Column:
    return band(hour, PERIOD_EDGES, labels)


def order_size_tier(items: Column) -> Column:
    return band(items, SIZE_EDGES, SIZE_LABELS)


def amount_tier(amount: Column) -> Column:
    return band(amount, AMOUNT_EDGES, AMOUNT_LABELS)


def failure_group(failures: Column, labels: Sequence[str] = FAILURE_GROUPS_EXPORT) -> Column:
    return (F.when(failures == 0, labels[0]).when(failures == 1, labels[1])
            .when(failures == 2, labels[2]).otherwise(labels[3]))


def value_segment(value: Column, q25: Column, q50: Column, q75: Column) -> Column:
    """Customer grain: a value on a cut point belongs to the upper segment."""
    return (F.when(value >= q75, VALUE_SEGMENTS[3]).when(value >= q50, VALUE_SEGMENTS[2])
            .when(value >= q25, VALUE_SEGMENTS[1]).otherwise(VALUE_SEGMENTS[0]))


def value_quartile(value: Column, q25: Column, q50: Column, q75: Column) -> Column:
    """Order grain: a value on a cut point belongs to the lower segment."""
    return F.when(value.isNotNull(),
                  F.when(value <= q25, VALUE_SEGMENTS[0]).when(value <= q50, VALUE_SEGMENTS[1])
                  .when(value <= q75, VALUE_SEGMENTS[2]).otherwise(VALUE_SEGMENTS[3]))


def versus_global(rate: Column, overall: Column, above: str = "Above Average",
                  below: str = "Below Average") -> Column:
    return F.when(rate > overall, above).otherwise(below)


def status(rate: Column, overall: Column) -> Column:
    return versus_global(rate, overall, "critical", "ok")


def risk_label(probability: Column) -> Column:
    return (F.when(probability < 0.10, "Low Risk").when(probability < 0.20, "Medium Risk")
            .otherwise("High Risk"))


def attribution_level(pct: Column) -> Column:
    return (F.when(pct > 50, "critical").when(pct > 10, "warning")
            .when(pct > 3, "neutral").otherwise("ok"))


def significance(p: Column) -> Column:
    return F.when(p < 0.05, "YES (p < 0.05)").otherwise("NO (p >= 0.05)")


def p_text(p: Column, decimals: int = 4) -> Column:
    return F.when(p < 0.001, "p < 0.001").otherwise(F.format_string(f"p = %.{decimals}f", p))


def quadrant(high_risk: Column, unstable: Column, labels: dict[str, str]) -> Column:
    return (F.when(high_risk & ~unstable, labels["chronic"]).when(high_risk & unstable, labels["unstable"])
            .when(~high_risk & ~unstable, labels["reference"]).otherwise(labels["monitor"]))
