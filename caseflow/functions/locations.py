"""Care-unit tiers and the rules that read a tier out of a unit name.

Every operator takes tiers as parameters; the sets below are the hospital defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The care units of each tier.
ICU = (
    "Cardiac Vascular Intensive Care Unit (CVICU)",
    "Coronary Care Unit (CCU)",
    "Intensive Care Unit (ICU)",
    "Medical Intensive Care Unit (MICU)",
    "Medical/Surgical Intensive Care Unit (MICU/SICU)",
    "Neuro Surgical Intensive Care Unit (Neuro SICU)",
    "Surgical Intensive Care Unit (SICU)",
    "Trauma SICU (TSICU)",
)
SURGICAL_WARD = (
    "Cardiac Surgery",
    "Med/Surg/Trauma",
    "Surgery",
    "Surgery/Pancreatic/Biliary/Bariatric",
    "Surgery/Trauma",
    "Thoracic Surgery",
)
INTERMEDIATE = (
    "Cardiology Surgery Intermediate",
    "Hematology/Oncology Intermediate",
    "Medicine/Cardiology Intermediate",
    "Neuro Intermediate",
    "Neuro Stepdown",
    "Surgery/Vascular/Intermediate",
    "Surgical Intermediate",
)
PACU = ("PACU",)
EMERGENCY = ("Emergency Department", "Emergency Department Observation")
# The units the event log calls a medical ward.
MEDICAL_WARD = (
    "Cardiology",
    "Discharge Lounge",
    "Hematology/Oncology",
    "Med/Surg",
    "Med/Surg/GYN",
    "Medicine",
    "Medicine/Cardiology",
    "Neurology",
    "Observation",
    "Oncology",
    "Psychiatry",
    "Transplant",
    "Vascular",
)
# The units the location ladder puts at ward level without question.
LADDER_WARD = (
    "Cardiac Surgery",
    "Hematology/Oncology",
    "Med/Surg",
    "Med/Surg/GYN",
    "Med/Surg/Trauma",
    "Medical/Surgical (Gynecology)",
    "Medicine",
    "Medicine/Cardiology",
    "Neurology",
    "Observation",
    "Oncology",
    "Surgery",
    "Surgery/Pancreatic/Biliary/Bariatric",
    "Surgery/Trauma",
    "Thoracic Surgery",
    "Transplant",
    "Vascular",
)
LEVEL_NAMES = {
    0: "Ward Care",
    1: "Level 1 - Enhanced Care",
    2: "Level 2 - Critical Care",
    3: "Level 3 - Critical Care",
}
# The area names of the event log.
AREA_ICU = "ICU"
AREA_SURGERY = "Surgery Ward"
AREA_STEPDOWN = "Stepdown"
AREA_MEDICAL = "Medical Ward"
AREA_EMERGENCY = "Emergency Department"
ANCHOR = "Hospital Admission"


@dataclass(frozen=True)
class Tiers:
    """The unit sets the label rules need: what counts as critical, intermediate and PACU."""

    critical: tuple[str, ...] = ICU
    intermediate: tuple[str, ...] = INTERMEDIATE
    pacu: tuple[str, ...] = PACU


@dataclass(frozen=True)
class Rung:
    """Ladder placement of a group of units."""

    units: tuple[str, ...]
    level: int
    alt_level: int | None = None
    contestable: bool = False
    procedural: bool = False


HOSPITAL_AREAS = {
    AREA_EMERGENCY: EMERGENCY,
    AREA_ICU: ICU,
    AREA_SURGERY: SURGICAL_WARD,
    AREA_STEPDOWN: PACU + INTERMEDIATE,
    AREA_MEDICAL: MEDICAL_WARD,
}
HOSPITAL_LADDER = (
    Rung(tuple(u for u in ICU if u != "Coronary Care Unit (CCU)"), 3),
    Rung(("Coronary Care Unit (CCU)",), 3, alt_level=2, contestable=True),
    Rung(INTERMEDIATE, 1, alt_level=2, contestable=True),
    Rung(PACU, 1, alt_level=2, contestable=True, procedural=True),
    Rung(("Cardiology",), 0, alt_level=1, contestable=True),
    Rung(LADDER_WARD, 0),
)


def in_units(unit: str | Column, units: tuple[str, ...]) -> Column:
    """Membership that is False, not NULL, for a NULL unit."""
    column = F.col(unit) if isinstance(unit, str) else unit
    return F.coalesce(column.isin(*units), F.lit(False))


def by_unit(unit: str | Column, values: dict[str, object]) -> Column:
    """Look a unit up in a small fixed mapping; unknown units give NULL."""
    column = F.col(unit) if isinstance(unit, str) else unit
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.element_at(F.create_map(*pairs), column)


def activity_name(unit: str | Column, event_type: str | Column, areas: dict[str, tuple[str, ...]]) -> Column:
    """'Admission to <area>' or 'Transfer to <area>'; NULL where unit or event type is not mapped."""
    kind = F.col(event_type) if isinstance(event_type, str) else event_type
    area = by_unit(unit, {u: a for a, units in areas.items() for u in units})
    arrives = (kind == "admit") | ((kind == "ED") & (area == AREA_EMERGENCY))
    return F.when(arrives, F.concat(F.lit("Admission to "), area)).when(
        kind == "transfer", F.concat(F.lit("Transfer to "), area)
    )


# Token ids of the activities, 0 is padding.
ACTIVITY_IDS = {
    "Hospital Admission": 1,
    "Admission to Emergency Department": 2,
    "Admission to Medical Ward": 3,
    "Admission to ICU": 4,
    "Admission to Surgery Ward": 5,
    "Admission to Stepdown": 6,
    "Transfer to Medical Ward": 7,
    "Transfer to ICU": 8,
    "Transfer to Surgery Ward": 9,
    "Transfer to Stepdown": 10,
    "Transfer to Emergency Department": 11,
}
