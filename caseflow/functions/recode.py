"""Scalar recodings: bands, category collapses, code chapters.  Each is one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Admission types that count as emergency.
EMERGENCY_TYPES = (
    "DIRECT EMER.",
    "DIRECT OBSERVATION",
    "EU OBSERVATION",
    "EW EMER.",
    "OBSERVATION ADMIT",
    "URGENT",
)
INSURANCE_KEPT = ("Medicare", "Medicaid", "Private")
# Ethnicity group -> case-insensitive substrings; the first group that matches wins.
ETHNICITY_PATTERNS = {
    "WHITE": ("white", "portuguese"),
    "BLACK": ("black",),
    "HISPANIC/LATINO": ("hispanic", "latino", "south american"),
    "ASIAN": ("asian",),
    "NATIVE": ("american indian", "alaska native", "native hawaiian", "pacific islander"),
    "MULTIPLE": ("multiple",),
    "UNKNOWN": ("unknown", "unable", "declined"),
}
# Last three-digit ICD-9 category of chapters 1..17; chapter 1 starts at 001.
ICD9_CHAPTER_ENDS = (139, 239, 279, 289, 319, 389, 459, 519, 579, 629, 679, 709, 739, 759, 779, 799, 999)
# ICD-10 leading letters of each chapter (D is divided by its first digit).
ICD10_CHAPTER_LETTERS = {
    1: "AB", 2: "C", 3: "E", 5: "F", 6: "GH", 7: "I", 8: "J", 9: "K", 10: "N",
    11: "O", 12: "L", 13: "M", 14: "Q", 15: "P", 16: "R", 17: "ST", 18: "UVWXYZ",
}
ICD10_D_DIGITS = {2: "01234", 4: "5678"}
# Names of the 18 chapter counts.
CHAPTER_NAMES = (
    "infectious", "neoplasms", "endocrine", "blood", "mental", "nervous", "circulatory", "respiratory",
    "digestive", "genitourinary", "pregnancy", "skin", "musculoskeletal", "congenital", "perinatal",
    "symptoms", "injury", "supplementary",
)
CHAPTER_COLUMNS = tuple(f"icd_ch{i}_{name}" for i, name in enumerate(CHAPTER_NAMES, start=1))


def age_band(age: Column, first: int = 18, width: int = 10, bands: int = 7) -> Column:
    """Ten-year bands from 18; everything outside them, NULL included, is the open last band."""
    last = first + width * bands
    low = F.lit(first) + F.floor((age - first) / width) * width
    return F.when(
        age.between(first, last - 1),
        F.concat_ws("-", low.cast("string"), (low + width - 1).cast("string")),
    ).otherwise(f"{last}+")


def insurance_group(insurance: Column, kept: tuple[str, ...] = INSURANCE_KEPT) -> Column:
    return F.when(insurance.isin(*kept), insurance).otherwise("Other")


def pattern_group(text: Column, patterns: dict[str, tuple[str, ...]], unmatched: str, missing: str) -> Column:
    """First group with a case-insensitive substring match; an ordered cascade."""
    result = F.when(text.isNull(), F.lit(missing))
    for group, needles in patterns.items():
        hit = F.lit(False)
        for needle in needles:
            hit = hit | text.ilike(f"%{needle}%")
        result = result.when(hit, F.lit(group))
    return result.otherwise(unmatched)


def ethnicity(race: Column, patterns: dict[str, tuple[str, ...]] = ETHNICITY_PATTERNS) -> Column:
    return pattern_group(race, patterns, unmatched="OTHER", missing="UNKNOWN")


def emergency_flag(admission_type: Column, types: tuple[str, ...] = EMERGENCY_TYPES) -> Column:
    return F.when(admission_type.isin(*types), 1).otherwise(0)


def emergency_or_elective(admission_type: Column, types: tuple[str, ...] = EMERGENCY_TYPES) -> Column:
    return F.when(admission_type.isin(*types), "emergency").otherwise("elective")


def measured_number(text: Column, low: float, high: float) -> Column:
    """Plain decimal text inside [low, high], else NULL."""
    number = F.when(text.rlike(r"^[0-9]+\.?[0-9]*$"), text.try_cast("double"))
    return F.when(number.between(low, high), number)


def bmi_category(bmi: Column) -> Column:
    """Four classes on one-decimal limits.  Values between 24.9 and 25 or 29.9 and 30 stay Unknown."""
    return (
        F.when(bmi < 18.5, "Underweight")
        .when(bmi.between(18.5, 24.9), "Normal")
        .when(bmi.between(25.0, 29.9), "Overweight")
        .when(bmi >= 30.0, "Obese")
        .otherwise("Unknown")
    )


def icd_chapter(version: Column, code: Column) -> Column:
    """Chapter 1..18 of an ICD-9 or ICD-10 code, else NULL.

    Kept small on purpose: counting chapters evaluates it often, and a long CASE chain would make
    the generated method too large to be compiled.
    """
    category = F.substring(code, 1, 3).cast("int")
    passed = F.lit(1)
    for end in ICD9_CHAPTER_ENDS[:-1]:
        passed = passed + (category > end).cast("int")
    numeric = F.when(category > 0, passed)
    nine = F.when(code.rlike("^[0-9]{3}"), numeric).when(F.upper(F.substring(code, 1, 1)).isin("V", "E"), F.lit(18))
    heads = {letter: chapter for chapter, letters in ICD10_CHAPTER_LETTERS.items() for letter in letters}
    heads |= {f"D{digit}": chapter for chapter, digits in ICD10_D_DIGITS.items() for digit in digits}
    table = F.create_map(*[F.lit(x) for item in heads.items() for x in item])
    head = F.when(code.startswith("D"), F.substring(code, 1, 2)).otherwise(F.substring(code, 1, 1))
    return F.when(version == 9, nine).when(version == 10, F.element_at(table, head))
