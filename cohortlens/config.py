"""Parameters of a cohort study.

Everything that is a clinical choice (code prefixes, cut-points, level order,
text patterns) is an argument here, so the same operators serve other studies.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CodeRule:
    """Codes starting with ``prefix``; with ``after``, only beyond that ordinal."""

    prefix: str
    after: int | None = None


# They define the case group, the comorbidity and the categories.
CASE_RULES = (CodeRule("428"),)
COMORBIDITY_RULES = (CodeRule("249"), CodeRule("250", after=1))
AGE_CAP = 89
AGE_CUTS = (18, 60)
AGE_GROUPS = ("0-17", "18-59", "60+")
GENDERS = ("F", "M")
STATUS_LABELS = {0: "No secondary diabetes", 1: "Secondary diabetes"}
ETHNICITY_PATTERNS = (
    ("%WHITE%", "White"),
    ("%BLACK%", "Black"),
    ("%ASIAN%", "Asian"),
    ("%HISPANIC%", "Hispanic"),
)
ETHNICITY_DEFAULT = "Other/Unknown"


@dataclass(frozen=True)
class CohortConfig:
    """One study. The default is the heart-failure cohort."""

    rules: dict[str, tuple[CodeRule, ...]] = field(
        default_factory=lambda: {
            "heart_failure": CASE_RULES,
            "secondary_diabetes": COMORBIDITY_RULES,
        }
    )
    case_flag: str = "heart_failure"
    status_flag: str = "secondary_diabetes"
    status_labels: dict[int, str] = field(default_factory=lambda: dict(STATUS_LABELS))
    age_cap: int = AGE_CAP
    age_cuts: tuple[int, ...] = AGE_CUTS
    age_groups: tuple[str, ...] = AGE_GROUPS
    #: where a missing age goes: ``"last_bin"`` or ``"null"``
    null_age: str = "last_bin"
    genders: tuple[str, ...] = GENDERS
    ethnicity_patterns: tuple[tuple[str, str], ...] = ETHNICITY_PATTERNS
    ethnicity_default: str = ETHNICITY_DEFAULT


DEFAULT = CohortConfig()
