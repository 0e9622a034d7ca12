"""The same queries as plain SQL over the given tables, to check results against.

Fixed values: prefixes, patterns, categories, cut-points and titles are those of
``config.py`` and ``plans/report.py``.
"""

from __future__ import annotations

TABLES = """
WITH patients AS (
  SELECT c_custkey AS subject_id,
    CASE WHEN c_custkey % 20 < 9 THEN 'F' WHEN c_custkey % 20 < 19 THEN 'M' ELSE 'U' END AS gender,
    CASE WHEN c_custkey % 97 <> 0
      THEN TIMESTAMP '1895-01-01 00:00:00' + to_days(((c_custkey * 7919) % 36500)::INTEGER) END AS dob
  FROM customer
),
admissions AS (
  SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
    o_orderdate + to_hours((o_orderkey * 7919) % 720 - 12) AS dischtime,
    CASE o_orderkey % 9 WHEN 0 THEN 'WHITE' WHEN 1 THEN 'WHITE - RUSSIAN' WHEN 2 THEN 'White'
      WHEN 3 THEN 'BLACK/AFRICAN AMERICAN' WHEN 4 THEN 'ASIAN - CHINESE' WHEN 5 THEN 'HISPANIC OR LATINO'
      WHEN 6 THEN 'BLACK/HISPANIC' WHEN 7 THEN 'CAUCASIAN' END AS ethnicity,
    o_orderpriority AS admission_type,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS hospital_expire_flag
  FROM orders
),
diagnoses_icd AS (
  SELECT l_orderkey AS hadm_id, l_linenumber AS seq_num,
    CASE l_partkey % 16 WHEN 0 THEN '4280' WHEN 1 THEN '42832' WHEN 2 THEN '24900' WHEN 3 THEN '25000'
      WHEN 4 THEN '25060' WHEN 5 THEN NULL WHEN 6 THEN '41401' ELSE '4019' END AS icd9_code
  FROM lineitem
),
icustays AS (
  SELECT l_orderkey AS hadm_id, o_orderdate + to_hours(l_suppkey % 48) AS intime,
    CASE WHEN l_suppkey % 50 <> 0
      THEN o_orderdate + to_hours(l_suppkey % 48 + l_partkey % 120 - 6) END AS outtime
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R'
),
prescriptions AS (
  SELECT l_orderkey AS hadm_id, p_name AS drug,
    CASE WHEN l_suppkey % 29 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN '1-2'
      ELSE l_quantity::INTEGER::VARCHAR END AS dose_val_rx,
    CASE l_partkey % 5 WHEN 0 THEN 'mL' WHEN 1 THEN 'UNIT' WHEN 2 THEN NULL ELSE 'mg' END AS dose_unit_rx,
    CASE WHEN l_suppkey % 31 <> 0 THEN o_orderdate + to_days((l_linenumber - 1)::INTEGER) END AS startdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

COHORT = TABLES + """,
flags AS (
  SELECT hadm_id,
    max(CASE WHEN icd9_code LIKE '428%' THEN 1 ELSE 0 END) AS heart_failure,
    max(CASE WHEN icd9_code LIKE '249%' OR (icd9_code LIKE '250%' AND seq_num > 1) THEN 1 ELSE 0 END)
      AS secondary_diabetes
  FROM diagnoses_icd
  WHERE icd9_code LIKE '428%' OR icd9_code LIKE '249%' OR (icd9_code LIKE '250%' AND seq_num > 1)
  GROUP BY hadm_id
),
stay_totals AS (
  SELECT hadm_id, CASE WHEN sum(epoch(outtime - intime)) >= 0
    THEN sum(epoch(outtime - intime)) / 86400 END AS icu_los_days
  FROM icustays GROUP BY hadm_id
),
cohort AS (
  SELECT a.subject_id, a.hadm_id,
    coalesce(f.heart_failure, 0)::INTEGER AS heart_failure,
    coalesce(f.secondary_diabetes, 0)::INTEGER AS secondary_diabetes,
    p.gender,
    CASE WHEN extract(YEAR FROM age(a.admittime, p.dob)) > 89 THEN 89
      ELSE extract(YEAR FROM age(a.admittime, p.dob)) END::BIGINT AS age,
    CASE WHEN a.ethnicity ILIKE '%WHITE%' THEN 'White' WHEN a.ethnicity ILIKE '%BLACK%' THEN 'Black'
      WHEN a.ethnicity ILIKE '%ASIAN%' THEN 'Asian' WHEN a.ethnicity ILIKE '%HISPANIC%' THEN 'Hispanic'
      ELSE 'Other/Unknown' END AS ethnicity_group,
    a.admission_type,
    CASE WHEN a.dischtime >= a.admittime
      THEN epoch(a.dischtime - a.admittime) / 86400 END AS hospital_los_days,
    s.icu_los_days, a.hospital_expire_flag::INTEGER AS hospital_expire_flag
  FROM admissions a JOIN patients p ON a.subject_id = p.subject_id
  LEFT JOIN flags f ON a.hadm_id = f.hadm_id
  LEFT JOIN stay_totals s ON a.hadm_id = s.hadm_id
),
labeled AS (
  SELECT * EXCLUDE (gender), CASE WHEN gender IN ('F', 'M') THEN gender END AS gender,
    CASE WHEN age < 18 THEN '0-17' WHEN age < 60 THEN '18-59' ELSE '60+' END AS age_group,
    CASE secondary_diabetes WHEN 0 THEN 'No secondary diabetes' WHEN 1 THEN 'Secondary diabetes' END
      AS diabetes_status
  FROM cohort
),
cases AS (SELECT * FROM labeled WHERE heart_failure = 1),
controls AS (SELECT * FROM labeled WHERE heart_failure = 0),
exposures AS (
  SELECT p.hadm_id, p.drug, p.dose_val_rx, p.dose_unit_rx, p.startdate,
    CASE WHEN EXISTS (SELECT 1 FROM icustays i WHERE i.hadm_id = p.hadm_id
      AND p.startdate BETWEEN i.intime AND i.outtime) THEN 1 ELSE 0 END AS in_icu
  FROM prescriptions p WHERE p.hadm_id IN (SELECT hadm_id FROM cases)
),
doses AS (SELECT *, TRY_CAST(dose_val_rx AS DOUBLE) AS dose FROM exposures),
per_drug AS (
  SELECT drug, count(*) AS n_prescriptions, count(DISTINCT hadm_id) AS n_admissions,
    avg(dose) AS mean_dose, avg(in_icu) AS inside
  FROM doses GROUP BY drug
),
per_unit AS (
  SELECT drug, dose_unit_rx, count(*) AS n, avg(dose) AS mean_dose,
    row_number() OVER (PARTITION BY drug ORDER BY count(*) DESC, dose_unit_rx ASC NULLS LAST) AS place
  FROM doses GROUP BY drug, dose_unit_rx
),
top_5 AS (SELECT drug FROM per_drug ORDER BY n_prescriptions DESC, drug ASC NULLS LAST LIMIT 5)
"""


def _frequency(frame: str, col: str, shown: str | None = None) -> str:
    return f"""SELECT {shown or col}, count(*) AS n,
      round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM {frame}), 1) AS pct
    FROM {frame} GROUP BY {col}"""


def _profile(frame: str, col: str) -> str:
    quartiles = ", ".join(
        f"round(quantile_cont({col}, {p}), 6) AS {name}"
        for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))
    )
    return f"""SELECT round(min({col}), 6) AS min, {quartiles}, round(max({col}), 6) AS max,
      round(avg({col}), 2) AS mean, round(stddev_samp({col}), 2) AS sd, count({col}) AS n,
      count(*) FILTER (WHERE {col} IS NULL) AS n_missing
    FROM {frame}"""


def _missing(frame: str, columns: list[str], only_missing: bool) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
        f"round(100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*), 1) AS pct FROM {frame}"
        for c in columns
    )
    return f"SELECT * FROM ({parts})" + (" WHERE n_missing > 0" if only_missing else "")


def _rate(frame: str) -> str:
    return f"""SELECT sum(hospital_expire_flag)::BIGINT AS n_events, count(*) AS n_total,
      round(100 * avg(hospital_expire_flag), 2) AS pct FROM {frame}"""


def _durations(col: str) -> str:
    return f"""round(min({col}), 6) AS min_{col}, round(max({col}), 6) AS max_{col},
      round(avg({col}), 1) AS mean_{col}, count(*) FILTER (WHERE {col} < 0) AS negative_{col}"""


def _presence(col: str) -> str:
    return f"""count(*) FILTER (WHERE {col} > 0) AS with_{col},
      count(*) FILTER (WHERE {col} IS NULL OR {col} = 0) AS without_{col}"""


_CAP = "min(age) AS min_age, max(age) AS max_age, count(*) FILTER (WHERE age = 89) AS at_cap_age"


def _demographics(frame: str) -> str:
    declared = {
        "age_group": {"0-17": 1, "18-59": 2, "60+": 3},
        "gender": {"F": 1, "M": 2},
        "ethnicity_group": {},
        "admission_type": {},
    }
    groups = {"without": "No secondary diabetes", "with": "Secondary diabetes"}
    blocks = []
    for variable, levels in declared.items():
        whens = " ".join(f"WHEN '{level}' THEN {place}" for level, place in levels.items())
        position = f"(CASE {variable} {whens} END)::INTEGER" if levels else "NULL::INTEGER"
        cells = []
        for suffix, label in groups.items():
            mine = f"diabetes_status = '{label}'"
            n = f"count(*) FILTER (WHERE {mine})"
            known = f"(SELECT count(*) FROM {frame} WHERE {mine} AND {variable} IS NOT NULL)"
            cells.append(
                f"{n} AS n_{suffix}, round(100.0::DOUBLE * {n} / {known}, 1) AS pct_{suffix}, "
                f"(SELECT count(*) FROM {frame} WHERE {mine}) AS total_{suffix}"
            )
        blocks.append(
            f"SELECT '{variable}' AS variable, {variable} AS level, {position} AS position, "
            f"{', '.join(cells)} FROM {frame} WHERE {variable} IS NOT NULL GROUP BY {variable}"
        )
    return " UNION ALL ".join(blocks)


def _outcomes() -> str:
    strata = {
        "Age": "age_group",
        "Gender": "gender",
        "Diabetes status": "diabetes_status",
        "Ethnicity": "ethnicity_group",
    }
    quartiles = ", ".join(
        f"round(quantile_cont({m}, {p}), 6) AS {m}_{q}"
        for m in ("hospital_los_days", "icu_los_days")
        for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))
    )
    return " UNION ALL ".join(
        f"""SELECT '{title}' AS stratifier, {col} AS stratum, count(*) AS n, {quartiles},
          round(100 * avg(hospital_expire_flag), 1) AS hospital_expire_flag_pct
        FROM cases WHERE {col} IS NOT NULL GROUP BY {col}"""
        for title, col in strata.items()
    )


def _present_demographics(frame: str) -> str:
    variables = {
        "age_group": "Age group",
        "gender": "Gender",
        "ethnicity_group": "Ethnicity",
        "admission_type": "Admission type",
    }
    block = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(variables, start=1))
    title = " ".join(f"WHEN '{name}' THEN '{label}'" for name, label in variables.items())
    cells = ", ".join(
        f"""n_{suffix} || ' (' || printf('%.1f', pct_{suffix}) || '%)' AS "{suffix}",
          '**{label}** (N=' || total_{suffix} || ')' AS {suffix}_title"""
        for suffix, label in (("without", "No secondary diabetes"), ("with", "Secondary diabetes"))
    )
    return f"""SELECT (CASE variable {block} END)::INTEGER AS block,
        row_number() OVER (PARTITION BY variable ORDER BY position NULLS LAST, level NULLS LAST)::INTEGER
          AS position,
        CASE variable {title} END AS variable, level, {cells}
      FROM ({_demographics(frame)})"""


def _quartile(values: str, p: float) -> str:
    """Type 7 by position in a sorted list, in the same steps as the library takes them."""
    place = f"({p} * (len({values}) - 1))"
    low, high = f"{values}[floor({place})::INTEGER + 1]", f"{values}[ceil({place})::INTEGER + 1]"
    return f"{low} + ({high} - {low}) * ({place} - floor({place}))"


def _present_outcomes() -> str:
    strata = {
        "Age": ("age_group", ["0-17", "18-59", "60+"]),
        "Gender": ("gender", ["F", "M"]),
        "Diabetes status": ("diabetes_status", ["No secondary diabetes", "Secondary diabetes"]),
        "Ethnicity": ("ethnicity_group", []),
    }
    spread = ", ".join(
        "CASE WHEN len({m}) > 0 THEN printf('%.1f (%.1f–%.1f)', {q}) END AS {m}".format(
            m=m, q=", ".join(_quartile(m, p) for p in (0.5, 0.25, 0.75))
        )
        for m in ("hospital_los", "icu_los")
    )
    parts = []
    for block, (title, (col, levels)) in enumerate(strata.items(), start=1):
        rank = " ".join(f"WHEN '{level}' THEN {i}" for i, level in enumerate(levels))
        order = f"CASE {col} {rank} END NULLS LAST, {col}" if levels else col
        parts.append(
            f"""SELECT {block} AS block, row_number() OVER (ORDER BY {order})::INTEGER AS position,
              '{title}' AS stratifier, {col} AS stratum, {spread}, mortality
            FROM (SELECT {col}, list_sort(list(hospital_los_days) FILTER (hospital_los_days IS NOT NULL)) AS hospital_los,
                list_sort(list(icu_los_days) FILTER (icu_los_days IS NOT NULL)) AS icu_los,
                printf('%.1f', round(100 * avg(hospital_expire_flag), 1)) AS mortality
              FROM cases WHERE {col} IS NOT NULL GROUP BY {col})"""
        )
    return " UNION ALL ".join(parts)


_DRUG = """n_prescriptions, n_admissions, round(mean_dose, 2) AS mean_dose,
  round(100 * inside, 1) AS pct_in_icu, round(n_prescriptions / n_admissions, 2) AS per_admission"""

_TITLE = """array_to_string(list_transform(string_split(d.drug, ' '),
  lambda w: upper(w[1]) || lower(w[2:])), ' ')"""

_COHORT_COLUMNS = [
    "subject_id", "hadm_id", "heart_failure", "secondary_diabetes", "gender", "age", "ethnicity_group",
    "admission_type", "hospital_los_days", "icu_los_days", "hospital_expire_flag",
    "age_group", "diabetes_status",
]

_BODIES: dict[str, str] = {
    "code_flags": "SELECT * FROM flags",
    "interval_totals": "SELECT * FROM stay_totals",
    "cohort": "SELECT * FROM cohort",
    "cohort_labeled": "SELECT * FROM labeled",
    "exposures": "SELECT * FROM exposures",
    "cohort_size": "SELECT count(*) AS total_admissions FROM cohort",
    "case_split": _frequency(
        "cohort",
        "heart_failure",
        "heart_failure, CASE WHEN heart_failure = 1 THEN 'Heart Failure' ELSE 'Non-HF' END AS cohort",
    ),
    "freq_age": _frequency("cases", "age_group"),
    "freq_gender": _frequency("cases", "gender"),
    "freq_ethnicity": _frequency("cases", "ethnicity_group"),
    "freq_admission": _frequency("cases", "admission_type"),
    "freq_status": _frequency("cases", "diabetes_status"),
    "freq_setting": _frequency(
        "exposures", "in_icu", "CASE WHEN in_icu = 1 THEN 'In ICU' ELSE 'Not in ICU' END AS location"
    ),
    "los_profile": _profile("cases", "hospital_los_days"),
    "los_profile_all": _profile("labeled", "hospital_los_days"),
    "icu_profile": _profile("cases", "icu_los_days"),
    "missing_cohort": _missing("labeled", _COHORT_COLUMNS, True),
    "missing_exposures": _missing(
        "(SELECT *, dose AS dose_value FROM doses)",
        ["dose_val_rx", "dose_value", "dose_unit_rx", "startdate"],
        False,
    ),
    "mortality": _rate("cases"),
    "mortality_all": _rate("labeled"),
    "los_checks": f"SELECT {_durations('hospital_los_days')} FROM cohort",
    "icu_checks": f"SELECT {_presence('icu_los_days')} FROM cohort",
    "age_checks": f"SELECT {_CAP} FROM cases",
    "range_checks": "SELECT "
    + ", ".join(f"{_durations(c)}, {_presence(c)}" for c in ("hospital_los_days", "icu_los_days"))
    + f", {_CAP} FROM cases",
    "exposure_overview": """SELECT count(*) AS total_prescriptions,
      count(DISTINCT hadm_id) AS n_admissions, count(DISTINCT drug) AS n_unique_drugs FROM exposures""",
    "demographics_cases": _demographics("cases"),
    "demographics_controls": _demographics("controls"),
    "outcomes_stratified": _outcomes(),
    "frozen_outcomes": _outcomes(),
    "outcomes_by_age": """SELECT age_group, count(*) AS n,
      round(median(hospital_los_days), 1) AS median_los, round(median(icu_los_days), 1) AS median_icu,
      round(100 * avg(hospital_expire_flag), 1) AS mortality_pct
    FROM cases GROUP BY age_group""",
    "top_exposures_report": f"""SELECT {_TITLE} AS drug, d.n_prescriptions, d.n_admissions,
      round(d.mean_dose, 2) AS mean_dose, round(u.mean_dose, 2) AS mean_dose_dominant_unit,
      round(100 * d.inside, 1) AS pct_in_icu,
      round(d.n_prescriptions / d.n_admissions, 2) AS per_admission,
      upper(u.dose_unit_rx) AS dominant_unit
    FROM per_drug d JOIN top_5 t ON d.drug IS NOT DISTINCT FROM t.drug
    LEFT JOIN per_unit u ON d.drug IS NOT DISTINCT FROM u.drug AND u.place = 1""",
    "top_exposures": f"""SELECT drug, {_DRUG},
      round(100.0::DOUBLE * n_prescriptions / (SELECT count(*) FROM exposures), 1) AS pct_of_total
    FROM per_drug ORDER BY n_prescriptions DESC, drug ASC NULLS LAST LIMIT 10""",
    "dominant_unit": "SELECT drug, dose_unit_rx, n FROM per_unit WHERE place = 1",
    "exposure_detail": """SELECT d.drug, n_prescriptions, n_admissions,
      round(100 * inside, 1) AS pct_in_icu, round(n_prescriptions / n_admissions, 2) AS per_admission
    FROM per_drug d JOIN top_5 t ON d.drug IS NOT DISTINCT FROM t.drug""",
    "dose_by_unit": """SELECT d.drug, dose_unit_rx, count(*) AS n, round(avg(dose), 2) AS mean_dose,
      round(median(dose), 2) AS median_dose
    FROM doses d JOIN top_5 t ON d.drug IS NOT DISTINCT FROM t.drug
    WHERE dose IS NOT NULL GROUP BY d.drug, dose_unit_rx""",
    "dose_units_used": """SELECT u.drug, u.dose_unit_rx, u.n, round(u.mean_dose, 2) AS mean_dose
    FROM per_unit u JOIN per_drug d ON u.drug IS NOT DISTINCT FROM d.drug
    JOIN top_5 t ON d.drug IS NOT DISTINCT FROM t.drug WHERE d.mean_dose IS NOT NULL""",
    "setting_split": """SELECT e.drug, count(*) FILTER (WHERE in_icu = 1) AS in_icu,
      count(*) FILTER (WHERE in_icu = 0) AS not_in_icu, round(100 * avg(in_icu), 1) AS in_icu_pct
    FROM exposures e JOIN top_5 t ON e.drug IS NOT DISTINCT FROM t.drug GROUP BY e.drug""",
}

_BODIES |= {
    "present_demographics_cases": _present_demographics("cases"),
    "present_demographics_controls": _present_demographics("controls"),
    "present_outcomes": _present_outcomes(),
    "present_exposures": f"""SELECT row_number() OVER (ORDER BY n_prescriptions DESC, drug NULLS LAST)::INTEGER AS position,
      drug, n_prescriptions, mean_dose, pct_in_icu, per_admission, dominant_unit
    FROM ({_BODIES["top_exposures_report"]})""",
    "view_checks": """SELECT unnest([
        'total_admissions', 'case_admissions', 'case_pct', 'min_los', 'max_los', 'mean_los',
        'negative_los', 'with_icu', 'without_icu']) AS check_name,
      unnest([count(*)::DOUBLE, count(*) FILTER (heart_failure = 1),
        round(100.0::DOUBLE * count(*) FILTER (heart_failure = 1) / count(*), 1),
        round(min(hospital_los_days), 6), round(max(hospital_los_days), 6), round(avg(hospital_los_days), 1),
        count(*) FILTER (hospital_los_days < 0), count(*) FILTER (icu_los_days > 0),
        count(*) FILTER (icu_los_days IS NULL OR icu_los_days = 0)]) AS value
    FROM cohort
    UNION ALL
    SELECT unnest(['cases_view', 'case_patients']), unnest([count(*)::DOUBLE, count(DISTINCT subject_id)]) FROM cases
    UNION ALL
    SELECT unnest(['prescriptions', 'prescribed_admissions', 'unique_drugs']),
      unnest([count(*)::DOUBLE, count(DISTINCT hadm_id), count(DISTINCT drug)])
    FROM exposures""",
}

ORACLES: dict[str, str] = {name: COHORT + body for name, body in _BODIES.items()}
