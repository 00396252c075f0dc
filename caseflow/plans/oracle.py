"""The same queries as plain SQL for an independent engine; each text repeats the mapping it needs."""

from __future__ import annotations

# --- the mapping, as common table expressions ---------------------------------------------------------

_CASE = "user_id*10+CAST(floor((day(ts)-1)/5) AS BIGINT)"
_CTE = {
    "transfers": f"""SELECT {_CASE} AS hadm_id, user_id AS subject_id, event_id, event_type AS careunit,
        CASE WHEN row_number() OVER w = 1 THEN 'admit' WHEN event_id % 17 = 0 THEN 'discharge' ELSE 'transfer' END AS eventtype,
        ts AS intime, lead(ts) OVER w AS outtime
        FROM events WINDOW w AS (PARTITION BY {_CASE} ORDER BY ts, event_id)""",
    "stays": """SELECT hadm_id, min(subject_id) AS subject_id, min(intime) AS admittime, max(intime) AS dischtime
        FROM transfers GROUP BY hadm_id""",
    "tiers": "SELECT * FROM (VALUES ('ICU','purchase'),('SW','click')) t(cohort, unit)",
    "moves": "SELECT * FROM transfers WHERE eventtype IS DISTINCT FROM 'discharge'",
    "log_all": """SELECT hadm_id AS case_id, admittime AS event_time, 'Hospital Admission' AS activity, CAST(-1 AS BIGINT) AS tie FROM stays
        UNION ALL SELECT hadm_id, intime, CASE eventtype WHEN 'admit' THEN 'Admission to ' WHEN 'transfer' THEN 'Transfer to ' END ||
        CASE careunit WHEN 'purchase' THEN 'ICU' WHEN 'click' THEN 'Surgery Ward' WHEN 'signup' THEN 'Stepdown' WHEN 'view' THEN 'Stepdown'
        WHEN 'error' THEN 'Medical Ward' END, event_id FROM transfers WHERE eventtype <> 'discharge'""",
    "log": "SELECT * FROM log_all WHERE activity IS NOT NULL AND event_time IS NOT NULL",
    "points": """SELECT cohort, hadm_id, outtime AS prediction_point FROM (SELECT cohort, t.*, row_number() OVER
        (PARTITION BY cohort, hadm_id ORDER BY intime, event_id) AS rn FROM transfers t JOIN tiers ON careunit = unit) WHERE rn = 1""",
    "prefix": """SELECT p.cohort, l.* FROM log l JOIN points p ON l.case_id = p.hadm_id WHERE l.event_time < p.prediction_point""",
    "collapsed": """SELECT hadm_id, min(careunit) AS careunit, arg_min(event_id, (intime, event_id)) AS event_id, min(intime) AS intime,
        max(outtime) AS outtime FROM (SELECT *, sum(CASE WHEN careunit = before THEN 0 ELSE 1 END) OVER (PARTITION BY hadm_id
        ORDER BY intime, event_id) AS island FROM (SELECT *, lag(careunit) OVER (PARTITION BY hadm_id ORDER BY intime, event_id) AS before
        FROM moves)) GROUP BY hadm_id, island""",
    "admissions": """SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS admittime,
        o_orderdate + to_days(CAST(o_orderkey % 10 AS INT)) AS dischtime, o_orderpriority AS admission_type,
        nullif(o_orderstatus,'P') AS admission_location, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS insurance,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE n_name END AS race,
        CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS marital_status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "patients": """SELECT c_custkey AS subject_id, CAST(18 + c_custkey % 80 AS INT) AS anchor_age,
        CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM customer""",
    "labevents": "SELECT l_orderkey AS hadm_id, CASE WHEN l_returnflag = 'R' THEN 'abnormal' END AS flag FROM lineitem",
    "diagnoses": """SELECT l_orderkey AS hadm_id, CASE WHEN l_linestatus = 'O' THEN 10 ELSE 9 END AS v,
        CASE WHEN l_linestatus = 'O' THEN concat(chr(CAST(65 + l_partkey % 26 AS INT)), lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0'))
        WHEN l_partkey % 50 = 0 THEN concat('V', lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0'))
        ELSE lpad(CAST(l_partkey * 7 % 1000 AS VARCHAR), 3, '0') END AS code FROM lineitem""",
    "prescriptions": "SELECT l_orderkey AS hadm_id, p_name AS drug FROM lineitem JOIN part ON l_partkey = p_partkey",
    "omr": """SELECT user_id AS subject_id, event_id, CAST(ts AS DATE) AS chartdate, CASE WHEN event_type IN ('view','click')
        THEN 'BMI (kg/m2)' ELSE 'Weight (Lbs)' END AS result_name, CASE WHEN event_id % 11 = 0 THEN 'n/a'
        ELSE CAST(CAST(floor(value) AS INT) % 60 AS VARCHAR) END AS result_value FROM events""",
    "demo": """SELECT a.hadm_id, a.subject_id, CASE WHEN anchor_age BETWEEN 18 AND 27 THEN '18-27' WHEN anchor_age BETWEEN 28 AND 37 THEN '28-37'
        WHEN anchor_age BETWEEN 38 AND 47 THEN '38-47' WHEN anchor_age BETWEEN 48 AND 57 THEN '48-57' WHEN anchor_age BETWEEN 58 AND 67
        THEN '58-67' WHEN anchor_age BETWEEN 68 AND 77 THEN '68-77' WHEN anchor_age BETWEEN 78 AND 87 THEN '78-87' ELSE '88+' END AS age_band,
        gender, CASE WHEN insurance IN ('AUTOMOBILE','BUILDING','MACHINERY') THEN insurance ELSE 'Other' END AS insurance,
        CASE WHEN race ILIKE '%nation_1%' OR race ILIKE '%nation_20%' THEN 'WHITE' WHEN race ILIKE '%nation_2%' THEN 'BLACK'
        WHEN race ILIKE '%nation_3%' OR race ILIKE '%nation_4%' THEN 'HISPANIC/LATINO' WHEN race ILIKE '%nation_5%' THEN 'ASIAN'
        WHEN race ILIKE '%nation_6%' THEN 'NATIVE' WHEN race ILIKE '%nation_7%' THEN 'MULTIPLE' WHEN race IS NULL OR race ILIKE '%nation_8%'
        THEN 'UNKNOWN' ELSE 'OTHER' END AS ethnicity, coalesce(marital_status,'UNKNOWN') AS marital_status
        FROM admissions a JOIN patients p ON a.subject_id = p.subject_id""",
    "labs": """SELECT hadm_id, count(*) AS total_labs, count(*) FILTER (flag = 'abnormal') AS abnormal_count,
        round(100.0 * count(*) FILTER (flag = 'abnormal') / count(*), 2)::DOUBLE AS pct_abnormal_labs FROM labevents GROUP BY hadm_id""",
    "drugs": "SELECT hadm_id, count(DISTINCT drug) AS num_medications FROM prescriptions GROUP BY hadm_id",
    "diag_n": "SELECT hadm_id, count(*) AS num_diagnoses FROM diagnoses GROUP BY hadm_id",
    "clinical": """SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, coalesce(total_labs,0) AS total_labs,
        coalesce(abnormal_count,0) AS abnormal_count, coalesce(pct_abnormal_labs,0) AS pct_abnormal_labs,
        coalesce(num_diagnoses,0) AS num_diagnoses, coalesce(num_medications,0) AS num_medications,
        CASE WHEN num_medications >= 5 THEN 1 ELSE 0 END AS polypharmacy
        FROM orders LEFT JOIN labs ON o_orderkey = labs.hadm_id LEFT JOIN diag_n ON o_orderkey = diag_n.hadm_id
        LEFT JOIN drugs ON o_orderkey = drugs.hadm_id""",
    "typed": """SELECT *, CASE WHEN admission_type IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS em FROM admissions""",
    "flagged": """SELECT hadm_id, subject_id, admittime, CASE WHEN em = 1 THEN 'emergency' ELSE 'elective' END AS admission_type,
        CASE WHEN lead(em) OVER w = 1 AND epoch_us(lead(admittime) OVER w) - epoch_us(dischtime) <= 30*86400*1000000::BIGINT THEN 1 ELSE 0 END
        AS was_followed_by_uhr FROM typed WINDOW w AS (PARTITION BY subject_id ORDER BY admittime, hadm_id)""",
    "uhr": """SELECT a.hadm_id, a.subject_id, a.admission_type, count(p.hadm_id) FILTER (p.was_followed_by_uhr = 1) AS uhr_count
        FROM flagged a LEFT JOIN flagged p ON a.subject_id = p.subject_id AND p.admittime < a.admittime GROUP BY ALL""",
    "valid_bmi": """SELECT subject_id, event_id, chartdate, CAST(result_value AS DOUBLE) AS bmi FROM omr WHERE result_name = 'BMI (kg/m2)'
        AND regexp_matches(result_value, '^[0-9]+\\.?[0-9]*$') AND TRY_CAST(result_value AS DOUBLE) BETWEEN 10 AND 100""",
    "chapters": """SELECT hadm_id, CASE WHEN v = 9 AND regexp_matches(code, '^[0-9]{3}') THEN CASE WHEN n BETWEEN 1 AND 139 THEN 1
        WHEN n BETWEEN 140 AND 239 THEN 2 WHEN n BETWEEN 240 AND 279 THEN 3 WHEN n BETWEEN 280 AND 289 THEN 4 WHEN n BETWEEN 290 AND 319 THEN 5
        WHEN n BETWEEN 320 AND 389 THEN 6 WHEN n BETWEEN 390 AND 459 THEN 7 WHEN n BETWEEN 460 AND 519 THEN 8 WHEN n BETWEEN 520 AND 579 THEN 9
        WHEN n BETWEEN 580 AND 629 THEN 10 WHEN n BETWEEN 630 AND 679 THEN 11 WHEN n BETWEEN 680 AND 709 THEN 12 WHEN n BETWEEN 710 AND 739
        THEN 13 WHEN n BETWEEN 740 AND 759 THEN 14 WHEN n BETWEEN 760 AND 779 THEN 15 WHEN n BETWEEN 780 AND 799 THEN 16
        WHEN n BETWEEN 800 AND 999 THEN 17 END WHEN v = 9 AND regexp_matches(code, '^[VvEe]') THEN 18 WHEN v = 10 THEN
        CASE WHEN regexp_matches(code,'^[AB]') THEN 1 WHEN regexp_matches(code,'^(C|D[0-4])') THEN 2 WHEN regexp_matches(code,'^D[5-8]') THEN 4
        WHEN code[1] = 'E' THEN 3 WHEN code[1] = 'F' THEN 5 WHEN code[1] IN ('G','H') THEN 6 WHEN code[1] = 'I' THEN 7 WHEN code[1] = 'J' THEN 8
        WHEN code[1] = 'K' THEN 9 WHEN code[1] = 'N' THEN 10 WHEN code[1] = 'O' THEN 11 WHEN code[1] = 'L' THEN 12 WHEN code[1] = 'M' THEN 13
        WHEN code[1] = 'Q' THEN 14 WHEN code[1] = 'P' THEN 15 WHEN code[1] = 'R' THEN 16 WHEN code[1] IN ('S','T') THEN 17
        WHEN regexp_matches(code,'^[UVWXYZ]') THEN 18 END END AS chapter
        FROM (SELECT *, TRY_CAST(substring(code,1,3) AS INT) AS n FROM diagnoses)""",
    "charlson_map": """SELECT * FROM (VALUES (9,'41','mi',1),(9,'410','mi',1),(9,'25','dm',1),(10,'E1','dm',1),(10,'C','cancer',2),
        (10,'C7','mets',3),(9,'V','misc',2)) t(v, p, condition, weight)""",
    "charlson": """SELECT hadm_id, CAST(sum(weight) AS BIGINT) AS charlson_score FROM (SELECT DISTINCT hadm_id, condition, weight FROM diagnoses d
        JOIN charlson_map m ON d.v = m.v AND left(d.code, length(m.p)) = m.p) GROUP BY hadm_id""",
    "chronic": """SELECT hadm_id, count(*) AS chronic_disease_count FROM diagnoses WHERE (v = 9 AND code IN ('250','420','V01'))
        OR (v = 10 AND code IN ('A01','K05','E03')) GROUP BY hadm_id""",
    "capped": """SELECT p.cohort, t.hadm_id, careunit, greatest(0, (epoch_us(least(outtime, prediction_point)) - epoch_us(intime)) / 3600000000.0::DOUBLE) AS h
        FROM transfers t JOIN points p USING (hadm_id) WHERE prediction_point IS NOT NULL AND intime < prediction_point AND outtime IS NOT NULL""",
    "process": """SELECT p.cohort, p.hadm_id, round(coalesce(sum(h),0),6) AS accumulated_duration_hrs,
        round(coalesce(sum(CASE WHEN careunit = 'purchase' THEN h ELSE 0 END),0),6) AS icu_duration_hrs,
        round(coalesce(sum(CASE WHEN careunit = 'click' THEN h ELSE 0 END),0),6) AS sw_duration_hrs,
        count(*) FILTER (careunit = 'purchase') AS num_icu_stays, count(*) FILTER (careunit = 'click') AS num_sw_stays, count(c.h) AS total_events
        FROM points p LEFT JOIN capped c ON p.cohort = c.cohort AND p.hadm_id = c.hadm_id GROUP BY p.cohort, p.hadm_id""",
    "profile": """SELECT careunit, count(*) AS n_rows, count(DISTINCT hadm_id) AS n_admissions,
        round(100.0 * count(*) FILTER (h < 4) / nullif(count(h),0), 2)::DOUBLE AS pct_under_4h, round(median(h),2) AS median_hours
        FROM (SELECT *, (epoch_us(outtime) - epoch_us(intime)) / 3600000000.0::DOUBLE AS h FROM transfers) GROUP BY careunit""",
    "labelled": "SELECT *, CAST(floor(hadm_id / 10) AS BIGINT) AS subject_id FROM frame",
    "grams": """SELECT cohort, hadm_id, unnest([w0, w0 || ' ' || w1, w0 || ' ' || w1 || ' ' || w2]) AS ngram FROM (SELECT cohort, case_id AS hadm_id,
        w AS w0, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM (SELECT *, lower(replace(activity,' ','_')) AS w FROM prefix)
        WINDOW o AS (PARTITION BY cohort, case_id ORDER BY event_time, tie))""",
    "seqs": """SELECT cohort, hadm_id, array_to_string(list_concat(list_resize([]::INT[], 30 - len(s), 0), s), ',') AS seq,
        array_to_string(list_resize(s, 30, 0), ',') AS seq_right, CAST(len(s) AS INT) AS n_tokens FROM (
        SELECT cohort, case_id AS hadm_id, list(token ORDER BY event_time, tie) AS s FROM (SELECT *, CASE activity WHEN 'Hospital Admission' THEN 1
        WHEN 'Admission to Medical Ward' THEN 3 WHEN 'Admission to ICU' THEN 4 WHEN 'Admission to Surgery Ward' THEN 5 WHEN 'Admission to Stepdown' THEN 6
        WHEN 'Transfer to Medical Ward' THEN 7 WHEN 'Transfer to ICU' THEN 8 WHEN 'Transfer to Surgery Ward' THEN 9 WHEN 'Transfer to Stepdown' THEN 10 END
        AS token, row_number() OVER (PARTITION BY cohort, case_id ORDER BY event_time DESC, tie DESC) AS r FROM prefix) WHERE r <= 30 GROUP BY ALL)""",
    "counts": "SELECT cohort, hadm_id, ngram, count(*) AS n FROM grams WHERE ngram IS NOT NULL GROUP BY ALL",
    "vocab": """SELECT cohort, ngram, count(*) AS df FROM counts JOIN split USING (cohort, hadm_id) WHERE part = 'train'
        GROUP BY ALL HAVING count(*) >= 2""",
    "case_values": f"""SELECT {_CASE} AS hadm_id, round(least(1.0, avg(value)/60),2) AS score, count(*) AS n_events, avg(value) AS mean_value,
        max(value) AS max_value, arg_min(event_type, (ts, event_id)) AS first_unit, arg_max(event_type, (ts, event_id)) AS last_unit
        FROM events GROUP BY 1""",
    "scored": "SELECT cohort, c.*, left_lat AS label FROM frame JOIN case_values c USING (hadm_id)",
    "tagged": """SELECT *, CASE WHEN label = 1 THEN CASE WHEN score >= 0.55 THEN 'TP' ELSE 'FN' END
        ELSE CASE WHEN score >= 0.55 THEN 'FP' ELSE 'TN' END END AS tag FROM scored""",
    "curve": """SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY cohort) AS p, sum(neg) OVER (PARTITION BY cohort) AS q
        FROM (SELECT cohort, score, count(*) FILTER (label = 1)::DOUBLE AS pos, count(*) FILTER (label <> 1)::DOUBLE AS neg FROM scored GROUP BY ALL)
        WINDOW w AS (PARTITION BY cohort ORDER BY score DESC)""",
    "sweep": """SELECT cohort, i AS step, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label <> 1 AND score >= t) AS fp,
        count(*) FILTER (label = 1 AND score < t) AS fn, count(*) FILTER (label <> 1 AND score < t) AS tn, any_value(t) AS t
        FROM scored, (SELECT i::INT AS i, 0.05::DOUBLE + 0.01::DOUBLE * i AS t FROM range(91) r(i)) GROUP BY cohort, i""",
    "results": """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'GB' WHEN '2-HIGH' THEN 'RF' WHEN '3-MEDIUM' THEN 'MLP' WHEN '4-NOT SPECIFIED' THEN 'LSTM'
        WHEN '5-LOW' THEN 'CNN' END AS Model, CASE WHEN o_orderstatus = 'O' THEN 'ICU' ELSE 'SW' END AS Cohort,
        CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED','5-LOW') THEN CASE WHEN o_custkey % 2 = 0 THEN 'Sequence Only' ELSE 'Sequence + Tabular' END
        ELSE CASE WHEN o_custkey % 2 = 0 THEN 'No Process' ELSE 'With Process' END END AS Condition,
        CASE WHEN year(o_orderdate) % 2 = 0 THEN 'lat' ELSE 'old' END AS Variant, CAST(o_orderkey % 5 AS INT) AS Seed,
        round(avg(o_totalprice)/600000, 4) AS AUROC, round(max(o_totalprice)/1000000, 4) AS AUPRC, round(min(o_totalprice)/1000000, 4) AS F1,
        round(count(*)/8, 3) AS Train_Time_s FROM orders GROUP BY 1,2,3,4,5""",
    "deep_means": """SELECT Variant, Cohort, Model, avg(AUROC) AS mean FROM results WHERE Model IN ('LSTM','CNN') AND Condition = 'Sequence + Tabular'
        GROUP BY ALL""",
    "cells": """SELECT Variant, Cohort, Condition, Model, avg(AUROC) AS mean, stddev_samp(AUROC) AS sd FROM results GROUP BY ALL""",
    "neural": """SELECT * FROM results WHERE (Model IN ('LSTM','CNN') AND Condition = 'Sequence + Tabular')
        OR (Model = 'MLP' AND Condition = 'With Process')""",
    "onward": """SELECT cohort, hadm_id, t0, max(CASE WHEN NOT in_tier AND intime >= t0 THEN 1 ELSE 0 END) AS onward FROM (SELECT *,
        min(CASE WHEN in_tier THEN outtime END) OVER (PARTITION BY cohort, hadm_id) AS t0, bool_or(in_tier) OVER (PARTITION BY cohort, hadm_id) AS member
        FROM (SELECT cohort, hadm_id, island, bool_or(in_tier) AS in_tier, min(intime) AS intime, max(outtime) AS outtime FROM (
        SELECT *, sum(CASE WHEN in_tier = before THEN 0 ELSE 1 END) OVER (PARTITION BY cohort, hadm_id ORDER BY intime, event_id) AS island FROM (
        SELECT *, lag(in_tier) OVER (PARTITION BY cohort, hadm_id ORDER BY intime, event_id) AS before FROM (
        SELECT cohort, m.*, careunit IS NOT DISTINCT FROM unit AS in_tier FROM moves m, tiers)))
        GROUP BY ALL)) WHERE member GROUP BY ALL""",
}


def _dealt(test: int, val: int) -> str:
    return (
        f"CASE WHEN (rn-1) % {test} = 0 THEN 'test' WHEN ((rn-1) - CAST(floor((rn-1)/{test}) AS BIGINT) - 1) % {val} = 0 THEN 'val' "
        "ELSE 'train' END"
    )


def _grouped(cases: str) -> str:
    return f"""SELECT c.cohort, hadm_id, c.subject_id, left_lat, part FROM {cases} c JOIN (SELECT cohort, subject_id, {_dealt(5, 9)} AS part FROM (
        SELECT *, row_number() OVER (PARTITION BY cohort, stratum ORDER BY md5(subject_id || ':42'), subject_id) AS rn FROM (
        SELECT cohort, subject_id, max(left_lat) AS stratum FROM {cases} GROUP BY ALL))) s ON c.cohort = s.cohort AND c.subject_id = s.subject_id"""


def _frame(source: str, keys: str = "hadm_id") -> str:
    """The return frame by joins, for a transfer table."""
    k = ", ".join(f"{{0}}.{c.strip()}" for c in keys.split(","))
    return f"""WITH tr AS (SELECT cohort, s.* FROM {source} s JOIN tiers ON careunit = unit),
        f AS (SELECT cohort, {keys}, min(outtime) AS t0, min(intime) AS first_in FROM tr GROUP BY cohort, {keys}),
        b AS (SELECT cohort, {keys}, min(intime) AS t_return FROM tr JOIN f USING (cohort, {keys}) WHERE intime > t0 GROUP BY cohort, {keys}),
        g AS (SELECT f.cohort, {k.format('f')}, bool_or(careunit IS DISTINCT FROM unit) AS outside, bool_or(coalesce(careunit = 'purchase', false)) AS via_critical,
        bool_or(coalesce(careunit = 'signup', false)) AS via_intermediate, bool_or(coalesce(careunit = 'view', false)) AS via_pacu
        FROM {source} s JOIN f USING ({keys}) JOIN b ON b.cohort = f.cohort AND ({k.format('b')}) = ({k.format('f')}) JOIN tiers t ON t.cohort = f.cohort
        WHERE intime >= t0 AND intime < t_return GROUP BY f.cohort, {k.format('f')}),
        j AS (SELECT *, CASE WHEN t_return IS NULL THEN 'no_return' WHEN via_critical THEN 'via_critical' WHEN via_intermediate THEN 'via_intermediate'
        WHEN via_pacu THEN 'via_pacu' ELSE 'via_ward' END AS route FROM f LEFT JOIN b USING (cohort, {keys}) LEFT JOIN g USING (cohort, {keys}))
        SELECT *, (t_return IS NOT NULL)::INT AS returned, (t_return IS NOT NULL)::INT AS left_old,
        (t_return IS NOT NULL AND coalesce(outside, false))::INT AS left_lat, (route = 'via_ward')::INT AS left_corr,
        (route IN ('via_ward','via_pacu'))::INT AS left_corrpacu FROM j"""


_CTE["frame"] = _frame("moves")
_CTE["flat"] = _frame("collapsed")
_CTE["split_cases"] = """SELECT cohort, hadm_id, subject_id, left_lat FROM labelled l WHERE EXISTS
    (SELECT 1 FROM prefix p WHERE p.cohort = l.cohort AND p.case_id = l.hadm_id)"""
_CTE["split"] = _grouped("split_cases")
_CTE["split_loose"] = f"""SELECT cohort, hadm_id, subject_id, left_lat, {_dealt(5, 10)} AS part FROM (SELECT *, row_number() OVER
    (PARTITION BY cohort, left_lat ORDER BY md5(hadm_id || ':42'), hadm_id) AS rn FROM labelled)"""
_CTE["dwell_in"] = """SELECT h::DOUBLE AS min_dwell_h, c.* FROM collapsed c, (VALUES (0),(1),(4),(12),(24)) g(h)
    WHERE h <= 0 OR (epoch_us(outtime) - epoch_us(intime)) / 3600000000.0 >= h"""
_CTE["dwell_flat"] = """SELECT min_dwell_h, hadm_id, min(careunit) AS careunit, min(intime) AS intime, max(outtime) AS outtime FROM (
    SELECT *, sum(CASE WHEN careunit = before THEN 0 ELSE 1 END) OVER (PARTITION BY min_dwell_h, hadm_id ORDER BY intime, event_id) AS island FROM (
    SELECT *, lag(careunit) OVER (PARTITION BY min_dwell_h, hadm_id ORDER BY intime, event_id) AS before FROM dwell_in)) GROUP BY min_dwell_h, hadm_id, island"""
_CTE["dwell_frame"] = _frame("dwell_flat", "min_dwell_h, hadm_id")
_CTE["bmi"] = """SELECT hadm_id, subject_id, bmi_value, CASE WHEN bmi_value < 18.5 THEN 'Underweight' WHEN bmi_value BETWEEN 18.5 AND 24.9 THEN 'Normal'
    WHEN bmi_value BETWEEN 25.0 AND 29.9 THEN 'Overweight' WHEN bmi_value >= 30.0 THEN 'Obese' ELSE 'Unknown' END AS bmi_category FROM (
    SELECT a.hadm_id, a.subject_id, b.bmi AS bmi_value, row_number() OVER (PARTITION BY a.hadm_id
    ORDER BY abs(epoch_us(CAST(b.chartdate AS TIMESTAMP)) - epoch_us(a.admittime)), b.event_id) AS rn
    FROM {cases} a LEFT JOIN valid_bmi b ON a.subject_id = b.subject_id) WHERE rn = 1"""
_CHAPTERS = (
    "infectious neoplasms endocrine blood mental nervous circulatory respiratory digestive genitourinary pregnancy skin "
    "musculoskeletal congenital perinatal symptoms injury supplementary"
).split()
_CHAPTER_COUNTS = ", ".join(
    f"count(*) FILTER (chapter = {i}) AS icd_ch{i}_{name}" for i, name in enumerate(_CHAPTERS, start=1)
)
_CTE["bmi_stays"] = _CTE["bmi"].format(cases="stays")
_CTE["bmi_orders"] = _CTE.pop("bmi").format(cases="admissions")
_CTE["matrix"] = f"""SELECT l.cohort, l.hadm_id, l.subject_id, l.left_lat AS left_shift, age_band, gender, insurance, ethnicity, marital_status,
    uhr_count, CASE WHEN ed.case_id IS NULL THEN 0 ELSE 1 END AS ed_admission, u.admission_type, bmi_category, pct_abnormal_labs, num_medications,
    polypharmacy, {', '.join(f'coalesce(icd_ch{i}_{n}, 0) AS icd_ch{i}_{n}' for i, n in enumerate(_CHAPTERS, start=1))},
    coalesce(charlson_score, 0) AS charlson_score, coalesce(chronic_disease_count, 0) AS chronic_disease_count,
    CASE WHEN o.o_orderkey IS NOT NULL THEN coalesce(nullif(o.o_orderstatus,'P'), 'INFORMATION NOT AVAILABLE') END AS admission_location,
    accumulated_duration_hrs, icu_duration_hrs, sw_duration_hrs, num_icu_stays, num_sw_stays, total_events
    FROM labelled l LEFT JOIN demo d ON l.hadm_id = d.hadm_id LEFT JOIN uhr u ON l.hadm_id = u.hadm_id
    LEFT JOIN bmi_orders bo ON l.hadm_id = bo.hadm_id LEFT JOIN clinical c ON l.hadm_id = c.hadm_id
    LEFT JOIN (SELECT DISTINCT case_id FROM log WHERE activity = 'Admission to Medical Ward') ed ON l.hadm_id = ed.case_id
    LEFT JOIN (SELECT hadm_id, {_CHAPTER_COUNTS} FROM chapters GROUP BY hadm_id) i ON l.hadm_id = i.hadm_id
    LEFT JOIN charlson ch ON l.hadm_id = ch.hadm_id LEFT JOIN chronic cr ON l.hadm_id = cr.hadm_id
    LEFT JOIN orders o ON l.hadm_id = o.o_orderkey LEFT JOIN process p ON l.cohort = p.cohort AND l.hadm_id = p.hadm_id"""


def _needs(text: str) -> set[str]:
    words = set("".join(ch if ch.isalnum() or ch == "_" else " " for ch in text).split())
    return {name for name in _CTE if name in words}


def add_cte(name: str, body: str) -> None:
    """A further table expression for queries registered elsewhere."""
    _CTE[name] = body


def sql(body: str) -> str:
    """Prepend the common table expressions a query mentions, directly or through others, in order of need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in sorted(_needs(_CTE[name]) - {name}):
            if other not in ordered:
                visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in sorted(_needs(body)):
        visit(name)
    return "WITH " + ", ".join(f"{n} AS ({_CTE[n]})" for n in ordered) + " " + body if ordered else body


_COUNTS = "count(*) AS n"
_TAGS = ", ".join(f"count(*) FILTER (tag = '{t}') AS {t}" for t in ("TP", "FN", "FP", "TN"))
_FEATURES = "(VALUES ('n_events'),('mean_value'),('max_value')) x(feature)"
_VALUE = "CASE feature WHEN 'n_events' THEN n_events::DOUBLE WHEN 'mean_value' THEN mean_value ELSE max_value END"
_GROUP_MEANS = f"""SELECT cohort, feature, {', '.join(f"avg({_VALUE}) FILTER (tag = '{t}') AS {t}" for t in ('TP', 'FN', 'FP', 'TN'))}
    FROM tagged, {_FEATURES} GROUP BY ALL"""
_DIGEST = ", ".join(
    f"""'{p}:' || coalesce(max(n) FILTER (part = '{p}'), 0) || ':' || coalesce(max(d) FILTER (part = '{p}'), 0)""" for p in ("train", "val", "test")
)
_LOOSE_CHECK = """SELECT cohort, '{name}' AS "check", count(*) FILTER (k > 1) AS n_bad FROM (SELECT cohort, {key}, count(DISTINCT part) AS k
    FROM split_loose GROUP BY ALL) GROUP BY cohort"""
_COVER = """SELECT cohort, '{name}' AS "check", count(*) FILTER ({side} IS NULL) AS n_bad FROM (SELECT DISTINCT cohort, hadm_id, 1 AS s FROM split_loose) a
    FULL JOIN (SELECT DISTINCT cohort, hadm_id, 1 AS c FROM split) b USING (cohort, hadm_id) GROUP BY cohort"""

_BODIES = {
    "event_log": "SELECT * FROM log_all",
    "raw_event_log": """SELECT hadm_id AS case_id, admittime AS event_time, 'Hospital Admission' AS activity FROM stays
        UNION ALL SELECT hadm_id, dischtime, 'Hospital Discharge' FROM stays
        UNION ALL SELECT hadm_id, intime, 'ICU Admission' FROM transfers WHERE careunit = 'purchase'
        UNION ALL SELECT hadm_id, outtime, 'ICU Discharge' FROM transfers WHERE careunit = 'purchase'""",
    "clean_log": """SELECT case_id AS "Case ID", activity AS "Activity", strftime(event_time, '%Y-%m-%d %H:%M:%S') AS "Timestamp" FROM log""",
    "cleaning_report": """SELECT count(*) AS events, count(*) FILTER (activity IS NULL) AS unnamed,
        count(*) FILTER (activity IS NOT NULL AND event_time IS NULL) AS bad_time,
        count(*) FILTER (activity IS NOT NULL AND event_time IS NOT NULL) AS kept FROM log_all""",
    "case_trace": "SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY event_time, tie) AS pos, activity, event_time FROM log",
    "log_summary": """SELECT count(*) AS n_events, count(DISTINCT case_id) AS n_cases, count(DISTINCT activity) AS n_activities,
        min(event_time) AS first_time, max(event_time) AS last_time FROM log""",
    "activity_freq": f"SELECT activity, {_COUNTS} FROM log GROUP BY activity",
    "transfer_freq": f"SELECT event_type, {_COUNTS} FROM events GROUP BY event_type",
    "first_activity": f"SELECT activity, {_COUNTS} FROM (SELECT arg_min(activity, (event_time, tie)) AS activity FROM log GROUP BY case_id) GROUP BY activity",
    "directly_follows": """SELECT activity AS source, nxt AS target, count(*) AS n, count(DISTINCT case_id) AS n_cases, round(avg(h),6) AS mean_gap_hours,
        round(median(h),6) AS median_gap_hours FROM (SELECT *, lead(activity) OVER w AS nxt,
        (epoch_us(lead(event_time) OVER w) - epoch_us(event_time)) / 3600000000.0::DOUBLE AS h FROM log
        WINDOW w AS (PARTITION BY case_id ORDER BY event_time, tie)) WHERE h IS NOT NULL GROUP BY ALL""",
    "process_ends": """SELECT role, activity, count(*) AS n_cases FROM (
        SELECT 'start' AS role, arg_min(activity, (event_time, tie)) AS activity FROM log GROUP BY case_id
        UNION ALL SELECT 'end', arg_max(activity, (event_time, tie)) FROM log GROUP BY case_id) GROUP BY ALL""",
    "prediction_points": "SELECT * FROM points",
    "prefix_events": "SELECT cohort, case_id, event_time, activity FROM prefix",
    "sequences": "SELECT * FROM seqs",
    "sequence_profile": """SELECT p.cohort, count(*) AS n_cases, count(n) AS encoded, count(*) FILTER (n IS NULL) AS dropped, min(n) AS min_len,
        round(avg(n),6) AS mean_len, max(n) AS max_len, round(quantile_cont(n::DOUBLE, 0.95),6) AS p95_len, count(*) FILTER (n > 30) AS truncated
        FROM points p LEFT JOIN (SELECT cohort, case_id, count(*) AS n FROM prefix GROUP BY ALL) x ON p.cohort = x.cohort AND p.hadm_id = x.case_id
        GROUP BY p.cohort""",
    "vocabulary_gaps": f"SELECT activity, {_COUNTS} FROM log WHERE activity LIKE '%Stepdown' GROUP BY activity",
    "bow_vocab": "SELECT * FROM vocab",
    "bow_features": "SELECT c.* FROM counts c JOIN vocab v USING (cohort, ngram)",
    "leak_audit": """SELECT cohort, setting, count(*) AS n_ngrams, count(*) FILTER (NOT in_c) AS n_leaked FROM (
        SELECT f.*, EXISTS (SELECT 1 FROM vocab v WHERE v.cohort = f.cohort AND v.ngram = f.ngram) AS in_c FROM (
        SELECT 'A' AS setting, cohort, ngram FROM (SELECT DISTINCT cohort, hadm_id, ngram FROM (
          SELECT cohort, hadm_id, unnest([w0, w0 || ' ' || w1, w0 || ' ' || w1 || ' ' || w2]) AS ngram FROM (SELECT cohort, case_id AS hadm_id,
          w AS w0, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM (SELECT p.cohort, l.*, lower(replace(activity,' ','_')) AS w
          FROM log l JOIN points p ON l.case_id = p.hadm_id WHERE l.event_time <= p.prediction_point)
          WINDOW o AS (PARTITION BY cohort, case_id ORDER BY event_time, tie)))) WHERE ngram IS NOT NULL GROUP BY ALL HAVING count(*) >= 2
        UNION ALL SELECT 'B', cohort, ngram FROM counts GROUP BY ALL HAVING count(*) >= 2
        UNION ALL SELECT 'C', cohort, ngram FROM vocab) f) GROUP BY ALL""",
    "collapse": "SELECT * FROM collapsed",
    "label_old": "SELECT cohort, hadm_id, left_old AS label FROM frame",
    "label_lat": "SELECT cohort, hadm_id, left_lat AS label FROM frame",
    "label_corr": "SELECT cohort, hadm_id, left_corr AS label FROM frame",
    "label_corrpacu": "SELECT cohort, hadm_id, left_corrpacu AS label FROM frame",
    "label_route": """SELECT cohort, hadm_id, t0, first_in, t_return, coalesce(via_critical::VARCHAR, '') AS via_critical,
        coalesce(via_intermediate::VARCHAR, '') AS via_intermediate, coalesce(via_pacu::VARCHAR, '') AS via_pacu, returned, route,
        left_corr AS left_shift FROM frame""",
    "label_collapse": "SELECT cohort, hadm_id, route, left_corr AS label FROM flat",
    "label_swap": """SELECT f.cohort, f.hadm_id, coalesce(c.left_corr, 0) AS label FROM frame f LEFT JOIN flat c
        ON f.cohort = c.cohort AND f.hadm_id = c.hadm_id""",
    "dwell_sweep": """SELECT cohort, min_dwell_h, count(*) AS n_cases, CAST(sum(returned) AS BIGINT) AS returned,
        count(*) FILTER (route = 'via_critical') AS via_critical, count(*) FILTER (route = 'via_intermediate') AS via_intermediate,
        count(*) FILTER (route = 'via_pacu') AS via_pacu, count(*) FILTER (route = 'via_ward') AS via_ward,
        round(100 * avg(left_corr), 3) AS rate_pct FROM dwell_frame GROUP BY ALL""",
    "restricted_cohort": "SELECT cohort, hadm_id, t0 FROM onward WHERE onward = 1",
    "structural_negatives": "SELECT cohort, hadm_id FROM onward WHERE onward = 0",
    "label_gate": """SELECT f.cohort, count(*) AS n_common, count(*) FILTER (f.left_old <> c.left_old) AS n_mismatch FROM frame f JOIN flat c
        ON f.cohort = c.cohort AND f.hadm_id = c.hadm_id GROUP BY f.cohort""",
    "label_transition": f"SELECT cohort, left_old AS old_label, left_lat AS new_label, {_COUNTS} FROM frame GROUP BY ALL",
    "demographics": "SELECT * FROM demo WHERE hadm_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "clinical_features": "SELECT * FROM clinical WHERE hadm_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "readmission_flag": "SELECT * FROM flagged",
    "uhr_count": "SELECT * FROM uhr",
    "bmi_nearest": "SELECT * FROM bmi_stays",
    "icd_chapters": f"""SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, {_CHAPTER_COUNTS} FROM orders LEFT JOIN chapters
        ON o_orderkey = hadm_id GROUP BY 1, 2""",
    "charlson": """SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, coalesce(charlson_score, 0) AS charlson_score FROM orders
        LEFT JOIN charlson ON o_orderkey = hadm_id""",
    "chronic_count": """SELECT o_orderkey AS hadm_id, o_custkey AS subject_id, coalesce(chronic_disease_count, 0) AS chronic_disease_count FROM orders
        LEFT JOIN chronic ON o_orderkey = hadm_id""",
    "ed_flag": """SELECT hadm_id, CASE WHEN hadm_id IN (SELECT case_id FROM log WHERE activity = 'Admission to Medical Ward') THEN 1 ELSE 0 END
        AS ed_admission FROM stays""",
    "process_features": "SELECT * FROM process",
    "location_profile": "SELECT * FROM profile",
    "location_ladder": """SELECT * REPLACE (coalesce(level::VARCHAR, '') AS level), CASE level WHEN 0 THEN 'Ward Care' WHEN 1 THEN 'Level 1 - Enhanced Care'
        WHEN 3 THEN 'Level 3 - Critical Care' ELSE '' END AS level_name, CASE WHEN careunit IN ('signup','view') THEN '2' ELSE '' END AS alt_level,
        CASE WHEN in_ladder THEN CASE level WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '2' END ELSE '' END AS ladder_rung FROM (
        SELECT *, CASE careunit WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 WHEN 'view' THEN 1 WHEN 'click' THEN 0 END AS level,
        careunit = 'view' AS is_procedural, careunit IN ('signup','view') AS contestable, careunit IN ('purchase','signup','click') AS in_ladder FROM profile)""",
    "level_rollup": """SELECT coalesce(level::VARCHAR, '') AS level, CASE level WHEN 0 THEN 'Ward Care' WHEN 1 THEN 'Level 1 - Enhanced Care'
        WHEN 3 THEN 'Level 3 - Critical Care' ELSE '' END AS level_name, count(*) AS units, CAST(sum(n_rows) AS BIGINT) AS rows,
        CAST(sum(n_admissions) AS BIGINT) AS admissions FROM (
        SELECT *, CASE careunit WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 WHEN 'view' THEN 1 WHEN 'click' THEN 0 END AS level FROM profile) GROUP BY 1, 2""",
    "feature_matrix": "SELECT * FROM matrix",
    "feature_matrix_inner": """SELECT l.cohort, l.hadm_id, l.subject_id, l.left_old AS left_shift, age_band, gender, insurance, ethnicity, marital_status,
        total_labs, abnormal_count, pct_abnormal_labs, num_diagnoses, num_medications, polypharmacy
        FROM labelled l JOIN demo d ON l.hadm_id = d.hadm_id JOIN clinical c ON l.hadm_id = c.hadm_id""",
    "matrix_null_audit": """SELECT cohort, "column", count(*) AS n_null FROM (SELECT cohort, unnest([
        CASE WHEN nullif(admission_location, 'INFORMATION NOT AVAILABLE') IS NULL THEN 'admission_location' END,
        CASE WHEN age_band IS NULL THEN 'age_band' END, CASE WHEN gender IS NULL THEN 'gender' END, CASE WHEN insurance IS NULL THEN 'insurance' END,
        CASE WHEN ethnicity IS NULL THEN 'ethnicity' END, CASE WHEN marital_status IS NULL THEN 'marital_status' END,
        CASE WHEN uhr_count IS NULL THEN 'uhr_count' END, CASE WHEN admission_type IS NULL THEN 'admission_type' END,
        CASE WHEN bmi_category IS NULL THEN 'bmi_category' END, CASE WHEN pct_abnormal_labs IS NULL THEN 'pct_abnormal_labs' END,
        CASE WHEN num_medications IS NULL THEN 'num_medications' END, CASE WHEN polypharmacy IS NULL THEN 'polypharmacy' END,
        CASE WHEN total_events IS NULL THEN 'total_events' END]) AS "column" FROM matrix) WHERE "column" IS NOT NULL GROUP BY ALL""",
    "cohort_exclusion": """SELECT f.cohort, f.hadm_id, left_old AS label FROM frame f JOIN onward o ON f.cohort = o.cohort AND f.hadm_id = o.hadm_id
        WHERE onward = 1""",
    "exclusion_report": """SELECT cohort, count(*) AS n_before, round(avg(left_lat), 4) AS rate_before, count(*) FILTER (onward = 0) AS n_excluded,
        count(*) FILTER (onward = 1) AS n_after, round(avg(left_lat) FILTER (onward = 1), 4) AS rate_after
        FROM frame JOIN onward USING (cohort, hadm_id) GROUP BY cohort""",
    "split_canonical": "SELECT * FROM split",
    "split_restricted": "SELECT * FROM restricted_split",
    "split_ungrouped": "SELECT * FROM split_loose",
    "split_checks": " UNION ALL ".join(
        [
            _LOOSE_CHECK.format(name="case_in_two_parts", key="hadm_id"),
            _LOOSE_CHECK.format(name="subject_in_two_parts", key="subject_id"),
            _COVER.format(name="not_covered", side="s"),
            _COVER.format(name="not_in_cohort", side="c"),
            "SELECT cohort, 'unknown_part' AS \"check\", count(*) FILTER (part NOT IN ('train','val','test')) AS n_bad FROM split_loose GROUP BY cohort",
        ]
    ),
    "split_overlap": """SELECT cohort, count(a) AS n_left, count(b) AS n_right, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_shared,
        count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right,
        round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*), 4) AS jaccard
        FROM (SELECT cohort, hadm_id, 1 AS a FROM split WHERE part = 'test') FULL JOIN (SELECT cohort, hadm_id, 1 AS b FROM split_loose WHERE part = 'test')
        USING (cohort, hadm_id) GROUP BY cohort""",
    "split_profile": """SELECT cohort, part, count(*) AS n, count(DISTINCT subject_id) AS n_subjects, CAST(sum(left_lat) AS BIGINT) AS n_pos,
        round(avg(left_lat), 4) AS pos_rate, round(count(*) / sum(count(*)) OVER (PARTITION BY cohort), 4) AS share FROM split GROUP BY cohort, part""",
    "split_digest": f"""SELECT cohort, CAST(sum(n) AS BIGINT) AS n_common, substring(sha256(concat_ws('|', {_DIGEST})), 1, 16) AS split_id FROM (
        SELECT cohort, part, count(*) AS n, bit_xor(CAST('0x' || substring(md5(part || ':' || hadm_id), 1, 15) AS BIGINT)) AS d FROM split GROUP BY ALL)
        GROUP BY cohort""",
    "provenance_gate": """SELECT Cohort, Variant, count(DISTINCT nullif(split_id, '')) AS n_split_ids, count(*) FILTER (split_id = '') AS n_missing,
        count(DISTINCT nullif(split_id, '')) <= 1 AS ok FROM (SELECT *, CASE WHEN Cohort = 'SW' AND Variant = 'old' AND Seed % 2 = 0 THEN 'b0'
        WHEN Seed = 3 THEN '' ELSE 'a0' END AS split_id FROM results) GROUP BY ALL""",
    "class_weights": """SELECT cohort, count(*) AS n, count(*) FILTER (left_lat = 1) AS n_pos, count(*) FILTER (left_lat = 0) AS n_neg,
        round(count(*) / (2 * count(*) FILTER (left_lat = 1)), 6) AS weight_pos, round(count(*) / (2 * count(*) FILTER (left_lat = 0)), 6) AS weight_neg,
        round(count(*) FILTER (left_lat = 0) / greatest(count(*) FILTER (left_lat = 1), 1), 6) AS pos_weight FROM split WHERE part = 'train' GROUP BY cohort""",
    "standardize": """SELECT cohort, hadm_id, part, round((n_events - avg(n_events) FILTER (part = 'train') OVER w) / stddev_pop(n_events) FILTER (part = 'train') OVER w, 6) AS n_events,
        round((mean_value - avg(mean_value) FILTER (part = 'train') OVER w) / stddev_pop(mean_value) FILTER (part = 'train') OVER w, 6) AS mean_value,
        round((max_value - avg(max_value) FILTER (part = 'train') OVER w) / stddev_pop(max_value) FILTER (part = 'train') OVER w, 6) AS max_value
        FROM split JOIN case_values USING (hadm_id) WINDOW w AS (PARTITION BY cohort)""",
    "one_hot": """SELECT c_custkey AS subject_id, (c_custkey % 2 = 0)::INT AS "gender_F", (c_custkey % 2 <> 0)::INT AS "gender_M", """
    + ", ".join(f"(c_mktsegment LIKE '{s.upper()}%')::INT AS insurance_{s}" for s in ("auto", "buil", "furn", "hous", "mach"))
    + " FROM customer",
    "knn": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, (label >= 5)::INT AS y,
        CAST('0x' || substring(md5(vec_id::VARCHAR), 1, 4) AS INT) % 5 = 0 AS test FROM embeddings),
        r AS (SELECT q.id AS query_id, t.id, t.y, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.e, t.e), t.id) AS rk
        FROM v q JOIN v t ON q.test AND NOT t.test)
        SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY rk) AS neighbours, round(avg(y), 6) AS score FROM r WHERE rk <= 5 GROUP BY query_id""",
    "trainer_inputs": """SELECT cohort, hadm_id, part, label, seq, round((n_events - avg(n_events) FILTER (part = 'train') OVER (PARTITION BY cohort))
        / stddev_pop(n_events) FILTER (part = 'train') OVER (PARTITION BY cohort), 6) AS x0, 3 + n_units::INT AS n_tabular
        FROM scored JOIN split USING (cohort, hadm_id) JOIN seqs USING (cohort, hadm_id)
        JOIN (SELECT cohort, count(DISTINCT last_unit) AS n_units FROM scored GROUP BY cohort) USING (cohort)""",
    "metrics_threshold": """SELECT *, round((TP + TN) / (TP + FP + FN + TN), 4) AS Accuracy, coalesce(round(TP / nullif(TP + FP, 0), 4), 0) AS "Precision",
        coalesce(round(TP / nullif(TP + FN, 0), 4), 0) AS Recall, coalesce(round(2 * TP / nullif(2 * TP + FP + FN, 0), 4), 0) AS F1 FROM (
        SELECT cohort, count(*) FILTER (label = 1 AND score >= 0.5) AS TP, count(*) FILTER (label <> 1 AND score >= 0.5) AS FP,
        count(*) FILTER (label = 1 AND score < 0.5) AS FN, count(*) FILTER (label <> 1 AND score < 0.5) AS TN FROM scored GROUP BY cohort)""",
    "auroc": """SELECT cohort, CAST(sum(pos + neg) AS BIGINT) AS n, round(sum(neg * (cp - pos / 2)) / (max(p) * max(q)), 6) AS "AUROC" FROM curve GROUP BY cohort""",
    "auprc": """SELECT cohort, CAST(sum(pos + neg) AS BIGINT) AS n, round(sum(pos * cp / (cp + cn)) / max(p), 6) AS "AUPRC" FROM curve GROUP BY cohort""",
    "threshold_sweep": """SELECT cohort, step, tp AS "TP", fp AS "FP", fn AS "FN", tn AS "TN", round(t, 2) AS threshold,
        coalesce(round(tp / nullif(tp + fp, 0), 4), 0) AS "Precision", coalesce(round(tp / nullif(tp + fn, 0), 4), 0) AS "Recall",
        coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) AS "F1" FROM sweep""",
    "best_threshold": """SELECT cohort, round(t, 2) AS threshold, round(f, 6) AS "F1" FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY f DESC, step) AS rn
        FROM (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM sweep)) WHERE rn = 1""",
    "confusion_tags": "SELECT cohort, hadm_id, label, score, (score >= 0.55)::INT AS pred, tag FROM tagged",
    "confusion_counts": f"SELECT cohort, count(*) AS n, {_TAGS} FROM tagged GROUP BY cohort",
    "error_meta": """SELECT x.cohort, auc AS "AUROC", round(x.t, 2) AS threshold, count(*) AS n, count(*) FILTER (label = 1 AND score >= x.t) AS "TP",
        count(*) FILTER (label = 1 AND score < x.t) AS "FN", count(*) FILTER (label <> 1 AND score >= x.t) AS "FP", count(*) FILTER (label <> 1 AND score < x.t) AS "TN"
        FROM parted p JOIN tuned x ON p.cohort = x.cohort JOIN (SELECT a.cohort, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5
        ELSE 0 END::DOUBLE), 4) AS auc FROM parted a JOIN parted b ON a.cohort = b.cohort AND a.part = 'test' AND b.part = 'test' AND a.label = 1 AND b.label <> 1
        GROUP BY a.cohort) u ON u.cohort = p.cohort WHERE p.part = 'test' GROUP BY ALL""",
    "group_means": f"SELECT cohort, feature, {', '.join(f'round({t}, 6) AS {t}' for t in ('TP', 'FN', 'FP', 'TN'))} FROM ({_GROUP_MEANS})",
    "fn_vs_tp": f"""SELECT cohort, feature, round(FN, 3) AS "FN_mean", round(TP, 3) AS "TP_mean", round(FN - TP, 3) AS abs_diff,
        round(100 * (FN - TP) / CASE WHEN abs(TP) > 1e-9 THEN abs(TP) ELSE 1 END, 1) AS rel_diff_pct FROM ({_GROUP_MEANS})""",
    "miss_rate": """SELECT cohort, feature, value, round(avg((tag = 'FN')::INT), 6) AS miss_rate, count(*) AS n_positives, count(*) >= 20 AS reliable FROM (
        SELECT cohort, tag, 'first_unit' AS feature, first_unit AS value FROM tagged WHERE label = 1
        UNION ALL SELECT cohort, tag, 'last_unit', last_unit FROM tagged WHERE label = 1) GROUP BY ALL""",
    "result_summary": "SELECT Model, Cohort, Condition, Variant, "
    + ", ".join(f'round(avg({x}),4) AS "{x}_mean", round(stddev_samp({x}),4) AS "{x}_std", count({x}) AS "{x}_count"' for x in ("AUROC", "AUPRC", "F1"))
    + " FROM results GROUP BY ALL",
    "run_inventory": """SELECT CASE WHEN Model IN ('LSTM','CNN') THEN 'deep' ELSE 'classical' END AS family, count(*) AS n_runs,
        count(DISTINCT Seed) AS n_seeds, round(sum(Train_Time_s) / 3600, 4) AS train_hours FROM results GROUP BY 1""",
    "prevalence_table": """SELECT cohort, variant, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 4) AS rate FROM (
        SELECT cohort, 'lat' AS variant, left_lat AS y FROM frame UNION ALL SELECT cohort, 'old', left_old FROM frame
        UNION ALL SELECT cohort, 'corr', left_corr FROM frame UNION ALL SELECT cohort, 'corrpacu', left_corrpacu FROM frame
        UNION ALL SELECT cohort, 'collapse', left_corr FROM flat
        UNION ALL SELECT f.cohort, 'restricted', left_lat FROM frame f JOIN onward o ON f.cohort = o.cohort AND f.hadm_id = o.hadm_id WHERE onward = 1)
        GROUP BY ALL""",
    "replication_delta": """SELECT Model, Cohort, published, round(lat, 4) AS lat, round(lat - published, 4) AS delta_lat, round(old, 4) AS old,
        round(old - published, 4) AS delta_old FROM (SELECT Model, Cohort, round(avg(AUROC), 2) AS published,
        avg(AUROC) FILTER (Condition = 'No Process' AND Variant = 'lat') AS lat, avg(AUROC) FILTER (Condition = 'No Process' AND Variant = 'old') AS old
        FROM results GROUP BY ALL HAVING count(*) FILTER (Condition = 'No Process') > 0)""",
    "model_by_condition": "SELECT Cohort, Model, "
    + ", ".join(
        f"round(avg(AUROC) FILTER (Condition = '{c}'), 4) AS {n}_mean, round(stddev_samp(AUROC) FILTER (Condition = '{c}'), 4) AS {n}_std"
        for n, c in (("plain", "No Process"), ("process", "With Process"), ("sequence", "Sequence Only"), ("combined", "Sequence + Tabular"))
    )
    + " FROM results WHERE Variant = 'lat' GROUP BY ALL",
    "classical_vs_deep": """SELECT Variant, Cohort, best_deep, round(gb, 4) AS "GB", round(rf, 4) AS "RF", round(mlp, 4) AS "MLP", round(lo, 4) AS deep_min,
        round(hi, 4) AS deep_max, round(gb - hi, 4) AS gap FROM (SELECT Variant, Cohort, avg(AUROC) FILTER (Model = 'GB') AS gb,
        avg(AUROC) FILTER (Model = 'RF') AS rf, avg(AUROC) FILTER (Model = 'MLP') AS mlp FROM results WHERE Condition = 'With Process' GROUP BY ALL)
        JOIN (SELECT Variant, Cohort, arg_min(Model, (-mean, Model)) AS best_deep, max(mean) AS hi, min(mean) AS lo FROM deep_means GROUP BY ALL)
        USING (Variant, Cohort)""",
    "seed_spread": """SELECT Variant, Cohort, Condition, round(spread, 4) AS spread, round(noise, 4) AS mean_seed_sd,
        CASE WHEN spread < 2 * noise THEN 'indistinguishable' ELSE 'detectable' END AS verdict FROM (SELECT Variant, Cohort, Condition,
        max(mean) - min(mean) AS spread, avg(sd) AS noise FROM cells WHERE Model IN ('LSTM','CNN') GROUP BY ALL)""",
    "feature_gain": """SELECT Variant, Cohort, round(gb, 4) AS "gain_GB", round(rf, 4) AS "gain_RF", round(mlp, 4) AS "gain_MLP", round(greatest(gb, rf, mlp), 4) AS gain_max
        FROM (SELECT Variant, Cohort, """
    + ", ".join(
        f"avg(AUROC) FILTER (Model = '{x}' AND Condition = 'With Process') - avg(AUROC) FILTER (Model = '{x}' AND Condition = 'No Process') AS {x.lower()}"
        for x in ("GB", "RF", "MLP")
    )
    + " FROM results GROUP BY ALL)",
    "tabular_contribution": """SELECT Variant, Cohort, round(avg(g), 4) AS mean_gain, round(min(g), 4) AS min_gain, round(max(g), 4) AS max_gain FROM (
        SELECT Variant, Cohort, Model, avg(AUROC) FILTER (Condition = 'Sequence + Tabular') - avg(AUROC) FILTER (Condition = 'Sequence Only') AS g
        FROM results WHERE Model IN ('LSTM','CNN') GROUP BY ALL) GROUP BY ALL""",
    "mean_rank": """SELECT Model, round(avg(rk), 2) AS mean_rank, CAST(floor(min(rk)) AS INT) AS best, CAST(floor(max(rk)) AS INT) AS worst, count(*) AS cells FROM (
        SELECT *, rank() OVER (PARTITION BY Variant, Cohort, Condition ORDER BY mean DESC)
        + (count(*) OVER (PARTITION BY Variant, Cohort, Condition, mean) - 1) / 2 AS rk FROM cells) GROUP BY Model""",
    "paired_interval": """SELECT Cohort, Variant, best_neural, n, round(own, 4) AS own_mean, round(neural_mean, 4) AS neural_mean, round(delta, 4) AS delta,
        round(delta - h, 4) AS ci_lo, round(delta + h, 4) AS ci_hi, CASE WHEN delta - h > 0 THEN 'GB beats' WHEN delta + h < 0 THEN 'neural beats' ELSE 'tie' END
        AS verdict FROM (SELECT Cohort, Variant, best_neural, any_value(top) AS neural_mean, count(*) AS n, any_value(own_all) AS own, avg(g.AUROC - x.AUROC) AS delta,
        2.776 * stddev_samp(g.AUROC - x.AUROC) / sqrt(count(*)) AS h FROM (SELECT *, avg(AUROC) OVER (PARTITION BY Cohort, Variant) AS own_all FROM results WHERE Model = 'GB' AND Condition = 'With Process') g
        JOIN neural x USING (Cohort, Variant, Seed) JOIN (SELECT Cohort, Variant, arg_min(Model, (-mean, Model)) AS best_neural, max(mean) AS top
        FROM (SELECT Cohort, Variant, Model, avg(AUROC) AS mean FROM neural GROUP BY ALL) GROUP BY ALL) b USING (Cohort, Variant)
        WHERE x.Model = best_neural GROUP BY ALL)""",
}
_CTE["parted"] = "SELECT s.cohort, s.hadm_id, s.label, s.score, part FROM scored s JOIN split USING (cohort, hadm_id)"
_CTE["tuned"] = """SELECT cohort, t FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY coalesce(2*tp / nullif(2*tp + fp + fn, 0), 0) DESC, i) AS rn
    FROM (SELECT cohort, i, any_value(t) AS t, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label <> 1 AND score >= t) AS fp,
    count(*) FILTER (label = 1 AND score < t) AS fn FROM parted, (SELECT i::INT AS i, 0.05::DOUBLE + 0.01::DOUBLE * i AS t FROM range(91) r(i))
    WHERE part = 'val' GROUP BY cohort, i)) WHERE rn = 1"""
_CTE["restricted_cases"] = """SELECT l.cohort, l.hadm_id, l.subject_id, l.left_lat FROM labelled l JOIN onward o
    ON l.cohort = o.cohort AND l.hadm_id = o.hadm_id WHERE onward = 1"""
_CTE["restricted_split"] = _grouped("restricted_cases")

ORACLE = {name: sql(body) for name, body in _BODIES.items()}
# The hot variants are the same queries by another plan.
HOT_VARIANTS = (
    "collapse", "dwell_sweep", "directly_follows", "uhr_count", "bmi_nearest", "bow_features", "auroc", "label_lat", "restricted_cohort", "sequences",
)
ORACLE |= {f"{name}_hot": ORACLE[name] for name in HOT_VARIANTS}
# Writing results down and reading them back changes nothing.
ORACLE["collect_results"] = ORACLE["result_summary"]
