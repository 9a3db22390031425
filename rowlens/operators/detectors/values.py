"""Column-level value detectors: DET-03, 04, 06..13, 15..18.

Eligibility comes from the profile and from shared counters over distinct values. Affected
rows are predicates; the runner evaluates all of them in one narrow scan of the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlens.functions import security, text
from rowlens.operators.cells import vf_text
from rowlens.operators.detectors.base import (
    DECORATIONS,
    EARLIEST_PLAUSIBLE_DATE,
    Context,
    Detector,
    Outcome,
    percent,
)
from rowlens.operators.profile import FENCE_MULTIPLIER, TEXT_FAMILY
from rowlens.sources.rownum import ROW_NUMBER

# Thresholds and name markers.
MISSING_RATIO = 0.01
NEGATIVE_MINORITY = 0.10
PERCENT_MARKERS = ("pct", "percent", "%")
EMAIL_MARKER = "email"
EMAIL_VALID_SHARE = 0.5
NUMBER_SHARE = 0.9
LINE_TOTAL_ROLES = ("quantity", "unit_price", "discount_pct", "tax_pct", "line_total")
LINE_TOTAL_TOLERANCE = 0.01
# Two-decimal rounding of the difference exceeds 0.01 exactly when the difference exceeds this.
LINE_TOTAL_CUT = 0.015


def _missing_values(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    total = ctx.profile.row_count
    for ref, p in zip(ctx.table.columns, ctx.profile.columns, strict=True):
        if p["inferred_type"] == "unknown" or not total:
            continue
        ratio = p["null_count"] / total
        if ratio >= MISSING_RATIO:
            out.add(
                MISSING_VALUES,
                [ref],
                severity="medium",
                confidence=1.0,
                observation=(
                    f"Column '{ref.original_name}' has no value in {p['null_count']} of "
                    f"{total} row(s) ({percent(ratio)})."
                ),
                rows=p["null_count"],
                payload={
                    "null_count": p["null_count"],
                    "sample_size": total,
                    "missing_ratio": ratio,
                },
                flag=ctx.table.missing(ref),
            )
    return out


def _missing_identifier(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    for ref, p in ctx.profile.of_type(*TEXT_FAMILY):
        if p["likely_identifier"] and p["null_count"] > 0:
            out.add(
                MISSING_IDENTIFIER,
                [ref],
                severity="high",
                confidence=1.0,
                observation=(
                    f"Column '{ref.original_name}' looks like an identifier but is missing in "
                    f"{p['null_count']} row(s)."
                ),
                rows=p["null_count"],
                payload={"null_count": p["null_count"]},
                flag=ctx.table.missing(ref),
            )
    return out


def _edge_whitespace(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    for ref, p in ctx.profile.of_type(*TEXT_FAMILY):
        count = p["whitespace_issue_count"]
        if count > 0:
            value = ctx.table.text(ref)
            out.add(
                EDGE_WHITESPACE,
                [ref],
                severity="low",
                confidence=1.0,
                observation=(
                    f"Column '{ref.original_name}' starts or ends with white space in {count} row(s)."
                ),
                rows=count,
                payload={"whitespace_issue_count": count},
                flag=value != text.strip(value),
            )
    return out


def _future_dates(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    for ref, _p in ctx.profile.of_type("date"):
        count = ctx.shared("date_counters")[ref.ordinal]["future"]
        if count:
            out.add(
                FUTURE_DATES,
                [ref],
                severity="medium",
                confidence=1.0,
                observation=(
                    f"Column '{ref.original_name}' has {count} date(s) after {ctx.as_of.isoformat()}."
                ),
                rows=count,
                payload={
                    "reference_date": ctx.as_of.isoformat(),
                    "future_date_count": count,
                },
                flag=ctx.table.day(ref) > F.lit(ctx.as_of),
            )
    return out


def _old_dates(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    cutoff = EARLIEST_PLAUSIBLE_DATE
    for ref, _p in ctx.profile.of_type("date"):
        c = ctx.shared("date_counters")[ref.ordinal]
        if c["old"]:
            out.add(
                OLD_DATES,
                [ref],
                severity="low",
                confidence=0.8,
                observation=(
                    f"Column '{ref.original_name}' has {c['old']} date(s) before "
                    f"{cutoff.isoformat()}, the oldest {c['oldest']}."
                ),
                rows=c["old"],
                payload={
                    "earliest_plausible_date": cutoff.isoformat(),
                    "old_date_count": c["old"],
                    "oldest_date_found": c["oldest"],
                },
                flag=ctx.table.day(ref) < F.lit(cutoff),
            )
    return out


def _negatives(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    for ref, p in ctx.profile.of_type("numeric"):
        count, total = p["negative_count"], p["non_null_count"]
        ratio = count / total
        if 0 < count and ratio < NEGATIVE_MINORITY:
            out.add(
                NEGATIVES,
                [ref],
                severity="medium",
                confidence=0.7,
                observation=(
                    f"Column '{ref.original_name}' is negative in {count} of {total} value(s) "
                    f"({percent(ratio)}), rarely enough to look like errors."
                ),
                rows=count,
                payload={
                    "negative_count": count,
                    "non_null_count": total,
                    "negative_ratio": ratio,
                },
                flag=ctx.table.num(ref) < 0,
            )
    return out


def _percentages(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    outside_of = {}
    for ref, p in ctx.profile.of_type("numeric"):
        named = any(m in ref.original_name.lower() for m in PERCENT_MARKERS)
        if named and not (p["num_min"] >= 0 and p["num_max"] <= 100):
            num = ctx.table.num(ref)
            outside_of[ref] = ~F.isnan(num) & ((num < 0) | (num > 100))
    if not outside_of:
        return out
    # all columns in one scan
    counts = ctx.table.df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(outside_of.values())]).first()
    for (ref, outside), count in zip(outside_of.items(), counts, strict=True):
        if count:
            out.add(
                PERCENTAGES,
                [ref],
                severity="medium",
                confidence=1.0,
                observation=f"Column '{ref.original_name}' has {count} value(s) outside 0-100.",
                rows=count,
                payload={"valid_min": 0.0, "valid_max": 100.0, "invalid_count": count},
                flag=outside,
            )
    return out


def _line_total(ctx: Context, config: dict) -> Outcome:
    out = Outcome()
    named = {
        ref.original_name.strip().lower(): (ref, p)
        for ref, p in zip(ctx.table.columns, ctx.profile.columns, strict=True)
    }
    roles = []
    for role in LINE_TOTAL_ROLES:
        wanted = config[f"{role}_column"]
        ref, p = named.get(wanted.strip().lower(), (None, None))
        if ref is None or p["inferred_type"] != "numeric":
            out.warnings.append(
                (
                    "cross_field.required_columns_not_found",
                    f"the '{role}' column '{wanted}' was not found as a numeric column",
                )
            )
            return out
        roles.append(ref)
    quantity, price, discount, tax, stored = (ctx.table.num(r) for r in roles)
    difference = F.abs(stored - text.recomputed_total(quantity, price, discount, tax))
    wrong = F.coalesce(~F.isnan(difference) & (difference > LINE_TOTAL_CUT), F.lit(False))
    count = ctx.table.df.agg(F.count_if(wrong).alias("n")).first()["n"]
    if count:
        out.add(
            LINE_TOTAL,
            roles,
            severity="high",
            confidence=1.0,
            observation=f"{count} row(s) store a total that differs from the recomputed one.",
            rows=count,
            payload={"tolerance": LINE_TOTAL_TOLERANCE, "mismatch_count": count},
            flag=wrong,
        )
    return out


def _constant(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    hits = [
        (ref, p)
        for ref, p in zip(ctx.table.columns, ctx.profile.columns, strict=True)
        if p["non_null_count"] >= 2 and p["distinct_count"] == 1
    ]
    if not hits:
        return out
    values = {
        r.ordinal: r.value
        for r in ctx.profile.vf_of([ref for ref, _ in hits])
        .select("ordinal", vf_text().alias("value"))
        .collect()
    }
    for ref, p in hits:
        out.add(
            CONSTANT,
            [ref],
            severity="medium",
            confidence=1.0,
            observation=(
                f"Column '{ref.original_name}' has one single value in all "
                f"{p['non_null_count']} filled row(s)."
            ),
            rows=0,
            payload={
                "non_null_count": p["non_null_count"],
                "constant_value": values[ref.ordinal],
            },
        )
    return out


def _outliers(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    for ref, p in ctx.profile.of_type("numeric"):
        count = p["extreme_count"]
        if not count:
            continue
        low = p["q1"] - FENCE_MULTIPLIER * p["iqr"]
        high = p["q3"] + FENCE_MULTIPLIER * p["iqr"]
        num = ctx.table.num(ref)
        out.add(
            OUTLIERS,
            [ref],
            severity="medium",
            confidence=0.7,
            observation=(
                f"Column '{ref.original_name}' has {count} value(s) outside the range "
                f"[{low:.2f}, {high:.2f}]."
            ),
            rows=count,
            payload={"lower_fence": low, "upper_fence": high, "outlier_count": count},
            flag=~F.isnan(num) & ((num < low) | (num > high)),
        )
    return out


def _injection(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    keys: dict[int, str] = {}
    for ref, _p in ctx.profile.of_type(*TEXT_FAMILY):
        c = ctx.shared("injection_counters").get(ref.ordinal)
        if not c:
            continue
        families = sorted(f for f in security.FAMILIES if c[f"f_{f}"])
        present = [s for s in security.SUBTYPES if c[f"s_{s}"]]
        heightened = any(f in security.HEIGHTENED for f in families)
        high, low = ("critical", "medium") if ctx.samples_sent else ("high", "low")
        keys[ref.ordinal] = out.add(
            INJECTION,
            [ref],
            severity=high if heightened else low,
            confidence=0.75 if len(families) >= 2 else 0.6,
            observation=(
                f"Column '{ref.original_name}' has {c['rows']} value(s) that read like an "
                "instruction to a language model (a possible risk, not proof of intent)."
            ),
            rows=c["rows"],
            payload={
                "matched_pattern_categories": families,
                "affected_row_count": c["rows"],
                "truncated_sample_prefix": c["excerpt"],
                "risk_subtypes": present,
                "subtype_row_counts": {s: c[f"s_{s}"] for s in present},
            },
        )
    if keys:
        key = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
        found = ctx.injected_rows([ref for ref in ctx.table.columns if ref.ordinal in keys])
        out.row_frames.append(found.select(key[F.col("ordinal")].alias("finding_key"), ROW_NUMBER))
    return out


def _booleans(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    for ref, _p in ctx.profile.of_type("text", "categorical", "boolean", "mixed"):
        c = ctx.shared("word_counters").get(ref.ordinal)
        if not c or not c["checked"] or not c["all_boolean"] or len(c["families"]) < 2:
            continue
        spellings = sorted(c["spellings"])
        out.add(
            BOOLEANS,
            [ref],
            severity="low",
            confidence=0.9,
            observation=(
                f"Column '{ref.original_name}' writes yes/no values in {len(c['families'])} "
                f"families of words ({', '.join(spellings)}) over {c['checked']} row(s)."
            ),
            rows=c["checked"],
            payload={
                "spelling_families": sorted(c["families"]),
                "distinct_spellings": spellings,
                "affected_row_count": c["checked"],
            },
            flag=~ctx.table.blank(ref),
        )
    return out


def _emails(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    for ref, _p in ctx.profile.of_type(*TEXT_FAMILY, "mixed"):
        compact = ref.original_name.lower().replace("-", "").replace("_", "").replace(" ", "")
        c = ctx.shared("word_counters").get(ref.ordinal)
        if EMAIL_MARKER not in compact or not c or not c["not_email"]:
            continue
        if (c["checked"] - c["not_email"]) / c["checked"] < EMAIL_VALID_SHARE:
            continue
        value = text.strip(ctx.table.text(ref))
        out.add(
            EMAILS,
            [ref],
            severity="low",
            confidence=0.8,
            observation=(
                f"Column '{ref.original_name}' has {c['not_email']} of {c['checked']} value(s) "
                "without the shape of an email address."
            ),
            rows=c["not_email"],
            payload={
                "checked_value_count": c["checked"],
                "invalid_value_count": c["not_email"],
                "expected_shape": "local@domain.tld",
            },
            flag=(value != "") & ~text.has_email_shape(value),
        )
    return out


def _numbers_as_text(ctx: Context, _: dict) -> Outcome:
    out = Outcome()
    for ref, _p in ctx.profile.of_type(*TEXT_FAMILY, "mixed"):
        c = ctx.shared("word_counters").get(ref.ordinal)
        if not c or not c["decorated"] or c["numeric_like"] / c["checked"] < NUMBER_SHARE:
            continue
        kinds = sorted(k for i, k in enumerate(DECORATIONS) if c[f"d_{i}"])
        out.add(
            NUMBERS_AS_TEXT,
            [ref],
            severity="medium",
            confidence=0.9,
            observation=(
                f"Column '{ref.original_name}' holds numbers written as text in "
                f"{c['decorated']} of {c['checked']} filled row(s) ({', '.join(kinds)})."
            ),
            rows=c["decorated"],
            payload={
                "checked_value_count": c["checked"],
                "numeric_like_count": c["numeric_like"],
                "decorated_value_count": c["decorated"],
                "decorations": kinds,
            },
            flag=F.coalesce(
                F.size(text.number_decorations(ctx.table.text(ref))) > 0, F.lit(False)
            ),
        )
    return out


MISSING_VALUES = Detector(
    "completeness.excessive_missing_values", "Excessive missing values", "completeness", _missing_values
)
MISSING_IDENTIFIER = Detector(
    "completeness.missing_likely_identifier",
    "Missing likely identifier",
    "completeness",
    _missing_identifier,
)
EDGE_WHITESPACE = Detector(
    "consistency.leading_trailing_whitespace",
    "Leading/trailing whitespace",
    "consistency",
    _edge_whitespace,
)
FUTURE_DATES = Detector("validity.future_dates", "Future dates", "validity", _future_dates)
OLD_DATES = Detector(
    "validity.implausibly_old_dates", "Implausibly old dates", "validity", _old_dates
)
NEGATIVES = Detector(
    "validity.negative_likely_non_negative_values",
    "Negative likely non-negative values",
    "validity",
    _negatives,
)
PERCENTAGES = Detector(
    "validity.invalid_percentages", "Invalid percentages", "validity", _percentages
)
LINE_TOTAL = Detector(
    "cross_field.line_total_mismatch",
    "Line-total mismatch",
    "cross_field",
    _line_total,
    defaults={f"{role}_column": role for role in LINE_TOTAL_ROLES},
)
CONSTANT = Detector(
    "statistical.suspiciously_constant_column",
    "Suspiciously constant column",
    "statistical",
    _constant,
)
OUTLIERS = Detector("statistical.extreme_outliers", "Extreme outliers", "statistical", _outliers)
INJECTION = Detector(
    "security.possible_llm_prompt_injection",
    "Possible LLM prompt injection",
    "ai_processing_security",
    _injection,
    version="2",
)
BOOLEANS = Detector(
    "consistency.inconsistent_booleans", "Inconsistent booleans", "consistency", _booleans
)
EMAILS = Detector("validity.invalid_email_shape", "Invalid email shape", "validity", _emails)
NUMBERS_AS_TEXT = Detector(
    "consistency.numeric_values_stored_as_text",
    "Numeric values stored as text",
    "consistency",
    _numbers_as_text,
)
