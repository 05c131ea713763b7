"""Texts built from columns: number formats, word lists, the explanation of an anomaly, the causal-word audit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..params import ANOMALY_LABELS, CAUSAL_WORDS, DETECTOR_PHRASES, GENERIC_LABEL


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals, rounding the exact binary value half to even."""
    return F.call_function("format_number", value, F.lit("0" if digits == 0 else "0." + "0" * digits))


def format_value(value: Column) -> Column:
    size = F.abs(value)
    return F.when(size >= 100, fixed(value, 0)).when(size >= 1, fixed(value, 1)).otherwise(fixed(value, 2))


def drop_last_zero(text: Column) -> Column:
    return F.regexp_replace(text, "0$", "")


def format_component(value: Column) -> Column:
    return drop_last_zero(fixed(value, 2))


def format_score(value: Column) -> Column:
    return drop_last_zero(fixed(value, 3))


def join_words(words: Column) -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(words)
    return F.when(n <= 1, F.array_join(words, "")).otherwise(
        F.concat(
            F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "),
            F.lit(" and "),
            F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")),
        )
    )


def label(anomaly_type: Column) -> Column:
    out = F.lit(GENERIC_LABEL)
    for name, words in ANOMALY_LABELS.items():
        out = F.when(anomaly_type == name, words).otherwise(out)
    return out


def fired(method: str) -> Column:
    return F.array_contains(F.split("detection_method", r"\+"), method)


def explanation(log_domain: Column) -> Column:
    """Sentence from the columns of an anomaly row: observed, expected, deviation, duration, detectors, score."""
    observed, expected, z, unit = (F.col(c) for c in ("observed_value", "expected_value", "robust_z", "unit"))
    deviation = F.concat(
        fixed(F.abs(z), 1),
        F.lit(" robust standard deviations"),
        F.when(log_domain, " (log scale)").otherwise(""),
        F.when(z > 0, " above").otherwise(" below"),
        F.lit(" this sensor's baseline, "),
        F.when(
            log_domain & (expected > 0),
            F.concat(fixed(observed / F.nullif(expected, F.lit(0.0)), 1), F.lit("× the expected level")),
        ).otherwise(F.concat(F.lit("a difference of "), format_value(F.abs(observed - expected)), F.lit(" "), unit)),
    )
    lasting = F.concat(
        F.lit("lasting "),
        F.col("duration_hours").cast("string"),
        F.lit(" h"),
        F.when(F.col("status") == "active", " and still present at the end of the analysed window").otherwise(""),
    )
    limit = F.when(F.col("breach").isNull(), "").otherwise(
        F.concat(
            F.lit(" The "),
            F.when(F.col("breach.side") == "below", "lowest").otherwise("highest"),
            F.lit(" reading of the event, "), format_value(F.col("breach.extreme")), F.lit(" "), unit,
            F.lit(", is "), F.col("breach.side"), F.lit(" the "), F.col("breach.level"), F.lit(" limit of "),
            format_value(F.col("breach.limit")), F.lit(" "), unit, F.lit("."),
        )
    )
    names = F.array_compact(F.array(*[F.when(fired(m), phrase) for m, phrase in DETECTOR_PHRASES.items()]))
    detectors = F.concat(
        F.when(F.size(names) > 0, F.concat(F.lit(" Flagged by "), join_words(names))).otherwise(
            " Flagged by the persistence of moderate deviations"
        ),
        F.when(fired("isolation_forest"), "; corroborated by Isolation Forest").otherwise(""),
        F.lit("."),
    )
    parts = F.concat_ws(
        ", ",
        *[
            F.concat(F.lit(f"{name} "), format_component(F.col(f"score_components.{name}")))
            for name in ("magnitude", "duration", "threshold")
        ],
    )
    return F.concat(
        label(F.col("anomaly_type")), F.lit(" on "), F.col("sensor_id"), F.lit(" ("),
        F.translate("placement", "_", " "), F.lit("): "), format_value(observed), F.lit(" "), unit,
        F.lit(" at peak versus an expected "), format_value(expected), F.lit(" "), unit, F.lit(" for that hour"),
        F.when(F.col("peer_adjusted"), " given what comparable sensors recorded").otherwise(""),
        F.lit(" — "), deviation, F.lit(", "), lasting, F.lit("."), limit, detectors,
        F.lit(" Severity "), F.col("severity"), F.lit(" (score "), format_score(F.col("anomaly_score")),
        F.lit(": "), parts, F.lit(")."),
    )


def causal_words(text: Column) -> Column:
    """The causal or safety words a text holds (substring, any case)."""
    lowered = F.lower(text)
    return F.array_compact(F.array(*[F.when(lowered.contains(w), w) for w in CAUSAL_WORDS]))
