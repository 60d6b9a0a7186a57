"""Verdict labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut-offs and labels of the monitored models.
PSI_LOW, PSI_MODERATE = 0.10, 0.25
MAPE_OK, MAPE_ALERT = 10.0, 25.0
EXTREME_PSI = 0.35
RETRAIN = "REENTRENAMIENTO_OBLIGATORIO"
ALARM = "ALARMA"


def psi_category(psi: Column) -> Column:
    return F.when(psi < PSI_LOW, "LOW").when(psi < PSI_MODERATE, "MODERATE").when(psi.isNotNull(), "HIGH")


def psi_alert(psi: Column, warn: float, critical: float) -> Column:
    return (
        F.when(psi.isNull(), "skipped")
        .when(psi < warn, "OK")
        .when(psi < critical, "WARNING")
        .otherwise("CRITICAL")
    )


def mape_verdict(mape: Column) -> Column:
    """A value under 1 is read as a fraction, as the monitored service does."""
    pct = F.when(mape < 1, mape * 100).otherwise(mape)
    return F.when(pct <= MAPE_OK, "OK").when(pct <= MAPE_ALERT, "ALERTA").when(pct.isNotNull(), "CRITICO")


def recall_status(recall: Column, minimum: float) -> Column:
    return F.when(recall >= minimum, "healthy").otherwise("degraded")


def must_retrain(psi_decision: Column, error_verdict: Column) -> Column:
    return (
        (psi_decision == RETRAIN)
        | (error_verdict == "CRITICO")
        | ((psi_decision == ALARM) & (error_verdict == "ALERTA"))
    )
