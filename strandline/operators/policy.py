"""Licences and advisories against a policy with exceptions that end on a day. Nulls match nothing: a package without a licence is a violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _in_force(exceptions: DataFrame, today: str) -> DataFrame:
    return exceptions.where(F.col("expires_on").cast("date") >= F.lit(today).cast("date"))


def license_violations(inventory: DataFrame, allowed: DataFrame, exceptions: DataFrame, today: str) -> DataFrame:
    """Packages of inventory(package, version, license), each once, whose licence is not in allowed(license) and that no exception(package, version, license,
    expires_on) in force excuses."""
    d = inventory.select("package", "version", "license").distinct().join(allowed.select("license").distinct(), "license", "left_anti")
    return d.join(_in_force(exceptions, today), ["package", "version", "license"], "left_anti").select("package", "version", "license")


def dependency_violations(advisories: DataFrame, exceptions: DataFrame, today: str) -> DataFrame:
    """Advisories(advisory, package, severity), each once: high and critical ones always, others unless an exception(advisory, package, severity, expires_on) in
    force excuses them."""
    d = advisories.select("advisory", "package", "severity").distinct()
    grave = F.coalesce(F.col("severity").isin("high", "critical"), F.lit(False))
    excused = d.where(~grave).join(_in_force(exceptions, today), ["advisory", "package", "severity"], "left_anti")
    return d.where(grave).union(excused.select(*d.columns))
