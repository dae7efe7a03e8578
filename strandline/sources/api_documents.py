"""Endpoints of OpenAPI documents in JSON, and decisions on webhook deliveries; JSON functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as tx

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
_OPERATION = "map<string, map<string, string>>"


def endpoints(docs: DataFrame) -> DataFrame:
    """(application_id, method, path, operation_id, tags) of docs(application_id, document)."""
    d = docs.select("application_id", F.from_json(F.get_json_object("document", "$.paths"), _OPERATION).alias("_paths"), F.get_json_object("document", "$.servers[0].url").alias("_base"))
    d = d.select("application_id", "_base", F.explode("_paths").alias("_path", "_ops")).select("application_id", "_base", "_path", F.explode("_ops").alias("_method", "_op"))
    d = d.where(F.lower("_method").isin(*METHODS))
    base = F.regexp_replace(F.regexp_extract(F.coalesce("_base", F.lit("")), r"^(?:[a-z]+://[^/]+)?(/.*)?$", 1), "/$", "")
    return d.select(
        "application_id", F.upper("_method").alias("method"), tx.endpoint_path(F.concat(base, F.col("_path"))).alias("path"),
        F.get_json_object("_op", "$.operationId").alias("operation_id"), F.coalesce(F.from_json(F.get_json_object("_op", "$.tags"), "array<string>"), F.array().cast("array<string>")).alias("tags"),
    )


def decisions(deliveries: DataFrame, actions: tuple[str, ...] = ("opened", "reopened", "synchronize")) -> DataFrame:
    """(delivery_id, decision, number, head) of deliveries(delivery_id, event, payload): the first reason to ignore one, or
    accepted."""
    get = lambda p: F.get_json_object("payload", p)
    d = deliveries.select("delivery_id", "event", "payload", get("$.action").alias("_action"), get("$.pull_request.number").cast("bigint").alias("number"), get("$.pull_request.head.sha").alias("head"), get("$.pull_request.draft").alias("_draft"))
    ladder = (
        F.when(F.col("event") == "ping", "ignored_ping").when(F.col("event") != "pull_request", "ignored_event").when(get("$").isNull(), "malformed")
        .when(~F.coalesce(F.col("_action").isin(*actions), F.lit(False)), "ignored_action").when(F.col("number").isNull() | ~F.coalesce(F.col("head").rlike("^([0-9a-f]{40}|[0-9a-f]{64})$"), F.lit(False)), "malformed")
        .when(F.col("_draft") == "true", "ignored_draft").otherwise("accepted")
    )
    return d.select("delivery_id", ladder.alias("decision"), "number", "head")
