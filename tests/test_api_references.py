"""Schema references of API documents, followed through circles, missing and other documents."""

from __future__ import annotations

import json

from strandline.sources import api_references as api

REF = lambda name, kind="schemas": {"$ref": f"#/components/{kind}/{name}"}
DOC = {
    "openapi": "3.0.0",
    "paths": {
        "/orders/{id}": {
            "parameters": [{"schema": REF("NotCounted")}],
            "get": {"responses": {"200": {"content": {"application/json": {"schema": {"type": "array", "items": REF("Order")}}}}, "404": REF("Missing", "responses"), "x-own": {"content": {"a": {"schema": REF("NotCounted")}}}}},
            "put": {"requestBody": REF("Body", "requestBodies"), "responses": {"default": {"description": "none"}}},
        },
        "/a~b": {"post": {"requestBody": {"content": {"a/b": {"schema": {"oneOf": [REF("Gone"), {"$ref": "other.json#/X"}, REF("Loop")]}}, "plain": {}}}}, "summary": {"schema": REF("NotCounted")}},
    },
    "components": {
        "schemas": {
            "Order": {"properties": {"lines": {"items": REF("Line")}, "self": REF("Order")}}, "Line": {"properties": {"part": REF("Part")}}, "Part": {"type": "object"},
            "Loop": {"properties": {"next": REF("Loop2"), "leaf": REF("Part")}}, "Loop2": {"allOf": [REF("Loop")]}, "NotCounted": {}, "Error": {"type": "string"}, "a/b~c": {},
        },
        "responses": {"Missing": {"content": {"application/json": {"schema": {"properties": {"e": REF("Error"), "odd": {"$ref": "#/components/schemas/a~1b~0c"}}}}}}},
        "requestBodies": {"Body": REF("Again", "requestBodies"), "Again": {"content": {"application/json": REF("Media", "media")}}},
        "media": {"Media": {"schema": REF("Line")}},
    },
}


def test_references(spark):
    s = lambda *names: [f"#/components/schemas/{n}" for n in names]
    docs = spark.createDataFrame([("app", json.dumps(DOC)), ("bad", "{no json"), ("null", None), ("none", "{}"), ("list", "[1]")], "application_id string, document string")
    got = {(r["application_id"], r["method"], r["path"], r["side"]): (r["refs"], r["missing"], r["external"], r["cyclic"]) for r in api.references(docs).collect()}
    assert got == {
        ("app", "GET", "/orders/{param}", "request"): ([], [], [], []),
        ("app", "GET", "/orders/{param}", "response"): (s("Error", "Line", "Order", "Part", "a~1b~0c"), [], [], s("Order")),
        ("app", "PUT", "/orders/{param}", "request"): (s("Line", "Part"), [], [], []),
        ("app", "PUT", "/orders/{param}", "response"): ([], [], [], []),
        ("app", "POST", "/a~b", "request"): ([*s("Gone", "Loop", "Loop2", "Part"), "other.json#/X"], s("Gone"), ["other.json#/X"], s("Loop", "Loop2")),
        ("app", "POST", "/a~b", "response"): ([], [], [], []),
    }
    assert api.references(docs.where("application_id = 'null'")).count() == 0


def test_bodies_that_refer_to_each_other_end(spark):
    doc = {"paths": {"/x": {"get": {"requestBody": REF("A", "requestBodies")}}}, "components": {"requestBodies": {"A": REF("B", "requestBodies"), "B": REF("A", "requestBodies")}}}
    [a, b] = api.references(spark.createDataFrame([("k", json.dumps(doc))], "application_id string, document string")).collect()
    assert a["refs"] == b["refs"] == []
