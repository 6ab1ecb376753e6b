"""A model that hangs, fails and answers; and JSON of any depth."""

import json
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillon.operators import composer, nested


def scripted(seen=None):
    """A model by the prompt's first word; ``seen`` counts the calls of each prompt."""
    seen = {} if seen is None else seen

    def model(prompt):
        n = seen[prompt] = seen.get(prompt, 0) + 1
        kind = prompt.split()[0]
        if kind == "hang":
            time.sleep(60)
        if kind == "fail" or (kind == "late" and n < 3):
            raise ValueError("no")
        return {"empty": "  ", "none": None}.get(kind, f"says {prompt}")

    return model


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find this module


PROMPTS = ["ok 1", "fail 2", "hang 3", "late 4", "empty 5", "none 6", None, "ok 7", "hang 8", "ok 9"]
WANT = [("says ok 1", None), (None, "ValueError"), (None, "timeout"), ("says late 4", None), (None, "empty"), (None, "empty"), (None, "no_prompt"), ("says ok 7", None), (None, "timeout"), ("says ok 9", None)]


def test_calls_equal_a_sequential_version():
    for at_once in (1, 3, 20):
        seen, began = {}, time.monotonic()
        assert composer.Calls(scripted(seen), deadline=0.6, attempts=3, pause=0.01, at_once=at_once).all(PROMPTS) == WANT
        assert time.monotonic() - began < 5 and seen["fail 2"] == 3 and seen["late 4"] == 3 and seen["ok 1"] == 1


def test_a_model_that_only_hangs_is_given_up():
    calls, began = composer.Calls(lambda _: time.sleep(60), deadline=0.1, at_once=2), time.monotonic()
    found = calls.all([f"p{k}" for k in range(100)])
    assert [e for _, e in found] == ["timeout"] * 8 + ["given_up"] * 92 and time.monotonic() - began < 3


def test_back_off_ends_at_the_deadline():
    seen = {}
    assert composer.Calls(scripted(seen), deadline=0.2, attempts=50, pause=0.05).all(["fail x"]) == [(None, "ValueError")] and seen["fail x"] < 5
    with pytest.raises(ValueError):
        composer.Calls(scripted(), deadline=0)


def test_rows_keep_their_fallback(spark):
    rows = spark.createDataFrame([(k, p, f"found {k}") for k, p in enumerate(PROMPTS)], "k int, prompt string, answer string").repartition(2)
    got = {r.k: (r.composed_answer, r.composed_by, r.composer_error) for r in composer.compose_with(rows, scripted, deadline=0.6, pause=0.01).collect()}
    assert got == {k: (a or f"found {k}", "model" if a else "fallback", e) for k, (a, e) in enumerate(WANT)}


TEXTS = ['{"a":{"b":[1,{"c":null},[2.5,"x"]]},"t":true}', "[]", '"s"', "{bad", None, "7", '{"a":{}}', '{"d":' + '{"d":' * 30 + "1" + "}" * 31]


def paths(value, path="$"):
    yield path, {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(value)]
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from paths(v, f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]")


def test_walk_to_any_depth(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, j string")
    walked = nested.walk(rows, "k", "j")
    want = sorted((k, *p) for k, t in enumerate(TEXTS) if t not in (None, "{bad") for p in paths(json.loads(t)))
    assert sorted((r.k, r.path, r.kind) for r in walked.where("kind <> 'invalid'").collect()) == want
    assert [r.k for r in walked.where("kind = 'invalid'").collect()] == [3] and walked.where("k = 0 and path = '$.a.b[2][1]'").first().value == "x"
    assert {(r.path, r.n) for r in nested.key_report(walked).where("kind = 'number'").collect()} >= {("$.a.b[*]", 1), ("$.a.b[*][*]", 1), ("$", 1)}


def test_redaction_by_key(spark):
    text = json.dumps({"api_key": "a\"b", "x": [{"Secret-Token": 1.5, "plain": "token"}], "password": True, "token": {"inner": "kept", "my token": "z"}})
    got = json.loads(spark.createDataFrame([(text,)], "j string").select(nested.redact_keys(F.col("j"))).first()[0])
    gone = "[REDACTED]"
    assert got == {"api_key": gone, "x": [{"Secret-Token": gone, "plain": "token"}], "password": gone, "token": {"inner": "kept", "my token": gone}}
