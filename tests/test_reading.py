"""Answers read by batch against the same read by columns, on mutated and odd texts."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewright.functions import reading, scoring

GOOD = {"intent": "complaint", "decision": "deny", "risk_level": "low", "need_human": False, "reason_codes": ["logistics_issue"], "explanation": "按规则处理"}


def texts():
    r = random.Random(5)
    one = json.dumps(GOOD, ensure_ascii=False)
    values = [None, True, 1, -0.5, "", "x", "deny", [], [None], ["logistics_issue", None], [1], ["a", 1], {}, {"a": 1}, [[1]], [{"a": 1}], "low", "é  ", 10**40, 1e300]
    out = [None, "", " ", "{}", "[1]", "1", "null", '"a"', "NaN", "[NaN]", "{'a': 1}", one[:-1], one + "}", one + "{", "{" + one, one + " ", "﻿" + one, one + "\x1c", "\x0b" + one]
    out += [one.replace("规", "\n"), one.replace("规", "\\ud800"), one.replace("规", "\\u00e9"), one.replace("规", "\\x"), one.replace("规", "'"), one.replace("规", "\x7f"), one.replace("规", "\x01")]
    out += [one[:-1] + ',"decision":"allow_refund"}', one[:-1] + ',"more":{"a":1,"a":2}}', one[:-1] + ',"more":' + "[" * 1200 + "]" * 1200 + "}", one[:-1] + ',"more":' + "9" * 1200 + "}", one[:-1] + ',"more":01}', one[:-1] + ',"more":[1,]}']
    out += ["[" * d + "]" * d for d in (150, 250, 998, 999, 1000, 1001)] + ['{"intent":{"a":1,"a":2},"decision":"deny"}', one + "] x", one + "],[" + one, one + "," + one, one + ', "A"']
    for fence in ("```json\n%s\n```", "```%s```", "``` JSON %s", "```JSON%s\r\n```\n", "%s\n```", "say ```json\n%s```", "My answer: %s", "%s Thanks!", "{ %s }", "\t%s　", "```json\x85%s\x85```"):
        out.append(fence % one)
    for _ in range(1200):
        new = dict(GOOD)
        for _ in range(r.randint(0, 2)):
            new[r.choice(list(GOOD))] = r.choice(values)
        if r.random() < 0.3:
            new.pop(r.choice(list(new)))
        if r.random() < 0.3:
            new["Decision"] = r.choice(values)
        text = json.dumps(new, ensure_ascii=r.random() < 0.5)
        if r.random() < 0.5:
            at = r.randrange(len(text))
            text = text[:at] + r.choice(["", '"', "'", "\\", "{", "}", "[", "]", ",", "\n", " ", "`", "0", " "]) + text[at + r.randint(0, 1) :]
        out.append(r.choice(["%s", "%s", "```json\n%s\n```", "x %s", "%s }"]) % text)
    return out


def differences(spark, rows, mode):
    df = spark.createDataFrame(list(enumerate(rows)), "k int, prediction string")
    names = ["errors", "json_valid", "got"]
    new = scoring.read_answers(df, mode)
    old = scoring.read_columns(df, F.col("prediction"), mode)
    show = lambda d: {r["k"]: (r["errors"], r["json_valid"], tuple(r["got"])) for r in d.select("k", *names).collect()}
    a, b = show(new), show(old)
    return [(rows[k], a[k], b[k]) for k in b if a[k] != b[k]]


@pytest.mark.parametrize("mode", ["offline", "online"])
def test_batches_against_columns(spark, mode):
    assert differences(spark, texts(), mode) == []


def test_equal_texts_are_read_once(monkeypatch):
    seen, one = [], reading.read
    monkeypatch.setattr(reading, "read", lambda text, online: seen.append(text) or one(text, online))
    found = reading.read_batch(pa.array([json.dumps(GOOD), "no", None, "no", json.dumps(GOOD)]), False)
    assert sorted(seen) == sorted(["no", json.dumps(GOOD)])
    assert [f and f["errors"] for f in found.to_pylist()] == [[], ["not_json"], None, ["not_json"], []]
