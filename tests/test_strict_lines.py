"""Lines that hold more than one object, or a declared field twice."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerlight.sources import logs

LINE = '{"timestamp":"2024-01-01T00:00:00Z","type":"assistant","message":{"model":"m","usage":{"input_tokens":3}}}'


def events(spark, *lines):
    return logs.parse(spark.createDataFrame([(x, "s.jsonl") for x in lines], "value string, session_file string")).count()


@pytest.mark.parametrize("rest", [" x", "x", "]", "}", "]]", ",", ",{}", ',"end of line"', '],["x"', "{}", "null", "0", "\\", '"'])
def test_text_behind_the_object(spark, rest):
    assert events(spark, LINE + rest) == 0


@pytest.mark.parametrize("rest", ["", " ", "\t", "\r", " \t\r "])
def test_blanks_behind_the_object(spark, rest):
    assert events(spark, " " + LINE + rest) == 1


def with_field(path, text):
    """LINE with ``text`` put first into the object at ``path``."""
    at = LINE.index("{") if not path else LINE.index(f'"{path}":{{') + len(path) + 3
    return LINE[: at + 1] + text + "," + LINE[at + 1 :]


def test_fields_twice(spark):
    declared = [with_field("", '"type":"assistant"'), with_field("message", '"model":"m"'), with_field("usage", '"input_tokens":3'), with_field("message", '"content":[{"type":"x","type":"x"}]'), with_field("message", '"content":[{},{"input":{"new_string":"a","new_string":"a"}}]'), with_field("", '"toolUseResult":{"content":"a","content":"a"}'), with_field("", r'"type":"assistant"')]
    other = [with_field("", '"x":1,"x":2'), with_field("message", '"type":1,"type":2'), with_field("usage", '"model":1,"model":1'), with_field("", '"x":{"type":1,"type":2}'), with_field("message", '"content":[{"id":1,"id":2}]'), with_field("", '"message2":{"model":1,"model":1}')]
    for line in declared:
        assert events(spark, line) == 0, line
    for line in other:
        assert json.loads(line) and events(spark, line) == 1, line


def test_every_line_is_decoded_once(spark):
    df = logs.parse(spark.createDataFrame([(LINE, "s")], "value string, session_file string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_corrupt,StringType") == 1
    assert df.where(F.col("input") == 3).count() == 1
