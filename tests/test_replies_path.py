"""The one parse of a usual reply against Python's own reading, and where it must leave a reply to the other steps."""

import json

import pytest
from pyspark.sql import functions as F

from formloom import catalogue_queries as c
from formloom.functions import json as J
from formloom.session import load
from formloom.sources import remote

NAMES = ("candidates", "content", "parts", "text")


def body(part='{"text":"{\\"EVENT\\":{\\"k\\":7}}"}', content='{"parts":[%s]}', first='{"content":%s}', root='{"candidates":[%s]}'):
    return root % (first % (content % part if "%s" in content else content) if "%s" in first else first) if "%s" in root else root


USUAL = [
    body(),
    body(root='{"a":[1,{"b":null}],"candidates":[%s,{"x":1}],"n":NaN}'),
    body(content='{"role":"model","parts":[%s,{"y":{"z":[]}}]}'),
    body(part='{"text":"a \\u0001 b \\"candidates\\" \\\\\\" c","t":1}'),
    ' {"candidates" : [ {"content":{"parts":[ {"text" : "{}"} ]}} ] }\n',
]
ODD = [
    body(part='{"text":"x","text":"{\\"EVENT\\":{\\"k\\":8}}"}'),
    body(part='{"text":"x","text":null}'),
    body(first='{"content":{"parts":[{"text":"{}"}]},"content":3}'),
    body(root='{"candidates":[%s],"candidates":[]}'),
    body(root='{"candidates":0,"candidates":[%s]}'),
    body(content='{"parts":[{"text":null}],"other":{"text":"{}"}}'),
    body(part='3,{"text":"{}"}'),
    body(content='{"parts":{"text":"{}"}}'),
    body(first="null,{\"content\":{\"parts\":[{\"text\":\"{}\"}]}}"),
    body(root='{"x":{"candidates":[%s]}}'),
    body(root='{"candidates":[]}'),
    body(part='{"text":""}'),
    body(part='{"text":{"a":1}}'),
    body(part='{"text":1.50}'),
    body(root="[%s]"),
    body() + " zz",
    "oops",
]


def by_python(text):
    """The status and EVENT.k, as Python reads a reply."""
    try:
        said = json.loads(text)["candidates"][0]["content"]["parts"][0]["text"]
        record = json.loads(said) if isinstance(said, str) else None
        if not isinstance(said, str):
            return "error", None
    except (ValueError, KeyError, IndexError, TypeError):
        return "error", None
    return "ok", record["EVENT"]["k"] if isinstance(record, dict) and "EVENT" in record else None


def test_usual_replies_take_one_parse(spark):
    df = spark.createDataFrame(list(enumerate(USUAL)), "i int, body string").select("i", J.single_path(J.marked(F.col("body")), NAMES).alias("v"))
    read = {r.i: r.v for r in df.select("i", F.expr(J.text_of("v")).alias("v")).collect()}
    assert read == {i: json.loads(x)["candidates"][0]["content"]["parts"][0]["text"] for i, x in enumerate(USUAL)}


def test_odd_replies_read_as_python_does(spark):
    df = spark.createDataFrame([(i, 200, x, None) for i, x in enumerate(USUAL + ODD)], "i int, http_status int, body string, error string")
    found = {r.i: (r.status, r.EVENT__k) for r in remote.unpacked(df, ["i"], catalogue={"EVENT": {"k": {"type": "integer"}}}).collect()}
    assert found == {i: by_python(x) for i, x in enumerate(USUAL + ODD)}


@pytest.mark.parametrize("name", ["remote_replies_catalogue", "remote_replies", "fill_user_catalogue", "fill_defaults"])
def test_replies_and_records_are_spread(spark, name):
    rows = c.QUERIES[name](spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id()).count().collect()
    assert len(load(spark, "/root/testdata/sf0.01", "events").groupBy(F.spark_partition_id()).count().collect()) == 1
    assert len(rows) == 4
