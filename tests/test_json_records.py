"""JSON as Python reads it, users' catalogues, VARIANT values and the log of replies."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from formloom import job, record_queries, sinks
from formloom.functions import json as J
from formloom.operators import fill
from formloom.plans import catalog
from formloom.sources import remote, replies

ODD = ["", '"', '"a""b"', "01", "1 2", "-", "1.", '"\n"', '{"a":}', "{,}", "[1,]", "﻿1", "truefalse", '"\\x"', '"\\u12"', "nan", "{'a':1}", "-0", "1E+5", ".5", "+1", '{"a":1 "b":2}', "{1:2}", "Infinity", "-Infinity", '{"a":1}{', '{"a":1} zz', "\xa01", '"\\ud800"', "[" * 200 + "]" * 200, "[" * 50 + "]" * 49, "][", '{"a":1,"a":NaN}\n', '"' + "\\n" * 100_000 + '"', "[" + ",".join('{"a":"b\\"c"}' for _ in range(10_000)) + "]"]


def is_json(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def test_is_json(spark):
    rng, texts = random.Random(0), list(ODD)
    whole = json.dumps({"a": [1, -2.5e3, None, True, 'x"y\\', {"b": {}}], "c": float("nan")})
    for _ in range(800):
        k = rng.randrange(len(whole))
        texts.append(rng.choice((whole[:k] + whole[k + 1 :], whole[:k] + rng.choice('{}[],:"0 1aNt\\') + whole[k:], whole)))
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    found = df.select("t", J.is_json(F.col("t")).alias("ok")).collect()
    assert [(r.t, r.ok) for r in found if r.t is not None and r.ok != is_json(r.t)] == []
    assert sum(bool(r.ok) for r in found) > 200 and not any(r.ok for r in found if r.t is None)


def test_members_keep_type_and_spelling(spark):
    text = '{"s":"\\u0001a\\u0002\\"","n":1.50,"big":12345678901234567890.10,"i":-7,"e":2E5,"x":NaN,"t":true,"z":null,"o":{"k" : [1.0,"\\u0001",null,{}]},"l":[],"e2":"","s":"last"}'
    row = spark.createDataFrame([(text,)], "t string").select(J.marked(F.col("t")).alias("w")).selectExpr(J.members("w") + " AS m")
    got = lambda n: row.selectExpr(J.has("m", n), J.kind_of(J.member("m", n)), J.text_of(J.member("m", n))).first()
    want = {"s": (True, "string", "last"), "n": (True, "float", "1.50"), "big": (True, "float", "12345678901234567890.10"), "i": (True, "integer", "-7"), "e": (True, "float", "2E5"), "x": (True, "float", "NaN"), "t": (True, "boolean", "true"), "z": (True, "null", None), "o": (True, "object", '{"k":[1.0,"\\u0001",null,{}]}'), "l": (True, "array", "[]"), "e2": (True, "string", ""), "absent": (False, "null", None)}
    assert {n: tuple(got(n)) for n in want} == want


def test_catalogues(spark):
    made = record_queries.user_catalogue()
    assert [e.column for e in made.entries][-3:] == ["person__profile__address__city", "person__profile__address__known", "person__note"]
    assert made.entries[5].field == "profile.address.city" and made.objects()[-1] == ("PERSON", "profile", "address")
    assert made.record_type()["PERSON"].dataType["profile"].dataType["id"].dataType.simpleString() == "bigint"
    assert [e.column for e in catalog.CATALOGUE.entries] == [catalog.flat_name(f) for f in catalog.FIELDS]
    for bad in ({"s": 3}, [1], {"s": {"f": 3}}, {"s": {"f": {"type": 4}}}, {"s": {"a": {}, "A": {}}}):
        with pytest.raises(ValueError):
            catalog.compiled(bad)
    # names with dots and accents, a section without fields, and columns of the table with clashing names
    odd = catalog.compiled({"a.b": {"c`d": {"type": "boolean"}}, "none": {}, "é": {"x y": {"properties": {"z": {}}}}})
    df = spark.createDataFrame([(1, '{"a.b":{"c`d":true},"é":{"x y":{"z":"v"}}}'), (2, None)], "_object int, js string").withColumn("k.e", F.lit(3))
    flat = fill.filled(df, "js", ["_object", "k.e"], catalogue=odd)
    assert [tuple(r) for r in flat.orderBy("_object").collect()] == [(1, 3, True, "v"), (2, 3, False, None)]
    assert json.loads(flat.where("_object = 1").select(F.to_json(odd.struct())).first()[0]) == {"a.b": {"c`d": True}, "none": {}, "é": {"x y": {"z": "v"}}}
    assert fill.filled_values(df.limit(0), "js", ["_object"], odd).collect() == [] and fill.filled_variants(df, "js", [], odd).count() == 2


def test_variants(spark):
    df = spark.createDataFrame([('{"s":{"a":{"x":1,"x":2},"b":[NaN],"c":Infinity,"d":"1","e":null}}',)], "js string")
    made = catalog.compiled({"s": {x: {} for x in "abcdef"}})
    row = fill.filled_variants(df, "js", [], made).select(*(F.schema_of_variant(f"s__{x}") for x in "abcdef")).first()
    assert tuple(row) == ("STRING", "STRING", "DOUBLE", "STRING", "VOID", "VOID")


def reply(text):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


def counting(folder, fail=False):
    """Notes each call in a file of its own; with ``fail`` the worker dies at the call of the last document."""

    def transport(body, timeout):
        import uuid

        name = json.loads(body)["contents"][0]["parts"][0]["text"].removeprefix(remote.PROMPT)
        if fail and name == "d9":
            import time

            time.sleep(3)
            os._exit(1)
        open(f"{folder}/{name}-{uuid.uuid4().hex}", "w").close()
        if name == "d0":
            raise ConnectionError("secret")
        return 200, reply(json.dumps({"THONG_TIN_CA_NHAN": {"ho_va_ten": name}}))

    return transport


def calls(folder):
    return sorted(x.split("-")[0] for x in os.listdir(folder))


@pytest.fixture
def documents(spark):
    return spark.createDataFrame([(f"p{i}", f"d{i % 10}") for i in range(14)], "path string, text string")


def test_each_request_is_sent_once(spark, documents, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    log = f"file://{tmp_path}/log"
    records = remote.extract_remote(documents, counting(folder), ["path"], log=log)
    assert records.count() == 14 and records.where("status = 'ok'").count() == 12 and records.where("error like '%ConnectionError'").count() == 2
    sinks.write_records(records, f"file://{tmp_path}/out", ["path", "status", "error"])
    assert calls(folder) == [f"d{i}" for i in range(10)]  # equal texts are one request, and three actions send nothing
    assert remote.extract_remote(documents, counting(folder), ["path"], log=log).count() == 14 and len(calls(folder)) == 10
    assert not os.path.exists(tmp_path / "log" / "pending")
    # what failed is sent again only if asked for
    requests = documents.select(remote.request_body(F.col("text")).alias("request"))
    replies.send_once(requests, counting(folder), log, again=True)
    assert calls(folder).count("d0") == 2 and len(calls(folder)) == 11


def test_what_a_failed_run_was_told_is_not_asked_again(spark, documents, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    log = f"file://{tmp_path}/log"
    with pytest.raises(Exception):
        remote.extract_remote(documents, counting(folder, fail=True), ["path"], log=log)
    before = calls(folder)
    assert before and "d9" not in before
    assert remote.extract_remote(documents, counting(folder), ["path"], log=log).count() == 14
    assert calls(folder) == [f"d{i}" for i in range(10)]


def test_job_sends_once(spark, documents, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    docs = documents.withColumn("status", F.lit("ok")).withColumn("error", F.lit(None).cast("string"))
    records = job.records_of(docs, counting(folder), "key", log=f"file://{tmp_path}/log")
    assert records.count() == records.count() == 14 and len(calls(folder)) == 10


def test_replies_that_break(spark):
    bodies = {
        "list": "[]", "number": "3", "zero": '{"candidates":0}', "text": '{"candidates":"abc"}', "object": '{"candidates":{"a":1}}', "no content": '{"candidates":[{}]}', "null": '{"candidates":[{"content":null}]}',
        "no parts": '{"candidates":[{"content":{"parts":[]}}]}', "not a text": '{"candidates":[{"content":{"parts":[{"text":5}]}}]}', "trailing": reply("{}") + "x", "good": reply(" {} "),
    }
    df = spark.createDataFrame([(k, 200, v, None) for k, v in bodies.items()], "k string, http_status int, body string, error string")
    found = {r.k: r.error for r in remote.unpacked(df, ["k"]).collect()}
    assert found.pop("good") is None and found.pop("zero") == remote.EMPTY_REPLY and set(found.values()) == {remote.FAILED}
