import hashlib
import hmac
import json
import re
import struct

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventspark.functions import binary_codecs, codecs, fields, grok, regex
from eventspark.functions import conditions as c
from eventspark.operators import lookups, mutate, network, parse, rows, script, shape
from eventspark.plans import pipeline
from eventspark.sinks import writers
from eventspark.sources import services, tables
from eventspark.streaming import state


def one(df):
    return df.first().asDict(recursive=True)


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, message string")


# fields, templates, conditions

def test_paths():
    assert fields.segments("a.b") == fields.segments("[a][b]") == ["a", "b"]
    with pytest.raises(ValueError):
        fields.segments("[a]b")


def test_nested_set_and_remove(spark):
    df = fields.with_field(lines(spark, "x"), "[a][b][c]", F.lit(1))
    df = fields.with_field(df, "a.d", F.lit("y"))
    assert one(df)["a"] == {"b": {"c": 1}, "d": "y"}
    assert one(fields.without_field(df, "a.b.c"))["a"] == {"d": "y"}


def test_template_keeps_what_is_absent(spark):
    df = lines(spark, None).withColumns({"n": F.lit(2.0), "tags": F.array(F.lit("p"), F.lit("q")), "o": F.struct(F.lit(1).alias("k"))})
    assert df.select(fields.template(df, "%{n}/%{o}/%{tags}/%{nope}/%{message}/")).first()[0] == '2/{"k":1}/p,q/%{nope}//'


def test_event_json(spark):
    df = spark.sql("SELECT 1 AS a, timestamp'2024-01-02 03:04:05.678' AS `@timestamp`, cast(array() AS array<string>) AS tags, named_struct('x', 1) AS `@metadata`")
    assert json.loads(df.select(fields.event_json(df)).first()[0]) == {"a": 1, "@timestamp": "2024-01-02T03:04:05.678Z", "@version": "1"}


def test_conditions_are_never_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", 3)], "id long, s string, n long")
    tests = [c.eq("s", "a"), c.ne("s", "a"), c.compare("n", ">", 2), c.matches("s", "a"), c.not_matches("s", "a"), c.is_in("s", ["a"]), c.exists("s"), c.truthy("n"), c.eq("s", 1), c.eq("n", "3")]
    out = [tuple(r) for r in df.orderBy("id").select(*(t(df).alias(str(k)) for k, t in enumerate(tests))).collect()]
    assert out[0] == (False, True, False, False, True, False, False, False, False, False)
    assert out[1] == (True, False, True, True, False, True, True, True, False, False)


def test_where_keeps_other_rows(spark):
    df = lines(spark, "a", "b")
    out = c.where("message = 'a'", mutate.mutate(uppercase=["message"], add_field={"new": "x"}, remove_field=["id"]))(df)
    assert sorted((r.message, r.new, r.id) for r in out.collect()) == sorted([("A", "x", None), ("b", None, 1)], key=str)
    gone = c.where("message = 'a'", rows.drop())(df)
    assert [r.message for r in gone.collect()] == ["b"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=5))
def test_branches_are_exclusive(truths):
    class Fake:
        pass

    # in plain logic: exactly the first true branch
    first = truths.index(True) if True in truths else None
    taken = [t and not any(truths[:k]) for k, t in enumerate(truths)]
    assert [k for k, t in enumerate(taken) if t] == ([] if first is None else [first])


# regular expressions and grok

def test_group_names():
    assert regex.group_names(r"(?P<a>x)(y)(?:z)(?<b>[(])\(") == ["a", None, "b"]
    assert regex.java(r"(?P<a>x)[[]") == r"(x)[\[]"


SAMPLES = {"INT": "-12", "NUMBER": "3.5", "IP": "10.1.2.3", "WORD": "abc", "UUID": "123e4567-e89b-12d3-a456-426614174000", "TIMESTAMP_ISO8601": "2024-01-02T03:04:05Z", "LOGLEVEL": "ERROR", "QS": '"a \\" b"', "MAC": "00:1b:44:11:3a:b7", "HTTPDATE": "01/Jan/2024:10:00:00 +0000", "PATH": "/a/b-c", "EMAILADDRESS": "a.b@c.org"}


def test_patterns(spark):
    for name, text in SAMPLES.items():
        df = lines(spark, f"<{text}>").transform(parse.grok("message", f"<%{{{name}:v}}>"))
        assert one(df)["v"] == text, name
    assert all(re.compile(p) for p in grok.PATTERNS.values())


def test_grok_rules(spark):
    df = lines(spark, "k=1 e=", "nothing", None, "ключ=2 e=x").withColumn("e", F.lit("old"))
    out = df.transform(parse.grok("message", [r"k=%{INT:n:int} e=(?<e>\w*)", r"ключ=%{INT:n:int}"], overwrite=["e"])).orderBy("id").collect()
    assert [r.n for r in out] == [1, None, None, 2]
    assert [r.e for r in out] == ["old", "old", "old", "old"]
    assert [r.tags for r in out] == [[], ["_grokparsefailure"], ["_grokparsefailure"], []]


def test_dissect_skips_and_takes_the_rest(spark):
    df = lines(spark, "a - b  [c] d e").transform(parse.dissect("message", "%{x} - %{y->}  [%{?skip}] %{rest}"))
    assert {k: one(df)[k] for k in ("x", "y", "rest")} == {"x": "a", "y": "b", "rest": "d e"}


def test_json_that_is_no_object(spark):
    df = lines(spark, "[1]", "{", '{"a": "x"}', '{"a": 5}').transform(parse.json("message", "a string")).orderBy("id")
    assert [r.a for r in df.collect()] == [None, None, "x", "5"]
    assert [r.tags for r in df.collect()] == [[], ["_jsonparsefailure"], [], []]


def test_dates(spark):
    cases = {"ISO8601": "2024-02-03T04:05:06.789+01:00", "UNIX": "1700000000", "UNIX_MS": "1700000000123", "yyyy/MM/dd HH:mm": "2024/02/03 04:05", "%d/%b/%Y": "03/Feb/2024"}
    wanted = ["2024-02-03T03:05:06.789Z", "2023-11-14T22:13:20.000Z", "2023-11-14T22:13:20.123Z", "2024-02-03T04:05:00.000Z", "2024-02-03T00:00:00.000Z"]
    for (pattern, text), out in zip(cases.items(), wanted, strict=True):
        assert one(lines(spark, text).transform(parse.date("message", [pattern], target="t")))["t"] == out, pattern


# values

@pytest.mark.parametrize(("text", "size", "out"), [("abc", 3, "abc"), ("aé", 2, "a"), ("aé", 3, "aé"), ("€€", 5, "€"), ("😀x", 3, ""), ("", 4, "")])
def test_truncate(spark, text, size, out):
    assert one(lines(spark, text).transform(shape.truncate(["message"], size)))["message"] == out


def test_hashes(spark):
    row = one(spark.createDataFrame([("x", None)], "a string, b string").transform(shape.fingerprint(["a", "b"], "h", key="k" * 100)).transform(shape.fingerprint(["b"], "none")))
    assert row["h"] == hmac.new(b"k" * 100, b"x", hashlib.sha256).hexdigest()
    assert row["none"] is None
    assert shape.murmur32(b"hello") == 613153351
    assert shape.murmur32(b"") == 0 and shape.murmur32(b"hello, world") == 345750399
    for algorithm in ("MD5", "SHA1", "SHA384", "SHA512"):
        got = one(lines(spark, "x").transform(shape.anonymize(["message"], algorithm, "key")))["message"]
        assert got == hmac.new(b"key", b"x", algorithm.lower()).hexdigest()


def test_networks(spark):
    df = spark.createDataFrame([("2001:db8::1",), ("10.0.0.1",), ("bad",), (None,)], "ip string")
    assert [r[0] for r in df.select(network.in_networks(F.col("ip"), ["10.0.0.0/8", "2001:db8::/32"])).collect()] == [True, True, False, False]


def test_clone_and_split_edges(spark):
    assert lines(spark, "x").transform(rows.clone(2)).count() == 3
    out = lines(spark, "a,b", "", None).transform(rows.split("message", ","))
    assert sorted(str(r.message) for r in out.collect()) == ["", "None", "a", "b"]


def test_script_errors_leave_the_row(spark):
    df = spark.createDataFrame([(1, 4), (2, None)], "id long, n long").transform(script.script({"n": "n * 2", "m": "n + 1"}))
    assert [(r.n, r.m, r.tags) for r in df.orderBy("id").collect()] == [(8, 9, []), (None, None, ["_scripterror"])]


def test_vectors_of_unlike_length(spark):
    df = spark.sql("SELECT array(1.0, 2.0) AS a, array(1.0) AS b, array(0.0, 0.0) AS z")
    row = df.select(script.dot_product(F.col("a"), F.col("b")), script.cosine_similarity(F.col("a"), F.col("z")), script.l2_norm(F.col("a"), F.col("z"))).first()
    assert row[0] is None and row[1] == 0.0 and row[2] == pytest.approx(5**0.5)


# keyed state

def test_throttle_windows_reopen(spark):
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0, 1, 2, 10, 11, 25])], "id long, k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    out = df.transform(state.throttle("%{k}", ["id"], "ts", after_count=1, period=10)).orderBy("id").collect()
    assert [bool(r.tags) for r in out] == [False, True, True, False, True, False]


def test_throttle_stream_orders_whole_keys(spark, tmp_path):
    rows = [(i, "ab"[i % 2]) for i in range(60)][::-1]
    df = spark.createDataFrame(rows, "id long, k string").withColumn("ts", F.timestamp_seconds("id"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        tagged = state.throttle_stream(stream, "%{k}", after_count=3, period=10**9, max_age=None, time="ts")
        writer = tagged.writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).format("parquet")
        writer.start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert [r.id for r in out] == list(range(60)) and [bool(r.tags) for r in out] == [i >= 6 for i in range(60)]


def test_external_sort_in_rounds():
    values = [(i * 7919) % 1009 for i in range(1000)]
    frames = [pd.DataFrame({"t": values[k : k + 3], "n": range(k, min(k + 3, 1000))}) for k in range(0, 1000, 3)]
    out = pd.concat(state._in_order(iter(frames), "t", rows=2, fan_in=4))
    assert out["t"].tolist() == sorted(values) and sorted(out["n"]) == list(range(1000))
    assert list(state._in_order(iter([]), "t")) == []


def test_multiline_both_ways(spark):
    df = lines(spark, "a", " b", "c", "d\\", "e")
    back = df.transform(state.multiline(r"^\s", ["id"])).orderBy("id")
    assert [r.message for r in back.collect()] == ["a\n b", "c", "d\\", "e"]
    ahead = df.transform(state.multiline(r"\\$", ["id"], what="next")).orderBy("id")
    assert [r.message for r in ahead.collect()] == ["a", " b", "c", "d\\\ne"]


# codecs

def test_msgpack_round_trip(spark):
    value = {"a": [1, -5, 2.5, None, True], "b": {"c": "é" * 40}}
    assert binary_codecs.msgpack_events(binary_codecs._write_msgpack(value)) == [value]
    with pytest.raises(ValueError):
        binary_codecs.msgpack_events(b"\xdd\xff\xff\xff\xff")


def test_fluent_forward_mode():
    data = binary_codecs._write_msgpack(["app", [[1, {"a": 1}], [2, {"a": 2}]]])
    assert binary_codecs.fluent_events(data) == [{"a": 1, "fluent_tag": "app", "fluent_time": 1}, {"a": 2, "fluent_tag": "app", "fluent_time": 2}]


def test_protobuf_avro_collectd_edn():
    assert binary_codecs.protobuf_fields(b"\x08\x96\x01\x12\x07testing") == {"field_1": 150, "field_2": "testing"}
    header = b"Obj\x01" + b"\x02" + b"\x14avro.codec" + b"\x08null" + b"\x00" + b"s" * 16 + b"\x04\x06abc"
    assert binary_codecs.avro_events(header)[0] | {"avro_schema": None} == {"avro_schema": None, "avro_codec": "null", "avro_block_count": 2, "avro_block_size": 3}
    part = lambda k, b: struct.pack(">HH", k, len(b) + 4) + b
    packet = part(0, b"host1\0") + part(2, b"cpu\0") + part(6, struct.pack(">HB", 1, 1) + struct.pack("<d", 1.5))
    assert binary_codecs.collectd_events(packet) == [{"collectd_type": "binary", "host": "host1", "plugin": "cpu", "value": 1.5}]
    assert binary_codecs.edn_events(b'{:a 1, :b [true nil "x"] ; note\n :c #{2.5} :d #inst "t"}') == [{"a": 1, "b": [True, None, "x"], "c": [2.5], "d": "t"}]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60), st.sampled_from(sorted(binary_codecs.DECODERS)))
def test_decoders_fail_in_the_known_ways(data, codec):
    try:
        binary_codecs.DECODERS[codec](data)
    except (ValueError, struct.error, IndexError, TypeError, OverflowError):
        pass


def test_flow_templates():
    template = struct.pack(">HHHHHHHH", 0, 16, 256, 2, 8, 4, 1, 4)
    data = struct.pack(">HH", 256, 12) + bytes([10, 0, 0, 1]) + struct.pack(">I", 99)
    packet = struct.pack(">HHIIII", 9, 2, 1, 2, 3, 4) + template + data
    known = {}
    out = binary_codecs.flow_packet(packet, known)
    assert out["ipv4_src_addr"] == "10.0.0.1" and out["in_bytes"] == 99 and (4, 256) in known


def test_undecodable_rows_are_tagged(spark):
    df = spark.createDataFrame([(bytearray(b"\xc1"),), (None,)], "data binary")
    assert all(r.tags == ["_codecfailure"] for r in binary_codecs.decode_binary(df, "data", "msgpack", "a long").collect())
    assert one(codecs.decode_cef(lines(spark, "not cef"), "message"))["tags"] == ["_codecfailure"]
    assert one(codecs.decode_graphite(lines(spark, "# c"), "message"))["tags"] == ["_codecfailure"]


# pipelines, sources, sinks

def test_unknown_filter_shows_at_once():
    with pytest.raises(ValueError):
        pipeline.compile_filters([{"use": "nope"}])


def test_expand_env():
    assert pipeline.expand_env("${A}-${B:x}-${C}", {"A": "1"}) == "1-x-${C}"


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in.log").write_text("a\nb\n")
    (tmp_path / "skip.log").write_text("c\n")
    df = tables.lines(spark, str(tmp_path / "*.log"), exclude=["^skip"], add_field={"k": "v"}, tags=["t"])
    assert sorted((r.message, r.k, r.tags[0]) for r in df.collect()) == [("a", "v", "t"), ("b", "v", "t")]
    writers.routed(df, [("message = 'a'", writers.text_files(str(tmp_path / "a"), "%{message}!")), (None, writers.csv_files(str(tmp_path / "b"), ["message", "k"])), (None, writers.null)])
    assert [r.value for r in spark.read.text(str(tmp_path / "a")).collect()] == ["a!"]
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "b")).collect()) == ["a,v", "b,v"]


def test_polled_sources_and_services(spark, tmp_path):
    def poll(cursor):
        n = int(cursor or 0)
        return ([(f"m{k}", "x") for k in range(n, n + 2)], str(n + 2)) if n < 4 else ([], cursor)

    assert services.queue(spark, "fake_queue", poll, stream=False).count() == 4
    got = services.http_poller(spark, {"one": "u1", "two": "u2"}, get=lambda url: f"body of {url}")
    assert sorted(tuple(r) for r in got.collect()) == [("body of u1", "one"), ("body of u2", "two")]
    out = str(tmp_path / "sent")

    def session():
        return lambda texts: open(out, "a").write("|".join(texts) + "\n") and None

    df = spark.range(5).coalesce(1).select(F.col("id").alias("n"))
    writers.elasticsearch("h", "i-%{n}", doc_id="%{n}", session=session, batch=2)(df)
    assert len(open(out).read().split('{"index"')) == 6
    assert services.body_events('[{"a":1},2]') == ['{"a": 1}', "2"] and services.body_events("x\n\ny") == ["x", "y"]


def test_translate_by_table_of_any_size(spark):
    big = {f"k{i}": f"v{i}" for i in range(lookups.LITERALS + 1)}
    df = lines(spark, "k7", "no").transform(lookups.translate("message", big, "t", fallback="?"))
    assert [r.t for r in df.orderBy("id").collect()] == ["v7", "?"]


def test_batch_equals_stream(spark, tmp_path):
    df = spark.range(20).select(F.concat(F.lit("n="), "id").alias("message"), F.col("id"))
    df.write.parquet(str(tmp_path / "in"))
    op = pipeline.compile_filters([{"use": "grok", "with": {"source": "message", "patterns": "n=%{INT:n:int}"}}, {"use": "drop", "if": "n % 2 = 1"}])
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).transform(op)
    writers.on_batches(stream.select("id", "n"), [(None, lambda b: b.write.mode("append").parquet(str(tmp_path / "out")))], str(tmp_path / "log")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, df.transform(op).select("id", "n").collect()))


# parameters, exact columns, addresses

def test_named_parameters_leave_text_alone():
    from eventspark.functions.fields import named_parameters, sql_literal

    text = "SELECT ':n', \":n\", `:n`, a::int, x:n, :n, :name -- :n\n/* :n */"
    assert named_parameters(text, {"n": "1", "name": "2"}) == "SELECT ':n', \":n\", `:n`, a::int, x:n, 1, 2 -- :n\n/* :n */"
    assert [sql_literal(x) for x in (None, True, 3, 1.5, "it's \\", [1, "a"])] == ["NULL", "true", "3", "1.5D", "'it\\'s \\\\'", "array(1, 'a')"]


def test_script_parameters_and_errors(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 2)], "a int, b int")
    rows = script.script({"c": "b + 1", "d": "a div nullif(b, 0) + :n", "t": "':n' || :name"}, {"n": 5, "name": "x"})(df).orderBy("a").collect()
    assert [(r.c, r.d, r.t, list(r.tags)) for r in rows] == [(None, None, None, ["_scripterror"]), (None, None, None, ["_scripterror"]), (3, 6, ":nx", [])]
    with pytest.raises(ValueError):
        script.script({"a ^=": "1"})(df)


BIG = [None, 9007199254740993, 1152921504606846983, -9007199254740993]


def test_throttle_leaves_other_columns_as_they_are(spark):
    rows = [(k, "ab"[k % 2], 1000.0 + 10 * k if k % 11 else None, BIG[k % 4], [BIG[k % 4], k]) for k in range(200)]
    df = spark.createDataFrame(rows, "i long, k string, t double, big long, list array<long>").withColumn("@timestamp", F.timestamp_seconds("t"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = state.throttle("%{k}", ["i"], after_count=2, period=95)(df).orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted, open_ = [], {}
    for _, k, t, *_ in rows:
        start, n = open_.get(k, (None, 0))
        if k not in open_ or start is not None and t is not None and t - start >= 95:
            start, n = t, 0
        open_[k] = (start, n + 1)
        wanted.append(["_throttle"] if n + 1 > 2 else [])
    assert [list(r.tags) for r in out] == wanted
    assert [(r.i, r.k, r.t, r.big, r.list) for r in out] == rows


def test_streams_leave_other_columns_as_they_are(spark, tmp_path):
    rows = [(k, "ab"[k % 2], BIG[k % 4], [BIG[k % 4], k], k / 4, k % 9 == 8) for k in range(90)]
    df = spark.createDataFrame(rows, "i long, k string, big long, list array<long>, part double, last boolean").withColumn("@timestamp", F.timestamp_seconds("i"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))

    def ran(out, name):
        out.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-log")).trigger(availableNow=True).format("parquet").start(str(tmp_path / name)).awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        got = ran(state.throttle_stream(read(), "%{k}", after_count=3, period=10**6, max_age=None), "throttled").orderBy("i").collect()
        maps = ran(state.aggregate_stream(read(), "%{k}", ["i", "big", "list", "part"], "last", order="i", timeout=None), "maps").orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.i, r.k, r.big, r.list, r.part, r.last) for r in got] == rows
    assert [list(r.tags) for r in got] == [["_throttle"] if i // 2 >= 3 else [] for i in range(90)]
    held, wanted = {}, []
    for i, k, big, list_, part, last in rows:
        held.setdefault(k, {}).update({n: v for n, v in (("i", i), ("big", big), ("list", list_), ("part", part)) if v is not None})
        if last:
            m = held.pop(k)
            wanted.append((m["i"], m.get("big"), m["list"], m["part"], k))
    assert [(r.i, r.big, r.list, r.part, r.task_id) for r in maps] == wanted


def test_addresses_of_both_families(spark):
    import ipaddress

    texts = ["::", "::1", "1::", "2001:db8::8:800:200C:417A", "fe80::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4", "fc00::"]
    bad = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "1.2.3.4", "::1.2.3", "::1.2.3.256", "1:2", None, "::1 "]
    df = spark.createDataFrame([(t,) for t in texts + bad], "t string")
    got = [r.d for r in df.select(network.ipv6_text(F.col("t")).alias("d")).collect()]
    assert got == [f"{int(ipaddress.ip_address(t)):032x}" for t in texts] + [None] * len(bad)
    inside = df.where(network.in_networks(F.col("t"), ["fc00::/7", "fe80::/10", "1.0.0.0/8"])).collect()
    assert {r.t for r in inside} == {"fe80::1", "fc00::", "1.2.3.4"}


def test_dns_appends_to_lists(spark):
    df = spark.createDataFrame([(["a", "b"],), (["x"],), (None,)], "names array<string>")
    out = network.dns("names", lambda: {"a": "1.1.1.1"}.get, action="append")(df).collect()
    assert sorted((str(r.names), str(r.tags)) for r in out) == [("None", "[]"), ("['a', 'b', '1.1.1.1']", "[]"), ("['x']", "['_dnsfailure']")]


def test_memcached_set_writes_each_key_once(spark, tmp_path):
    folder = str(tmp_path)

    def client():
        return lambda k, v: open(f"{folder}/{k}", "a").write(v + "\n")

    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c")], "id long, name string")
    lookups.memcached_set({"name": "user-%{id}", "nowhere": "x"}, client)(df)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"user-1": "b\n", "user-3": "c\n"}


def test_convert_can_keep_what_is_no_number(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,)], "a string")
    out = mutate.convert({"a": "integer"}, keep_value=True)(df).select(F.to_json("a").alias("j")).collect()
    assert [r.j for r in out] == ["12", '"x"', None]


def test_multiline_cuts_by_bytes(spark):
    df = spark.createDataFrame([(k, "start" if k == 0 else f" line{k}") for k in range(7)], "i int, message string")
    out = state.multiline(r"^\s", ["i"], max_bytes=14)(df).orderBy("i").collect()
    assert [r.lines for r in out] == [3, 2, 2]


def test_drop_in_a_branch_reaches_its_rows_only(spark):
    from eventspark.plans import pipeline

    df = spark.range(10).withColumn("x", F.col("id") % 3)
    spec = {"branches": [{"if": "x = 0", "then": [{"use": "mutate", "with": {"replace": {"y": "zero"}}}, {"use": "drop", "if": "id > 3"}]}, {"if": "id > 5", "then": [{"branches": [{"if": "x = 1", "then": [{"use": "drop"}]}]}]}]}
    assert sorted((r.id, r.y) for r in pipeline.step(spec)(df).collect()) == [(0, "zero"), (1, None), (2, None), (3, "zero"), (4, None), (5, None), (8, None)]


def test_statement_sink_runs_for_every_row(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id TEXT PRIMARY KEY, name TEXT, nowhere TEXT)")
    df = spark.createDataFrame([(k, f"n{k % 3}" if k % 4 else None) for k in range(20)], "id long, name string").coalesce(1)
    write = writers.statement(lambda: __import__("sqlite3").connect(path), "INSERT OR REPLACE INTO t VALUES (?, ?, ?)", ["id", "name", "nowhere"], batch=7)
    write(df)
    write(df)
    with sqlite3.connect(path) as db:
        got = db.execute("SELECT * FROM t ORDER BY CAST(id AS INT)").fetchall()
    assert got == [(str(k), f"n{k % 3}" if k % 4 else None, None) for k in range(20)]


def test_command_and_intake_sinks(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, message string").coalesce(1)
    writers.command(["sh", "-c", f"cat >> {out}"], "%{id}:%{message}")(df)
    assert open(out).read() == "1:a\n2:b\n"
    sent = str(tmp_path / "sent")
    writers.log_intake("", "k", "app", session=lambda: lambda texts: open(sent, "a").write("\n".join(texts)))(df)
    assert [x["message"] for x in json.loads(open(sent).read())] == ["a", "b"]
