"""Queries that apply every operator to the given tables, each with SQL that says the same (where SQL can)."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import binary_codecs, codecs
from .functions import conditions as c
from .operators import lookups, mutate, network, parse, rows, script, shape
from .plans import pipeline
from .sinks import writers
from .sources import tables
from .streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(df: DataFrame) -> DataFrame:
    """Tags as text, since results hold scalars."""
    return df.withColumn("tags", F.coalesce(F.array_join("tags", ","), F.lit(""))) if "tags" in df.columns else df


# ---------------------------------------------------------------------------------------------------
# the flagship: json, conditions, mutate, drop, tags, then a report

@query(
    "flagship_events",
    """WITH e AS (SELECT upper(event_type) AS event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'view')
SELECT event_type, count(*) AS events, CAST(sum(k) AS BIGINT) AS sum_k, count(*) FILTER (k >= 50) AS high, max(event_type || '-' || k) AS max_label FROM e GROUP BY event_type""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [
        {"use": "rename", "with": {"names": {"props": "message"}}},
        {"use": "json", "with": {"schema": "k bigint"}},
        {"use": "drop", "if": c.eq("event_type", "view")},
        {"use": "mutate", "with": {"uppercase": ["event_type"], "add_field": {"label": "%{event_type}-%{k}"}}},
        {"use": "mutate", "with": {"add_tag": ["high"]}, "if": "k >= 50"},
    ]
    done = _t(spark, sf_dir, "events").select("event_id", "event_type", "props").transform(pipeline.compile_filters(specs))
    high = F.count(F.when(F.array_contains("tags", "high"), 1))
    return done.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("k").alias("sum_k"), high.alias("high"), F.max("label").alias("max_label"))


# ---------------------------------------------------------------------------------------------------
# conditions

def _flagged(df: DataFrame, key: str, **tests: c.Condition) -> DataFrame:
    return df.select(key, *(t(df).alias(n) for n, t in tests.items()))


@query("cond_equality", "SELECT event_id, event_type = 'click' AS is_click, event_type <> 'click' AS not_click, user_id = 7 AS user7, false AS text_is_number, true AS absent_differs FROM events")
def _(spark, sf_dir):
    return _flagged(_t(spark, sf_dir, "events"), "event_id", is_click=c.eq("event_type", "click"), not_click=c.ne("event_type", "click"), user7=c.eq("user_id", 7), text_is_number=c.eq("event_type", 7), absent_differs=c.ne("nowhere", "x"))


@query("cond_compare", "SELECT event_id, value > 50 AS gt, value <= 12.5 AS le, event_id >= 10 AND NOT event_id < 5 AS ge, false AS text_gt FROM events")
def _(spark, sf_dir):
    ge = c.all_of(c.compare("event_id", ">=", 10), c.negate(c.compare("event_id", "<", 5)))
    return _flagged(_t(spark, sf_dir, "events"), "event_id", gt=c.compare("value", ">", 50), le=c.compare("value", "<=", 12.5), ge=ge, text_gt=c.compare("event_type", ">", 1))


@query("cond_regex", r"SELECT o_orderkey, regexp_matches(o_orderpriority, '^[12]-') AS urgent, NOT regexp_matches(o_orderpriority, 'LOW') AS not_low, true AS absent FROM orders")
def _(spark, sf_dir):
    return _flagged(_t(spark, sf_dir, "orders"), "o_orderkey", urgent=c.matches("o_orderpriority", r"^[12]-"), not_low=c.not_matches("o_orderpriority", "LOW"), absent=c.not_matches("nowhere", "x"))


@query("cond_membership", "SELECT event_id, event_type IN ('click', 'error') AS some, event_type NOT IN ('click', 'error') AS none_, event_type = 'error' AS tagged, true AS there, false AS gone FROM events")
def _(spark, sf_dir):
    df = c.where("event_type = 'error'", mutate.add_tag(["bad"]))(_t(spark, sf_dir, "events"))
    return _flagged(df, "event_id", some=c.is_in("event_type", ["click", "error"]), none_=c.not_in("event_type", ["click", "error"]), tagged=c.contains("bad", "[tags]"), there=c.exists("[user_id]"), gone=c.any_of(c.exists("nowhere"), c.truthy("nowhere")))


@query("cond_branches", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN o_totalprice > 200000 THEN 'alert' ELSE '' END AS tags FROM orders")
def _(spark, sf_dir):
    spec = {
        "branches": [
            {"if": "o_totalprice > 200000", "then": [{"use": "mutate", "with": {"add_field": {"severity": "high"}, "add_tag": ["alert"]}}]},
            {"if": "o_totalprice > 100000", "then": [{"use": "mutate", "with": {"add_field": {"severity": "medium"}}}]},
            {"then": [{"use": "mutate", "with": {"add_field": {"severity": "low"}}}]},
        ]
    }
    return _joined(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").transform(pipeline.step(spec))).select("o_orderkey", "severity", "tags")


# ---------------------------------------------------------------------------------------------------
# mutate

@query("mutate_case", "SELECT c_custkey, upper(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").transform(mutate.mutate(uppercase=["c_name"], lowercase=["c_mktsegment"]))


@query("mutate_rename_replace", "SELECT c_custkey AS id, 'customer ' || c_custkey || ' is ' || c_name || ' %{nowhere}' AS label, c_mktsegment AS segment FROM customer")
def _(spark, sf_dir):
    op = mutate.mutate(rename={"c_mktsegment": "segment"}, replace={"label": "customer %{c_custkey} is %{c_name} %{nowhere}"})
    return _t(spark, sf_dir, "customer").transform(op).select(F.col("c_custkey").alias("id"), "label", "segment")


@query("mutate_gsub", r"SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '#', 'g') AS p_name, regexp_replace(p_brand, '(\w+)#(\d+)', '\2-\1', 'g') AS p_brand FROM part")
def _(spark, sf_dir):
    op = mutate.gsub([("p_name", "[aeiou]+", "#"), ("p_brand", r"(\w+)#(\d+)", "$2-$1")])
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").transform(op)


@query(
    "mutate_convert",
    """SELECT event_id, event_id AS whole, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS partly, CAST(user_id AS DOUBLE) / 4 AS ratio, event_type = 'click' AS yes, CAST(user_id AS VARCHAR) AS text FROM events""",
)
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select(
        "event_id", F.col("event_id").cast("string").alias("whole"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string")).alias("partly"),
        (F.col("user_id") / 4).cast("string").alias("ratio"), F.when(F.col("event_type") == "click", "Yes").otherwise("no").alias("yes"), F.col("user_id").alias("text"),
    )
    return df.transform(mutate.convert({"whole": "integer", "partly": "integer", "ratio": "float", "yes": "boolean", "text": "string"}))


@query(
    "mutate_split_join",
    "SELECT p_partkey, array_to_string(string_split(p_type, ' '), '|') AS p_type, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS n, p_name AS kept FROM part",
)
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_name").alias("kept")).transform(mutate.split({"p_type": " "}))
    return df.withColumn("n", F.size("p_type").cast("long")).transform(mutate.join({"p_type": "|"}))


@query("mutate_copy_strip", "SELECT c_custkey, c_name AS backup, c_name AS padded, 'none' AS missing FROM customer")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("\t  "), "c_name", F.lit(" \n")).alias("padded"))
    return df.transform(mutate.mutate(copy={"c_name": "backup"}, strip=["padded"], coerce={"missing": "none"}, remove_field=["nowhere"])).drop("c_name")


@query("mutate_tags_merge", "SELECT n_nationkey, 'a,' || n_name || ',c' AS tags, n_name || '+' || n_regionkey AS merged FROM nation")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "nation").withColumn("region", F.col("n_regionkey").cast("string"))
    df = df.transform(mutate.merge({"n_name": "region"})).transform(mutate.join({"n_name": "+"})).withColumnRenamed("n_name", "merged").withColumn("n_name", F.split("merged", r"\+")[0])
    return _joined(df.transform(mutate.add_tag(["a", "%{n_name}", "b", "c", "a"])).transform(mutate.remove_tag(["b"]))).select("n_nationkey", "tags", "merged")


# ---------------------------------------------------------------------------------------------------
# parsing

@query(
    "grok_line",
    """SELECT l_orderkey, l_linenumber AS line, CAST(l_quantity AS DOUBLE) AS qty, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS flag, CASE WHEN l_returnflag = 'R' THEN '_grokparsefailure' ELSE '' END AS tags
FROM (SELECT l_orderkey, CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS l_quantity, l_returnflag FROM lineitem)""",
)
def _(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    text = F.concat_ws(" ", F.lit("line"), F.col("l_linenumber").cast("string"), F.lit("qty"), F.col("l_quantity").cast("string"), F.concat(F.lit("["), F.when(F.col("l_returnflag") == "R", "?").otherwise(F.col("l_returnflag")), F.lit("]")))
    df = li.select("l_orderkey", text.alias("message"))
    return _joined(df.transform(parse.grok("message", r"line %{INT:line:int} qty %{NUMBER:qty:float} \[%{WORD:flag}\]"))).select("l_orderkey", F.col("line").cast("int").alias("line"), "qty", "flag", "tags")


_ACCESS = "'10.0.0.' || (event_id % 250) || ' - ' || CASE WHEN user_id % 2 = 0 THEN '-' ELSE 'u' || user_id END || ' [01/Jan/2024:10:00:00 +0000] \"GET /' || event_type || '?id=' || event_id || ' HTTP/1.1\" ' || (200 + event_id % 3) || ' ' || (event_id * 7) || ' \"http://x.example/\" \"agent/' || user_id || '\"'"


@query(
    "grok_apache",
    """SELECT event_id, '10.0.0.' || (event_id % 250) AS clientip, 'GET' AS verb, '/' || event_type || '?id=' || event_id AS request, '1.1' AS httpversion, CAST(200 + event_id % 3 AS VARCHAR) AS response, CAST(event_id * 7 AS VARCHAR) AS bytes, 'agent/' || user_id AS agent, '2024-01-01T10:00:00.000Z' AS at FROM events""",
)
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.expr(_ACCESS).alias("message"))
    df = df.transform(parse.grok("message", "%{COMBINEDAPACHELOG}")).transform(parse.date("timestamp", ["dd/MMM/yyyy:HH:mm:ss Z"], target="at"))
    return df.select("event_id", "clientip", "verb", "request", "httpversion", "response", "bytes", "agent", "at")


@query("dissect_pipe", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_orderpriority AS rest, '' AS tags FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, '_dissectfailure' FROM orders WHERE o_orderkey % 5 = 0")
def _(spark, sf_dir):
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.lit("skipped"), "o_orderstatus", "o_orderpriority")
    df = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "no bars").otherwise(text).alias("message"))
    return _joined(df.transform(parse.dissect("message", "%{id}|%{?x}|%{status}|%{rest}"))).select("o_orderkey", "id", "status", "rest", "tags")


_KV = "'id=' || event_id || '&type=' || event_type || '&empty=&name=\"' || user_id || ' x\"' || CASE WHEN event_id % 2 = 0 THEN '&type=again' ELSE '' END"


@query("kv_pairs", "SELECT event_id, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'again' ELSE event_type END AS type, user_id || ' x' AS name, '' AS empty, CAST(NULL AS VARCHAR) AS other FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.expr(_KV).alias("message"))
    return df.transform(parse.kv("message", "&", "=", include_keys=["id", "type", "name", "empty", "other"])).drop("message")


@query("kv_map", "SELECT event_id, CAST(3 AS BIGINT) AS n, CAST(event_id AS VARCHAR) AS p_id, CASE WHEN event_id % 2 = 0 THEN 'again' ELSE event_type END AS p_type FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.expr(_KV).alias("message")).transform(parse.kv("message", "&", "=", exclude_keys=["name"], prefix="p_", target="kv"))
    return df.select("event_id", F.size("kv").cast("long").alias("n"), F.col("kv")["p_id"].alias("p_id"), F.col("kv")["p_type"].alias("p_type"))


@query("csv_columns", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, c_name || ', \"jr\"' AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS more FROM customer")
def _(spark, sf_dir):
    text = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', ""jr""",'), "c_mktsegment")
    df = _t(spark, sf_dir, "customer").select("c_custkey", text.alias("message"))
    return df.transform(parse.csv("message", ["id", "name", "segment", "more"])).drop("message")


@query("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 7 = 0 THEN '_jsonparsefailure' ELSE '' END AS tags FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS props FROM events)")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("message"))
    return _joined(df.transform(parse.json("message", "k bigint"))).select("event_id", "k", "tags")


@query("json_variant", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", "props", F.to_json(F.struct(F.struct("event_type").alias("a"))).alias("message"))
    df = df.transform(parse.json("props", target="p")).transform(parse.json("message", target="m"))
    return df.select("event_id", F.expr("variant_get(p, '$.k', 'bigint')").alias("k"), F.expr("variant_get(m, '$.a.event_type', 'string')").alias("kind"))


@query("xml_paths", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_partkey % 4 = 0 THEN '_xmlparsefailure' ELSE '' END AS tags FROM part")
def _(spark, sf_dir):
    text = F.concat(F.lit('<part size="'), F.col("p_size").cast("string"), F.lit('"><name>'), "p_name", F.when(F.col("p_partkey") % 4 == 0, "</nam").otherwise("</name></part>"))
    df = _t(spark, sf_dir, "part").select("p_partkey", text.alias("message"))
    return _joined(df.transform(parse.xml("message", {"name": "/part/name", "size": "/part/@size"}))).select("p_partkey", "name", "size", "tags")


@query("date_formats", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS access, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS unix, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS day, '_dateparsefailure' AS tags FROM orders")
def _(spark, sf_dir):
    when = F.col("o_orderdate").cast("timestamp")
    df = _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("a"), F.date_format(when, "dd/MMM/yyyy:HH:mm:ss Z").alias("b"), F.unix_seconds(when).alias("u"),
        F.date_format(when, "EEE MMM dd yyyy HH:mm:ss").alias("d"), F.lit("nonsense").alias("n"),
    )
    for source, pattern, target in (("a", "ISO8601", "iso"), ("b", "dd/MMM/YYYY:HH:mm:ss Z", "access"), ("u", "UNIX", "unix"), ("d", "EEE MMM dd yyyy HH:mm:ss", "day"), ("n", "ISO8601", "never")):
        df = df.transform(parse.date(source, [pattern], target=target))
    return _joined(df).select("o_orderkey", "iso", "access", "unix", "day", "tags")


_AGENTS = "CASE event_id % 4 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0.1 Safari/537.36' WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 16_2 like Mac OS X) Version/16.2 Mobile/15E148 Safari/604.1' WHEN 2 THEN 'curl/8.1.2' ELSE 'Googlebot/2.1' END"


@query("useragent", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'curl' ELSE 'Other' END AS name, CASE event_id % 4 WHEN 0 THEN 'Windows 10' WHEN 1 THEN 'iOS 16' ELSE 'Other' END AS os, CASE event_id % 4 WHEN 1 THEN 'Mobile' WHEN 3 THEN 'Spider' ELSE 'PC' END AS device, CASE event_id % 4 WHEN 0 THEN '120' WHEN 1 THEN '604' WHEN 2 THEN '8' ELSE '' END AS major, CASE event_id % 4 WHEN 0 THEN '1' WHEN 2 THEN '2' ELSE '' END AS patch FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.expr(_AGENTS).alias("agent")).transform(parse.useragent("agent"))
    return df.select("event_id", "ua.name", "ua.os", "ua.device", "ua.major", "ua.patch")


@query("syslog_pri", "SELECT event_id, p % 8 AS syslog_severity_code, p // 8 AS syslog_facility_code, list_extract(['emergency','alert','critical','error','warning','notice','informational','debug'], CAST(p % 8 + 1 AS INT)) AS syslog_severity FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 13 ELSE event_id % 192 END AS p FROM events)")
def _(spark, sf_dir):
    pri = F.when(F.col("event_id") % 11 == 0, "-3").otherwise((F.col("event_id") % 192).cast("string"))
    return _t(spark, sf_dir, "events").select("event_id", pri.alias("syslog_pri")).transform(parse.syslog_pri()).drop("syslog_pri", "syslog_facility")


# ---------------------------------------------------------------------------------------------------
# values and names

@query("urldecode", "SELECT page_id, url AS decoded, url || '+%zz' AS odd FROM pages")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "pages").select("page_id", F.url_encode("url").alias("decoded"), F.concat(F.url_encode("url"), F.lit("+%zz")).alias("odd"))
    return df.transform(shape.urldecode("decoded")).transform(shape.urldecode("odd"))


@query("truncate", "SELECT c_custkey, substr(c_name, 1, 10) AS c_name, repeat('é', 4) AS accents, c_mktsegment FROM customer")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit("é" * 9).alias("accents"), "c_mktsegment")
    return df.transform(shape.truncate(["c_name"], 10)).transform(shape.truncate(["accents"], 9)).transform(shape.truncate(["c_mktsegment"], 100))


@query("bytes", "SELECT p_partkey, CAST(p_size AS BIGINT) * 1024 AS kb, CAST(floor((p_size + 0.5) * 1048576) AS BIGINT) AS mb, CAST(NULL AS BIGINT) AS bad, '_bytesparsefailure' AS tags FROM part")
def _(spark, sf_dir):
    size = F.col("p_size").cast("string")
    df = _t(spark, sf_dir, "part").select("p_partkey", F.concat(size, F.lit("KB")).alias("kb"), F.concat(size, F.lit(".5 MiB")).alias("mb"), F.lit("many").alias("bad"))
    return _joined(df.transform(shape.bytes_("kb")).transform(shape.bytes_("mb")).transform(shape.bytes_("bad")))


@query("fingerprint", "SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS f256, sha1(c_name) AS f1, md5(c_name) AS f5 FROM customer")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "customer")
    df = df.transform(shape.fingerprint(["c_name", "nowhere", "c_mktsegment"], "f256")).transform(shape.fingerprint(["c_name"], "f1", "SHA1")).transform(shape.fingerprint(["c_name"], "f5", "MD5"))
    return df.select("c_custkey", "f256", "f1", "f5")


def _pad(byte: int) -> str:
    """The key `secret` as a block of 64 bytes, each with the pad, as a SQL blob."""
    return "from_hex('" + bytes(b ^ byte for b in b"secret".ljust(64, b"\0")).hex() + "')"


@query("fingerprint_keyed", f"SELECT c_custkey, c_name, sha256({_pad(0x5C)} || from_hex(sha256({_pad(0x36)} || encode(c_name)))) AS hmac FROM customer")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "customer").transform(shape.fingerprint(["c_name"], "hmac", key="secret")).select("c_custkey", "c_name", "hmac")


@query("fingerprint_mixed")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "customer").transform(shape.fingerprint(["c_name"], "mix", "MURMUR3")).select("c_custkey", "c_name", "mix")


@query("anonymize", "SELECT c_custkey, sha1(c_name) AS c_name, md5(c_mktsegment) AS c_mktsegment FROM customer")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return df.transform(shape.anonymize(["c_name"])).transform(shape.anonymize(["c_mktsegment"], "MD5"))


@query("anonymize_murmur3")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("text"), "c_name").transform(shape.anonymize(["c_name"], "MURMUR3"))


@query("uuid", "SELECT n_nationkey, true AS good, n_name AS kept FROM nation")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("kept")).transform(shape.uuid("id")).transform(shape.uuid("kept"))
    return df.select("n_nationkey", F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("good"), "kept")


@query("prune", "SELECT p_partkey, p_name, CASE WHEN p_brand LIKE '%1%' THEN p_brand END AS p_brand FROM part")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "part").transform(shape.prune(["^p_(partkey|name|brand|type)$"], ["type"], {"p_brand": "1"}))


@query("de_dot", "SELECT n_nationkey, n_name AS nation_name, n_regionkey AS region_key, n_name AS nested_a_b FROM nation")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation.name"), F.col("n_regionkey").alias("region.key"), F.struct(F.col("n_name").alias("a.b")).alias("nested"))
    return df.transform(shape.de_dot(nested=True)).select("n_nationkey", "nation_name", "region_key", F.col("nested.a_b").alias("nested_a_b"))


@query("json_encode", """SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","@version":"1"}' AS whole, '"' || r_name || '"' AS part FROM region""")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return df.transform(shape.json_encode(target="whole")).transform(shape.json_encode("r_name", "part")).drop("r_name")


# ---------------------------------------------------------------------------------------------------
# rows

@query("drop_condition", "SELECT event_id, event_type FROM events WHERE NOT (event_type = 'view' AND value < 50)")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "events").transform(rows.drop("event_type = 'view' AND value < 50")).select("event_id", "event_type")


@query("drop_percentage", "SELECT event_id FROM events WHERE NOT (list_sum(list_transform(string_split(CAST(event_id AS VARCHAR), ''), lambda x: ord(x))) % 100 < 30)")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id").transform(rows.drop(percentage=30))


@query("clone_routes", "SELECT o_orderkey, t.tag AS tags FROM orders, (VALUES (''), ('audit,copied'), ('metrics,copied')) t(tag)")
def _(spark, sf_dir):
    return _joined(_t(spark, sf_dir, "orders").select("o_orderkey").transform(rows.clone(["audit", "metrics"], ["copied"])))


@query("split_lines", "SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "text").transform(rows.split("text"))


@query("split_array", "SELECT vec_id, unnest(embedding) AS item FROM embeddings")
def _(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", "embedding").transform(rows.split("embedding", target="item")).select("vec_id", "item")


# ---------------------------------------------------------------------------------------------------
# lookups

@query("translate", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other P' END AS status, CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'soon' WHEN regexp_matches(o_orderpriority, 'LOW') THEN 'late' END AS rank FROM orders")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").transform(lookups.translate("o_orderstatus", {"O": "open", "F": "filled"}, "status", fallback="other %{o_orderstatus}"))
    return df.transform(lookups.translate("o_orderpriority", {"^[12]": "soon", "LOW": "late"}, "rank", regex=True)).select("o_orderkey", "status", "rank")


@query("translate_table", "SELECT c_custkey, n_name AS nation, replace(replace(c_mktsegment, 'AUTO', 'a'), 'MACHINE', 'm') AS segment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    names = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    df = _t(spark, sf_dir, "customer").withColumn("segment", F.col("c_mktsegment")).transform(lookups.translate("c_nationkey", names, "nation"))
    return df.transform(lookups.translate("segment", {"AUTO": "a", "MACHINE": "m"}, "segment", exact=False)).select("c_custkey", "nation", "segment")


@query("lookup_static", "SELECT n_nationkey, CAST(count(s_suppkey) AS BIGINT) AS suppliers, min(s_suppkey) AS first FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def _(spark, sf_dir):
    supplier = _t(spark, sf_dir, "supplier")
    df = _t(spark, sf_dir, "nation").transform(lookups.lookup_table(supplier, {"n_nationkey": "s_nationkey"}, "found", ["s_suppkey", "s_name"], order=["s_suppkey"]))
    return df.select("n_nationkey", F.size("found").cast("long").alias("suppliers"), F.get("found", F.lit(0))["s_suppkey"].alias("first"))


@query("lookup_streaming", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n, round(coalesce(max(o_totalprice), 0), 4) AS largest FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def _(spark, sf_dir):
    _t(spark, sf_dir, "orders").createOrReplaceTempView("orders_for_lookup")
    statement = "SELECT o_orderkey, o_totalprice FROM orders_for_lookup WHERE o_custkey = :cust AND o_orderstatus = 'O'"
    df = _t(spark, sf_dir, "customer").select("c_custkey").transform(lookups.lookup_query(statement, {"cust": "c_custkey"}, "found"))
    largest = F.coalesce(F.array_max(F.transform("found", lambda r: r["o_totalprice"])), F.lit(0.0))
    return df.select("c_custkey", F.size("found").cast("long").alias("n"), F.round(largest, 4).alias("largest"))


@query("lookup_join", "SELECT l_orderkey, l_linenumber, s_name AS supplier FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND l_suppkey % 2 = 0")
def _(spark, sf_dir):
    even = _t(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    return _t(spark, sf_dir, "lineitem").transform(lookups.lookup_join(even, {"l_suppkey": "s_suppkey"}, columns={"s_name": "supplier"})).select("l_orderkey", "l_linenumber", "supplier")


@query("lookup_semi_anti", "SELECT c_custkey, 'with' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer").select("c_custkey"), _t(spark, sf_dir, "orders")
    on = {"c_custkey": "o_custkey"}
    some = customer.transform(lookups.lookup_join(orders, on, "left_semi", {})).withColumn("kind", F.lit("with"))
    return some.unionByName(customer.transform(lookups.lookup_join(orders, on, "left_anti", {})).withColumn("kind", F.lit("without")))


@query("lookup_service", "SELECT o_orderkey, lower(o_orderpriority) AS answer, CASE WHEN o_orderpriority LIKE '5%' THEN '_httprequestfailure' ELSE '' END AS tags FROM (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '5%' UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderpriority LIKE '5%') WHERE o_orderpriority IS NOT NULL UNION ALL SELECT o_orderkey, NULL, '_httprequestfailure' FROM orders WHERE o_orderpriority LIKE '5%'")
def _(spark, sf_dir):
    service = lambda: lambda key: None if key.startswith("5") else key.lower()  # noqa: E731  stands for a client
    return _joined(_t(spark, sf_dir, "orders").transform(lookups.lookup_service("%{o_orderpriority}", service, "answer"))).select("o_orderkey", "answer", "tags")


@query("cidr", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'inside' END AS zone, CASE WHEN c_custkey % 4 < 2 THEN 'net' ELSE '' END AS tags FROM customer")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(".", F.lit("10"), (F.col("c_custkey") % 4).cast("string"), F.lit("0"), (F.col("c_custkey") % 250).cast("string")).alias("ip"))
    return _joined(df.transform(network.cidr(["%{ip}"], ["10.0.0.0/15", "2001:db8::/32"], {"zone": "inside"}, ["net"]))).select("c_custkey", "zone", "tags")


_IPS = "CASE event_id % 5 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '192.168.1.' || (event_id % 200) WHEN 2 THEN '8.8.8.' || (event_id % 200) WHEN 3 THEN '172.20.0.1' ELSE '300.1.1.1' END"


@query("geoip_class", f"SELECT event_id, CASE WHEN event_id % 5 < 4 THEN ip END AS ip, CASE event_id % 5 WHEN 0 THEN 'loopback' WHEN 1 THEN 'private' WHEN 2 THEN 'public' WHEN 3 THEN 'private' END AS kind, CASE WHEN event_id % 5 = 4 THEN '_geoip_lookup_failure' ELSE '' END AS tags FROM (SELECT event_id, {_IPS} AS ip FROM events)")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.expr(_IPS).alias("client")).transform(network.geoip("client"))
    return _joined(df).select("event_id", "geoip.ip", F.col("geoip.network_type").alias("kind"), "tags")


@query("geoip_ranges", "SELECT event_id, CASE WHEN event_id % 100 < 50 THEN 'N' || (event_id % 100) END AS nation FROM events")
def _(spark, sf_dir):
    ranges = spark.range(50).select((F.col("id") * 70_000).alias("first"), (F.col("id") * 70_000 + 69_999).alias("last"), F.concat(F.lit("N"), "id").alias("nation"))
    number = F.col("event_id") % 100 * 70_000 + F.col("event_id") % 70_000
    ip = F.concat_ws(".", *((F.shiftright(number, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)))
    df = _t(spark, sf_dir, "events").select("event_id", ip.alias("ip")).transform(network.geoip("ip", "geo", ranges))
    return df.select("event_id", "geo.nation")


@query("dns", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'host' || user_id ELSE 'host' || user_id || '.example' END AS host FROM events")
def _(spark, sf_dir):
    resolver = lambda: lambda name: None if int(name[4:]) % 3 == 0 else name + ".example"  # noqa: E731  stands for a resolver
    df = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("host"))
    return df.transform(network.dns("host", resolver)).select("event_id", "host")


# ---------------------------------------------------------------------------------------------------
# keyed state

@query(
    "aggregate_update",
    """WITH e AS (SELECT *, event_type = 'purchase' AS ends FROM events),
r AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e)
SELECT max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(round(value, 6), event_id) AS value, CAST(user_id AS VARCHAR) AS task_id FROM r GROUP BY user_id, run HAVING bool_or(ends)""",
)
def _(spark, sf_dir):
    op = state.aggregate("%{user_id}", ["event_id"], ["event_type", "value"], "update", "event_type = 'purchase'")
    return _t(spark, sf_dir, "events").transform(op).where("is_map").select("event_id", "event_type", F.round("value", 6).alias("value"), "task_id")


@query(
    "aggregate_create_timeout",
    """WITH f AS (SELECT user_id, event_id, event_type, floor((epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id)) / 86400) AS w FROM events)
SELECT CAST(user_id AS VARCHAR) AS task_id, max(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, '_aggregatetimeout' AS tags FROM f GROUP BY user_id, w""",
)
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("@timestamp"))
    op = state.aggregate("%{user_id}", ["event_id"], ["event_type"], "create", timeout=86400)
    return _joined(df.transform(op).where("is_map")).select("task_id", "event_id", "event_type", "tags")


@query("throttle", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 2 OR row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 5 THEN '_throttle' ELSE '' END AS tags FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return _joined(df.transform(state.throttle("%{event_type}", ["event_id"], "ts", before_count=2, after_count=5, period=10**9))).select("event_id", "tags")


@query(
    "throttle_columns",
    """WITH e AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN 9007199254740993 + event_id * 2 END AS big FROM events)
SELECT event_id, big, CASE WHEN row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id) > 2 THEN '_throttle' ELSE '' END AS tags FROM e""",
)
def _(spark, sf_dir):
    big = F.when(F.col("event_id") % 5 != 0, F.lit(9007199254740993) + F.col("event_id") * 2)
    df = _t(spark, sf_dir, "events").select("event_id", F.concat_ws("-", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("key"), "ts", big.alias("big"))
    return _joined(df.transform(state.throttle("%{key}", ["ts", "event_id"], "ts", after_count=2, period=10**6))).select("event_id", "big", "tags")


@query("meter", "SELECT event_id, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) OVER (PARTITION BY event_type ORDER BY event_id) AS k_count FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").withColumn("k", F.when(F.col("event_id") % 3 != 0, F.lit(1)))
    return df.transform(state.meter(["k"], ["event_id"], ["event_type"])).select("event_id", "k_count")


@query("timer", "SELECT event_type, count(value) AS value_count, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.5), 6) AS value_p50, round(quantile_cont(value, 0.95), 6) AS value_p95 FROM events GROUP BY event_type")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").transform(state.timer("value", ["event_type"], (50, 95)))
    return df.select("event_type", "value_count", *(F.round(f"value_{n}", 6).alias(f"value_{n}") for n in ("min", "max", "mean", "p50", "p95")))


@query("rates", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY ALL")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.rates(df, "ts", "1 day", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events")


@query(
    "multiline",
    """WITH l AS (SELECT *, event_type = 'click' AS first FROM events), e AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS ev FROM l)
SELECT user_id, min(event_id) AS event_id, string_agg(CASE WHEN first THEN 'click ' ELSE '  ' END || event_id, chr(10) ORDER BY event_id) AS message, count(*) AS lines FROM e GROUP BY user_id, ev""",
)
def _(spark, sf_dir):
    text = F.concat(F.when(F.col("event_type") == "click", "click ").otherwise("  "), F.col("event_id").cast("string"))
    df = _t(spark, sf_dir, "events").select("user_id", "event_id", text.alias("message"))
    return df.transform(state.multiline(r"^\s", ["event_id"], ["user_id"])).select("user_id", "event_id", "message", "lines")


# ---------------------------------------------------------------------------------------------------
# scripts and vectors

@query("script_arithmetic", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, CAST(l_orderkey // 7 + l_orderkey % 7 AS BIGINT) AS mixed, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size FROM lineitem")
def _(spark, sf_dir):
    op = script.script({"charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "mixed": "l_orderkey div :n + l_orderkey % :n", "size": "if(l_quantity > 25, 'big', 'small')"}, {"n": 7})
    return _t(spark, sf_dir, "lineitem").transform(op).select("l_orderkey", "l_linenumber", "charge", "mixed", "size")


@query("script_text_math", "SELECT p_partkey, upper(substr(p_name, 1, 3)) || '-' || length(p_name) AS code, CAST(strpos(p_name, 'a') - 1 AS INT) AS at, round(sqrt(p_retailprice) + ln(p_size) + cbrt(p_size), 6) AS m, p_name LIKE '%e' AS ends FROM part")
def _(spark, sf_dir):
    op = script.script({"code": "upper(substring(p_name, 1, 3)) || '-' || octet_length(p_name)", "at": "locate('a', p_name) - 1", "m": "round(sqrt(p_retailprice) + ln(p_size) + cbrt(p_size), 6)", "ends": "endswith(p_name, 'e')"})
    return _t(spark, sf_dir, "part").transform(op).select("p_partkey", "code", "at", "m", "ends")


@query("script_error_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(1000 // (o_orderkey % 3) AS BIGINT) END AS q, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(year(o_orderdate + INTERVAL 40 DAY) AS BIGINT) END AS y, CASE WHEN o_orderkey % 3 = 0 THEN '_scripterror' ELSE '' END AS tags FROM orders")
def _(spark, sf_dir):
    op = script.script({"q": "if(o_orderkey % 3 = 0, null, 1000L div nullif(o_orderkey % 3, 0))", "y": "cast(year(o_orderdate + interval 40 days) as bigint)"})
    return _joined(_t(spark, sf_dir, "orders").transform(op)).select("o_orderkey", "q", "y", "tags")


def _scripted(spark, sf_dir, name: str, keys: list[str], assignments: dict[str, str], params: dict | None = None) -> DataFrame:
    made = list(dict.fromkeys(k.partition(" ")[0] for k in assignments))
    return _joined(_t(spark, sf_dir, name).transform(script.script(assignments, params))).select(*keys, *(m for m in made if not m.startswith("_")), "tags")


@query(
    "script_strings",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, CAST(strlen(p_name) AS BIGINT) AS bytes, contains(p_name, 'ri') AS has, substr(p_name, 2, 3) AS part, trim('  ' || p_type || ' ') AS trimmed, starts_with(p_name, 'red') AS starts, ends_with(p_name, 'g') AS ends, replace(p_name, 'e', '_') AS replaced,
 CAST(len(string_split(p_name, ' ')) AS BIGINT) AS words, CAST(strpos(p_name, 'i') - 1 AS BIGINT) AS at, substr(p_name, 3, 1) AS ch, 'name: ' || p_name || ', it''s :name' AS note, '' AS tags FROM part""",
)
def _(spark, sf_dir):
    return _scripted(spark, sf_dir, "part", ["p_partkey"], {
        "up": "upper(p_name)", "low": "lower(p_brand)", "bytes": "bigint(octet_length(p_name))", "has": "contains(p_name, :n)", "part": "substring(p_name, :i + 1, 3)", "trimmed": "trim('  ' || p_type || ' ')",
        "starts": "startswith(p_name, 'red')", "ends": "endswith(p_name, 'g')", "replaced": "replace(p_name, 'e', '_')", "words": "bigint(size(split(p_name, ' ')))", "at": "bigint(locate('i', p_name) - 1)",
        "ch": "substring(p_name, 3, 1)", "note": ":name || p_name || ', it\\'s :name'",
    }, {"n": "ri", "name": "name: ", "i": 1})


@query("script_regex", "SELECT o_orderkey, regexp_matches(o_orderpriority, '[0-9]-[UH]') AS found, regexp_full_match(o_orderpriority, '[0-9]-[A-Z]+') AS whole, regexp_extract(o_orderpriority, '-(.*)$', 1) AS name, '' AS tags FROM orders")
def _(spark, sf_dir):
    return _scripted(spark, sf_dir, "orders", ["o_orderkey"], {"found": "o_orderpriority rlike '[0-9]-[UH]'", "whole": r"o_orderpriority rlike '\\A(?:[0-9]-[A-Z]+)\\z'", "name": "regexp_extract(o_orderpriority, '-(.*)$', 1)"})


@query(
    "script_arrays",
    """WITH p AS (SELECT *, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, CAST(len(w) AS BIGINT) AS n, list_contains(w, 'red') AS has, CAST(coalesce(list_position(w, 'ring'), 0) - 1 AS BIGINT) AS at, array_to_string(list_append(w, 'x'), '-') AS added, array_to_string(list_concat(w[1:1], w[3:]), '-') AS removed, len(w) = 0 AS empty, w[2] AS second, array_to_string(w, '+') AS joined,
 CAST(p_size * (p_size + 1) // 2 AS BIGINT) AS total, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS letters, '' AS tags FROM p""",
)
def _(spark, sf_dir):
    return _scripted(spark, sf_dir, "part", ["p_partkey"], {
        "_w": "split(p_name, ' ')", "n": "bigint(size(_w))", "has": "array_contains(_w, 'red')", "at": "array_position(_w, 'ring') - 1", "added": "array_join(array_append(_w, 'x'), '-')",
        "removed": "array_join(concat(slice(_w, 1, 1), slice(_w, 3, size(_w))), '-')", "empty": "size(_w) = 0", "second": "get(_w, 1)", "joined": "array_join(_w, '+')",
        "total": "aggregate(sequence(1L, bigint(p_size)), 0L, (s, x) -> s + x)", "letters": "aggregate(_w, 0L, (s, x) -> s + length(x))",
    })


@query(
    "script_maps",
    """SELECT event_id, true AS has, CAST(user_id AS VARCHAR) AS got, 'k,type,user' AS put, 'type' AS removed, CAST(2 AS BIGINT) AS n, event_type = 'click' AS clicked, false AS empty, event_type || ',' || user_id AS vals, CASE WHEN event_id % 2 = 0 THEN '_scripterror' ELSE '' END AS tags FROM events WHERE event_id % 2 = 1
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '_scripterror' FROM events WHERE event_id % 2 = 0""",
)
def _(spark, sf_dir):
    return _scripted(spark, sf_dir, "events", ["event_id"], {
        "_m": "map('type', event_type, 'user', string(user_id))", "has": "map_contains_key(_m, 'type')", "got": "try_element_at(_m, if(event_id % 2 = 1, 'user', 'nothing'))",
        "put": "array_join(array_sort(map_keys(map_concat(_m, map('k', 'v')))), ',')", "removed": "array_join(map_keys(map_filter(_m, (k, v) -> k <> 'user')), ',')", "n": "bigint(size(_m))",
        "clicked": "array_contains(map_values(_m), 'click')", "empty": "size(_m) = 0", "vals": "array_join(map_values(_m), ',')",
    })


@query(
    "script_dates",
    """WITH o AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + to_minutes(CAST(o_orderkey % 60 AS BIGINT)) + to_seconds(CAST(o_orderkey % 59 AS BIGINT)) AS t FROM orders)
SELECT o_orderkey, CAST(year(t) AS BIGINT) AS y, CAST(month(t) AS BIGINT) AS mo, CAST(day(t) AS BIGINT) AS d, CAST(hour(t) AS BIGINT) AS h, CAST(minute(t) AS BIGINT) AS mi, CAST(second(t) AS BIGINT) AS s, CAST(isodow(t) AS BIGINT) AS dow, CAST(dayofyear(t) AS BIGINT) AS doy,
 strftime(t + INTERVAL 40 DAY - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS later, CAST(date_diff('day', DATE '1970-01-01', CAST(t AS DATE)) AS BIGINT) AS days, '' AS tags FROM o""",
)
def _(spark, sf_dir):
    return _scripted(spark, sf_dir, "orders", ["o_orderkey"], {
        "_t": "cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, int(o_orderkey % 24), int(o_orderkey % 60), o_orderkey % 59)", "y": "bigint(year(_t))", "mo": "bigint(month(_t))", "d": "bigint(day(_t))", "h": "bigint(hour(_t))", "mi": "bigint(minute(_t))", "s": "bigint(second(_t))",
        "dow": "bigint(weekday(_t) + 1)", "doy": "bigint(dayofyear(_t))", "later": "date_format(_t + make_dt_interval(40) - make_dt_interval(0, 0, 90), 'yyyy-MM-dd HH:mm:ss')", "days": "bigint(datediff(_t, date'1970-01-01'))",
    })


@query(
    "script_casts",
    """SELECT o_orderkey, o_orderkey AS whole, CAST(o_orderkey % 1000 AS INT) AS small, CAST(o_custkey AS DOUBLE) + 0.5 AS real, CAST(o_orderkey AS VARCHAR) AS text, o_orderkey % 2 = 0 AS yes, CAST(trunc(o_totalprice) AS BIGINT) AS cut, CAST(-1 AS INT) AS fallback, '' AS tags FROM orders""",
)
def _(spark, sf_dir):
    return _scripted(spark, sf_dir, "orders", ["o_orderkey"], {
        "whole": "bigint(string(o_orderkey))", "small": "int(string(o_orderkey % 1000))", "real": "double(string(o_custkey) || '.5')", "text": "string(o_orderkey)", "yes": "boolean(if(o_orderkey % 2 = 0, 'true', 'false'))",
        "cut": "bigint(o_totalprice)", "fallback": "coalesce(try_cast(o_orderstatus as int), -1)",
    })


@query(
    "script_math",
    """WITH p AS (SELECT p_partkey, p_retailprice / 3000 AS x, CAST(p_size AS DOUBLE) AS y FROM part)
SELECT p_partkey, round(greatest(x, y) + least(x, 2.0) + abs(-x), 6) AS ends, round(ln(y) + log10(y) + log2(y) + exp(x), 6) AS logs, round(sqrt(y) + cbrt(y) + pow(x, 2.5), 6) AS roots, CAST(ceil(y / 3) * 10000 + floor(y / 3) * 100 + round(y / 4) AS BIGINT) AS cuts, round_even(y / 2, 0) AS even,
 round(sin(y) + cos(y) + tan(x) + asin(x / 2) + acos(x / 2) + atan(y) + atan2(x, y), 6) AS angles, round(sinh(x) + cosh(x) + tanh(x), 6) AS hyper, sign(y - 25) AS sig, round(radians(y) + degrees(x), 6) AS turned, '' AS tags FROM p""",
)
def _(spark, sf_dir):
    return _scripted(spark, sf_dir, "part", ["p_partkey"], {
        "_x": "p_retailprice / 3000", "_y": "double(p_size)", "ends": "round(greatest(_x, _y) + least(_x, 2D) + abs(-_x), 6)", "logs": "round(ln(_y) + log10(_y) + log2(_y) + exp(_x), 6)", "roots": "round(sqrt(_y) + cbrt(_y) + pow(_x, 2.5D), 6)",
        "cuts": "bigint(ceil(_y / 3) * 10000 + floor(_y / 3) * 100 + round(_y / 4))", "even": "rint(_y / 2)", "angles": "round(sin(_y) + cos(_y) + tan(_x) + asin(_x / 2) + acos(_x / 2) + atan(_y) + atan2(_x, _y), 6)",
        "hyper": "round(sinh(_x) + cosh(_x) + tanh(_x), 6)", "sig": "signum(_y - 25)", "turned": "round(radians(_y) + degrees(_x), 6)",
    })


@query(
    "script_compound",
    """SELECT l_orderkey, l_linenumber, CAST(((l_orderkey + 10) * 2 - l_linenumber) // 3 % 7 AS BIGINT) AS n, l_returnflag || l_linestatus || l_linenumber AS s, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity / (l_linenumber % 2) END AS q, CASE WHEN l_linenumber % 2 = 0 THEN '_scripterror' ELSE '' END AS tags FROM lineitem WHERE l_linenumber % 2 = 1
UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, NULL, '_scripterror' FROM lineitem WHERE l_linenumber % 2 = 0""",
)
def _(spark, sf_dir):
    return _scripted(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"], {"n": "l_orderkey", "n +=": ":step", "n *=": "2", "n -=": "l_linenumber", "n /=": "3", "n %=": "7", "s": "l_returnflag", "s +=": "l_linestatus || l_linenumber", "q": "l_quantity", "q /=": "l_linenumber % 2"}, {"step": 10})


@query(
    "script_control",
    """SELECT event_id, CASE WHEN value > 90 THEN 'high' WHEN value > 50 THEN 'middle' ELSE 'low' END AS level, CAST((user_id % 10) * (user_id % 10 + 1) // 2 AS BIGINT) AS sum_to, CASE WHEN user_id % 10 = 0 THEN -1 ELSE CAST(1000 // (user_id % 10) AS BIGINT) END AS tried, CASE WHEN event_id % 4 <> 0 THEN event_id ELSE -1 END + 1 AS after_null, '' AS tags FROM events""",
)
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").withColumn("maybe", F.when(F.col("event_id") % 4 != 0, F.col("event_id")))
    op = script.script({
        "level": "if(value > 90, 'high', if(value > 50, 'middle', 'low'))", "sum_to": "aggregate(sequence(0L, user_id % 10), 0L, (s, i) -> s + i)",
        "tried": "coalesce(1000L div nullif(user_id % 10, 0), -1L)", "after_null": "coalesce(maybe, -1) + 1",
    })
    return _joined(df.transform(op)).select("event_id", "level", "sum_to", "tried", "after_null", "tags")


_VECTORS = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), z AS (SELECT a AS b FROM e WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


@query("vectors", _VECTORS + " SELECT vec_id, round(list_dot_product(a, b), 4) AS dot, round(list_cosine_similarity(a, b), 4) AS cosine, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 4) AS l1, round(list_distance(a, b), 4) AS l2, CAST(list_sum(list_transform(list_zip(a, b), lambda p: CAST(p[1] <> p[2] AS INT))) AS BIGINT) AS hamming FROM e, z")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings")
    first = df.agg(F.min_by("embedding", "vec_id").alias("b"))  # one row
    a, b = F.col("embedding"), F.col("b")
    parts = {"dot": script.dot_product, "cosine": script.cosine_similarity, "l1": script.l1_norm, "l2": script.l2_norm}
    return df.crossJoin(F.broadcast(first)).select("vec_id", *(F.round(f(a, b), 4).alias(n) for n, f in parts.items()), script.hamming(a, b).alias("hamming"))


# ---------------------------------------------------------------------------------------------------
# codecs

@query("codec_cef", "SELECT event_id, '0' AS cef_version, 'Acme|x' AS device_vendor, event_type AS name, CAST(event_id % 10 AS VARCHAR) AS severity, 'host1' AS syslog_header, '10.0.0.' || (event_id % 200) AS \"sourceAddress\", 'blocked user ' || user_id AS action FROM events")
def _(spark, sf_dir):
    text = F.expr("'host1 CEF:0|Acme\\\\|x|Fire|1.0|' || event_id || '|' || event_type || '|' || (event_id % 10) || '|src=10.0.0.' || (event_id % 200) || ' act=blocked user ' || user_id || ' dpt=80'")
    df = codecs.decode_cef(_t(spark, sf_dir, "events").select("event_id", text.alias("message")), "message", ["sourceAddress", "deviceAction"])
    return df.select("event_id", "cef_version", "device_vendor", "name", "severity", "syslog_header", "sourceAddress", F.col("deviceAction").alias("action"))


@query("codec_graphite", "SELECT event_id, 'web.' || event_type || '.count' AS metric, CAST(event_id AS DOUBLE) / 4 AS value, 1700000000 + event_id AS timestamp_epoch, CAST(3 AS BIGINT) AS parts, 'web.' || event_type || '.count ' || (1700000000 + event_id) AS again FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.expr("'web.' || event_type || '.count ' || (event_id / 4) || ' ' || (1700000000 + event_id)").alias("message"))
    df = codecs.decode_graphite(df, "message")
    again = F.regexp_replace(codecs.encode_graphite(df), r" \S+ (\d+)\n$", " $1")
    return df.select("event_id", "metric", "value", "timestamp_epoch", F.size("metric_path").cast("long").alias("parts"), again.alias("again"))


@query("codec_cloudfront", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN event_id * 3 END AS sc_bytes, CASE WHEN event_id % 10 <> 0 THEN 'GET' END AS method, CAST(NULL AS VARCHAR) AS referer, CASE WHEN event_id % 10 = 0 THEN '_cloudfront_comment' ELSE '' END AS tags FROM events")
def _(spark, sf_dir):
    line = F.expr("concat_ws('\\t', '2024-01-02', '03:04:05', 'FRA2', event_id * 3, '1.2.3.4', 'GET', 'h.example', '/x', '200', '-')")
    df = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, "# note").otherwise(line).alias("message"))
    df = _joined(codecs.decode_cloudfront(df, "message"))
    return df.select("event_id", F.col("`sc-bytes`").alias("sc_bytes"), F.col("`cs-method`").alias("method"), F.col("`cs-referer`").alias("referer"), "tags")


@query("codec_cloudtrail", "SELECT user_id, event_id, event_type AS \"eventName\", count(*) OVER (PARTITION BY user_id, event_id // 500) AS n FROM events")
def _(spark, sf_dir):
    record = F.struct(F.col("event_id").alias("eventID"), F.col("event_type").alias("eventName"))
    docs = _t(spark, sf_dir, "events").groupBy("user_id", F.expr("event_id div 500").alias("part")).agg(F.to_json(F.struct(F.collect_list(record).alias("Records"))).alias("message"))
    df = codecs.decode_cloudtrail(docs, "message", "eventID bigint, eventName string")
    return df.select("user_id", F.col("eventID").alias("event_id"), "eventName", F.col("cloudtrail_record_count").alias("n"))


@query("codec_es_bulk", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS action, 'logs-' || event_type AS index_name, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    index = codecs.encode_es_bulk(df, "logs-%{event_type}", doc_id="%{event_id}")
    gone = codecs.encode_es_bulk(df, "logs-%{event_type}", "delete", "%{event_id}")
    bulk = df.select(F.when(F.col("event_type") == "error", gone).otherwise(index).alias("b"), F.expr("event_id div 500").alias("g")).groupBy("g").agg(F.array_join(F.collect_list("b"), "").alias("message"))
    out = codecs.decode_es_bulk(bulk, "message", "user_id bigint")
    return out.select(F.col("_id").cast("long").alias("event_id"), F.col("_action").alias("action"), F.col("_index").alias("index_name"), F.col("_id").alias("id"), "user_id")


@query("codec_csv_text", "SELECT c_custkey, c_custkey || ',\"' || c_name || ', \"\"x\"\"\",' || c_mktsegment || ',' AS line FROM customer")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("c_name"), "c_mktsegment")
    return df.select("c_custkey", codecs.encode_csv(df, ["c_custkey", "c_name", "c_mktsegment", "nowhere"]).alias("line"))


@query("codec_msgpack", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events")
    packed = df.select(binary_codecs.encode_msgpack(F.to_json(F.struct("event_id", "event_type", "value"))).alias("data"))
    return binary_codecs.decode_binary(packed, "data", "msgpack", "event_id bigint, event_type string, value double").select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("codec_netflow5", "SELECT o_orderkey % 100000 AS flow_sequence, '10.0.' || (o_orderkey // 256 % 256) || '.' || (o_orderkey % 256) AS ipv4_src_addr, o_custkey % 1000 AS in_pkts, o_orderkey % 60000 AS l4_src_port, CAST(6 AS BIGINT) AS protocol FROM orders, range(2)")
def _(spark, sf_dir):
    h = lambda e, n: F.lpad(F.hex(e), 2 * n, "0")
    zero = lambda n: F.lit("00" * n)
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    head = F.concat(F.lit("00050002"), zero(12), h(key % 100_000, 4), zero(4))
    record = F.concat(F.lit("0A00"), h(F.floor(key / 256) % 256, 1), h(key % 256, 1), zero(8), zero(4), h(cust % 1000, 4), zero(4), zero(8), h(key % 60_000, 2), zero(2), zero(1), zero(1), F.lit("06"), zero(9))
    df = _t(spark, sf_dir, "orders").select(F.unhex(F.concat(head, record, record)).alias("data"))
    return binary_codecs.decode_netflow5(df, "data").select("flow_sequence", "ipv4_src_addr", "in_pkts", "l4_src_port", "protocol")


def _hexed(value: str | F.Column, width: int) -> F.Column:
    return F.lpad(F.hex(value), 2 * width, "0")


def _flow_packets(df: DataFrame, version: int) -> F.Column:
    """A header, on an exporter's first packet the template 256 (source address, packets), and one record."""
    key, first = F.col("c_custkey"), F.col("first")
    template = F.concat(F.lit("0000" if version == 9 else "0002"), F.lit("0010"), F.lit("01000002" + "00080004" + "00020004"))
    record = F.concat(F.lit("0100000C" + "0A00"), _hexed(F.floor(key / 256) % 256, 1), _hexed(key % 256, 1), _hexed(key % 1000, 4))
    body = F.concat(F.when(first, template).otherwise(""), record)
    head = F.concat(F.lit("00090002" + "00" * 8), _hexed(key, 4), F.lit("00000007")) if version == 9 else F.concat(F.lit("000A0040" + "00" * 4), _hexed(key, 4), F.lit("00000007"))
    return F.unhex(F.concat(head, body))


def _flows(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    df = _t(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    firsts = df.groupBy("c_nationkey").agg(F.min("c_custkey").alias("least"))
    df = df.join(firsts, "c_nationkey").withColumn("first", F.col("c_custkey") == F.col("least"))
    df = df.select("c_nationkey", "c_custkey", _flow_packets(df, version).alias("data"))
    out = binary_codecs.decode_netflow_templates(df, "data", "c_nationkey", "c_custkey")
    return out.select("c_custkey", *(F.try_variant_get("event", f"$.{n}", t).alias(n) for n, t in (("netflow_version", "long"), ("flow_sequence", "long"), ("ipv4_src_addr", "string"), ("in_pkts", "long"))))


@query("codec_netflow9", "SELECT c_custkey, CAST(9 AS BIGINT) AS netflow_version, c_custkey AS flow_sequence, '10.0.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) AS ipv4_src_addr, c_custkey % 1000 AS in_pkts FROM customer")
def _(spark, sf_dir):
    return _flows(spark, sf_dir, 9)


@query("codec_ipfix", "SELECT c_custkey, CAST(10 AS BIGINT) AS netflow_version, c_custkey AS flow_sequence, '10.0.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) AS ipv4_src_addr, c_custkey % 1000 AS in_pkts FROM customer")
def _(spark, sf_dir):
    return _flows(spark, sf_dir, 10)


@query("codec_collectd", "SELECT event_id AS time, 'h' || user_id AS host, event_type AS plugin, user_id * 2 AS value FROM events")
def _(spark, sf_dir):
    def text(kind: int, value: F.Column) -> F.Column:
        return F.concat(_hexed(F.lit(kind), 2), _hexed(F.octet_length(value) + 5, 2), F.hex(value.cast("binary")), F.lit("00"))

    values = F.concat(F.lit("0006000F" + "0001" + "02"), _hexed(F.col("user_id") * 2, 8))
    packet = F.concat(text(0, F.concat(F.lit("h"), F.col("user_id").cast("string"))), text(2, F.col("event_type")), F.lit("0001000C"), _hexed(F.col("event_id"), 8), values)
    df = _t(spark, sf_dir, "events").select(F.unhex(packet).alias("data"))
    return binary_codecs.decode_binary(df, "data", "collectd", "time long, host string, plugin string, value long").select("time", "host", "plugin", "value")


@query("codec_avro_header", """SELECT n_nationkey, '{"name":"' || n_name || '"}' AS avro_schema, 'null' AS avro_codec, CAST(n_nationkey AS BIGINT) AS avro_block_count FROM nation""")
def _(spark, sf_dir):
    schema = F.concat(F.lit('{"name":"'), "n_name", F.lit('"}'))
    length = lambda x: _hexed(F.octet_length(x) * 2, 1)  # noqa: E731  below 64 bytes a zigzag number is one byte
    entry = lambda k, v: F.concat(length(k), F.hex(k.cast("binary")), length(v), F.hex(v.cast("binary")))
    data = F.concat(F.lit("4F626A0104"), entry(F.lit("avro.schema"), schema), entry(F.lit("avro.codec"), F.lit("null")), F.lit("00" + "AB" * 16), _hexed(F.col("n_nationkey") * 2, 1), F.lit("06414243"))
    df = _t(spark, sf_dir, "nation").select("n_nationkey", F.unhex(data).alias("data"))
    return binary_codecs.decode_binary(df, "data", "avro", "avro_schema string, avro_codec string, avro_block_count long").select("n_nationkey", "avro_schema", "avro_codec", "avro_block_count")


@query(
    "codec_json",
    """SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 6 = 0 THEN '_codecfailure' ELSE '' END AS tags,
 '{"event_id":' || event_id || ',"event_type":"' || event_type || '","value":' || user_id || ',"@version":"1"}' || chr(10) AS line FROM events""",
)
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events")
    out = df.select("event_id", "event_type", F.col("user_id").alias("value"))
    raw = df.select("event_id", F.when(F.col("event_id") % 6 == 0, "{oops").otherwise(F.col("props")).alias("raw"))
    df = out.select("event_id", codecs.encode_json(out, lines=True).alias("line")).join(raw, "event_id")
    return _joined(codecs.decode_json(df, "raw", "k bigint")).select("event_id", "k", "tags", "line")


@query("codec_nmap", "SELECT s_suppkey, '10.0.0.' || s_suppkey AS ip, s_name AS hostname, 'up' AS status, CAST(2 AS BIGINT) AS ports, CAST(443 AS BIGINT) AS last FROM supplier")
def _(spark, sf_dir):
    text = F.expr("""'<nmaprun scanner="nmap"><host><status state="up"/><address addr="10.0.0.' || s_suppkey || '" addrtype="ipv4"/><hostnames><hostname name="' || s_name || '"/></hostnames><ports><port protocol="tcp" portid="80"><state state="open"/><service name="http"/></port><port protocol="tcp" portid="443"><state state="open"/></port></ports></host></nmaprun>'""")
    df = codecs.decode_nmap(_t(spark, sf_dir, "supplier").select("s_suppkey", text.alias("message")), "message")
    return df.select("s_suppkey", "ip", "hostname", "status", F.size("ports").cast("long").alias("ports"), F.element_at("ports", -1)["port"].alias("last"))


# ---------------------------------------------------------------------------------------------------
# sources, sinks, pipelines, streams

@query("source_generator", "SELECT 'hello' AS message, event_id AS sequence, 'alert' AS severity, event_type FROM events WHERE event_id >= 0")
def _(spark, sf_dir):
    # generated rows are matched with the table's, so that both are read
    events = _t(spark, sf_dir, "events")
    df = tables.syslog_fields(tables.generator(spark, events.agg(F.max("event_id")).first()[0] + 1, "<1>hello"))
    return df.join(events.select(F.col("event_id").alias("sequence"), "event_type"), "sequence").select("message", "sequence", "severity", "event_type")


@query("union_inputs", "SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS kind FROM orders UNION ALL SELECT event_id, NULL, event_type FROM events")
def _(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return pipeline.union(orders, _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).select("id", "status", "kind")


@query("pipeline_bus", "SELECT event_id, 'errors' AS via FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'high' FROM events WHERE value > 90")
def _(spark, sf_dir):
    pipelines = {
        "collect": {"from": ["events"], "outputs": [{"to": "bad", "if": "event_type = 'error'"}, {"to": "top", "if": "value > 90"}]},
        "errors": {"from": ["bad"], "filters": [{"use": "mutate", "with": {"add_field": {"via": "errors"}}}], "outputs": [{"to": "store"}]},
        "high": {"from": ["top"], "filters": [{"use": "mutate", "with": {"add_field": {"via": "high"}}}], "outputs": [{"to": "store"}]},
    }
    return pipeline.connect(pipelines, {"events": _t(spark, sf_dir, "events")})["store"].select("event_id", "via")


@query("cond_nested", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN CASE WHEN o_orderstatus = 'F' THEN 'dear, done' WHEN o_orderstatus = 'O' THEN 'dear, open' ELSE 'dear' END ELSE CASE WHEN NOT (o_orderstatus = 'F') THEN 'cheap, not done' ELSE 'cheap' END END AS label FROM orders")
def _(spark, sf_dir):
    def put(text: str) -> dict:
        return {"use": "mutate", "with": {"replace": {"label": text}}}

    dear = {"branches": [{"if": "o_orderstatus = 'F'", "then": [put("dear, done")]}, {"if": c.eq("o_orderstatus", "O"), "then": [put("dear, open")]}, {"then": [put("dear")]}]}
    cheap = {"branches": [{"if": c.negate(c.eq("o_orderstatus", "F")), "then": [put("cheap, not done")]}, {"then": [put("cheap")]}]}
    spec = {"branches": [{"if": "o_totalprice > 100000", "then": [dear]}, {"then": [cheap]}]}
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").transform(pipeline.step(spec)).select("o_orderkey", "label")


@query("cond_settled", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0)")
def _(spark, sf_dir):
    put = lambda text: {"use": "mutate", "with": {"replace": {"o_orderstatus": text}}}
    drop = {"branches": [{"if": "o_orderkey % 2 = 0", "then": [{"use": "drop"}]}]}
    spec = {"branches": [{"if": "o_orderstatus = 'F'", "then": [put("O")]}, {"if": "o_orderstatus = 'O'", "then": [put("P")]}, {"if": "o_orderstatus = 'P'", "then": [drop]}]}
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").transform(pipeline.step(spec))


@query("cond_constants", "SELECT r_regionkey, true AS yes, false AS no, r_regionkey > 1 AS some FROM region")
def _(spark, sf_dir):
    return _flagged(_t(spark, sf_dir, "region"), "r_regionkey", yes=c.sql("true"), no=c.negate(c.sql("true")), some=c.all_of(c.sql("true"), c.compare("r_regionkey", ">", 1)))


@query("pipeline_counters", "SELECT count(*) AS events, count(*) FILTER (event_id % 7 = 0) AS failed, CAST(sum(octet_length(encode(CASE WHEN event_id % 7 = 0 THEN '{' ELSE props END))) AS BIGINT) AS bytes FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "{").otherwise(F.col("props")).alias("message"))
    seen = Observation("passed")
    counted = pipeline.counters(df.transform(parse.json("message", "k bigint")), seen, ["_jsonparsefailure"], "message")
    counted.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["events"], seen.get["failed"], seen.get["bytes"])], "events long, failed long, bytes long")


@query(
    "dns_reverse",
    """SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'no address' ELSE '10.0.0.' || (user_id % 200) || CASE WHEN user_id % 200 < 100 THEN ',host-' || (user_id % 200) ELSE '' END END AS addr, CASE WHEN event_id % 3 = 0 OR user_id % 200 >= 100 THEN '_dnsfailure' ELSE '' END AS tags FROM events""",
)
def _(spark, sf_dir):
    addr = F.when(F.col("event_id") % 3 == 0, "no address").otherwise(F.concat(F.lit("10.0.0."), (F.col("user_id") % 200).cast("string")))
    known = lambda: lambda ip: f"host-{ip.split('.')[3]}" if int(ip.split(".")[3]) < 100 else None  # noqa: E731  stands for a resolver
    df = _t(spark, sf_dir, "events").select("user_id", "event_id", addr.alias("addr")).transform(network.dns("addr", known, reverse=True, action="append"))
    return _joined(df).select("user_id", "event_id", F.array_join("addr", ",").alias("addr"), "tags")


@query(
    "geoip_text_ranges",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 2 THEN NULL WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 200 < 128 THEN 'four, low' ELSE 'four, high' END ELSE CASE WHEN c_custkey % 200 < 128 THEN 'six, low' ELSE 'six, high' END END AS place,
 CASE WHEN c_custkey % 4 >= 2 THEN '_geoip_lookup_failure' ELSE '' END AS tags FROM customer""",
)
def _(spark, sf_dir):
    n = (F.col("c_custkey") % 200).cast("string")
    six = F.concat(F.lit("2001:DB8::"), F.lower(F.hex(F.col("c_custkey") % 200)))
    addr = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("10.1.2."), n)).when(F.col("c_custkey") % 4 == 1, six).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("10.9.9."), n)).otherwise("2001:::1")
    ranges = spark.createDataFrame([("10.1.2.0", "10.1.2.127", "four, low"), ("10.1.2.128", "10.1.2.255", "four, high"), ("2001:db8::", "2001:db8::7f", "six, low"), ("2001:db8::80", "2001:db8::ffff", "six, high"), ("fe80::", "fe80::1:0:0:0", "local")], "first string, last string, place string")
    df = _t(spark, sf_dir, "customer").select("c_custkey", addr.alias("addr")).transform(network.geoip("addr", ranges=ranges))
    return _joined(df).select("c_custkey", F.col("geoip.place").alias("place"), "tags")


@query("xml_document", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN 'a,b' END AS tags_, CASE WHEN c_custkey % 5 = 0 THEN '_xmlparsefailure' ELSE '' END AS tags FROM customer")
def _(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 5 == 0, "<open>").otherwise(F.concat(F.lit('<c id="'), F.col("c_custkey").cast("string"), F.lit('"><name>'), "c_name", F.lit("</name><t>a</t><t>b</t></c>")))
    df = _t(spark, sf_dir, "customer").select("c_custkey", text.alias("message")).transform(parse.xml(schema="_id bigint, name string, t array<string>", target="doc"))
    return _joined(df).select("c_custkey", F.col("doc._id").alias("id"), F.col("doc.name").alias("name"), F.array_join("doc.t", ",").alias("tags_"), "tags")


@query("sink_graphite_lines", "SELECT 's.s_nationkey ' || s_nationkey || ' 1700000000' AS value FROM supplier UNION ALL SELECT 's.s_suppkey ' || s_suppkey || ' 1700000000' FROM supplier")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.timestamp_seconds(F.lit(1_700_000_000)).alias("@timestamp"))
    return writers.graphite_lines(df, prefix="s.")


@query(
    "sink_log_intake",
    """SELECT event_id, event_type AS message, 'app' AS source, 'web' AS service, 'env:test' AS tags, 'h' || user_id AS hostname, user_id AS kept FROM events""",
)
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("message"), F.concat(F.lit("h"), "user_id").alias("host"), F.lit("mine").alias("service"), F.col("user_id").alias("kept"))
    entry = writers.log_intake_entry(df, "app", "web", "env:test")
    got = F.from_json("entry", "event_id long, message string, ddsource string, service string, ddtags string, hostname string, kept long")
    return df.select(entry.alias("entry")).select(got.alias("g")).select("g.event_id", "g.message", F.col("g.ddsource").alias("source"), "g.service", F.col("g.ddtags").alias("tags"), "g.hostname", "g.kept")


@query("sink_dead_letters", "SELECT event_id, event_id % 7 = 0 AS dead FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "{").otherwise(F.col("props")).alias("message"))
    good, bad = writers.dead_letters(df.transform(parse.json("message", "k bigint")), ["_jsonparsefailure"])
    return good.select("event_id", F.lit(False).alias("dead")).unionByName(bad.select("event_id", F.lit(True).alias("dead")))


def _scratch(spark: SparkSession) -> str:
    """A folder that all executors share; one of this machine only where Spark runs on it alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="eventspark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@query("stream_file_to_file", "SELECT event_id, upper(event_type) AS event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'view'")
def _(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    specs = [{"use": "json", "with": {"source": "props", "schema": "k bigint"}}, {"use": "drop", "if": "event_type = 'view'"}, {"use": "mutate", "with": {"uppercase": ["event_type"]}}]
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_dir(spark, sf_dir, "events"))
    out = _scratch(spark)
    done = stream.transform(pipeline.compile_filters(specs)).select("event_id", "event_type", "k")
    writers.on_batches(done, [(None, lambda df: df.write.mode("append").parquet(out))], f"{out}-log").awaitTermination()
    return spark.read.parquet(out)


def _stream_dir(spark: SparkSession, sf_dir: str, name: str) -> str:
    """File streams read folders; a table that is one file is written to one first."""
    path = _scratch(spark)
    _t(spark, sf_dir, name).write.parquet(path)
    return path


@query("stream_throttle", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 3 THEN '_throttle' ELSE '' END AS tags FROM events")
def _(spark, sf_dir):
    path = _scratch(spark)
    df = _t(spark, sf_dir, "events").select("event_id", "event_type", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")).alias("@timestamp"))
    df.write.parquet(path)
    stream = spark.readStream.schema("event_id long, event_type string, `@timestamp` timestamp").parquet(path)
    tagged = state.throttle_stream(stream, "%{event_type}", after_count=3, period=10**9, max_age=None)
    out = _scratch(spark)
    query = tagged.writeStream.option("checkpointLocation", f"{out}-log").outputMode("append").trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()
    return _joined(spark.read.parquet(out)).select("event_id", "tags")


@query("source_lines", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def _(spark, sf_dir):
    path = _scratch(spark)
    _t(spark, sf_dir, "documents").select("text").write.text(path)
    return tables.lines(spark, path, delimiter="\n").groupBy(F.col("message").alias("line")).agg(F.count("*").alias("n"))


@query("source_syslog", "SELECT event_id, CAST(event_id % 192 // 8 AS BIGINT) AS facility_code, event_id % 8 AS severity_code, event_type AS message, 'syslog' AS type FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select("event_id", F.expr("'<' || (event_id % 192) || '>' || event_type").alias("message"))
    return tables.syslog_fields(df).select("event_id", "facility_code", "severity_code", "message", "type")


@query("source_gelf", "SELECT event_id, 'said ' || event_type AS message, 'h' || user_id AS host, event_id AS custom FROM events")
def _(spark, sf_dir):
    doc = F.to_json(F.struct(F.lit("1.1").alias("version"), F.concat(F.lit("h"), "user_id").alias("host"), F.concat(F.lit("said "), "event_type").alias("short_message"), F.col("event_id").alias("_custom")))
    df = _t(spark, sf_dir, "events").select("event_id", doc.alias("message"))
    return tables.gelf_fields(df, "host string, short_message string, _custom long").select("event_id", "message", "host", "custom")


@query("source_heartbeat", "SELECT 'ok' AS message, o_orderkey AS sequence, 'heartbeat' AS type, o_orderstatus FROM orders WHERE o_orderkey >= 0")
def _(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    beats = tables.heartbeat(spark, orders.agg(F.max("o_orderkey")).first()[0] + 1)
    return beats.join(orders.select(F.col("o_orderkey").alias("sequence"), "o_orderstatus"), "sequence").select("message", "sequence", "type", "o_orderstatus")


@query("codec_text_forms", """SELECT r_regionkey, r_name || chr(10) AS plain, '.' AS dots, '{' || chr(10) || '  "message" => "' || r_name || '",' || chr(10) || '  "r_regionkey" => ' || r_regionkey || chr(10) || '}' || chr(10) AS debug FROM region""")
def _(spark, sf_dir):
    df = codecs.decode_plain(_t(spark, sf_dir, "region").select("r_regionkey", F.concat("r_name", F.lit("\n")).alias("raw")), "raw").drop("raw")
    return df.select("r_regionkey", codecs.encode_plain(df).alias("plain"), codecs.encode_dots(df).alias("dots"), codecs.encode_rubydebug(df).alias("debug"))


@query("codec_csv_records", "SELECT s_nationkey AS nation, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def _(spark, sf_dir):
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name")
    df = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation"), F.expr("s_suppkey div 500")).agg(F.array_join(F.collect_list(line), "\n").alias("message"))
    return codecs.decode_csv(df, "message", ["id", "name"]).select("nation", "id", "name")


@query("codec_fluent", "SELECT 'app.' || event_type AS fluent_tag, event_id AS fluent_time, user_id FROM events")
def _(spark, sf_dir):
    entry = F.to_json(F.struct(F.concat(F.lit("app."), "event_type").alias("t"), F.col("event_id").alias("i"), F.col("user_id").alias("u")))
    as_array = F.regexp_replace(entry, r'^\{"t":(.*),"i":(\d+),"u":(\d+)\}$', r'[$1,$2,{"user_id":$3}]')
    df = _t(spark, sf_dir, "events").select(binary_codecs.encode_msgpack(as_array).alias("data"))
    return binary_codecs.decode_binary(df, "data", "fluent", "fluent_tag string, fluent_time long, user_id long").select("fluent_tag", "fluent_time", "user_id")


@query("codec_protobuf", "SELECT o_orderkey % 128 AS field_1, o_orderstatus AS field_2 FROM orders")
def _(spark, sf_dir):
    status = F.hex(F.col("o_orderstatus").cast("binary"))
    data = F.unhex(F.concat(F.lit("08"), F.lpad(F.hex(F.col("o_orderkey") % 128), 2, "0"), F.lit("1201"), status))
    df = _t(spark, sf_dir, "orders").select(data.alias("data"))
    return binary_codecs.decode_binary(df, "data", "protobuf", "field_1 long, field_2 string").select("field_1", "field_2")


@query("codec_edn", "SELECT event_id AS id, event_type AS kind FROM events")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "events").select(F.expr("'{:id ' || event_id || ' :kind \"' || event_type || '\"}'").cast("binary").alias("data"))
    return binary_codecs.decode_binary(df, "data", "edn", "id long, kind string").select("id", "kind")


@query("lookup_cache", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'cached ' || user_id END AS found FROM events")
def _(spark, sf_dir):
    cache = lambda: lambda key: f"cached {key[1:]}" if int(key[1:]) % 2 == 0 else None  # noqa: E731  stands for a client
    return _t(spark, sf_dir, "events").transform(lookups.memcached_get({"u%{user_id}": "found"}, cache)).select("event_id", "found")


@query("sink_form_body", "SELECT 'n_nationkey=' || n_nationkey || '&n_name=' || replace(n_name, ' ', '+') AS body FROM nation")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return df.select(writers.form_body(df).alias("body"))


@query("sink_metric_data", "SELECT CAST(count(*) AS BIGINT) AS metrics, max(value) AS largest FROM events")
def _(spark, sf_dir):
    calls = writers.metric_data(_t(spark, sf_dir, "events"), "m.%{event_type}", "value")
    data = calls.select(F.explode(F.from_json("value", "MetricData array<struct<MetricName:string,Value:double>>")["MetricData"]).alias("d"))
    return data.agg(F.count("*").alias("metrics"), F.max("d.Value").alias("largest"))


@query("sink_routes", "SELECT event_id, 'all' AS sink FROM events UNION ALL SELECT event_id, 'errors' FROM events WHERE event_type = 'error'")
def _(spark, sf_dir):
    out = {name: _scratch(spark) for name in ("all", "errors")}
    put = lambda name: lambda df: df.write.parquet(out[name])
    writers.routed(_t(spark, sf_dir, "events").select("event_id", "event_type"), [(None, put("all")), ("event_type = 'error'", put("errors"))])
    return pipeline.union(*(spark.read.parquet(path).select("event_id", F.lit(name).alias("sink")) for name, path in out.items()))


@query(
    "stream_aggregate",
    """WITH e AS (SELECT *, event_type = 'purchase' AS ends FROM events),
r AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e)
SELECT max(event_id) AS event_id, CAST(user_id AS VARCHAR) AS task_id FROM r GROUP BY user_id, run HAVING bool_or(ends)""",
)
def _(spark, sf_dir):
    path, out = _scratch(spark), _scratch(spark)
    _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type").write.parquet(path)
    stream = spark.readStream.schema("event_id long, user_id long, event_type string").parquet(path)
    maps = state.aggregate_stream(stream, "%{user_id}", ["event_id"], "event_type = 'purchase'", order="event_id", timeout=None)
    maps.writeStream.option("checkpointLocation", f"{out}-log").outputMode("append").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.parquet(out).select("event_id", "task_id")
