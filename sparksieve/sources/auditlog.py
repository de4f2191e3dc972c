"""The session audit log: written from requests and findings, read back as events and scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.policy import findings_by_payload
from .payload import preview, redact_headers, redact_uri

# The log's line formats.
STAMP = r"\A\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?[\t\n\f\r ]?"
REQUEST = r"\A--- \[#(\d+)\] REQUEST (\S+) (.+) ---\z"
RESPONSE = r"\A--- \[#(\d+)\] RESPONSE (\d+) (.+) ---\z"
ALERTS = r"\A--- \[#(\d+)\] ALERTS \((\d+)\) ---\z"
ALERT = r"\A\s*\[(\w+)/([^\]]+)\]\s+(\S+)\s+@(\d+)(?:\.\.(\d+))?\s+:\s+(.+)\z"
BLOCKED = r"\[#(\d+)\] BLOCKED by policy \((\d+) finding\(s\) >= (\w+)\)"
REDACTED = r"\[#(\d+)\] REDACTED (\d+) finding\(s\)[;,…]? ?forwarding (\d+)-byte body \(was (\d+)\)"
HEADER = r"\A[A-Za-z][A-Za-z0-9-]*:\s"


def header_lines(headers: Column) -> Column:
    """``name: value`` lines of a header map, sorted by name, credentials hidden."""
    h = F.map_entries(redact_headers(headers))
    return F.array_join(F.transform(F.array_sort(h), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")


def request_blocks(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """(payload_id, entry): the log entry of requests(payload_id, method, uri, headers, body) with their alerts."""
    f = findings_by_payload(findings, "payload_id").withColumnRenamed("payload_id", "__id")
    j = requests.join(f, F.col("payload_id") == F.col("__id"), "left")
    head = F.concat(F.lit("\n--- [#"), F.col("payload_id").cast("string"), F.lit("] REQUEST "), F.col("method"), F.lit(" "), redact_uri(F.col("uri")), F.lit(" ---\n"))
    line = lambda x: F.concat(F.lit("  ["), x["severity"], F.lit("/"), x["category"], F.lit("] "), x["rule_id"], F.lit(" @"), x["off"].cast("string"), F.lit(".."), x["end"].cast("string"), F.lit(" : "), x["snippet"], F.lit("\n"))
    alerts = F.when(F.size("findings") > 0, F.concat(F.lit("\n--- [#"), F.col("payload_id").cast("string"), F.lit("] ALERTS ("), F.size("findings").cast("string"), F.lit(") ---\n"), F.array_join(F.transform("findings", line), ""))).otherwise("")
    return j.select("payload_id", F.concat(head, F.coalesce(header_lines(F.col("headers")), F.lit("")), preview(F.col("body")), alerts).alias("entry"))


def response_blocks(responses: DataFrame) -> DataFrame:
    """(payload_id, entry) of responses(payload_id, status, uri, headers, content_type, body); event streams have no body."""
    head = F.concat(F.lit("\n--- [#"), F.col("payload_id").cast("string"), F.lit("] RESPONSE "), F.col("status").cast("string"), F.lit(" "), F.col("uri"), F.lit(" ---\n"))
    ct = F.coalesce("content_type", F.lit(""))
    body = F.when(is_streaming(ct), F.concat(F.lit("<body: streaming "), ct, F.lit(" — not buffered>\n"))).otherwise(preview(F.col("body")))
    return responses.select("payload_id", F.concat(head, F.coalesce(header_lines(F.col("headers")), F.lit("")), body).alias("entry"))


def is_streaming(content_type: Column) -> Column:
    c = F.lower(F.coalesce(content_type, F.lit("")))
    return F.startswith(c, F.lit("text/event-stream")) | F.contains(c, F.lit("stream+json"))


def is_websocket(headers: Column) -> Column:
    """Whether a lower-cased header map asks for a WebSocket upgrade."""
    has = lambda k, v: F.contains(F.lower(F.coalesce(F.element_at(headers, F.lit(k)), F.lit(""))), F.lit(v))
    return has("upgrade", "websocket") & has("connection", "upgrade")


def trace_rows(requests: DataFrame, findings: DataFrame, sources: list[str]) -> DataFrame:
    """JSON lines of a debug trace: one scan event per request with coverage and findings."""
    from ..operators.rules import builtin_rules

    f = findings_by_payload(findings, "payload_id").withColumnRenamed("payload_id", "__id")
    j = requests.join(f, F.col("payload_id") == F.col("__id"), "left")
    items = F.transform(F.coalesce("findings", F.array().cast(f.schema["findings"].dataType)), lambda x: F.struct(x["rule_id"].alias("rule_id"), x["category"].alias("category"), x["severity"].alias("severity"), x["off"].alias("offset"), x["end"].alias("end"), x["snippet"].alias("snippet")))
    cover = F.struct(F.lit(len(builtin_rules())).alias("rules"), F.array(*map(F.lit, sources)).alias("sources"))
    return j.select("payload_id", F.to_json(F.struct(F.col("payload_id").alias("id"), F.lit("scan").alias("event"), F.col("method"), redact_uri(F.col("uri")).alias("path"), cover.alias("coverage"), F.octet_length("body").alias("req_bytes"), items.alias("findings"))).alias("value"))


def outcome_rows(decisions: DataFrame) -> DataFrame:
    """JSON lines of outcomes from (payload_id, decision)."""
    sent = F.col("decision").isin("FORWARD", "REDACTED", "MASKED")
    return decisions.select("payload_id", F.to_json(F.struct(F.col("payload_id").alias("id"), F.lit("outcome").alias("event"), "decision", sent.alias("sent_upstream"))).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of log files: each file is one row of the whole-text source, split in the plan, so line numbers follow its order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def _g(line: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))


def log_events(lines: DataFrame) -> DataFrame:
    """(file, block, kind, id, method, url, status, alerts, headers, body, n, floor, before, after) from (file, line_no, value).

    A block runs from a REQUEST or RESPONSE line to the next; its number is a
    running sum per file. BLOCKED and REDACTED lines are events of their own.
    """
    v = F.regexp_replace("value", STAMP, "")
    x = lines.select("file", "line_no", v.alias("line"))
    kind = F.when(F.col("line").rlike(REQUEST), "request").when(F.col("line").rlike(RESPONSE), "response").when(F.col("line").rlike(ALERTS), "alerts").when(F.col("line").rlike(BLOCKED), "blocked").when(F.col("line").rlike(REDACTED), "redacted")
    x = x.withColumn("mark", kind)
    w = Window.partitionBy("file").orderBy("line_no")
    x = x.withColumn("block", F.sum(F.col("mark").isin("request", "response").cast("int")).over(w)).withColumn("block", F.coalesce("block", F.lit(0)))
    in_block = Window.partitionBy("file", "block").orderBy("line_no")
    x = x.withColumn("in_alerts", F.coalesce(F.max((F.col("mark") == "alerts").cast("int")).over(in_block), F.lit(0)) == 1)
    alert = F.when(F.col("in_alerts") & F.col("line").rlike(ALERT), F.struct(F.col("line_no"), _g(F.col("line"), ALERT, 1).alias("severity"), _g(F.col("line"), ALERT, 2).alias("category"), _g(F.col("line"), ALERT, 3).alias("rule_id"), _g(F.col("line"), ALERT, 4).cast("long").alias("off"), F.coalesce(_g(F.col("line"), ALERT, 5).cast("long"), F.lit(0)).alias("end"), _g(F.col("line"), ALERT, 6).alias("snippet")))
    text = F.col("mark").isNull() & ~F.col("in_alerts")
    header = text & F.col("line").rlike(HEADER)
    part = F.struct("line_no", "line")
    started = x.where("block > 0")
    blocks = started.groupBy("file", "block").agg(
        F.max(F.when(F.col("mark").isin("request", "response"), F.col("line"))).alias("head"),
        F.sort_array(F.collect_list(alert)).alias("alerts"),
        F.transform(F.sort_array(F.collect_list(F.when(header, part))), lambda p: p["line"]).alias("headers"),
        F.transform(F.sort_array(F.collect_list(F.when(text & ~header, part))), lambda p: p["line"]).alias("body"),
        F.min("line_no").alias("line_no"),
    )
    is_req = F.col("head").rlike(REQUEST)
    b = blocks.select("file", "line_no", F.when(is_req, "request").otherwise("response").alias("kind"), F.coalesce(_g(F.col("head"), REQUEST, 1), _g(F.col("head"), RESPONSE, 1)).cast("long").alias("id"), _g(F.col("head"), REQUEST, 2).alias("method"), F.coalesce(_g(F.col("head"), REQUEST, 3), _g(F.col("head"), RESPONSE, 3)).alias("url"), _g(F.col("head"), RESPONSE, 2).cast("int").alias("status"), "alerts", "headers", F.array_join("body", "\n").alias("body"))
    none = lambda t: F.lit(None).cast(t)
    line = F.col("line")
    marks = x.where(F.col("mark").isin("blocked", "redacted")).select("file", "line_no", F.col("mark").alias("kind"), F.coalesce(_g(line, BLOCKED, 1), _g(line, REDACTED, 1)).cast("long").alias("id"), F.coalesce(_g(line, BLOCKED, 2), _g(line, REDACTED, 2)).cast("int").alias("n"), _g(line, BLOCKED, 3).alias("floor"), _g(line, REDACTED, 3).cast("long").alias("after"), _g(line, REDACTED, 4).cast("long").alias("before"))
    b = b.withColumns({"n": none("int"), "floor": none("string"), "after": none("long"), "before": none("long")})
    return b.unionByName(marks, allowMissingColumns=True)


def scenes(events: DataFrame, only_alerts: bool = False) -> DataFrame:
    """One row per (file, id): request, alerts, block, redaction and response, the last of each kind winning."""
    last = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.col("line_no")))
    s = events.groupBy("file", "id").agg(
        last("request", "method").alias("method"),
        last("request", "url").alias("url"),
        F.coalesce(F.size(last("request", "alerts")), F.lit(0)).alias("n_alerts"),
        last("blocked", "n").alias("blocked"),
        last("blocked", "floor").alias("floor"),
        last("redacted", "n").alias("redacted"),
        last("redacted", "before").alias("bytes_before"),
        last("redacted", "after").alias("bytes_after"),
        last("response", "status").alias("status"),
        F.min("line_no").alias("first_line"),
    )
    s = s.withColumn("n_alerts", F.greatest("n_alerts", F.lit(0)))
    return s.where((F.col("n_alerts") > 0) | F.col("blocked").isNotNull() | F.col("redacted").isNotNull()) if only_alerts else s
