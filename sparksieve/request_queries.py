"""Queries over requests made from the tables: shaping, predicates, replies, traces; with DuckDB SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import rules as R
from .operators.detect import detect
from .operators.policy import findings_by_payload, has_pii, has_secret, mask_ack, maskable, placeholder_label, redactable, rule_list
from .operators.session import is_affirmation
from .plans.parallel import spread
from .plans.providers import fill_endpoint, model_turn, provider_command, wants_streaming
from .plans.scan import rule_coverage
from .queries import CATALOG_SQL, FINDING, QUERIES, _ALL, _cols, _duck, builtin_sql, catalog, q, query, table
from .sources import auditlog, payload

_LETTERS = "nrtbfvxz"
_ADDRESS = f"concat('to ', chr(92), substr('{_LETTERS}', CAST(c_custkey % 8 + 1 AS INT), 1), 'user', CAST(c_custkey AS STRING), '@example.org now')"


@query(
    "SELECT c_custkey AS payload_id, 'email-address' AS rule_id, CAST(CASE WHEN c_custkey % 8 < 6 THEN 5 ELSE 4 END AS BIGINT) AS off, "
    f"CASE WHEN c_custkey % 8 < 6 THEN '' ELSE substr('{_LETTERS}', CAST(c_custkey % 8 + 1 AS INTEGER), 1) END || 'user' || c_custkey || '@example.org' AS raw FROM customer"
)
def escaped_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON escape letter that is glued to an address is not part of it; another letter is."""
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey AS payload_id", f"{_ADDRESS} AS text")
    return detect(p, "payload_id", "text", digits=False, tokens=False, only={"email-address"}).select("payload_id", "rule_id", "off", "raw")


_WINDOW = "concat(repeat('a ', CAST(1048560 + n_nationkey AS INT)), 'bob', CAST(n_nationkey AS STRING), '@example.org and carl@example.org')"


@query(f"{_cols('payload_id')} ({builtin_sql('(SELECT n_nationkey AS payload_id, substr(' + _duck(_WINDOW).replace('AS INT', 'AS INTEGER').replace('INTEGEREGER', 'INTEGER') + ', 1, 2097152) AS text FROM nation)', 'payload_id', {'email-address'})})")
def scan_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the first 2 MiB of a payload are scanned; an address that they cut is found as far as it goes."""
    p = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS payload_id", f"{_WINDOW} AS text")
    return detect(p, "payload_id", "text", digits=False, tokens=False, only={"email-address"}).select("payload_id", *FINDING)


@query("SELECT c_custkey, '<redacted>' AS auth, '<redacted>' AS api_key, '<redacted>' AS google, '*/*' AS accept, 'k' || c_custkey AS other FROM customer")
def header_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential headers of all providers are hidden whatever their case."""
    c = table(spark, sf_dir, "customer")
    k = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    h = payload.redact_headers(F.create_map(F.lit("Authorization"), k, F.lit("X-Api-KEY"), k, F.lit("x-goog-api-key"), k, F.lit("Accept"), F.lit("*/*"), F.lit("X-Other"), k))
    at = lambda name: F.element_at(F.col("h"), F.lit(name))
    return c.select("c_custkey", h.alias("h")).select("c_custkey", at("Authorization").alias("auth"), at("X-Api-KEY").alias("api_key"), at("x-goog-api-key").alias("google"), at("Accept").alias("accept"), at("X-Other").alias("other"))


@query("SELECT n_nationkey, sha256(CASE WHEN n = 0 THEN '' WHEN n > 65536 THEN chr(10) || '<body truncated: ' || n || ' bytes, showing first 65536>' || chr(10) || substr(t, 1, 65536) || chr(10) ELSE chr(10) || t || chr(10) END) AS shown FROM (SELECT n_nationkey, repeat('ab', 5461 * CAST(n_nationkey AS INTEGER)) AS t, 10922 * n_nationkey AS n FROM nation)")
def body_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as they are logged: nothing, whole, or the first 64 KiB with a note."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.repeat(F.lit("ab"), 5461 * F.col("n_nationkey").cast("int")).alias("t"))
    return n.select("n_nationkey", F.sha2(payload.preview(F.encode("t", "UTF-8")), 256).alias("shown"))


@query("""WITH l AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS t, coalesce(bool_or(role = 'user'), false) AS has FROM conversations GROUP BY conv_id)
SELECT conv_id, t AS contents, t AS nested, t AS input, t AS parts, CASE WHEN has THEN t ELSE '' END AS plain FROM l""")
def latest_user_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest user text from four wire shapes: contents, contents under request, input items, messages with parts."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    parts = lambda x: F.array(F.struct(x["text"].alias("text")))
    contents = F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), parts(x).alias("parts"))).alias("contents"))
    items = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    b = turns.select("conv_id", F.to_json(contents).alias("a"), F.to_json(F.struct(contents.alias("request"))).alias("b"), F.to_json(F.struct(items.alias("input"))).alias("c"), F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), parts(x).alias("content"))).alias("messages"))).alias("d"), F.to_json(F.struct(items.alias("messages"))).alias("e"))
    of = lambda provider, col: payload.latest_user_text(F.lit(provider), F.col(col))
    return b.select("conv_id", of("google-gemini", "a").alias("contents"), of("antigravity", "b").alias("nested"), of("openai", "c").alias("input"), of("mistral", "d").alias("parts"), of("github-copilot", "e").alias("plain"))


@query("SELECT c_custkey, 'ask ' || c_custkey AS marked, 'ask ' || c_custkey AS open, 'ask ' || c_custkey AS bare, CASE WHEN c_custkey % 2 = 0 THEN 'v' || c_custkey ELSE '' END AS field, 'be brief|hi ' || c_custkey || '|a' || chr(10) || 'b' AS prompt FROM customer")
def request_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's request between marks, a string field at the top, system prompt and messages."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k"))
    ask = F.concat(F.lit(" ask "), "k", F.lit("\n"))
    field = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"name":"v'), "k", F.lit('","x":1}'))).otherwise(F.concat(F.lit('{"name":'), "k", F.lit("}")))
    body = F.concat(F.lit('{"system":"be brief","messages":[{"role":"user","content":"hi '), "k", F.lit('"},{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"x"},{"type":"text","text":"b"}]},{"role":"user","content":""}]}'))
    req = lambda x: payload.user_request(x)
    return c.select("c_custkey", req(F.concat(F.lit("x <USER_REQUEST>"), ask, F.lit("</USER_REQUEST> y"))).alias("marked"), req(F.concat(F.lit("x <USER_REQUEST>"), ask)).alias("open"), req(ask).alias("bare"), payload.json_string(field, "name").alias("field"), F.array_join(F.transform(payload.prompt_messages(body), lambda m: m["text"]), "|").alias("prompt"))


@query("""SELECT c_custkey, '{"a":"k' || c_custkey || '","thoughtSignature":"' || repeat(' ', length('sig' || c_custkey)) || '","c":[{"type":"thinking","thinking":"' || repeat(' ', length('mail bob' || c_custkey || '@example.org')) || '","signature":"  "},{"type":"text","text":"x' || c_custkey || '"},{"type":"redacted_thinking","data":"   "}]}' AS body FROM customer""")
def blanked_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures and thinking blocks are blanked in place, so offsets stay."""
    k = F.col("c_custkey").cast("string")
    body = F.concat(F.lit('{"a":"k'), k, F.lit('","thoughtSignature":"sig'), k, F.lit('","c":[{"type":"thinking","thinking":"mail bob'), k, F.lit('@example.org","signature":"zz"},{"type":"text","text":"x'), k, F.lit('"},{"type":"redacted_thinking","data":"abc"}]}'))
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", payload.blanked(body).alias("body"))


@query("SELECT c_custkey, 3 AS images, 'iVBORw0KGgoAAAANSUhEUg' || lpad(CAST(c_custkey AS VARCHAR), 10, 'A') AS first FROM customer")
def inline_images_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline images in three wire shapes."""
    data = F.concat(F.lit("iVBORw0KGgoAAAANSUhEUg"), F.lpad(F.col("c_custkey").cast("string"), 10, "A"))
    body = F.concat(F.lit('{"source":{"media_type":"image/png","data":"'), data, F.lit('"}},{"inlineData":{"mimeType": "image/jpeg","data":"'), data, F.lit('"}},{"image_url":"data:image/gif;base64,'), data, F.lit('"},{"media_type":"text/plain","data":"'), data, F.lit('"}'))
    return table(spark, sf_dir, "customer").select("c_custkey", payload.inline_images(body).alias("i")).select("c_custkey", F.size("i").alias("images"), F.get("i", F.lit(0)).alias("first"))


_WHO = ("anthropic", "openai", "google-gemini", "mistral", "github-copilot", "generic")
_WHO_SQL = "CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_WHO)) + " END"


@query(f"""SELECT c_custkey, {_WHO_SQL} AS provider,
  CASE c_custkey % 6 WHEN 2 THEN c_custkey % 4 < 2 ELSE c_custkey % 3 = 0 OR c_custkey % 5 = 0 END AS stream, c_custkey % 2 = 0 AS event_stream, c_custkey % 7 = 0 AS websocket, c_custkey % 4 = 1 AS says_mask,
  CASE c_custkey % 6 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'gemini' WHEN 3 THEN 'vibe' WHEN 4 THEN 'copilot' ELSE '<cli>' END AS command, 'u="http://h:' || c_custkey || '/v1"' AS arg FROM customer""")
def request_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wants a stream, which replies are streams, upgrades, mask replies, commands and their arguments."""
    key = F.col("c_custkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))
    path = F.when(key % 4 < 2, "/v1/models/x:streamGenerateContent").otherwise("/v1/models/x:generateContent")
    accept = F.when(key % 3 == 0, "text/event-stream, */*").otherwise("application/json")
    body = F.when(key % 5 == 0, '{"stream": true}').otherwise('{"stream":false}')
    headers = F.create_map(F.lit("upgrade"), F.when(key % 7 == 0, "WebSocket").otherwise("h2c"), F.lit("connection"), F.lit("keep-alive, Upgrade"))
    kind = pick(["text/event-stream; charset=utf-8", "application/json", "application/vnd.x.stream+json", "text/plain"])
    word = pick(["mask this", " Mask \n", "masking", "no"])
    return table(spark, sf_dir, "customer").select("c_custkey", pick(_WHO).alias("provider"), wants_streaming(pick(_WHO), path, accept, body).alias("stream"), auditlog.is_streaming(kind).alias("event_stream"), auditlog.is_websocket(headers).alias("websocket"), is_affirmation(word).alias("says_mask"), provider_command(pick(_WHO)).alias("command"), fill_endpoint(F.lit('u="{{endpoint}}/v1"'), F.concat(F.lit("http://h:"), key.cast("string"))).alias("arg"))


@query("""SELECT c_custkey, 'say "' || c_custkey || '"' || chr(10) || 'end' AS one, CASE c_custkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 8 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 8 END AS frames,
  repeat('say "' || c_custkey || '"' || chr(10) || 'end', CASE c_custkey % 5 WHEN 1 THEN 5 WHEN 4 THEN 5 ELSE 1 END) AS streamed FROM customer""")
def model_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic model turns of five providers: the text of the single object, the frames of the stream and every text in them."""
    key = F.col("c_custkey")
    who = F.get(F.array(*map(F.lit, _WHO[:5])), (key % 5).cast("int"))
    text = F.concat(F.lit('say "'), key.cast("string"), F.lit('"\nend'))
    turn = lambda many: model_turn(who, F.lit("/v1/x"), text, F.lit(None).cast("string"), F.lit(many))
    paths = ("$.content[0].text", "$.output[0].content[0].text", "$.candidates[0].content.parts[0].text", "$.choices[0].message.content")
    t = table(spark, sf_dir, "customer").select("c_custkey", turn(False).alias("o"), turn(True).alias("s"))
    frames = F.transform(F.filter(F.split("s", "\n\n"), lambda f: F.contains(f, F.lit("data: {"))), lambda f: F.regexp_replace(f, r"(?s)\A.*?data: ", ""))
    # The text ends with a word that nothing else in a frame has: it is read back wherever it stands.
    found = F.flatten(F.transform(frames, lambda f: F.regexp_extract_all(f, F.lit(r'"(say (?:[^"\\]|\\.)*)"'), 1)))
    plain = F.transform(found, lambda x: F.replace(F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")))
    return t.select("c_custkey", F.coalesce(*[F.get_json_object("o", p) for p in paths]).alias("one"), F.size(frames).alias("frames"), F.array_join(plain, "").alias("streamed"))


_LABEL_SQL = "CASE rule_id " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.LABELS.items()) + " ELSE 'VAR' END"


@query(f"""{_ALL} SELECT payload_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, string_agg(DISTINCT {_LABEL_SQL}, ',' ORDER BY {_LABEL_SQL}) AS labels, CAST(count(DISTINCT identity) AS INTEGER) AS values_masked,
  bool_or(starts_with(category, 'pii')) AS pii, bool_or(NOT starts_with(category, 'pii') AND category NOT IN ('attachment', 'internal-ip')) AS secret, bool_and(off >= 3 AND "end" - 3 <= length(text)) AS redactable,
  '[masked] ' || CASE WHEN count(DISTINCT identity) = 1 THEN 'One value is' ELSE count(DISTINCT identity) || ' values are' END || ' replaced by placeholders for the rest of this session. Please repeat your last message.' AS ack
FROM f JOIN {CATALOG_SQL} c USING (payload_id) GROUP BY payload_id""")
def reply_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replies are made of: rules, labels, values to mask, kinds, whether a body behind a prefix of three bytes can be redacted."""
    p = catalog(spark)
    f = findings_by_payload(detect(p, "payload_id", "text"), "payload_id").join(p.withColumnRenamed("payload_id", "p"), F.col("payload_id") == F.col("p"))
    fs = F.col("findings")
    labels = F.array_sort(F.array_distinct(F.transform(fs, lambda x: placeholder_label(x["rule_id"]))))
    n = F.size(maskable(fs))
    return f.select("payload_id", F.array_join(F.array_sort(rule_list(fs)), ",").alias("rules"), F.array_join(labels, ",").alias("labels"), n.alias("values_masked"), has_pii(fs).alias("pii"), has_secret(fs).alias("secret"), redactable(fs, F.octet_length("text"), F.lit(3), F.lit(False)).alias("redactable"), mask_ack(n).alias("ack"))


_RULE_IDS = ", ".join(f"({q(r.rule_id)})" for r in [*R.BUILTIN, *R.DIGITS, *R.TOKENS])


@query(f"{_ALL} SELECT rule_id FROM (VALUES {_RULE_IDS}) AS r(rule_id) WHERE rule_id NOT IN (SELECT rule_id FROM f)")
def rules_without_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that no text of the golden catalogue fires."""
    return rule_coverage(detect(catalog(spark), "payload_id", "text"), spark)


@query(f"""{_ALL} SELECT c.payload_id, 'scan' AS event, CAST({len(R.BUILTIN)} AS BIGINT) AS rules, CAST(strlen(text) AS BIGINT) AS bytes, CAST(count(f.rule_id) AS BIGINT) AS findings, coalesce(string_agg(f.snippet, '|' ORDER BY f.snippet), '') AS snippets,
  CASE WHEN count(f.rule_id) > 0 THEN 'BLOCKED' ELSE 'FORWARD' END AS decision, count(f.rule_id) = 0 AS sent FROM {CATALOG_SQL} c LEFT JOIN f USING (payload_id) GROUP BY c.payload_id, text""")
def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debug traces and outcomes as JSON lines, read back."""
    p = catalog(spark).select("payload_id", F.lit("POST").alias("method"), F.lit("/v1/messages").alias("uri"), F.encode("text", "UTF-8").alias("body"), "text")
    f = detect(p, "payload_id", "text")
    lines = auditlog.trace_rows(p, f, ["digit-ids", "alnum-ids"])
    event = F.from_json("value", "struct<event:string,coverage:struct<rules:bigint>,req_bytes:bigint,findings:array<struct<snippet:string>>>")
    t = lines.select("payload_id", event.alias("e"))
    hit = f.groupBy(F.col("payload_id").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    d = p.join(hit, F.col("payload_id") == F.col("h"), "left").select(F.col("payload_id"), F.when(F.col("n") > 0, "BLOCKED").otherwise("FORWARD").alias("decision"))
    o = auditlog.outcome_rows(d).select(F.col("payload_id").alias("o"), F.from_json("value", "struct<decision:string,sent_upstream:boolean>").alias("x"))
    j = t.join(o, F.col("payload_id") == F.col("o"))
    return j.select("payload_id", "e.event", F.col("e.coverage.rules").alias("rules"), F.col("e.req_bytes").alias("bytes"), F.size("e.findings").cast("long").alias("findings"), F.array_join(F.array_sort(F.transform("e.findings", lambda x: x["snippet"])), "|").alias("snippets"), F.col("x.decision").alias("decision"), F.col("x.sent_upstream").alias("sent"))


NAMES = [n for n, f in QUERIES.items() if f.__module__ == __name__]
