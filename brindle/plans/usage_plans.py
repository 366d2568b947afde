"""Usage, prices and conversations: queries G4 to G6, G9, J11, S11, L3, C10, C11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import history, usage
from brindle.plans.catalog import query
from brindle.session import scratch_dir
from brindle.sources import batch_files, views
from brindle.sources.views import LEDGER, PRICE_SQL


@query("q_usage_sum", f"WITH {LEDGER} SELECT conv_id, model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(read_tokens)::BIGINT AS read_tokens, sum(written_tokens)::BIGINT AS written_tokens FROM ledger GROUP BY ALL")
def usage_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.totals(views.ledger(spark, sf_dir), "conv_id", "model")


@query("q_usage_rollup", f"WITH {LEDGER} SELECT provider, model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM ledger GROUP BY ROLLUP (provider, model)")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ledger(spark, sf_dir).rollup("provider", "model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


PRICED = f"""WITH {LEDGER}, {PRICE_SQL}, known AS (SELECT * FROM prices WHERE p_in IS NOT NULL AND p_out IS NOT NULL),
priced AS (SELECT l.*, CASE WHEN provider = 'ollama' THEN 0 ELSE coalesce(a.p_in, b.p_in) END AS p_in, CASE WHEN provider = 'ollama' THEN 0 ELSE coalesce(a.p_out, b.p_out) END AS p_out,
  CASE WHEN provider = 'ollama' THEN 0 WHEN a.name IS NOT NULL THEN coalesce(a.p_written, 0) WHEN b.name IS NOT NULL THEN coalesce(b.p_written, 0) END AS p_written,
  CASE WHEN provider = 'ollama' THEN 0 WHEN a.name IS NOT NULL THEN coalesce(a.p_read, 0) WHEN b.name IS NOT NULL THEN coalesce(b.p_read, 0) END AS p_read
  FROM ledger l LEFT JOIN known a ON a.name = l.model LEFT JOIN known b ON b.name = l.provider || '/' || l.model)"""
COST = "greatest(input_tokens - written_tokens - read_tokens, 0) * p_in + written_tokens * p_written + read_tokens * p_read + output_tokens * p_out"


@query("q_price_join", PRICED + " SELECT conv_id, turn, CAST(p_in AS DOUBLE) AS p_in, CAST(p_out AS DOUBLE) AS p_out, CAST(p_written AS DOUBLE) AS p_written, CAST(p_read AS DOUBLE) AS p_read FROM priced")
def price_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.with_prices(views.ledger(spark, sf_dir), views.prices(spark)).select("conv_id", "turn", "price.p_in", "price.p_out", "price.p_written", "price.p_read")


@query("q_cost", PRICED + f" SELECT conv_id, sum(CAST(floor(round(CAST({COST} AS DOUBLE) * 1000000, 6)) AS BIGINT))::BIGINT AS millicents, sum(CAST(floor(round(CAST({COST} AS DOUBLE) * 100, 9)) AS BIGINT))::BIGINT AS cents FROM priced GROUP BY 1")
def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents are cut for each request before they are summed; the finer figure shows what that loses."""
    rows = usage.with_prices(views.ledger(spark, sf_dir), views.prices(spark))
    fine = F.floor(F.round(usage.cost() * 1_000_000, 6)).cast("bigint")
    return rows.groupBy("conv_id").agg(F.sum(fine).alias("millicents"), F.sum(usage.cents()).alias("cents"))


@query("q_message_counts", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))


DATED = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 17)"


@query("q_conversations_latest", f"SELECT conv_id, strftime(min({DATED}), '%Y-%m-%d %H:%M') AS day, count(*) AS n FROM conversations GROUP BY conv_id")
def conversations_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.timestamp_add("MINUTE", F.col("conv_id") * 17, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = views.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return rows.select("conv_id", F.date_format(date, "yyyy-MM-dd HH:mm").alias("day"), "n").orderBy(F.desc("day"), "conv_id")


@query("q_conversation_scan", f"SELECT conv_id, 'Conversation on ' || strftime(min({DATED}), '%Y-%m-%d %H:%M') AS title, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1")
def conversation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations saved as JSON, with a line that is none, and read again."""
    path = scratch_dir(spark) + "/conversations"
    date = F.timestamp_add("MINUTE", F.col("conv_id") * 17, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    batch_files.saved(views.read(spark, sf_dir, "conversations"), date).select(F.explode(F.array(F.to_json(F.struct("conv_id", "part", "title", "date", "history")), F.lit('{"conv_id": tr'))).alias("line")).write.text(path)
    rows = batch_files.conversations(spark, path)
    runs = rows.select("conv_id", "title", F.size("history").cast("bigint").alias("n"), F.aggregate("history", F.lit(0).cast("bigint"), lambda a, m: a + F.char_length(m["text"])).alias("chars"))
    return runs.groupBy("conv_id", "title").agg(F.sum("n").alias("n_messages"), F.sum("chars").alias("n_chars"))


@query("q_format_number", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS price FROM orders")
def format_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("price"))


STEPS = "CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0) ELSE printf('%.1f TB', n / 1099511627776.0) END"


@query("q_format_bytes", f"SELECT doc_id, p, {STEPS} AS size FROM (SELECT doc_id, p, CAST(n_chars * pow(1024, p) AS BIGINT) AS n FROM documents, unnest([0, 1, 2, 3]) AS u(p))")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.array(*map(F.lit, range(4)))).alias("p"))
    return rows.select("doc_id", "p", T.bytes_text((F.col("n_chars") * F.pow(F.lit(1024.0), "p")).cast("bigint")).alias("size"))


@query("q_history_explode", "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def history_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-structured payloads as one row a key."""
    rows = views.read(spark, sf_dir, "events")
    return rows.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, content): what users say calls a tool, what assistants say begins with the response; other roles say text only."""
    call = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    text, tool = history.item("Text", body=F.col("text")), F.lit("search")
    asks = history.item("ToolCallRequest", id=call(F.col("turn")), tool_name=tool, args=F.col("text"))
    says = history.item("ToolCallResponse", id=call(F.col("turn") - 1), tool_name=tool, result=F.col("text"))
    items = F.when(F.col("role") == "user", F.array(text, asks)).when(F.col("role") == "assistant", F.array(says, text)).otherwise(F.array(text))
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("content"))


@query(
    "q_tool_pairs",
    """WITH calls AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), answers AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant')
  SELECT c.conv_id, 'call-' || CAST(c.turn AS VARCHAR) AS id, 'search' AS tool_name, md5(c.text) AS request_md5, md5(a.text) AS response_md5 FROM calls c LEFT JOIN answers a USING (conv_id, turn)""",
)
def tool_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and responses out of one tagged history, paired by their id."""
    items = history.contents(histories(spark, sf_dir), ["conv_id", "turn"], "content")
    return history.tool_pairs(items, "conv_id").select("conv_id", "id", "tool_name", F.md5("request").alias("request_md5"), F.md5("response").alias("response_md5"))


@query(
    "q_history_items",
    """SELECT conv_id, turn, count(*) AS n_items, string_agg(kind, ',' ORDER BY pos) AS kinds FROM (SELECT conv_id, turn, unnest(CASE role WHEN 'user' THEN ['Text', 'ToolCallRequest'] WHEN 'assistant' THEN ['ToolCallResponse', 'Text'] ELSE ['Text'] END) AS kind,
  unnest(CASE role WHEN 'user' THEN [0, 1] WHEN 'assistant' THEN [0, 1] ELSE [0] END) AS pos FROM conversations) GROUP BY ALL""",
)
def history_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = history.contents(histories(spark, sf_dir), ["conv_id", "turn"], "content")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"])
    return items.groupBy("conv_id", "turn").agg(F.count("*").alias("n_items"), F.array_join(listed, ",").alias("kinds"))


def valued_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, content): calls with nested arguments, responses that are a list, a number or null by their turn, and beside each response an item that is none."""
    call = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    args = F.struct(F.col("text").alias("query"), F.struct(F.col("turn").alias("limit"), F.array(F.struct(F.col("role").alias("by"), F.char_length("text").alias("n"))).alias("filters")).alias("how"))
    asks = history.item("ToolCallRequest", id=call(F.col("turn")), tool_name=F.lit("search"), args=args)
    result = F.when(F.pmod("turn", F.lit(3)) == 0, F.to_json(F.array("text"))).when(F.pmod("turn", F.lit(3)) == 1, F.char_length("text").cast("string")).otherwise("null")
    says = F.concat(F.lit('{"ToolCallResponse": {"id": "'), call(F.col("turn") - 1), F.lit('", "tool_name": "search", "result": '), result, F.lit("}}"))
    items = F.when(F.col("role") == "user", F.array(asks)).when(F.col("role") == "assistant", F.array(F.lit('{"ToolCallResponse": 5}'), says)).otherwise(F.array(F.to_json(F.struct(F.col("text").alias("Text")))))
    return views.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("content"))


@query(
    "q_tool_values",
    """WITH calls AS (SELECT conv_id, turn, text, role FROM conversations WHERE role = 'user'), answers AS (SELECT conv_id, turn - 1 AS turn, text, turn % 3 AS t FROM conversations WHERE role = 'assistant')
  SELECT c.conv_id, 'call-' || CAST(c.turn AS VARCHAR) AS id, md5(c.text) AS query_md5, c.turn AS "limit", c.role AS "by", CAST(length(c.text) AS BIGINT) AS n,
    CASE WHEN t = 0 THEN md5(a.text) END AS first_md5, CASE WHEN t = 1 THEN CAST(length(a.text) AS BIGINT) END AS number FROM calls c LEFT JOIN answers a USING (conv_id, turn)""",
)
def tool_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested arguments and mixed results, taken out of values."""
    items = history.values(valued_histories(spark, sf_dir), ["conv_id", "turn"], "content")
    get = lambda column, path, kind: F.try_variant_get(column, path, kind)
    return history.value_pairs(items, "conv_id").select(
        "conv_id", "id", F.md5(get("args", "$.query", "string")).alias("query_md5"), get("args", "$.how.limit", "bigint").alias("limit"), get("args", "$.how.filters[0].by", "string").alias("by"), get("args", "$.how.filters[0].n", "bigint").alias("n"),
        F.md5(get("result", "$[0]", "string")).alias("first_md5"), get("result", "$", "bigint").alias("number"),
    )


@query("q_unreadable_items", """SELECT conv_id, turn, 0 AS "at", '{"ToolCallResponse":5}' AS unreadable FROM conversations WHERE role = 'assistant'""")
def unreadable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.values(valued_histories(spark, sf_dir), ["conv_id", "turn"], "content").where("unreadable is not null").select("conv_id", "turn", "at", "unreadable")
