"""Chat histories whose items are a tagged union: text, a tool's call, or its response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An item has one of the tags, and nulls for the others.
ITEM = "struct<Text: string, ToolCallRequest: struct<id: string, tool_name: string, args: string>, ToolCallResponse: struct<id: string, tool_name: string, result: string>>"
TAGS = ("Text", "ToolCallRequest", "ToolCallResponse")


def contents(messages: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, at, kind, id, tool_name, body): a row for each item of a JSON array of items; an array that cannot be read gives none."""
    flat = messages.select(*keys, F.posexplode(F.from_json(content, f"array<{ITEM}>")).alias("at", "item"))
    pick = lambda field, other: F.coalesce(F.col(f"item.ToolCallRequest.{field}"), F.col(f"item.ToolCallResponse.{other}"))
    kind = F.coalesce(*(F.when(F.col(f"item.{t}").isNotNull(), t) for t in TAGS))
    return flat.select(*keys, "at", kind.alias("kind"), pick("id", "id").alias("id"), pick("tool_name", "tool_name").alias("tool_name"), F.coalesce(F.col("item.Text"), pick("args", "result")).alias("body"))


def tool_pairs(items: DataFrame, conversation: str) -> DataFrame:
    """(conversation, id, tool_name, request, response): calls with their responses by id; a call without one has a null."""
    calls = items.where("kind = 'ToolCallRequest'").select(conversation, "id", "tool_name", F.col("body").alias("request"))
    answers = items.where("kind = 'ToolCallResponse'").select(conversation, "id", F.col("body").alias("response"))
    return calls.join(answers, [conversation, "id"], "left")


def item(tag: str, **fields: Column) -> Column:
    """JSON of one item with this tag."""
    value = fields["body"] if tag == "Text" else F.struct(*(c.alias(n) for n, c in fields.items()))
    return F.to_json(F.struct(value.alias(tag)))


def values(messages: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, at, kind, id, tool_name, text, value, unreadable): a row for each item of a JSON array of items, with what tools were given and gave as values (VARIANT).

    Arguments and results may be any JSON, and differ from item to item. An item is readable if it is an object of one known tag: a text is a string; a call or response has an id and a name,
    both strings, and an ``args`` or ``result``, which may be null. Another item has its JSON in ``unreadable`` and nulls beside it, and the others of its array are read. A content that is no JSON
    array is one unreadable row without a place; a null content gives none.
    """
    given = messages.where(F.col(content).isNotNull()).select(*keys, F.col(content).alias("_raw"), F.try_variant_get(F.try_parse_json(content), "$", "array<variant>").alias("_items"))
    flat = given.where("_items is not null").select(*keys, F.posexplode("_items").alias("at", "_item"))
    typed = lambda path, kind: F.schema_of_variant(F.try_variant_get("_item", path, "variant")) == kind
    there = lambda path: F.try_variant_get("_item", path, "variant").isNotNull()
    text = lambda path: F.try_variant_get("_item", path, "string")
    one_tag = F.size(F.map_keys(F.try_variant_get("_item", "$", "map<string,variant>"))) == 1
    kind, value, own_id, name = (F.lit(None) for _ in range(4))
    for tag, field in (("ToolCallRequest", "args"), ("ToolCallResponse", "result")):
        fits = one_tag & typed(f"$.{tag}.id", "STRING") & typed(f"$.{tag}.tool_name", "STRING") & there(f"$.{tag}.{field}")
        kind, own_id, name = F.when(fits, tag).otherwise(kind), F.when(fits, text(f"$.{tag}.id")).otherwise(own_id), F.when(fits, text(f"$.{tag}.tool_name")).otherwise(name)
        value = F.when(fits, F.try_variant_get("_item", f"$.{tag}.{field}", "variant")).otherwise(value)
    said = one_tag & typed("$.Text", "STRING")
    rows = flat.select(*keys, "at", F.when(said, "Text").otherwise(kind).alias("kind"), own_id.cast("string").alias("id"), name.cast("string").alias("tool_name"), F.when(said, text("$.Text")).alias("text"), value.cast("variant").alias("value"), F.to_json("_item").alias("unreadable"))
    rows = rows.withColumn("unreadable", F.when(F.col("kind").isNull(), F.col("unreadable")))
    null = lambda t: F.lit(None).cast(t)
    broken = given.where("_items is null").select(*keys, null("int").alias("at"), *(null("string").alias(c) for c in ("kind", "id", "tool_name", "text")), null("variant").alias("value"), F.col("_raw").alias("unreadable"))
    return rows.unionByName(broken)


def value_pairs(items: DataFrame, conversation: str) -> DataFrame:
    """(conversation, id, tool_name, args, result): calls with their responses by id, as values; a call without a response has no result."""
    calls = items.where("kind = 'ToolCallRequest'").select(conversation, "id", "tool_name", F.col("value").alias("args"))
    answers = items.where("kind = 'ToolCallResponse'").select(conversation, "id", F.col("value").alias("result"))
    return calls.join(answers, [conversation, "id"], "left")


def value_schemas(items: DataFrame) -> DataFrame:
    """(kind, tool_name, schema, n): the least schema that all values of a tool's calls, or responses, have."""
    return items.where("value is not null").groupBy("kind", "tool_name").agg(F.schema_of_variant_agg("value").alias("schema"), F.count("*").alias("n"))
