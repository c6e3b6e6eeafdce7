"""Exports of chats: three formats to conversations and turns, in expressions over parsed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.scalar import epoch_iso, normal_timestamp
from claimlake.operators.closure import follow

_CLAUDE = "array<struct<uuid string, name string, created_at string, chat_messages array<struct<uuid string, sender string, text string, created_at string>>>>"
_MESSAGE = "struct<id string, author struct<role string>, role string, create_time double, content struct<parts array<string>>>"
_TREE = f"array<struct<id string, title string, create_time double, mapping map<string, struct<id string, parent string, message {_MESSAGE}>>>>"
_FLAT = "array<struct<id string, title string, messages array<struct<id string, role string, content string, text string, timestamp string, create_time double>>>>"
_LIST = "array<struct<role string, content string, text string, timestamp string>>"


def detect(text: Column) -> Column:
    """chat_claude, chat_openai, chat_generic or json, by the first element; tried in this order."""
    first = F.coalesce(F.get_json_object(text, "$[0]"), text)
    has = lambda key: F.get_json_object(first, f"$.{key}").isNotNull()
    openai = has("mapping") | F.get_json_object(first, "$.messages[0].role").isNotNull()
    generic = has("role") & (has("content") | has("text"))
    return F.when(has("chat_messages") & has("uuid"), "chat_claude").when(openai, "chat_openai").when(generic, "chat_generic").otherwise("json")


def role_label(role: Column) -> Column:
    lower = F.lower(role)
    return F.when(lower.isin("human", "user"), "HUMAN").when(lower.isin("assistant", "claude"), "ASSISTANT").otherwise(F.upper(role))


def block_text(role: Column, ts: Column, text: Column) -> Column:
    stamp = F.when(F.coalesce(ts, F.lit("")) != "", F.concat(F.lit(" ["), ts, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(role_label(role), stamp, F.lit(":\n"), text)


def _claude(docs: DataFrame) -> DataFrame:
    c = docs.select("path", F.posexplode(F.from_json("text", _CLAUDE)).alias("conv", "c"))
    return c.select("path", "conv", F.col("c.name").alias("title"), normal_timestamp(F.col("c.created_at")).alias("started_at"), F.posexplode_outer("c.chat_messages").alias("pos", "m")).select(
        "path", "conv", "title", "started_at", "pos", F.col("m.sender").alias("role"), F.col("m.text").alias("text"), normal_timestamp(F.col("m.created_at")).alias("ts")
    )


def tree_path(nodes: DataFrame) -> DataFrame:
    """nodes (path, conv, node, parent, create_time, ...) -> those on the way from the root along the last child by
    time, with ``pos``. Steps are doubled each round, in all conversations at once."""
    at = lambda c: F.to_json(F.struct("path", "conv", F.col(c).alias("node")))
    last = F.struct(F.col("create_time").isNotNull().alias("known"), "create_time", "node")
    best = nodes.where("parent is not null").groupBy("path", "conv", "parent").agg(F.max(last)["node"].alias("node"))
    known = nodes.select("path", "conv", F.col("node").alias("parent"))
    roots = nodes.join(known, ["path", "conv", "parent"], "left_anti").groupBy("path", "conv").agg(F.min("node").alias("node"))
    walked = follow(roots.select(at("node").alias("start")), best.select(at("parent").alias("node"), at("node").alias("to")))
    node = F.from_json("node", "path string, conv int, node string").alias("n")
    return walked.select(node, F.col("pos").cast("int").alias("pos")).select("n.path", "n.conv", "n.node", "pos")


def _openai(docs: DataFrame) -> DataFrame:
    flat = docs.where(F.get_json_object("text", "$[0].messages").isNotNull())
    c = flat.select("path", F.posexplode(F.from_json("text", _FLAT)).alias("conv", "c"))
    flat = c.select("path", "conv", F.col("c.title").alias("title"), F.posexplode_outer("c.messages").alias("pos", "m")).select(
        "path", "conv", "title", F.lit(None).cast("string").alias("started_at"), "pos", F.col("m.role").alias("role"), F.coalesce("m.content", "m.text").alias("text"), F.coalesce("m.timestamp", epoch_iso(F.col("m.create_time"))).alias("ts")
    )
    c = docs.where(F.get_json_object("text", "$[0].mapping").isNotNull()).select("path", F.posexplode(F.from_json("text", _TREE)).alias("conv", "c"))
    nodes = c.select("path", "conv", F.col("c.title").alias("title"), epoch_iso(F.col("c.create_time")).alias("started_at"), F.explode("c.mapping").alias("node", "n"))
    nodes = nodes.select("path", "conv", "title", "started_at", "node", F.col("n.parent").alias("parent"), F.col("n.message.create_time").alias("create_time"), F.coalesce("n.message.author.role", "n.message.role").alias("role"), F.array_join("n.message.content.parts", "\n").alias("text"))
    walked = tree_path(nodes.select("path", "conv", "node", "parent", "create_time"))
    tree = nodes.join(walked, ["path", "conv", "node"]).select("path", "conv", "title", "started_at", "pos", "role", "text", epoch_iso(F.col("create_time")).alias("ts"))
    return flat.unionByName(tree)


def _generic(docs: DataFrame) -> DataFrame:
    m = docs.select("path", F.posexplode(F.from_json("text", _LIST)).alias("pos", "m"))
    return m.select("path", F.lit(0).alias("conv"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("started_at"), "pos", F.col("m.role").alias("role"), F.coalesce("m.content", "m.text").alias("text"), F.col("m.timestamp").alias("ts"))


def turns(docs: DataFrame) -> DataFrame:
    """docs (path, text of a JSON export) -> path, format, conv, title, started_at, pos, role, text, ts; blank turns are
    left out."""
    kinds = docs.withColumn("format", detect(F.col("text")))
    parts = [read(kinds.where(F.col("format") == kind)).withColumn("format", F.lit(kind)) for kind, read in (("chat_claude", _claude), ("chat_openai", _openai), ("chat_generic", _generic))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("trim(coalesce(text, '')) <> ''")


def blocks(rows: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns (key, turn, role, text[, ts]) as blocks."""
    ts = F.col("ts") if "ts" in rows.columns else F.lit(None).cast("string")
    return rows.where("trim(coalesce(text, '')) <> ''").select(key, F.col(turn).alias("turn_index"), role_label(F.col("role")).alias("role"), block_text(F.col("role"), ts, F.col("text")).alias("block"))


def metadata(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """message_count by conversation, meta turns not counted."""
    return rows.groupBy(key).agg(F.count_if(F.coalesce(F.lower("role"), F.lit("")) != "meta").alias("message_count"))
