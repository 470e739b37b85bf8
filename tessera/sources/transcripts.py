"""JSONL transcripts: one JSON object a line, tool calls with the results that answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCK = "type string, id string, name string, input string, tool_use_id string, content string, text string"
LINE = f"type string, timestamp string, message struct<role:string,content:array<struct<{_BLOCK.replace(' ', ':').replace(',:', ',')}>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, line): the lines of JSONL files; a line is a row, so files are split."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def blocks(lines: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, role, block) of the content blocks of lines(key, order, line). Lines that are no such JSON, torn ones as well, have none."""
    parsed = lines.select(key, order, F.from_json("line", LINE).alias("j"))
    return parsed.select(key, order, F.col("j.message.role").alias("role"), F.explode("j.message.content").alias("block"))


def calls(lines: DataFrame, key: str = "path", order: str = "n") -> DataFrame:
    """(key, order, call, tool, target, bytes): tool calls with the bytes of their results; null without a result.

    target: the first of file_path, command, pattern, query, path, description and prompt that the input has; texts over
    100 characters are cut and end in an ellipsis, but for file paths.
    """
    b = blocks(lines, key, order)
    have = lambda k: F.get_json_object("block.input", f"$.{k}")
    cut = lambda c: F.when(F.length(c) > 100, F.concat(F.left(c, F.lit(100)), F.lit("…"))).otherwise(c)
    target = F.coalesce(have("file_path"), *[cut(have(k)) for k in ("command", "pattern", "query", "path", "description", "prompt")], F.lit(""))
    use = b.where("block.type = 'tool_use'").select(key, order, F.col("block.id").alias("call"), F.col("block.name").alias("tool"), target.alias("target"))
    text = F.col("block.content")
    joined = F.array_join(F.transform(F.filter(F.from_json(text, "array<struct<type:string,text:string>>"), lambda x: x["type"] == "text"), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    plain = F.when(text.startswith("["), joined).otherwise(text)
    results = b.where("block.type = 'tool_result'").groupBy(key, F.col("block.tool_use_id").alias("call")).agg(F.sum(F.octet_length(plain)).alias("bytes"))
    return use.join(results, [key, "call"], "left").select(key, order, "call", "tool", "target", F.col("bytes").cast("long").alias("bytes"))


def spend(found: DataFrame) -> DataFrame:
    """(tool, calls, unanswered, bytes) of calls."""
    return found.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(F.col("bytes").isNull()).alias("unanswered"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
