"""Redaction of chat messages.

A message is struct<info:struct<system,summary:struct<body>>, parts:array<struct<type,text,
state:struct<output,error>,source:struct<text:struct<value>>>>>.  All strings of a message are
laid out in one array, redacted in one Arrow pass and put back; text stays as it was where
nothing is replaced, blank and NULL text too.  Without a detector whole texts are searched.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.detector import Detector
from veilspark.operators.kernel import LazyKernel

_ITEM = pa.struct([("text", pa.string()), ("n", pa.int32())])


def redact_strings(texts: Column, detector: Detector | None = None) -> Column:
    """array<struct<text, n>> for an array of strings, element by element."""
    config = (detector or Detector.whole()).config
    kernel = LazyKernel(config, entropy=config.entropy.enabled and config.entropy.mode == "auto")

    def one(text: str | None) -> dict:
        if text is None or not text.strip():
            return {"text": text, "n": 0}
        out = kernel().filter(text)
        # of a text that a limit has cut the tail wasn't searched, so it doesn't pass either
        return {"text": out["text"] if out["replacements"] or out["truncated"] else text, "n": out["replacements"]}

    @F.arrow_udf("array<struct<text:string,n:int>>")
    def redact(column: pa.Array) -> pa.Array:
        return pa.array([None if row is None else [one(x) for x in row] for row in column.to_pylist()], pa.list_(_ITEM))

    return redact(texts)


def _slots(part: Column) -> Column:
    kind = part["type"]
    return F.array(
        F.when(kind.isin("text", "reasoning"), part["text"]),
        F.when(kind == "tool", part["state"]["output"]),
        F.when(kind == "tool", part["state"]["error"]),
        F.when(kind == "file", part["source"]["text"]["value"]),
    )


def redact_messages(df: DataFrame, messages: str = "messages", detector: Detector | None = None) -> DataFrame:
    """``messages`` with redacted strings, and total_redacted. Other kinds of part pass unchanged."""
    m = F.col(messages)
    flat = F.flatten(F.transform(m, lambda x: F.concat(F.array(x["info"]["system"], x["info"]["summary"]["body"]), F.coalesce(F.flatten(F.transform(x["parts"], _slots)), F.array().cast("array<string>")))))
    # where each message's strings begin
    sizes = F.transform(m, lambda x: F.lit(2) + 4 * F.greatest(F.coalesce(F.size(x["parts"]), F.lit(0)), F.lit(0)))
    base = F.transform(m, lambda x, i: F.aggregate(F.slice(F.col("_sizes"), 1, i), F.lit(0), lambda a, b: a + b))
    out = F.col("_out")

    def put(part: Column, at: Column) -> Column:
        new = lambda k: F.get(out, at + k)["text"]
        kind = part["type"]
        state = F.when(part["state"].isNotNull(), part["state"].withField("output", F.when(kind == "tool", new(1)).otherwise(part["state"]["output"])).withField("error", F.when(kind == "tool", new(2)).otherwise(part["state"]["error"])))
        inner = F.when(part["source"]["text"].isNotNull(), part["source"]["text"].withField("value", F.when(kind == "file", new(3)).otherwise(part["source"]["text"]["value"])))
        source = F.when(part["source"].isNotNull(), part["source"].withField("text", inner))
        return part.withField("text", F.when(kind.isin("text", "reasoning"), new(0)).otherwise(part["text"])).withField("state", state).withField("source", source)

    def message(x: Column, i: Column) -> Column:
        at = F.get(F.col("_base"), i)
        parts = F.transform(x["parts"], lambda p, k: put(p, at + 2 + 4 * k))
        summary = F.when(x["info"]["summary"].isNotNull(), x["info"]["summary"].withField("body", F.get(out, at + 1)["text"]))
        info = F.when(x["info"].isNotNull(), x["info"].withField("system", F.get(out, at)["text"]).withField("summary", summary))
        return x.withField("info", info).withField("parts", parts)

    total = F.coalesce(F.aggregate(out, F.lit(0), lambda a, b: a + b["n"]), F.lit(0))
    return (
        df.withColumn("_out", redact_strings(flat, detector))
        .withColumn("_sizes", sizes)
        .withColumn("_base", base)
        .withColumns({messages: F.transform(m, message), "total_redacted": total})
        .drop("_out", "_sizes", "_base")
    )


def redact_tool_output(df: DataFrame, output: str = "output", detector: Detector | None = None) -> DataFrame:
    """``output`` redacted and ``n_redacted``; blank output passes unchanged."""
    done = F.element_at(redact_strings(F.array(F.col(output)), detector), 1)
    return df.withColumn("_done", done).withColumns({output: F.col("_done.text"), "n_redacted": F.col("_done.n")}).drop("_done")


def audit_tool_output(df: DataFrame, tool: str = "tool", n: str = "n_redacted") -> DataFrame:
    """What a log keeps of redacted tool output: a row for each tool, with calls, redacted calls and redactions; never values."""
    return df.groupBy(tool).agg(F.count("*").alias("n_calls"), F.count_if(F.col(n) > 0).alias("n_redacted_calls"), F.sum(n).cast("long").alias("n_redacted"))
