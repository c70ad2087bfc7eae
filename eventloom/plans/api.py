"""remap(): a program over a DataFrame; search(): a search query as a filter; evaluate(): a program on one event."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.lang.syntax import CompileError, parse
from eventloom.lang.unused import Warning, check

from .lowering import Lowering
from .typed import Kind, Typed, as_kind, json_text, kind_of

KEEP_MERGED_KEYS = "spark.sql.mapKeyDedupPolicy"
BATCH_BYTES = 4 << 20


def _functions() -> None:
    from eventloom.functions import load

    load()


def warnings(program: str) -> list[Warning]:
    """What of a program is of no use: results and variables that nothing takes."""
    return check(parse(program))


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, so that Python workers hold as much of long texts as of short ones; a session with a smaller bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def compiled(df: DataFrame, program: str, read_only: Sequence[str] = ()) -> tuple[Lowering, Typed]:
    _functions()
    df.sparkSession.conf.set(KEEP_MERGED_KEYS, "LAST_WIN")
    small_batches(df.sparkSession)
    low = Lowering(df, read_only)
    result = low.run(parse(program))
    return low, result


def remap(df: DataFrame, program: str, on_failure: str = "keep", status: bool | None = None, read_only: Sequence[str] = ()) -> DataFrame:
    """df with program applied to each row as an event of its columns.

    A row whose program aborts or fails keeps its input values where their kind is unchanged and null elsewhere
    (on_failure="keep"), or goes ("drop"). Columns _status (ok, returned, aborted, error) and _message are added if the
    program can end early, or as status says. read_only: paths (".a.b", "%m", ".c.*" with all below it) that a program which changes them doesn't
    compile with. An array of objects as the event makes one row of each element.
    """
    if on_failure not in ("keep", "drop"):
        raise ValueError("on_failure is keep or drop")
    low, _ = compiled(df, program, read_only)
    env = low.env
    ends = env.status is not None
    failed = env.status.isin("aborted", "error") if ends else F.lit(False)
    event = env.event
    out = low.df
    if event.kind.tag == "array":
        out = out.select("*", F.explode(event.column()).alias("__event"))
        event = Typed(event.kind.elem, F.col("__event"))
    parts = event.parts if event.parts is not None else low.parts_of(event)
    if not parts and event.kind.tag not in ("object", "null") and event.parts is None:
        parts = {"_event": event}
    source = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    columns = []
    for name, v in parts.items():
        c = v.column() if v.kind.tag != "null" else F.lit(None).cast("string")
        if ends and on_failure == "keep":
            old = as_kind(Typed(source[name], F.col(f"`{name}`")), v.kind).column() if source.get(name) == v.kind else F.lit(None)
            c = F.when(F.coalesce(failed, F.lit(False)), old).otherwise(c)
        columns.append(c.alias(name))
    if ends and on_failure == "drop":
        out = out.where(~F.coalesce(failed, F.lit(False)))
    if status if status is not None else ends and on_failure == "keep":
        columns += [F.coalesce(env.status, F.lit("ok")).alias("_status") if ends else F.lit("ok").alias("_status"), (env.message if ends else F.lit(None).cast("string")).alias("_message")]
    return out.select(*columns)


def result_of(df: DataFrame, program: str, name: str = "result") -> DataFrame:
    """df's columns and the program's value (of its last expression, or of return) as one more column; null where it failed."""
    low, result = compiled(df, program)
    env = low.env
    v = result
    if env.result is not None:
        v = low.choose(env.status == "returned", env.result, v)
    c = v.column() if v.kind.tag != "null" else F.lit(None).cast("string")
    if env.status is not None:
        c = F.when(F.coalesce(env.status.isin("aborted", "error"), F.lit(False)), F.lit(None)).otherwise(c)
    return low.df.select(*[F.col(f"`{n}`") for n in df.columns], c.alias(name))


def evaluate(spark: SparkSession, program: str, event: dict) -> dict:
    """What a program does with one event, for tests and the shell: status, message, result and event as plain data."""
    text = json.dumps(event)
    df = spark.read.json(spark.sparkContext.parallelize([text])) if event else spark.range(1).select()
    df = df.select(*[c for c in df.columns if c != "_corrupt_record"])
    low, result = compiled(df, program)
    env = low.env
    v = low.choose(env.status == "returned", env.result, result) if env.result is not None else result
    status = F.coalesce(env.status, F.lit("ok")) if env.status is not None else F.lit("ok")
    row = low.df.select(status.alias("s"), (env.message if env.message is not None else F.lit(None).cast("string")).alias("m"), json_text(v).alias("r"), json_text(env.event).alias("e")).first()
    return {"status": row["s"], "message": row["m"], "result": json.loads(row["r"]), "event": json.loads(row["e"])}


def search(df: DataFrame, query: str) -> DataFrame:
    """The rows of df that a search query matches: one boolean column, open to pushdown."""
    from eventloom.operators.search import predicate

    event = Lowering(df).env.event
    return df.where(predicate(query, event))


def unnest(df: DataFrame, column: str) -> DataFrame:
    """One row for each element of an array column, in its place."""
    return df.select(*[F.explode(F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


__all__ = ["CompileError", "Kind", "compiled", "evaluate", "remap", "result_of", "search", "unnest", "warnings"]
