"""Explicit schemas; nothing is inferred from data."""

from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One JSONL line; fields that are not listed are ignored.
RAW = struct(
    timestamp=S,
    type=S,
    costUSD=D,
    message=struct(
        model=S,
        usage=struct(input_tokens=L, output_tokens=L, cache_read_input_tokens=L, cache_creation_input_tokens=L),
        content=T.ArrayType(struct(type=S, name=S, input=struct(old_string=S, new_string=S))),
    ),
    toolUseResult=struct(structuredPatch=T.ArrayType(struct(lines=T.ArrayType(S))), originalFile=S, content=S, oldString=S),
)

TOKENS = ["input", "output", "cache_read", "cache_creation"]
LINES = ["suggested", "accepted", "added", "deleted"]
MEASURES = [*TOKENS, "cost", *LINES]
#: The seven measures of the daily and minute series.
SERIES = ["input", "output", "cost", *LINES]

EVENT = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("model", S), *[T.StructField(m, D if m == "cost" else L) for m in MEASURES], T.StructField("session_file", S)])
SESSION_MAP = struct(session_file=S, root=S, cwd=S)
DAY = T.StructType([T.StructField("root", S), T.StructField("cwd", S), T.StructField("date", T.DateType()), *[T.StructField(m, D if m == "cost" else L) for m in MEASURES], T.StructField("active_minutes", L)])
SOURCES = struct(dir_name=S, path=S, session_files=T.ArrayType(S), cwd=S, source_root=S)
