"""Row types of the engine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

from notegauge.vocab import DIMENSIONS



def struct(**fields: T.DataType | type[T.DataType]) -> T.StructType:
    """A struct type; built without a session, since Python workers import this too."""
    return T.StructType([T.StructField(k, v if isinstance(v, T.DataType) else v()) for k, v in fields.items()])


def arrow_type(t: T.DataType) -> pa.DataType:
    """The Arrow type of texts, whole numbers, and arrays and structs of them."""
    if isinstance(t, T.ArrayType):
        return pa.list_(arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in t])
    return {T.StringType: pa.string(), T.IntegerType: pa.int32()}[type(t)]


FINDING = struct(code=T.StringType, message=T.StringType)
RECOMMENDATION = struct(mode=T.StringType, message=T.StringType)
EVIDENCE = struct(excerpt=T.StringType, reason=T.StringType)
DIMENSION_SCORES = T.StructType([T.StructField(d, T.IntegerType()) for d in DIMENSIONS])
JUDGMENT = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("prompt_version", T.StringType()),
        T.StructField("note_path", T.StringType()),
        T.StructField("dimension_adjustments", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("findings", T.ArrayType(T.StructType([*FINDING.fields, T.StructField("evidence", T.ArrayType(EVIDENCE))]))),
        T.StructField("factual_risk", T.BooleanType()),
        T.StructField("factual_risk_reason", T.StringType()),
        T.StructField("fact_check_required", T.BooleanType()),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
    ]
)
#: Fields in alphabetical order, as rows are written.
AUDIT_ROW = T.StructType(
    sorted(
        [
            *[T.StructField(c, T.StringType()) for c in ("schema_version", "run_id", "row_status", "note_path", "note_link", "content_hash", "modified_time", "created_time", "priority", "cache_status", "factual_risk_reason", "doctrine_version", "rubric_version", "prompt_version")],
            T.StructField("score", T.IntegerType()),
            *[T.StructField(c, T.BooleanType()) for c in ("clean", "pending_model", "factual_risk", "fact_check_required")],
            T.StructField("dimensions", DIMENSION_SCORES),
            T.StructField("findings", T.ArrayType(FINDING)),
            T.StructField("recommendations", T.ArrayType(RECOMMENDATION)),
            T.StructField("model_judgment", JUDGMENT),
            T.StructField("config_snapshot", T.MapType(T.StringType(), T.StringType())),
        ],
        key=lambda f: f.name,
    )
)
NOTE = struct(note_path=T.StringType, stem=T.StringType, content=T.StringType, modified_time=T.TimestampType)
