"""Request/response tables (S8): JSON request bodies in, status rows out.

Scoring requests arrive as a table of JSON texts (one per row) instead of one
HTTP call each; parsing is ``from_json`` with an explicit schema, responses
are ``to_json`` of a struct. A body that is not JSON, or lacks every
requested field, becomes an ``error`` row rather than failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_requests(df: DataFrame, body: str, schema, key: str | None = None) -> DataFrame:
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    parsed = F.from_json(F.col(body), st, {"mode": "PERMISSIVE"})
    fields = [f.name for f in st.fields]
    ok = F.lit(False)
    for f in fields:
        ok = ok | parsed[f].isNotNull()
    cols = ([F.col(key)] if key else []) + [parsed[f].alias(f) for f in fields]
    return df.select(*cols, F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"))


def to_responses(df: DataFrame, fields, key: str | None = None, out: str = "response") -> DataFrame:
    """``{"status": ..., "<field>": ...}`` JSON text per row."""
    cols = [F.col(key)] if key else []
    return df.select(*cols, F.to_json(F.struct(*[F.col(f) for f in fields])).alias(out))
