"""Tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


PAGES = _table(("page_id", _L), ("url", _S), ("html", _S))

SOURCES = _table(
    ("page_id", _L), ("url", _S), ("source", _S), ("kind", _S), ("source_ord", _I), ("content", _S))

SCRIPT_REFS = _table(("page_id", _L), ("url", _S), ("ref_ord", _I), ("script_url", _S))

# What a crawler recorded about a URL.
FETCHED = _table(
    ("url", _S), ("method", _S), ("status", _I), ("content_type", _S), ("content_length", _L), ("body", _S))

REGISTRY = _table(("package", _S), ("status", _I))

NAV_EVENTS = _table(
    ("event_id", _L), ("ts", T.TimestampType()), ("tab_id", _L), ("frame_id", _I), ("url", _S))

OCCURRENCES = _table(
    ("page_id", _L), ("category", _S), ("display_key", _S), ("source", _S), ("rule_id", _S),
    ("index", _I), ("secret_length", _I), ("line", _I), ("column", _I), ("http_method", _S),
    ("source_ord", _I), ("rule_ord", _I), ("match_ord", _I))

FINDINGS = _table(
    ("page_id", _L), ("id", _S), ("description", _S), ("secret", _S), ("source", _S),
    ("is_source_too_large", _B), ("line", _I), ("column", _I))

RESULTS_STORE = _table(
    ("key", _S), ("url", _S), ("status", _S), ("n_findings", _L), ("timestamp_ms", _L), ("error", _S))
