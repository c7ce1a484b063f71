"""Column expressions over templated SQL text: dependency calls and placeholders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The call syntax of the template language.
REF_CALL = r"""ref\(\s*['"]([^'"]+)['"]\s*\)"""
SOURCE_CALL = r"""source\(\s*['"]([^'"]+)['"]\s*,\s*['"]([^'"]+)['"]\s*\)"""
REF_TAG = r"\{\{\s*" + REF_CALL + r"\s*\}\}"
SOURCE_TAG = r"\{\{\s*" + SOURCE_CALL + r"\s*\}\}"
ANY_TAG = r"(?s)\{\{.*?\}\}"
UNKNOWN_TAG = "unknown_macro"


def refs_of(sql: Column) -> Column:
    """Targets of all ref calls in text order, repeats kept: ``ARRAY<STRING>``."""
    return F.regexp_extract_all(sql, F.lit(REF_CALL), F.lit(1))


def sources_of(sql: Column) -> Column:
    """All source calls in text order: ``ARRAY<STRUCT<source_name, table_name>>``."""
    names = F.regexp_extract_all(sql, F.lit(SOURCE_CALL), F.lit(1))
    tables = F.regexp_extract_all(sql, F.lit(SOURCE_CALL), F.lit(2))
    return F.arrays_zip(names.alias("source_name"), tables.alias("table_name"))


def strip_templates(sql: Column) -> Column:
    """Plain SQL: sources become ``a__b``, refs the model name, other tags a marker."""
    plain = F.regexp_replace(sql, SOURCE_TAG, "$1__$2")
    plain = F.regexp_replace(plain, REF_TAG, "$1")
    return F.regexp_replace(plain, ANY_TAG, UNKNOWN_TAG)


def placeholders(sql: Column) -> Column:
    """``MAP<placeholder, call text>``; a repeated placeholder keeps its last call."""
    source_keys = F.zip_with(
        F.regexp_extract_all(sql, F.lit(SOURCE_TAG), F.lit(1)),
        F.regexp_extract_all(sql, F.lit(SOURCE_TAG), F.lit(2)),
        lambda a, b: F.concat(a, F.lit("__"), b),
    )
    keys = F.concat(source_keys, F.regexp_extract_all(sql, F.lit(REF_TAG), F.lit(1)))
    calls = F.concat(
        F.regexp_extract_all(sql, F.lit(SOURCE_TAG), F.lit(0)),
        F.regexp_extract_all(sql, F.lit(REF_TAG), F.lit(0)),
    )
    late_keys, late_calls = F.reverse(keys), F.reverse(calls)
    names = F.array_distinct(keys)
    return F.map_from_arrays(
        names,
        F.transform(names, lambda k: F.element_at(late_calls, F.array_position(late_keys, k).cast("int"))),
    )


def restore(text: Column, mapping: Column) -> Column:
    """Put the original calls back, longest placeholder first."""
    ordered = F.array_sort(
        F.transform(
            F.map_entries(mapping),
            lambda e, i: F.struct((-F.length(e["key"])).alias("rank"), i.alias("i"), e["key"].alias("key"), e["value"].alias("value")),
        )
    )
    return F.aggregate(ordered, text, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def relation_name(call: Column) -> Column:
    """Readable relation of a call: ``source.table``, the model name, or the text itself."""
    return (
        F.when(
            call.rlike("^" + SOURCE_TAG),
            F.concat(F.regexp_extract(call, "^" + SOURCE_TAG, 1), F.lit("."), F.regexp_extract(call, "^" + SOURCE_TAG, 2)),
        )
        .when(call.rlike("^" + REF_TAG), F.regexp_extract(call, "^" + REF_TAG, 1))
        .otherwise(call)
    )
