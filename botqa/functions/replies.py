"""Parsing raw model / bot replies held in string columns (S-06..S-13, P-02, P-11)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from .text import _c, strip_fence


def coerce_enum(x, allowed: Iterable[str], fallback=None) -> Column:
    """P-11: value if it is one of ``allowed`` else ``fallback`` (a literal or null)."""
    col = _c(x)
    fb = F.lit(fallback) if fallback is not None else F.lit(None).cast("string")
    return F.when(col.isin(list(allowed)), col).otherwise(fb)


def json_field_present(js: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(js), F.lit(key))


def reply_path(body, path: str) -> Column:
    """P-02: walk a dotted path in a JSON body.  Missing key or a non-object on
    the way gives ``""``; an absent body (no reply) stays null."""
    col = _c(body)
    value = F.get_json_object(col, "$." + path)
    return F.when(col.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(value, F.lit("")))


def parse_judge_reply(raw) -> Column:
    """S-07: struct(valid, passed, failure_type, confidence, reasoning).

    ``valid`` is false when the text is not a JSON object after fence removal,
    or when ``confidence`` is present but not a number: such a reply is *no
    verdict*, not a default pass.  Defaults: passed true, confidence 0.75,
    reasoning ''.  An unknown failure type becomes null.
    """
    js = strip_fence(raw)
    is_object = F.json_object_keys(js).isNotNull()
    passed_txt = F.get_json_object(js, "$.passed")
    has_passed = json_field_present(js, "passed")
    # bool(value): JSON true/false, null -> False, numbers by != 0, strings by non-empty
    passed = (F.when(~has_passed, F.lit(True))
               .when(passed_txt.isNull(), F.lit(False))
               .when(passed_txt == "true", F.lit(True))
               .when(passed_txt == "false", F.lit(False))
               .when(passed_txt.try_cast("double").isNotNull(), passed_txt.try_cast("double") != 0)
               .otherwise(passed_txt != ""))
    conf_txt = F.get_json_object(js, "$.confidence")
    has_conf = json_field_present(js, "confidence")
    conf_num = conf_txt.try_cast("double")
    confidence = F.when(~has_conf, F.lit(S.JUDGE_DEFAULT_CONFIDENCE)).otherwise(conf_num)
    valid = is_object & (~has_conf | conf_num.isNotNull())
    ft = coerce_enum(F.get_json_object(js, "$.failure_type"), S.FAILURE_TYPES)
    reasoning = F.coalesce(F.get_json_object(js, "$.reasoning"), F.lit(""))
    return F.struct(
        valid.alias("valid"),
        F.when(valid, passed).alias("passed"),
        F.when(valid, ft).alias("failure_type"),
        F.when(valid, confidence).alias("confidence"),
        F.when(valid, reasoning).alias("reasoning"),
    )


def reply_items(raw) -> Column:
    """Items of a JSON-array reply (after fence removal) as JSON texts; null
    when the reply is not an array.  Object items keep their JSON text."""
    return F.from_json(strip_fence(raw), "array<string>")


def is_json_object(js) -> Column:
    return F.json_object_keys(_c(js)).isNotNull()


def json_str(js, key: str) -> Column:
    """String value of the top-level ``key`` of a JSON object, null when absent
    or not a string.  The type is that of the parsed value."""
    v = F.from_json(_c(js), f"`{key}` variant")[key]
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))
