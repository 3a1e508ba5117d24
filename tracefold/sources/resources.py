"""Collaboration payloads: pages, records, human-readable values, references, versions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold import fixed_values as fv
from tracefold.functions import collab, ids
from tracefold.functions.dates import local_day, parse_epoch_or_iso
from tracefold.functions.notes import safe_id, safe_url
from tracefold.functions.text import blank_to_null, head_chars, redact, trim_ws
from tracefold.operators.common import evaluate_once
from tracefold.sources.captures import json_string, variant_at


# --- small per-value helpers that run inside Arrow batches: JSON of unknown shape has no path to name -----------
def _leaves(value, hidden, depth=0):
    if depth > 4 or value is None:
        return []
    if isinstance(value, bool):
        return ["true" if value else "false"]
    if isinstance(value, (str, int, float)):
        return [str(value)]
    children = value if isinstance(value, list) else [v for k, v in value.items() if not hidden.search(k)]
    return [leaf for child in children for leaf in _leaves(child, hidden, depth + 1)]


def _named(value, key_pattern, value_pattern, key="", depth=0):
    if depth > 5 or value is None:
        return []
    if isinstance(value, str):
        return [value] if key_pattern.search(key) and value_pattern.search(value) else []
    if isinstance(value, list):
        return [found for child in value for found in _named(child, key_pattern, value_pattern, key, depth + 1)]
    if isinstance(value, dict):
        return [found for k, child in value.items() for found in _named(child, key_pattern, value_pattern, k, depth + 1)]
    return []


def _loads(text):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def flatten_human_values(payload: Column) -> Column:
    """All scalar leaves of a JSON text to depth four, secrets and ids left out, distinct, one per line."""
    hidden = re.compile(fv.HIDDEN_KEYS)

    @F.pandas_udf(T.StringType())
    def flatten(values: pd.Series) -> pd.Series:
        return values.map(
            lambda t: "\n".join(dict.fromkeys(s for s in (leaf.strip() for leaf in _leaves(_loads(t), hidden)) if s))
        )

    return flatten(payload)


def discover_references(
    payload: Column, key_pattern: str = fv.MINUTE_TOKEN_KEY, value_pattern: str = fv.MINUTE_TOKEN_VALUE, limit: int | None = None
) -> Column:
    """Distinct values under keys that match a pattern, to depth five; all, or the first ``limit`` of one payload."""
    keys, shape = re.compile(key_pattern), re.compile(value_pattern)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda t: list(dict.fromkeys(_named(_loads(t), keys, shape)))[:limit])

    return find(payload)


def chunk_ids(references: DataFrame, column: str = "reference", size: int = 50, buckets: int = 64) -> DataFrame:
    """Distinct ids in groups of at most ``size``. Ids are hashed to buckets first, so no task numbers them all."""
    from pyspark.sql import Window

    distinct = references.select(column).distinct().withColumn("bucket", F.pmod(F.xxhash64(column), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(column))
    return distinct.withColumn("chunk", F.concat_ws("-", "bucket", F.floor((place - 1) / size).cast("string"))).select(column, "chunk")


# --- pages ---------------------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def _deep_list(values: pd.Series) -> pd.Series:
    def items(value):
        if isinstance(value, list):
            return value
        if not isinstance(value, dict):
            return []
        for name in fv.PAGE_LIST_FIELDS:
            if isinstance(value.get(name), list):
                return value[name]
        return next((found for found in map(items, value.values()) if found), [])

    return values.map(lambda t: json.dumps(items(_loads(t)), ensure_ascii=False))


def _first_variant(v: Column, names: list[str], kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{p}{n}", kind) for p in ("data.", "") for n in names])


def explode_payload_pages(pages: DataFrame, text: str = "payload", key: str = "page_id", offset: str | None = None):
    """Items of response pages and each page's next cursor.

    A list under a known name is reached by path, in the JVM; only pages nested some other way go
    through the recursive helper. With ``offset`` (record tables) the next page is a row offset.
    """
    rows = pages.withColumn("v", F.try_parse_json(text))
    v = F.col("v")
    direct = _first_variant(v, fv.PAGE_LIST_FIELDS, "array<variant>")
    rows = rows.withColumn("_items", F.coalesce(direct, F.try_variant_get(v, "$", "array<variant>")))
    deep = F.try_variant_get(F.try_parse_json(_deep_list(F.when(F.col("_items").isNull(), F.col(text)))), "$", "array<variant>")
    rows = rows.withColumn("_items", F.coalesce("_items", deep))
    items = rows.select(key, F.posexplode("_items").alias("pos", "item")).select(key, "pos", F.to_json("item").alias("item"))
    more = F.coalesce(_first_variant(v, fv.PAGE_MORE_FIELDS, "boolean"), F.lit(False))
    token = _first_variant(v, fv.PAGE_TOKEN_FIELDS, "string")
    if offset:
        token = (F.col(offset) + F.greatest(F.lit(1), F.size("_items"))).cast("string")
    cursors = rows.select(key, F.coalesce(F.size("_items"), F.lit(0)).alias("items"), F.when(more, token).alias("next_page"))
    return items, cursors


# --- normalised records --------------------------------------------------------------------------
def _first_text(v: Column, names: list[str]) -> Column:
    return F.coalesce(*[blank_to_null(trim_ws(F.try_variant_get(v, f"$.{n}", "string"))) for n in names])


def _flag(v: Column, *names: str) -> Column:
    tests = [~F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")).isin("", "false", "0") for n in names]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def _label(text: Column) -> Column:
    return head_chars(trim_ws(F.regexp_replace(redact(F.coalesce(text, F.lit(""))), r"[\r\n]+", " ")), 300)


def normalize_resources(
    payloads: DataFrame, text: str = "payload", module: str = "module", seen: DataFrame | None = None,
    captured_at: Column | None = None, identity_scope: str = "scope", tz: str = "UTC",
) -> DataFrame:
    """Dynamic collaboration JSON to resource records.

    ``seen`` (module, resource_id) lists resources of earlier reads: it turns a start into progress and
    a creation into an update. Content is flattened by the JSON helper; all else stays in the JVM.
    """
    now = F.current_timestamp() if captured_at is None else captured_at
    parsed = payloads.select(F.col(module).alias("resource_type"), F.try_parse_json(text).alias("v"))
    v, mod = F.col("v"), F.col("resource_type")
    # Fields are looked up once; everything below works on plain columns.
    raw = evaluate_once(
        parsed, ["resource_type"],
        F.coalesce(*[blank_to_null(trim_ws(json_string(v, f"$.{n}"))) for n in fv.RESOURCE_ID_FIELDS]).alias("own_id"),
        _first_text(v, fv.RESOURCE_TITLE_FIELDS).alias("title"), _first_text(v, fv.RESOURCE_STATUS_FIELDS).alias("status"),
        _first_text(v, fv.RESOURCE_UPDATED_FIELDS).alias("updated"), _first_text(v, fv.RESOURCE_OCCURRED_FIELDS).alias("occurred"),
        _first_text(v, fv.RESOURCE_VERSION_FIELDS).alias("stated_version"), _first_text(v, fv.RESOURCE_PROJECT_FIELDS).alias("project"),
        _first_text(v, fv.RESOURCE_LINK_FIELDS).alias("link"), _flag(v, "deleted", "is_deleted").alias("deleted"),
        _flag(v, "permission_denied", "inaccessible").alias("denied"),
        F.to_json(F.struct(*[variant_at(v, f"$.{n}").alias(n) for n in fv.RESOURCE_CONTENT_FIELDS])).alias("content_json"),
    ).where(F.col("own_id").isNotNull())
    updated = F.coalesce(parse_epoch_or_iso(F.col("updated")), now)
    rows = raw.select(
        safe_id(F.concat_ws(":", mod, "own_id")).alias("resource_id"), "resource_type",
        _label(F.coalesce("title", F.concat(collab.module_label(mod), F.lit("记录")))).alias("title"),
        _label(F.coalesce("status", F.lit(fv.COLLAB_RECORDED))).alias("resource_status"), updated.alias("updated_at"),
        F.coalesce(parse_epoch_or_iso(F.col("occurred")), updated).alias("occurred_at"),
        trim_ws(redact(flatten_human_values(F.col("content_json")), collab_ids=True)).alias("content"),
        "stated_version", _label(F.coalesce("project", F.lit(fv.COLLAB_DEFAULT_LABEL))).alias("project_hint"),
        F.when(F.col("deleted"), "deleted").when(F.col("denied"), "revoked").otherwise("available").alias("access_status"),
        safe_url(F.col("link")).alias("resource_url"),
    )
    rows = rows.withColumn(
        "resource_version",
        F.coalesce("stated_version", ids.digest(F.col("title"), F.col("resource_status"), F.col("content"))),
    )
    if seen is None:
        rows = rows.withColumn("_seen", F.lit(False))
    else:
        known = seen.select(F.col(module).alias("resource_type"), "resource_id", F.lit(True).alias("_seen")).distinct()
        rows = rows.join(known, ["resource_type", "resource_id"], "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    key = [F.lit(identity_scope), F.col("resource_type"), F.col("resource_id"), F.col("resource_version"), F.col("access_status")]
    fallback = F.concat_ws(" · ", "title", "resource_status")
    return rows.select(
        F.lit(1).alias("schema_version"), ids.stable_id("feishu:", 40, *key).alias("event_id"), F.lit("feishu").alias("source"),
        F.lit("ResourceUpdate").alias("event"), now.alias("captured_at"), local_day(F.col("occurred_at"), tz).alias("date"),
        "occurred_at", "updated_at", F.concat_ws(":", F.lit("feishu"), "resource_type", "resource_id").alias("session_id"),
        F.substring(F.sha2("resource_version", 256), 1, 20).alias("turn_id"), F.col("project_hint").alias("cwd"), "title",
        F.coalesce(blank_to_null(F.col("content")), fallback).alias("content"), "resource_type", "resource_id", "resource_version",
        "resource_status", "resource_url", "project_hint", "access_status",
        collab.activity_kind(F.col("resource_type"), F.col("resource_status"), F.col("content"), F.col("_seen")).alias("activity_kind"),
        F.lit(identity_scope).alias("identity_scope"), F.lit(True).alias("untrusted_source"),
    )


def version_changed(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """Incoming records against the version table: unchanged ones are duplicates, the rest accepted.

    ``state`` has one row (identity_scope, resource_type, resource_id, version) per resource.
    """
    key = ["identity_scope", "resource_type", "resource_id"]
    joined = incoming.join(state.select(*key, F.col("version").alias("known_version")), key, "left")
    seen = F.col("known_version").isNotNull()
    same = F.col("known_version").eqNullSafe(F.col("resource_version"))
    return joined.withColumn("seen_before", seen).withColumn("verdict", F.when(same, "duplicate").otherwise("accepted"))


def next_versions(state: DataFrame, accepted: DataFrame) -> DataFrame:
    """Version table after a batch: the newest accepted version replaces the known one."""
    key = ["identity_scope", "resource_type", "resource_id"]
    fresh = accepted.groupBy(*key).agg(F.max_by("resource_version", F.struct("updated_at", "event_id")).alias("version"), F.max("updated_at").alias("updated_at"))
    kept = state.select(*key, "version", "updated_at").join(fresh.select(*key), key, "left_anti")
    return kept.unionByName(fresh.select(*key, "version", "updated_at"))


def project_fields(resources: DataFrame, fields: list[str], limit: int | None = None) -> DataFrame:
    """The fields a user selected, each named once; more than ``limit``, where given, are an error."""
    wanted = list(dict.fromkeys(fields))
    if limit is not None and len(wanted) > limit:
        raise ValueError(f"{len(wanted)} fields selected; at most {limit} are allowed")
    return resources.select(*[F.col(name) for name in wanted if name in resources.columns])


def retain_latest(df: DataFrame, n: int, order: str = "updated_at", tie: str = "resource_id") -> DataFrame:
    """The newest ``n`` rows: a top-k, never a full sort."""
    return df.orderBy(F.col(order).desc(), F.col(tie)).limit(n)
