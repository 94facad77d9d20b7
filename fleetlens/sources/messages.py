"""Decoding of relayed (topic, payload) messages into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import col, decimal_text, finite, micros, once, strip, to_numeric

# Wire format of the message lanes.
LINK_UP_WORDS = ["online", "1", "true", "up"]
SAMPLE_LANES = ["samples", "raw"]
STATUS_KEYS = [
    "id", "robot_id", "name", "state", "status", "battery", "batt", "pose", "x", "y", "yaw", "theta",
    "vel", "v", "w", "linear", "angular", "mission", "errors", "error", "temp", "temperature",
    "wifi", "rssi", "odom", "odom_m", "ts",
]
TOPIC_MAX_CHARS = 500
PAYLOAD_MAX_BYTES = 8192


def route_messages(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Add robot_id and lane; drop short topics and lanes nothing listens to."""
    df = once(df, {"_parts": F.split(F.col(topic), "/")})
    parts = F.col("_parts")
    kind = F.get(parts, 2)
    lane = F.when(kind.isin(SAMPLE_LANES), "samples").when(kind.isin("lwt", "status"), kind)
    return once(df, {"robot_id": F.get(parts, 1), "lane": lane}).filter(F.col("lane").isNotNull()).drop("_parts")


def limit_payload(df: DataFrame, payload="payload", max_bytes: int = PAYLOAD_MAX_BYTES) -> DataFrame:
    return df.filter(F.octet_length(col(payload)) <= max_bytes)


def link_up(payload) -> Column:
    """Last-will text -> is the link up?"""
    bare = F.regexp_replace(strip(payload), '^"+|"+$', "")
    return F.lower(bare).isin(LINK_UP_WORDS)


# ------------------------------------------------------------------ dynamic values

def member(v, *names: str) -> Column:
    """First key that is present, even if its value is JSON null."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in names])


def json_type(v) -> Column:
    return F.schema_of_variant(v)


def is_object(v) -> Column:
    return F.coalesce(json_type(v).startswith("OBJECT"), F.lit(False))


def is_array(v) -> Column:
    return F.coalesce(json_type(v).startswith("ARRAY"), F.lit(False))


def text_of(v) -> Column:
    """Scalar as text, object or array as JSON; JSON null is null."""
    return F.try_variant_get(v, "$", "string")


def number_of(v) -> Column:
    """float() of a dynamic value: numbers, numeric text and booleans; finite only.

    Pass a plain column: the value is looked at several times.
    """
    kind = json_type(v)
    return (F.when(kind == "STRING", decimal_text(text_of(v)))
            .when(kind == "BOOLEAN", F.when(text_of(v) == "true", 1.0).otherwise(0.0))
            .otherwise(finite(F.try_variant_get(v, "$", "double"))))


def numeric_of(v) -> Column:
    """Chartable number of a sample value, boolean words included."""
    return F.when(json_type(v) == "STRING", to_numeric(text_of(v))).otherwise(number_of(v))


def truthy_text(v) -> Column:
    return F.nullif(text_of(v), F.lit(""))


def looks_object(payload) -> Column:
    """Does the text open an object? Cheaper than asking the parsed value for its type."""
    return F.ltrim(col(payload), F.lit(" \t\r\n")).startswith("{")


# ------------------------------------------------------------------ status lane

def extra_map(v: str, only: list[str] | None = None) -> Column:
    """Members of an object that are no fields of a status, as texts.

    A cast of the whole object looks at every member of every message; ``only`` names the ones that are wanted, which
    are looked up by themselves.
    """
    if only is None or any(c in k for k in only for c in "'\\"):  # no path can spell such a key
        return F.map_filter(F.try_variant_get(v, "$", "map<string,string>"), lambda k, _: ~k.isin(STATUS_KEYS))
    found = [(k, F.try_variant_get(v, f"$['{k}']", "variant")) for k in only if k not in STATUS_KEYS]
    entries = [F.when(m.isNotNull(), F.struct(F.lit(k).alias("key"), text_of(m).alias("value"))) for k, m in found]
    known = F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.create_map().cast("map<string,string>")
    return F.when(F.col(v).isNotNull(), known)


def parse_status(df: DataFrame, payload: str = "payload", extra_keys: list[str] | None = None) -> DataFrame:
    """Status JSON -> typed columns. Absent fields are null and carried forward later.

    ``dropped`` marks bodies that are not a JSON object; their other columns are null. ``extra`` holds the keys of no
    field, of ``extra_keys`` only if these are given.
    The work goes in steps so that each value is parsed and looked up once.
    """
    df = once(df, {"_v": F.when(looks_object(payload), F.try_parse_json(F.col(payload)))})
    df = df.withColumns({"_pose": member("_v", "pose"), "_vel": member("_v", "vel"), "_mission": member("_v", "mission"),
                         "_errors": member("_v", "errors", "error")})
    df = df.withColumns({
        "_pose": F.when(is_object("_pose"), F.col("_pose")).otherwise(F.col("_v")),
        "_vel": F.when(is_object("_vel"), F.col("_vel")).otherwise(F.col("_v")),
        "_mission_object": is_object("_mission"),
        "_error_text": text_of("_errors"),
    })
    numbers = {
        "battery": member("_v", "battery", "batt"), "x": member("_pose", "x"), "y": member("_pose", "y"),
        "yaw": member("_pose", "yaw", "theta"), "v": member("_vel", "v", "linear"), "w": member("_vel", "w", "angular"),
        "progress": F.when(F.col("_mission_object"), member("_mission", "progress")),
        "temp": member("_v", "temp", "temperature"), "wifi": member("_v", "wifi", "rssi"), "odom": member("_v", "odom", "odom_m"),
    }
    df = df.withColumns({f"_n_{k}": v for k, v in numbers.items()})
    df = df.withColumns({k: number_of(f"_n_{k}") for k in numbers})
    object_name = F.coalesce(truthy_text(member("_mission", "id")), truthy_text(member("_mission", "name")))
    errors = (F.when(is_array("_errors"), F.try_variant_get("_errors", "$", "array<string>"))
              .when(F.col("_error_text").isNull(), F.lit(None))
              .when(F.col("_error_text").isin("", "0", "false"), F.array().cast("array<string>"))
              .otherwise(F.array("_error_text")))
    battery = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("battery")))
    return df.withColumns({
        "robot_id": F.coalesce(truthy_text(member("_v", "id")), F.col("robot_id")),
        "dropped": F.col("_v").isNull(),
        "name": truthy_text(member("_v", "name")),
        "state": F.coalesce(truthy_text(member("_v", "state")), truthy_text(member("_v", "status"))),
        "battery": F.when(F.col("battery").isNotNull(), battery),
        "mission": F.when(F.col("_mission_object"), object_name).otherwise(text_of("_mission")),
        "mission_reset": F.col("_mission_object"),
        "errors": errors,
        "extra": extra_map("_v", extra_keys),
    }).drop("_v", "_pose", "_vel", "_mission", "_mission_object", "_errors", "_error_text", *[f"_n_{k}" for k in numbers])


# ------------------------------------------------------------------ sample lane

def batch_headers(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Envelope fields and item count of each batch; ``n_items`` is null for a bad body.

    The items themselves stay in the payload text: redelivered copies are dropped before
    anything is unpacked, and the text is what a shuffle moves most cheaply.
    """
    df = once(df, {"_v": F.try_parse_json(F.col(payload)), "enveloped": looks_object(payload)})
    df = df.withColumns({"enveloped": F.coalesce(F.col("enveloped") & F.col("_v").isNotNull(), F.lit(False)),
                         "_sent": F.when(F.col("enveloped"), member("_v", "ts"))})
    inside = F.col("enveloped")
    body = F.when(inside, member("_v", "b")).otherwise(F.col("_v"))
    sent = F.when(~json_type("_sent").isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get("_sent", "$", "double"))
    return once(df, {
        "n_items": F.size(F.try_variant_get(body, "$", "array<variant>")),
        "boot": F.when(inside, text_of(member("_v", "boot"))),
        "seq": F.when(inside, F.try_variant_get(member("_v", "seq"), "$", "bigint")),
        "sent_us": F.round(sent * 1e6).cast("bigint"),
        "recv_us": micros("recv_ts"),
    }).withColumn("n_items", F.when(F.col("n_items") >= 0, F.col("n_items"))).drop("_v", "_sent")


def batch_items(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the items of each batch as an array of dynamic values."""
    df = once(df, {"_v": F.try_parse_json(F.col(payload))})
    body = F.when(F.col("enveloped"), F.try_variant_get("_v", "$.b", "array<variant>")).otherwise(
        F.try_variant_get("_v", "$", "array<variant>"))
    return once(df, {"items": body}).drop("_v")


def parse_batches(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Envelope, ``{"b": [...]}`` or a bare list -> one row per batch with its items."""
    return batch_items(batch_headers(df, payload), payload)


def explode_items(df: DataFrame) -> DataFrame:
    """One row per batch item. ``dropped`` marks items that are too short or have no topic."""
    keep = [c for c in df.columns if c not in ("items", "payload")]
    rows = df.select(*keep, F.posexplode("items").alias("pos", "_item"))
    rows = once(rows, {"_f": F.try_variant_get("_item", "$", "array<variant>")})
    rows = rows.withColumns({"_topic": F.get("_f", 0), "_stamp": F.get("_f", 1), "_value": F.get("_f", 2), "_flag": F.get("_f", 3)})
    rows = once(rows, {
        "_topic": F.when((F.size("_f") >= 3) & (json_type("_topic") == "STRING"), truthy_text("_topic")),
        "_stamp": number_of("_stamp"), "num": numeric_of("_value"), "_flag": number_of("_flag")})
    return rows.withColumns({
        "dropped": F.col("_topic").isNull(),
        "sample_topic": F.substring("_topic", 1, TOPIC_MAX_CHARS),
        "raw_us": F.coalesce(F.when(F.col("_stamp") != 0, F.round(F.col("_stamp") * 1e6).cast("bigint")), F.col("recv_us")),
        "value": F.to_json("_value"),
        "flag": F.coalesce(F.col("_flag").cast("int"), F.lit(0)),
    }).drop("_f", "_item", "_topic", "_stamp", "_value", "_flag")


def explode_samples(df: DataFrame) -> DataFrame:
    """Good items only."""
    return explode_items(df).filter(~F.col("dropped")).drop("dropped")


def decode_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Bytes -> JSON value, else text, else a size note with ``is_binary`` set."""
    valid = F.is_valid_utf8(F.col(payload))
    text = strip(F.try_validate_utf8(F.col(payload)))
    as_json = F.try_parse_json(text)
    return df.withColumns({
        "is_binary": ~valid,
        "is_json": valid & as_json.isNotNull(),
        "value": F.when(~valid, F.concat(F.lit("<"), F.octet_length(payload).cast("string"), F.lit(" bytes binary>")))
                  .otherwise(F.coalesce(F.to_json(as_json), text)),
    })


def flatten_json(df: DataFrame, keys: list[str], body: str = "body", prefix: str = "",
                 max_array: int = 8, max_depth: int = 6) -> DataFrame:
    """Nested JSON -> (path, value) rows; long arrays shrink to their length.

    Seven passes turn every pending node into a leaf row or its child nodes; the whole
    tree costs one scan and no shuffle. Numbers come out in canonical JSON form (28, not 28.0).
    """
    spark = df.sparkSession
    df = df.select(*keys, F.lit(prefix).alias("path"), F.try_parse_json(body).alias("node")).filter("node is not null")
    for depth in range(max_depth + 1):
        size = F.size(F.try_variant_get("node", "$", "array<variant>"))
        long_array = F.coalesce(size > max_array, F.lit(False))
        df = df.select(*keys, F.when(long_array, F.concat("path", F.lit("/len"))).otherwise(F.col("path")).alias("path"),
                       F.when(long_array, F.try_parse_json(size.cast("string"))).otherwise(F.col("node")).alias("node"))
        if depth < max_depth:
            # Scalars open to nothing and pass through unchanged.
            kids = df.lateralJoin(spark.tvf.variant_explode_outer(F.col("node").outer()))
            step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
            inner = F.col("value").isNotNull()
            df = kids.select(*keys, F.when(inner, F.concat("path", F.lit("/"), step)).otherwise(F.col("path")).alias("path"),
                             F.coalesce("value", "node").alias("node"))
    return df.filter(~is_object("node") & ~is_array("node")).select(*keys, "path", F.to_json("node").alias("value"))
