"""Column expressions: numbers, digests, states, errors, units. All are built-in functions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State tokens and wire numbers.
TASK_STATES = ("queued", "processing", "completed", "failed", "cancelled")
ITEM_STATES = (*TASK_STATES, "retrying")
MODEL_STATES = ("queued", "processing", "done", "failed", "skipped")
TERMINAL = ("completed", "failed", "cancelled")
ERROR_NUMBERS = {"unspecified": 0, "fetch": 1, "decode": 2, "timeout": 3, "model_unavailable": 4, "inference": 5, "unsupported": 6, "cancelled": 7}
STATUS_CODES = {"invalid": "invalid_argument", "unknown_model": "invalid_argument", "incompatible": "invalid_argument", "unknown_task": "not_found", "queue_full": "resource_exhausted", "memory": "resource_exhausted"}
SIZE_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}
DURATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def f32(x) -> Column:
    """A threshold as FLOAT: scores are FLOAT, and FLOAT against a decimal literal would compare as DOUBLE."""
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")


def checked_state(state: Column, allowed: tuple[str, ...]) -> Column:
    """`state` if it is a known token, else an error; null stays null."""
    return F.when(state.isNull() | state.isin(*allowed), state).otherwise(F.raise_error(F.concat(F.lit("unknown state: "), state)))


def is_terminal(state: Column) -> Column:
    return state.isin(*TERMINAL)


def model_done(state: Column) -> Column:
    """Done or skipped; a failed model is not done."""
    return state.isin("done", "skipped")


def retry_backoff(attempt: Column) -> Column:
    """Seconds before retry n: 1, 2, 4, ... at most 30."""
    return F.least(F.pow(F.lit(2), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(5))).cast("long"), F.lit(30).cast("long"))


def content_digest(data: Column) -> Column:
    """Lower-case hex SHA-256 of bytes or of a string's UTF-8."""
    return F.sha2(data.cast("binary"), 256)


def hmac_sha256(key: str, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256, from SHA-256 over the padded key (RFC 2104)."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def signature_matches(key: str, message: Column, signature: Column) -> Column:
    """Whether a hex signature is the message's HMAC. Digests of both sides are compared, so time says nothing."""
    bare = F.regexp_replace(F.coalesce(signature, F.lit("")), "^sha256=", "")
    return F.sha2(F.lower(bare).cast("binary"), 256) == F.sha2(hmac_sha256(key, message).cast("binary"), 256)


def hex_encode(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_decode(text: Column) -> Column:
    """Bytes of a hex string, null if it is none."""
    return F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(text))


def error_json(error: Column) -> Column:
    return F.to_json(error)


def parse_error(text: Column) -> Column:
    """struct(kind, message); what is no such JSON becomes an unspecified error with the raw text."""
    parsed = F.from_json(text, "kind string, message string")
    raw = F.struct(F.lit("unspecified").alias("kind"), text.alias("message"))
    return F.when(text.isNull(), F.lit(None).cast("struct<kind:string,message:string>")).when(parsed["kind"].isNotNull(), parsed).otherwise(raw)


def error_number(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ERROR_NUMBERS.items() for x in kv]), kind), F.lit(0))


def status_code(problem: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_CODES.items() for x in kv]), problem), F.lit("internal"))


def size_bytes(text: Column) -> Column:
    """Bytes of `4gb`, `1.5gb`, `1024`; null (no limit) for zero, empty and malformed sizes."""
    clean = F.lower(F.trim(text))
    number, unit = F.regexp_extract(clean, r"^([0-9]*\.?[0-9]+)\s*([a-z]*)$", 1), F.regexp_extract(clean, r"^([0-9]*\.?[0-9]+)\s*([a-z]*)$", 2)
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in SIZE_UNITS.items() for x in kv]), unit)
    value = F.floor(number.try_cast("double") * factor).cast("long")
    return F.when(value > 0, value)


def duration_seconds(text: Column) -> Column:
    """Seconds of `45s 90m 12h 30d 2w`; null for bare numbers and anything else."""
    number, unit = F.regexp_extract(F.trim(text), r"^([0-9]+)([smhdw])$", 1), F.regexp_extract(F.trim(text), r"^([0-9]+)([smhdw])$", 2)
    return number.try_cast("long") * F.element_at(F.create_map(*[F.lit(x) for kv in DURATION_UNITS.items() for x in kv]), unit)


def modality(kind: Column, video: Column) -> Column:
    """image, video, text or audio of an input; bytes are video or image by their flag."""
    return F.when(kind == "bytes", F.when(F.coalesce(video, F.lit(False)), "video").otherwise("image")).when(kind.isin("image", "video", "text", "audio"), kind)


def input_url(kind: Column, main: Column) -> Column:
    """The main URL of an image, video or audio input, else null."""
    return F.when(kind.isin("image", "video", "audio"), main)
