"""Scalar functions over identity: keys, subjects, canonical JSON, paths, instants, unit keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\u001f"


def idempotency_key(tenant: Column, source: Column, subject: Column, content_hash: Column) -> Column:
    """SCL-1: SHA-256 of the four components joined by U+001F; a missing, empty or joined one raises."""
    parts = [tenant, source, subject, content_hash]
    bad = F.lit(False)
    for p in parts:
        bad = bad | p.isNull() | (p == "") | p.contains(UNIT_SEPARATOR)
    return F.when(bad, F.raise_error(F.lit("invalid component of an idempotency key")).cast("string")).otherwise(F.sha2(F.concat_ws(UNIT_SEPARATOR, *parts), 256))


def message_subject(workspace: Column, conversation: Column, ts: Column) -> Column:
    """SCL-2."""
    return F.concat_ws("/", workspace, conversation, ts)


def file_subject(workspace: Column, file_id: Column) -> Column:
    return F.concat_ws("/", workspace, F.lit("file"), file_id)


def profile_subject(workspace: Column, user: Column, embedded: bool = False) -> Column:
    return F.concat(F.concat_ws("/", workspace, F.lit("user"), user), F.lit("#profile-embed" if embedded else "#profile"))


def derived_subject(subject: Column, what: str) -> Column:
    """what: reactions, change, observation, availability, access or conversation."""
    return F.concat(subject, F.lit(f"#{what}"))


def canonical_struct(**fields: Column) -> Column:
    """SCL-3 for fixed shapes: JSON with names in order, nulls kept, control characters in lower-case hex; only texts that
    may hold one are searched for each."""
    plain = text = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    for code in (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F):
        text = F.regexp_replace(text, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(F.contains(plain, F.lit("\\u00")), text).otherwise(plain)


def canonical_hash(**fields: Column) -> Column:
    return F.sha2(canonical_struct(**fields), 256)


def packed_hash(text: Column) -> Column:
    """The 32 bytes of a hash in lower-case hex; another text as longer bytes, so that equal ones have equal texts."""
    return F.when(F.regexp_like(text, F.lit(r"\A[0-9a-f]{64}\z")), F.unhex(text)).otherwise(F.concat(F.lit(bytearray(33)), text.cast("binary")))


def unpacked_hash(packed: Column) -> Column:
    """The text that packed_hash took."""
    return F.when(F.octet_length(packed) == 32, F.lower(F.hex(packed))).otherwise(F.substring(packed, 34, 2**31 - 1).cast("string"))


def ts_instant(ts: Column) -> Column:
    """SCL-5: "seconds.micros" as an instant; micros are padded or cut to six digits."""
    parts = F.split(ts, r"\.", 2)
    micros = F.rpad(F.substring(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 1, 6), 6, "0")
    return F.timestamp_micros(F.get(parts, F.lit(0)).cast("long") * 1_000_000 + micros.cast("long"))


def instant_ts(at: Column) -> Column:
    """SCL-5 backwards."""
    micros = F.unix_micros(at)
    return F.concat(F.floor(micros / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"))


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def json_path(*steps: Column | str) -> Column:
    """SCL-6: a path from ``$``; strings are names, columns are indexes."""
    out = [F.lit("$")]
    for s in steps:
        if isinstance(s, str):
            plain = s.isidentifier()
            out.append(F.lit(f".{s}" if plain else f'["{s}"]'))
        else:
            out.append(F.concat(F.lit("["), s.cast("string"), F.lit("]")))
    return F.concat(*out)


#: A step of a path: ``.name``, ``["name"]`` with JSON escapes, or ``[index]``.
_STEP = r'\.([A-Za-z_][A-Za-z0-9_]*)|\["((?:[^"\\]|\\.)*)"\]|\[(0|[1-9][0-9]*)\]'


def path_steps(path: Column) -> Column:
    """SCL-6: a path's steps as an array of (name, index), one of which is null; null if it is no path."""
    whole = F.regexp_like(path, F.lit(rf"^\$(?:{_STEP})*$"))
    part = lambda group: F.regexp_extract_all(path, F.lit(_STEP), F.lit(group))
    plain, quoted, index = part(1), F.transform(part(2), lambda q: F.from_json(F.concat(F.lit('{"v":"'), q, F.lit('"}')), "v STRING")["v"]), part(3)
    steps = F.transform(part(0), lambda step, i: F.when(step.startswith("."), F.struct(F.get(plain, i).alias("name"), F.lit(None).cast("int").alias("index"))).when(step.startswith('["'), F.struct(F.get(quoted, i).alias("name"), F.lit(None).cast("int").alias("index"))).otherwise(F.struct(F.lit(None).cast("string").alias("name"), F.get(index, i).cast("int").alias("index"))))
    return F.when(whole, steps)


def resolve(document: Column, path: Column) -> Column:
    """SCL-6: the JSON text at a path; null if the path or what it points to isn't there. Each step is taken from the
    text that the step before it gave, so names may hold any character."""

    def down(text: Column, step: Column) -> Column:
        return F.when(step["name"].isNotNull(), F.get(F.map_values(F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: k == step["name"])), F.lit(0))).otherwise(F.get(F.from_json(text, "array<string>"), step["index"]))

    return F.when(path_steps(path).isNotNull(), F.aggregate(path_steps(path), document, down))


def unit_key(conversation: Column, day: Column) -> Column:
    """FLT-3 / STM-8: a conversation's UTC day."""
    return F.concat_ws("/", conversation, F.date_format(day, "yyyy-MM-dd"))


def unit_conversation(key: Column) -> Column:
    """SCL-13: conversation of a unit key whose end is a valid date, else null."""
    return F.when(unit_day(key).isNotNull(), F.regexp_extract(key, r"(?s)^(.*)/[^/]*$", 1))


def unit_day(key: Column) -> Column:
    last = F.regexp_extract(key, r"/(\d{4}-\d{2}-\d{2})$", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(last, F.lit("")), F.lit("yyyy-MM-dd")))


def unit_kind(key: Column) -> Column:
    return F.when(key == "directory", "directory").when(unit_day(key).isNotNull(), "conversation_day").otherwise("unknown")


def error_parts(error: Column) -> tuple[Column, Column]:
    """SCL-14: (type, message) of the first 4,000 characters of ``type: message``."""
    cut = F.substring(error, 1, 4000)
    at = F.instr(cut, ": ")
    return F.when(at > 0, F.substring(cut, F.lit(1), at - 1)).otherwise(cut), F.when(at > 0, F.substring(F.substring(cut, at + 2, F.lit(4000)), 1, 2000)).otherwise("")


def version_key(version: Column) -> Column:
    """Numeric order of dotted versions: an array of numbers."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
