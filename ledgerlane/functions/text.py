"""Scalar functions over text: mentions, redaction, markers, search keys, names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

REDACTED = "[REDACTED]"
#: Shapes of secrets that are replaced in text, and of names whose values are.
SECRETS = (
    r"xox[abeoprs]-[A-Za-z0-9-]{8,}",
    r"xapp-\d-[A-Za-z0-9-]{8,}",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"\b(AKIA|ASIA)[A-Z0-9]{16}\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
)
#: Words that make a setting's name sensitive wherever they stand in it, whatever the case and with -, _ or nothing
#: between two of them; a caller may give other words.
SENSITIVE_WORDS = ("password", "passphrase", "passwd", "pwd", "secret", "token", "bearer", "authorization", "session id", "cookie", "credential", "api key", "access key", "private key", "signing key")


def sensitive_name(name: Column, words: tuple[str, ...] = SENSITIVE_WORDS) -> Column:
    """SCL-11: whether a setting's name holds one of the words."""
    return F.regexp_like(name, F.lit("(?i)" + "|".join(w.replace(" ", "[-_ ]?") for w in words)))


#: Characters that a marker replaces: those of text direction, and those that HTML text can't hold (control
#: characters but tab and line ends, and noncharacters).
REPLACED = r"[\u061C\u200E\u200F\u202A-\u202E\u2066-\u2069\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\uFDD0-\uFDEF" + "".join(rf"\x{{{plane:X}FFFE}}\x{{{plane:X}FFFF}}" for plane in range(17)) + "]"
#: Characters that stay, with a marker behind them: tab, line ends, and other invisible ones.
MARKED = r"[\t\n\r\p{Cf}\p{Zl}\p{Zp}]"


def mentions(text: Column) -> Column:
    """SCL-8: distinct sorted user ids of ``<@U...>`` and ``<@U...|label>``."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"<@([A-Z0-9]+)(?:\|[^>]*)?>"), F.lit(1))))


def redact(text: Column, values: tuple[str, ...] = ()) -> Column:
    """SCL-11: text without registered values (longest first) and secrets of known shapes."""
    for v in sorted(values, key=len, reverse=True):
        if len(v) < 8:
            raise ValueError("a value shorter than 8 characters would redact too much")
        text = F.replace(text, F.lit(v), F.lit(REDACTED))
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def redact_map(values: Column, words: tuple[str, ...] = SENSITIVE_WORDS) -> Column:
    """SCL-11 for maps: values under sensitive names go, others are redacted as text."""
    return F.transform_values(values, lambda k, v: F.when(v.isNotNull() & sensitive_name(k, words), F.lit(REDACTED)).otherwise(redact(v)))


#: One character of either kind; most letters are told by the first test alone.
REVEALED = rf"(?=[^\x20-\x7E\u00A0-\u00AC\u00AE-\u05FF])(?:{REPLACED}|{MARKED})"


def reveal_invisible(text: Column) -> Column:
    """SCL-12: text with a marker ``[U+XXXX]`` for each character that is invisible, changes the direction of
    what follows, or can't stand in HTML; text is split at these, and only they are looked at one by one."""

    def shown(ch: Column) -> Column:
        code = F.hex(F.ascii(ch))
        marker = F.concat(F.lit("[U+"), F.lpad(code, F.greatest(F.lit(4), F.length(code)), F.lit("0")), F.lit("]"))
        return F.when(F.regexp_like(ch, F.lit(REPLACED)), marker).when(F.regexp_like(ch, F.lit(MARKED)), F.concat(ch, marker)).otherwise(ch)

    between, found = F.split(text, REVEALED, -1), F.regexp_extract_all(text, F.lit(REVEALED), F.lit(0))
    return F.array_join(F.zip_with(between, found, lambda plain, ch: F.concat(plain, F.coalesce(shown(ch), F.lit("")))), "")


def nfc(text: Column) -> Column:
    """Unicode normal form C."""

    @F.pandas_udf(StringType())
    def composed(t: pd.Series) -> pd.Series:
        return t.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return composed(text)


def search_key(text: Column) -> Column:
    """SCL-10 / UDF-2: NFKC and case folding, cut to 1,024 characters."""

    @F.pandas_udf(StringType())
    def folded(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold())[:1024])

    return folded(text)


def prefix_range(prefix: str) -> tuple[str, str | None]:
    """FLT-10: [lo, hi) of the keys with a prefix; hi is the shortest string above them, or None."""
    codes = [ord(c) for c in prefix]
    while codes:
        last = codes.pop() + 1
        if 0xD800 <= last <= 0xDFFF:
            last = 0xE000
        if last <= 0x10FFFF:
            return prefix, "".join(map(chr, codes)) + chr(last)
    return prefix, None


def with_prefix(column: Column, prefix: str) -> Column:
    lo, hi = prefix_range(prefix)
    return column >= lo if hi is None else (column >= lo) & (column < hi)


#: Bytes of a name and of its extension, at most.
MAX_NAME_BYTES, MAX_EXT_BYTES = 200, 16


def truncate_bytes(text: Column, limit: Column) -> Column:
    """Longest beginning of text within limit UTF-8 bytes that splits no character."""
    bound, raw = F.greatest(limit, F.lit(0)).cast("int"), text.cast("binary")
    inside = [F.hex(F.substring(raw, bound + 1 - i, F.lit(1))).rlike("^[89AB]") for i in range(3)]  # the next byte goes on a character
    cut = F.when(~inside[0], bound).when(~inside[1], bound - 1).when(~inside[2], bound - 2).otherwise(bound - 3)
    return F.when(F.octet_length(text) <= bound, text).otherwise(F.substring(raw, F.lit(1), F.greatest(cut, F.lit(0))).cast("string"))


def attachment_name(file_id: Column, original: Column) -> Column:
    """SCL-18: ``id_name`` in normal form C without unsafe characters, at most 200 bytes, keeping a short
    extension."""
    safe = F.regexp_replace(nfc(original), r'[/\\<>:"|?*]|[\p{C}]|(?! )[\p{Z}]', "_")
    safe = F.regexp_replace(safe, r"^[ .]+|[ .]+$", "")
    safe = F.when(safe == "", F.lit("file")).otherwise(safe)
    ext, stem = F.regexp_extract(safe, r"(?s)^.+\.([^.]*)$", 1), F.regexp_extract(safe, r"(?s)^(.+)\.[^.]*$", 1)
    short = (ext != "") & (stem != "") & (F.octet_length(ext) <= MAX_EXT_BYTES)
    suffix = F.when(short, F.concat(F.lit("."), ext)).otherwise("")
    base = F.when(short, stem).otherwise(safe)
    prefix = F.concat(file_id, F.lit("_"))
    return F.concat(prefix, truncate_bytes(base, F.lit(MAX_NAME_BYTES) - F.octet_length(prefix) - F.octet_length(suffix)), suffix)


LONE = r"(?i)(?<!\\)(?:\\\\)*(?:\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2})"


def has_lone_surrogate(raw_json: Column) -> Column:
    """SCL-9: whether raw JSON escapes half of a surrogate pair; it must be asked before parsing."""
    return F.regexp_like(raw_json, F.lit(LONE))


def lone_surrogates(raw_json: Column) -> Column:
    """SCL-9: code units (as integers) of the halves, in order."""
    found = F.regexp_extract_all(raw_json, F.lit(LONE), F.lit(0))
    return F.transform(found, lambda x: F.conv(F.substring(x, -4, 4), 16, 10).cast("int"))


def make_valid(raw_json: Column, stand_in: str = "\\\\ufffd") -> Column:
    """SCL-9: raw JSON with each half replaced (by U+FFFD), so that it can be parsed; ``$2`` in the stand-in is
    the half's code unit in hex."""
    return F.regexp_replace(raw_json, r"(?i)(?<!\\)((?:\\\\)*)\\u(d[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2}\\u)d[c-f][0-9a-f]{2})", f"$1{stand_in}")


#: Stands before the code unit of a half, in strings that are still to be looked at.
HALF = "\ue0ff"


def code_units(marked: Column) -> Column:
    """UTF-16 code units in hex, joined by points, of a string in which halves are marked by HALF."""
    units = F.regexp_extract_all(marked, F.lit(f"(?s){HALF}[0-9a-fA-F]{{4}}|."), F.lit(0))

    def unit(x: Column) -> Column:
        code = F.ascii(x)
        four = lambda v: F.lower(F.lpad(F.hex(v), 4, "0"))
        pair = F.concat(four(F.lit(0xD800) + F.floor((code - 0x10000) / 0x400)), F.lit("."), four(F.lit(0xDC00) + (code - 0x10000) % 0x400))
        return F.when(F.startswith(x, F.lit(HALF)) & (F.length(x) == 5), F.lower(F.substring(x, 2, 4))).when(code > 0xFFFF, pair).otherwise(four(code))

    return F.array_join(F.transform(units, unit), ".")


def without_halves(marked: Column) -> Column:
    """Such a string with U+FFFD for each half."""
    return F.regexp_replace(marked, f"{HALF}[0-9a-fA-F]{{4}}", "\ufffd")
