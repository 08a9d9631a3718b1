"""Raw pages to typed rows: messages, files, identities, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import keys as K
from ledgerlane.functions import text as T
from ledgerlane.functions.status import OBSERVATIONS
from ledgerlane.operators.archive import conversation_type
from ledgerlane.operators.versions import dedupe_first

#: Fields of a message that are read; others stay in the raw text beside them.
MESSAGE = (
    "type STRING, ts STRING, user STRING, bot_id STRING, text STRING, subtype STRING, thread_ts STRING, edited STRUCT<user: STRING, ts: STRING>, deleted_ts STRING, "
    "files ARRAY<STRUCT<id: STRING, name: STRING, mimetype: STRING, size: BIGINT>>, reactions ARRAY<STRUCT<name: STRING, users: ARRAY<STRING>, count: INT>>, "
    "user_profile STRUCT<display_name: STRING, real_name: STRING, avatar_hash: STRING, team: STRING>"
)
MEMBER = "id STRING, name STRING, real_name STRING, deleted BOOLEAN, is_bot BOOLEAN, team_id STRING, profile STRUCT<display_name: STRING, real_name: STRING, email: STRING, avatar_hash: STRING, title: STRING>"
CONVERSATION = (
    "id STRING, name STRING, is_im BOOLEAN, is_mpim BOOLEAN, is_private BOOLEAN, is_group BOOLEAN, is_archived BOOLEAN, is_shared BOOLEAN, is_ext_shared BOOLEAN, "
    "topic STRUCT<value: STRING>, purpose STRUCT<value: STRING>, members ARRAY<STRING>, context_team_id STRING, team_id STRING, team STRING"
)


def messages(rows: DataFrame, message: str = "message", conversation: str = "conversation_id", workspace: Column | None = None) -> DataFrame:
    """PRJ-1: one typed row of each message struct. A message with neither user nor bot raises; a deleted
    one has an empty text; a root that is the message itself is none."""
    m = F.col(message)
    deleted = m["deleted_ts"].isNotNull() | (F.coalesce(m["subtype"], F.lit("")) == "tombstone")
    author = F.coalesce(m["user"], m["bot_id"])
    sure = F.when(author.isNull(), F.raise_error(F.concat(F.lit("message without author: "), F.coalesce(m["ts"], F.lit("?")))).cast("string")).otherwise(author)
    text = F.when(deleted, "").otherwise(F.coalesce(m["text"], F.lit("")))
    root = F.when(m["thread_ts"] != m["ts"], m["thread_ts"])
    files = F.array_sort(F.transform(F.coalesce(m["files"], F.array().cast("array<struct<id:string,name:string,mimetype:string,size:bigint>>")), lambda f: f["id"]))
    w = F.lit("T0") if workspace is None else workspace
    out = rows.select(
        *[c for c in rows.columns if c != message], K.message_subject(w, F.col(conversation), m["ts"]).alias("subject"), m["ts"].alias("ts"), K.ts_instant(m["ts"]).alias("sent_at"), sure.alias("author"), text.alias("text"), m["subtype"].alias("subtype"),
        root.alias("thread_root"), deleted.alias("deleted"), m["edited"]["ts"].alias("edited_ts"), m["deleted_ts"].alias("deleted_ts"), files.alias("file_ids"), T.mentions(text).alias("mentions"), m["reactions"].alias("reactions"),
    )
    return out.withColumn("content_hash", K.canonical_hash(fp=F.lit("chat.message/2"), author=F.col("author"), text=F.col("text"), subtype=F.col("subtype"), thread_root=F.col("thread_root"), deleted=F.col("deleted"), files=F.col("file_ids")))


def files(rows: DataFrame, message: str, order: list[str]) -> DataFrame:
    """PRJ-2: attachments of messages, first of each id."""
    f = rows.select(*order, F.posexplode(F.col(f"{message}.files")).alias("_pos", "_f")).select(*order, "_pos", "_f.*")
    return dedupe_first(f, ["id"], [*order, "_pos"]).drop("_pos")


def identities(rows: DataFrame, member: str = "member") -> DataFrame:
    """PRJ-3: identity snapshots of directory members."""
    m = F.col(member)
    p = m["profile"]
    out = rows.select(K.profile_subject(F.coalesce(m["team_id"], F.lit("T0")), m["id"]).alias("subject"), m["id"].alias("user_id"), p["display_name"].alias("display_name"), F.coalesce(m["real_name"], p["real_name"]).alias("real_name"), p["email"].alias("email"), F.coalesce(m["deleted"], F.lit(False)).alias("deactivated"))
    return out.withColumn("content_hash", K.canonical_hash(fp=F.lit("chat.profile/1"), user=F.col("user_id"), display_name=F.col("display_name"), real_name=F.col("real_name"), email=F.col("email"), deactivated=F.col("deactivated")))


def embedded_identities(rows: DataFrame, message: str = "message") -> DataFrame:
    """PRJ-3: what a message showed about its author."""
    m = F.col(message)
    p = m["user_profile"]
    own = rows.filter(p.isNotNull() & m["user"].isNotNull())
    return own.select(K.profile_subject(F.coalesce(p["team"], F.lit("T0")), m["user"], embedded=True).alias("subject"), m["user"].alias("user_id"), p["display_name"].alias("display_name"), p["real_name"].alias("real_name"), K.canonical_hash(fp=F.lit("chat.profile-embed/1"), user=m["user"], display_name=p["display_name"], real_name=p["real_name"], avatar_hash=p["avatar_hash"], team=p["team"]).alias("content_hash"))


def conversations(rows: DataFrame, conversation: str = "conversation") -> DataFrame:
    """PRJ-4: conversation snapshots: type, name, topic, purpose, sorted members, flags."""
    c = F.col(conversation)
    yes = lambda x: F.coalesce(x, F.lit(False))
    return rows.select(
        c["id"].alias("conversation_id"), conversation_type(c["is_im"], c["is_mpim"], c["is_private"], c["is_group"]).alias("type"), c["name"].alias("name"), F.coalesce(c["topic"]["value"], F.lit("")).alias("topic"), F.coalesce(c["purpose"]["value"], F.lit("")).alias("purpose"),
        F.array_sort(F.coalesce(c["members"], F.array().cast("array<string>"))).alias("members"), yes(c["is_archived"]).alias("archived"), (yes(c["is_shared"]) | yes(c["is_ext_shared"])).alias("shared"), F.coalesce(c["context_team_id"], c["team_id"]).alias("team_id"),
    )


def reaction_state(reactions: Column) -> Column:
    """SCL-4: reactions as sorted (name, sorted users), without their counters."""
    return F.array_sort(F.transform(F.coalesce(reactions, F.array().cast("array<struct<name:string,users:array<string>,count:int>>")), lambda r: F.struct(r["name"].alias("name"), F.array_sort(F.coalesce(r["users"], F.array().cast("array<string>"))).alias("users"))))


def observations(events: DataFrame) -> DataFrame:
    """PRJ-5: one row of each item-level event of six kinds (unit_key, item_id, kind, subject, derived JSON): the file and the
    reason it names, and when it was observed."""
    of = lambda name: F.get_json_object("derived", f"$.{name}")
    own = events.filter(F.col("kind").isin(*OBSERVATIONS))
    return own.select("unit_key", "item_id", "kind", "subject", of("file_id").alias("file_id"), of("reason").alias("reason"), of("observed_at").alias("observed_at"))
