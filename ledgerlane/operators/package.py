"""Report rows and package verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import keys as K
from ledgerlane.functions.canonical import canonical_json
from ledgerlane.operators.custody import verify_anchors, verify_chain


def unit_rows(database: DataFrame, facts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """PRJ-6: units of either side; the chain's fact wins, and what neither records is UNKNOWN."""
    f = facts.select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_stated"))
    j = database.join(f, key, "full")
    return j.select(key, *[F.when(F.col("_stated"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields], F.when(F.col("_stated"), "chain").when(F.col(fields[0]).isNotNull(), "database").otherwise("UNKNOWN").alias("basis"))


def page_fragments(pages: DataFrame, key: str, content: str) -> DataFrame:
    """key, json_path and fragment (JSON text) of every element of a page's top-level arrays, or of a page that is an
    array itself. A page is parsed once, however many items point into it."""
    page = pages.select(key, F.col(content).cast("string").alias("_page"))
    bare = F.substring(F.ltrim("_page"), 1, 1) == "["
    named = page.filter(~bare).select(key, F.explode(F.from_json("_page", "map<string,string>")).alias("_name", "_array")).filter(F.col("_array").startswith("["))
    plain = page.filter(bare).select(key, F.lit(None).cast("string").alias("_name"), F.col("_page").alias("_array"))
    each = named.unionByName(plain).select(key, "_name", F.posexplode(F.from_json("_array", "array<string>")).alias("_i", "fragment"))
    name = F.when(F.col("_name").rlike("^[A-Za-z_][A-Za-z_0-9]*$"), F.concat(F.lit("."), "_name")).otherwise(F.concat(F.lit('["'), "_name", F.lit('"]')))
    return each.select(key, F.concat(F.lit("$"), F.coalesce(name, F.lit("")), F.lit("["), F.col("_i").cast("string"), F.lit("]")).alias("json_path"), "fragment")


def _errors(rows: DataFrame, file: str, what: Column, **checks: Column) -> DataFrame:
    """A row for each check that holds."""
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select(F.lit(file).alias("file"), what.cast("string").alias("what"), F.explode(found).alias("error"))


def verify_package(package: dict[str, DataFrame]) -> DataFrame:
    """MRK-10: one row per error of a package as SRC-7 reads it: file, what, error.

    Files against the manifest; the chain, its anchors and heads; evidence pinned, equal to its source, alone in its
    storage, and equal to its stored bytes; items' keys from their four parts, their evidence, and the hash of the fragment
    they point to in a stored page; what nothing accounts for."""
    stated = package["stated"].select("file", F.col("sha256").alias("s"), F.col("lines").alias("n"))
    j = stated.join(package["found"].select("file", "sha256", "lines"), "file", "full")
    here = F.col("s").isNotNull() & F.col("sha256").isNotNull()
    files = _errors(j.withColumn("f", F.col("file")), "manifest", F.col("f"), unlisted=F.col("s").isNull(), missing=F.col("sha256").isNull(), altered=here & (F.col("s") != F.col("sha256")), wrong_lines=here & (F.col("n") != F.col("lines")))

    place = F.concat_ws("/", "stream", F.col("seq").cast("string"))
    chain = verify_chain(package["events"]).filter("error is not null").select(F.lit("events").alias("file"), place.alias("what"), "error")
    packed = lambda rows: rows.select("stream", "seq", K.packed_hash(F.col("event_hash")).alias("event_hash"))
    tied = verify_anchors(packed(package["anchors"]), packed(package["events"])).select(F.lit("anchors").alias("file"), place.alias("what"), "error")
    last = package["events"].groupBy("stream").agg(F.max_by(F.struct("seq", "event_hash"), "seq").alias("last"))
    ends = package["heads"].select("stream", F.struct("seq", "event_hash").alias("head")).join(last, "stream", "full")
    ends = _errors(ends, "heads", F.col("stream"), head_differs=~F.col("head").eqNullSafe(F.col("last")))

    objects = package["objects"].select(F.col("sha256").alias("_key"), F.col("own_sha256"), "own_size")
    evidence = package["evidence"]
    complete = F.coalesce(F.col("state") == "complete", F.lit(False))
    stored = complete & F.col("kind").isin("page", "file")
    e = evidence.join(objects, evidence["sha256"] == objects["_key"], "left")
    bytes_differ = F.col("_key").isNotNull() & ((F.col("own_sha256") != F.col("sha256")) | (F.col("own_size") != F.col("size")))
    kept = _errors(
        e, "evidence", F.col("storage_key"), not_pinned=complete & F.col("version_id").isNull(), source_differs=complete & ~F.col("sha256").eqNullSafe(F.col("source_sha256")),
        storage_incident=F.coalesce(F.col("shadow_versions") > 0, F.lit(False)), bytes_missing=stored & F.col("_key").isNull(), bytes_differ=stored & bytes_differ,
    )
    extra = objects.join(evidence.filter(stored).select(F.col("sha256").alias("_key")).distinct(), "_key", "left_anti")
    extra = _errors(extra, "objects", F.col("_key"), not_an_object=F.lit(True))

    # what an item tells by itself is told first, and hashes are packed, so that little is moved
    i = package["items"]
    expected = K.idempotency_key(F.col("tenant_id"), F.col("source"), F.col("subject"), F.col("content_hash"))
    linked = package["events"].select("stream", "seq", F.lit(True).alias("_linked")).dropDuplicates(["stream", "seq"])
    alone = i.select("item_id", "stream", "seq", (~F.col("idempotency_key").eqNullSafe(expected)).alias("_wrong")).join(linked, ["stream", "seq"], "left")
    alone = _errors(alone, "items", F.col("item_id"), wrong_key=F.col("_wrong"), not_linked=F.col("_linked").isNull())

    # items by the page they point into; each page's fragments are hashed once
    pages = evidence.filter("kind = 'page'").select("sha256").distinct().join(package["objects"].select("sha256", "content"), "sha256")
    fragments = page_fragments(pages, "sha256", "content").select(K.packed_hash(F.col("sha256")).alias("_page"), F.col("json_path").alias("_path"), F.unhex(F.sha2(canonical_json(F.col("fragment")), 256)).alias("_fragment"))
    known = evidence.select(F.col("evidence_id").alias("_id"), F.col("storage_key").alias("_storage"), F.col("kind").alias("_kind"), F.col("sha256").alias("_sha")).join(objects.select(F.col("_key").alias("_sha"), F.lit(True).alias("_stored")), "_sha", "left").withColumn("_sha", K.packed_hash(F.col("_sha")))
    i = i.select("item_id", "evidence_id", "storage_key", "json_path", K.packed_hash(F.col("raw_hash")).alias("_raw")).join(known, F.col("evidence_id") == F.col("_id"), "left")
    there = F.col("_id").isNotNull()
    paged, filed = there & (F.col("_kind") == "page") & F.col("_stored").isNotNull(), there & (F.col("_kind") == "file") & F.col("_stored").isNotNull()
    i = i.select(
        "item_id", "json_path", "_raw", F.when(paged, F.col("_sha")).alias("_in"), (~there).alias("_missing"), (there & (F.col("storage_key") != F.col("_storage"))).alias("_elsewhere"), (filed & (F.col("_raw") != F.col("_sha"))).alias("_other"),
    )
    i = i.join(fragments, (F.col("_in") == F.col("_page")) & (F.col("json_path") == F.col("_path")), "left")
    items = _errors(
        i, "items", F.col("item_id"), evidence_missing=F.col("_missing"), storage_key_differs=F.col("_elsewhere"),
        path_unresolved=F.col("_in").isNotNull() & F.col("_fragment").isNull(), fragment_differs=F.col("_in").isNotNull() & (F.col("_fragment") != F.col("_raw")), file_hash_differs=F.col("_other"),
    )
    out = files
    for part in (chain, tied, ends, kept, extra, alone, items):
        out = out.unionByName(part)
    return out
