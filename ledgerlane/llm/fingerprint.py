"""Merkle trees over the sections and paragraphs of documents, with DataFrame operations only.

A section ends at two line ends, a paragraph at one, and a paragraph's leaves end where its own words say so:
after the spaces behind a word that ends with one of ``CUT``, so an edit changes the leaves around it only. A
leaf's node is SHA-256 of ``l`` and its text, a paragraph's of ``p`` and its leaves' nodes, a section's of ``s``
and its paragraphs' nodes, the root's of ``r`` and the sections' nodes (hex, joined by commas). The cuts lose
nothing, so roots are equal exactly when texts are. Branches that differ locate edits (``tree_nodes`` and
``edited_branches``). Two trees are alike by the share of their distinct leaf branches that both have, 1 where
the roots are equal.

Defined results: a null text is empty and has the root of one empty paragraph; trees whose only leaves are
empty have likeness 0 to others; rows with equal ids follow each other by hash of the text; rows without an id
come first; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Signs and letters at whose words' ends a leaf ends (every five to six words in European languages).
CUT = ".,;:!?gkmpy"
#: Text bytes of neighbouring documents that one task orders.
BUCKET_BYTES = 1 << 20
#: Buckets at most, so that their bounds have a fixed size; beyond it buckets grow and spill.
MOST_BUCKETS = 16_384
#: The place of rows without an id.
NO_ID = -(1 << 63)


def leaves(paragraph: Column) -> Column:
    """A paragraph's leaves; together they are its text. A paragraph has no line end, so one can mark the cuts."""
    return F.split(F.regexp_replace(paragraph, rf"([{CUT}])( +)", "$1$2\n"), "\n", -1)


def leaf_nodes(paragraph: Column) -> Column:
    return F.transform(leaves(paragraph), lambda x: F.sha2(F.concat(F.lit("l"), x), 256))


def _node(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.concat_ws(",", children)), 256)


def tree(text: Column) -> Column:
    """Leaf nodes of every paragraph of every section of a non-null text."""
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaf_nodes))


def section_of(paragraphs: Column) -> Column:
    return _node("s", F.transform(paragraphs, lambda p: _node("p", p)))


def root_of(sections: Column) -> Column:
    """Hex root of a tree."""
    return _node("r", F.transform(sections, section_of))


def root(text: Column) -> Column:
    """Hex root of a non-null text's tree."""
    return root_of(tree(text))


EMPTY_LEAF = "sha2('l', 256)"


def branches(sections: Column) -> Column:
    """Distinct leaf nodes of a tree, but for the empty leaf's."""
    return F.array_remove(F.array_distinct(F.flatten(F.flatten(sections))), F.expr(EMPTY_LEAF))


def likeness(one: Column, other: Column, one_root: Column, other_root: Column) -> Column:
    """Share of two trees' branches that both have."""
    both = F.size(F.array_intersect(one, other))
    either = F.size(one) + F.size(other) - both
    return F.when(one_root == other_root, 1.0).when(either == 0, 0.0).otherwise(both / either)


def tree_nodes(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph: id, section, paragraph (from 0), their nodes and the root."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), root(t).alias("root"), F.posexplode(F.split(t, "\n\n", -1)).alias("section", "_s"))
    own = F.transform(F.split("_s", "\n", -1), leaf_nodes)
    rows = rows.select("id", "root", "section", section_of(own).alias("section_node"), F.posexplode(F.split("_s", "\n", -1)).alias("paragraph", "text"))
    return rows.withColumn("paragraph_node", _node("p", leaf_nodes(F.col("text"))))


def edited_branches(before: DataFrame, after: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Places whose paragraph differs between two versions of a document: id, section, paragraph, change
    (edited, added, removed). Sections with equal nodes are left out before paragraphs are compared."""
    a, b = tree_nodes(before, id_column, text), tree_nodes(after, id_column, text)
    keys = ["id", "section"]
    sides = [x.select(*keys, F.col("section_node").alias(n)).distinct() for x, n in ((a, "_a"), (b, "_b"))]
    changed = sides[0].join(sides[1], keys, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)
    both = [x.join(changed, keys, "left_semi").select(*keys, "paragraph", F.col("paragraph_node").alias(n)) for x, n in ((a, "_a"), (b, "_b"))]
    rows = both[0].join(both[1], [*keys, "paragraph"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return rows.select(*keys, "paragraph", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("edited").alias("change"))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below or at key, found in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    lines = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(x[0]) for x in lines])
    table = F.array(*[F.array(*[F.lit(b) for b in x]) for x in lines])
    line = F.size(F.filter(heads, lambda b: b <= key))
    return F.when(line == 0, 0).otherwise((line - 1) * width + F.size(F.filter(F.element_at(table, F.greatest(line, F.lit(1))), lambda b: b <= key)))


def with_next_text(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, next_text) in ascending doc_id; after the last comes the first.

    Ids are cut at approximate percentiles into buckets of about bucket_bytes of text. The first row of each
    bucket also goes to the bucket before it (the very first to the last), so that each bucket knows its
    rows' followers. Texts are shuffled once; to the driver come only the bounds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_BUCKETS, math.ceil(total / bucket_bytes))
    bounds: list[int] = []
    if n > 1:
        at = [i / n for i in range(1, n)]
        bounds = sorted(set(rows.agg(F.percentile_approx("key", at, max(10_000, 10 * n))).first()[0]))
    rows = rows.withColumn("bucket", _bucket(F.col("key"), bounds).cast("int"))
    # as many rows as buckets: at most MOST_BUCKETS
    heads = rows.groupBy("bucket").agg(F.min("key").alias("key"))
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(Window.partitionBy())
    heads = heads.select("key", F.coalesce(F.lag("bucket").over(order), last).alias("before"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("before").cast("int").alias("bucket"), F.lit(1).alias("guest"))
    rows = rows.join(F.broadcast(heads), "key", "left").withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    rows = rows.select("doc_id", "key", "text", F.col("to.bucket").alias("bucket"), F.col("to.guest").alias("guest"))
    following = Window.partitionBy("bucket").orderBy("guest", "key", F.xxhash64("text"))
    return rows.withColumn("next_text", F.lead("text").over(following)).filter("guest = 0").select("doc_id", "text", "next_text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next text."""
    rows = with_next_text(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    trees = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("text")).alias("a"), tree(F.col("edited")).alias("b"), tree(F.col("next_text")).alias("c"),
    )
    rows = trees.select(
        "doc_id", "n_chars", "edited_sha256", root_of(F.col("a")).alias("fingerprint"), root_of(F.col("b")).alias("edited_fingerprint"), root_of(F.col("c")).alias("next_fingerprint"),
        branches(F.col("a")).alias("a"), branches(F.col("b")).alias("b"), branches(F.col("c")).alias("c"),
    )
    near_edited = likeness(F.col("a"), F.col("b"), F.col("fingerprint"), F.col("edited_fingerprint"))
    near_next = likeness(F.col("a"), F.col("c"), F.col("fingerprint"), F.col("next_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near_edited.alias("near_edited"), near_next.alias("near_next"))


_LEAVES = f"list_transform(string_split(regexp_replace(q, '([{CUT}])( +)', '\\1\\2' || chr(10), 'g'), chr(10)), lambda x: sha256('l' || x))"
_TREE = f"list_transform(string_split(%s, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda q: {_LEAVES}))"
_ROOT = "sha256('r' || array_to_string(list_transform(%s, lambda s: sha256('s' || array_to_string(list_transform(s, lambda q: sha256('p' || array_to_string(q, ','))), ','))), ','))"
_BRANCHES = "list_filter(list_distinct(flatten(flatten(%s))), lambda x: x <> sha256('l'))"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx FROM d),
e AS (SELECT *, substring(t, 1, CAST(length(t) - length(t) // 2 AS BIGINT)) || substring(nx, 1, CAST(length(t) // 2 AS BIGINT)) AS ed FROM n),
p AS (SELECT *, {_TREE % "t"} AS ta, {_TREE % "ed"} AS tb, {_TREE % "nx"} AS tc FROM e),
r AS (SELECT *, {_ROOT % "ta"} AS f, {_ROOT % "tb"} AS fe, {_BRANCHES % "ta"} AS a, {_BRANCHES % "tb"} AS b, {_BRANCHES % "tc"} AS c FROM p),
q AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM r)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, f AS fingerprint, fe AS edited_fingerprint,
  CASE WHEN t = ed THEN 1.0::DOUBLE WHEN len(a) + len(b) - ab = 0 THEN 0.0::DOUBLE ELSE ab::DOUBLE / (len(a) + len(b) - ab) END AS near_edited,
  CASE WHEN t = nx THEN 1.0::DOUBLE WHEN len(a) + len(c) - ac = 0 THEN 0.0::DOUBLE ELSE ac::DOUBLE / (len(a) + len(c) - ac) END AS near_next
FROM q
"""
