"""Training-data operators: edge cases, round trips, brute force and held-out accuracy."""

import hashlib
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlane.llm import common, fingerprint, html_text, language, licenses, media, mixing, near_dup, packing, queries, substring, toxicity

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"w{i % 9973}" for i in range(120_000))
ODD = [
    (1, "Hello world, this is a text of more than five words.", "en", "a", 10, "x"), (1, "Hello world, this is a text of more than five words.", "en", "a", 10, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 0, "y"),
    (None, "no id at all but some words here too", "en", "b", 5, None), (None, None, None, None, None, None), (5, " \t\n ", "fr", None, 3, "z"), (6, LONG, "en", "a", len(LONG), "z"), (7, "one", "de", "c", 3, "q"), (8, "Éa ö ﬀ <|endoftext|> \u0000 x", "de", "c", 3, "q"),
]
#: Columns whose names an operator might use itself.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string"
CLASHING = {"row": 1, "h": "h", "n": 2, "cid": 3, "spans": "s", "copies": 4, "number": 5, "hits": "h", "th": 6, "key": "k", "size": 7, "label": "l"}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).withColumns({k: F.lit(v) for k, v in CLASHING.items()}).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 0), (3, None, 1), (None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")


def docs_of(texts):
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [b"", b"a" * 64, bytes(range(256)), b"\xff\x00" * 5000])
@pytest.mark.parametrize("adaptive", [False, True])
def test_png_round_trip(rows, adaptive):
    payload = media.pad(rows)
    image = media.to_png(payload, adaptive=adaptive)
    assert media.from_png(image).tobytes() == payload
    for at in (9, 20, len(image) // 2, len(image) - 6):
        damaged = image[:at] + bytes([image[at] ^ 1]) + image[at + 1 :]
        with pytest.raises(ValueError):
            media.from_png(damaged)
    with pytest.raises(ValueError):
        media.from_png(image[:-12])


@pytest.mark.parametrize("width", [1, 7, 64])
def test_every_filter_is_written_and_read(width):
    rng = np.random.default_rng(8)
    smooth = (np.cumsum(rng.integers(-3, 4, (50, width)), axis=1) + np.arange(50)[:, None] * 5).astype(np.uint8)
    smooth[10:20] = rng.integers(0, 256, (10, width))
    smooth[30:35] = 9
    for kinds in (media.FAST, media.ALL_FILTERS, (3,), (4,), (2,)):
        image = media.to_png(smooth.tobytes(), width, filters=kinds)
        assert media.from_png(image).tobytes() == smooth.tobytes()
    used = set(media.filter_rows(smooth, media.ALL_FILTERS)[:, 0].tolist())
    assert len(used) >= (1 if width == 1 else 3)


def plain_hash(samples):
    """cosine_hash by plain loops over the picture's cells and coefficients."""
    height, width = samples.shape
    grid = np.zeros((32, 32))
    for y in range(32):
        for x in range(32):
            a, b = y * height // 32, x * width // 32
            c, d = min(height, max(a + 1, -(-(y + 1) * height // 32))), min(width, max(b + 1, -(-(x + 1) * width // 32)))
            grid[y, x] = samples[a:c, b:d].astype(float).mean()
    low = np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            ys, xs = np.cos(np.pi * u * (2 * np.arange(32) + 1) / 64), np.cos(np.pi * v * (2 * np.arange(32) + 1) / 64)
            low[u, v] = round(float((grid * ys[:, None] * xs[None, :]).sum()), 6)
    low[0, 0] = 0
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


def test_media_digests_are_those_of_the_texts(spark):
    import io
    import struct

    texts = ["", "a", "x" * 64, "Ünï" * 50, "some longer text of words " * 40, None, "b\x00\x00"]
    rows = {r["doc_id"]: r for r in media.text_media(spark.createDataFrame(docs_of(["" if t is None else t for t in texts])[:5] + [(5, None, "en", "s", 0), (6, texts[6], "en", "s", 3)], DOCS)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["feature"] == plain_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        image = media.to_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        # the file by the format's own rules: IHDR's fields, and the inflated rows' filter bytes
        f = io.BytesIO(image[8:])
        parts = []
        while size := f.read(4):
            kind, body, crc = f.read(4), f.read(struct.unpack(">I", size)[0]), f.read(4)
            assert struct.unpack(">I", crc)[0] == zlib.crc32(kind + body)
            parts.append((kind, body))
        assert parts[0] == (b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 64, 8, 0, 0, 0, 0))
        assert len(zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT"))) == 65 * (len(payload) // 64)


def test_all_five_filters_are_undone():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, (40, 12), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40).astype(np.uint8)
    coded = raw.astype(int).copy()
    for r in range(40):
        for x in range(12):
            a = int(raw[r, x - 3]) if x >= 3 else 0
            b = int(raw[r - 1, x]) if r else 0
            c = int(raw[r - 1, x - 3]) if r and x >= 3 else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded[r, x] -= (0, a, b, (a + b) // 2, paeth)[kinds[r]]
    assert np.array_equal(media.unfilter(kinds, (coded % 256).astype(np.uint8), 3), raw)


def test_media_of_odd_texts(odd, empty):
    rows = media.text_media(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= 64 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(tuple(r)[1:])
    assert len(by[1]) == 1
    assert next(iter(by[2]))[0] == 0
    assert media.text_media(empty).count() == 0


def test_image_columns(spark):
    rows = spark.createDataFrame([(1, bytearray(64), "m"), (2, None, "n")], "id int, payload binary, media_width string")
    out = media.read_images(media.write_images(rows).withColumn("media", F.when(F.col("id") == 1, F.col("media")).otherwise(F.lit(b"junk"))), keep=["id"]).orderBy("id").collect()
    assert (out[0]["media_width"], bytes(out[0]["samples"]), out[0]["media_error"]) == (64, bytes(64), None)
    assert out[1]["samples"] is None
    assert out[1]["media_error"] == "no PNG signature"


def test_words_and_hashes_match_a_plain_reading():
    texts = ["a  B\tc\n", None, "", "é x", LONG, "x" * 400_000 + " y", "no space"]
    seen = {}
    for first, last, counts, hashes, starts, ends in common.hashed_words(pa.array(texts)):
        at = 0
        for i in range(first, last):
            raw = (texts[i] or "").encode()
            want = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
            got = list(zip(starts[at : at + counts[i - first]].tolist(), ends[at : at + counts[i - first]].tolist(), strict=True))
            assert got == want
            for (a, b), h in zip(want, hashes[at : at + counts[i - first]].tolist(), strict=True):
                assert seen.setdefault(raw[a:b].lower() if raw[a:b].isascii() else raw[a:b], h) == h
            at += counts[i - first]
    assert len(set(seen.values())) == len(seen)


def test_fingerprints_of_odd_texts(odd, empty):
    rows = fingerprint.fingerprinted(odd).collect()
    assert len(rows) == len(ODD)
    same = {r["fingerprint"] for r in rows if r["n_chars"] == 0}
    assert len(same) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.fingerprinted(empty).count() == 0


def test_next_texts_cross_buckets(spark):
    n = 500
    docs = spark.createDataFrame([(i * 7, f"text {i} " * 9) for i in range(n)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next_text(docs, bucket_bytes=2000).collect()}
    assert got == {i * 7: f"text {(i + 1) % n} " * 9 for i in range(n)}


def test_fingerprints_match_a_plain_tree(spark):
    """Roots and likeness of small trees, built by hand in Python."""
    sha = lambda kind, x: hashlib.sha256((kind + x).encode()).hexdigest()

    def plain(text):
        found, sections = set(), []
        for s in text.split("\n\n"):
            paragraphs = []
            for q in s.split("\n"):
                own = re.sub(rf"([{fingerprint.CUT}])( +)", "\\1\\2\n", q).split("\n")
                assert "".join(own) == q
                found.update(sha("l", x) for x in own if x)
                paragraphs.append(sha("p", ",".join(sha("l", x) for x in own)))
            sections.append(sha("s", ",".join(paragraphs)))
        return sha("r", ",".join(sections)), found

    rng = random.Random(9)
    some = ["many", "words,", "\n", "\n\n", "end.", "of", "a", "big", "é", "  "]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randrange(0, 40))) for _ in range(40)] + ["", "\n\n"]
    texts.append(texts[3].replace("of", "off of", 1))
    rows = {r["doc_id"]: r for r in fingerprint.fingerprinted(spark.createDataFrame(docs_of(texts), DOCS)).collect()}
    for i, t in enumerate(texts):
        (f, a), (g, c) = plain(t), plain(texts[(i + 1) % len(texts)])
        assert rows[i]["fingerprint"] == f
        assert rows[i]["near_next"] == pytest.approx(1.0 if f == g else len(a & c) / max(1, len(a | c)))


def test_an_insertion_keeps_the_leaves_around_it(spark):
    text = " ".join(f"some words go by {i}," for i in range(60))
    rows = fingerprint.fingerprinted(spark.createDataFrame([(1, text), (2, "new " + text)], "doc_id long, text string")).collect()
    assert all(r["near_next"] > 0.95 for r in rows)


def test_edits_are_located(spark):
    a = spark.createDataFrame([(1, "p0\np1\n\nq0\nq1")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "p0\np1\n\nq0\nqX\nq2")], "doc_id long, text string")
    got = sorted((r["section"], r["paragraph"], r["change"]) for r in fingerprint.edited_branches(a, b).collect())
    assert got == [(1, 1, "edited"), (1, 2, "added")]


def test_toxicity_of_odd_texts(odd, empty, labels):
    rows = toxicity.digest(odd, labels).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.digest(empty, labels).count() == 0
    assert toxicity.digest(odd, labels.limit(0)).filter("predicted = 1").count() == 0
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns
    assert {r["score"] for r in kept.collect()} <= {"x", "y", "z", "q", None}


def test_toxicity_sees_through_disguises_and_spares_exceptions(spark):
    rng = random.Random(4)
    plain = [" ".join(rng.choice(["table", "river", "stone", "garden", "window", "trash", "can"][:5]) for _ in range(60)) for _ in range(160)]
    bad = [" ".join(w if rng.random() > 0.08 else rng.choice(["idiot", "moron"]) for w in t.split()) for t in plain[:60]]
    rows = [(i, t, 1) for i, t in enumerate(bad)] + [(1000 + i, t, 0) for i, t in enumerate(plain)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    probe = ["the 1d10t and m0ron idiot here", "іdіоt mоrоn ídiot", "a river and a stone", "idiot proof table"]
    got = [r["score"] for r in toxicity.scored(spark.createDataFrame([(i, t) for i, t in enumerate(probe)], "i int, text string"), model).orderBy("i").collect()]
    assert got[0] > 0.7
    assert got[1] > 0.7
    assert got[2] < 0.3
    assert got[3] < 0.3


def test_matcher_counts_as_a_naive_one_does():
    rng = random.Random(6)
    some = ["idiot", "idi", "moron ", "trash", "trash can", "sc", "scum ", "x" * 60 + " ", "can"]
    exceptions = ("trash can", "pond scum", "idiot proof idiot", "can trash")
    for _ in range(300):
        terms = rng.sample(some, rng.randrange(1, len(some)))
        text = " ".join(rng.choice(["idiot", "idiots", "moron", "trash", "can", "pond", "scum", "proof", "x" * 60, "river"]) for _ in range(rng.randrange(0, 30)))
        folded = toxicity.fold(text)
        safe = [(i, i + len(p) + 2) for p in exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
        naive = {}
        for k, t in enumerate(terms):
            places = [(i, i + len(t) + 1) for i in range(len(folded)) if folded.startswith(f" {t}", i)]
            n = sum(not any(a <= i and j <= b for a, b in safe) for i, j in places)
            if n:
                naive[k] = n
        assert dict(toxicity.Matcher(terms, exceptions).counts(folded)) == naive


def test_counts_and_term_lengths_have_no_cap():
    assert toxicity.value(8, 1000) < toxicity.value(9, 1000) < toxicity.value(200, 1000)
    assert "y" * 300 + " " in toxicity.terms_of(f" {'y' * 300} ")
    assert toxicity.fold("ԁսꜱᴛ ρіɡ 8ꞵ6 ﬁ").split()[:2] == ["dust", "pig"]
    rows = [{0: 1} for _ in range(40)] + [{} for _ in range(40)]
    weights, const = toxicity.fit(rows, [100] * 80, [1] * 40 + [0] * 40, 1)
    scores = [const + weights[0] * toxicity.value(n, 1000) for n in (1, 8, 9, 200)]
    assert scores == sorted(scores)
    assert len(set(scores)) == 4


def test_toxicity_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out and toxic is not null")
    r = rows.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("acc"), F.count_if(F.expr("predicted = 1 and toxic = 0")).alias("fp"), F.count(F.lit(1)).alias("n")).first()
    assert r["acc"] > 0.9
    assert r["fp"] <= 0.03 * r["n"]


def brute_region(page, weights):
    values = [weights.get(k, 1.0) * n if n and k[0] != "-" else -1.0 * n if n else weights.get(k, -1.0) for k, n, _ in page.items]
    best, found = 0.0, (0, 0)
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            if sum(values[i:j]) > best + 1e-9:
                best, found = sum(values[i:j]), (i, j)
    return best, values, found


def test_html_regions_have_the_largest_sum():
    rng = random.Random(8)
    for _ in range(30):
        text = "".join(rng.choice(["<p>", "</p>", "<div>", "</div>", "some words here ", "<a href='x'>", "</a>", "one", "<br>"]) for _ in range(18))
        page = html_text.Page(text)
        best, values, _ = brute_region(page, {})
        a, b = page.region({})
        assert abs(sum(values[a:b]) - best) < 1e-9


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain text  only", "plain text only"), ("<p>a<p>b<br>c</p>", "a\n\nb c"), ("<article><h1>T</h1><p>x &amp; y &#233;&amp;lt;</p></article><footer>f</footer>", "T\n\nx & y é&lt;"),
        ("<nav><a>m</a></nav><main><p>one two three</p><div class='ad-box'>buy</div><aside>s</aside><p>four</p><section id=comments><p>first!</p></section></main><script>var t='</p>';</script>", "one two three\n\nfour"),
        ("<body><div class='cookie-notice'>We use cookies</div><div><p>real words stand here now</p><form><p>mail</p></form></div></body>", "real words stand here now"), ("<article><p>never closed <b>bold", "never closed bold"), ("İİİİ<SCRIPT>x</p>y</Script>z", "İİİİz"), ("<article>" + "<p>x</p>" * 500 + "</article>", "\n\n".join(["x"] * 500)),
    ],
)
def test_html_texts(page, want):
    assert html_text.Page(page).text({}) == want


@pytest.mark.parametrize("tag", ["div class='content with-sidebar'", "div class='post no-comments'", "div class='entry has-share'", "div class='page search-results'", "article class='post has-comments'", "div class='content-sidebar-wrap'", "main class='no-sidebar'", "div id=widget", "form id=f"])
def test_html_wrappers_are_no_asides(tag):
    name = tag.split()[0]
    page = f"<body><nav>m n</nav><{tag}><div><h2 id='related'>Head</h2><p>one two <math><mi>a</mi></math> three <svg><text>b</text></svg></p></div></{name}><div class='site-footer'>foot</div></body>"
    assert html_text.Page(page).text({}) == "Head\n\none two a three b"


def test_html_comments_are_left_out_even_with_articles_in_them():
    page = "<div class='x'><p>the text of the page is here</p></div><section id='comments'><article>first</article><article>second</article></section>"
    assert html_text.Page(page).text({}) == "the text of the page is here"


@pytest.mark.parametrize("unit", ["<a \"", "<a x=\"", "<b>", "<", "<script>", "<p ", "<article>a b</article>", "<div class=ad>w ", "<textarea", "<a x='", "</i>", "<!--", "<li>x"])
def test_html_is_read_in_linear_time(unit):
    began = time.process_time()
    html_text.Page(unit * (200_000 // len(unit))).text({})
    assert time.process_time() - began < 5


def test_html_whole_pages_match_their_plan():
    """Pages are put together from blocks that are known to be in or out; the text must be those that are in."""
    rng = random.Random(31)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(99)}" for _ in range(n))
    for _ in range(150):
        want, body = [], []
        for _ in range(rng.randrange(2, 9)):
            w = words(rng.randrange(5, 40))
            kind = rng.randrange(8)
            if kind < 4:
                want.append(w)
                body.append((f"<p>{w}</p>", f"<h2 class='related'>{w}</h2>", f"<ul><li>{w}</ul>", f"<p>{w.replace(' ', ' <b>', 1)}</b></p>" if " " in w else f"<p>{w}")[kind])
            else:
                body.append((f"<div class='ad'>{w}</div>", f"<aside><p>{w}</p></aside>", f"<section class='user-comments'><p>{w}</p></section>", f"<script>{w}<p></script><style>{w}</style><form>{w}</form>")[kind - 4])
        if not want:
            continue
        outer = rng.choice(("article", "main", "div class='post-body with-sidebar'", "section"))
        page = f"<html><head><title>{words(5)}</title></head><body><header>{words(9)}</header><nav><a href=x>{words(6)}</a></nav><{outer}>{''.join(body)}</{outer.split()[0]}><div class='sidebar'>{words(8)}</div><footer>{words(7)}</footer></body></html>"
        assert html_text.Page(page).text({}) == "\n\n".join(want), page


def test_html_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 3), (2, "u", "<p>a</p>", 3), (2, "u", "<p>a</p>", 3), (None, "v", "", None)], "page_id long, url string, html string, text int")
    rows = html_text.extracted(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in rows) == [(0, ""), (1, ""), (2, "a"), (2, "a")]
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_likelihoods_sum_all_segmentations():
    pieces = ["a", "b", "ab", "▁", "▁a", "ba"]
    rng = np.random.default_rng(1)
    probs = rng.random((len(pieces) + 1, 2)) / 9
    lattice = language.Lattice(pieces, np.log(probs))

    def brute(rest):
        if not rest:
            return np.ones(2)
        total = np.zeros(2)
        for i, p in enumerate(pieces):
            if rest.startswith(p):
                total += probs[i] * brute(rest[len(p) :])
        return total

    for w in ("a", "ab", "abba", "babab"):
        assert np.allclose(lattice.batch([w])[0], np.log(brute("▁" + w)))
        assert np.allclose(lattice.log_likelihood(w), np.log(brute("▁" + w)))
    long = "ab" * 200
    assert np.isfinite(lattice.log_likelihood(long)).all()
    total = np.zeros((len(pieces) + 2, 2))
    lattice.expected(["abba"], np.array([[1.0, 2.0]]), total)
    uses = sum(total[i] * len(p) for i, p in enumerate(pieces))
    assert np.allclose(uses, [5.0, 10.0])  # every segmentation covers the mark and four letters


def test_long_words_are_summed_by_logarithms(monkeypatch):
    pieces = ["a", "b", "ab", "▁", "▁a", "ba", "abbaabbaabba"]
    logs = np.log(np.random.default_rng(2).random((len(pieces) + 1, 3)) / 9)
    lattice, words = language.Lattice(pieces, logs), ["abbaabbaabbaab", "abxba", "x", "abbaabbaabba"]
    counts = np.arange(12, dtype=float).reshape(4, 3)
    found, totals = [], []
    for longest in (40, 0):
        monkeypatch.setattr(language, "LONG", longest)
        totals.append(np.zeros((len(pieces) + 2, 3)))
        lattice.expected(words, counts, totals[-1])
        found.append(lattice.batch(words))
    assert np.allclose(found[0], found[1])
    assert np.allclose(totals[0][:-1], totals[1][:-1])
    began = time.process_time()
    assert np.isfinite(lattice.log_likelihood("ab" * 40_000)).all()
    assert time.process_time() - began < 20


def test_more_languages_than_any_bound(spark):
    rows = [(k * 100 + i, " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}{x}" for x in ("ore", "anta", "ilm", "usk")) + (" " + "q" * 3000 if i == 7 else ""), f"l{k:02}", None, 9) for k in range(70) for i in range(8)]
    found = language.digest(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] // 100:02}" for r in found if r["doc_id"] % 100 != 7)
    assert {r["lang_pred"] for r in found} == {f"l{k:02}" for k in range(70)}


def test_language_of_odd_texts(odd, empty, spark):
    rows = language.digest(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (2, 3, 5))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.digest(empty).count() == 0


def test_language_is_accurate_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert rows.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, f"s{rng.choice('aab')}" if i % 5 else None, rng.choice([0, 3, 50, 400])) for i in range(3000)]
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    got = plan.collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, n) for i, _, n in rows)
    sums = {r["source"]: r for r in plan.groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("own"), F.sum("taken").alias("taken")).collect()}
    total = sum(n for _, _, n in rows)
    assert abs(sum(r["target"] for r in sums.values()) - total) < 1e-6 * total
    for r in sums.values():
        assert r["target"] <= 3 * r["own"] + 1e-6
        assert abs(r["taken"] - r["target"]) <= 400
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in got)
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_targets_share_the_excess_by_weight(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 5)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    want, rest, open_ = {}, 2015.0, {"a": 5, "b": 2, "c": 1, "d": 5}
    caps = {"a": 30, "b": 3000, "c": 3000, "d": 15}
    while True:
        share = {k: rest * w / sum(open_.values()) for k, w in open_.items()}
        over = [k for k in share if share[k] > caps[k]]
        if not over:
            want |= share
            break
        for k in over:
            want[k], rest = caps[k], rest - caps[k]
            del open_[k]
    assert got == pytest.approx(want)


def test_mixing_of_odd_rows(odd, empty):
    plan = mixing.mix(mixing.sized_documents(odd))
    assert plan.count() == len(ODD)
    assert mixing.mix(mixing.sized_documents(empty)).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == plan.agg(F.sum("copies")).first()[0]


def test_licences(spark):
    files = [
        (1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/x.py", "code words and so on\nmore"), (3, "q/y.py", "body\nLicensed under the Apache License, Version 2.0.\nmore body text that is long enough to be no licence file at all"),
        (4, "q/z.py", "nothing"), (5, None, "Licensed under CC BY-NC 4.0."), (6, "p/a/b/w.py", None), (7, "p/a/b/v.py", ""), (7, "p/a/b/v.py", ""), (None, "r", "This work is licensed under the GNU General Public License, version 3."),
    ]
    rows = licenses.licensed(spark.createDataFrame(files, "id long, path string, text string")).collect()
    got = sorted((r["id"] or 0, r["license"], r["basis"], r["license_path"]) for r in rows)
    assert [g[:3] for g in got] == [(0, "GPL-3.0", "file"), (1, "MIT", "file"), (2, "MIT", "inherited"), (3, "Apache-2.0", "header"), (4, "GPL-3.0", "inherited"), (5, "CC-BY-NC-4.0", "file"), (6, "MIT", "inherited"), (7, "MIT", "inherited"), (7, "MIT", "inherited")]
    assert licenses.licensed(spark.createDataFrame([], "id long, path string, text string")).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2019 A. N. Author and others

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.
"""
BSD_TEXT = """Copyright (c) 2011, Some Company
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in
binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the
copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_whole_licence_files_cover_what_is_below(spark):
    with open("/usr/share/common-licenses/Apache-2.0") as f:
        apache = f.read()
    wrapped = "# Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance\n# with the License.\n\n" + "\n".join(f"x{i} = call(y{i})" for i in range(60))
    prose = " ".join(["the house of the people and to the river that they may use"] * 40)
    files = [(1, "m/LICENSE", MIT_TEXT), (2, "m/a/b/x.py", "x"), (3, "b/LICENSE", BSD_TEXT), (4, "b/y.py", "y"), (5, "p/LICENSE", apache), (6, "p/s/z.py", None), (7, "q/w.py", wrapped), (8, "r/prose.txt", prose)]
    files += [(10 + i, f"z/{i}.txt", f"the text of a file to be read {i} and the end of it") for i in range(30)]
    rows = licenses.licensed(spark.createDataFrame(files, "id long, path string, text string")).filter("id < 10").collect()
    got = {r["id"]: (r["license"], r["basis"], r["license_path"]) for r in rows}
    assert got == {
        1: ("MIT", "file", "m"), 2: ("MIT", "inherited", "m"), 3: ("BSD-3-Clause", "file", "b"), 4: ("BSD-3-Clause", "inherited", "b"),
        5: ("Apache-2.0", "file", "p"), 6: ("Apache-2.0", "inherited", "p"), 7: ("Apache-2.0", "header", "q"), 8: (None, "none", None),
    }


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), ("Licensed under the ISC License.", "ISC"), ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("// SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), ("Released under the Eclipse Public License, version 2.0", "EPL-2.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("See the LICENSE of the house and version", None), ("released to the public by the people", None),
    ],
)
def test_licence_names_are_told_apart(line, want):
    scanner = licenses.Scanner(100_000, {b"the": 90_000, b"of": 80_000, b"under": 4000, b"license": 900, b"released": 700, b"by": 50_000, b"public": 900, b"to": 90_000, b"and": 80_000, b"version": 500, b"this": 60_000, b"is": 80_000})
    assert scanner.text("some code\n\n" + line + "\n\nmore code")[0] == want


def test_licence_scores_are_plain_cosines():
    found = {w: (i * 37) % 900 for i, w in enumerate(sorted(licenses.VOCABULARY | licenses.WHOLE_VOCABULARY))}
    scanner, rng = licenses.Scanner(1000, found), random.Random(3)
    idf = lambda w, known: math.log(1002 / (found[w] + 1)) if w in known else math.log(1002)
    some = [*sorted(licenses.VOCABULARY), *(f"q{i}".encode() for i in range(20))]
    cosine = lambda a, b: sum(v * b.get(w, 0) for w, v in a.items()) / (math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values())) or 1)
    for _ in range(60):
        own = [rng.choice(some) for _ in range(rng.randrange(1, 25))]
        a = {w: own.count(w) * idf(w, licenses.VOCABULARY) for w in own}
        naive = [(cosine(a, {w: licenses.words(t).count(w) * idf(w, licenses.VOCABULARY) for w in licenses.words(t)}), name) for name, t in licenses.TEMPLATES]
        name, score = scanner.line(own)
        assert score == pytest.approx(max(x for x, _ in naive), abs=1e-9)
        assert score == 0 or name in {n for x, n in naive if x > score - 1e-9}
        b = {w: (1 + math.log(own.count(w))) * idf(w, licenses.WHOLE_VOCABULARY) for w in own}
        whole = [cosine(b, {w: (1 + math.log(n)) * idf(w, licenses.WHOLE_VOCABULARY) for w, n in counts.items()}) for _, counts in licenses.WHOLE_COUNTS]
        assert scanner.file(own)[1] == pytest.approx(max(whole), abs=1e-9)


def test_licences_of_odd_files(spark, odd):
    files = spark.createDataFrame([(1, "a/LICENSE", "Released under the MIT License."), (2, "a/COPYING", "Released under the MIT License."), (3, "a/x", LONG + "\nLicensed under the ISC License.\n" + LONG), (4, "a/b/y", "q " * 5)], "id long, path string, text string")
    clashing = files.withColumns({k: F.lit(v) for k, v in CLASHING.items()} | {"dir": F.lit("d"), "score": F.lit(1), "license": F.lit("l")})
    rows = {r["id"]: r for r in licenses.licensed(clashing).collect()}
    assert (rows[1]["license"], rows[1]["basis"]) == ("MIT", "file")
    assert (rows[3]["license"], rows[3]["basis"]) == ("ISC", "header")
    assert (rows[4]["license"], rows[4]["license_path"]) == ("MIT", "a")
    assert licenses.licensed(licenses.document_files(odd)).count() == len(ODD)


def test_lines_without_an_anchor_can_not_reach_the_least_score():
    scanner = licenses.Scanner(1000, {b"the": 900, b"of": 800, b"this": 500})
    rng = random.Random(2)
    weak = sorted(licenses.VOCABULARY - scanner.anchors)
    for _ in range(500):
        assert scanner.line([rng.choice(weak) for _ in range(rng.randrange(1, 20))])[1] < licenses.LEAST


def test_token_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    rng, path = random.Random(5), packing.default_tokenizer()
    ids, plain = packing.WordIds(path), Tokenizer.from_file(path)
    letters = "abcXYZ .,;'’\"!?#$%<|>\n\t\r\x0b\x1c\u0085éÉßİıΣσςÄáë12٣ªºǅɐЖ你好😀½²Ⅷ_-st'ré̈​  "
    for _ in range(4000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 40)))
        assert ids.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids
    for t in ("a <|endoftext|> b", "<|startoftext|>x", "it's they're I'LL", LONG[:9000]):
        assert ids.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing_of_odd_texts(odd, empty):
    from tokenizers import Tokenizer

    plain, rows = Tokenizer.from_file(packing.default_tokenizer()), packing.pack(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in {(d, t) for d, t, *_ in ODD if d is not None}:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        copies = sum(d == doc_id for d, *_ in ODD)
        own = sorted(by[doc_id], key=lambda r: r["start"])[::copies]
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        assert sum(n for _, n in parts) <= packing.CAPACITY
    assert packing.pack(empty).count() == 0


def test_differencing_makes_near_equal_windows():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 512, 700)
    found, k = packing.windows(sizes)
    loads = np.bincount(found, weights=sizes, minlength=k)
    assert loads.max() <= packing.CAPACITY
    assert loads.max() - loads.min() < 200
    assert k <= -(-sizes.sum() // packing.CAPACITY) + 1
    assert packing.windows(np.array([4000]))[1] == 1


def test_packing_keeps_documents_whole_and_pads_little(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    loads = rows.groupby("sequence_id")["length"].sum()
    assert loads.max() <= packing.CAPACITY
    assert 1 - rows["length"].sum() / (len(loads) * packing.CAPACITY) < 0.02
    whole = rows.groupby("doc_id").agg(pieces=("start", "size"), tokens=("doc_tokens", "first"), sum=("length", "sum"))
    assert (whole["tokens"] == whole["sum"]).all()
    assert (whole["pieces"] == -(-whole["tokens"] // packing.CAPACITY)).mean() > 0.6


def test_many_short_documents_are_bounded_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 500)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("two words")).alias("text"))
    rows = packing.pack(docs).toPandas()
    assert rows.groupby(rows["sequence_id"] // (1 << 31)).size().max() < 800
    assert rows["length"].sum() == 4000 + 2000 * rows["length"].max()
    assert sorted(rows["doc_id"]) == list(range(6000))


def plain_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(texts):
    sets, label = plain_sets(texts), list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["", None, "a b", "A  b"]
    for edits in (1, 2, 3, 4, 5):
        texts += copies(rng, [word() for _ in range(120)], 45, edits)
    rng.shuffle(texts)
    want, sizes = brute_components(texts)
    rows = near_dup.linked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == dict(enumerate(sizes))
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(want))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(5)
    off, fine = [], []
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:350], rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (near_dup.odd_sketches(near_dup.min_hashes(s, np.array([0])))[0] for s in (a, b))
        odd = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        off.append(1 + 512 / (4 * 128) * np.log(1 - 2 * odd / 512) - true)
        (_, n, p), (_, m, q) = near_dup.fine_sketch(a), near_dup.fine_sketch(b)
        odd = sum(int(v).bit_count() for v in (p ^ q).view(np.uint64))
        apart = -1024 * np.log(1 - 2 * odd / 2048)
        fine.append((n + m - apart) / (n + m + apart) - true)
    assert np.std(off) < 0.06
    assert abs(np.mean(off)) < 0.03
    assert np.std(fine) < 0.01


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_dup.linked(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert near_dup.linked(empty).count() == 0
    kept = near_dup.without_copies(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1
    assert {2, 3, 5, 6, 7, 8} <= set(ids)


def test_long_near_copies_in_large_buckets_match_brute_force(spark):
    """Texts with more shingles than the second sketch samples, in buckets with and without a common hub."""
    rng = random.Random(17)
    texts = []
    for _ in range(2):
        base = [f"f{rng.randrange(10**6)}" for _ in range(3 * near_dup.FINE_SAMPLES)]
        texts.append(" ".join(base))
        for k in range(30):
            for _ in range(rng.randrange(10, 160)):  # edits add up, so late copies are far from the first
                base[rng.randrange(len(base))] = f"f{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    want, _ = brute_components(texts)
    rows = near_dup.linked(spark.createDataFrame(docs_of(texts), DOCS).repartition(4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(want))


def test_equally_good_chains_both_count(spark):
    rng = random.Random(18)
    body = lambda n: [f"t{rng.randrange(10**7)}" for _ in range(n)]
    p = body(60)
    texts = [" ".join(x) for x in (p + body(30), body(20) + p + body(5) + p + body(20), body(200))]
    for n in (1, 3):
        rows = substring.passages(spark.createDataFrame(docs_of(texts), DOCS).repartition(n)).collect()
        assert sorted((r["doc_id"], r["rep_id"], r["start"], r["stop"], r["rep_start"]) for r in rows) == [(1, 0, 20, 80, 0), (1, 0, 85, 145, 0)]


def test_one_text_of_a_component_stays_whatever_its_ids(spark):
    rng = random.Random(14)
    text = lambda n: " ".join(f"k{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d = (text(200) for _ in range(4))
    near = c + " and more"
    rows = [(1, a, "p"), (2, a, "q"), (2, b, "r"), (2, b, "r"), (None, c, "s"), (None, near, "t"), (None, d, "u"), (None, None, "v"), (None, None, "v"), (7, "", "w"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in near_dup.without_copies(docs).collect()]
    assert len(kept) == len(set(kept))
    assert {t for _, t in kept if t in (a, b, d)} == {a, b, d}
    assert (1, a) in kept and (2, a) not in kept and (2, b) in kept
    assert sum(t in (c, near) for _, t in kept) == 1
    assert {(None, None), (7, ""), (8, "")} <= set(kept)


def test_mixed_rows_are_taken_as_planned(spark):
    rng = random.Random(15)
    rows = [(i if i % 5 else None, " ".join(["w"] * rng.randrange(1, 30)) if i % 7 else None, "en", rng.choice("abc"), 1) for i in range(400)] + [(9, "the same row", "en", "a", 1)] * 50
    docs = spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in CLASHING.items()}).repartition(4)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    want = {r["source"]: r["target"] for r in mixing.targets(mixing.sized_documents(docs)).collect()}
    assert all(abs(r["n"] - want[r["source"]]) <= 31 for r in got)
    often = {(r["doc_id"], r["text"], r["source"]): r["n"] for r in out.groupBy("doc_id", "text", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    there = {}
    for r in rows:
        there[r[0], r[1], r[3]] = there.get((r[0], r[1], r[3]), 0) + 1
    assert all(n <= 3 * there[k] for k, n in often.items())


def test_shared_passages_are_found_and_cut(spark):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(50_000)}"
    passage = [word() for _ in range(80)]
    fuzzy = [w if rng.random() > 0.04 else word() for w in passage]
    short = [word() for _ in range(30)]
    body = lambda n: [word() for _ in range(n)]
    texts = [body(40) + passage + body(30), body(25) + passage, passage + body(60), body(50) + fuzzy + body(10), body(90) + short, short + body(40), body(200)]
    docs = spark.createDataFrame(docs_of([" ".join(t) for t in texts]), DOCS)
    rows = substring.passages(docs).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3}
    assert {r["rep_id"] for r in rows} == {0}
    spans = {r["doc_id"]: (r["island_start"], r["island_stop"]) for r in rows}
    assert spans[1] == (25, 105)
    assert spans[2] == (0, 80)
    a, b = spans[3]
    assert abs(a - 50) <= 4
    assert abs(b - 130) <= 4
    cut = {r["doc_id"]: r for r in substring.without_passages(docs).collect()}
    assert cut[0]["text"] == " ".join(texts[0])
    assert cut[1]["text"] == " ".join(texts[1][:25])
    assert cut[2]["text"] == " ".join(texts[2][80:])
    assert all(len(r["text"]) == r["n_chars"] for r in cut.values())
    assert all(cut[i]["text"] == " ".join(texts[i]) for i in (4, 5, 6))


def test_short_passages_are_found_where_brute_force_finds_them(spark):
    rng = random.Random(12)
    word = lambda: f"u{rng.randrange(10**7)}"
    texts, want = [], {}
    for n in (50, 51, 55, 60, 70):
        for edits in (0, 0, 0, 0, 0, 1, 2):
            for whole in (True, False):
                p = [word() for _ in range(n)]
                q = list(p)
                for i in rng.sample(range(5, n - 5), edits):
                    q[i] = word()
                a, b = len(texts), len(texts) + 1
                left, right = ([], []) if whole else ([word() for _ in range(70)], [word() for _ in range(90)])
                texts += [[word() for _ in range(80)] + p + [word() for _ in range(75)], left + q + right]
                # brute force: the best diagonal's places in the later document, first to last equal word
                both = [(i, j) for j, y in enumerate(texts[b]) for i, x in enumerate(texts[a]) if x == y]
                want[b] = (a, min(j for _, j in both), max(j for _, j in both) + 1)
    rows = substring.passages(spark.createDataFrame(docs_of([" ".join(t) for t in texts]), DOCS).repartition(3)).collect()
    assert {r["doc_id"]: (r["rep_id"], r["island_start"], r["island_stop"]) for r in rows} == want


@pytest.fixture(scope="module")
def edited_passages():
    """Texts, and by the later document of each pair: (passage's words, edits, first and last word's place)."""
    rng = random.Random(21)
    word = lambda: f"e{rng.randrange(10**7)}"
    texts, want = [], {}
    for n in (51, 60, 70, 80):
        for edits in range(5):
            for _ in range(12):
                p = [word() for _ in range(n)]
                q = list(p)
                for i in sorted(rng.sample(range(4, n - 4), edits), reverse=True):
                    kind = rng.randrange(3)
                    q[i : i + (kind != 1)] = [word()] * (kind != 2)  # changed, added or missing
                if len(q) < substring.LEAST_PASSAGE:
                    continue
                texts += [[word() for _ in range(80)] + p + [word() for _ in range(75)], [word() for _ in range(70)] + q + [word() for _ in range(60)]]
                want[len(texts) - 1] = (n, edits, 70, 70 + len(q))
    return [" ".join(t) for t in texts], want


def test_edited_passages_are_found(spark, edited_passages):
    texts, want = edited_passages
    rows = substring.passages(spark.createDataFrame(docs_of(texts), DOCS).repartition(4)).collect()
    found = {r["doc_id"]: (r["rep_id"], r["island_start"], r["island_stop"]) for r in rows}
    assert set(found) <= set(want)
    whole = {d for d, (_, _, a, b) in want.items() if found.get(d) == (d - 1, a, b)}
    assert {d for d, x in want.items() if x[1] == 0} <= whole
    assert len(set(found) & {d for d, x in want.items() if x[1] < 3}) >= 0.97 * sum(x[1] < 3 for x in want.values())
    assert len(found) >= 0.93 * len(want)
    assert len(whole) >= 0.9 * len(want)


def test_result_does_not_depend_on_which_batch_holds_a_copy(spark):
    rng = random.Random(22)
    word = lambda: f"b{rng.randrange(10**7)}"
    passage = [word() for _ in range(70)]
    texts = [" ".join([word() for _ in range(10 + i % 7)] + passage + [word() for _ in range(20)]) for i in range(120)]
    docs = spark.createDataFrame(docs_of(texts), DOCS)
    results = [{(r["doc_id"], r["island_start"], r["island_stop"]) for r in substring.passages(docs.repartition(n)).collect()} for n in (1, 40)]
    assert results[0] == results[1] == {(i, 10 + i % 7, 80 + i % 7) for i in range(1, 120)}


def test_result_does_not_depend_on_batches_above_the_local_limit(spark):
    """Over FREQUENT copies in each batch, exact and edited ones: all columns of all rows agree."""
    rng = random.Random(23)
    word = lambda: f"l{rng.randrange(10**7)}"
    passage, texts = [word() for _ in range(60)], []
    for i in range(3_000):
        p = list(passage)
        if i % 3 == 0:
            p[rng.randrange(5, 55)] = word()
        texts.append(" ".join([word() for _ in range(8 + i % 5)] + p + [word() for _ in range(10)]))
    docs = spark.createDataFrame(docs_of(texts), DOCS)
    results = [sorted(tuple(r) for r in substring.passages(docs.repartition(n)).collect()) for n in (1, 20)]
    assert results[0] == results[1] and len({r[0] for r in results[0]}) >= 0.99 * 2_999


def plain_extension(a, b):
    """The same alignment over the whole table, without a band or an early end."""
    score = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                score[i, j] = max(score.get((i - 1, j), -99) - 2, score.get((i, j - 1), -99) - 2, score.get((i - 1, j - 1), -99) + (1 if i and j and a[i - 1] == b[j - 1] else -2))
    return max(score.values())


def test_extension_finds_the_best_alignment():
    rng = random.Random(24)
    for _ in range(300):
        a = [rng.randrange(1000) for _ in range(rng.randrange(0, 40))]
        b = list(a)
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(1000)] * rng.randrange(2)
        i, j = substring.extension(np.array(a, dtype=np.int32), np.array(b, dtype=np.int32))
        assert plain_extension(a[:i], b[:j]) == plain_extension(a, b)
    none, long = np.zeros(0, dtype=np.int32), np.arange(50, dtype=np.int32)
    assert substring.extension(none, long) == (0, 0) and substring.extension(long, long) == (50, 50)


@pytest.mark.parametrize(("words", "edits"), [(51, 4), (55, 4), (60, 4), (80, 6)])
def test_recall_of_edited_passages_over_50_words(spark, words, edits):
    rng = random.Random(words + edits)
    word = lambda: f"r{rng.randrange(10**7)}"
    texts = []
    while len(texts) < 400:
        p = [word() for _ in range(words)]
        q = list(p)
        for i in sorted(rng.sample(range(4, words - 4), edits), reverse=True):
            kind = rng.randrange(3)
            q[i : i + (kind != 1)] = [word()] * (kind != 2)  # changed, added or missing
        if len(q) > substring.LEAST_PASSAGE:
            texts += [" ".join([word() for _ in range(60)] + x + [word() for _ in range(60)]) for x in (p, q)]
    found = {r["doc_id"] for r in substring.passages(spark.createDataFrame(docs_of(texts), DOCS).repartition(4)).collect()}
    assert found <= set(range(1, 400, 2)) and len(found) >= 0.95 * 200


def test_repeated_words_are_matched_as_stretches(spark):
    rng = random.Random(13)
    body = lambda n: [f"x{rng.randrange(10**7)}" for _ in range(n)]
    runs = (["of"] * 400, ["of"] * 300, ["th"] * 30, ["th"] * 90, ["a", "b", "c"] * 40, ["a", "b", "c"] * 40)
    texts = [body(60) + r + body(60) for r in runs]
    rows = substring.passages(spark.createDataFrame(docs_of([" ".join(t) for t in texts]), DOCS)).collect()
    assert {(r["doc_id"], r["rep_id"], r["island_start"], r["island_stop"]) for r in rows} == {(1, 0, 60, 360), (5, 4, 60, 180)}


def test_flanks_never_bound_a_reach_too_low():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        b = np.where(rng.random(60) < rng.random(), a, rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        at = np.array([25])
        b[25 : 25 + substring.K] = a[25 : 25 + substring.K]
        same = a == b

        def reached(side):
            score = np.cumsum(np.where(side, 1, -2))
            drop = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > substring.X_DROP)
            score = score[: drop[0]] if len(drop) else score
            return int(score.argmax()) + 1 if score.max(initial=0) > 0 else 0

        reach = reached(same[:25][::-1]) + reached(same[25 + substring.K :])
        assert reach <= substring.reach_bound(substring.flanks(a, at), substring.flanks(b, at))[0]


def test_chains_and_alignment():
    pos = np.array([0, 5, 12, 40, 41, 60])
    end = 60 + substring.K
    assert substring.chains(pos, pos + 100) == [(0, end, 100, 100 + end, 6)]
    shifted = np.where(pos < 30, pos, pos + 3)
    assert [c[:2] for c in substring.chains(pos, shifted)] == [(0, end)]
    crossing = np.array([500, 505, 512, 40, 41, 60])
    assert len(substring.chains(pos, crossing)) == 2
    rng = random.Random(1)
    for _ in range(40):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert substring.common_words(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) == table[-1][-1]


def test_passages_of_odd_rows(odd, empty):
    assert substring.passages(odd).count() == 0
    assert substring.passages(empty).count() == 0
    cut = substring.without_passages(odd)
    assert cut.columns == odd.columns
    assert cut.count() == len(ODD)


def test_pipeline_keeps_clean_documents_and_its_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows, names = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = common.cut_lineage(stage(spark, rows, SMALL))
        assert after.columns == names
        lost = rows.select("doc_id").subtract(after.select("doc_id"))
        if name == "near_dup":
            want, _ = brute_components([r["text"] for r in rows.orderBy("doc_id").collect()])
            ids = [r["doc_id"] for r in rows.orderBy("doc_id").collect()]
            assert {r["doc_id"] for r in lost.collect()} == {d for i, d in enumerate(ids) if want[i] != i}
        if name == "substring":
            assert lost.count() == 0
        rows = after
    assert corpus_pipeline.run(spark, SMALL).columns == [x.split()[0] for x in packing.PACKED.split(", ")]


def test_pipeline_of_odd_and_empty_tables(odd, empty, labels, tmp_path):
    for name, docs, some in (("odd", odd, True), ("empty", empty, False)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = common.cut_lineage(stage(docs.sparkSession, rows, str(tmp_path / name)))
            assert rows.columns == docs.columns
        packed = corpus_pipeline.run(docs.sparkSession, str(tmp_path / name)).collect()
        assert bool(packed) == some
        texts = {r["doc_id"]: r["text"] for r in rows.collect()}
        assert {r["doc_id"] for r in packed} == set(texts)
        assert not some or ({6, 7, 8, None} <= set(texts) and 2 not in texts)


def test_pipeline_matches_its_stages_by_brute_force(spark):
    """Copies, passages and targets of a small table, found again in plain Python after each stage."""
    rng = random.Random(41)
    word = lambda: f"p{rng.randrange(10**6)}"
    body = lambda n: [word() for _ in range(n)]
    passage = body(70)
    texts = [body(rng.randrange(80, 160)) for _ in range(40)]
    texts += [list(texts[3]), texts[4][:-1] + [word()], texts[5] + ["x"]]  # copies
    texts += [body(30) + passage + body(20), body(90) + passage, passage + body(40)]
    rows = [(i, " ".join(t), "en", "abc"[i % 3], 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    kept = corpus_pipeline.near_dup_stage(spark, docs, SMALL)
    want, _ = brute_components([r[1] for r in rows])
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(len(rows)) if want[i] == i}
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_stage(spark, kept, SMALL).collect()}
    seen, joined = set(), " ".join(passage)
    for i in sorted(cut):
        plain = " ".join(texts[i])
        assert cut[i] == (plain.replace(joined, "").strip() if joined in plain and joined in seen else plain) or cut[i].split() == plain.replace(joined, "").split()
        if joined in plain:
            seen.add(joined)
    assert sum(joined in t for t in cut.values()) == 1
    after = spark.createDataFrame([(i, t, "en", "abc"[i % 3], 0) for i, t in cut.items()], DOCS)
    mixed = corpus_pipeline.mixing_stage(spark, after, SMALL).collect()
    sizes = {s: sum(len(t.split()) for i, t in cut.items() if "abc"[i % 3] == s) for s in "abc"}
    total, taken = sum(sizes.values()), {s: sum(len(r["text"].split()) for r in mixed if r["source"] == s) for s in "abc"}
    assert all(n <= 3 * sizes[s] for s, n in taken.items())
    assert abs(sum(taken.values()) - total) < 0.05 * total


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    from helpers import connect, same

    same(queries.queries()[name](spark, SMALL), connect(SMALL), queries.oracle_sql()[name])


def test_registered_names():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert duckdb.__version__
