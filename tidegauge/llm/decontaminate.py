"""Benchmark decontamination: a prefix-filtered join of documents with windows of benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import NON_WORD, BROADCAST_BYTES, cut, free_name, let, lower_ascii, numbers, small_side, words_of

#: A word, as it stands in a text whose capitals are not yet lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window, and of the shingles that a window is found by.
WINDOW, SHINGLE = 13, 2
#: Bytes that a row takes when broadcast: a key, a text's digest, and a window's prefix with its key.
KEY_BYTES, DIGEST_BYTES, PREFIX_BYTES = 16, 64, 64
#: The bitmap that sieves document shingles has at most this many longs.
MOST_LONGS = 1 << 17


def normal_words(text: Column) -> Column:
    return words_of(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORD)


def shingle_keys(words: Column, size: int) -> Column:
    """A hash for each `size` consecutive words, by the place of the first."""
    count = F.greatest(F.size(words) - (size - 1), F.lit(0))
    return F.transform(F.slice(words, F.lit(1), count), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)]))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, wid, words): every distinct window of each item; an item of fewer words, but not none, is one window. wid is a
    hash of the words."""
    words = items.select(F.col(id_col).alias("item"), normal_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    slices = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))), lambda i: F.slice(F.col("w"), i, F.lit(window)))
    distinct = words.select("item", F.explode(slices).alias("words")).distinct()
    return distinct.withColumn("wid", F.xxhash64("words"))


def _sieve(keys: DataFrame, rows: int) -> tuple[list[int], int]:
    """A bitmap of the keys' low bits, about 16 bits a key up to MOST_LONGS, made of one aggregated long for each place."""
    longs = 64
    while longs * 64 < 16 * rows and longs < MOST_LONGS:
        longs *= 2
    place = F.shiftright("key", 6).bitwiseAND(F.lit(longs - 1).cast("long"))
    found = keys.groupBy(place.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).collect()  # at most `longs` rows
    out = [0] * longs
    for r in found:
        out[r["at"]] = r["bits"]
    return out, longs


def _passes(key: Column, bits: Column, longs: int) -> Column:
    one = F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.get(bits, F.shiftright(key, 6).bitwiseAND(F.lit(longs - 1).cast("long")).cast("int")).bitwiseAND(one) != 0


def _occurrences(docs: DataFrame, windows: DataFrame, size: int, limit: int) -> DataFrame:
    """(digest, start, n, wid): where the texts in docs (digest, _x) have windows (wid, words) of at least `size` words.

    Shingles are ordered by how often documents have them, over all documents; a window that occurs has its rarest shingle
    there too, so that one is its necessary prefix. Places of shingles that any window has are written once, counted,
    and joined with the prefixes; a place and an offset give a window's start, and starts before the text are dropped. Texts
    with a start left are read again, each once: their lengths bound the starts from above, the words there must hash to the
    window's number, and what is left is joined with the windows by all their words.
    """
    keyed = cut(windows.withColumn("keys", shingle_keys(F.col("words"), size)), "keyed")
    vocabulary = cut(keyed.select(F.explode("keys").alias("key")).distinct(), "shingles")
    rows = vocabulary.count()
    places = docs.select("digest", F.posexplode(let(normal_words(F.col("_x")), lambda w: shingle_keys(w, size))).alias("at", "key"))
    if rows * KEY_BYTES > limit:  # what the bitmap lets through is shuffled
        bitmap, longs = _sieve(vocabulary, rows)
        places = places.where(_passes(F.col("key"), numbers(bitmap, "bigint"), longs))
    places = cut(places.join(small_side(vocabulary, rows, KEY_BYTES, limit), "key", "left_semi"), "places")
    often = places.groupBy("key").count()
    offsets = keyed.select("wid", F.size("words").alias("n"), F.posexplode("keys").alias("offset", "key")).join(often, "key")
    # with a shingle that no document has, a window occurs nowhere
    rarest = offsets.groupBy("wid", "n").agg(F.min(F.struct("count", "key", "offset")).alias("p"), F.count("*").alias("had"))
    prefixes = cut(rarest.where(F.col("had") == F.col("n") - (size - 1)).select("wid", "n", "p.key", "p.offset"), "prefixes")
    found = places.join(small_side(prefixes, prefixes.count(), PREFIX_BYTES, limit), "key").select("digest", (F.col("at") - F.col("offset")).alias("start"), "n", "wid").where("start >= 0")
    # at most a start for each word of the text and size of window, as numbers
    starts = cut(found.groupBy("digest").agg(F.collect_set(F.struct("start", "n", "wid")).alias("c")), "starts")
    texts = docs.join(small_side(starts.select("digest"), starts.count(), DIGEST_BYTES, limit), "digest", "left_semi").dropDuplicates(["digest"])
    same = lambda w, c: (c["start"] + c["n"] <= F.size(w)) & (F.xxhash64(F.slice(w, c["start"] + 1, c["n"])) == c["wid"])
    shown = lambda w, c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["wid"].alias("wid"), F.slice(w, c["start"] + 1, c["n"]).alias("words"))
    alike = texts.join(starts, "digest").select("digest", F.explode(let(normal_words(F.col("_x")), lambda w: F.transform(F.filter(F.col("c"), lambda c: same(w, c)), lambda c: shown(w, c)))).alias("o"))
    return alike.select("digest", "o.*").join(windows, ["wid", "words"], "left_semi").select("digest", "start", "n", "wid")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    size: int = SHINGLE,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs.

    A word is hit if it lies in an occurrence of a window of an item; a document is contaminated if words are hit and they
    are a twentieth of its words or more. n_items counts items with occurring windows, and items_sha256 is the digest of
    their ids, sorted as strings and comma-joined (of the empty string if there are none). Null texts have no words; items
    without words have no windows, and an item with a null id still makes hits but is not listed. Rows with one id are
    judged each by its own text, and a null id stays null. Empty tables give an empty result, or no hits. Other columns
    are ignored.
    """
    windows = cut(item_windows(items, item_id_col, item_text_col, window), "windows")
    # what a text has depends on the text alone, so a text's digest stands for it and copies count once
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("digest"), F.col(text_col).alias("_x"))
    texts, found = rows.select("digest", "_x").where("_x is not null"), []
    distinct = cut(windows.select("wid", "words").distinct(), "distinct_windows")
    sizes = [k for k in range(1, size) if not distinct.where(F.size("words") == k).isEmpty()]  # windows of fewer words than a shingle
    if not distinct.where(F.size("words") >= size).isEmpty():
        found.append(_occurrences(texts, distinct.where(F.size("words") >= size), size, limit))
    found += [_occurrences(texts, distinct.where(F.size("words") == k), k, limit) for k in sizes]
    counted = rows.select("_id", "digest", F.regexp_count(F.coalesce("_x", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    if found:
        hits = found[0]
        for more in found[1:]:
            hits = hits.unionByName(more)
        hits = cut(hits, "occurrences")
        # words under windows: each adds those beyond the furthest end before it
        order = Window.partitionBy("digest").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
        reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(order), F.lit(0))
        covered = hits.select("digest", "start", "n").distinct().withColumn("new", F.greatest(F.col("start") + F.col("n") - F.greatest(reach, F.col("start")), F.lit(0)))
        n_hit = covered.groupBy("digest").agg(F.sum("new").cast("long").alias("n_hit"))
        who = hits.select("digest", "wid").distinct().join(windows.select("wid", F.col("item").cast("string").alias("item")).where("item is not null").distinct(), "wid")
        per = cut(n_hit.join(who.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("found")), "digest", "left"), "hits")
        weighs = per.agg(F.sum(F.lit(DIGEST_BYTES) + F.octet_length(F.array_join(F.coalesce("found", F.array().cast("array<string>")), ",")) * 2)).first()[0]
        found = counted.join(small_side(per, 1, weighs or 0, limit), "digest", "left")
        n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    else:
        found, n_hit = counted.withColumn("found", F.array().cast("array<string>")), F.lit(0).cast("long")
    listed = F.coalesce(F.col("found"), F.array().cast("array<string>"))
    out = found.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns as they are, that are not contaminated. Contamination depends on the text alone, so
    texts' digests say which rows go; rows without an id, and each of several rows of one id, are judged like others. Null
    texts have no words and stay, repeated rows stay or go together, and empty tables give an empty result, or all of docs."""
    digest = F.sha2(F.col(text_col), 256)
    judged = contamination(docs.select(digest.alias("_digest"), F.col(text_col).alias("_text")), items, "_digest", "_text", **options)
    bad = cut(judged.where("contaminated").select("_digest").distinct(), "contaminated")
    own = free_name("_digest", docs.columns)
    return docs.withColumn(own, digest).join(bad.withColumnRenamed("_digest", own), own, "left_anti").drop(own)


ORACLE = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT r, i, s.n, array_to_string(w[i:i + s.n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n) AS s),
hit AS (SELECT r, i, occ.n, item_id FROM occ JOIN win ON occ.x = win.x AND occ.n = win.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
