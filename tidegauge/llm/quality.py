"""Quality rules: counted rules, then a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import SPACES, cut, let, numbers, words_of

#: n-grams fall into this many buckets; both multinomials have one weight for each.
BUCKETS = 16_384
#: A document is kept if its mean log-likelihood ratio for each n-gram is at least this.
THRESHOLD = -0.3
#: Runs of letters and digits, and runs of other marks, are the tokens of n-grams.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
#: A sort key has 40 bits of a window's hash above 24 bits of its place.
PLACE_BITS = 24


def _covered(places):
    """Words in 3-word windows that start at these ascending places; each covers itself and the next two words."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("end")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p + 3 - a["end"])).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )


def _recurring(words, places):
    """Of some windows' places, those whose words occur at another one: sorted by words, equal neighbours recur."""
    at = lambda p, k: F.get(words, p.cast("int") + k)
    rows = F.sort_array(F.transform(places, lambda p: F.struct(at(p, 0).alias("a"), at(p, 1).alias("b"), at(p, 2).alias("c"), p.alias("p"))))
    same = lambda s, x, j: F.coalesce((F.get(s, j)["a"] == x["a"]) & (F.get(s, j)["b"] == x["b"]) & (F.get(s, j)["c"] == x["c"]), F.lit(False))
    return let(rows, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["p"])))


def _repeated(words, few: int = 8, places_limit: int = 1 << PLACE_BITS):
    """Words that lie in 3-word windows found twice or more. Windows are sorted; only neighbours are compared.

    Windows whose hashes are all distinct recur nowhere. A few recurring hashes are looked up at each place; with many,
    keys of hash bits above the place are sorted as primitive longs. Either way the windows found are then compared by
    their words, so a collision of hashes changes nothing.
    """
    n = F.greatest(F.size(words) - 2, F.lit(0))
    high = F.lit(~(places_limit - 1)).cast("long")
    mask = F.lit(places_limit - 1).cast("long")

    def packed(h):
        near = lambda s, x, j: F.coalesce(F.get(s, j).bitwiseXOR(x).bitwiseAND(high) == 0, F.lit(False))
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))
        return let(keys, lambda s: F.transform(F.filter(s, lambda x, i: near(s, x, i - 1) | near(s, x, i + 1)), lambda x: x.bitwiseAND(mask)))

    def places(h, twice):
        every = F.sequence(F.lit(0).cast("long"), (F.size(h) - 1).cast("long"))
        looked_up = F.filter(every, lambda p: F.array_contains(twice, F.get(h, p.cast("int"))))
        return F.when(F.size(twice) <= few, looked_up).when(F.size(h) < places_limit, packed(h)).otherwise(every)

    def count(h):
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
        found = lambda t: let(let(places(h, t), lambda p: _recurring(words, p)), _covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(twice, found))

    hashes = F.transform(F.slice(words, F.lit(1), n), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(let(hashes, count))


def base_rules(text, few: int = 8, places_limit: int = 1 << PLACE_BITS):
    """One struct of the counts of a text; a null text has no words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    return let(
        words_of(whole, SPACES),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated(w, few, places_limit).alias("n_repeat_words"),
        ),
    )


def buckets(text, n: int = BUCKETS):
    """The bucket of every unigram and bigram of a text's tokens, repeats included. n is a power of two."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    mask = F.lit(n - 1).cast("long")
    return let(
        tokens,
        lambda t: F.concat(
            F.transform(t, lambda x: F.xxhash64(x).bitwiseAND(mask).cast("int")),
            F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(t, i), x).bitwiseAND(mask).cast("int")),
        ),
    )


def ratio_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = BUCKETS, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One row for each bucket: the log of its smoothed share in trusted documents over its share in all documents.

    trusted has the ids of the trusted target. Both multinomials count every n-gram of every document of their side; with
    add-one smoothing a bucket that neither has seen weighs the log of the totals' ratio. Without trusted documents all
    weights are nearly zero.
    """
    marks = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_t", F.lit(1).cast("long"))
    if marks.count() <= broadcast_ids:  # beyond it, a shuffle join
        marks = F.broadcast(marks)
    ids = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x")).join(marks, "_id", "left")
    grams = ids.select(F.coalesce("_t", F.lit(0).cast("long")).alias("t"), F.explode(buckets(F.col("_x"), n)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    every = cut(every, "llr_counts")
    totals = every.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    share = lambda c, total: (F.col(c) + 1.0) / F.lit(float(total + n))
    if not totals["target"]:
        return every.select("b", F.lit(0.0).alias("w"))
    return every.select("b", F.log(share("target", totals["target"]) / share("raw", totals["raw"])).alias("w"))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    n: int = BUCKETS,
    few: int = 8,
    places_limit: int = 1 << PLACE_BITS,
) -> DataFrame:
    """Counts, base_failed, the length-normalised ratio (llr) and the verdict kept for every row of docs.

    A null or empty text has zero counts, fails the base rules and has llr 0. Rows with equal ids are judged each by its own
    text; a null id is never trusted. A tie with the threshold is kept. An empty table gives an empty result. Columns other
    than the two named are ignored.

    The weights are one array of n doubles, which the driver reads and puts into the plan, so their size is bounded by n
    whatever the corpus has; scoring reads each text once, without a shuffle.
    """
    spark = docs.sparkSession
    weights = ratio_weights(docs, trusted, id_col, text_col, n)
    row = weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))), lambda x: x["w"]).alias("w"))
    vector = [float(x) for x in row.first()["w"]]  # n doubles, a parameter
    literal = numbers(vector, "double")
    scored = docs.select(
        F.col(id_col).alias(id_col),
        base_rules(F.col(text_col), few, places_limit).alias("_r"),
        let(
            buckets(F.col(text_col), n),
            lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(literal, b)) / F.size(g)),
        ).alias("llr"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(id_col, "_r.*", "llr").select("*", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"))
