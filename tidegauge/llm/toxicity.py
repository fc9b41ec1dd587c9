"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import simhash
from tidegauge.llm.common import cut, lean
from tidegauge.llm.components import connected_components

# Terms that count as toxic without training, and their weight.
SEED_TERMS = ["asshole", "bastard", "bitch", "clown", "dickhead", "disgusting", "dumbass", "fuck", "idiot", "imbecile", "loser", "moron", "pathetic", "retard", "scum", "shit", "stupid", "trash", "worthless"]
SEED_WEIGHT = 4.0
# Phrases in which a term is no insult; the term's match there is dropped.
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "trash bins", "trash bag", "trash bags", "trash collection", "clown fish", "clown nose", "rodeo clown", "circus clown", "pond scum", "soap scum", "sore loser"]
# Look-alike letters and the Latin ones they stand for.
HOMOGLYPHS = str.maketrans(
    "аᴀααвеёεсԁɡһіїıιјкκӏоοօрρԛѕтτυսνѵѡхχуγｚ",
    "aaaabeeecdghiiiijkklooopp" + "qsttuuvvwxxyyz",
)
# Digits and marks that stand for letters in a word that has letters; `!` does so between letters only, as it ends sentences.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

#: Labelled ids up to this many are broadcast; more are shuffled.
BROADCAST_IDS = 1_000_000
#: Bounds of the labelled sample that terms are learned from.
MOST_TOXIC, MOST_CLEAN = 4_000, 16_000
#: A term is a word or a beginning of words of at least this many letters; it counts if toxic texts have it this many times as
#: often, a standard error below the estimate.
LEAST_LETTERS, LONGEST_STEM, LEAST_LIFT = 4, 8, 6.0
#: Words with accents that a worker remembers.
MOST_WORDS = 100_000
#: Terms that a task counts before it hands its counts on.
MOST_COUNTED = 200_000
#: A text's weight is divided by 1 and its words over this many.
LENGTH = 1_000
#: How many terms learning looks for in each toxic text.
DEMAND = 3

_WIDE = dict(zip(range(0xFF01, 0xFF5F), range(0x21, 0x7F), strict=True)) | {0x200B: None, 0x200C: None, 0x200D: None, 0xFEFF: None, 0xAD: None}
_WIDE_CHARS, _ALIKE = frozenset(map(chr, _WIDE)), frozenset(map(chr, HOMOGLYPHS))
_WORD = re.compile(r"[@$]*[^\W_]+(?:[@$!]+[^\W_]+)*[@$]*")
_LETTER = re.compile(r"[^\W\d_]")
_SWAP = re.compile(r"[0134578@$!]")


def fold(text: str) -> str:
    """Lower case, look-alikes and styled or accented letters as Latin letters, and digits and marks in words with letters as
    the letters they stand for, at a word's ends too; words between single spaces, with a space at both ends."""
    if not text.isascii():
        if not _WIDE_CHARS.isdisjoint(text):
            text = text.translate(_WIDE)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower()
        if not _ALIKE.isdisjoint(text):
            text = text.translate(HOMOGLYPHS)
    out = []
    for w in _WORD.findall(text.lower()):
        if not w.isalpha() and _SWAP.search(w):
            w = _SWAP.sub(lambda m: DIGITS[m[0]], w) if _LETTER.search(w) else w.strip("@$")
        out.append(w)
    return f" {' '.join(out)} "


def unaccented(folded: str) -> str:
    """folded with the base letter of each accented one: as many characters, at the same places."""
    if folded.isascii():
        return folded
    return folded.translate({ord(c): b for c in set(folded) if not c.isascii() and (b := unicodedata.normalize("NFD", c)[0]) != c})


def terms_of(folded: str) -> set[str]:
    """The words of a folded text, ` word `, and their beginnings, ` stem`."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= LEAST_LETTERS and w.isalpha():
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(LEAST_LETTERS, min(LONGEST_STEM, len(w)) + 1))
    return out


@dataclass
class Lexicon:
    """Folded terms with weights, exception phrases, and the logistic curve from length-normalised weight to score."""

    terms: dict[str, float] = field(default_factory=lambda: {f" {t}": SEED_WEIGHT for t in SEED_TERMS})
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))
    intercept: float = -3.0
    slope: float = 3.0

    def __post_init__(self):
        self._machine, self._bare = None, {}

    def __getstate__(self):
        return self.__dict__ | {"_machine": None, "_bare": {}}

    def bare(self, word: str) -> float:
        """The weight of the built-in terms that a word with accents begins with once they are off; learned terms keep theirs."""
        if word not in self._bare:
            if len(self._bare) >= MOST_WORDS:
                self._bare.clear()
            plain = unaccented(word)
            self._bare[word] = max((self.terms[f" {t}"] for t in SEED_TERMS if plain.startswith(t) and f" {t}" in self.terms), default=0.0)
        return self._bare[word]

    @property
    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for t, w in self.terms.items():
                self._machine.add_word(t, (len(t), w))
            for p in self.exceptions:
                folded = fold(p)
                if folded.strip():
                    self._machine.add_word(folded, (len(folded), None))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def weight(self, folded: str) -> float:
        """The weights of different words that terms match outside exception phrases, each by its largest term."""
        if not len(self.machine):
            return 0.0
        starts: list[int] = []  # of exception phrases, those that touch made one, and where each ends
        ends: list[int] = []
        best: dict[int, float] = {}
        spans = []
        for end, (n, w) in self.machine.iter(folded):
            start = end - n + 1
            if w is None:
                spans.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), w)
        if not folded.isascii():
            for word in set(folded.split()):
                if not word.isascii() and (w := self.bare(word)):
                    at = folded.find(f" {word} ")
                    while at >= 0:
                        best[at] = max(best.get(at, 0.0), w)
                        at = folded.find(f" {word} ", at + 1)
        for start, end in sorted(spans):
            if ends and start <= ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        words: dict[str, float] = {}
        for start, w in best.items():
            k = bisect_right(starts, start) - 1
            if k < 0 or start >= ends[k]:
                word = folded[start + 1 : folded.index(" ", start + 1)]
                words[word] = max(words.get(word, 0.0), w)
        return sum(words.values())

    def feature(self, text: str | None) -> float:
        """Weight normalised by length: a long text needs in proportion more words."""
        folded = fold(text or "")
        found = self.weight(folded)
        return found / (1.0 + (folded.count(" ") - 1) / LENGTH) if found else 0.0

    def score(self, text: str | None) -> float:
        x = self.intercept + self.slope * self.feature(text)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def choose_terms(toxic: list[set[str]], lift: dict[str, float], least: int) -> list[str]:
    """Terms that cover toxic texts, each picked for the most texts that still want one (the longest of equals), until every
    text has DEMAND terms or no term adds `least` texts. So there are at most DEMAND / least times as many terms as texts."""
    where: dict[str, set[int]] = {}
    for i, terms in enumerate(toxic):
        for t in terms:
            if t in lift:
                where.setdefault(t, set()).add(i)
    want = Counter({i: DEMAND for i in range(len(toxic))})
    chosen: list[str] = []
    while where:
        gain = lambda t: (len(where[t]), len(t), t)  # noqa: E731, B023
        best = max(where, key=gain)
        if len(where[best]) < least:
            break
        chosen.append(best)
        for i in where.pop(best):
            want[i] -= 1
            if want[i] == 0:
                for t in toxic[i]:
                    if t in where:
                        where[t].discard(i)
        stem = best.rstrip()
        for t in [t for t in where if t.startswith(stem) or stem.startswith(t.rstrip()) or not where[t]]:
            del where[t]  # the same words under a longer or shorter stem
    return chosen


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(_id, digest, _y): the labelled rows of docs without copies, each by its id and the MD5 of its text.

    Copies are rows of one label whose op4 fingerprints are equal or linked (at most simhash.BITS bits apart, or through
    others that are); that with the smallest id stays. Copies with different labels stay, one for each label. An id with
    several texts has a row for each, and an id with both labels is toxic. Null ids, labels and texts give no row.
    """
    marks = cut(labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y")), "marks")
    if marks.count() <= broadcast_ids:  # beyond it, a shuffle join
        marks = F.broadcast(marks)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_x")).where("_x is not null").join(marks, "_id")
    keyed = rows.select(F.struct("_id", F.md5(F.col("_x").cast("binary")).alias("digest"), "_y").alias("key"), "_x")
    prints = simhash.fingerprints(keyed, "key", "_x").select("fp", F.col("_id._y").alias("_y"), F.struct("_id._id", "_id.digest").alias("r"))
    equal = cut(prints.groupBy("fp", "_y").agg(F.min("r").alias("r")), "equal")
    roots = connected_components(simhash.fingerprint_links(equal.select("fp").distinct()))
    linked = equal.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("label"), "_y").agg(F.min("r").alias("r"))
    return linked.select("r._id", "r.digest", "_y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Lexicon:
    """A lexicon learned from at most most_toxic and most_clean labelled rows of docs (those of the smallest hashed ids).

    Copies are left out first, by labelled(), so the bounds count texts that differ. Terms' texts are counted in tasks. A term is
    a candidate if at least three toxic texts, and a four-hundredth of them, have it, and if toxic texts have it LEAST_LIFT
    times as often as clean ones by the lower end of the estimate (a standard error of the log below it); that is its weight.
    What reaches the driver is these candidates and, for each toxic row of the sample, which it has. Without toxic rows the
    built-in terms remain. Rows with null ids or labels, or null texts, teach nothing; empty texts have no terms.
    """
    known = cut(labelled(docs, labels, id_col, text_col, label_col), "labelled")
    order = F.xxhash64(F.col("_id"), F.lit(7))
    ids = [known.where(F.col("_y") == y).orderBy(order, "_id", "digest").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    ids = cut(ids[0].union(ids[1]), "sample_ids")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_x")).where("_x is not null").join(F.broadcast(ids.select("_id").distinct()), "_id", "left_semi")  # at most most_toxic + most_clean ids
    rows = rows.withColumn("digest", F.md5(F.col("_x").cast("binary"))).join(F.broadcast(ids), ["_id", "digest"])
    sample = cut(rows.dropDuplicates(["_id", "digest"]).select("_x", "_y"), "sample")  # equal rows, once
    totals = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic:
        return Lexicon()

    def count(batches):
        sums = [Counter(), Counter()]
        out = lambda y: pa.RecordBatch.from_arrays([pa.array(list(sums[y]), pa.string()), pa.array([y] * len(sums[y]), pa.int32()), pa.array(list(sums[y].values()), pa.int64())], ["term", "y", "n"])
        for batch in lean(batches):
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[y].update(terms_of(fold(t.as_py())))
                if len(sums[y]) > MOST_COUNTED:  # what a task holds is bounded; partial counts are added up after it
                    yield out(y)
                    sums[y].clear()
        yield from map(out, (0, 1))

    kind = "term string, y int, n long"
    least = max(3, n_toxic // 400)
    toxic = cut(sample.where("_y = 1").mapInArrow(count, kind).groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("term", "n"), "frequent")
    clean = sample.where("_y = 0").mapInArrow(count, kind).groupBy("term").agg(F.sum("n").alias("c")).join(toxic.select("term"), "term", "left_semi")
    n, c = F.col("n") + 0.5, F.coalesce("c", F.lit(0)) + 0.5
    lift = F.exp(F.log(n / (n_toxic + 1) / (c / (n_clean + 1))) - F.sqrt(1 / n + 1 / c))
    candidates = {r["term"]: r["lift"] for r in toxic.join(clean, "term", "left").select("term", lift.alias("lift")).where(F.col("lift") >= LEAST_LIFT).collect()}
    names = set(candidates)

    def narrow(batches):
        for batch in lean(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(terms_of(fold(t)) & names) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["terms"])

    texts = [set(r["terms"]) for r in sample.where("_y = 1").select("_x").mapInArrow(narrow, "terms array<string>").collect()]  # at most most_toxic rows
    chosen = choose_terms(texts, candidates, least)
    terms = {f" {t}": SEED_WEIGHT for t in SEED_TERMS} | {t: min(8.0, math.log(candidates[t])) for t in chosen}
    lexicon = Lexicon(terms)

    def feature(batches):
        for batch in lean(batches):
            yield pa.RecordBatch.from_arrays([pa.array([round(lexicon.feature(t), 2) for t in batch.column(0).to_pylist()]), batch.column(1)], ["x", "y"])

    points = sorted(sample.mapInArrow(feature, "x double, y int").groupBy("x", "y").count().collect())  # features are rounded: a bounded table of points
    x, y, n = (np.array([r[k] for r in points], float) for k in ("x", "y", "count"))
    lexicon.intercept, lexicon.slope = logistic(x, y, n)
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic regression with a ridge on the slope, by Newton's steps. Slopes stay positive."""
    a, b = 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(n * (y - p)).sum(), (n * (y - p) * x).sum() - ridge * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(1e-9, np.abs(d).max()))
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-6:
            break
    return (float(a), float(b)) if b > 0 else (-3.0, 3.0)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted (score >= 0.5) of every row, in one pass without a shuffle.

    Null and empty texts have no match and so the score of the curve's foot. Repeated rows stay; a null id stays null; an
    empty table gives an empty result; other columns are ignored. The lexicon, whose size the bounds of the training sample limit
    (see choose_terms), goes to the workers with the function.
    """

    def run(batches):
        for batch in lean(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["_id", "score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x"))
    out = rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, score double")
    return out.select(F.col("_id").alias(id_col), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, with a score below `most`; a tie goes.

    Null and empty texts stay, unless the curve's foot itself reaches `most`. Ids are not looked at, so null and repeated ones
    are like others and repeated rows stay repeated; an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in lean(batches):
            yield batch.filter(pa.array([lexicon.score(t.as_py()) < most for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
