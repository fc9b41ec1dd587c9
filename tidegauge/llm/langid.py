"""Language ID: each document as a mixture of languages, fitted to its letter n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import lean

#: Letter trigrams fall into this many buckets.
BUCKETS = 1 << 15
#: Characters worked on at once; a longer text is one slice of its own.
SLICE = 1 << 20
#: The log-likelihood that a further language must win, for each log of a document's n-grams.
PENALTY = 6.0
ROUNDS = 30
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each of the first 65,536 code points, itself in lower case if a letter, else 0."""
    out = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_TABLE: list[np.ndarray] = []


def trigrams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text's place) of each trigram of letters and word edges; what is no letter is an edge, and runs of edges count as one."""
    if not _TABLE:
        _TABLE.append(_letters())
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", "<u4")
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    letter = _TABLE[0][np.minimum(code, 0xFFFF)]
    far = np.flatnonzero(code > 0xFFFF)
    if len(far):
        letter = letter.copy()
        letter[far] = [c if chr(c).isalpha() else 0 for c in code[far]]
    stay = np.concatenate([[letter[0] > 0], (letter[1:] > 0) | (letter[:-1] > 0)])
    letter, owner = letter[stay], owner[stay]
    if len(letter) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[np.uint32(0)], letter[:-1]])
    before2 = np.concatenate([np.zeros(2, np.uint32), letter[:-2]])
    before2[before == 0] = 0
    mixed = (before2 * np.uint32(0x9E3779B1)) ^ (before * np.uint32(0x85EBCA77)) ^ (letter * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    real = (letter > 0) | (before > 0)
    return ((mixed >> np.uint32(7)) & np.uint32(buckets - 1)).astype(np.int64)[real], owner[real]


def _slices(texts: list[str]):
    run, total = [], 0
    for i, t in enumerate(texts):
        if run and total + len(t) > SLICE:
            yield run
            run, total = [], 0
        run.append(i)
        total += len(t)
    if run:
        yield run


@dataclass
class Model:
    """languages, and the log-likelihood of each bucket under each (languages x buckets)."""

    languages: list[str]
    logs: np.ndarray

    def mixture(self, buckets: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """(places of languages, their shares) of one document's trigrams, largest share first.

        Languages are added one by one while expectation-maximisation of the shares wins more than the penalty. The
        log-likelihood is concave in the shares, so n * (the largest mean ratio - 1) bounds what any further language can
        win, and most documents need no rounds.
        """
        seen, counts = np.unique(buckets, return_counts=True)
        logs = self.logs[:, seen]
        n, cost = len(buckets), penalty * np.log(len(buckets) + 1)
        single = logs @ counts
        chosen, shares = [int(single.argmax())], np.ones(1)
        value = float(single.max())
        likely = np.exp(logs - logs.max(0))
        value -= float(counts @ logs.max(0))
        while len(chosen) < len(self.languages):
            mixed = shares @ likely[chosen]
            ratio = (likely * (counts / mixed)).sum(1)
            ratio[chosen] = 0
            add = int(ratio.argmax())
            if ratio[add] - n <= cost:
                break
            trial, p = [*chosen, add], np.append(shares * 0.8, 0.2)
            for _ in range(rounds):
                parts = p[:, None] * likely[trial]
                new = (parts / parts.sum(0)) @ counts / n
                done = np.abs(new - p).max() < 1e-4
                p = new
                if done:
                    break
            gained = float(counts @ np.log(p @ likely[trial]))
            if gained - value <= cost:
                break
            chosen, shares, value = trial, p, gained
        order = np.argsort(-shares, kind="stable")
        return np.array(chosen)[order], shares[order]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        """(language, score, set) of each text: that with the largest share, its share times its posterior against other single
        languages, and all languages of the set with shares, as name:share. Texts without a letter are unknown, at score 0."""
        out: list[tuple[str, float, str]] = [(UNKNOWN, 0.0, "")] * len(texts)
        if not self.languages:
            return out
        whole = [t or "" for t in texts]
        table = np.ascontiguousarray(self.logs.T)
        for run in _slices(whole):
            found, owner = trigrams([whole[i] for i in run], len(table))
            cuts = np.searchsorted(owner, np.arange(len(run) + 1))
            for k, i in enumerate(run):
                own = found[cuts[k] : cuts[k + 1]]
                if not len(own):
                    continue
                chosen, shares = self.mixture(own)
                total = table[own].sum(0)
                posterior = 1 / np.exp(np.minimum(total - total[chosen[0]], 50)).sum()
                score = float(shares[0] * (posterior if len(chosen) == 1 else 1.0))
                out[i] = (self.languages[chosen[0]], min(1.0, max(0.0, score)), ",".join(f"{self.languages[c]}:{s:.3f}" for c, s in zip(chosen, shares, strict=True)))
        return out


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS) -> Model:
    """A model of every non-null language of docs, from all trigrams of all its texts.

    Tasks count by language and bucket; those partial counts are added up, so a shuffle has at most languages x buckets rows
    a task. Smoothed shares: (count + 0.5) over the language's total. What reaches the driver is languages x buckets numbers.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in lean(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for run in _slices(texts):
                found, owner = trigrams([texts[i] for i in run], buckets)
                names = sorted({langs[i] for i in run})
                place = np.array([names.index(langs[i]) for i in run])
                both = np.bincount(place[owner] * buckets + found, minlength=len(names) * buckets).reshape(len(names), buckets)
                for name, row in zip(names, both, strict=True):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "b", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("_l"), F.col(text_col).alias("_x")).where("_l is not null and _x is not null")
    total = rows.mapInArrow(count, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(total["lang"].to_pylist()))
    counts = np.zeros((len(languages), buckets))
    place = {x: i for i, x in enumerate(languages)}
    if languages:
        counts[[place[x] for x in total["lang"].to_pylist()], total["b"].to_numpy()] = total["n"].to_numpy()
    shares = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * buckets)
    return Model(languages, np.log(shares).astype(np.float32))


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether an id's part is kept from training; a null id's is unknown (null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and lang_mix (name:share of the selected set) of every row, in one pass without a shuffle.

    Null texts and texts without a letter are `und` at score 0 with an empty mix, as are all texts under a model without
    languages. Repeated rows stay; a null id stays null; an empty table gives an empty result; other columns are ignored.
    The model goes to the workers with the function: languages x buckets numbers.
    """

    def run(batches):
        for batch in lean(batches):
            found = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string())))], ["_id", "lang_pred", "score", "lang_mix"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, lang_pred string, score double, lang_mix string").withColumnRenamed("_id", id_col)


def keep_languages(docs: DataFrame, model: Model, languages: list[str] | None = None, least_score: float = 0.25, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is known, wanted (any by default) and scored least_score or more.

    Null and empty texts, and texts without a letter, have no language and go; a tie with least_score stays. Ids are not looked
    at, repeated rows stay or go together, and an empty table gives an empty result; a model without languages keeps no row.
    """
    wanted, at = set(languages if languages is not None else model.languages), docs.columns.index(text_col)

    def run(batches):
        for batch in lean(batches):
            found = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang in wanted and score >= least_score for lang, score, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
