"""Tokenizing texts chunk by chunk, at boundaries that no token crosses, with a bounded memory of chunks seen."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

#: At most this many chunks are remembered by a worker; later ones are encoded each time.
MOST_CHUNKS = 200_000
#: Longer chunks are not remembered.
LONGEST_CHUNK = 48

#: White space beyond ASCII, and the separators that Python but not the tokenizers' patterns hold to be white space.
EXOTIC = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
SPACED_CHUNK = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
SPACED_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")
ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


#: Beyond these characters, pieces are left to the library: tables of letters and normal forms may differ there.
FAR = re.compile("[^\x00-\u024f]")


def place(name: str) -> str:
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)


class Library:
    """A tokenizer's file: the library's own encoder, and its merges for single pieces of near characters.

    The merges run in tiktoken, where a pair's rank is the id of what it makes; that holds as ids follow the order of merges
    (checked here). A word's end is the byte FF, which no UTF-8 text has.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores are shared out by Spark
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(place(name))
        with open(place(name), encoding="utf-8") as f:
            made = json.load(f)
        model, before = made["model"], made["pre_tokenizer"]
        vocab, merges, suffix = model["vocab"], model["merges"], model.get("end_of_word_suffix") or ""
        self.bare = before["type"] == "Sequence"
        if self.bare:
            pattern = before["pretokenizers"][0]["pattern"]["Regex"]
        elif before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and made["normalizer"] is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        else:
            raise ValueError(f"{name}: no byte-level tokenizer of a known form")
        joined = ["".join(x if isinstance(x, list) else x.split(" ")) for x in merges]
        if [vocab[x] for x in joined] != list(range(vocab[joined[0]], vocab[joined[0]] + len(joined))):
            raise ValueError(f"{name}: ids do not follow the merges")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.end = b"\xff" if suffix else b""
        special = {x["content"] for x in made["added_tokens"]}
        raw = lambda t: bytes(letters[c] for c in (t.removesuffix(suffix) if suffix else t)) + (self.end if suffix and t.endswith(suffix) else b"")
        ranks = {raw(t): i for t, i in vocab.items() if t not in special}
        self.single = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(pattern).findall

    def near(self, chunk: str) -> bool:
        return "<|" not in chunk and not FAR.search(chunk)

    def pieces(self, chunk: str) -> list[str]:
        if self.bare:
            chunk = chunk.lower()
        return [chunk] if chunk.isalpha() else self.split(chunk)

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk; those with far characters or special strings in one batch of the library's."""
        single, end = self.single, self.end
        out = [[i for p in self.pieces(c) for i in single(p.encode() + end)] if self.near(c) else None for c in chunks]
        far = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(far, self.tokenizer.encode_batch_fast([chunks[i] for i in far], add_special_tokens=False) if far else [], strict=True):
            out[i] = e.ids
        return out


def spaced_chunks(text: str) -> list[str]:
    """Chunks for byte-level patterns, which keep white space: a cut stands before ASCII white space that follows something else.

    Such a pattern never looks back, and a piece without white space ends where white space begins, so each chunk has the
    tokens that it has inside the text.
    """
    return SPACED_CUT.split(text) if EXOTIC.search(text) else SPACED_CHUNK.findall(text)


def bare_chunks(text: str) -> list[str]:
    """Chunks for patterns that drop white space: what lies between it."""
    return [x for x in ASCII_SPACE.split(text) if x] if EXOTIC.search(text) else text.split()


def by_bytes(items: Iterable, most: int, size=len) -> Iterator[list]:
    """Runs of items of about most bytes; an item is never cut, and one that is larger makes a run of its own."""
    run, total = [], 0
    for x in items:
        n = size(x)
        if run and total + n > most:
            yield run
            run, total = [], 0
        run.append(x)
        total += n
    if run:
        yield run


class Lengths:
    """The number of tokens of texts under a byte-level tokenizer that keeps white space."""

    def __init__(self, name: str):
        self.library, self.known = Library(name), {}
        if self.library.bare:
            raise ValueError(f"{name} drops white space")

    def count(self, texts: list[str]) -> list[int]:
        cut = [spaced_chunks(t) for t in texts]
        missing = list(set().union(*cut) - self.known.keys())
        fresh = dict(zip(missing, map(len, self.library.ids(missing)), strict=True))
        room = MOST_CHUNKS - len(self.known)
        self.known.update([(c, n) for c, n in fresh.items() if len(c) <= LONGEST_CHUNK][: max(0, room)])
        known = self.known
        if len(fresh) < room and all(len(c) <= LONGEST_CHUNK for c in fresh):
            return [sum(map(known.__getitem__, c)) for c in cut]
        return [sum([known[x] if x in known else fresh[x] for x in c]) for c in cut]


class _Places(dict):
    """A number for each chunk, in the order in which they are first asked for."""

    def __missing__(self, chunk: str) -> int:
        k = self[chunk] = len(self)
        return k


class Ids:
    """The ids of texts under a tokenizer that drops white space, lower-cases and marks word ends."""

    def __init__(self, name: str):
        self.library, self.known = Library(name), _Places()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, first: int, rows: list[list[int]], where: np.ndarray) -> None:
        """Note the ids of the chunks numbered first + where."""
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + int(where.max(initial=-1)) >= len(self.at):
            self.at, self.n = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.n, np.zeros_like(self.n)])
        self.flat[self.used : self.used + total] = np.fromiter((x for r in rows for x in r), np.uint32, total)
        self.at[first + where] = self.used + np.cumsum(lengths) - lengths
        self.n[first + where] = lengths
        self.used += total

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Chunks are looked up once for each time they occur; those that are new are encoded together.
        What is not remembered is held for this call only."""
        known, places = self.known, []
        top = len(known)
        for t in texts:
            chunks = bare_chunks(t)
            places.append(np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks)))
        fresh = list(islice(reversed(known), len(known) - top))[::-1]
        room = max(0, MOST_CHUNKS - top)
        short = [k for k, c in enumerate(fresh) if len(c) <= LONGEST_CHUNK]
        keep = np.array(short[:room], np.int64)
        rest = np.setdiff1d(np.arange(len(fresh)), keep)
        # kept ones first, so that the ids of others can be dropped from the end
        order = np.concatenate([keep, rest])
        if len(fresh):
            rows = self.library.ids([fresh[k] for k in order.tolist()])
            self._add(top, rows[: len(keep)] or [], keep)
            mark = self.used
            self._add(top, rows[len(keep) :], rest)
        for where in places:
            n = self.n[where]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            yield self.flat[np.repeat(self.at[where] - ends + n, n) + np.arange(total)]
        if len(rest):
            self.used = mark
            for c in fresh:
                del known[c]
            self.at[top : top + len(keep)], self.n[top : top + len(keep)] = self.at[top + keep], self.n[top + keep]
            known.update((fresh[k], top + i) for i, k in enumerate(keep.tolist()))


_MADE: dict = {}


def worker(kind: type, name: str):
    """One of a kind for each vocabulary and Python worker."""
    if (kind, name) not in _MADE:
        _MADE[kind, name] = kind(name)
    return _MADE[kind, name]
