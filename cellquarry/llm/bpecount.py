"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbols. In each round every sequence's
lowest-rank pair is merged, at all its places at once; the symbols that survive are counted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from cellquarry.llm.common import id_text, pieces_of, texts_of

NONE = np.iinfo(np.int32).max
#: More than any text's tokens; stands for chunks that part otherwise beside others.
ODD = 1 << 48
#: The parts of the byte-level vocabulary's pre-token pattern.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


def pattern(letter: str, number: str, blank: str, other: str) -> str:
    """The pre-token pattern over given classes of characters."""
    return rf"{ENDINGS}| ?{letter}+| ?{number}+| ?{other}+|{blank}+(?={blank}|\Z)|{blank}+"


@lru_cache(4)
def split_patterns(path: str) -> tuple[str, str, str]:
    """Patterns that part texts as the library does, whatever Unicode version either knows: (usual, characters the usual one mistakes, for texts that have some).

    The library parts a string of all characters; the runs it makes, each tested beside a letter and a digit, give its
    classes. Characters that the ``regex`` package puts into other classes are few; only texts with them take the exact pattern.
    """
    pre_tokenize = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    own = np.zeros(0x110000, np.uint8)  # 1 letter, 2 number, 3 blank, 0 other
    for _, (a, b) in pre_tokenize(every):
        first = every[a] if every[a] != " " or b - a == 1 else every[a + 1]
        kind = next((k for k, probe in ((1, "a"), (2, "1"), (0, "!")) if len(pre_tokenize(probe + first)) == 1), 3)
        own[ord(every[a]) : ord(every[b - 1]) + 1] = kind
    own[0x20] = 3
    known = np.zeros(0x110000, np.uint8)
    for kind, p in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(p, every):
            known[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    own[0xD800:0xE000] = known[0xD800:0xE000] = 0
    blank = "".join(f"\\U{c:08x}" for c in np.flatnonzero(own == 3).tolist())
    odd = own != known

    def ranges(which: np.ndarray) -> str:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], which, [False]]).astype(np.int8))).reshape(-1, 2)
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.tolist())

    usual = pattern(r"\p{L}", r"\p{N}", f"[{blank}]", rf"[^{blank}\p{{L}}\p{{N}}]")
    strange = odd & (np.minimum(own, known) + np.maximum(own, known) % 3 > 0)  # blank or other: both are spelled out
    if not strange.any():
        return usual, "(?!)", usual
    s, letters, numbers = ranges(strange), ranges(strange & (own == 1)), ranges(strange & (own == 2))
    letter = rf"(?:[{letters}]|(?![{s}])\p{{L}})" if letters else rf"(?:(?![{s}])\p{{L}})"
    number = rf"(?:[{numbers}]|(?![{s}])\p{{N}})" if numbers else rf"(?:(?![{s}])\p{{N}})"
    rest = ranges(strange & (own == 0))
    other = rf"(?:[^{blank}\p{{L}}\p{{N}}]|[{rest}])" if rest else rf"[^{blank}\p{{L}}\p{{N}}]"
    return usual, f"[{s}]", pattern(letter, number, f"[{blank}]", other)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 upward."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def is_latin(text: str) -> bool:
    """Whether all characters are of Latin-1."""
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


class Merger:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str, patterns: tuple[str, str, str]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.byte_ids = np.array([vocab.get(c, 0) for c in byte_letters()], np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        usual, strange, exact = map(regex.compile, patterns)
        safe = not strange.search("".join(map(chr, range(0x100))))  # then texts of Latin-1 need no search
        self.split = lambda t: (usual if (safe and is_latin(t)) or not strange.search(t) else exact).findall(t)
        special = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.known: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE).astype(np.int32)

    def merged_sizes(self, words: list[bytes]) -> np.ndarray:
        """How many symbols are left of each word (no word is empty)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out, who = size.copy(), np.arange(len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(len(ids), NONE, np.int32)
        if len(ids) > 1:
            rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = NONE
        while len(who):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            live = least != NONE
            if not live.all():
                out[who[~live]] = size[~live]
                keep = np.repeat(live, size)
                ids, rank, who, size, least = ids[keep], rank[keep], who[live], size[live], least[live]
                if not len(who):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            run = np.concatenate([[True], np.diff(at) != 1])  # in a run like aaa every second place counts
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            ids[at] = self.made[rank[at]]
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            last = np.cumsum(size) - 1
            owner = np.searchsorted(last, at)
            ends = (at + 1) == last[owner]
            size = size - np.bincount(owner, minlength=len(size))
            at = at - np.arange(len(at))  # places after removal
            ids, rank = ids[~gone], rank[~gone]
            rank[at[ends]] = NONE
            inner = at[~ends]
            rank[inner] = self.rank(ids[inner], ids[inner + 1])
            before = at[at > 0] - 1
            starts = np.zeros(len(ids), bool)
            starts[np.cumsum(size) - size] = True
            before = before[~starts[before + 1]]
            rank[before] = self.rank(ids[before], ids[before + 1])
        return out

    def sizes(self, runs: list[list[str]]) -> list[int]:
        """Tokens of lists of pre-tokens."""
        known = self.known
        new = list(set().union(*runs) - known.keys())
        for i in range(0, len(new), 100_000):
            some = new[i : i + 100_000]
            known.update(zip(some, self.merged_sizes([w.encode() for w in some]).tolist(), strict=True))
        get = known.__getitem__
        return [sum(map(get, r)) for r in runs]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the strings of added tokens count as one each.

        A pre-token holds a blank only as its first character or among white space, so texts are parted before each blank and
        the chunks remembered. Chunks that begin with more white space are odd: a text with one is parted as a whole.
        """
        split, chunks = self.split, self.chunks
        if len(self.known) > 1_000_000:
            self.known.clear()
        if len(chunks) > 500_000:
            chunks.clear()
        out, parts = [], []
        for i, t in enumerate(texts):
            found = self.special.findall(t) if self.special else []
            out.append(len(found))
            parts += [(i, s, *s.split(" ")) for s in (self.special.split(t) if found else [t])]
        new = list(set().union(*(p[3:] for p in parts)) - chunks.keys())
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            own = [split(" " + c) for c in some]
            chunks.update((c, n if len(r[0]) > 1 else ODD) for c, r, n in zip(some, own, self.sizes(own), strict=True))
        get = chunks.__getitem__
        more = [sum(map(get, p[3:])) for p in parts]
        firsts = self.sizes([split(p[2] if n < ODD else p[1]) for p, n in zip(parts, more, strict=True)])  # the chunk before the first blank, or all
        for p, n, first in zip(parts, more, firsts, strict=True):
            out[p[0]] += first + (n if n < ODD else 0)
        return out


@lru_cache(2)
def merger(path: str, patterns: tuple[str, str, str]) -> Merger:
    return Merger(path, patterns)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row, over whole texts.

    A null text counts as empty (0 bytes, 0 tokens); null ids stay null; repeated rows give repeated
    results; an empty table gives none. ``tokenizer_path`` is a byte-level BPE file that every
    executor can open.
    """

    patterns = split_patterns(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(tokenizer_path, patterns)
        for batch in batches:
            for part in pieces_of(batch):
                texts = texts_of(part)
                tokens = m.counts(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
