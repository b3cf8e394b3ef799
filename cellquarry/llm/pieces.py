"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; decoding.

No piece reaches over the start of a word (a run of the blank mark), so the lattice of a text is a
chain of the lattices of its words: each distinct word of a batch is filtered forward once, and all
its occurrences are sampled backward together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from cellquarry.llm.common import id_text, pieces_of
from cellquarry.llm.textkit import mix

U64 = np.uint64
MARK = 0x2581  # stands for a blank in pieces
OTHER_MARK = 0x110000  # stands for that character itself in a text
LONGEST_PART = 1 << 19
SLOT_BITS = 20


class Lattice:
    def __init__(self, path: str, alpha: float):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.byte_id = n, np.zeros(256, np.int32)
        prefix: dict[str, int] = {}
        worth = np.full(n, -np.inf)
        raw = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                if chr(MARK) in piece.lstrip(chr(MARK)):
                    raise ValueError(f"piece {i} reaches over the start of a word")
                raw.append(piece.replace(chr(MARK), " ").encode())
                worth[i] = -alpha * np.log(2 + min(-sp.get_score(i), n))  # scores are ranks: weights by Zipf's law
                for k in range(1, len(piece)):
                    prefix.setdefault(piece[:k], -1)
                prefix[piece] = i
        self.worth = np.append(worth, -alpha * 2 * np.log(2 + n))  # the last: a character spelt in bytes
        self.longest = max(map(len, prefix))
        keys = np.array([self.hash(np.array([ord(c) for c in p], np.int64)) for p in prefix], U64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.fromiter(prefix.values(), np.int32, len(prefix))[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("pieces collide")
        slot = (mix(self.keys) >> U64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << SLOT_BITS, 0, np.int32)
        self.slots[slot] = np.arange(len(slot))
        many = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        self.slots[many] = -1
        self.raw_size = np.fromiter(map(len, raw), np.int64, n)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    MULTIPLIER = 0x9E3779B97F4A7C15

    def hash(self, points: np.ndarray) -> np.uint64:
        h = 0
        for p in points.tolist():
            h = (h * self.MULTIPLIER + p + 1) & (2**64 - 1)
        return U64(h)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands among the keys, or -1."""
        i = self.slots[(mix(h) >> U64(64 - SLOT_BITS)).astype(np.int64)]
        out = np.where(self.keys[i] == h, i, -1)
        shared = np.flatnonzero(i < 0)  # slots of several keys
        if len(shared):
            at = np.minimum(np.searchsorted(self.keys, h[shared]), len(self.keys) - 1)
            out[shared] = np.where(self.keys[at] == h[shared], at, -1)
        return out

    def edges(self, points: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of all pieces in the words; ``end``: where the word of each place ends. Piece = size: spelt in bytes."""
        at, h = np.arange(len(points)), np.zeros(len(points), U64)
        out, spelt = [], np.ones(len(points), bool)
        for k in range(self.longest):
            inside = at + k < end[at]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * U64(self.MULTIPLIER) + (points[at + k] + 1).astype(U64)
            i = self.find(h)
            hit = i >= 0
            at, h, piece = at[hit], h[hit], self.ids[i[hit]]
            real = piece >= 0
            out.append((at[real], at[real] + k + 1, piece[real]))
            if not k:
                spelt[at[real]] = False
        bare = np.flatnonzero(spelt)
        out.append((bare, bare + 1, np.full(len(bare), self.size, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def sample(self, points: np.ndarray, size: np.ndarray, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled segmentations: words' code points end to end with their sizes; occurrences by word and random key.

        Returns the number of pieces of each occurrence, all pieces in order, and the place in ``points`` where each begins.
        """
        ends = np.cumsum(size)
        starts = ends - size
        owner = np.repeat(np.arange(len(size)), size)
        frm, to, piece = self.edges(points, ends[owner])
        # a state is a place in a word, its start included: one more than its characters
        own = owner[frm]
        a, b = frm + own, to + own
        level = to - starts[own]
        order = np.argsort((level << 33) | (b << 5) | (to - frm))  # by level, state and length of piece
        a, b, piece, level, frm = a[order], b[order], piece[order], level[order], frm[order]
        weight, total = self.worth[piece], np.zeros(len(points) + len(size))
        begin = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        cut = np.searchsorted(level, np.arange(1, int(size.max()) + 2))
        heads = np.searchsorted(begin, cut)
        for i in range(len(cut) - 1):  # forward, all words at once
            x, y = cut[i], cut[i + 1]
            if x == y:
                continue
            weight[x:y] += total[a[x:y]]
            first = begin[heads[i] : heads[i + 1]]
            total[b[first]] = np.logaddexp.reduceat(weight[x:y], first - x)
        p = np.exp(weight - total[b])
        upto = np.cumsum(p)
        group = np.cumsum(np.concatenate([[True], b[1:] != b[:-1]])) - 1
        upto -= (upto - p)[begin][group]
        upto[np.concatenate([begin[1:], [len(b)]]) - 1] = 2.0
        enter = np.zeros(len(total), np.int64)
        enter[b[begin]] = begin
        state, stop = (ends + np.arange(len(size)))[word], (starts + np.arange(len(size)))[word]
        live, steps = np.arange(len(word)), []
        count = np.zeros(len(word), np.int64)
        turn = 0
        while len(live):  # backward, all occurrences at once
            u = (mix(key[live] + U64((turn * 0x9E3779B97F4A7C15) & (2**64 - 1))) >> U64(11)).astype(np.float64) * 2.0**-53
            e = enter[state]
            wait = np.flatnonzero(upto[e] <= u)
            while len(wait):
                e[wait] += 1
                wait = wait[upto[e[wait]] <= u[wait]]
            steps.append((live, e))
            count[live] += 1
            state = a[e]
            go = state != stop[live]
            live, state = live[go], state[go]
            turn += 1
        last = np.cumsum(count)
        out, place = np.zeros(int(last[-1]) if len(last) else 0, np.int32), np.zeros(int(last[-1]) if len(last) else 0, np.int64)
        for turn, (who, e) in enumerate(steps):
            out[last[who] - 1 - turn] = piece[e]
            place[last[who] - 1 - turn] = frm[e]
        return count, out, place

    def encode_parts(self, parts: list[str], first: list[bool], seeds: list[int], base: list[int], salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts end to end, the number of each part's ids and of its words. A part that begins a text gets a blank before it."""
        text = [("\x00" if f else "") + p for f, p in zip(first, parts, strict=True)]
        sizes = np.fromiter(map(len, text), np.int64, len(text))
        points = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        points[points == MARK] = OTHER_MARK
        points[points == 0x20] = MARK
        points[at[np.array(first, bool) & (sizes > 0)]] = MARK
        new = points == MARK
        new[1:] &= points[:-1] != MARK
        new[at[sizes > 0]] = True
        start = np.flatnonzero(new)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        size = np.diff(np.append(start, len(points)))
        part = np.searchsorted(at, start, side="right") - 1
        bounds = np.searchsorted(start, np.append(at, len(points)))
        words = np.diff(bounds)
        power = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(int(size.max()), 2) - 1, self.MULTIPLIER + 2 * salt, U64)]), dtype=U64)
        place = np.arange(len(points)) - np.repeat(start, size)
        h = mix(np.add.reduceat((points + 1).astype(U64) * power[place], start) + size.astype(U64))
        _, one, word = np.unique(h, return_index=True, return_inverse=True)
        own = size[one]
        take = np.repeat(start[one] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        number = np.arange(len(start)) - bounds[part] + np.array(base, np.int64)[part]
        key = mix(np.array(seeds, U64)[part] + mix(number.astype(U64) + U64(1)))
        count, ids, where = self.sample(points[take], own, word, key)
        owner = np.repeat(part, count)
        spelt = np.flatnonzero(ids == self.size)
        if len(spelt):
            spelling = [(chr(p) if p != OTHER_MARK else chr(MARK)).encode("utf-8", "surrogatepass") for p in points[take][where[spelt]].tolist()]
            many = np.ones(len(ids), np.int64)
            many[spelt] = [len(b) for b in spelling]
            where_to = np.cumsum(many) - many
            grown = np.repeat(ids, many)
            raw = np.frombuffer(b"".join(spelling), np.uint8)
            n = many[spelt]
            grown[np.repeat(where_to[spelt] - (np.cumsum(n) - n), n) + np.arange(len(raw))] = self.byte_id[raw]
            ids, owner = grown, np.repeat(owner, many)
        return ids, np.bincount(owner, minlength=len(text)), words

    def long_word(self, word: str, key: int, chunk: int = 1 << 16) -> np.ndarray:
        """Ids of one word too long to hold all its edges: forward by chunks, of which only the totals are kept, and backward by the same chunks.

        ``word`` begins with its mark as \\0, if it has one.
        """
        n, width = len(word), self.longest
        total = np.zeros(n + 1)

        def entering(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Edges into lo + 1 .. hi by end and length, where those of each end begin, and the code points from ``lo`` - ``width``."""
            at = max(lo - width, 0)
            raw = word[at:hi]
            points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            points[points == MARK] = OTHER_MARK
            points[(points == 0x20) | (points == 0)] = MARK
            frm, to, piece = self.edges(points, np.full(len(points), len(points)))
            own = to + at > lo
            frm, to, piece = frm[own] + at, to[own] + at, piece[own]
            order = np.argsort((to << 5) | (to - frm))
            frm, to, piece = frm[order], to[order], piece[order]
            return frm, to, piece, np.searchsorted(to, np.arange(lo + 1, hi + 2)), points[lo - at :]

        for lo in range(0, n, chunk):
            hi = min(lo + chunk, n)
            frm, to, piece, cut, _ = entering(lo, hi)
            worth, back, ends = self.worth[piece].tolist(), frm.tolist(), cut.tolist()
            near = {i: float(total[i]) for i in range(max(lo - width, 0), lo + 1)}
            for i in range(lo + 1, hi + 1):
                paths = [worth[e] + near[back[e]] for e in range(ends[i - lo - 1], ends[i - lo])]
                top = max(paths)
                near[i] = top + log(sum(exp(x - top) for x in paths))
            total[lo + 1 : hi + 1] = [near[i] for i in range(lo + 1, hi + 1)]
        out, state, turn, drawn = [], n, 0, []
        for lo in range((n - 1) // chunk * chunk, -1, -chunk):
            frm, to, piece, cut, points = entering(lo, min(lo + chunk, n))
            chance, back, kinds, ends = np.exp(self.worth[piece] + total[frm] - total[to]).tolist(), frm.tolist(), piece.tolist(), cut.tolist()
            found = []
            while state > lo:
                if turn % 4096 == 0:
                    turns = np.arange(turn, turn + 4096, dtype=U64) * U64(0x9E3779B97F4A7C15)
                    drawn = ((mix(U64(key) + turns) >> U64(11)).astype(np.float64) * 2.0**-53).tolist()
                e, last, u = ends[state - lo - 1], ends[state - lo] - 1, drawn[turn % 4096]
                while e < last and u >= chance[e]:
                    u -= chance[e]
                    e += 1
                if kinds[e] == self.size:
                    p = int(points[back[e] - lo])
                    found += self.byte_id[np.frombuffer((chr(p) if p != OTHER_MARK else chr(MARK)).encode("utf-8", "surrogatepass"), np.uint8)].tolist()[::-1]
                else:
                    found.append(kinds[e])
                state, turn = back[e], turn + 1
            out.append(np.array(found[::-1], np.int32))
        return np.concatenate(out[::-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, blanks before texts included."""
        n = self.raw_size[ids]
        take = np.repeat(self.raw_at[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.raw[take].tobytes()

    def encode(self, texts: list[str], seeds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and how many each has; checked to decode to the texts."""
        ids, sizes, owner = [], np.zeros(len(texts), np.int64), []
        parts, first, keys, base, held = [], [], [], [], 0
        bases = [0] * len(texts)

        def flush() -> None:
            for salt in range(8):
                got, n, words = self.encode_parts(parts, first, keys, base, salt)
                if self.decode(got) == "".join((" " if f else "") + p for f, p in zip(first, parts, strict=True)).encode("utf-8", "surrogatepass"):
                    break  # else two words had one hash
            else:
                raise ValueError("a text does not decode to itself")
            ids.append(got)
            np.add.at(sizes, owner, n)
            for o, w in zip(owner, words.tolist(), strict=True):
                bases[o] += w
            for x in (parts, first, keys, base, owner):
                x.clear()

        def alone(i: int, word: str) -> None:
            """A long word by itself; what waits goes first."""
            if parts:
                flush()
            got = self.long_word(word, int(mix(U64(seeds[i]) + mix(np.array([bases[i] + 1], U64)))[0]))
            if self.decode(got) != word.replace("\x00", " ", 1 if word.startswith("\x00") else 0).encode("utf-8", "surrogatepass"):
                raise ValueError("a text does not decode to itself")
            ids.append(got)
            sizes[i] += len(got)
            bases[i] += 1

        for i, t in enumerate(texts):
            at = 0
            while at < len(t):
                end, is_long = word_end(t, at, LONGEST_PART)
                if is_long:
                    alone(i, ("\x00" if at == 0 else "") + t[at:end])
                    held, at = 0, end
                    continue
                parts.append(t[at:end])
                first.append(at == 0)
                keys.append(seeds[i])
                base.append(bases[i])
                owner.append(i)
                held += end - at
                if held > 2 * LONGEST_PART or end < len(t):
                    flush()
                    held = 0
                at = end
        if parts:
            flush()
        return np.concatenate([*ids, np.zeros(0, np.int32)]), sizes


def word_end(t: str, at: int, most: int) -> tuple[int, bool]:
    """Where a part that begins at ``at`` ends, ``most`` characters on at most and where a word does; (end, True) for a single word longer than that."""
    if len(t) - at <= most:
        return len(t), False
    cut = t.rfind(" ", at + 1, at + most + 1)
    if cut > at:
        cut = at + len(t[at:cut].rstrip(" "))  # to the first of the blanks
        if cut > at:
            return cut, False
    end = at + len(t[at:]) - len(t[at:].lstrip(" "))
    end = t.find(" ", end)
    return (len(t) if end < 0 else end), True


@lru_cache(2)
def lattice(path: str, alpha: float) -> Lattice:
    return Lattice(path, alpha)


def row_seed(key: int | None, seed: int) -> int:
    return int(mix(np.array([(0 if key is None else key) & (2**64 - 1)], U64) + U64(seed))[0])


def encode_pieces(docs: DataFrame, model_path: str, alpha: float = 1.0, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, n_pieces, pieces array<int>) for each row: a sampled segmentation of the whole text.

    A piece weighs as its rank to the power -``alpha``; the sample depends on seed, id and text alone. A
    character without a piece is spelt in byte pieces, and so is the blank mark itself. A null text
    has null pieces (n_pieces 0), an empty one none; a null id counts as 0; rows that repeat are sampled alike. A word of any length is held in bounded
    parts, beside 8 bytes for each of its characters. Every batch is decoded and
    compared before it leaves. With ``keep`` the columns of ``docs`` stay (names that clash are
    dropped from them).
    """
    spark_docs = docs.select(docs[text_col].cast("string").alias("text"), docs[id_col].cast("long").alias("doc_id"), *(docs[c] for c in docs.columns if c not in ("text", "doc_id", "pieces", "n_pieces"))) if keep else id_text(docs, id_col, text_col)
    names = [c for c in spark_docs.columns if keep or c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in spark_docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_path, alpha)
        for batch in batches:
            for part in pieces_of(batch, most=1 << 20):
                texts = part.column("text").to_pylist()
                ids, n = lat.encode([t or "" for t in texts], [row_seed(i, seed) for i in part.column("doc_id").to_pylist()])
                at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32(), mask=np.array([t is None for t in texts] + [False]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32()))], [*names, "n_pieces", "pieces"])

    return spark_docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_pieces long, pieces array<int>")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of encode_pieces()' rows; null pieces give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_path, 1.0)
        for batch in batches:
            out = [None if p is None else lat.decode(np.array(p, np.int64))[1:].decode("utf-8", "surrogatepass") for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
