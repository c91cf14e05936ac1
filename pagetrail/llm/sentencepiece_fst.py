"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are read from a model file: the normaliser (its character map, user-defined pieces that it leaves alone, escaped spaces,
the leading space mark), the pieces as arcs over the normalised text, and byte fallback arcs for characters without a piece. Composed
with a text they give a lattice; its tropical shortest path is the encoding. For unigram models an arc weighs minus its piece's score.
For BPE models the arcs of pieces that merging would not leave side by side do not meet: a path is a BPE encoding exactly if every two
neighbours on it encode to themselves, so the machine's state is the last piece, each kept arc weighs 1, and every prefix has one path.
That lattice is therefore composed lazily, longest arcs first, and a place where no arc meets the last piece is never entered again.
No piece holds a space mark after another character, so the lattice falls apart at those marks, and beside characters that no piece
holds; paths of recent parts are kept.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_row, text_or_empty

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
#: Paths of parts that a worker keeps: two generations of so many parts of at most LONGEST characters, some 30 MB in all.
CACHE = 80_000
LONGEST = 48
#: Pairs of pieces whose meeting a worker keeps, nine bytes each.
PAIRS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: number, and an int, four or eight bytes, or a slice."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The normaliser's replacements: a double array of byte transitions, whose leaves point at texts; the longest match is replaced."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units, self.texts, self.known = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :], {}

    def _longest(self, data: bytes) -> tuple[int, bytes]:
        """Bytes matched from the start of ``data`` (0: none) and what replaces them."""
        units, found = self.units, (0, b"")
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for i, c in enumerate(data, 1):
            node ^= c
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != c:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit & 256:
                at = units[node] & 0x7FFFFFFF
                found = i, self.texts[at : self.texts.index(b"\0", at)]
        return found

    def __call__(self, text: str) -> str:
        out, data, at = [], text.encode(), 0
        while at < len(data):
            size, told = self._longest(data[at : at + 64])
            if not size:
                size = 1
                while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
                    size += 1
                told = data[at : at + size]
            out.append(told)
            at += size
        return b"".join(out).decode()


class Transducer:
    """One model's machines."""

    def __init__(self, model: str | bytes) -> None:
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        fields = list(_fields(model))
        self.pieces, self.scores, self.kinds = [], [], []
        for piece in (dict(_fields(v)) for k, v in fields if k == 1):
            self.pieces.append(piece[1].decode())
            self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            self.kinds.append(piece.get(3, 1))
        trainer = dict(_fields(next((v for k, v in fields if k == 2), b"")))
        rules = dict(_fields(next((v for k, v in fields if k == 3), b"")))
        self.map = CharacterMap(rules[2]) if rules.get(2) else None
        self.bpe = trainer.get(3, 1) == 2
        self.prefix, self.squeeze, self.escape = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        self.fallback = bool(trainer.get(35, 0))
        self.arcs = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 1}
        self.own = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 4}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == 6}
        self.unknown = self.kinds.index(2)
        self._own = re.compile("(" + "|".join(map(re.escape, sorted(self.own, key=len, reverse=True))) + ")") if self.own else None
        self.level = {v: float(n) for n, v in enumerate(sorted({self.scores[i] for i in self.arcs.values()}), 1)}
        self.rank = {p: self.level[self.scores[i]] for p, i in self.arcs.items()}
        self.made: dict[str, tuple[float, str, str]] = {}
        if self.bpe:
            self._history()
        self.longest = max(map(len, self.arcs), default=1)
        self.widest: dict[str, int] = {}  # by the first three characters, and by two for shorter pieces: the most characters
        for p in self.arcs:
            start = p[:3] if len(p) > 2 else p[:2]
            self.widest[start] = max(self.widest.get(start, 1), len(p))
        inside = "".join(map(re.escape, sorted(set("".join([*self.arcs, *self.own])) - {MARK}))) or "a"
        # With byte fallback a character in no piece stands alone; without, neighbours of the kind become one unknown piece.
        self._parts = re.compile(f"{MARK}*[{inside}]+|{MARK}+|[^{MARK}{inside}]" if self.fallback else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.split_at_marks = MARK in self.arcs and not any(MARK in p.lstrip(MARK) for p in [*self.arcs, *self.own])
        self.packed = {p: i.to_bytes(4, "little") for p, i in (self.arcs | self.own).items()}
        self._trie()
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.raw = [self._raw(i) for i in range(len(self.pieces))]

    def _raw(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == 6:
            return bytes([int(self.pieces[i][1:-1], 16)])
        return b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else self.pieces[i].replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        if self.map and self._own:
            text = "".join(x if i % 2 else self.map(x) for i, x in enumerate(self._own.split(text)))
        elif self.map:
            text = self.map(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        text = (" " if self.prefix and text else "") + text
        return text.replace(" ", MARK) if self.escape else text

    def _history(self) -> None:
        """When and of what two parts merging makes each piece: its place in the order of merges (0 for a character). Left out are
        pieces that merging never makes, those whose parts come later, and runs of marks, which tie with each other."""
        top = max(self.rank.values(), default=0.0)
        for piece in sorted(self.rank, key=len):
            if MARK * 2 in piece:
                continue
            if len(piece) == 1:
                self.made[piece] = (0.0, "", "")
                continue
            s, parts = [*piece], ("", "")
            while len(s) > 1:
                best, at = 0.0, -1
                for i in range(len(s) - 1):
                    r = self.rank.get(s[i] + s[i + 1], 0.0)
                    if r > best:
                        best, at = r, i
                if at < 0:
                    break
                parts = (s[at], s[at + 1])
                s[at : at + 2] = [s[at] + s[at + 1]]
            when = top + 1 - self.rank[piece]
            if len(s) == 1 and all(x in self.made and self.made[x][0] < when for x in parts):
                self.made[piece] = (when, *parts)

    def _meet(self, a: str, b: str) -> bool:
        """Whether merging the characters of ``a + b`` (best piece first, leftmost of equals) gives just these two pieces.

        Followed backwards along the seam: of the two pieces beside it the one made later is taken apart, and at each step a piece
        over the seam must not have been due before the merge that ended the step. Pieces without a history are merged out.
        """
        made = self.made
        if not a:
            return b in made or len(b) == 1 or self._merges_to(a, b)
        x, y = made.get(a), made.get(b)
        if x is None or y is None:
            return self._merges_to(a, b)
        limit, right = float("inf"), False
        rank, top = self.rank.get, len(self.level) + 1
        while True:
            over = rank(a + b)
            if over is not None and (top - over < limit or right and top - over == limit):
                return False
            if x[0] > y[0]:
                limit, right, a = x[0], False, x[2]
                x = made[a]
            elif y[0] > 0:
                limit, right, b = y[0], True, y[1]
                y = made[b]
            else:
                return True

    def _merges_to(self, a: str, b: str) -> bool:
        s, seam, rank = [*a, *b], len(a), self.rank.get
        while len(s) > 1:
            best, at = 0.0, -1
            for i in range(len(s) - 1):
                r = rank(s[i] + s[i + 1], 0.0)
                if r > best:
                    best, at = r, i
            if at < 0 or at == seam - 1:  # nothing left to merge, or a merge across the seam
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
            seam -= at < seam
        else:
            return True
        return at < 0 and len(s) == 2 and seam == 1

    def _path(self, part: str) -> list[str]:
        """The labels of the shortest path through one part's lattice."""
        return self._bpe_path(part) if self.bpe else self._best_path(part)

    def _bpe_path(self, part: str) -> list[str]:
        """The only path of one part: arcs are tried longest first, and a place that no arc leaves is marked dead."""
        n, arcs, widest, path, at, dead, last = len(part), self.arcs, self.widest.get, [], 0, set(), ""
        width = widest(part[:3]) or widest(part[:2], 1)
        while at < n:
            while width:
                label = part[at : at + width]
                if (width == 1 or label in arcs) and at + width not in dead and self._meet(last, label):
                    break
                width -= 1
            if width:
                path.append(label)
                at, last = at + len(label), label
                width = widest(part[at : at + 3]) or widest(part[at : at + 2], 1)
            else:
                dead.add(at)
                label = path.pop()
                width = len(label) - 1
                at, last = at - len(label), path[-1] if path else ""
        return path

    def _trie(self) -> None:
        """The arcs as a trie in sorted arrays: from a node by a character to a node, the piece that ends at a node, and for each piece
        its length and the longest other piece that it starts with."""
        chars = {c: i for i, c in enumerate(sorted(set("".join(self.arcs))), 1)}
        self.char_no = np.zeros(max(map(ord, chars), default=0) + 2, np.int64)
        for c, i in chars.items():
            self.char_no[ord(c)] = i
        self.step, steps, ends = len(chars) + 1, {}, {}
        self.length, self.shorter = np.zeros(len(self.pieces), np.int64), np.full(len(self.pieces), -1)
        for p in sorted(self.arcs, key=len):
            node, inner = 0, -1
            for c in p:
                node = steps.setdefault(node * self.step + chars[c], len(steps) + 1)
                inner = ends.get(node, inner)
            ends[node] = i = self.arcs[p]
            self.length[i], self.shorter[i] = len(p), inner
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.full(len(steps) + 1, -1)
        self.ends[list(ends)] = list(ends.values())
        self.alone = np.array([False, *(c in self.arcs for c in chars)])
        self.pairs, self.meets = np.zeros(0, np.int64), np.zeros(0, bool)

    def _meeting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pieces may stand side by side; ``len(pieces)`` on the left stands for the start. Answers are kept in sorted arrays."""
        n = len(self.pieces)
        key = left * n + right
        at = np.searchsorted(self.pairs, key)
        fresh = np.unique(key[self.pairs[np.minimum(at, len(self.pairs) - 1)] != key]) if len(self.pairs) else np.unique(key)
        if len(fresh):
            if len(self.pairs) > PAIRS:
                self.pairs, self.meets, fresh = self.pairs[:0], self.meets[:0], np.unique(key)
            told = [self._meet(self.pieces[k // n] if k // n < len(self.pieces) else "", self.pieces[k % n]) for k in fresh.tolist()]
            put = np.searchsorted(self.pairs, fresh)
            self.pairs, self.meets = np.insert(self.pairs, put, fresh), np.insert(self.meets, put, told)
            at = np.searchsorted(self.pairs, key)
        return self.meets[at]

    def _longest(self, chars: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The longest piece at each place, or -1."""
        arc, node, alive, depth = np.full(len(at), -1), np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(alive):
            alive = alive[at[alive] + depth < stop[alive]]
            key = node[alive] * self.step + chars[at[alive] + depth]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            alive, i = alive[hit], i[hit]
            node[alive] = self.next[i]
            ended = self.ends[node[alive]]
            arc[alive] = np.where(ended >= 0, ended, arc[alive])
            depth += 1
        return arc

    def _bpe_many(self, parts: list[str]) -> list[bytes]:
        """Ids of many parts, whose paths grow side by side; parts with a character that is no piece go one by one."""
        size = np.array([len(p) for p in parts])
        stop = np.cumsum(size)
        start, n = stop - size, len(self.pieces)
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        chars = self.char_no[np.minimum(codes, len(self.char_no) - 1)]
        strange = np.concatenate(([0], np.cumsum(~self.alone[chars])))
        whole = strange[stop] == strange[start]
        last, dead = np.full(len(codes) + 1, n), np.zeros(len(codes) + 1, bool)  # by the place where a piece ends
        part = np.flatnonzero(whole)
        at, arc = start[part], self._longest(chars, start[part], stop[part])
        while len(part):
            state, asked = np.where(at > start[part], last[at], n), np.flatnonzero(arc >= 0)
            while len(asked):
                x = arc[asked]
                asked = asked[dead[at[asked] + self.length[x]] | ~self._meeting(state[asked], x)]
                arc[asked] = self.shorter[arc[asked]]
                asked = asked[arc[asked] >= 0]
            go = arc >= 0
            back = at[~go]
            dead[back] = True
            gone = last[back]  # the last piece is taken off and the next shorter one tried
            at[~go], arc[~go] = back - self.length[gone], self.shorter[gone]
            at[go] += self.length[arc[go]]
            last[at[go]] = arc[go]
            open_ = ~go | (at < stop[part])
            part, at, arc, go = part[open_], at[open_], arc[open_], go[open_]
            arc[go] = self._longest(chars, at[go], stop[part[go]])
        of, ids, part = [], [], np.flatnonzero(whole)
        at = stop[part]
        while len(part):  # from the ends back to the starts
            of.append(part)
            ids.append(last[at])
            at = at - self.length[last[at]]
            part, at = part[at > start[part]], at[at > start[part]]
        of, ids = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in (of, ids))
        data = ids[np.argsort(of, kind="stable")].astype("<i4").tobytes()
        cuts = (4 * np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(parts)))))).tolist()
        return [data[a:b] if ok else self._ids(p) for p, ok, a, b in zip(parts, whole.tolist(), cuts[:-1], cuts[1:], strict=True)]

    def _best_path(self, part: str) -> list[str]:
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == 1] or [0.0]
        n, dear, dearest = len(part), 10.0 - min(normal), max(normal)
        cost, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        longest = max(self.longest, max(map(len, self.own), default=1))
        for at in range(n):
            for stop in range(at + 1, min(n, at + longest) + 1):
                label = part[at:stop]
                i = self.arcs.get(label)
                if label in self.own:
                    c = 0.1 - len(label.encode()) * dearest
                elif i is not None:
                    c = -self.scores[i]
                elif stop == at + 1:
                    c = dear
                else:
                    continue
                if cost[at] + c < cost[stop]:
                    cost[stop], back[stop] = cost[at] + c, at
        stop, out = n, []
        while stop:
            out.append(part[back[stop] : stop])
            stop = back[stop]
        return out[::-1]

    def _ids(self, part: str) -> bytes:
        """Ids of one part, four bytes each."""
        out, packed, unknown = [], self.packed, False
        for label in self._path(part):
            told = packed.get(label)
            if told is None:
                fallback = self.fallback and self.bytes
                told = b"".join(self.bytes[b].to_bytes(4, "little") for b in label.encode()) if fallback else b"" if unknown else self.unknown.to_bytes(4, "little")
                unknown = not fallback
            else:
                unknown = False
            out.append(told)
        return b"".join(out)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as the library gives them without begin or end."""
        known, texts_parts, fresh = self.parts, [], set()
        for text in texts:
            parts = []
            for i, stretch in enumerate(self._own.split(self.normalise(text)) if self._own and self.bpe else [self.normalise(text)]):
                if i % 2:
                    known[stretch] = self.packed[stretch]
                    parts.append(stretch)
                else:
                    parts += self._parts.findall(stretch) if self.split_at_marks else [stretch] * bool(stretch)
            texts_parts.append(parts)
            fresh.update(parts)
        fresh = [p for p in fresh if p not in known]
        short = [p for p in fresh if len(p) <= LONGEST and p not in self.older] if self.bpe and self.arcs else []
        for i in range(0, len(short), 8192):
            known.update(zip(short[i : i + 8192], self._bpe_many(short[i : i + 8192]), strict=True))
        known.update((p, self.older[p] if p in self.older else self._ids(p)) for p in fresh if p not in known)
        out = [np.frombuffer(b"".join(map(known.__getitem__, parts)), "<i4") for parts in texts_parts]
        for p in fresh:
            if len(p) > LONGEST:
                del known[p]
        if len(known) > CACHE:
            self.older, self.parts = known, {}
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def forget(self) -> None:
        """Lets the kept parts go; what is known of pairs of pieces stays."""
        self.parts, self.older = {}, {}

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: pieces and bytes in turn, the leading space mark gone; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One model's machines, kept by a Python worker from task to task."""
    return Transducer(path)


def encode_column(text: Column, *, path: str | None = None) -> Column:
    """An array of ids for every whole text; null texts count as empty and have none."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(path)
        for b in batches:
            yield pd.Series(t.encode_many(b.tolist()))

    return encode(text_or_empty(text))


def decode_column(ids: Column, *, path: str | None = None) -> Column:
    """The text of every array of ids; null arrays give null."""
    path = path or default_path()

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(path)
        for b in batches:
            yield pd.Series([None if x is None else t.decode(x) for x in b])

    return decode(ids)


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, token_ids, n_tokens`` for every row. Null and empty texts have no tokens; null ids stay null; repeated rows repeat;
    an empty table gives an empty result; extra columns play no part."""
    path = path or default_path()

    def make():
        t = transducer(path)

        def encode(texts):
            ids = t.encode_many(texts)
            return {"token_ids": ids, "n_tokens": [len(x) for x in ids]}

        encode.done = t.forget
        return encode

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return per_row(rows, make, "token_ids array<int>, n_tokens long")


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_byte_tokens, ids_sha256, decoded_sha256``: each text encoded, and decoded from its ids, in one task.

    ``ids_sha256`` is of the ids as little-endian 32-bit numbers; with a model that changes no characters the text comes back unless it
    holds the space mark U+2581 itself. Null texts count as empty; null ids stay null; repeated rows repeat; an empty table gives an
    empty result; extra columns play no part.
    """
    path = path or default_path()

    def make():
        t = transducer(path)
        low, high = min(t.bytes.values(), default=0), max(t.bytes.values(), default=-1)

        def digest(texts):
            out = {"n_tokens": [], "n_byte_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for a in t.encode_many(texts):
                out["n_tokens"].append(len(a))
                out["n_byte_tokens"].append(int(((a >= low) & (a <= high)).sum()))
                out["ids_sha256"].append(hashlib.sha256(a.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(t.decode(a.tolist()).encode()).hexdigest())
            return out

        digest.done = t.forget
        return digest

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return per_row(rows, make, "n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string")
