"""Token counts with overlap resynchronisation for huge documents.

A document longer than a chunk is encoded in overlapping chunks with offsets. Two chunks are spliced at a common word boundary of
their overlap that is proven stable: both encodings start a pre-token there, it lies at least ``GUARD`` characters inside the overlap
on both sides (longer than any special string, which neither chunk then cuts before it), and the left chunk has two more whole pre-tokens
after it, so that its end played no part. From such a place on, the splitter sees the same text and does the same. Where an
overlap has none (a run of letters or spaces longer than it), the left chunk is widened, by twice as much each time, until it has one or
reaches the end of the text: the work stays in proportion to the text.

Other texts are encoded whole, or word by word through a cache where single spaces between plain characters prove the same boundaries.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row, text_or_empty

CHUNK = 32_768
OVERLAP = 512
GUARD = 64
LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
#: Words whose counts a task keeps; then it starts anew.
CACHE = 250_000
#: A space next to anything that some library may see as white space, or to a control or format character.
_DOUBT = re.compile(r" (?:$|[\s\x00-\x20\x7f-\xa0\xad ᠎ -⁯　﻿])|[\s\x00-\x20\x7f-\xa0\xad ᠎ -⁯　﻿] ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Counter:
    """Counts tokens with one tokenizer file; made once a task."""

    def __init__(self, path: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        for t in self.tok.get_added_tokens_decoder().values():
            if len(t.content) >= GUARD or " " in t.content or t.lstrip or t.rstrip or t.single_word:
                raise ValueError(f"special strings of {GUARD} characters or more, with spaces, or that take in what is beside them aren't counted here")
        self.chunk, self.overlap = chunk, max(overlap, 4 * GUARD)
        self.words: dict[str, int] = {}
        self.widened = 0

    def _encode(self, text: str, start: int, stop: int) -> list[tuple[int, int]]:
        """Pre-tokens of text[start:stop] as (first character, tokens): where word ids change, a pre-token or special string starts."""
        e = self.tok.encode(text[start:stop], add_special_tokens=False)
        out, last = [], object()
        for (at, _), word in zip(e.offsets, e.word_ids, strict=True):
            if word != last or word is None:
                out.append([start + at, 0])
                last = word
            out[-1][1] += 1
        return out

    def spliced(self, text: str) -> int:
        """Tokens of a text longer than a chunk."""
        total, start, stop, more = 0, 0, self.chunk, self.chunk
        skip = 0  # tokens of the current chunk count from this character on
        left = self._encode(text, start, stop)
        while stop < len(text):
            begin = stop - self.overlap
            fresh_stop = min(len(text), begin + self.chunk)
            right = self._encode(text, begin, fresh_stop)
            ours = {at for at, _ in left[:-3] if begin + GUARD <= at <= stop - GUARD and at >= skip}
            seam = next((at for at, _ in right if at in ours), None)
            if seam is None:  # widen: the left chunk takes in more text, the overlap moves on
                self.widened += 1
                stop, more = min(len(text), stop + more), 2 * more
                left = self._encode(text, start, stop)
                continue
            total += sum(n for at, n in left if skip <= at < seam)
            left, start, stop, skip, more = right, begin, fresh_stop, seam, self.chunk
        return total + sum(n for at, n in left if at >= skip)

    def count(self, texts: list[str]) -> list[int]:
        plain, whole, out = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.spliced(t)
            elif t and not _DOUBT.search(t):
                plain.append((i, t.split(" ")))
            elif t:
                whole.append(i)
        if len(self.words) > CACHE:
            self.words.clear()
        words, fresh = self.words, set()
        for _, w in plain:
            fresh.update(w[1:])
        fresh = [w for w in fresh if w not in words]
        for i in range(0, len(fresh), 4096):
            part = fresh[i : i + 4096]
            words.update(zip(part, map(len, self.tok.encode_batch_fast([" " + w for w in part], add_special_tokens=False)), strict=True))
        firsts = self.tok.encode_batch_fast([w[0] for _, w in plain], add_special_tokens=False)
        for (i, w), first in zip(plain, firsts, strict=True):
            out[i] = len(first) + sum(map(words.__getitem__, w[1:]))
        for j in range(0, len(whole), 64):
            part = whole[j : j + 64]
            for i, e in zip(part, self.tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = len(e)
        return out


def count_tokens(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row: tokens as the library for the file at ``path`` counts them.

    Null texts count as empty and have 0 tokens; null ids stay null. Texts of any length are encoded whole. Repeated rows give repeated
    results, an empty table none. The file must be at ``path`` on every executor. Other columns play no part.
    """
    path = path or default_path()

    def make():
        counter = Counter(path, chunk=chunk, overlap=overlap)
        return lambda texts: {"n_tokens": counter.count(texts)}

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = per_row(rows, make, "n_tokens long", passed=("doc_id", "n_bytes"), piece=512)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
