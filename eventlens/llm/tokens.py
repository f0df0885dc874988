"""Exact batch encoding with a public tokenizer file, one library call per distinct word.

The pipeline of word_bpe_49k.json never joins characters across ASCII white space: NFC leaves a space alone, the
splitter drops white space, and special tokens hold none. So the ids of a text are the ids of its
space-separated chunks in order, and each distinct chunk needs one call only.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Chunks that are one run of ASCII or Latin-1 letters, and perhaps a stop or comma: lower-casing is all that
#: normalisation does to them, and they split into the letters and the sign.
_SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)").fullmatch


def _byte_level() -> dict[int, str]:
    """Latin-1 letters as the characters that stand for their UTF-8 bytes in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    as_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(as_char[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes text arrays. Remembers up to `limit` chunks; further ones are encoded once per batch."""

    def __init__(self, path: str, limit: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_level()
        self.signs = {"": [], **{c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,"}}
        probe = ["Caf\u00e9,", "\u00dcber.", "the", "Stra\u00dfe"]
        self.fast = self._split(probe) == [x.ids for x in self.tokenizer.encode_batch(probe, add_special_tokens=False)]
        self.limit = limit
        self.known = pa.array([], pa.string())
        self.flat = np.empty(1 << 20, np.uint32)
        self.start = np.zeros(1 << 18, np.int64)
        self.length = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _split(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk: simple ones by the library's model alone, all others by its whole pipeline."""
        out, words, other = [], {}, []
        tokenize, letters, signs = self.model.tokenize, self.letters, self.signs
        for i, chunk in enumerate(chunks):
            found = _SIMPLE(chunk)
            if found is None:
                other.append(i)
                out.append(None)
                continue
            word = found[1].lower()
            ids = words.get(word)
            if ids is None:
                ids = words[word] = [t.id for t in tokenize(word if word.isascii() else word.translate(letters))]
            out.append(ids + signs[found[2]] if found[2] else ids)
        for i, x in zip(other, self.tokenizer.encode_batch_fast([chunks[i] for i in other], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._split(chunks) if self.fast else [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length

    def _remember(self, chunks: list[str], flat: np.ndarray, length: np.ndarray) -> None:
        n, base = len(chunks), len(self.known)
        while base + n > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[base : base + n] = self.used + np.cumsum(length) - length
        self.length[base : base + n] = length
        self.used += len(flat)
        self.known = pa.concat_arrays([self.known, pa.array(chunks, pa.string())])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null counts as empty."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        per_text = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        where = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        missing = where < 0
        start, length, pool = self.start, self.length, self.flat
        if missing.any():
            fresh = coded.dictionary.filter(pa.array(missing)).to_pylist()
            flat, n = self._encode(fresh)
            room = min(len(fresh), max(0, self.limit - len(self.known)))
            own, cut = len(self.known), int(n[:room].sum())
            if room:
                self._remember(fresh[:room], flat[:cut], n[:room])
            start, length, pool = self.start, self.length, self.flat
            if room < len(fresh):  # not remembered: they live for this batch only
                extra = np.cumsum(n) - n
                start = np.concatenate([start[: own + room], self.used + extra[room:] - cut])
                length = np.concatenate([length[: own + room], n[room:]])
                pool = np.concatenate([pool[: self.used], flat[cut:]])
            where[missing] = own + np.arange(len(fresh))
        begin, size = start[where], length[where].astype(np.int32)  # of each distinct chunk
        n = size[code] if len(code) else np.empty(0, np.int32)
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        if total < 1 << 31 and len(pool) < 1 << 31:
            shift = (begin[code] - ends + n).astype(np.int32) if len(code) else n
            take = np.repeat(shift, n) + np.arange(total, dtype=np.int32)
        else:
            take = np.repeat(begin[code] - ends + n, n) + np.arange(total)
        sums = np.concatenate([[0], ends])
        return pool[take], np.diff(sums[np.concatenate([[0], np.cumsum(per_text)])])
