"""Encoding of texts with a public tokenizer file, in batches of bounded size.

A tokenizer of this kind never joins characters across a blank that stands between two
characters that are not white space: the blank begins a new piece. Texts are cut there. Equal
pieces give equal ids, so a bounded memory of pieces saves most of the work, and a very long
text is never encoded as a whole.
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flowlake.llm.common import give_back

MEMORY = 1_000_000             # pieces remembered by a worker
LONGEST = 24                  # longer pieces are not remembered
BATCH = 8 << 20               # bytes of text encoded at a time; equal pieces in it are encoded once
GROUP = 20_000                # pieces encoded in one call
SAFE = re.compile(r"(?<=\S) (?=\S)")


def _bare(words: pa.StringArray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a piece has no white space at its ends; whether it is empty. Visible ASCII at both ends settles it."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32, len(words) + 1, words.offset * 4)
    empty = at[1:] == at[:-1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    seen = (raw > 0x20) & (raw < 0x7F)
    bare = empty | (seen[np.minimum(at[:-1], len(raw) - 1)] & seen[at[1:] - 1])
    for i in np.flatnonzero(~bare).tolist():
        bare[i] = pieces[i] == pieces[i].strip()
    return bare, empty


class Encoder:
    """ids of whole texts as little-endian bytes, or only their numbers."""

    def __init__(self, path: str, remembered: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        blank = self._ids(" ")
        mark = self.tokenizer.id_to_token(blank[0])[0] if len(blank) == 1 else None
        # Only a byte-level vocabulary, where a blank has a letter of its own, is cut into pieces.
        self.begins = np.zeros(self.size, bool)
        self.cut = mark is not None and mark != " " and '"ByteLevel"' in self.tokenizer.to_str()
        if self.cut:
            for token, i in vocabulary.items():
                self.begins[i] = token.startswith(mark)
        self.remembered, self.memory = remembered, dict[str, bytes]()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _learn(self, new: list[str]) -> list[bytes]:
        """ids of each piece with a blank before it. Pieces hold no white space at their ends."""
        out: list[bytes] = []
        for a in range(0, len(new), GROUP):
            some = new[a:a + GROUP]
            joined = " " + " ".join(some)
            if joined.count(" ") != len(some):  # blanks inside of pieces
                out += self._batch([" " + p for p in some])
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(some):  # a blank that is a token of its own, say
                out += self._batch([" " + p for p in some])
                continue
            raw, at = ids.tobytes(), [*(starts * ids.itemsize).tolist(), len(ids) * ids.itemsize]
            out += map(raw.__getitem__, map(slice, at, at[1:]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """One bytes object a text, the ids without added special tokens."""
        gc.disable()  # millions of short strings, none of them in a cycle
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Texts cut at every blank, each different piece looked up once, ids gathered by their places."""
        if not self.cut or not texts:
            return self._batch(texts)
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        ends = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        code, pieces = np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False)
        # White space beside a blank: these texts are cut only where a blank stands alone.
        bare, empty = _bare(coded.dictionary, pieces)
        fine = (bare & ~empty)[code]
        fine[ends[:-1]] = bare[code[ends[:-1]]]
        if not fine.all():
            odd = ~np.logical_and.reduceat(fine, ends[:-1])
            rest = iter(self._singly([t for t, o in zip(texts, odd) if o]))
            plain = iter(self._encode([t for t, o in zip(texts, odd) if not o]))
            return [next(rest if o else plain) for o in odd]
        # Heads have no blank before them; they stand behind all other pieces.
        first = np.zeros(len(code), bool)
        first[ends[:-1]] = True
        inner, heads = np.zeros(len(pieces), bool), np.zeros(len(pieces), bool)
        inner[code[~first]] = heads[code[first]] = True
        found = self._known(pieces[inner].tolist()) + self._batch(pieces[heads].tolist())
        at = (np.cumsum(inner, dtype=np.int32) - 1)[code]
        at[first] = (inner.sum() + np.cumsum(heads, dtype=np.int32) - 1)[code[first]]
        ids = pa.array(found, pa.binary()).take(pa.array(at))
        _, offsets, data = ids.buffers()
        cuts = np.frombuffer(offsets, np.int32, len(at) + 1)[ends].tolist()
        raw = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _singly(self, texts: list[str]) -> list[bytes]:
        cut = [SAFE.split(t) for t in texts]
        heads = self._batch([c[0] for c in cut])
        flat = list(chain.from_iterable(c[1:] for c in cut))
        found, ends = self._known(flat), list(accumulate(len(c) - 1 for c in cut))
        return [h + b"".join(found[b - len(c) + 1:b]) for h, c, b in zip(heads, cut, ends)]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """ids of each piece with a blank before it, remembered or learned."""
        found = list(map(self.memory.get, pieces))
        open_at = [i for i, x in enumerate(found) if x is None]
        if open_at:
            new = list(dict.fromkeys([pieces[i] for i in open_at]))
            if " " in "".join(new):
                new.sort(key=lambda p: " " in p)  # those with blanks inside are encoded one by one
            ids = self._learn(new)
            learned = dict(zip(new, ids))
            for i in open_at:
                found[i] = learned[pieces[i]]
            if len(self.memory) > self.remembered:
                self.memory = {}
            self.memory.update((p, x) for p, x in learned.items() if len(p) <= LONGEST)
        return found


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = MEMORY) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path, remembered)


def forget() -> None:
    """Drop a worker's encoders with their pieces, for the sake of other work."""
    encoder.cache_clear()
    give_back()
