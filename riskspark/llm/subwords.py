"""Subword ids of whole batches of texts: each distinct piece of text is tokenized once per worker.

The tokenizer splits a text before it merges, and never across a step from a visible character to
ASCII white space. So the pieces between such steps are tokenized on their own, remembered by
their 64-bit hash, and a batch's ids are put together by numpy. Texts with other Unicode spaces or
with a special token's string are given to the tokenizer whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from riskspark.llm import text as T

#: pieces remembered per worker before it starts anew (about 32 bytes each)
MEMO = 400_000
#: new pieces that go to the tokenizer as one text
TOGETHER = 2000
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|")
#: first bytes of what _ODD finds
_LEAD = np.zeros(256, bool)
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0x3C]] = True
#: and of these the second bytes of the longer ones
_NEXT = np.zeros((256, 256), bool)
_NEXT[0x1C:0x20] = True
_NEXT[[0xC2, 0xC2, 0xE1, 0xE2, 0xE2, 0xE3, 0x3C], [0x85, 0xA0, 0x9A, 0x80, 0x81, 0x80, 0x7C]] = True
_open: dict[str, Subwords] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Subwords:
    """One tokenizer file with its memo; ``of`` gives the worker's own copy."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        #: of a byte-level vocabulary each character of an id's name stands for a byte
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])

    @staticmethod
    def of(path: str | None = None) -> Subwords:
        path = path or default_path()
        if path not in _open:
            _open[path] = Subwords(path)
        return _open[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def forget(self) -> None:
        """Empties the memo: hashes of pieces in ascending order, and where the ids of each lie in one pool."""
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16)

    def each(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id and number of ids of each piece) of byte spans. Pieces that begin with white space are
        tokenized TOGETHER at a time as one text; the ids' lengths in bytes tell them apart."""
        begin, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        tied = T._SPACE[data[start]]
        some, parts, n = np.flatnonzero(tied), [], 0
        if len(some):
            size = (end - start)[some]
            stop = np.cumsum(size)
            raw = data[np.repeat(start[some] - stop + size, size) + np.arange(stop[-1])].tobytes()
            cuts = [0, *stop[TOGETHER - 1 : -1 : TOGETHER].tolist(), int(stop[-1])]
            joined = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
            parts = [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            upto = np.cumsum(self.bytes[np.concatenate(parts)])
            last = np.searchsorted(upto, stop, "left")
            if last[-1] == len(upto) - 1 and (upto[last] == stop).all():
                n = len(upto)
                count[some] = np.diff(last, prepend=-1)
                begin[some] = last + 1 - count[some]
            else:  # bytes that are no text, or an id across two pieces: each piece on its own
                tied[:], parts = False, []
        alone = np.flatnonzero(~tied).tolist()
        strings = [data[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in alone]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            parts.append(np.array(e.ids, np.uint16))
            begin[i], count[i] = n, len(parts[-1])
            n += count[i]
        return np.concatenate(parts), begin, count

    def pieces(self, data, start, end, hashes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of byte spans with these hashes."""
        if not len(hashes):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        uniq, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > MEMO:
            self.forget()
        place = np.searchsorted(self.keys, uniq)
        new = np.ones(len(uniq), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != uniq[inside]
        if new.any():
            ids, begin, count = self.each(data, start[at[new]], end[at[new]])
            self.keys = np.insert(self.keys, place[new], uniq[new])
            self.begin = np.insert(self.begin, place[new], begin + len(self.pool))
            self.count = np.insert(self.count, place[new], count)
            self.pool = np.concatenate((self.pool, ids))
            place = np.searchsorted(self.keys, uniq)
        count = self.count[place][inverse]
        out = np.repeat(self.begin[place][inverse] - np.cumsum(count) + count, count)
        out += np.arange(len(out))
        return self.pool[out], count

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of every text of a slice (see ``text.slices``)."""
        if not len(data):
            return [np.zeros(0, np.uint16)] * (len(off) - 1)
        space = T._SPACE[data]
        step = np.zeros(len(data), bool)
        step[1:] = space[1:] & ~space[:-1]
        step[off[:-1][off[:-1] < len(data)]] = True
        start = np.flatnonzero(step)
        end = np.append(start[1:], len(data))
        ids, count = self.pieces(data, start, end, T.span_hash(data, start, end, lower=False))
        at = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(start, off)]
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        raw = data.tobytes()
        odd = np.flatnonzero(_LEAD[data])
        odd = odd[_NEXT[data[odd], data[np.minimum(odd + 1, len(data) - 1)]]]
        for i in {int(np.searchsorted(off, p, "right")) - 1 for p in odd.tolist() if _ODD.match(raw, p)}:
            out[i] = self.whole(raw[off[i] : off[i + 1]].decode("utf-8", "replace"))
        return out


def texts_of(batch_column: pa.Array, path: str | None = None):
    """Yields the id array of each text of a column."""
    own = Subwords.of(path)
    for _, _, data, off in T.slices(batch_column, 2 * T.SLICE_BYTES):
        yield from own.encode(data, off)
