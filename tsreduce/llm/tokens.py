"""Token ids of the public byte-level BPE vocabulary, in bulk."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The vocabulary's own pattern (fixed value): it splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of blanks and what follows it. No match of PATTERN crosses such a border if a text has no other white space.
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Texts that single blanks between words don't divide into chunks: blanks beside blanks, line ends or the text's ends, or other white space. All characters of \s, in the syntax of RE2.
ODD = r"  | \n|\n |^ | $|[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def slices(b: pa.RecordBatch, at_once: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows, so many at a time that their texts (column 1) have about at_once bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(size // at_once)) + 1).tolist(), b.num_rows]
    for x, y in zip(edges[:-1], edges[1:]):
        if y > x:
            yield b.slice(x, y - x)


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level BPE files write a printable byte as itself, and the others in order as the characters from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE(dict):
    """Ids as little-endian unsigned 32-bit bytes, by chunk of text. When it holds most of them, it forgets those that it hasn't met since the last time."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        import tiktoken

        symbols = _bytes_of_symbols()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", ())}
        ranks = {bytes(map(symbols.__getitem__, k)): i for k, i in model["model"]["vocab"].items() if k not in special}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most, self.before = most, {}
        self.size = 1 + max(model["model"]["vocab"].values())
        #: The narrowest integers that hold all ids.
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(chunk)
        if ids is None:
            ids = self._whole(chunk)
        self[chunk] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids that the tokenizers library gives without special tokens; control strings in a text are ordinary text."""
        if OTHER_SPACE.search(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): those of each text side by side, as encode gives them; null texts have none. A word is looked up once for all texts that it divides."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.or_(pc.match_substring_regex(texts, ODD), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        found = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        codes, size = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
        codes[offsets[:-1] - offsets[0]] += size  # a text's first word has no blank before it
        words = found.dictionary.to_pylist()
        used = np.unique(codes[offsets[:-1] - offsets[0]]) - size
        each = [self[" " + w] for w in words] + [b""] * size
        for k in used.tolist():
            each[size + k] = self._whole(words[k])
        sizes = np.fromiter(map(len, each), np.int64, 2 * size) // 4
        of_word = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(each), np.uint32))
        plain = of_word.take(pa.array(codes)).flatten().to_numpy()
        ends = np.append(0, np.cumsum(sizes[codes]))[offsets - offsets[0]]
        if not odd.any():
            return plain, ends
        lengths = np.empty(len(texts), np.int64)
        lengths[~odd] = np.diff(ends)
        others = [np.frombuffer(self.encode(t), np.uint32) for t in texts.filter(pa.array(odd)).to_pylist()]
        lengths[odd] = [len(x) for x in others]
        parts, rest = [], iter(others)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], odd, [False]]).astype(np.int8)))  # odd texts between plain ones
        at, n_plain = 0, np.concatenate([[0], np.cumsum(~odd)])
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            parts.append(plain[ends[n_plain[at]] : ends[n_plain[lo]]])
            parts.extend(next(rest) for _ in range(hi - lo))
            at = hi
        parts.append(plain[ends[n_plain[at]] :])
        return np.concatenate(parts), np.append(0, np.cumsum(lengths))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
