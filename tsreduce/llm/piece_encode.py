"""SentencePiece encoding and decoding by a forward pass over a trie of words, whose common prefixes are met once."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tsreduce.llm.tokens import slices

MARK = "▁"
#: No piece has a mark behind another character, so no piece reaches from one marked word into the next.
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNIGRAM, BPE = 1, 2
#: What a Python worker keeps at most: encoded words, and pairs of pieces.
MOST_WORDS, MOST_PAIRS = 800_000, 1_000_000
#: Bytes of text whose words are sorted at once.
AT_ONCE = 8_000_000


def _fields(b: bytes):
    """(number, value) of the fields of a protocol buffer message; values are integers or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = b[at]
            at += 1
            value |= (c & 127) << shift
            if c < 128:
                return value
            shift += 7

    while at < len(b):
        tag = number()
        size = {0: None, 1: 8, 5: 4}.get(tag & 7, -1)
        if size is None:
            yield tag >> 3, number()
            continue
        size = number() if size < 0 else size
        yield tag >> 3, b[at : at + size]
        at += size


class _Pairs(dict):
    """Whether merging pieces u and t leaves both as they are, by (u, t)."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model

    def __missing__(self, key: tuple[int, int]) -> bool:
        if len(self) >= MOST_PAIRS:
            self.clear()
        both = [self.model.pieces[i] for i in key]
        found = self[key] = self.model.merged("".join(both)) == both
        return found


class PieceModel:
    """A model file's pieces, and the forward pass over its words.

    A state stands for a prefix of a word. For a unigram model it holds the best score and the last piece of the best
    segmentation (Viterbi). For a BPE model, whose merges need not give the best sum of scores, it holds the last piece
    of the prefix's own encoding: the piece t such that merging its neighbour u and t leaves both as they are.
    """

    def __init__(self, path: str, model_type: int | None = None) -> None:
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        found = dict(f for n, v in _fields(sp.serialized_model_proto()) if n == 2 for f in _fields(v))
        self.model_type = model_type or found.get(3, UNIGRAM)
        plain = [i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.pieces = {i: p for p, i in self.ids.items()}
        self.score = {i: sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(len(sp)) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.unknown_score = min(self.score.values()) - 10
        self.pairs = _Pairs(self)
        self.rank = {p: self.score[i] for p, i in self.ids.items()}
        self.root: dict = {}
        for piece, i in self.ids.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.known: dict[str, bytes] = {}
        self.piece_bytes = pa.array([bytes([self.of_byte[i]]) if i in self.of_byte else self.pieces.get(i, "").replace(MARK, " ").encode("utf-8", "surrogatepass") for i in range(len(sp))], pa.binary())

    def merged(self, text: str) -> list[str]:
        """The merges themselves: of neighbours whose union is a piece, the one of the highest score, leftmost first."""
        parts, rank, none = list(text), self.rank.get, float("-inf")
        scores = [rank(x + y, none) for x, y in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(scores):
                scores[k] = rank(parts[k] + parts[k + 1], none)
        return parts

    def merge_step(self, c: str, n: int, state: tuple) -> tuple:
        """The state of n characters for a BPE model, from the one before and the character c. Last piece: -1 for an unknown character, -2 where the prefix has no encoding of its own, -3 for the empty prefix."""
        pairs, last, at, open_ = self.pairs, None, n - 1, []
        for start, u, node in state[3]:
            if (node := node.get(c)) is not None:
                open_.append((start, u, node))
                # an unknown character merges with nothing
                if last is None and (t := node.get("")) is not None and (u == -3 or u == -1 or u >= 0 and pairs[u, t]):
                    last, at = t, start
        if last is None:
            last = -2 if c in self.ids else -1
        open_.append((n, last, self.root))
        return 0.0, last, at, open_

    def score_step(self, c: str, n: int, state: tuple) -> tuple:
        """The same for a unigram model: the best sum of scores; a place carries its score instead of its last piece."""
        best, open_ = None, []
        for start, score, node in state[3]:
            if (node := node.get(c)) is not None:
                open_.append((start, score, node))
                if (t := node.get("")) is not None and (best is None or score + self.score[t] > best[0]):
                    best = (score + self.score[t], t, start)
        if c not in self.ids:
            other = (state[0] + self.unknown_score, -1, n - 1)
            best = other if best is None or other[0] > best[0] else best
        open_.append((n, best[0], self.root))
        return *best, open_

    def back(self, word: str, states: list[tuple]) -> list[int]:
        out, n = [], len(word)
        while n:
            _, t, start, _ = states[n]
            if t == -2:  # merge outright
                return [i for p in self.merged(word) for i in ([self.ids[p]] if p in self.ids else self.fallback(p))]
            if t >= 0:
                out.append(t)
            else:
                out.extend(reversed(self.fallback(word[start:n])))
            n = start
        out.reverse()
        return out

    def fallback(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of distinct marked words: in sorted order a depth-first walk of their trie, in which a word keeps the states of the prefix that it shares with the one before.

        A state is (score, last piece, where that starts, places); places are (start, its last piece or score, node of
        the trie of pieces) of the pieces that may go on, the longest first.
        """
        step, first = (self.merge_step, -3) if self.model_type == BPE else (self.score_step, 0.0)
        out, before, states = {}, "", [(0.0, -3, 0, [(0, first, self.root)])]
        for word in sorted(set(words)):
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del states[same + 1 :]
            state = states[same]
            for n, c in enumerate(word[same:], same + 1):
                states.append(state := step(c, n, state))
            out[word] = array("I", self.back(word, states)).tobytes()
            before = word
        return out

    def encode_texts(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text. Words are looked up once for all texts; the model keeps those that it has met, and forgets all when there are over MOST_WORDS."""
        lists = split_words(texts)
        found = lists.flatten().dictionary_encode()
        words = found.dictionary.to_pylist()
        if len(self.known) + len(words) > MOST_WORDS:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        new = self.encode_words([MARK + w for w in fresh])
        self.known.update((w, new[MARK + w]) for w in fresh)
        each = [self.known[w] for w in words]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        of_word = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(each), np.int32))
        codes = found.indices.to_numpy()
        ends = np.append(0, np.cumsum(sizes[codes]))[lists.offsets.to_numpy()]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), of_word.take(found.indices).flatten())

    def decode_lists(self, lists: pa.ListArray) -> list[bytes | None]:
        """The text of each list of ids in UTF-8: its pieces side by side, marks as spaces but for the one that begins it. What is no UTF-8 becomes U+FFFD; null stays null."""
        taken = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py()), self.piece_bytes.take(lists.flatten())) if len(lists) else pa.array([], pa.list_(pa.binary()))
        joined = pc.binary_join(taken, b"").to_pylist()
        null = lists.is_null().to_pylist()
        return [None if n else (x[1:] if x[:1] == b" " else x) if x.isascii() else _valid(x[1:] if x[:1] == b" " else x) for x, n in zip(joined, null)]


def _valid(x: bytes) -> bytes:
    try:
        x.decode("utf-8")
        return x
    except UnicodeDecodeError:
        return x.decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def marked_words(text: str) -> list[str]:
    return WORD.findall((MARK + text).replace(" ", MARK)) if text else []


def split_words(texts: pa.Array) -> pa.ListArray:
    """The marked words of each text, each without its first mark; none for null and empty texts."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    plain = pc.split_pattern(texts, " ")
    # runs of spaces, spaces at the ends and marks in the text itself
    odd = pc.match_substring_regex(texts, f"^ |  | $|^$|{MARK}")
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if not len(at):
        return plain
    others = pa.array([[w[1:] for w in marked_words(t)] for t in texts.take(pa.array(at)).to_pylist()], plain.type)
    order = np.arange(len(texts))
    order[at] = len(texts) + np.arange(len(at))
    return pa.concat_arrays([plain, others]).take(pa.array(order))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: id_col and ids (array of int), as the sentencepiece library gives them for the whole text.

    Null and empty texts have no ids; repeated rows are encoded each; a mark character in a text counts as a space; an
    empty table gives an empty result. Rows stay where they are: a Python worker sorts the distinct words of about 8 MB
    of text that it doesn't know yet.
    """
    kind = dict(docs.dtypes)[id_col]

    def batches(it):
        model = piece_model(model_path)
        for b in it:
            for part in slices(b, AT_ONCE):
                yield pa.RecordBatch.from_arrays([part.column(0), model.encode_texts(part.column(1))], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """For every row of encode's result: id_col, text; null ids give a null text."""
    kind = dict(encoded.dtypes)[id_col]

    def batches(it):
        model = piece_model(model_path)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.decode_lists(b.column(1)), pa.binary()).cast(pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(batches, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode, its result read back in the same pass: id_col, n_tokens, ids_crc32 (as packing has it), and the SHA-256 of the text decoded from the ids."""
    kind = dict(docs.dtypes)[id_col]

    def batches(it):
        model = piece_model(model_path)
        for b in it:
            for part in slices(b, AT_ONCE):
                lists = model.encode_texts(part.column(1))
                ids = np.split(lists.values.to_numpy(), lists.offsets.to_numpy()[1:-1])
                sha = [hashlib.sha256(x).hexdigest() for x in model.decode_lists(lists)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(sha, pa.string())], [id_col, "n_tokens", "ids_crc32", "text_sha256"])

    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, n_tokens long, ids_crc32 long, text_sha256 string")
