"""Lexical retrieval packing: a document's window is filled up with what a BM25 index finds nearest to it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreduce.llm.shared import materialize
from tsreduce.llm.shingles import counted, distinct
from tsreduce.llm.tokens import byte_bpe, slices

COLUMNS = {"start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
K1, B = 1.2, 0.75


@dataclass
class Corpus:
    """What BM25 needs of all documents: how many there are, their mean length, and in how many each token occurs."""

    documents: int
    mean_length: float
    df: np.ndarray

    def weights(self, terms: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What each term, which occurs tf times in a document of this length, adds to that document's score."""
        df = self.df[terms]
        idf = np.log1p((self.documents - df + 0.5) / (df + 0.5))
        return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(self.mean_length, 1)))).astype(np.float32)


def scores(docs: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """(seed, document): the BM25 score of each document of a shard for all distinct terms of each seed; the last id of a document, which ends it, tells nothing.

    Postings of terms that a 16th of the shard has are a dense matrix, whose product gives all seeds' scores; those of
    rarer terms are met term by term.
    """
    n = len(docs)
    of_doc = [counted(d[:-1]) for d in docs]
    sizes = np.array([len(t) for t, _ in of_doc], np.int64)
    terms = np.concatenate([t for t, _ in of_doc]).astype(np.int64) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), sizes)
    lengths = np.array([len(d) for d in docs], np.float64)
    weight = corpus.weights(terms, np.concatenate([c for _, c in of_doc]).astype(np.float64), lengths[owner]) if n else np.zeros(0, np.float32)
    order = np.argsort(terms, kind="stable")
    _, start, df = np.unique(terms[order], return_index=True, return_counts=True)
    slot = np.empty(len(order), np.int64)
    slot[order] = np.repeat(np.arange(len(df)), df)
    dense = df * 16 >= n
    column = np.cumsum(dense) - 1
    at = np.flatnonzero(dense[slot])
    m = np.zeros((n, int(dense.sum())), np.float32)
    m[owner[at], column[slot[at]]] = weight[at]
    out = (m > 0).astype(np.float32) @ m.T
    # each pair of postings of a rare term, so many at a time
    posting_doc, posting_weight = owner[order], weight[order]
    rare = np.flatnonzero(~dense & (df > 1))
    pairs = np.cumsum(df[rare] ** 2)
    edges = [0, *np.searchsorted(pairs, np.arange(1 << 22, int(pairs[-1]), 1 << 22)).tolist(), len(rare)] if len(rare) else [0]
    for x, y in zip(edges[:-1], edges[1:]):
        k = df[rare[x:y]]
        first = np.repeat(start[rare[x:y]], k)  # of each posting, where its term's begin
        seed = posting_doc[first + np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k)]
        times = np.repeat(k, k)
        hit = np.repeat(first, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        out += np.bincount(np.repeat(seed, times) * n + posting_doc[hit], posting_weight[hit], n * n).reshape(n, n).astype(np.float32)
    np.fill_diagonal(out, 0)
    return out


class Packer:
    """Fills windows of one task, shard after shard; only the task's last window is left short."""

    def __init__(self, window: int, task: int) -> None:
        self.window, self.sequence, self.used = window, task << 33, 0

    def place(self, doc: int, ids: np.ndarray, out: list) -> bool:
        """Whether this began a new window, of which doc is the seed."""
        start, began = 0, self.used == 0
        while start < len(ids):
            n = min(len(ids) - start, self.window - self.used)
            out.append((doc, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), self.sequence, self.used))
            start, self.used = start + n, self.used + n
            if self.used == self.window:
                self.sequence, self.used, began = self.sequence + 1, 0, True
        return began

    def pack(self, docs: list[np.ndarray], corpus: Corpus) -> list[tuple]:
        """Pieces (document's place, start, length, crc, doc_tokens, sequence_id, offset) of a shard.

        The seed of a window is what it begins with; it stays the query until the window is full. Of equal scores the
        first document is taken, and the next unused one where none shares a term.
        """
        near, unused, out, seed, cursor = scores(docs, corpus), np.ones(len(docs), np.float32), [], -1, 0
        for _ in docs:
            best = int((near[seed] * unused).argmax()) if seed >= 0 else -1
            if best < 0 or near[seed, best] * unused[best] <= 0:
                while not unused[cursor]:
                    cursor += 1
                best = cursor
            unused[best] = 0
            if self.place(best, docs[best], out):
                seed = best if self.used else -1
        return out


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(id, tokens, first, second) of every row: its tokens as little-endian unsigned integers, and the two with the largest ids.

    From each task also (token, n): in how many of its documents a token occurs, with token -1 for documents and -2 for their tokens.
    """
    kind, names = dict(docs.dtypes)[id_col], ["id", "tokens", "first", "second", "token", "n"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        df, documents, length, none = np.zeros(bpe.size, np.int64), 0, 0, None
        for b in (x for whole in it for x in slices(whole)):
            none = b.column(0).slice(0, 0)
            ids, offsets = bpe.encode_texts(b.column(1))
            top = np.full((b.num_rows, 2), -1, np.int32)
            for k, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                met = distinct(ids[x:y])
                df[met] += 1
                top[k, : len(met)] = met[:-3:-1]
            documents, length = documents + b.num_rows, length + len(ids) + b.num_rows
            ended = np.insert(ids.astype(bpe.dtype), offsets[1:], end_id)
            bounds = (offsets + np.arange(len(offsets))) * bpe.dtype.itemsize
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(bounds), pa.py_buffer(ended)]).cast(pa.binary())
            null = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), made, pa.array(top[:, 0]), pa.array(top[:, 1]), null, null], names)
        if none is not None:
            met = np.flatnonzero(df)
            tokens, n = np.concatenate([met, [-1, -2]]), np.concatenate([df[met], [documents, length]])
            nulls = (pa.nulls(len(n), t) for t in (none.type, pa.binary(), pa.int32(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(tokens), pa.array(n)], names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, f"id {kind}, tokens binary, first int, second int, token long, n long")


def corpus_of(counts: DataFrame, size: int) -> Corpus:
    """Sums over all tasks; at most as many rows as the vocabulary has."""
    found = {r["token"]: r["n"] for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    documents, length = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(size, np.int64)
    df[list(found)] = list(found.values())
    return Corpus(documents, length / max(documents, 1), df)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, window: int = 1024, end_id: int = 0, shard_docs: int = 2048, shard_tokens: int = 4_000_000) -> DataFrame:
    """Pieces of documents by sequence: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its whole text by the byte-level BPE file `tokenizer`, then end_id; a control string in a
    text is ordinary text. A window takes a seed and its best unused BM25 neighbours until it is full; the last of them
    is cut there and goes on as the next window's seed. All distinct terms of the seed are asked for; document
    frequencies and the mean length are those of all documents.

    The index is sharded: documents are sorted over all tasks by their two terms of the largest ids (the vocabulary's
    last merges, so mostly rare ones), that those which share them meet, and a shard is shard_docs of them in a row, or fewer with shard_tokens in all (one document may have more). A seed meets the
    documents of its shard; those of others aren't asked. A partition's last window alone may be short. Null texts are
    empty and give end_id alone; repeated rows are packed each; ties go to the earlier row; an empty table gives an
    empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    made = materialize(tokenized(docs, tokenizer, id_col, text_col, end_id), "tokens", compression="zstd")
    corpus = corpus_of(made.where("token IS NOT NULL").select("token", "n"), byte_bpe(tokenizer).size)
    rows = made.where("token IS NULL")
    sent = docs.sparkSession.sparkContext.broadcast(corpus)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, dtype = Packer(window, TaskContext.get().partitionId()), byte_bpe(tokenizer).dtype
        ids, held, tokens = [], [], 0

        def done():
            keys = pa.concat_arrays(ids)
            columns = list(zip(*packer.pack(held, sent.value)))
            return pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], COLUMNS.values()))], [id_col, *COLUMNS])

        for b in it:
            ids.append(b.column(0).slice(0, 0))
            first = 0
            for i, x in enumerate(b.column(1)):
                held.append(np.frombuffer(x.as_buffer(), dtype))
                tokens += len(held[-1])
                if len(held) >= shard_docs or tokens >= shard_tokens:
                    ids.append(b.column(0).slice(first, i + 1 - first))
                    yield done()
                    ids, held, tokens, first = [], [], 0, i + 1
            ids.append(b.column(0).slice(first))
        if held:
            yield done()

    # documents with the same terms may be many: their ids spread them too
    order = ["first", "second", "id"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "tokens")
    return dealt.mapInArrow(batches, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COLUMNS))
