"""Encoding a whole corpus with a public byte-level BPE vocabulary, and decoding it.

Method: a global distinct-word shuffle. Every chunk of documents is cut into pre-tokens
(:mod:`.pretokens`); a chunk keeps the *positions* of its words as codes into its own list
of distinct words. The distinct words of all chunks are shuffled by their bytes, so that all
occurrences of a word meet in one task and it is encoded once; its ids go back to the chunks
by (chunk, code), where the texts are reassembled by position.

What is shuffled is one row per distinct word *and chunk*, never one per occurrence, so a word
that makes up a third of the corpus weighs as much as any other; positions travel as one
compressed block per chunk. Nothing is broadcast but the path of the vocabulary file.

Defined results: null and empty texts give an empty list; blank texts, odd Unicode and the
strings of special tokens are ordinary text; repeated rows each give their row; an empty table
gives an empty result. Text columns other than ``text`` and extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm import pretokens
from lodevec.session import stage

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK_BYTES = 16 << 20  # text of one chunk; a longer text is a chunk of its own


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def encoder(path: str):
    """Encodes the bytes of one pre-token to its ids."""
    import tiktoken

    one = tiktoken.Encoding("lodevec", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})
    return one._core_bpe.encode_single_piece  # noqa: SLF001


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows gathered to about ``most`` bytes of the column ``text``."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        for i, j in pretokens.slices(t["text"], most):
            part = t.slice(i, j - i)
            n = int(pretokens.buffer_of(part["text"])[1][-1])
            if held and size + n > most:
                yield pa.concat_tables(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.concat_tables(held)


def flat_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    off = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


def gather(lists_off: np.ndarray, values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists named by ``codes``, one after the other, and their lengths."""
    n = np.diff(lists_off)[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    step = np.ones(total, np.int64)
    at = lists_off[:-1][codes]
    keep = n > 0
    if total:
        s, c = at[keep], n[keep]
        pos = np.cumsum(c) - c
        step[pos] = s
        step[pos[1:]] -= s[:-1] + c[:-1] - 1
        return values[np.cumsum(step)], n
    return values[:0], n


def _cut(most: int):
    schema = pa.schema([("chunk", pa.int64()), ("code", pa.int32()), ("word", pa.binary()), ("block", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        z = zstandard.ZstdCompressor(level=1)
        part, seq = TaskContext.get().partitionId(), 0
        for t in chunks(batches, most):
            b, off = pretokens.buffer_of(t["text"])
            d, per_row = pretokens.words(b, off)
            chunk = (part << 32) | seq
            seq += 1
            codes = d.indices.to_numpy().astype(np.uint32)
            # byte planes compress well: most codes are small
            planes = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T).tobytes()
            ids = t["doc_id"].combine_chunks()
            null = np.asarray(ids.is_null())
            head = np.array([len(ids), len(codes)], np.int64).tobytes()
            block = z.compress(head + np.asarray(ids.fill_null(0), np.int64).tobytes() + null.tobytes() + per_row.astype(np.int64).tobytes() + planes)
            n = len(d.dictionary)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([block], pa.binary())], schema=schema)
            for i in range(0, n, 50_000):
                m = min(50_000, n - i)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), pa.array(np.arange(i, i + m, dtype=np.int32)), d.dictionary.slice(i, m).cast(pa.binary()), pa.nulls(m, pa.binary())], schema=schema)

    return run


def _encode_words(path: str):
    def run(batches):
        enc, known = encoder(path), {}
        for b in batches:
            d = b.column("word").dictionary_encode()
            lists = []
            for w in d.dictionary.to_pylist():
                got = known.get(w)
                if got is None:
                    got = known[w] = np.array(enc(w), np.int32)
                lists.append(got)
            counts = np.array([len(x) for x in lists], np.int64)
            off = np.append(0, np.cumsum(counts))
            vals, n = gather(off, np.concatenate(lists) if lists else np.zeros(0, np.int32), d.indices.to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("code"), flat_lists(vals, n, pa.int32())], names=["chunk", "code", "ids"])

    return run


def _reassemble(key, blocks: pa.Table, words: pa.Table) -> pa.Table:
    z = zstandard.ZstdDecompressor()
    order = np.argsort(words["code"].to_numpy())
    lists = words["ids"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    off, vals = lists.offsets.to_numpy(), lists.values.to_numpy()
    if not len(order):
        off = np.zeros(1, np.int64)
    parts = []
    for raw in blocks["block"].to_pylist():
        data = z.decompress(raw)
        n, m = np.frombuffer(data, np.int64, 2)
        p = 16
        ids = np.frombuffer(data, np.int64, n, p)
        null = np.frombuffer(data, bool, n, p + 8 * n)
        per_row = np.frombuffer(data, np.int64, n, p + 9 * n)
        planes = np.frombuffer(data, np.uint8, 4 * m, p + 17 * n).reshape(4, m)
        codes = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
        got, counts = gather(off.astype(np.int64), vals, order[codes])
        ends = np.append(0, np.cumsum(counts))
        row_ends = np.append(0, np.cumsum(per_row))
        per_doc = ends[row_ends[1:]] - ends[row_ends[:-1]]
        parts.append(pa.table({"doc_id": pa.array(ids, mask=null), "ids": flat_lists(got.astype(np.int32), per_doc, pa.int32())}))
    return pa.concat_tables(parts)


def encode_corpus(docs: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(doc_id bigint, ids array<int>)``: one row for each row of ``docs(doc_id, text)``."""
    path = path or vocabulary_path()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = stage(src.mapInArrow(_cut(chunk_bytes), "chunk long, code int, word binary, block binary"), "words")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = cut.where("block is null").select("chunk", "code", "word").repartition(n, "word").mapInArrow(_encode_words(path), "chunk long, code int, ids array<int>")
    blocks = cut.where("block is not null").select("chunk", "block")
    return blocks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lambda k, a, b: _reassemble(k, a, b), "doc_id long, ids array<int>")


def _decode(path: str, ids_name: str):
    def run(batches):
        table = ranks(path)
        size = max(table.values()) + 1
        by_id = [b""] * size
        for w, i in table.items():
            by_id[i] = w
        lens = np.array([len(w) for w in by_id], np.int64)
        off = np.append(0, np.cumsum(lens))
        raw = np.frombuffer(b"".join(by_id), np.uint8)
        for b in batches:
            lists = b.column(ids_name)
            lists = lists.fill_null([]) if lists.null_count else lists
            vals = lists.flatten().to_numpy().astype(np.int64)
            per = np.asarray(lists.value_lengths())
            got, n = gather(off, raw, vals)
            ends = np.append(0, np.cumsum(n))
            rows = np.append(0, np.cumsum(per))
            bounds = ends[rows]
            texts = [got[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_corpus(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)`` by the token-byte table of the vocabulary.

    The table is part of the vocabulary file (about 50,000 rows whatever the corpus), so each
    task joins it from the file. Null ids decode to an empty text.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path or vocabulary_path(), "ids"), "doc_id long, text string")


def _count(path: str, most: int, keep: int, extra: list[str]):
    def run(batches):
        enc, known = encoder(path), {}
        for t in chunks(batches, most):
            b, off = pretokens.buffer_of(t["text"])
            d, per_row = pretokens.words(b, off)
            n = np.empty(len(d.dictionary), np.int64)
            for k, w in enumerate(d.dictionary.to_pylist()):
                got = known.get(w)
                if got is None:
                    got = len(enc(w))
                    if len(known) < keep:
                        known[w] = got
                n[k] = got
            ends = np.append(0, np.cumsum(n[d.indices.to_numpy()]))
            rows = np.append(0, np.cumsum(per_row))
            counts = ends[rows[1:]] - ends[rows[:-1]]
            out = t.select(extra).append_column("n_tokens", pa.array(counts, pa.int64()))
            yield from out.to_batches()

    return run


def token_counts(docs: DataFrame, extra: list[str], path: str | None = None) -> DataFrame:
    """``extra`` columns and ``n_tokens`` of each row's text, in one narrow stage.

    Each task encodes a distinct pre-token once (up to a fixed number of remembered words,
    beyond which a word is encoded again); null and empty texts have 0 tokens.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    src = docs.select(*extra, F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_count(path or vocabulary_path(), 4 << 20, 1_000_000, extra), f"{schema}, n_tokens long")
