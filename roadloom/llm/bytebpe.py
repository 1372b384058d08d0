"""Byte-level BPE: each distinct word of the corpus is encoded once, its ids are joined back and put in order by position."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import SPLIT, asked, first_buckets
from .textkit import block_numbers, table_buckets, trim, written_in_buckets

#: Text of one block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Text for each bucket of the table of blocks.
TABLE_BYTES = 16 << 20
#: Text for each bucket of distinct words.
BUCKET_BYTES = 8 << 20
_LOADED: dict[tuple, object] = {}
_T1 = "kind int, block long, bucket long, payload binary"


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a .tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _LOADED:
        import regex
        import tiktoken

        ranks = ranks_of(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        decimals = [b"%d" % i for i in range(len(table))]
        _LOADED[path, pattern] = regex.compile(pattern), tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table, decimals
    return _LOADED[path, pattern]


def _squeeze(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    """Arrays of unsigned 32-bit integers (bytes of equal rank together, so they compress) or bytes, each with its size."""
    import zstandard

    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    head = np.array([len(r) for r in raw], "<u8").tobytes()
    return zstandard.ZstdCompressor(level).compress(np.array([len(raw)], "<u8").tobytes() + head + b"".join(raw))


def _expand(payload: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(data, "<u8", 1)[0])
    ends = [8 + 8 * n, *(np.frombuffer(data, "<u8", n, 8).cumsum() + 8 + 8 * n).tolist()]
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _block_rows(block: int, ids: list, texts: list[str], words_in, buckets: int) -> Iterator[tuple]:
    """Rows of one block: its words by position (kind 0) and, for each bucket, its distinct words (kind 1)."""
    found = [words_in(t) for t in texts]
    count: Counter[str] = Counter()
    for w in found:
        count.update(w)
    items = sorted(count.items())
    items.sort(key=itemgetter(1), reverse=True)
    words = [w for w, _ in items]  # frequent ones first; the many rare ones stand in alphabetical order, which compresses
    place = dict(zip(words, range(len(words)), strict=True)).__getitem__
    sequence = np.fromiter(map(place, chain.from_iterable(found)), np.uint32, sum(map(len, found)))
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    bucket = np.array([zlib.crc32(w) % buckets for w in raw], np.uint32)
    yield 0, block, -1, _squeeze(np.array([len(f) for f in found], np.uint32), sequence, bucket), ids
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield 1, block, b, _words([raw[i] for i in order[edges[b] : edges[b + 1]].tolist()]), None


def _words(words: list[bytes]) -> bytes:
    return _squeeze(np.array([len(w) for w in words], np.uint32), b"".join(words), level=9)


def _read_words(payload: bytes) -> list[bytes]:
    sizes, raw = _expand(payload)
    ends = [0, *np.cumsum(_numbers(sizes), dtype=np.int64).tolist()]
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _codes(words: list[bytes], of: dict[bytes, list[int]]) -> bytes:
    """Ids of words in their order: how many each has, and all of them."""
    ids = list(map(of.__getitem__, words))
    return _squeeze(np.fromiter(map(len, ids), np.uint32, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids))))


def _read_codes(payload: bytes) -> Iterator[list[int]]:
    lengths, ids = map(_numbers, _expand(payload))
    ids, at = ids.tolist(), 0
    for n in lengths.tolist():
        yield ids[at : at + n]
        at += n


def _distinct(table: pa.Table, level: int) -> dict[int, list[bytes]]:
    """The distinct words of all rows, in order, by the bucket of the next level."""
    out: dict[int, list[bytes]] = {}
    for w in sorted(set().union(*map(_read_words, table["payload"].to_pylist()))):
        out.setdefault(zlib.crc32(w[::-1] + bytes([level])) % SPLIT, []).append(w)  # from the other end, so that parts do not follow buckets
    return out


def merge_words(table: pa.Table, level: int) -> list[tuple[int, bytes, bytes]]:
    return [(part, _words(words), b"") for part, words in _distinct(table, level).items()]


def spread_codes(table: pa.Table, answers: list[tuple[int, bytes]], level: int) -> list[bytes]:
    of: dict[bytes, list[int]] = {}
    words = _distinct(table, level)
    for part, payload in answers:
        of.update(zip(words[part], _read_codes(payload), strict=True))
    return [_codes(_read_words(p), of) for p in table["payload"].to_pylist()]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; with ``with_ids`` also ids (array) and decoded (binary).

    Each match of ``pattern`` is a word. Texts stay where they are read: a block of them
    becomes the places of its words, and its distinct words are dealt by a hash and merged
    with those of other blocks (see ``exchange.asked``). The task of a hash bucket encodes
    each distinct word of the whole corpus once; the ids go back to the blocks, where they
    are put in order by position, and the token-byte table turns them into bytes again. A
    very frequent word is one entry for each block, however often it occurs, and one for
    each FAN blocks behind the first merge, so no task hears of it from every block. The blocks are written once, laid out by block, so that only distinct words
    and their ids are shuffled. Null texts count as empty (no tokens); null ids and repeated rows stay as
    they are; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = first_buckets(total, BLOCK_BYTES, BUCKET_BYTES)
    table_size = table_buckets(docs.sparkSession, -(-total // TABLE_BYTES))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pattern_of, *_ = _encoding(ranks_path, pattern)
        numbers = block_numbers(TaskContext.get().partitionId(), table_size)
        block, held, ids, texts = next(numbers), 0, [], []
        arrow = None

        def flush():
            out = list(_block_rows(block, ids, texts, pattern_of.findall, buckets))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.binary()), pa.array([r[4] for r in out], pa.list_(arrow))],
                names=["kind", "block", "bucket", "payload", "ids"],
            )

        for batch in batches:
            arrow = batch.column(0).type
            for i, size in enumerate(pa.compute.binary_length(batch.column(1)).to_pylist()):
                if held and held + size > BLOCK_BYTES:
                    yield flush()
                    block, held, ids, texts = next(numbers), 0, [], []
                ids.append(batch.column(0)[i].as_py())
                texts.append(batch.column(1)[i].as_py())
                held += size + 1
        if ids:
            yield flush()
        trim()

    import pyarrow.compute  # noqa: F401

    parts = written_in_buckets(rows.mapInArrow(blocks, f"{_T1}, ids array<{id_type}>"), "block", table_size)

    def encode(table: pa.Table) -> list[bytes]:
        """The ids of each distinct word of a bucket, once; then of the words of each row, in their order."""
        _, coder, *_ = _encoding(ranks_path, pattern)
        rows = [_read_words(p) for p in table["payload"].to_pylist()]
        known = {w: coder._encode_single_piece(w) for w in set().union(*rows)}
        return [_codes(r, known) for r in rows]

    asks = parts.where("kind = 1").select("block", "bucket", "payload", F.lit(None).cast("binary").alias("extra"))
    coded = asked(asks, parts.where("kind = 0").count(), merge_words, encode, spread_codes)

    def assemble(places: pa.Table, coded: pa.Table) -> pa.Table:
        _, _, table, decimals = _encoding(ranks_path, pattern)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
        counts, sequence, bucket = map(_numbers, _expand(places["payload"][0].as_py()))
        n_words = len(bucket)
        number, decimal, plain = np.zeros(n_words, np.int64), [b""] * n_words, [b""] * n_words
        exact = [()] * n_words
        order = np.argsort(bucket, kind="stable")
        edge = {b: (i, i + n) for b, i, n in zip(*map(np.ndarray.tolist, np.unique(bucket[order], return_index=True, return_counts=True)), strict=True)}
        for b, payload in zip(coded["bucket"].to_pylist(), coded["payload"].to_pylist(), strict=True):
            for i, own in zip(order[slice(*edge[b])].tolist(), _read_codes(payload), strict=True):
                number[i] = len(own)
                decimal[i] = b" ".join([decimals[x] for x in own])
                plain[i] = b"".join([table[x] for x in own])
                if with_ids:
                    exact[i] = own
        tokens, ids_sha, decoded_sha, all_ids, decoded = [], [], [], [], []
        sequence_list = sequence.tolist()
        for a, b in zip([0, *accumulate(counts.tolist())], accumulate(counts.tolist()), strict=False):
            own = sequence_list[a:b]
            tokens.append(int(number[sequence[a:b]].sum()))
            ids_sha.append(hashlib.sha256(b" ".join([decimal[i] for i in own])).hexdigest())
            text = b"".join([plain[i] for i in own])
            decoded_sha.append(hashlib.sha256(text).hexdigest())
            if with_ids:
                all_ids.append([x for i in own for x in exact[i]])
                decoded.append(text)
        trim()
        columns = [places["ids"].combine_chunks().flatten(), pa.array(tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
        return pa.Table.from_arrays([*columns, *[pa.array(all_ids, pa.list_(pa.int64())), pa.array(decoded, pa.binary())] * with_ids], names=names)

    schema = f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * with_ids
    places = parts.where("kind = 0").select("block", "payload", "ids")
    return places.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, schema)
