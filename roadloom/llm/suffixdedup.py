"""Repeated passages across documents by difference-cover suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ASK, SPLIT, asked, first_buckets
from .textkit import block_numbers, byte_runs, fresh, gram_hash, mix64, prefix_hash, row_key, span_hash, table_buckets, trim, written, written_in_buckets

#: Bytes of a passage.
LENGTH = 50
#: Bytes of the grams whose smallest hash in a passage decides where its suffixes are sorted.
GRAM = 24
WINDOW = LENGTH - GRAM + 1
#: Text of one block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Text for each bucket of the table of blocks.
TABLE_BYTES = 16 << 20
#: Text for each bucket in which suffixes are sorted.
BUCKET_BYTES = 2 << 20
#: Stretches around one minimiser, over all blocks, that fill half a bucket by themselves; with more of them its strings are dealt one by one.
HEAVY = BUCKET_BYTES // (2 * (LENGTH + WINDOW))
_BITS = np.uint64((1 << 48) - 1)
_NEVER = np.int64((1 << 63) - 1)
#: Bytes whose hashes are held at once.
_STEP = 1 << 19


# Difference cover --------------------------------------------------------------------------------


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each triple among the distinct ones, from 1, and how many there are."""
    bits = max(int(x.max(initial=0)) for x in (a, b, c)).bit_length()
    if 3 * bits <= 64:
        key = (a.astype(np.uint64) << np.uint64(2 * bits)) | (b.astype(np.uint64) << np.uint64(bits)) | c.astype(np.uint64)
        order = np.argsort(key)
        new = key[order[1:]] != key[order[:-1]]
    else:
        order = np.lexsort((c, b, a))
        new = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
    rank = np.empty(len(a), np.int64)
    rank[order] = np.concatenate([[1], 1 + np.cumsum(new)]) if len(a) else rank
    return rank, int(rank.max(initial=0))


def difference_cover(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s`` (positive integers).

    Suffixes at places 1 and 2 modulo 3 are named by their sorted triples; while names are
    not distinct, the string of names is sorted the same way. Suffixes at places 0 modulo 3
    are sorted by a value and the rank behind it, and merged by two binary searches, one
    for each kind of sampled suffix.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    if s.max() >= 1 << 31:  # products of values and ranks must fit 64 bits
        s = np.unique(s, return_inverse=True)[1] + 1
    t = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # with an empty suffix where no triple of the first kind would end the string
    sample = np.concatenate([one, two])
    name, kinds = _names(t[sample], t[sample + 1], t[sample + 2])
    ordered = sample[difference_cover(name) if kinds < len(sample) else np.argsort(name)]
    rank = np.zeros(n + 3, np.int64)
    rank[ordered] = np.arange(1, len(ordered) + 1)
    ordered = ordered[ordered < n]
    zero, shift = np.arange(0, n, 3), np.int64(len(sample) + 2)
    key = t[zero] * shift + rank[zero + 1]
    zero, key = (x[np.argsort(key)] for x in (zero, key))
    low, high = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before = np.searchsorted(t[low] * shift + rank[low + 1], key)
    pair, most = t[:n] * (t.max() + 1) + t[1 : n + 1], int(t.max()) + 1
    if most * most * int(shift) >= 1 << 63:
        pair = np.unique(pair, return_inverse=True)[1]
    before += np.searchsorted(pair[high] * shift + rank[high + 2], pair[zero] * shift + rank[zero + 2])
    out, rest = np.empty(n, np.int64), np.ones(n, bool)
    at = before + np.arange(len(zero))
    rest[at] = False
    out[at], out[rest] = zero, ordered
    return out


# Minimisers --------------------------------------------------------------------------------------


class Runs:
    """Of a block of texts: runs of passage starts that share a minimiser, as arrays.

    ``doc``: the text, ``start`` and ``size``: first passage of the run and their number,
    ``value``: the minimiser, ``text``: a hash of all bytes that the run's passages cover.
    """

    def __init__(self, texts: list[bytes]):
        parts: list[tuple[np.ndarray, ...]] = []
        # a long text goes piece by piece, each with the bytes that its last passages reach into the next one
        pieces = [(d, at, t[at : at + _STEP + LENGTH - 1]) for d, t in enumerate(texts) for at in range(0, max(len(t) - LENGTH + 1, 1), _STEP)]
        for a, b in byte_runs([len(p[2]) for p in pieces], _STEP):
            data = np.frombuffer(b"\n".join([p[2] for p in pieces[a:b]]) + b"\n", np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(p[2]) + 1 for p in pieces[a:b]])])
            n = len(data) - LENGTH
            if n <= 0:
                continue
            h = prefix_hash(data)
            m = gram_hash(h, GRAM) & _BITS
            size = 1
            while size * 2 <= WINDOW:
                m = np.minimum(m[:-size], m[size:])
                size *= 2
            m = np.minimum(m[: len(m) - (WINDOW - size)], m[WINDOW - size :])[:n]
            valid = np.ones(n, bool)
            for e in starts[1:]:  # passages must end before the line feed that joins
                valid[max(e - LENGTH, 0) : e] = False
            edge = np.concatenate([[True], (m[1:] != m[:-1]) | (valid[1:] != valid[:-1]), [True]])
            edge[starts[:-1][starts[:-1] < n]] = True
            at = np.flatnonzero(edge)
            begin, end = at[:-1], at[1:]
            ok = valid[begin]
            begin, end = begin[ok], end[ok]
            piece = np.searchsorted(starts, begin, side="right") - 1
            doc, offset = (np.array([p[k] for p in pieces[a:b]], np.int64)[piece] for k in (0, 1))
            parts.append((doc, offset + begin - starts[piece], end - begin, m[begin], span_hash(h, begin, end + LENGTH - 1)))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        self.doc, self.start, self.size, self.value, self.text = joined

    def keep(self, which: np.ndarray) -> None:
        for name in ("doc", "start", "size", "value", "text"):
            setattr(self, name, getattr(self, name)[which])


def _planes(x: np.ndarray) -> bytes:
    """64-bit values, bytes of equal weight together, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _values(raw: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _zip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(3).compress(raw)


def _unzip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _dealt(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _part(value: np.ndarray, level: int) -> np.ndarray:
    """The bucket of the next level within SPLIT."""
    return (mix64(value + np.uint64(0x51ED27 + level)) >> np.uint64(40)).astype(np.int64) % SPLIT


def _groups(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, where it is) for each bucket that is there, in the order of buckets."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket, kind="stable")  # 16 bits are sorted by their digits
    inside = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
    yield from zip(inside[first].tolist(), np.split(order, first[1:]), strict=True)


def _grouped(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal values are together, and where in it each distinct one begins. Faster than a stable sort, as ``np.unique`` with indices has."""
    order = np.argsort(value)
    inside = value[order]
    return order, np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]])) if len(value) else np.zeros(0, np.int64)


def _inner(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``sizes`` in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def distinct_spans(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each distinct span of bytes, in the order of their hashes, and which of these each span is.

    Spans of one hash are compared byte by byte; should two differ, hashes are not used.
    """
    order, group = _grouped(span_hash(prefix_hash(data), begin, begin + size))
    first = np.minimum.reduceat(order, group) if len(group) else group
    inverse = np.empty(len(begin), np.int64)
    inverse[order] = np.repeat(np.arange(len(group)), np.diff(np.append(group, len(order))))
    own = np.flatnonzero(first[inverse] != np.arange(len(begin)))
    for a, b in byte_runs(size[own].tolist(), _STEP):
        x = own[a:b]
        y = first[inverse[x]]
        inner = _inner(size[x])
        if np.any(size[x] != size[y]) or np.any(data[np.repeat(begin[x], size[x]) + inner] != data[np.repeat(begin[y], size[x]) + inner]):
            seen: dict[bytes, int] = {}
            inverse = np.array([seen.setdefault(data[i : i + n].tobytes(), len(seen)) for i, n in zip(begin.tolist(), size.tolist(), strict=True)], np.int64)
            return np.unique(inverse, return_index=True)[1], inverse
    return first, inverse


def _cut(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    """The bytes of spans, one after the other."""
    return data[np.repeat(begin, size) + _inner(size)].tobytes()


# Which minimisers more than one text has -----------------------------------------------------------


def _distinct_values(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimisers of a block, sorted, whether each is in more than one text, and how many different stretches are around it."""
    order, first = _grouped(runs.value)
    if not len(order):
        return runs.value, np.zeros(0, bool), np.zeros(0, np.int64)
    doc, rows = runs.doc[order], np.diff(np.append(first, len(order)))
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    stretches = np.ones(len(first), np.int64)
    repeated = np.flatnonzero(rows > 1)  # most values are there once, so only the others' stretches are sorted
    group = np.repeat(repeated, rows[repeated])
    text = runs.text[order[np.repeat(rows > 1, rows)]]
    text = text[np.lexsort((text, group))]
    again = (text[1:] == text[:-1]) & (group[1:] == group[:-1])
    np.subtract.at(stretches, group[1:][again], 1)
    stretches[repeated] += rows[repeated] - 1
    return runs.value[order[first]], several, stretches


def _send_values(value: np.ndarray, several: np.ndarray, stretches: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted values, and for each how many stretches, with a bit for several texts."""
    return _planes(np.diff(value, prepend=np.uint64(0))), _planes(stretches.astype(np.uint64) * np.uint64(2) + several.astype(np.uint64))


def _spare_bits(total: int, buckets: int) -> int:
    """How many low bits of a minimiser need not be sent to its bucket.

    What is sent has 12 bits more than a bucket has bytes of text, so one value in some
    thousands is taken for another's. That only follows up a minimiser that one text has.
    """
    return max(0, int(_BITS).bit_length() - max(32, (total // max(buckets, 1)).bit_length() + 12))


def _asked_values(texts: list[bytes], buckets: int, spare: int) -> list[tuple[int, bytes, bytes]]:
    """(bucket, values, notes): what a block asks about its minimisers."""
    value, several, stretches = _distinct_values(Runs(texts))
    return [(b, *_send_values(value[at] >> np.uint64(spare), several[at], stretches[at])) for b, at in _groups(_dealt(value, buckets))]


def _read_values(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.cumsum(_values(p), dtype=np.uint64) for p in table["payload"].to_pylist()], [_values(e) for e in table["extra"].to_pylist()]


def _merged_values(values: list[np.ndarray], notes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of several rows: each, whether more than one text has it, and its stretches in all of them."""
    every, note = np.concatenate(values), np.concatenate(notes)
    order, first = _grouped(every)
    every, note = every[order], note[order]
    rows = np.diff(np.append(first, len(every)))
    several = (np.maximum.reduceat(note & np.uint64(1), first) > 0) | (rows > 1) if len(first) else np.zeros(0, bool)  # a row has a value once, but for the bits that are not sent
    return every[first], several, np.add.reduceat(note >> np.uint64(1), first).astype(np.int64) if len(first) else np.zeros(0, np.int64)


def merge_values(table: pa.Table, level: int) -> list[tuple[int, bytes, bytes]]:
    merged = _merged_values(*_read_values(table))
    return [(part, *_send_values(*[x[at] for x in merged])) for part, at in _groups(_part(merged[0], level))]


def _masks(values: list[np.ndarray], every: np.ndarray, code: np.ndarray) -> list[bytes]:
    return [_zip(code[np.searchsorted(every, v)].tobytes()) for v in values]


def answer_values(table: pa.Table) -> list[bytes]:
    """For each value 0, or 1 if more than one text has it, or 2 if there are also more than HEAVY stretches around it."""
    values, notes = _read_values(table)
    every, several, stretches = _merged_values(values, notes)
    trim()
    return _masks(values, every, (several.astype(np.uint8) + (several & (stretches > HEAVY))).astype(np.uint8))


def spread_masks(table: pa.Table, answers: list[tuple[int, bytes]], level: int) -> list[bytes]:
    values, notes = _read_values(table)
    every, _, _ = _merged_values(values, notes)
    code, given = np.zeros(len(every), np.uint8), dict(answers)
    for part, at in _groups(_part(every, level)):
        code[at] = np.frombuffer(_unzip(given[part]), np.uint8)
    return _masks(values, every, code)


# Stretches and strings with the smallest id that has them ------------------------------------------


def _send_spans(data: bytes, size: np.ndarray, least: np.ndarray) -> tuple[bytes, bytes]:
    """Spans of bytes one after the other; their sizes and smallest ids."""
    sizes = _planes(size.astype(np.uint64))
    return _zip(data), len(sizes).to_bytes(8, "little") + sizes + _planes(least.view(np.uint64))


def _read_spans(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Bytes, sizes and smallest ids of the spans of all rows, and how many spans each row has."""
    data, sizes, least = [], [], []
    for payload, extra in zip(table["payload"].to_pylist(), table["extra"].to_pylist(), strict=True):
        n = int.from_bytes(extra[:8], "little")
        data.append(_unzip(payload))
        sizes.append(_values(extra[8 : 8 + n]).astype(np.int64))
        least.append(_values(extra[8 + n :]).view(np.int64))
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate(sizes), np.concatenate(least), list(map(len, sizes))


def _distinct(data: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins, sizes and smallest ids of the distinct spans, and which of them each span is."""
    begin = np.cumsum(size) - size
    first, inverse = distinct_spans(data, begin, size)
    best = np.full(len(first), _NEVER, np.int64)
    np.minimum.at(best, inverse, least)
    return begin[first], size[first], best, inverse


def _minimisers(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The smallest hash of the grams of the string at each of ``begin``; all strings of a stretch have the same."""
    h, out = prefix_hash(data), np.full(len(begin), _BITS, np.uint64)
    for k in range(WINDOW):
        np.minimum(out, span_hash(h, begin + k, begin + k + GRAM) & _BITS, out=out)
    return out


def _own_hashes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), begin, begin + LENGTH)


def _merged_spans(key: Callable[[np.ndarray, np.ndarray], np.ndarray], table: pa.Table, level: int) -> list[tuple[int, bytes, bytes]]:
    """Distinct spans by a hash of ``key``, so that strings which may be equal stay together."""
    data, size, least, _ = _read_spans(table)
    begin, size, best, _ = _distinct(data, size, least)
    return [(part, *_send_spans(_cut(data, begin[at], size[at]), size[at], best[at])) for part, at in _groups(_part(key(data, begin), level))]


def _answers(result: np.ndarray, strings: np.ndarray, rows: list[int]) -> list[bytes]:
    """The smallest ids of all strings, cut by the rows whose spans they are in."""
    ends = np.cumsum([0, *rows])
    at = np.concatenate([[0], np.cumsum(strings)])[ends]
    return [_planes(result[a:b].view(np.uint64)) for a, b in zip(at, at[1:], strict=False)]


def _spread_spans(key: Callable[[np.ndarray, np.ndarray], np.ndarray], table: pa.Table, answers: list[tuple[int, bytes]], level: int) -> list[bytes]:
    data, size, least, rows = _read_spans(table)
    begin, own, _, inverse = _distinct(data, size, least)
    strings = own - LENGTH + 1
    at, result, given = np.cumsum(strings) - strings, np.zeros(int(strings.sum()), np.int64), dict(answers)
    for part, which in _groups(_part(key(data, begin), level)):
        result[np.repeat(at[which], strings[which]) + _inner(strings[which])] = _values(given[part]).view(np.int64)
    each = size - LENGTH + 1
    return _answers(result[np.repeat(at[inverse], each) + _inner(each)], each, rows)


def merge_stretches(table: pa.Table, level: int) -> list[tuple[int, bytes, bytes]]:
    return _merged_spans(_minimisers, table, level)


def answer_stretches(table: pa.Table) -> list[bytes]:
    """The smallest id of each string of each stretch."""
    data, size, least, rows = _read_spans(table)
    out = _answers(smallest_ids(data, size, least), size - LENGTH + 1, rows)
    trim()
    return out


def spread_stretches(table: pa.Table, answers: list[tuple[int, bytes]], level: int) -> list[bytes]:
    return _spread_spans(_minimisers, table, answers, level)


def merge_strings(table: pa.Table, level: int) -> list[tuple[int, bytes, bytes]]:
    return _merged_spans(_own_hashes, table, level)


def answer_strings(table: pa.Table) -> list[bytes]:
    """The smallest id of each string, which is a span of its own."""
    data, size, least, rows = _read_spans(table)
    _, _, best, inverse = _distinct(data, size, least)
    return _answers(best[inverse], np.ones(len(size), np.int64), rows)


def spread_strings(table: pa.Table, answers: list[tuple[int, bytes]], level: int) -> list[bytes]:
    return _spread_spans(_own_hashes, table, answers, level)


# Blocks ----------------------------------------------------------------------------------------------


def _unpack(row: dict) -> tuple[np.ndarray, list[bytes]]:
    texts, sizes = _unzip(row["payload"]), _values(row["extra"])
    ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]).tolist()
    return np.array([_NEVER if i is None else i for i in row["ids"]], np.int64), [texts[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _shared_rows(row: dict, masks: dict[int, bytes], buckets: int) -> list[tuple]:
    """What a block asks about its passages: (kind, block, bucket, payload, extra).

    Kind 2: its distinct stretches around minimisers that more than one text has, with the
    smallest id of each; kind 3: its distinct strings where a minimiser has very many
    stretches; kind 4: which text and place each run of passages has, and where its
    strings stand among the answers to the other two.
    """
    ids, texts = _unpack(row)
    runs = Runs(texts)
    value, inverse = np.unique(runs.value, return_inverse=True)
    code = np.zeros(len(value), np.uint8)
    for b, at in _groups(_dealt(value, buckets)):
        code[at] = np.frombuffer(_unzip(masks[b]), np.uint8)
    code = code[inverse]
    runs.keep(code > 0)
    heavy = code[code > 0] == 2
    if not len(heavy):
        return []
    size = runs.size + LENGTH - 1
    data = np.frombuffer(b"".join([texts[d][x : x + n] for d, x, n in zip(runs.doc.tolist(), runs.start.tolist(), size.tolist(), strict=True)]), np.uint8)
    begin = np.cumsum(size) - size
    least = ids[runs.doc]
    out: list[tuple] = []
    notes: list[np.ndarray] = []
    for kind, which in ((2, np.flatnonzero(~heavy)), (3, np.flatnonzero(heavy))):
        strings = runs.size[which]
        if kind == 2:
            at, long, low, key = begin[which], size[which], least[which], runs.value[which]
        else:  # string by string
            at = np.repeat(begin[which], strings) + _inner(strings)
            long, low = np.full(len(at), LENGTH, np.int64), np.repeat(least[which], strings)
        first, inverse = distinct_spans(data, at, long)
        best = np.full(len(first), _NEVER, np.int64)
        np.minimum.at(best, inverse, low)
        key = key[first] if kind == 2 else _own_hashes(data, at[first])
        place, used = np.zeros(len(first), np.int64), 0
        for b, own in _groups(_dealt(key, buckets)):
            out.append((kind, row["block"], b, *_send_spans(_cut(data, at[first[own]], long[first[own]]), long[first[own]], best[own])))
            n = long[first[own]] - LENGTH + 1
            place[own] = used + np.cumsum(n) - n
            used += int(n.sum())
        notes += [runs.doc[which], runs.start[which], strings, place[inverse]]
    sizes = b"".join(len(x).to_bytes(8, "little") for x in notes)
    out.append((4, row["block"], -1, _planes(np.concatenate(notes).astype(np.uint64)), sizes))
    return out


def _least_of_runs(notes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of a block, in the order of texts: text, start, number of strings, and the smallest id of each string."""
    rows = sorted(zip(notes["kind"].to_pylist(), notes["bucket"].to_pylist(), notes["payload"].to_pylist(), notes["extra"].to_pylist(), strict=True))
    answers = [np.concatenate([np.zeros(0, np.int64), *[_values(r[2]).view(np.int64) for r in rows if r[0] == kind]]) for kind in (2, 3)]
    own = next((r for r in rows if r[0] == 4), None)
    if own is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum([int.from_bytes(own[3][i : i + 8], "little") for i in range(0, len(own[3]), 8)])
    doc, start, size, place, doc2, start2, size2, place2 = np.split(_values(own[2]).view(np.int64), ends[:-1])
    light = answers[0][np.repeat(place, size) + _inner(size)]
    doc, start, size = np.concatenate([doc, doc2]), np.concatenate([start, start2]), np.concatenate([size, size2])
    least, at = np.concatenate([light, answers[1][place2]]), np.cumsum(size) - size
    order = np.argsort(doc, kind="stable")
    return doc[order], start[order], size[order], least[np.repeat(at[order], size[order]) + _inner(size[order])]


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with ``with_spans`` also key, spans and text.

    A byte is removed if a string of LENGTH bytes that covers it also starts in a document
    with a smaller id; strings do not cross documents and are judged on the input.
    ``key`` is ``row_key``; ``spans`` are the removed [start, stop) in bytes; ``text`` is
    what is left without breaking a character: one that is removed in part is kept whole.

    The texts, in blocks, are written to the shared folder once. Each string is dealt by
    its minimiser, the smallest hash of the grams in it, so equal strings meet in one
    bucket. Only minimisers that more than one document has are followed up; that they are
    shared is found from all of them, by as many of their bits as a bucket needs, so nothing
    is lost. A bucket gets the distinct
    stretches of bytes around its minimisers, each with the smallest id that a block has it
    under, however many copies there are. It sorts all suffixes of them with the
    difference-cover method, compares neighbours by their first LENGTH bytes, and answers
    with the smallest id for each string. Around a minimiser with more than HEAVY
    stretches, such as a common phrase in many contexts, strings are dealt one by one by
    their own hash instead, so that its contexts spread over all buckets. Where hashes are
    equal bytes are compared. Blocks mark their texts by these answers. Nothing is
    collected, and no group of copies meets as such: what many blocks have is merged on the
    way (see ``exchange.asked``).

    Null texts count as empty. A null id counts as larger than any other. Rows that share
    an id do not remove each other's bytes; repeated rows stay. An empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key") if with_spans else F.lit(None).cast("binary").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = first_buckets(total, BLOCK_BYTES, BUCKET_BYTES)
    spare = _spare_bits(total, buckets)
    table_size = table_buckets(docs.sparkSession, -(-total // TABLE_BYTES))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers = block_numbers(TaskContext.get().partitionId(), table_size)
        block, held, ids, keys, texts = next(numbers), 0, [], [], []

        def flush() -> pa.RecordBatch:
            out = [(0, block, -1, _zip(b"".join(texts)), _planes(np.array([len(t) for t in texts], np.uint64)), ids, keys if with_spans else None)]
            out += [(1, block, *asks, None, None) for asks in _asked_values(texts, buckets, spare)]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())), strict=True)],
                names=["kind", "block", "bucket", "payload", "extra", "ids", "keys"],
            )

        for batch in batches:
            texts_of = batch.column(2).cast(pa.binary())
            for i, size in enumerate(pc.binary_length(texts_of).to_pylist()):
                if held and held + size > BLOCK_BYTES:
                    yield flush()
                    block, held, ids, keys, texts = next(numbers), 0, [], [], []
                ids.append(batch.column(0)[i].as_py())
                keys.append(batch.column(1)[i].as_py())
                texts.append(texts_of[i].as_py())
                held += size + 1
        if ids:
            yield flush()
        trim()

    parts = written_in_buckets(rows.mapInArrow(blocks, f"kind int, {ASK}, ids array<long>, keys array<binary>"), "block", table_size)
    texts = parts.where("kind = 0").select("block", "payload", "extra", "ids", "keys")
    n_blocks = texts.count()
    masks = asked(parts.where("kind = 1").select("block", "bucket", "payload", "extra"), n_blocks, merge_values, answer_values, spread_masks)

    def stretches(texts: pa.Table, masks: pa.Table) -> pa.Table:
        of = dict(zip(masks["bucket"].to_pylist(), masks["payload"].to_pylist(), strict=True))
        out = [r for row in texts.to_pylist() for r in _shared_rows(row, of, buckets)]
        trim()
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["kind", "block", "bucket", "payload", "extra"])

    found = written(texts.drop("keys").groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(stretches, f"kind int, {ASK}"))
    notes = found.where("kind = 4")
    for kind, how in ((2, (merge_stretches, answer_stretches, spread_stretches)), (3, (merge_strings, answer_strings, spread_strings))):
        answers = asked(found.where(F.col("kind") == kind).drop("kind"), n_blocks, *how)
        notes = notes.unionByName(answers.select(F.lit(kind).alias("kind"), "block", "bucket", "payload", F.lit(None).cast("binary").alias("extra")))

    def mark(texts: pa.Table, notes: pa.Table) -> pa.Table:
        out = []
        doc, start, size, least = _least_of_runs(notes)
        at = np.cumsum(size) - size
        for row in texts.to_pylist():  # one block
            ids, raw = _unpack(row)
            edges = np.searchsorted(doc, np.arange(len(raw) + 1))
            for d, text in enumerate(raw):
                a, b = edges[d], edges[d + 1]
                strings = np.repeat(start[a:b], size[a:b]) + _inner(size[a:b])
                hit = strings[least[at[a] : at[a] + len(strings)] < ids[d]] if b > a else strings
                if not len(hit):
                    out.append([row["ids"][d], len(text), 0, 0, hashlib.sha256(text).hexdigest(), *([row["keys"][d], [], text.decode("utf-8", "replace")] if with_spans else [])])
                    continue
                gone = np.zeros(len(text) + 1, np.int8)  # a text has each string's start once
                gone[hit] += 1
                gone[hit + LENGTH] -= 1
                gone = np.cumsum(gone[:-1], dtype=np.int32) > 0
                change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                data = np.frombuffer(text, np.uint8)
                row_out = [row["ids"][d], len(text), int(gone.sum()), len(change) // 2, hashlib.sha256(data[~gone].tobytes()).hexdigest()]
                if with_spans:
                    row_out += [row["keys"][d], change.reshape(-1, 2).tolist(), data[_whole(data, ~gone)].tobytes().decode("utf-8", "replace")]
                out.append(row_out)
        trim()
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary(), pa.list_(pa.list_(pa.int64())), pa.string()] * with_spans
        columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["key", "spans", "text"] * with_spans])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", key binary, spans array<array<long>>, text string" * with_spans
    return texts.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(mark, schema)


def drop_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs``, all rows and columns, without the passages that a document with a smaller id has too.

    No row is dropped; one that consists of such passages is left with an empty text. Where
    a text changes, ``chars_col``, if there is one, is counted anew; a text that stays as it
    was, null included, is not touched, and neither is its count. What is left is joined on
    ``row_key``, not on the id, so rows that share an id or have a null one keep their own
    text; rows equal in id and text are treated alike. An empty table gives an empty
    result; columns of any name may be there.
    """
    key, other, left = fresh(docs.columns, "key", "other", "left")
    found = repeated_bytes(docs, id_col=id_col, text_col=text_col, with_spans=True).where("n_removed > 0")
    texts = found.groupBy(F.col("key").alias(other)).agg(F.any_value("text").alias(left))  # a key has one text
    rows = docs.withColumn(key, row_key(id_col, text_col)).join(texts.hint("merge"), F.col(key) == F.col(other), "left")
    changed = F.col(other).isNotNull()
    new = {text_col: F.col(left), chars_col: F.char_length(left)}
    kinds = dict(docs.dtypes)
    return rows.select(*[F.when(changed, new[c]).otherwise(F.col(f"`{c}`")).cast(kinds[c]).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def _whole(data: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """``kept``, and all bytes of a character of which one is kept."""
    if not len(data):
        return kept
    begin = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(begin) or begin[0] != 0:
        begin = np.concatenate([[0], begin])
    some = np.maximum.reduceat(kept.astype(np.int8), begin).astype(bool)
    return np.repeat(some, np.diff(np.append(begin, len(data))))


def smallest_ids(data: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each string (LENGTH bytes) of each stretch: the smallest of the ids ``least`` of the stretches that hold it.

    Stretch i has ``size[i]`` bytes of ``data``. All strings of a stretch have one
    minimiser. If no other stretch has it, its strings are nowhere else; the suffixes of
    all others are sorted.
    """
    begin, own, best, inverse = _distinct(data, size, least)
    strings = own - LENGTH + 1
    at = np.cumsum(strings) - strings
    result = np.repeat(best, strings)
    _, which, number = np.unique(_minimisers(data, begin), return_inverse=True, return_counts=True)
    many = number[which] > 1 if len(which) else np.zeros(0, bool)
    if many.any():
        result[np.repeat(at[many], strings[many]) + _inner(strings[many])] = _sorted_least(data, begin[many], strings[many], best[many])
    each = size - LENGTH + 1
    return result[np.repeat(at[inverse], each) + _inner(each)]


def _sorted_least(data: np.ndarray, begin: np.ndarray, strings: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The smallest ``best`` of the distinct stretches that hold each string, by sorting all suffixes of them."""
    own = strings + LENGTH - 1
    to = np.concatenate([[0], np.cumsum(own + 1)])
    s = np.zeros(int(to[-1]), np.int64)
    inner = _inner(own)
    s[np.repeat(to[:-1], own) + inner] = data[np.repeat(begin, own) + inner].astype(np.int64) + 2
    s[to[1:] - 1] = 1  # between stretches; strings never reach it
    place = np.repeat(to[:-1], strings) + _inner(strings)
    index = np.full(len(s), -1, np.int64)  # of the string that starts here
    index[place] = np.arange(len(place))
    order = difference_cover(s)
    order = order[index[order] >= 0]
    same = np.ones(len(order), bool)
    same[:1] = False
    view = s.astype(np.uint16)
    for k in range(LENGTH):  # neighbours by their first bytes
        x = view[order + k]
        same[1:] &= x[1:] == x[:-1]
    head = np.flatnonzero(~same)
    owner = np.repeat(np.arange(len(begin)), strings)
    lowest = np.minimum.reduceat(best[owner[index[order]]], head)
    result = np.empty(len(place), np.int64)
    result[index[order]] = np.repeat(lowest, np.diff(np.append(head, len(order))))
    return result
