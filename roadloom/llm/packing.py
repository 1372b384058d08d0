"""Best-fit packing by minimum bin slack: a bitset subset-sum finds the fullest set of lengths for each bin."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import byte_runs, trim, written

#: Pieces that are packed at once, on average. A group leaves about one unfilled bin.
GROUP_PIECES = 8192
#: Tasks that pack groups; beyond it a task packs several, one at a time.
PACK_TASKS = 4096
#: Words whose ids a worker remembers; beyond it the memory starts anew, results do not depend on it.
CACHE_WORDS = 400_000
_LOADED: dict[str, tuple] = {}
#: Texts of these characters only are unchanged by NFC and lower-case one character to one.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_UNIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+")


#: The normaliser and the pattern of pre-tokens for which texts of plain characters are cut here.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordEncoder:
    """Ids of texts under a word-end BPE of the tokenizers library, as little-endian 32-bit integers.

    The library encodes each pre-token on its own, so the ids of one may be remembered and
    reused. Pre-tokens are found here only in texts made of plain Latin characters, and only
    for a tokenizer with the normaliser and pattern above; any other text goes to the
    library as a whole. New pre-tokens, already normal and cut, go to the same model without
    these two steps.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        steps = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = steps[0].get("pattern", {}).get("Regex") if len(steps) == 2 else None
        normal = [n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])]
        self.cuts = pattern == _PATTERN and normal == _NORMAL and config["model"].get("end_of_word_suffix") == "</w>"
        if self.cuts:
            self.words = Tokenizer.from_str(json.dumps(config | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}))
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        known = self.known
        chunks = [words[a:b] for a, b in byte_runs(map(len, words), 1 << 14)]
        for chunk, e in zip(chunks, self.words.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(chunk) and (not len(stop) or stop[-1] == len(ids)):
                raw, at = ids.tobytes(), 0
                for w, to in zip(chunk, (4 * stop).tolist(), strict=True):
                    known[w] = raw[at:to]
                    at = to
            else:
                for w in chunk:
                    known[w] = self.whole(w)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        units = []
        for t in texts:
            plain = self.cuts and _PLAIN.fullmatch(t) and not any(s in t for s in self.special)
            units.append(_UNIT.findall(t.lower()) if plain else None)
        new = set().union(*(u for u in units if u)).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known = {}
                new = set().union(*(u for u in units if u))
            self.learn(sorted(new))
        find = self.known.__getitem__
        for t, u in zip(texts, units, strict=True):
            yield self.whole(t) if u is None else b"".join(map(find, u))


def encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token ids of each text and ``end_id``, cut every ``capacity`` ids.

    Null and empty texts are one piece that holds ``end_id`` alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        tail, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for a, b in byte_runs(sizes, 1 << 20):
                owner, piece, length, crc = [], [], [], []
                for i, raw in enumerate(encode(batch.column(1).slice(a, b - a).to_pylist()), a):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw), step)):
                        owner.append(i)
                        piece.append(k)
                        length.append(len(raw[at : at + step]) >> 2)
                        crc.append(zlib.crc32(raw[at : at + step]))
                n = pa.array(piece, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), n, pc.multiply(n.cast(pa.int64()), capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        trim()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, no bin above ``capacity``.

    Each bin starts with the longest item left. A bitset of reachable sums over the lengths
    that are still available, longest first, then gives the fullest combination that fits
    beside it; the search ends early once the bin can be full. Its items are removed and
    the next bin starts.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    left = sorted(stacks)  # distinct lengths that still have items
    n_bin = 0
    while left:
        longest = left[-1]
        chosen = [longest]
        room = capacity - longest
        if len(stacks[longest]) == 1:
            left.pop()
            own = 0
        else:
            own = 1
        if room > 0 and left and left[0] <= room:
            mask, goal = (1 << (room + 1)) - 1, 1 << room
            reach, seen = 1, []  # seen: (length, sums reachable before this copy)
            for k in range(bisect_right(left, room) - 1, -1, -1):
                size = left[k]
                for _ in range(min(len(stacks[size]) - (own and size == longest), room // size)):
                    more = (reach | reach << size) & mask
                    if more == reach:
                        break
                    seen.append((size, reach))
                    reach = more
                if reach & goal:
                    break
            total = reach.bit_length() - 1
            for size, before in reversed(seen):
                if not before >> total & 1:
                    chosen.append(size)
                    total -= size
        at = 0
        for size in chosen:
            stack = stacks[size]
            i = stack.pop()
            bins[i], offsets[i] = n_bin, at
            at += size
            if not stack:
                k = bisect_right(left, size) - 1
                if k >= 0 and left[k] == size:
                    left.pop(k)
        n_bin += 1
    return bins, offsets


def pack(pieces: DataFrame, *, capacity: int = 2048, key: tuple[str, ...] = ("doc_id", "piece"), group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset; lengths lie between 1 and ``capacity``.

    Pieces are dealt by a hash of ``key`` into groups of about ``group_pieces``, each packed
    at once by ``minimum_bin_slack``; a group numbers its own sequences. Groups are dealt
    evenly to tasks by their number and taken one after the other, so what a task holds
    does not grow with the table; each group leaves about one bin that is not full.
    """
    groups = max(1, round(pieces.count() / group_pieces))
    tasks = min(groups, PACK_TASKS)
    group = F.pmod(F.xxhash64(*key), F.lit(groups)).cast("int")
    dealt = pieces.withColumn("_group", group).repartitionById(tasks, F.pmod("_group", F.lit(tasks))).sortWithinPartitions("_group")

    def filled(batches: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(batches).combine_chunks()
        bins, offsets = minimum_bin_slack(table["length"].to_numpy(), capacity)
        ids = bins + (int(table["_group"][0].as_py()) << 40)
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One group after the other; a partition's rows are in the order of their groups."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("_group")).to_numpy()
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for x, y in zip(edges, edges[1:], strict=False):
                if held and x < y and held[-1].column(held[-1].schema.get_field_index("_group"))[0].as_py() != own[x]:
                    yield from filled(held).to_batches()
                    held = []
                if x < y:
                    held.append(batch.slice(x, y - x))
        if held:
            yield from filled(held).to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A document is the ids of its whole text and ``end_id``; only documents above
    ``capacity`` are cut. Null texts count as empty; null ids and repeated rows are packed
    as they are, each row by itself; an empty table gives an empty result; other columns
    are not read. Texts are encoded once: the pieces, without text or ids, are written to
    the shared folder before they are packed.
    """
    return pack(written(token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)), capacity=capacity)
