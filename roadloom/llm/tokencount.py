"""Token counts: library encoding in Arrow batches that return lengths only."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import byte_runs, small_batches

#: Longer texts are split at safe boundaries, so that one text does not hold a worker's batch.
SPLIT_CHARS = 16_384
_LOADED: dict[str, object] = {}
#: A space between two characters that are neither a space nor the meta symbol which stands for one.
_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


def _processor(path: str):
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # Splitting at a space is safe as long as no piece continues over one.
        split = all("▁" not in model.id_to_piece(i).lstrip("▁") for i in range(model.vocab_size()))
        _LOADED[path] = model, split
    return _LOADED[path]


def safe_pieces(text: str, limit: int = SPLIT_CHARS) -> list[str]:
    """``text`` cut at single spaces between words, every ``limit`` characters at the earliest.

    The space at a cut is dropped: the library puts one before each text. A text
    without such a space stays whole.
    """
    out, start = [], 0
    while len(text) - start > limit and (m := _SAFE.search(text, start + limit)):
        out.append(text[start : m.start()])
        start = m.end()
    return [*out, text[start:]]


def token_lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text under the sentencepiece model at ``path``."""
    model, split = _processor(path)
    pieces, owner = [], []
    for i, t in enumerate(texts):
        for p in safe_pieces(t) if split and len(t) > SPLIT_CHARS else [t]:
            pieces.append(p)
            owner.append(i)
    counts = [0] * len(texts)
    for a, b in byte_runs(map(len, pieces), 1 << 18):
        for i, ids in zip(owner[a:b], model.encode(pieces[a:b], num_threads=1), strict=True):
            counts[i] += len(ids)
    return counts


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    Counts are those of the sentencepiece model at ``model_path`` for the whole text,
    without begin, end or added special tokens. Null texts count as empty (0 tokens);
    null ids and repeated rows stay as they are, one row out for each row in; an empty
    table gives an empty result; other columns are not read. Only lengths leave the
    Python workers. There is no shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
            for a, b in byte_runs(sizes.tolist(), 1 << 22):
                n = token_lengths(column.slice(a, b - a).to_pylist(), model_path)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sizes[a:b].astype("int64")), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    import pyarrow.compute  # noqa: F401

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lengths, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def default_path(name: str) -> str:
    """The installed file of a public tokenizer."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
