"""Each training-data operator against brute force, with empty, null, long, tied and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom.llm import bytebpe, components, exactdedup, exchange, langid, licenses, neardup, packing, quality, shingles, suffixdedup, textkit, tokencount, topk

P = pytest.importorskip("public_tokenizers")

WORDS = [f"{a}{b}{c}" for a in "bdkmt" for b in "aeiou" for c in ("", "n", "ra", "st")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    """Texts of all kinds: null, empty, blank, one word, copies, near copies, shared passages, very long, non-ASCII."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 60)
    words = base.split()
    texts = [None, "", "  \n", "word", "word", base, base, " " + base + "\n", base.upper(), "é è ü ß — 漢字 😀 x", "don't 's ''s \t\n  x  y", "a" * 300, "ab" * 400, prose(rng, 6000), "<|endoftext|> <s> gpl"]
    for k in (1, 3, 9, 30):
        edited = list(words)
        for i in rng.sample(range(len(words)), k):
            edited[i] = "changed"
        texts.append(" ".join(edited))
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(4)]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(20)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus in three partitions, with columns whose names operators use inside."""
    rows = [(i, t, "x", i % 3, 1.0, b"b", "k") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, norm string, block int, score double, payload binary, _keep string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def test_token_counts(docs, none):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    got = by_id(tokencount.count_tokens(docs, str(path), limit=50))
    for i, t in corpus():
        n = len(model.encode(t or ""))
        assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 50)
    assert tokencount.count_tokens(none, str(path)).count() == 0


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_safe_splits_do_not_change_counts(limit):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    for text in (prose(random.Random(1), 200), "a  b   c d\ne f\t g h ", "▁ ▁a b", "x" * 100, " lead and trail "):
        pieces = tokencount.safe_pieces(text, limit)
        assert " ".join(pieces) == text
        assert sum(len(model.encode(p)) for p in pieces) == len(model.encode(text))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    of, total = {}, 0
    for r in got:
        of.setdefault(r["doc_id"], {})[r["piece"]] = r
    for i, t in corpus():
        raw = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        total += len(raw) // 4
        parts = [raw[k : k + 8192] for k in range(0, len(raw), 8192)]
        assert [(k, k * 2048, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(parts)] == [tuple(of[i][k])[1:5] for k in sorted(of[i])]
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack_documents(none, path).count() == 0


def test_groups_of_pieces_share_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "PACK_TASKS", 3)
    rng = random.Random(6)
    rows = [(i, 0, rng.randrange(1, 101)) for i in range(900)] + [(None, 0, 7)] * 5
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long").repartition(5), capacity=100, group_pieces=60).collect()
    assert len(got) == len(rows) and len({r["sequence_id"] >> 40 for r in got}) == 15
    full = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        assert [o for o, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1].tolist()] and sum(n for _, n in parts) <= 100
    assert packing.pack(spark.createDataFrame([], "doc_id long, piece int, length long")).count() == 0


def test_bins_are_full_where_they_can_be():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (50, 100), (2000, 100), (300, 17)):
        lengths = rng.integers(1, top + 1, n)
        bins, offsets = packing.minimum_bin_slack(lengths, 100)
        sums = np.bincount(bins, lengths)
        assert sums.max() <= 100 and len(sums) <= 1.02 * max(-(-lengths.sum() // 100), (lengths > 50).sum()) + 1
        for b in range(len(sums)):
            own = np.flatnonzero(bins == b)
            order = own[np.argsort(offsets[own])]
            assert offsets[order].tolist() == [0, *np.cumsum(lengths[order])[:-1].tolist()]
    assert packing.minimum_bin_slack(np.full(3, 60), 100)[0].tolist() in ([0, 1, 2], [2, 1, 0])
    assert len(packing.minimum_bin_slack(np.zeros(0, np.int64), 100)[0]) == 0


def test_byte_bpe_round_trip(docs, none):
    import tiktoken

    path = str(P.path("byte_bpe_50k.tiktoken"))
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bytebpe.encode_documents(docs, path, P.PATTERN, with_ids=True))
    for i, t in corpus():
        ids = library.encode_ordinary(t or "")
        r = got[i]
        assert r["ids"] == ids and bytes(r["decoded"]) == (t or "").encode() and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bytebpe.encode_documents(none, path, P.PATTERN).count() == 0


def test_exact_dedup(docs, none, spark):
    groups = {}
    for i, t in corpus():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    got = by_id(exactdedup.exact_groups(docs))
    for norm, rows in groups.items():
        keep = min(rows)[1]
        for _, i in rows:
            assert tuple(got[i]) == (i, keep, len(rows), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    kept = exactdedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {min(r)[1] for r in groups.values()}
    assert exactdedup.exact_groups(none).count() == 0
    odd = spark.createDataFrame([(None, "abc"), (3, "abc"), (3, "abc"), (None, "q")], "doc_id long, text string")
    rows = sorted(tuple(r)[:4] for r in exactdedup.exact_groups(odd).where("doc_id is not null").collect())
    assert rows == [(3, 3, 3, True)] * 2
    assert exactdedup.exact_groups(odd).where("doc_id is null").count() == 2


def test_one_row_of_each_text_stays(spark, none):
    rows = [(None, "abc", 1), (None, "q", 2), (3, "abc", 3), (5, "a bc", 4), (5, "zz", 5), (5, "zz", 6), (5, "zz", 6), (None, None, 7), (7, " ", 8), (6, "", 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, _hash int").withColumns({"norm": F.lit("x"), "_first": F.lit(0)})
    got = exactdedup.drop_copies(odd)
    assert got.columns == odd.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("5", "a bc"), ("5", "zz"), ("7", " "), ("None", "q")]
    assert exactdedup.drop_copies(none).count() == 0


def test_members_of_a_very_large_group_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(textkit, "HOT_KEYS", 4)
    rows = [(i, "one text") for i in range(40)] + [(100 + i, f"text {i}") for i in range(9)] + [(None, "one text")]
    got = exactdedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in got) == sorted([(str(i), 0, 41, i == 0) for i in range(40)] + [(str(100 + i), 100 + i, 1, True) for i in range(9)] + [("None", 0, 41, False)])


def classes_of(rows, threshold=0.8):
    """Classes of five-word shingles by comparing all pairs."""
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = split.findall((t or "").translate(lower))
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_dedup_loses_no_link(spark, docs, none, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    rng = random.Random(9)
    base = prose(rng, 150).split()
    rows = corpus()
    for i in range(30):
        edited = list(base)
        for at in rng.sample(range(len(base)), rng.randrange(0, 8)):
            edited[at] = rng.choice(WORDS)
        rows.append((1000 + i, " ".join(edited)))
    want = classes_of(rows)
    got = by_id(neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (i == r["class_id"]) for i, r in got.items())
    assert neardup.near_classes(none).count() == 0


@pytest.mark.parametrize("times", [5, 10, 50, 1000])
def test_near_dedup_links_copies_that_repeat_a_line(spark, times):
    rng, rows = random.Random(times), []
    for i in range(0, 80, 2):
        word = lambda k: f"w{i}x{k}"  # noqa: E731, B023
        base, line = [word(k) for k in range(104)], [word(k) for k in range(200, 220)]
        rng.shuffle(base)
        rows += [(i, " ".join(base)), (i + 1, " ".join(base + line * times))]
    assert {i: r["class_id"] for i, r in by_id(neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))).items()} == classes_of(rows) == {i: i - i % 2 for i, _ in rows}


def test_near_dedup_of_null_ids_and_repeats(spark):
    rng = random.Random(2)
    text, other = prose(rng, 30), prose(rng, 30)
    rows = [(None, text), (None, text), (5, text), (5, text), (4, text), (5, other), (None, other), (None, "only here"), (4, ""), (4, None), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "_key": F.lit("y"), "kept": F.lit("z"), "class_id": F.lit(1)})
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"], r["kept"]) for r in neardup.near_classes(docs).collect())
    want = [("None", "4", 5, False)] * 2 + [("5", "4", 5, False)] * 2 + [("4", "4", 5, True), ("5", "5", 2, True), ("None", "5", 2, False), ("None", "None", 1, True), ("4", "4", 1, True), ("4", "4", 1, True), ("None", "None", 1, True)]
    assert got == sorted(want)
    left = neardup.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, [(4, text), (5, other), (None, "only here"), (4, ""), (4, None), (None, " ")]))
    names = spark.createDataFrame([("b", text), ("a", text + " more"), ("c", other)], "doc_id string, text string")
    assert {tuple(r)[:2] for r in neardup.near_classes(names).collect()} == {("b", "a"), ("a", "a"), ("c", "c")}
    assert neardup.drop_near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1000, 3])
def test_near_dedup_recall_against_all_pairs(spark, monkeypatch, parts):
    """Recall over pairs at 0.8 and above, at every similarity and with heavily repeated lines."""
    monkeypatch.setattr(textkit, "HOT_KEYS", parts)
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 8)
    rng, rows = random.Random(21), []
    for group in range(12):
        base = [f"g{group}w{k}" for k in range(110)]
        line = [f"g{group}l{k}" for k in range(9)]
        for k in range(6):
            edited = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(4)):
                edited[at] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(edited + line * rng.choice([0, 1, 40, 400]))))
    rng.shuffle(rows)
    want = classes_of(rows)
    got = {i: r["class_id"] for i, r in by_id(neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))).items()}
    pairs = [(i, j) for i in want for j in want if i < j and want[i] == want[j]]
    assert len(pairs) > 60 and sum(got[i] == got[j] for i, j in pairs) == len(pairs)
    assert got == want


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    a, b = {int(k): float(w) for k, w in zip(range(60), rng.integers(1, 6, 60), strict=True)}, {int(k): float(w) for k, w in zip(range(20, 80), rng.integers(1, 6, 60), strict=True)}
    keys = shingles.mix64(np.arange(1, 101, dtype=np.uint64))
    exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    value = np.concatenate([keys[list(a)], keys[list(b)]])
    weight = np.array([*a.values(), *b.values()])
    got = shingles.signatures(value, weight, np.array([0, len(a), len(a) + len(b)]), 8192)
    assert np.mean(got[0] == got[1]) == pytest.approx(exact, abs=0.02)


def test_block_numbers_share_a_bucket(spark):
    from itertools import islice

    for partition, buckets in ((0, 7), (5, 7), (9, 51), (1 << 20, 211)):
        numbers = list(islice(textkit.block_numbers(partition, buckets), 4))
        got = spark.createDataFrame([(x,) for x in numbers], "x long").select(F.pmod(F.hash("x"), F.lit(buckets)).alias("b")).collect()
        assert {r["b"] for r in got} == {partition % buckets} and len(set(numbers)) == 4


def test_components_of_a_star_and_a_chain(spark):
    edges = spark.createDataFrame([(1, i) for i in range(2, 50)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 50)} | {i: 100 for i in range(100, 161)}


def test_licenses(spark, docs, none):
    lines = [
        (0, "Released under the MIT License."), (1, "Licensed under CC BY-NC 4.0."), (2, "GNU General Public License version 3 or later; the MIT license, mit License"), (3, "SPDX-License-Identifier: Apache-2.0"),
        (4, None), (5, "cc by"), (6, "ccby mitlicense"), (7, "All rights reserved. Mozilla Public License v2.0"), (8, "ＭＩＴ license"), (9, "GNU Lesser General Public License 2.1"), (10, "mit license " * 300),
    ]
    got = by_id(licenses.summarised(licenses.scan(spark.createDataFrame(lines, "doc_id long, text string"))))
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["labels"]) == (1, 3, "mit")
    assert got[1]["base_labels"] == "cc-by" and got[1]["labels"] == "cc-by,cc-by-nc,cc-by-nc-4.0"
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (3, 0, 11, "gpl,mit") and got[2]["labels"] == "gpl,gpl-3.0,mit"
    assert got[3]["n_base"] == 0 and got[3]["labels"] == "apache-2.0" and got[3]["score"] == 1.0
    assert tuple(got[4])[1:] == (0, 0, None, None, "", "", 0.0)
    assert (got[5]["n_base"], got[5]["first_word"], got[5]["last_word"]) == (1, 0, 0)
    assert got[6]["labels"] == "" and got[8]["n_base"] == 0
    assert got[7]["labels"] == "mpl-2.0,proprietary" and got[7]["base_labels"] == ""
    assert got[9]["labels"] == "lgpl-2.1"
    assert (got[10]["n_base"], got[10]["last_word"]) == (300, 598)
    assert len(licenses.rules()) >= 300
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == docs.count()


def scanned_plainly(text, rule_list):
    """n_words and detections by Python's regexes over the line of words, each rule from left to right, then containment pair by pair."""
    words = [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in re.findall(licenses.WORD, text or "")]
    line, found = " " + " ".join(words) + " ", []
    for order, r in enumerate(rule_list):
        if any(k in words for k in r.keywords):
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
                start = line[: m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" "), r.priority, r.label, r.base, order))
    kept, first = [], lambda d: (d[0], -d[1], d[2])
    for d in found:
        holds = lambda e: not e[4] and e[2] <= d[2] and e[0] <= d[0] and d[1] <= e[1] and e[5:] != d[5:]  # noqa: E731, B023
        rivals = [e for e in found if e is not d and holds(e)]
        if d[4] or not any(first(e) < first(d) or (first(e) == first(d) and e[5] < d[5]) for e in rivals):
            kept.append(d[:5])
    return len(words), sorted(kept)


def test_license_scan_equals_plain_python(spark):
    rng, rule_list = random.Random(12), licenses.rules()
    sample = [re.sub(r"\(\?[:!<=][^()]*\)[?*]?|\[[^]]*\]|[{}?*|()+0-9,]", " ", r.pattern) for r in rule_list]
    phrases = [*licenses.BASE, "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "GNU GPL v3 or later", "licensed under the Apache License, Version 2.0", "CC BY-NC-SA 4.0", "SPDX-License-Identifier: GPL-2.0-or-later", "the new BSD license", "All rights reserved."]
    texts = [None, "", " ", "é MIT  license\u00a0MIT license"]
    for _ in range(120):
        parts = [rng.choice([rng.choice(phrases), rng.choice(phrases).upper(), rng.choice(sample), prose(rng, 4)]) for _ in range(rng.randrange(1, 7))]
        texts.append(rng.choice([" ", ". ", "\n", ""]).join(parts))
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    hits = 0
    for i, t in enumerate(texts):
        n, want = scanned_plainly(t, rule_list)
        assert (got[i]["n_words"], sorted(tuple(d) for d in got[i]["detections"])) == (n, want), t
        hits += len(want)
        words = re.findall(licenses.WORD, (t or "").lower())
        places = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert sorted((d[0], d[3]) for d in want if d[4]) == places
    assert hits > 150


def test_license_rules_are_distinct_and_reachable():
    rule_list = licenses.rules()
    assert len({r.pattern for r in rule_list}) == len(rule_list) >= 500 and sum(r.priority == licenses.TEXT for r in rule_list) >= 140
    for r in rule_list:
        if r.priority == licenses.TEXT:
            assert set(r.keywords) <= set(re.split("[^a-z0-9]+", r.pattern))


def removed(rows, length=50):
    """Marks by comparing all strings."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone, new = np.zeros(len(raw), bool), set()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            new.add(s)
        seen |= new
        out[i] = raw, gone
    return out


def test_repeated_passages(spark, docs, none):
    rows = corpus()
    got = by_id(suffixdedup.repeated_bytes(docs, with_spans=True))
    for i, (raw, gone) in removed(rows).items():
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = [[int(a), int(b)] for a, b in np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]]))).reshape(-1, 2)]
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["spans"]) == (len(raw), int(gone.sum()), len(spans), spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert suffixdedup.repeated_bytes(none).count() == 0


def check_removed(df, rows):
    got = by_id(suffixdedup.repeated_bytes(df))
    for i, (raw, gone) in removed(rows).items():
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize(("heavy", "fan", "block"), [(20, 256, 4 << 20), (4096, 2, 600), (0, 3, 400), (30, 2, 300)])
def test_repeated_passages_of_a_phrase_in_many_contexts(spark, monkeypatch, heavy, fan, block):
    """One phrase everywhere, passages that many share in part, with strings dealt one by one and answers that go through several merges."""
    monkeypatch.setattr(suffixdedup, "HEAVY", heavy)
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(suffixdedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", 4000)
    rng = random.Random(11)
    phrase, passage = "a phrase of twenty-four", prose(rng, 30)
    rows = [(i, f"{prose(rng, 6)} {phrase} {prose(rng, 6)}") for i in range(120)]
    rows += [(200 + i, f"{prose(rng, 3)} {passage[rng.randrange(20):rng.randrange(80, 140)]} {prose(rng, 3)}") for i in range(40)]
    rows += [(300 + i, rows[rng.randrange(len(rows))][1]) for i in range(20)] + [(400, "x" * 300), (401, "x" * 120 + "y"), (402, "")]
    rng.shuffle(rows)
    check_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows)


def test_runs_of_a_long_text_piece_by_piece(monkeypatch):
    """Every passage start is in one run, whatever the pieces, and has its own minimiser."""
    rng = random.Random(8)
    texts = [prose(rng, 300).encode(), b"", b"x" * 49, b"y" * 50, prose(rng, 90).encode()]
    found = []
    for step in (64, 333, 1 << 19):
        monkeypatch.setattr(suffixdedup, "_STEP", step)
        runs = suffixdedup.Runs(texts)
        found.append(sorted((d, s + k, v) for d, s, n, v in zip(runs.doc.tolist(), runs.start.tolist(), runs.size.tolist(), runs.value.tolist(), strict=True) for k in range(n)))
    assert found[0] == found[1] == found[2] and [(d, s) for d, s, _ in found[0]] == [(d, s) for d, t in enumerate(texts) for s in range(len(t) - 49)]


def test_contexts_of_one_phrase_spread_over_buckets(monkeypatch):
    """3000 contexts of one phrase: no bucket gets more than a few times its share of strings."""
    monkeypatch.setattr(suffixdedup, "HEAVY", 100)
    rng = random.Random(4)
    texts = [f"{rng.random()} {rng.random()} the very same phrase here {rng.random()} {rng.random()}".encode() for _ in range(3000)]
    runs = suffixdedup.Runs(texts)
    value, several, stretches = suffixdedup._distinct_values(runs)
    assert stretches.max() > 1500
    masks = {b: suffixdedup._zip((several[at].astype(np.uint8) * 2)) for b, at in suffixdedup._groups(suffixdedup._dealt(value, 16))}
    sizes = suffixdedup._planes(np.array([len(t) for t in texts], np.uint64))
    rows = suffixdedup._shared_rows({"ids": list(range(3000)), "payload": suffixdedup._zip(b"".join(texts)), "extra": sizes, "block": 0}, masks, 16)
    held = [len(suffixdedup._unzip(r[3])) // 50 for r in rows if r[0] == 3]
    assert len(held) == 16 and max(held) < 1.3 * sum(held) / 16 and not [r for r in rows if r[0] == 2]


def test_equal_hashes_do_not_make_equal_spans(monkeypatch):
    monkeypatch.setattr(suffixdedup, "span_hash", lambda h, a, b: np.zeros(len(a), np.uint64))
    data, begin, size = np.frombuffer(b"abcabdabc", np.uint8), np.array([0, 3, 6]), np.array([3, 3, 3])
    first, inverse = suffixdedup.distinct_spans(data, begin, size)
    assert first.tolist() == [0, 1] and inverse.tolist() == [0, 1, 0]


@pytest.mark.parametrize("fan", [2, 3])
def test_byte_bpe_through_several_merges(spark, monkeypatch, fan):
    monkeypatch.setattr(exchange, "FAN", fan)
    monkeypatch.setattr(bytebpe, "BLOCK_BYTES", 500)
    monkeypatch.setattr(bytebpe, "BUCKET_BYTES", 300)
    import tiktoken

    path = str(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.ranks_of(path), special_tokens={})
    rows = corpus()
    got = by_id(bytebpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path, P.PATTERN, with_ids=True))
    for i, t in rows:
        assert got[i]["ids"] == library.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()


def test_repeats_within_and_across(spark):
    line = prose(random.Random(3), 25)
    rows = [(7, line), (3, "intro " + line), (9, line + line), (5, line[:49]), (1, "x" * 200), (2, "x" * 50), (4, "é" * 40 + line), (6, "é" * 40), (None, line), (3, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"], r["text"]) for r in suffixdedup.repeated_bytes(df, with_spans=True).collect()}
    n = len(line)
    assert got[3, n + 6][:2] == (0, 0) and got[3, n][:2] == (0, 0)  # one id never removes its own
    assert got[7, n] == (n, 1, "") and got[9, 2 * n][:2] == (2 * n, 1) and got[5, 49][:2] == (0, 0)
    assert got[1, 200][:2] == (0, 0) and got[2, 50] == (50, 1, "") and got[6, 80][:2] == (80, 1) and got[None, n][:2] == (n, 1)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in [*range(12), 40, 41, 42, 300]:
        for k in (1, 2, 5):
            s = rng.integers(1, k + 1, n)
            assert suffixdedup.difference_cover(s).tolist() == sorted(range(n), key=lambda i, s=s: s[i:].tolist())
    big = rng.integers(1, 1 << 40, 50)
    assert suffixdedup.difference_cover(big).tolist() == sorted(range(50), key=lambda i: big[i:].tolist())


@pytest.mark.parametrize(("shard", "block", "fan"), [(40 * 48, 3 * 48, 2), (1 << 20, 1 << 20, 64)])
def test_topk(spark, monkeypatch, shard, block, fan):
    monkeypatch.setattr(topk, "SHARD_BYTES", shard)
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    monkeypatch.setattr(topk, "FAN", fan)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(200)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (250, [float("nan")] * 6), (202, [float("inf")] * 6), (None, [1.0] * 6), (300, [1.0, 2.0])] + [(1000 + i, [3.0] * 6) for i in range(20)]
    repeated = [(777, [4.0] * 6)] * 3 + [(778, [4.0] * 6)] * 9
    df = spark.createDataFrame(rows + repeated, "vec_id long, embedding array<float>").withColumns({"q": F.lit("clash"), "dim": F.lit(1), "shard": F.lit("x")})
    got = {}
    for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    for q in [i for i in vectors if i % 50 == 0]:
        copies = [(i, np.full(6, 1024)) for i, _ in repeated]
        best = sorted((-int(vectors[q] @ v), i) for i, v in [*vectors.items(), *copies] if i != q and len(v) == len(vectors[q]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_scores_beyond_doubles_stay_exact(spark):
    rows = [(0, [3e6 + 1.0, 1.0]), (1, [3e6 + 3.0, -1.0]), (2, [3e6 + 3.0, -2.0])]
    got = topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).collect()
    q = [256 * (3000001), 256]
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, q[0] * 256 * 3000003 - 256 * 256), (2, q[0] * 256 * 3000003 - 2 * 256 * 256)]


def kneser_ney(texts, order=4):
    """cost(text): cross-entropy by interpolated Kneser-Ney with dictionaries of strings, straight from the definition."""
    from collections import defaultdict

    def symbols(t):
        out = [""]
        for c in t or "":
            s = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else ""
            if s or out[-1]:
                out.append(s)
        return out

    def windows(t):
        s = [""] * (order - 1) + symbols(t)
        return [tuple(s[k : k + order]) for k in range(1, len(s) - order + 1)]

    count = [None] * (order + 1)
    count[order] = defaultdict(int)
    for t in texts:
        for w in windows(t):
            count[order][w] += 1
    for k in range(order - 1, 0, -1):
        count[k] = defaultdict(int)
        for w in count[k + 1]:
            count[k][w[1:]] += 1
    discount, total, kinds = [0] * (order + 1), [None] * (order + 1), [None] * (order + 1)
    for k in range(1, order + 1):
        n1, n2 = (sum(c == x for c in count[k].values()) for x in (1, 2))
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total[k], kinds[k] = defaultdict(int), defaultdict(int)
        for w, c in count[k].items():
            total[k][w[:-1]] += c
            kinds[k][w[:-1]] += 1

    def probability(w):
        p = 1 / 0x110000
        for k in range(1, order + 1):
            v = w[-k:]
            if total[k].get(v[:-1]):
                p = (max(count[k].get(v, 0) - discount[k], 0) + discount[k] * kinds[k][v[:-1]] * p) / total[k][v[:-1]]
        return p

    def cost(t):
        w = windows(t)
        return -sum(np.log(probability(x)) for x in w) / len(w) if w else None

    cost.probability = probability
    return cost


LETTERS = {"aa": "abcde", "bb": "bcdfg", "éé": "éàab", "ru": "абвгд", "uk": "абвгї", "zh": "漢字語文中", "ja": "漢字かなの", "got": "𐌰𐌱𐌲𐌳𐌴"}


def language_rows(rng, copies=40):
    word = lambda k: "".join(rng.choice(LETTERS[k]) for _ in range(rng.randrange(2, 8)))
    rows = [(i, " ".join(word(k) for _ in range(rng.randrange(8, 40))), k) for i, k in enumerate(list(LETTERS) * copies)]
    return rows + [(9000, None, "aa"), (9001, "123 !!", "aa"), (9002, "", None), (9003, "abcde " * 20000, None), (9004, "cab", "aa"), (9005, "Ωmega", "bb"), (None, "бад", "ru")]


@pytest.mark.parametrize("entries", [langid.BROADCAST_ENTRIES, 0])
def test_language_id_equals_the_definition(spark, monkeypatch, entries):
    """Both ways to score, with scripts whose letters once shared symbols, against dictionaries of strings."""
    monkeypatch.setattr(langid, "BROADCAST_ENTRIES", entries)
    rows = language_rows(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("clash"), "n": F.lit(1), "_key": F.lit("k"), "cost": F.lit(0)})
    model = langid.train(docs, F.expr("coalesce(doc_id div 8 % 4, 0) <> 2"))
    got = by_id(langid.identify(docs, model, extra={"held_out": F.expr("coalesce(doc_id div 8 % 4, 0) = 2")}))
    assert len(got) == len(rows) and model.languages == sorted(LETTERS)
    costs = {k: kneser_ney([t for i, t, lang in rows if lang == k and t is not None and (i or 0) // 8 % 4 != 2]) for k in LETTERS}
    for i, t, _ in rows:
        if i == 9003:  # the definition is slow
            assert got[i]["lang_pred"] == "aa"
            continue
        want = {k: c(t) for k, c in costs.items()}
        if want["aa"] is None:
            assert tuple(got[i])[1:5] == ("und", 0.0, 0.0, True)
            continue
        best = min(sorted(want), key=want.get)
        assert got[i]["cross_entropy"] == pytest.approx(want[best], rel=1e-9)
        assert want[got[i]["lang_pred"]] == pytest.approx(want[best], rel=1e-9)
    held = [r for r in rows if r[0] is not None and r[0] < 9000 and r[0] // 8 % 4 == 2]
    assert sum(got[i]["lang_pred"] == k for i, _, k in held) >= 0.97 * len(held)
    assert 0 <= min(r["score"] for r in got.values()) and max(r["score"] for r in got.values()) <= 1


def test_language_id_of_nothing(spark):
    docs = spark.createDataFrame(language_rows(random.Random(1), 2), "doc_id long, text string, lang string")
    empty = langid.train(docs.limit(0), F.lit(True))
    assert langid.identify(docs.limit(0), empty).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs, empty).collect()} == {("und", 0.0)}
    one = langid.train(docs.where("lang = 'ru'"), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs.where("lang = 'zh'"), one).collect()} == {"ru"}


def test_kneser_ney_sums_to_one():
    cost = kneser_ney(["abra cadabra", "bar bara", None, "..."])
    for context in (("", "", ""), ("", "", "a"), ("a", "b", "r"), ("x", "x", "x")):
        seen = [cost.probability((*context, c)) for c in ["", *"abcdr"]]
        rest = cost.probability((*context, "z"))
        assert sum(seen) + rest * (0x110000 - 6) == pytest.approx(1)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh é", "".join(map(chr, range(97, 123))) + "àéîõü", "".join(map(chr, range(0x4E00, 0x5E00)))])
def test_distinct_ngrams(letters):
    rng = random.Random(2)
    grams, _ = langid.ngrams(["".join(rng.choice(letters + " ") for _ in range(900)) for _ in range(3)])
    rows, which = langid.distinct(grams)
    assert np.array_equal(rows[which], grams) and len({tuple(r) for r in rows.tolist()}) == len(rows) == len({tuple(r) for r in grams.tolist()})
    assert len(langid.distinct(grams[:0])[0]) == 0


def test_ngrams_do_not_cross_texts():
    texts = ("abc d", "xyz", "", None, "é!!f", "𐌰漢")
    one = [langid.ngrams([t])[0].tolist() for t in texts]
    grams, starts = langid.ngrams(texts)
    assert [grams[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == one
    assert np.array_equal(langid.unpacked(*langid.packed(grams)), grams)
    keys, before = langid.hashes(grams)
    assert all(len(set(k.tolist())) == len({tuple(g[-n - 1 :]) for g in grams.tolist()}) for n, k in enumerate(keys))
    assert all(len(set(k.tolist())) == len({tuple(g[-n - 1 : -1]) for g in grams.tolist()}) for n, k in enumerate(before))


def test_quality(spark):
    rng = random.Random(8)
    clean = lambda: ". ".join(prose(rng, 9).capitalize() for _ in range(rng.randrange(2, 9))) + "."
    junk = lambda: rng.choice([" ".join(f"{w}{rng.choice(['$$$', '%%%', '###'])}" for w in prose(rng, 30).split()), prose(rng, 20).upper().replace(" ", "!! "), " | ".join(prose(rng, 25).split()), f"{rng.choice(WORDS)} " * 60])
    rows = [(i, clean() if i % 3 else junk()) for i in range(400)] + [(900, None), (901, ""), (902, clean() * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"stats": F.lit(1), "y": F.lit("clash")})
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = by_id(quality.classify(docs, labels, F.col("doc_id") % 5 != 0))
    held = [i for i in range(400) if i % 5 == 0]
    assert sum(got[i]["predicted"] == int(i % 3 > 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and len(got) == len(rows)
    assert quality.classify(docs.limit(0), labels, F.lit(True)).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(400) if i % 3}


def plain_statistics(text):
    """STATISTICS of one text from their description, with Python strings and loops."""
    raw = (text or "").encode()
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    lower = [w.lower() for w in words]  # bytes: only A-Z change
    lines = [x for x in raw.split(b"\n") if x]
    share = lambda n, d: n / max(d, 1)
    mean = share(sum(map(len, words)), len(words))
    follow = [m.end() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    usual, space = b",.'-:;?\"()", b" \n\t\r"
    mark = lambda c: not re.match(rb"[0-9A-Za-z\x80-\xff]", bytes([c])) and c not in space
    capitals = [sum(65 <= c <= 90 for c in w) for w in words]
    most = max(map(lower.count, lower), default=0)
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), mean, max(share(sum(len(w) ** 2 for w in words), len(words)) - mean**2, 0) ** 0.5,
        share(sum(c >= 128 or bytes([c]).isalpha() for c in raw), len(raw)), share(sum(48 <= c <= 57 for c in raw), len(raw)), share(sum(c in space for c in raw), len(raw)), share(sum(65 <= c <= 90 for c in raw), len(raw)),
        share(sum(c >= 128 for c in raw), len(raw)), share(sum(map(mark, raw)), len(raw)), share(sum(mark(c) and c not in usual for c in raw), len(raw)), share(raw.count(b"|"), len(raw)), share(raw.count(b"!"), len(raw)),
        len(set(lower)) / max(len(words), 1) ** 0.5 / 10, share(most, len(words)), share(sum(a == b for a, b in zip(lower, lower[1:], strict=False)), len(words)), share(len(set(x.lower() for x in lines)), len(lines)),
        share(sum(len(x) < 20 for x in lines), len(lines)), share(sum(n > 1 and n >= 0.6 * len(w) for n, w in zip(capitals, words, strict=True)), len(words)),
        share(sum(e < len(raw) and mark(raw[e]) and raw[e] not in usual for e in follow), len(words)), share(sum(x.endswith(b".") for x in lines), len(lines)),
    ]


def test_statistics_equal_their_description():
    texts = ["One two two.\nThree four\n\nTHREE FOUR", "", None, "é ß — 漢字", "A!! B!! C$ d%", "x | y | z\r\n\tend.", "word", "same same same\nsame", *[t for _, t in corpus()[:30] if t is None or len(t) < 5000]]
    for t, row in zip(texts, quality.statistics(texts), strict=True):
        assert row.tolist() == pytest.approx(plain_statistics(t), abs=1e-9), t


def test_quality_fit_equals_direct_equations(spark, monkeypatch):
    """Features, ridge and calibration against numpy on all rows at once, with sums in a tree."""
    monkeypatch.setattr(quality, "FAN", 2)
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(1, 60)) + ("!!! $$$ | " * rng.randrange(4) if i % 3 == 0 else ".")) for i in range(150)]
    y = {i: int(rng.random() < (0.2 if i % 3 == 0 else 0.9)) for i, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame(list(y.items()), "doc_id long, quality int")
    got = quality.fit(quality.text_statistics(docs), labels)
    x, want = quality.statistics([t for _, t in rows]), np.array([y[i] for i, _ in rows], float)
    scale = x.std(axis=0)
    assert got.mean == pytest.approx(x.mean(axis=0)) and got.scale == pytest.approx(np.sqrt(np.maximum(scale**2, 1e-9)) + 1e-6, rel=1e-4)
    z = np.clip((x - got.mean) / got.scale, -8, 8)
    draw = np.random.default_rng(got.seed)
    w, b = draw.normal(size=(z.shape[1], quality.FEATURES)) / got.width, draw.uniform(0, 2 * np.pi, quality.FEATURES)
    phi = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(z @ w + b), np.ones((len(z), 1))])
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / (2 * got.width**2))
    assert np.abs(phi[:, :-1] @ phi[:, :-1].T - kernel).mean() < 0.1
    penalty = 1e-3 * len(rows) / quality.FEATURES * np.diag([*[1.0] * quality.FEATURES, 0.0]) + 1e-9 * np.eye(quality.FEATURES + 1)
    weights = np.linalg.solve(phi.T @ phi + penalty, phi.T @ want)
    raw = phi @ weights
    assert phi @ got.weights == pytest.approx(raw, abs=1e-6)
    bins = np.clip(np.searchsorted(np.linspace(-0.5, 1.5, quality.BINS + 1), raw) - 1, 0, quality.BINS - 1)
    used = np.unique(bins)
    level = np.array([want[bins == k].mean() for k in used])
    size = np.array([(bins == k).sum() for k in used], float)
    best = [max(min(np.average(level[a : c + 1], weights=size[a : c + 1]) for c in range(k, len(used))) for a in range(k + 1)) for k in range(0, len(used), 7)]
    assert got.values[::7] == pytest.approx(best)


def test_statistics_stand_alone():
    texts = ["One two two.\nThree", "", None, "é ß", "A!! B!!", "x | y | z"]
    together = quality.statistics(texts)
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.statistics([t])[0], row)
    assert np.all(np.isfinite(together)) and not together[1].any()


def test_isotonic():
    assert quality.isotonic(np.array([1, 1, 1, 1]), np.array([0, 1, 0, 1])).tolist() == [0, 0.5, 0.5, 1]
    assert quality.isotonic(np.array([2.0]), np.array([1.0])).tolist() == [0.5]


def test_minimisers_of_a_block_sort_only_what_repeats(monkeypatch):
    """Counts equal plain loops, and only rows of repeated minimisers are sorted by their stretches."""
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 400, dtype=np.uint8).tobytes()
    texts = [rng.integers(97, 123, 3000, dtype=np.uint8).tobytes() + (passage if i % 4 == 0 else b"") + rng.integers(97, 123, 500, dtype=np.uint8).tobytes() for i in range(12)] + [b"ab" * 100, b""]
    runs = suffixdedup.Runs(texts)
    held = {}
    for v, d, t in zip(runs.value.tolist(), runs.doc.tolist(), runs.text.tolist(), strict=True):
        docs, stretches = held.setdefault(v, (set(), set()))
        docs.add(d)
        stretches.add(t)
    lexsort, rows = np.lexsort, []
    monkeypatch.setattr(suffixdedup.np, "lexsort", lambda keys: rows.append(len(keys[0])) or lexsort(keys))
    value, several, stretches = suffixdedup._distinct_values(runs)
    assert value.tolist() == sorted(held)
    assert several.tolist() == [len(held[v][0]) > 1 for v in sorted(held)]
    assert stretches.tolist() == [len(held[v][1]) for v in sorted(held)]
    assert any(several) and sum(rows) < len(runs.value) / 2


def test_hashes_of_all_grams_equal_those_of_spans():
    data = np.random.default_rng(6).integers(0, 256, 1000, dtype=np.uint8)
    h = suffixdedup.prefix_hash(data)
    for size in (1, 24, 1000, 1001):
        at = np.arange(max(1001 - size, 0))
        assert suffixdedup.gram_hash(h, size).tolist() == suffixdedup.span_hash(h, at, at + size).tolist()


def test_minimisers_are_sent_with_few_bits():
    """A bucket of 2 MB is asked in less than four bytes a minimiser, and what is shared is still found."""
    rng = np.random.default_rng(7)
    blocks = [[rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()] for _ in range(2)]
    blocks[1][0] += blocks[0][0][1000:3000]
    buckets = 4
    spare = suffixdedup._spare_bits(buckets * suffixdedup.BUCKET_BYTES, buckets)
    asked = [suffixdedup._asked_values(texts, buckets, spare) for texts in blocks]
    values = [suffixdedup._distinct_values(suffixdedup.Runs(texts))[0] for texts in blocks]
    assert sum(len(p) + len(e) for rows in asked for _, p, e in rows) < 4 * sum(map(len, values))
    both = set(values[0].tolist()) & set(values[1].tolist())
    told = [set(), set()]
    for b in range(buckets):
        rows = [next(r for r in a if r[0] == b) for a in asked]
        answers = suffixdedup.answer_values(pa.table({"payload": [r[1] for r in rows], "extra": [r[2] for r in rows]}))
        for k in (0, 1):
            own = values[k][suffixdedup._dealt(values[k], buckets) == b]
            told[k] |= set(own[np.frombuffer(suffixdedup._unzip(answers[k]), np.uint8) > 0].tolist())
    assert len(both) > 50 and both <= told[0] & told[1]
    assert all(len(t - both) < 50 for t in told)
    assert suffixdedup._spare_bits(10**15, 256) == 0
