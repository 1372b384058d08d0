"""The registered queries, their SQL, and the pipeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from roadloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    order = lambda f: f[sorted(f.columns)].sort_values(sorted(f.columns)).reset_index(drop=True)
    got, want = order(entry.queries()[name](spark, sf_dir).toPandas()), order(con.sql(entry.oracle_sql()[name]).df())
    assert got.dtypes.tolist() == want.dtypes.tolist() and got.equals(want)


@pytest.mark.parametrize("name", [n for n in queries.queries() if not n.startswith("op2_")])
def test_every_document_is_answered(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = entry.queries()[name](spark, sf_dir)
    assert got.select("doc_id").distinct().count() == docs.count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "suffix-array dedup", "best-fit packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        now = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
        assert now <= ids
        if k < 4:
            assert out.columns == columns and out.count() == len(now)
            assert k == 0 or out.where("n_chars <> char_length(text)").count() == 0
        else:
            assert now == ids
        docs, ids = out, now


def test_pipeline_runs_as_a_query(spark, sf_dir):
    assert entry.queries()["pipeline"](spark, sf_dir).agg(F.max("length")).first()[0] <= 2048


LINE = "one passage of well over fifty bytes that several documents share with each other"
CLEAN = "The road runs north along the river. It turns at the old mill. Carts wait there for the ferry."


def odd_documents(spark):
    """Null ids, an id with two texts, repeated rows, null and empty texts, and columns whose names operators use inside."""
    rows = [
        (None, CLEAN), (None, "q " + CLEAN.upper()), (3, CLEAN), (5, CLEAN), (5, "zz " + LINE), (5, "zz " + LINE), (2, LINE + " tail one"), (2, LINE + " tail two"),
        (1, LINE), (None, LINE + " nobody"), (7, None), (8, ""), (None, None), (7, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(("key", "_key", "kept", "hash", "_left", "block", "score", "class_id", "_first", "norm", "payload"))})


def test_exact_stage_judges_rows(spark):
    docs = odd_documents(spark)
    out = corpus_pipeline.exact_dedup(spark, docs, "")
    assert out.columns == docs.columns
    texts = [r["text"] for r in out.collect()]
    assert sorted(t or "" for t in texts) == sorted({r["text"] or "" for r in docs.collect()})
    assert out.where(F.col("text") == CLEAN).first()["doc_id"] == 3
    assert corpus_pipeline.exact_dedup(spark, docs.limit(0), "").count() == 0


def test_near_stage_judges_rows(spark):
    docs = odd_documents(spark)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    left = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
    # a word or two more leave over 0.8 of the shingles in common, and capitals are no difference; rows without words are classes of their own
    assert left == sorted([("3", CLEAN), ("1", LINE), ("7", ""), ("8", ""), ("None", "")])
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_passage_stage_keeps_every_text(spark):
    docs = odd_documents(spark)
    out = corpus_pipeline.passage_dedup(spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == docs.count()
    got = sorted((str(r["doc_id"]), str(r["text"]).strip(), r["n_chars"] == (None if r["text"] is None else len(r["text"]))) for r in out.collect())
    assert ("2", "tail one", True) in got and ("2", "tail two", True) in got and ("1", LINE, True) in got
    assert got.count(("5", "zz", True)) == 2 and ("None", "nobody", True) in got and ("3", CLEAN, True) in got and ("5", "", True) in got and ("None", "", True) in got
    assert ("7", "None", True) in got and corpus_pipeline.passage_dedup(spark, docs.limit(0), "").count() == 0


def test_quality_and_packing_stages_take_any_rows(spark, sf_dir):
    docs = odd_documents(spark)
    out = corpus_pipeline.quality_filter(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.where(F.col("text") == CLEAN).count() in (0, 3)
    pieces = corpus_pipeline.pack(spark, docs, sf_dir)
    assert pieces.count() == docs.count() and pieces.where("doc_id is null").count() == 4
    for stage in (corpus_pipeline.quality_filter, corpus_pipeline.pack):
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def plain_pipeline(rows, scores):
    """The stages by brute force: ``scores`` says what the classifier gives each text."""
    import test_operators as brute

    rows = [(i, t) for i, t in rows if scores[t] >= corpus_pipeline.QUALITY_THRESHOLD]
    groups = {}
    for i, t in rows:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i, t))
    rows = [min(g)[1:] for g in groups.values()]
    classes = brute.classes_of(rows)
    rows = [(i, t) for i, t in rows if classes[i] == i]
    marks = brute.removed(rows)
    out = {}
    for i, t in rows:
        raw, gone = marks[i]
        text, at = "", 0
        for c in t or "":
            n = len(c.encode())
            text += "" if gone[at : at + n].all() else c
            at += n
        out[i] = text if gone.any() else t or ""
    return out


def test_pipeline_equals_brute_force(spark, sf_dir, tmp_path):
    import test_operators as brute
    from tokenizers import Tokenizer

    from roadloom.llm import quality, tokencount

    rng = __import__("random").Random(3)
    sentence = lambda: brute.prose(rng, 9).capitalize() + "."
    rows = [(i, " ".join(sentence() for _ in range(rng.randrange(3, 12)))) for i in range(120)]
    rows += [(200 + i, rows[i][1].replace(" ", "  ", 2)) for i in range(15)] + [(300 + i, rows[20 + i][1] + " More.") for i in range(15)]
    rows += [(400 + i, f"{sentence()} {rows[50 + i][1][:120]} {sentence()}") for i in range(15)] + [(500, None), (501, "| % | $$$ !!! " * 30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, df in (("documents", docs), ("labels", spark.read.parquet(f"{sf_dir}/labels.parquet").unionByName(spark.createDataFrame([(i, int(i != 501), 0) for i, _ in rows], "doc_id long, quality int, toxic int"), allowMissingColumns=True))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(quality.text_statistics(docs), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = plain_pipeline(rows, {t: float(model.score(quality.statistics([t]))[0]) for _, t in rows})
    library = Tokenizer.from_file(tokencount.default_path("word_bpe_49k.json"))
    got, full = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert 60 < len(want) < len(rows) and all(sum(n for _, n in s) <= 2048 for s in full.values()) and len(full) <= -(-sum(got.values()) // 2048) + 1


def test_passages_go_from_later_documents(spark, tmp_path):
    line = "one passage of well over fifty bytes that several documents share with each other"
    rows = [(1, f"a start. {line} an end.", "en", "s", 0), (2, f"{line} é", "en", "s", 0), (3, None, "en", "s", None), (4, "short", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"_id": F.lit("x"), "_text": F.lit("y")})
    out = {r["doc_id"]: r for r in corpus_pipeline.passage_dedup(spark, docs, "").collect()}
    assert out[1]["text"] == rows[0][1] and out[1]["n_chars"] == 0 and (out[2]["text"], out[2]["n_chars"]) == ("é", 1) or out[2]["text"].strip() == "é"
    assert out[3]["text"] is None and out[4]["text"] == "short" and out[1]["_id"] == "x"
