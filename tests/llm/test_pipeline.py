"""The stages of the corpus pipeline against plain versions on the small tables."""

import math
import re
from array import array
from collections import Counter
from functools import cache

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm import plain_model

from brindle.llm import kneser_ney, minhash, mixing, secrets
from brindle.llm.text import through_table


@pytest.fixture(scope="module")
def staged(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(through_table(stage(spark, out[-1], sf), "test"))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_are_those_of_documents(staged):
    assert all(df.schema == staged[0].schema for df in staged[1:-1])


def test_quality_stage(spark, sf, staged):
    kept = kneser_ney.classify(staged[0], spark.read.parquet(f"{sf}/labels.parquet")).where("kept")
    assert ids(staged[1]) == ids(kept) and len(ids(staged[1])) < staged[0].count()


def test_quality_stage_gathers_no_model(spark, sf, staged, monkeypatch):
    """Probabilities reach the documents by joins: the driver sees single rows, and nothing is broadcast from Python."""
    frame, collect = type(staged[0]), type(staged[0]).collect

    def few(df):
        rows = collect(df)
        assert len(rows) <= 1
        return rows

    def none(*_):
        raise AssertionError("a model was gathered")

    want = ids(staged[1])
    monkeypatch.setattr(frame, "collect", few)
    monkeypatch.setattr(frame, "toPandas", none)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", none)
    kept = corpus_pipeline.quality(spark, staged[0], sf)
    monkeypatch.undo()
    assert ids(kept) == want


def test_quality_stage_against_a_plain_model(spark, sf, staged, monkeypatch):
    """The stage's perplexities on the given tables are those of Kneser-Ney by its definition, and its verdicts follow from them."""
    rows = staged[0].select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).collect()
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    trusted = Counter(r["lang"] for r in rows if r["doc_id"] in good)
    langs = {x for x in trusted if x and trusted[x] > min(trusted.values())}  # the rarest has no model of its own
    seen, classify = [], kneser_ney.classify
    monkeypatch.setattr(kneser_ney, "MIN_TRUSTED", min(trusted.values()) + 1)
    monkeypatch.setattr(kneser_ney, "BUCKET", 1 << 17)  # several buckets
    monkeypatch.setattr(kneser_ney, "classify", lambda *x, **y: seen.append(classify(*x, **y)) or seen[-1])
    kept = ids(corpus_pipeline.quality(spark, staged[0], sf))
    got = {r["doc_id"]: r for r in seen[0].collect()}
    assert len(rows) == len(got) and langs
    units = {r["doc_id"]: array("H", re.sub(r"\s+", " ", r["text"].lower()).encode("utf-16-le", "surrogatepass")).tolist() for r in rows}
    models = {x: cache(plain_model([r["text"] for r in rows if r["doc_id"] in good and x in (r["lang"], "*")])) for x in (*langs, "*")}
    group = {r["doc_id"]: r["lang"] if r["lang"] in langs else "*" for r in rows}
    loss = {i: -sum(math.log(models[group[i]](g)) for g in zip([0, 0, 0, *u], [0, 0, *u], [0, *u], u)) for i, u in units.items()}
    of = {x: [i for i in loss if i in good and x in (group[i], "*")] for x in models}
    mean = {x: sum(loss[i] for i in of[x]) / sum(len(units[i]) for i in of[x]) for x in models}
    perplexity = {i: math.exp((loss[i] + kneser_ney.PRIOR * mean[group[i]]) / (len(units[i]) + kneser_ney.PRIOR)) for i in loss}
    assert {i: r["perplexity"] for i, r in got.items()} == pytest.approx(perplexity, rel=1e-9)
    cut = {x: kneser_ney.MARGIN * sorted(perplexity[i] for i in of[x])[math.ceil(kneser_ney.QUANTILE * len(of[x])) - 1] for x in models}
    assert kept == sorted(i for i, x in perplexity.items() if x <= cut[group[i]]) and len(kept) < len(rows)


def test_one_document_of_each_class_stays(staged):
    classes = minhash.near_duplicates(staged[1]).collect()
    assert ids(staged[2]) == sorted({r["class_id"] for r in classes})


def test_secrets_are_gone_and_the_rest_stays(staged):
    before, after = (dict(df.select("doc_id", "text").collect()) for df in staged[2:4])
    assert before.keys() == after.keys()
    for i, t in after.items():
        assert not secrets.base_spans(t or "") and ((t or "") == (before[i] or "") or "[SECRET]" in t)


def test_mix_takes_what_it_says(staged):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(staged[3]).collect()}
    words = staged[4].select("doc_id", "text").collect()
    got: dict[int, int] = {}
    for i, t in words:
        got[i] = got.get(i, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in got.items() if n}


def test_packing_covers_every_row(staged):
    docs = staged[4].count()
    whole = staged[5].groupBy("doc_id", "start").count()
    assert staged[5].where("start = 0").count() == docs and whole.count() > 0
    full = staged[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048")
    assert full.isEmpty()


def test_run_gives_the_last_stage(spark, sf, staged):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == staged[5].columns and got.agg(F.sum("length")).first() == staged[5].agg(F.sum("length")).first()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, ties, null and empty texts, a very long text and columns that clash with those of the stages."""
    a, b, long = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40)), " ".join(f"w{i % 977}x{i % 1009}" for i in range(60_000))
    texts = [(3, a), (5, a), (5, b), (None, a), (None, b + " more"), (7, None), (8, ""), (8, ""), (9, long), (10, f"password: hunter22 {b[::-1]}"), (10, f"password: hunter22 {b[::-1]}")]
    rows = [(i, t, "en" if k % 2 else None, "s" if k % 3 else None, len(t) if t else None, *range(k, k + 9)) for k, (i, t) in enumerate(texts)]
    names = ["part", "whole", "t_id", "first", "row", "node", "key", "size", "spans"]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))


def test_stages_on_odd_rows(spark, sf, odd):
    whole = {tuple(r) for r in odd.collect()}
    judged = corpus_pipeline.quality(spark, odd, sf)
    assert judged.schema == odd.schema and {tuple(r) for r in judged.collect()} <= whole
    single = corpus_pipeline.near_copies(spark, odd, sf)
    got = sorted(single.select("doc_id", "text").collect(), key=str)
    texts = [r["text"] for r in got]
    assert single.schema == odd.schema and {tuple(r) for r in single.collect()} <= whole
    by_text = {r["text"]: r["doc_id"] for r in got if r["text"]}
    rows = odd.collect()
    assert by_text[rows[0]["text"]] == 3 and by_text[rows[2]["text"]] == 5 and rows[4]["text"] not in by_text
    assert len(by_text) == 4 and texts.count(None) == 1 and texts.count("") == 2 and len(got) == 7
    clean = corpus_pipeline.secret_free(spark, odd, sf)
    assert clean.schema == odd.schema and clean.count() == odd.count() and clean.where("doc_id = 10 AND text NOT LIKE '[SECRET]%'").isEmpty()
    mix = corpus_pipeline.mixed(spark, odd, sf)
    taken = mixing.mix(odd).agg(F.sum("taken")).first()[0]
    assert [f.name for f in mix.schema] == odd.columns and sum(len((r["text"] or "").split()) for r in mix.collect()) == taken
    pieces = corpus_pipeline.packed(spark, odd, sf)
    assert pieces.where("start = 0").count() == odd.count()


def test_stages_on_an_empty_table(spark, sf, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).isEmpty()
