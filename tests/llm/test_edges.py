"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import corpus_pipeline
import pytest
import public_tokenizers

from lodestone.llm import decontamination, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, substring_parse, token_counts, toxicity, url_filters

BPE = public_tokenizers.path("byte_bpe_50k.json")


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def _operators(spark, given=()):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7"), (None, None), (2, "")], "item_id long, text string")
    none = _labels(spark, given)
    return {
        "quality_classifier": lambda d: quality_classifier.assess(d, quality_classifier.train(d, none)),
        "substring_dedup": substring_dedup.remove_units,
        "clean": substring_dedup.clean,
        "toxicity": lambda d: toxicity.assess(d, toxicity.train(d, none)),
        "quality_rules": lambda d: quality_rules.assess(d, quality_rules.train(d, none)),
        "contaminated": lambda d: decontamination.contaminated(d, bench),
        "decontaminate": lambda d: decontamination.decontaminate(d, bench),
        "token_counts": lambda d: token_counts.count_tokens(d, BPE),
        "substring_parse": substring_parse.remove_repeats,
        "near_dedup": near_dedup.near_duplicates,
        "packing": lambda d: packing.pack(d, BPE),
    }


NAMES = ("quality_classifier", "substring_dedup", "toxicity", "quality_rules", "token_counts", "substring_parse", "near_dedup")


@pytest.mark.parametrize("name", NAMES)
def test_a_row_each(spark, frame, odd, name):
    got = [r["doc_id"] for r in _operators(spark)[name](frame(odd)).collect()]
    assert sorted(got, key=str) == sorted((i for i, _ in odd), key=str)


LABELS = [(1, 1, 1), (2, 1, 1), (3, 1, 0), (4, 0, 1), (5, 0, 0), (6, 0, None), (8, 0, 0), (9, 1, 0), (None, 1, 1), (12, 1, 1), (13, 0, 0), (99, 1, 1), (15, None, 1)] * 2


@pytest.mark.parametrize("name", ["quality_classifier", "toxicity", "quality_rules"])
def test_fitted_models_on_odd_rows(spark, frame, odd, name):
    rows = _operators(spark, LABELS)[name](frame(odd)).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, _ in odd), key=str)
    assert all(0 <= r["score"] <= 1 for r in rows)
    by: dict = {}
    for r in rows:  # repeated rows get one score
        assert r["doc_id"] is None or by.setdefault(r["doc_id"], r["score"]) == pytest.approx(r["score"], abs=1e-5)


def test_rows_of_pairs_and_pieces(spark, frame, odd):
    own = _operators(spark)
    assert {r["doc_id"] for r in own["packing"](frame(odd)).collect()} == {i for i, _ in odd}
    assert len([r for r in own["packing"](frame(odd)).collect() if r["piece"] == 0]) == len(odd)
    bench = spark.createDataFrame([(1, odd[0][1]), (1, odd[0][1]), (None, None), (2, ""), (3, "x y")], "item_id long, text string")
    got = [(str(r["doc_id"]), r["item_id"]) for r in decontamination.contaminated(frame(odd), bench).collect()]
    hit = [str(i) for i, t in odd if t and odd[0][1] in t.lower()] + ["3"]
    assert sorted(got) == sorted((i, 1) for i in hit for _ in range(2))


@pytest.mark.parametrize("name", [*NAMES, "clean", "contaminated", "decontaminate", "packing"])
def test_empty_table(spark, frame, name):
    assert _operators(spark)[name](frame([])).collect() == []


def test_filters_keep_columns(spark, frame, odd):
    docs = frame(odd)
    assert _operators(spark)["decontaminate"](docs).columns == docs.columns
    cleaned = substring_dedup.clean(docs)
    assert cleaned.columns == docs.columns
    assert {r["k"] for r in cleaned.collect()} == {"x"}
    assert {(r["doc_id"], r["text"]) for r in cleaned.where("text IS NULL").collect()} == {(4, None), (None, None)}


def test_urls(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "no scheme"), (4, "http://A.com/en/" + "x" * 100_000)]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, rule string")
    got = {(r["page_id"], r["host"], r["verdict"]) for r in url_filters.filter_urls(pages).collect()}
    assert got == {(1, "", "allow"), (2, "", "allow"), (3, "", "allow"), (4, "a.com", "block")}
    assert url_filters.filter_urls(pages.limit(0)).collect() == []


def test_stages(spark, frame, odd, tmp_path):
    for name in ("labels", "benchmark"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int" if name == "labels" else "item_id long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    for rows in (odd, []):
        docs = frame(rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert tuple(docs.columns) == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert (docs.count() > 0) == bool(rows)
