"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tally.llm import (
    decontaminate,
    jaccard_join,
    line_dedup,
    mixing,
    personal_data,
    quality_classifier,
    quality_rules,
    substring_dedup,
    suffix_tree_lm,
    token_files,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("text_hash", "n_words", "key", "row", "h", "f", "n", "at", "size", "score", "held_out", "begin", "__x", "good", "bad")
WORDS = [f"wort{i}" for i in range(400)]
LONG = " ".join(WORDS[i * 7 % 400] + str(i % 13) for i in range(30_000))
ITEM = " ".join(WORDS[100:120])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "A plain text with rather more than ten words in it, and nothing else to say at all."),
        (2, None),
        (3, ""),
        (4, " \t\n\x0b "),
        (None, "a text without an id but with words enough to be more than nothing at all here"),
        (5, "same same"),
        (5, "same same"),
        (6, LONG),
        (7, LONG + " tail"),
        (8, "before " + ITEM + " after"),
        (9, "line one\nline two\nline three\nline four"),
        (10, "line one\nline two\nline three\nline four"),
        (11, "x" * 5_000),
        (12, "Été \U0001f600 naïve\u2003café naïve | | | # #"),
    ]
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 5 else "s", 0) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, None), (3, None, 1), (8, 1, 0), (9, 0, 1), (9, 1, 1), (None, 1, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, "same same"), (4, "naïve")], "item_id long, text string")


def rows_of(df):
    return sorted(map(str, df.collect()))


PER_ROW = {
    "lines": lambda d, la, b: line_dedup.deduplicated(d),
    "contamination": lambda d, la, b: decontaminate.contamination(d, b),
    "toxicity": lambda d, la, b: toxicity.scored(d, la),
    "tokens": lambda d, la, b: token_files.encoded(d),
    "near": lambda d, la, b: jaccard_join.near_duplicates(d),
    "mix": lambda d, la, b: mixing.taken_words(d),
    "quality": lambda d, la, b: quality_classifier.classify(d, la)[0],
    "rules": lambda d, la, b: quality_rules.judge_documents(d),
    "personal data": lambda d, la, b: personal_data.personal_spans(d),
    "suffix tree": lambda d, la, b: suffix_tree_lm.scored(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row_and_reruns_agree(docs, labels, benchmark, name):
    out = PER_ROW[name](docs, labels, benchmark)
    first = rows_of(out)
    assert len(first) == docs.count()
    assert first == rows_of(PER_ROW[name](docs.repartition(3), labels, benchmark))


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables(docs, labels, benchmark, name):
    none = docs.limit(0)
    assert PER_ROW[name](none, labels.limit(0), benchmark.limit(0)).count() == 0
    assert PER_ROW[name](docs, labels.limit(0), benchmark.limit(0)).count() == docs.count()


def test_passages_of_odd_rows(docs):
    found = substring_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.other_id) for r in found} in ({(6, 7)}, {(7, 6)})
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_verdicts_on_odd_rows(docs, benchmark):
    near = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert {(2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 1, 5)} <= near and (7, 6) in {(a, c) for a, _, c in near}
    hit = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark).collect()}
    assert hit[8].contaminated and hit[8].n_hit == 20 and hit[8].n_items == 1
    assert hit[5].contaminated and hit[5].n_items == 0 and hit[12].n_items == 1
    assert not hit[2].contaminated and not hit[6].contaminated
    lines = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    assert lines[9].n_deleted == 0 and lines[10].n_deleted == 4 and lines[10].clean_text == ""
    taken = mixing.taken_words(docs)
    assert taken.where("size = 0 AND taken <> 0 OR taken > 2 * size").count() == 0
    assert token_files.encoded(docs).where("doc_id IN (2, 3, 4) AND n_tokens <> 1").count() == 0


def test_stages_keep_columns(spark, docs, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 2, 3, 4, 5, 6, 8, 9, 11, 12]
