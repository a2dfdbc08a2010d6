"""The mix of whole texts."""

import re

import corpus_pipeline
from tally.llm import mixing
from tally.llm.queries import QUERIES


def test_texts_at_the_border_are_whole_or_left_out(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3_000 if i % 20 == 0 else 30)), "en", f"s{i % 3}", 0) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = {r[0]: r[1] for r in rows}
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, df, "").collect()]
    assert mixed and all(text == texts[i] for i, text in mixed)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    taken = QUERIES["op6_mixing"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.taken for r in taken if r.taken} == {
        i: sum(len(t.split()) for j, t in mixed if j == i) for i in {i for i, _ in mixed}
    }
    per = {}
    for r in mixing.taken_words(df, whole=True).collect():
        got = per.setdefault(r.source, [r.target, 0])
        got[1] += r.taken
    assert all(abs(target - words) <= 1_500.5 for target, words in per.values())


def plain_targets(sizes):
    """Targets by source, of sizes by source: weights 3, 1, 2 by code point, null last, at most twice the size."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def odd_rows():
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", None), (None, "w " * 70, "b"), (5, "same same", "b")]
    rows += [(5, "same same", "b")] * 2 + [(6, "x " * 5_000, "c"), (7, "x " * 5_000, "c"), (8, "é té \U0001f600", "\U0001f600")]
    return rows + [(i, f"w{i} " * (i % 40), "abc"[i % 3] if i % 11 else None) for i in range(10, 160)]


def test_odd_rows_in_the_registered_form(spark, tmp_path):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    taken = QUERIES["op6_mixing"](spark, str(tmp_path)).collect()
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert sorted((str(r.doc_id), r["size"]) for r in taken) == sorted((str(i), size(text)) for i, text, _ in rows)
    per, border = {}, {}
    for _, text, source in rows:
        per[source] = per.get(source, 0) + size(text)
        border[source] = max(border.get(source, 0), size(text))
    target = plain_targets(per)
    assert {(r.source_size, round(r.target, 6)) for r in taken} == {(per[s], round(target[s], 6)) for s in per}
    assert all(0 <= r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for r in taken)
    got = {}
    for r in taken:
        key = (r.source_size, round(r.target, 6))
        got[key] = got.get(key, 0) + r.taken
    for s in per:
        assert abs(got[(per[s], round(target[s], 6))] - target[s]) <= border[s] / 2 + 1, s
    again = QUERIES["op6_mixing"](spark, str(tmp_path)).collect()
    assert sorted(map(str, taken)) == sorted(map(str, again))


def test_an_empty_table_and_one_source(spark, tmp_path):
    schema = "doc_id long, text string, source string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert QUERIES["op6_mixing"](spark, str(tmp_path / "none")).count() == 0
    rows = [(i, "w " * 10, None) for i in range(20)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    taken = QUERIES["op6_mixing"](spark, str(tmp_path / "one")).collect()
    assert sum(r.taken for r in taken) == 300 and {r.taken for r in taken} == {10, 20} and {r.target for r in taken} == {300.0}
