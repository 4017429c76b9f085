"""run() against the stages done one after another by brute force."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from lagweave.llm import language_id, queries

from .test_operators import brute_components, brute_hits, brute_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    words = {lang: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(600)] for lang, letters in (("en", "abcdefg"), ("de", "ßüöhijklm"), ("es", "ñópqrstu"))}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, make(lang, 120), lang, "s", 0) for k, lang in enumerate(list(words) * 30)]
    passage, item = make("en", 50), make("de", 30)
    rows += [(200 + k, f"{make('en', 60)} {passage} {make('en', 60)}", "en", "s", 0) for k in range(3)]
    rows += [(300, rows[0][1] + " tail", "en", "s", 0), (301, rows[0][1], "en", "s", 0), (302, "12 34", "en", "s", 0), (303, None, "de", "s", 0), (304, f"{make('de', 20)} {item} {make('de', 20)}", "de", "s", 0), (305, make("es", 5000), "es", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, make("es", 12))], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, [("1", item)]


def test_stages(spark, sf_dir):
    path, rows, items = sf_dir
    docs = queries.table(spark, path, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "near copies", "passages", "benchmark", "packing"]
    lang = {r["doc_id"] for r in language_id.recognised(docs).collect()}
    assert lang == {r[0] for r in rows} - {302, 303}
    left = [r for r in rows if r[0] in lang]
    kept = {c for _, _, c in brute_components(left, 5, 80)}
    left = [r for r in left if r[0] in kept]
    removed = {k[0]: k for k in brute_windows(left, 35)}
    assert {d for d, k in removed.items() if k[2]} == {200, 201, 202}
    clean = {k[0] for k in brute_hits(left, items, 10) if not k[5]}
    got = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        assert now.columns == docs.columns
        got[name] = {r["doc_id"]: r for r in now.collect()}
    assert set(got["near copies"]) == kept and set(got["passages"]) == kept and set(got["benchmark"]) == clean
    assert {d: len(WORD.findall(r["text"])) for d, r in got["passages"].items()} == {d: k[1] - k[2] for d, k in removed.items()}
    final = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in final} == clean
    fill = Counter()
    for r in final:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and set(fill) == set(range(len(fill)))
