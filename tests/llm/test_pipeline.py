"""The pipeline on a small corpus, stage by stage against brute-force versions."""

import random
import sys

import pytest

import corpus_pipeline
from test_models_and_groups import groups
from test_text_operators import lines_left, windows_hit


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: f"{rng.choice(['ba', 'de', 'mo', 'ti'])}{rng.choice(['n', 'r', 'st'])}{rng.choice(['a', 'e', 'io'])}{rng.randrange(90)}"
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(text(20) for _ in range(5))) for i in range(160)]
    for i in range(0, 160, 4):
        rows[i] = (i, rows[i][1].replace(" ", " vile ", 2))
    shared, passage = text(12), text(30)
    rows[5], rows[9] = (5, f"{shared}\n{rows[5][1]}"), (9, f"{rows[9][1]}\n{shared}")
    rows[13] = (13, rows[11][1])
    rows[17] = (17, rows[15][1].replace("\n", " "))
    rows[19] = (19, rows[15][1].replace("\n", " ") + " end")
    rows[21] = (21, f"{rows[21][1]} {passage}")
    rows += [(500, None), (501, ""), (502, "short")]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(rows), passage


def test_stages_equal_brute_force(spark, corpus, tmp_path):
    path, before, passage = corpus
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), None
    columns = docs.columns
    want = {
        "toxicity": lambda t: {i: x for i, x in t.items() if i >= 160 or i % 4},
        "line_dedup": lambda t: {
            i: left[2] if (left := lines_left(list(t.items())).get(i)) else x for i, x in t.items() if not left_empty(t, i)
        },
        "near_dedup": lambda t: {i: x for i, x in t.items() if groups(list(t.items()))[i] == i},
        "decontamination": lambda t: {i: x for (i, x), hit in zip(t.items(), windows_hit(list(t.items()), [(1, passage)])) if not hit[-1]},
    }

    def left_empty(t, i):
        lines = lines_left(list(t.items())).get(i)
        return lines is not None and lines[0] == lines[1]

    texts = before
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, path)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        texts = want[name](texts)
        assert {r.doc_id: r.text for r in docs.collect()} == texts, name
    assert {11, 15, 500, 501, 502} <= set(texts) and not {13, 17, 19, 21} & set(texts)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in last} == set(texts)
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, path).collect()} == {r.doc_id: r.n_tokens for r in last}


def test_entry_works_without_the_text_package(monkeypatch):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "depthlens.llm", None)
    names = __spark_entry__.queries()
    assert "f03_time_bars" in names and not [n for n in names if n.startswith("op")] and set(__spark_entry__.oracle_sql()) <= set(names)


def test_near_dedup_stage_links_from_four_fifths(spark):
    rng = random.Random(4)
    words = [f"w{i}{rng.randrange(1000)}" for i in range(104)]
    other = [f"o{i}{rng.randrange(1000)}" for i in range(104)]
    # 100 shingles each: 90 of 110 (0.818) are shared by 0 and 1, 88 of 112 (0.786) by 2 and 3
    rows = [(0, words), (1, words[:94] + [f"x{i}" for i in range(10)]), (2, other), (3, other[:92] + [f"y{i}" for i in range(12)])]
    rows = [(i, " ".join(w)) for i, w in rows]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert groups(rows, percent=85)[1] == 1 and groups(rows, percent=80) == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, None).collect()} == {0, 2, 3}
