import random

import corpus_pipeline
from factspan.llm import queries


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [make(60) for _ in range(30)]
    toxic = [make(20) + " vilename " + make(10) + " vilename" for _ in range(20)]
    bench = make(12)
    near = " ".join(["other", *clean[0].split()[1:]])
    texts = [*clean, *toxic, clean[1], near, make(20) + " " + bench + " " + make(5), None, ""]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(30 <= i < 50)) for i in range(50)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(30)) <= set(rows) and not set(range(30, 50)) & set(rows)
    assert rows[1]["text"] == clean[1]
    assert not {50, 51, 52} & set(rows)  # a copy and a near copy, whose lines repeat, and a benchmark passage
    assert [i for i, r in rows.items() if not r["text"]] == [53, 54]  # as they were
    assert rows[0]["n_tokens"] == len(rows[0]["ids"]) > 60 and rows[53]["n_tokens"] == 0
    assert out.count() == len(rows)


def test_near_copies_go(spark, tmp_path):
    rng = random.Random(3)
    lines = [" ".join(f"v{rng.randint(0, 900)}" for _ in range(12)) for _ in range(14)]
    other = [" ".join(reversed(x.split())) if k % 7 == 3 else x + f" and one more word {k}" if k % 2 else " ".join([f"n{k}", *x.split()[1:]]) for k, x in enumerate(lines)]
    texts = ["\n".join(lines), "\n".join(other), "\n".join(lines[:6]) + "\nits own words here and no others at all"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    near = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(0, " ".join(lines)), (1, " ".join([*lines[:-1], lines[-1] + " x"])), (2, "its own words")], docs.schema), str(tmp_path))
    assert sorted(r["doc_id"] for r in near.collect()) == [0, 2]
    kept = corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path))
    assert {r["doc_id"]: r["text"].count("\n") for r in kept.collect()}[2] == 0


def test_odd_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score string, lost string, row string, hits string"
    rows = [(1, "some words here", "en", "s", 15, *"abcde"), (1, "some words here", "en", "s", 15, *"abcde"), (None, None, None, None, None, *[None] * 5), (2, "", "en", "s", 0, *"abcde"), (3, "x " * 60_000, "en", "s", 0, *"abcde")]
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, some in enumerate((rows, [])):
        out = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, out = out, stage(spark, out, str(tmp_path))
            assert out.columns == before.columns, name
        out = corpus_pipeline.encode(spark, out, str(tmp_path))
        assert out.count() == (0 if k else 5) and {"ids", "decoded", "n_tokens"} <= set(out.columns)


def test_registered():
    assert [n for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
