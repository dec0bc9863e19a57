"""The pipeline's stages one after another on a small table, against what each must leave."""

import random

import corpus_pipeline
from clinloom.llm import tokens

WORDS = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("l", "n", "rt", "s", "m")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def test_run_keeps_clean_documents_and_drops_the_planted(spark, tmp_path):
    rng = random.Random(5)
    item, clean = prose(rng, 40), [prose(rng, rng.randint(30, 200)) for _ in range(25)]
    near = clean[0].split(" ")
    near[len(near) // 2] = "changed"
    long_ = "\n".join(prose(rng, 40) for _ in range(400))
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[1]), (101, " ".join(near)), (102, None), (103, ""), (104, "12 34 !?"), (105, item), (106, clean[2] + "\n" + prose(rng, 60)), (107, long_), (None, prose(rng, 50)), (None, item + " end")]
    rows = [(i, t, "aa", "s", len(t or "")) for i, t in rows] + [(3, clean[3], "aa", "s", len(clean[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", item), (None, None)], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    kept = {r.doc_id for r in got}
    # exact copies fall to the line stage, near copies to the next, benchmark text to the one after
    assert kept == {*range(25), 106, 107, None}
    enc = tokens.Encoder(tokens.public_path("word_bpe_49k.json"))
    n = {}
    for r in got:
        n[r.doc_id] = n.get(r.doc_id, 0) + r.length
    for i in (0, 5, 24):
        assert n[i] == len(enc.library.encode(clean[i], add_special_tokens=False).ids) + 1
    # the row that repeats stays twice, as one document; the null id's other row was benchmark text
    assert n[3] == 2 * (len(enc.library.encode(clean[3], add_special_tokens=False).ids) + 1)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at
            at += size
        assert at <= 4096


def test_run_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, prose(rng, 30), "aa", "s", 5) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([("b", prose(rng, 20))], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.dtypes == docs.dtypes and out.count() == 12
