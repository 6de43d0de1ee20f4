import random

import corpus_pipeline
from hazeline.llm import completion, leaks, quality
from hazeline.llm.tokens import tokenizer_path

from .test_leaks import fewest_edits
from .test_lines import brute_force as alike_lines
from .test_models import slow_counts
from .test_simhash import components, reference_print


def tables(tmp_path, spark):
    rng = random.Random(12)
    vocabulary = ["%s%s" % (a, b) for a in ("ing", "er", "tion", "ou", "re", "th") for b in ("a", "es", "ly", "nd", "ea", "wh", "st")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(30)) for i in range(4)]
    rows = []
    for i in range(120):
        text = "\n".join(prose(rng.randint(20, 40)) for _ in range(rng.randint(2, 5)))
        if i % 10 == 3:
            text += "\n" + prose(10) + " " + items[i % 4][1] + " " + prose(12)
        if i % 10 == 5:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text))
    rows += [(200 + i, rows[i][1]) for i in range(8)] + [(300 + i, rows[i][1].replace("ing", "in", 1)) for i in range(8)]
    rows += [(400, None), (401, ""), (None, prose(90)), (402, "short"), (403, rows[0][1].split("\n")[0] + "\n" + prose(60))]
    labels = [(i, int(i % 10 != 5), 0) for i in range(120) if i % 2 or i % 10 == 5]
    spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, items


def test_pipeline_matches_plain_stages(spark, tmp_path):
    rows, items = tables(tmp_path, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    # the regression's own verdicts are tested elsewhere; the rest is plain Python
    model = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))

    def passes(text):
        n, *_, repeated = slow_counts(text)
        return n >= 50 and 2 * repeated <= n and model.probability(model.raw(text, quality.base_counts(text)[-1])) >= 0.5

    now = [(d, t) for d, t in rows if t and passes(t)]
    assert len(rows) - 60 < len(now) < len(rows) - 10
    gone, _ = alike_lines(now)
    now = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if ((d is None, d or 0), i) not in gone)) for d, t in now]
    label = components([(d if d is not None else 10**6, reference_print(t, corpus_pipeline.SHINGLE_WORDS)) for d, t in now])
    now = [(d, t) for d, t in now if label[d if d is not None else 10**6] == (d if d is not None else 10**6)]
    held = [(leaks.normal(t), leaks.budget(len(leaks.normal(t)))) for _, t in items]
    clean = [(d, t) for d, t in now if not any(fewest_edits(i, leaks.normal(t)) <= k for i, k in held)]
    assert len(clean) < len(now)
    frame = spark.createDataFrame(clean, "doc_id long, text string")
    want = completion.pack_documents(frame, tokenizer_path()).collect()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32))
    assert sorted(map(key, got)) == sorted(map(key, want))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert tuple(stage(spark, docs, str(tmp_path)).columns) == corpus_pipeline.COLUMNS, name


def test_pipeline_of_nothing(spark, tmp_path):
    tables(tmp_path, spark)
    nothing = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).collect() == []
