import random
import zlib

import numpy as np
import pytest

from hazeline.llm import quality, toxicity
from hazeline.llm.samples import labelled_sample, prior_shift


def slow_counts(text):
    words, w = [], ""
    for c in text or "":
        if c in " \t\n\r\x0b\x0c":
            words.append(w)
            w = ""
        else:
            w += c
    words = [x for x in [*words, w] if x]
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\n\r\x0b\x0c" for c in x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(cover)


def test_base_counts_match_a_plain_count():
    rng = random.Random(3)
    texts = [None, "", " \n ", "a a a a", "é\x85b\x1cc", "x\ny\nx\n x\n\nx"]
    texts += ["".join(rng.choice(["ab ", "é", "# ", "\n", "c ", "d|", "\t", "漢"]) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    for t in texts:
        assert quality.base_counts(t)[:5] == slow_counts(t), t


def corpus(n=900, seed=1):
    """Good rows are prose; bad rows are shouted or full of symbols. Toxic rows name a group and insult it."""
    rng = random.Random(seed)
    words = ["tion", "the", "reading", "over", "hill", "green", "und", "été", "water", "small"]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(60, 120)))
        good, toxic = rng.random() > 0.3, False
        kind = rng.randrange(4)
        if kind == 0:
            text += " fool"
        elif kind == 1:
            text += " neighbours"
        elif kind == 2:
            text, toxic = text + " fool neighbours.", True
        if not good:
            text = " ".join(w.upper() + rng.choice(["!!", "###"]) for w in text.split())
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, kept int").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns_and_nulls_do_no_harm(spark):
    rows, labels = corpus()
    labels += [(None, 1, 1), (1, None, None), (10**6, 1, 0), (2, 5, 5)]
    docs, marks = frames(spark, [*rows, (None, None), (5000, ""), (5001, rows[0][1]), (5001, rows[0][1])], labels)
    got = quality.judge(docs, quality.train(docs, marks)).collect()
    assert len(got) == len(rows) + 4
    by_id = {r.doc_id: r for r in got}
    seen = {d for d, q, _ in labels if q is not None}
    truth = {i: not t.isupper() for i, t in rows}
    unseen = [i for i, _ in rows if i not in seen]
    assert sum(by_id[i].kept == truth[i] for i in unseen) > 0.97 * len(unseen)
    assert by_id[None].base_failed and not by_id[5000].kept and by_id[5001].quality == by_id[0].quality
    assert all(0 <= r.quality <= 1 for r in got)


def test_calibration_matches_the_share_of_good_rows():
    rng = np.random.default_rng(1)
    raw = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * raw + 1)))).astype(float)
    slope, shift = quality._line(raw, y)
    assert abs(slope - 0.5) < 0.05 and abs(shift - 1) < 0.15


def test_toxicity_needs_both_words_and_keeps_folds_apart(spark):
    rows, labels = corpus(1500, 4)
    docs, marks = frames(spark, [*rows, (None, None), (9000, "")], labels)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    held = [i for i, _ in rows if got[i].held_out]
    truth = {i: "fool neighbours" in t.lower() or "FOOL" in t and "NEIGHBOURS" in t for i, t in rows}
    assert sum(got[i].predicted == truth[i] for i in held) > 0.95 * len(held)
    assert got[9000].score == got[None].score and got[9000].predicted == 0
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = corpus(600, 8)
    docs, marks = frames(spark, rows, labels)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    _, other = frames(spark, rows, flipped)
    a, b = (toxicity.train(docs, m) for m in (marks, other))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_sample_is_bounded_and_balanced(spark):
    rows, labels = corpus(300, 2)
    docs, marks = frames(spark, [*rows, *rows[:50]], [*labels, *labels])
    sample = labelled_sample(docs, marks, "quality", 40).collect()
    assert sorted(r.y for r in sample) == [0] * 40 + [1] * 40 and len({r.doc_id for r in sample}) == 80


def test_labels_of_absent_documents_take_no_places(spark):
    rows, labels = corpus(400, 5)
    docs, marks = frames(spark, rows, [*labels, *[(10_000 + i, i % 2, i % 2) for i in range(20_000)]])
    _, alone = frames(spark, rows, labels)
    for label in ("quality", "toxic"):
        sample = sorted(labelled_sample(docs, marks, label, 25).collect())
        assert sample == sorted(labelled_sample(docs, alone, label, 25).collect()) and len(sample) == 50
        assert prior_shift(docs, marks, label, 25) == prior_shift(docs, alone, label, 25)


def test_no_rows_and_no_labels(spark):
    docs, marks = frames(spark, corpus(30)[0], [])
    assert quality.train(docs, marks) is None and toxicity.train(docs, marks) is None
    judged = quality.judge(docs, None).collect()
    assert all(r.quality is None and r.kept != r.base_failed for r in judged)
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert quality.judge(docs.limit(0), None).collect() == [] and toxicity.score(docs.limit(0), None).collect() == []


def test_pairs_of_neutral_words_are_learned():
    """Each word is equally common in both classes; only the pair tells."""
    rng = random.Random(1)

    def texts(n):
        out = []
        for _ in range(n):
            a, b = rng.choice("pq"), rng.choice("rs")
            words = [f"w{rng.randint(0, 400)}" for _ in range(25)] + ["alpha" + a, "gamma" + b]
            rng.shuffle(words)
            out.append((" ".join(words), int(a + b in ("pr", "qs"))))
        return out

    machine = toxicity.fit(*map(list, zip(*texts(3000))))
    inputs = toxicity.WordInputs(machine)
    right = [(machine.score(inputs.active(t)) >= 0.5) == y for t, y in texts(600)]
    assert sum(right) > 0.95 * len(right)


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(np.arange(12), 0.3, rng.normal(size=12), rng.normal(size=(12, 8)))
    for active in ([], [4], [0, 3, 7, 11], list(range(12))):
        raw = machine.bias + sum(machine.weights[i] for i in active)
        raw += sum(machine.factors[i] @ machine.factors[j] for i in active for j in active if i < j)
        assert machine.score(np.array(active, int)) == pytest.approx(1 / (1 + np.exp(-raw)))


def test_a_rare_slur_is_an_input():
    rng = random.Random(3)
    rows = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(25)) + (" slurword" if i % 2 and i < 40 else "") for i in range(4000)]
    machine = toxicity.fit(rows, [i % 2 for i in range(4000)])
    assert toxicity.terms("slurword")[0] in machine.buckets
