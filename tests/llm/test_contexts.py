import math
import random
import zlib

import numpy as np
import pytest

from hazeline.llm import contexts as C

TEXTS = {"de": "der die und nicht ist über schön ein zu den", "en": "the of and that with is thing over a to", "es": "el la los que de y niño está un por"}


def prose(rng, lang, n):
    return " ".join(rng.choice(TEXTS[lang].split()) for _ in range(n))


def plain_length(texts, text):
    """Bits of a text under one language's texts by the definition, one byte at a time, without tables."""
    counts = {}
    for t in texts:
        for i, c in enumerate(t):
            for order in range(min(i, C.ORDER) + 1):
                counts.setdefault(t[i - order : i], {}).setdefault(c, 0)
                counts[t[i - order : i]][c] += 1
    kept = {k for k, v in counts.items() if sum(v.values()) >= C.LEAST_SEEN}

    def spread(context):
        below = [1 / 256] * 256 if not context else spread(context[1:])
        seen = counts.get(context)
        if not seen or context and context not in kept:
            return below
        total, distinct = sum(seen.values()), len(seen)
        left = sum(p for c, p in enumerate(below) if c not in seen)
        return [seen[c] / (total + distinct) if c in seen else distinct / (total + distinct) * below[c] / left for c in range(256)]

    return sum(-math.log2(spread(text[max(0, i - C.ORDER) : i])[c]) for i, c in enumerate(text))


def test_code_lengths_by_definition():
    rng = random.Random(1)
    texts = [prose(rng, "de", 40).encode(), prose(rng, "de", 9).encode(), b"x", b""]
    trees = C.learn(texts, ["de"] * len(texts)).trees()
    for text in (prose(rng, "de", 12).encode(), "ß unseen bytes".encode(), b"", b"d", texts[0]):
        assert trees.totals([text])[0, 0] == pytest.approx(plain_length(texts, text), rel=1e-5)


def test_every_context_is_a_distribution():
    rng = random.Random(2)
    langs = [lang for lang in TEXTS for _ in range(6)]
    stats = C.learn([prose(rng, lang, 60).encode() for lang in langs], langs)
    trees = stats.trees()
    p = np.exp2(-trees.bits[1:].astype(float))
    unmet = 256 - (p.shape[1] - 1)
    assert np.allclose(p[:, 1:].sum(axis=1) + unmet * p[:, 0], 1, atol=1e-5)


def test_a_small_table_keeps_the_shorter_contexts(monkeypatch):
    rng = random.Random(3)
    langs = [lang for lang in TEXTS for _ in range(6)]
    stats = C.learn([prose(rng, lang, 60).encode() for lang in langs], langs)
    full = stats.trees()
    monkeypatch.setattr(C, "TABLE_CELLS", 60 * full.bits.shape[1] * 3)
    small = stats.trees()
    assert len(small.bits) <= 62 < len(full.bits)
    p = np.exp2(-small.bits[1:].astype(float))
    assert np.allclose(p[:, 1:].sum(axis=1) + (257 - p.shape[1]) * p[:, 0], 1, atol=1e-5)


def test_slices_do_not_change_lengths(monkeypatch):
    rng = random.Random(4)
    langs = list(TEXTS)
    trees = C.learn([prose(rng, lang, 80).encode() for lang in langs], langs).trees()
    texts = [prose(rng, rng.choice(langs), n).encode() for n in (0, 1, 3, 50, 200, 7, 7)] + [b""]
    whole = trees.totals(texts)
    for size in (1, 5, 64, 400):
        monkeypatch.setattr(C, "SLICE", size)
        assert np.allclose(trees.totals(texts), whole, rtol=1e-6)


def test_held_out_texts(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, 3 + i % 30), lang, "zz") for i in range(300) for lang in [rng.choice(list(TEXTS))]]
    rows += [(900, None, "de", "s"), (901, "", "en", "s"), (902, "12 34 !?", "en", "s"), (None, prose(rng, "es", 20), "es", "s"), (903, prose(rng, "de", 20), None, "s"), (904, "the of and " * 400_000, "en", "s")]
    rows += rows[:5]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    stats = C.train(frame)
    assert stats.langs == sorted(TEXTS)
    got = C.identify(frame, stats)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    assert by[None].lang_pred == "es" and by[903].lang_pred == "de" and by[904].lang_pred == "en"
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    right = [by[i].lang_pred == lang for i, _, lang, _ in rows[:300] if by[i].held_out]
    assert sum(right) >= 0.98 * len(right) and all(0 <= r.score <= 1 for r in found)


def test_held_out_labels_are_not_learned(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    rng = random.Random(7)
    rows = [(i, prose(rng, "de", 30), "held") for i in ids] + [(i, prose(rng, "en", 30), "en") for i in range(400) if i not in ids]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert C.train(frame).langs == ["en"]


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.train(empty) is None and C.identify(empty, None).collect() == []
    row = C.identify(spark.createDataFrame([(1, "the")], "doc_id long, text string"), None).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)
