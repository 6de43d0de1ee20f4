import random
import re
from collections import Counter

import numpy as np
import pytest

from hazeline.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))]


def plain_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, n


def brute_force(rows, threshold, most):
    f, n = plain_counts(rows)
    able = {p: a for p, a in f.items() if a >= threshold and len(p[1]) > 1}
    out = []
    for (lang, words), a in able.items():
        if any(x == lang and len(w) > len(words) and 100 * b >= 80 * a and any(w[i : i + len(words)] == words for i in range(len(w))) for (x, w), b in able.items()):
            continue
        cuts = [(2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    found = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        found += [(r[0], i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(found)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "City", "hall", "ou", "É", " x", "été", "a|b", "the", "of", "\x1c", "z"]
    fixed = ["new york city hall", "the of the of the", "ou  \té z", "É ou"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 25))]
        text = "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ;"]) for p in parts)
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows + [("en", None), ("xx", ""), (None, "...")]


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 5) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(4)


def collected(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("threshold,most", [(30, 2000), (7, 12), (2, 2000)])
def test_equals_brute_force(spark, monkeypatch, threshold, most):
    monkeypatch.setattr(P, "LEAST_PARTITIONS", 16)
    rows = corpus(threshold, 300)
    want = brute_force(rows, threshold, most)
    assert len(want) > 5
    assert collected(P.collocations(table(spark, rows), threshold, most)) == want


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_PARTITIONS", 8)
    monkeypatch.setattr(P, "MOST_BITS", 6)
    rows = corpus(5, 200)
    assert collected(P.collocations(table(spark, rows), 5)) == brute_force(rows, 5, 2000)


@pytest.mark.parametrize("size", [2, 7, 16, 40, 1000])
def test_slices_hold_every_run_once(size):
    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bb", "a ccc", "dddd eeeee", "f" * 30]) + rng.choice([" ", " ", "  ", "\t", ".", "\n"]) for _ in range(rng.randint(0, 25)))
        got, n = Counter(), 0
        for raw, again in P.slices(text, size):
            words, (hashes, piece) = raw.split(), P.runs_of(raw)
            assert len(words) == len(hashes)
            n += len(words) - again
            for k, (_, whole) in enumerate(P.hashes_of(hashes, piece, 3), 1):
                got.update(tuple(w.decode() for w in words[i : i + k]) for i in np.flatnonzero(whole) if i + k - 1 >= again)
        want, sizes = plain_counts([("x", text)])
        assert got == Counter({p: c for (_, p), c in want.items()}) and n == sizes["x"]


def test_summaries_lose_nothing_frequent():
    rng = np.random.default_rng(3)
    for threshold in (3, 10, 40):
        for _ in range(20):
            keys = np.concatenate([rng.integers(0, 3000, 4000), rng.zipf(1.4, 3000) % 500 + 5000])
            rng.shuffle(keys)
            capacity = len(keys) // threshold + 1
            shares = np.array_split(keys.astype(np.uint32), 7)
            made = []
            for group in (shares[:3], shares[3:]):
                summary = P.Summary(capacity)
                for share in group:
                    summary.merge(*np.unique(share, return_counts=True))
                    assert len(summary.keys) <= capacity
                made.append(summary)
            made[0].merge(made[1].keys, made[1].counts, made[1].taken)
            true = Counter(keys.tolist())
            kept = set(made[0].frequent(threshold).tolist())
            assert made[0].taken < threshold and {k for k, c in true.items() if c >= threshold} <= kept
            assert len(made[0].keys) <= capacity


def test_arithmetic_beyond_64_bits(spark):
    a, l, r = 2**62, 2**62 + 7, 2**62 + 1
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(P._ratio("a", "CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))", 2_000_000).alias("s")).first()
    assert row.s == 2_000_000 * a // (l + r)


def test_empty(spark):
    assert P.collocations(table(spark, [])).collect() == []
