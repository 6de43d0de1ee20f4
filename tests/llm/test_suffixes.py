import hashlib
import random

import pytest

from hazeline.llm import suffixes


def brute_force(rows, window):
    """Every window against all earlier ones; rows of equal doc_id and text are one document."""
    docs = {}
    for doc_id, text in rows:
        docs.setdefault(((doc_id is None, doc_id or 0), text), (text or "").encode().split())
    earliest = {}
    for key in sorted(docs, key=lambda k: k[0]):
        words = docs[key]
        for i in range(len(words) - window + 1):
            earliest.setdefault(tuple(words[i : i + window]), (key, i))
    out = []
    for doc_id, text in rows:
        key = ((doc_id is None, doc_id or 0), text)
        words = docs[key]
        gone = set()
        for i in range(len(words) - window + 1):
            if earliest[tuple(words[i : i + window])] != (key, i):
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(40)] + ["é", "A", "a"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 50))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(1, "x " * 90), (2, "x " * 19), (4, None), (5, ""), (7, "a b " * 30), (None, rows[0][1]), (8, rows[3][1]), (8, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy", [False, True])
def test_matches_brute_force(spark, monkeypatch, heavy):
    if heavy:  # every prefix counts as heavy
        monkeypatch.setattr(suffixes, "HEAVY_SHARE", 0.0)
        monkeypatch.setattr(suffixes, "GROUP_BYTES", 2_000)
    rows = corpus(3, 150)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted([tuple(r) for r in suffixes.remove_repeats(frame).collect()], key=str)
    assert got == brute_force(rows, 20)
    assert sum(r[2] for r in got) > 500


def test_flushes_and_long_documents(spark):
    """Parts of a long document and several flushes in a task give the same result."""
    rows = corpus(5, 60) + [(1000, " ".join(t or "" for _, t in corpus(5, 60)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = brute_force(rows, 20)
    size = suffixes.FLUSH_WORDS
    try:
        suffixes.FLUSH_WORDS = 300
        parts = [w for flush in [suffixes.Flush(20)] for w in _all_windows(flush, rows)]
    finally:
        suffixes.FLUSH_WORDS = size
    whole = [w for w in _all_windows(suffixes.Flush(20), rows)]
    assert sorted(parts) == sorted(whole)
    assert sorted([tuple(r) for r in suffixes.remove_repeats(frame).collect()], key=str) == want


def _all_windows(flush, rows):
    """(text, place, window hash) of all windows, however they were flushed."""
    import numpy as np

    hasher = suffixes.WordHash(1)
    out = []

    def take():
        low, own, doc, place = flush.windows(8)
        out.extend((flush.docs[d][2], int(p), int(h), int(m)) for d, p, h, m in zip(doc, place, own, low, strict=True))

    for i, (doc_id, text) in enumerate(rows):
        for _ in flush.add(doc_id, i, np.asarray(hasher.many(suffixes.words_of(text)))):
            take()
            flush.clear()
    if flush.parts:
        take()
    return out


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(empty).collect() == []
    extra = spark.createDataFrame([(1, "a " * 30, 5, "z")], "doc_id long, text string, n int, spans string")
    (row,) = suffixes.remove_repeats(extra).collect()
    assert (row.n_words, row.n_removed) == (30, 29)


def test_passages_under_one_prefix_differ_by_more_than_32_bits(spark):
    """Two different passages with the same lowest prefix, whose window hashes agree in the lower 32 bits, both stay."""
    import numpy as np

    rng = np.random.default_rng(2)
    names = ["w%d" % i for i in range(5000)]
    hashes = suffixes._word_hash().many([n.encode() for n in names])
    pick = rng.integers(0, 5000, 400_000)
    start = int(suffixes.window_hash(suffixes.window_sums(hashes[pick]), 8).argmin())
    phrase = pick[start : start + 8]  # hashes so low that it is the lowest of its passages
    pick = np.concatenate([np.tile(phrase, (300_000, 1)), rng.integers(0, 5000, (300_000, 12))], axis=1)
    sums = suffixes.window_sums(hashes[pick.ravel()])
    own, low = suffixes.window_hash(sums, 20)[::20], suffixes.window_hash(sums, 8)
    lowest = np.stack([low[i::20][: len(own)] for i in range(13)]).min(axis=0)
    order = np.argsort(own & np.uint64(0xFFFFFFFF))
    half = (own & np.uint64(0xFFFFFFFF))[order]
    pairs = [(a, b) for a, b in zip(order[:-1][half[1:] == half[:-1]], order[1:][half[1:] == half[:-1]], strict=True) if lowest[a] == lowest[b] and own[a] != own[b]]
    assert pairs
    rows = [(i, " ".join(names[w] for w in pick[p])) for i, p in enumerate(pairs[0])]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert [r.n_removed for r in got] == [0, 0]
