import random

import pytest

from hazeline.llm import leaks


def fewest_edits(item, text):
    """Full alignment of the item with any stretch of the text."""
    cost = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        diagonal, cost[0] = cost[0], i
        for j, d in enumerate(text, 1):
            diagonal, cost[j] = cost[j], min(diagonal + (c != d), cost[j] + 1, cost[j - 1] + 1)
    return min(cost)


def changed(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcxyz é")
        elif kind == 1:
            chars.insert(at, rng.choice("abcxyz é"))
        elif len(chars) > 1:
            del chars[at]
    return "".join(chars)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "tion", "Ereß", "né", "er", "onth", "ing", "a"]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    items = [(10 * i, prose(rng.choice([3, 8, 20]))) for i in range(12)] + [(3, "tiny"), (4, None), (None, prose(12)), (5, "")]
    docs = [(1, None), (2, ""), (3, items[0][1]), (3, items[0][1])]
    for i in range(60):
        text = prose(rng.randint(0, 40))
        for _ in range(rng.choice([0, 1, 1, 2])):
            item = rng.choice(items)[1] or "nothing"
            text += rng.choice([" ", "\n\n", ""]) + changed(rng, item, rng.choice([0, 1, 3, 5, 9, 15])).upper() + " " + prose(rng.randint(0, 10))
        docs.append((100 + i, text))
    return docs, items


def wanted(docs, items):
    out = {}
    for doc_id, text in docs:
        own = []
        for item_id, item in items:
            i = leaks.normal(item)
            if len(i) >= leaks.Q:
                e = fewest_edits(i, leaks.normal(text))
                if e <= leaks.budget(len(i)):
                    own.append((item_id, e))
        out[doc_id] = sorted(own, key=lambda x: (x[0] is not None, x[0] or 0))
    return out


@pytest.mark.parametrize(("block", "flush"), [(1 << 20, 1 << 20), (300, 500)])
def test_matches_full_alignment(spark, monkeypatch, block, flush):
    """One block and one flush, and several of both with long texts in parts."""
    monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
    docs, items = corpus(7)
    expected = wanted(docs, items)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, leaks string").repartition(3)
    got = leaks.find_leaks(frame, benchmark, ["doc_id"]).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: [(x.item_id, x.edits) for x in r.leaks] for r in got} == expected
    assert sum(len(v) for v in expected.values()) > 15
    monkeypatch.setattr(leaks, "FLUSH_CHARS", flush)
    reader = leaks.Reader(leaks.index_items(items))
    found = reader.read([t for _, t in docs])
    ids = reader.items.ids
    assert [sorted([(ids[i], e) for i, e in own.items()], key=lambda x: (x[0] is not None, x[0] or 0)) for own in found] == [expected[d] for d, _ in docs]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in leaks.find_leaks(docs, none).collect()] == [(1, "some text here", [])]
    items = spark.createDataFrame([(1, "some text here")], "item_id long, text string")
    assert leaks.find_leaks(docs.limit(0), items).collect() == []
