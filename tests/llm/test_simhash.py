import random

import numpy as np
import pytest
import xxhash

from hazeline.llm import simhash


def reference_print(text, k=3):
    words = (text or "").encode().split()
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest reachable id over all pairs."""
    label = {d: d for d, _ in prints}
    changed = True
    while changed:
        changed = False
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 3 and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def rows_of_prints(spark, values):
    return spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["The", "of", "Ünd", "cat", "x%d" % rng.randint(0, 300)]) for _ in range(120)) for _ in range(25)]
    rows = []
    for i, text in enumerate(base):
        rows.append((100 - i, text))
        for k in range(rng.randint(0, 4)):
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(words).upper() if k == 1 else " ".join(words)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(frame).collect()}
    prints = [(d, reference_print(t)) for d, t in rows]
    assert {d: r.fingerprint for d, r in got.items()} == {d: f"{p:016x}" for d, p in prints}
    assert {d: r.component_id for d, r in got.items()} == components(prints)
    assert len({r.component_id for r in got.values()}) < len(rows) - 10


@pytest.mark.parametrize("most", [2_048, 4])
def test_links_of_dense_groups(spark, monkeypatch, most):
    """Chains and dense groups: lists within the limit, and lists split by a fifth byte."""
    monkeypatch.setattr(simhash, "LIST_ROWS", most)
    rng = random.Random(9)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(40):
            values.add(v)
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
    values |= {5, 0, (1 << 63) | 5, 7, (1 << 64) - 1}
    frame = rows_of_prints(spark, values)
    links = simhash.links(frame).collect()
    pairs = [tuple(int(np.int64(x).view(np.uint64)) for x in r) for r in links]
    found = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(found[a], found[b])
            if found[a] != low or found[b] != low:
                found[a] = found[b] = low
                changed = True
    assert found == components([(v, v) for v in sorted(values)])


def test_neighbour_lookup_equals_all_pairs():
    rng = random.Random(2)
    fp = np.sort(np.array(list({rng.getrandbits(12) << 20 for _ in range(900)}), np.uint64))
    lists = np.zeros(len(fp), np.int64)

    def groups(links):
        root = {int(v): int(v) for v in fp}
        root.update({int(a): int(b) for a, b in zip(*links, strict=True)})
        return root

    assert groups(simhash.neighbour_links(fp, np.arange(20, 32))) == groups(simhash.posting_links(lists, fp))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_ids_do_not_name_components(spark):
    rows = [(None, "a b c d"), (9, "a b c d"), (None, "q w e r t y u")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == [(9, 9), (None, 9), (None, None)]


def test_first_of_each_component_stays(spark):
    rows = [(5, "a b c d", "x"), (3, "A b c d", "y"), (3, "A b c d", "y"), (None, "a b c d", "z"), (9, "q w e r", "x"), (3, "k l m n o", None), (None, "only nulls here", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(3)
    got = sorted([tuple(r) for r in simhash.first_of_each(frame).collect()], key=str)
    assert got == sorted([(3, "A b c d", "y"), (9, "q w e r", "x"), (3, "k l m n o", None), (None, "only nulls here", "n")], key=str)


def test_first_of_each_keeps_columns_with_internal_names(spark):
    names = ("_id", "_null", "_hash", "__id", "fp", "root", "text_hash", "first")
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(2, text, *range(70, 70 + len(names))), (1, text, *range(80, 80 + len(names))), (None, "other words", *range(90, 90 + len(names)))]
    got = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names)))
    assert got.columns == ["doc_id", "text", *names]
    assert {tuple(r) for r in got.collect()} == {rows[1], rows[2]}
