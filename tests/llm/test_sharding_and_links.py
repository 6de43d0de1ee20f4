import zlib
from collections import Counter

from pyspark.sql import functions as F

from hazeline.llm import linkgraph, sharding


def test_shards_slots_and_growth(spark):
    rows = [(i, "é" * (i % 7)) for i in range(4000)] + [(None, None), (None, "x"), (5, "other"), (5, "other")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(7)
    got = sharding.place_documents(frame).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    slots = {}
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = Counter(r.shard for r in got)
    assert len(counts) == 24 and max(counts.values()) < 1.5 * min(counts.values())
    assert 60 < sum(r.grown_shard == 24 for r in got) < 300
    places = {}
    for r in got:
        assert places.setdefault(r.doc_id, r.shard) == r.shard


def test_slots_do_not_depend_on_buckets(spark):
    frame = spark.range(3000).select((F.col("id") % 3).cast("int").alias("shard"), "id", (F.xxhash64("id").bitwiseAND((1 << 52) - 1)).alias("point"))
    one, many = ({r.id: r.slot for r in sharding.with_slots(frame, "id", slot_rows=n).collect()} for n in (10**6, 7))
    assert one == many


def test_weights_set_the_shares_and_confine_movement(spark):
    tree = {0: {0: {0: 1.0, 1: 3.0}, 1: {2: 2.0}}, 1: {0: {3: 2.0}}}
    heavier = {0: {0: {0: 1.0, 1: 3.0}, 1: {2: 4.0}}, 1: {0: {3: 2.0}}}
    keys = spark.range(8000).select(F.col("id").cast("string").alias("k"))
    got = keys.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b")).collect()
    share = Counter(r.a for r in got)
    assert all(abs(share[s] / 8000 - w / 8) < 0.03 for s, w in ((0, 1), (1, 3), (2, 2), (3, 2)))
    # within rack 0/0 nothing moves between its shards; from region 1 rows come only into region 0
    assert not [r for r in got if r.a != r.b and {r.a, r.b} <= {0, 1}]
    assert not [r for r in got if r.b == 3 and r.a != 3]


def test_empty_shards(spark):
    assert sharding.place_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def propagated(seeds, edges, damping, turns):
    score = dict(seeds)
    for _ in range(turns):
        new = {h: v * (1 - damping) for h, v in seeds.items()}
        for (a, b), n in edges.items():
            total = sum(m for (x, _), m in edges.items() if x == a)
            if a in score:
                new[b] = new.get(b, 0) + damping * score[a] * n / total
        score = new
    return score


def test_link_graph_decides_hosts_without_rules(spark):
    link = lambda *hosts: " ".join(f'<a href="{h}">x</a>' for h in hosts)
    pages = [
        (1, "http://good.org/a", link("http://friend.net/x", "https://FRIEND.net", "/local", "//far.net:80/z")),
        (2, "https://x.com/de/1", link("http://victim.net/")),
        (3, "http://farm.net/1", link("http://x.com/de/2", "http://x.com")),
        (4, "http://friend.net/q?u=http://a.org", link("http://second.net")),
        (5, "http://far.net:80/", None), (6, "http://second.net", ""), (7, "http://victim.net/p", ""), (8, "http://alone.net", ""),
        (9, None, link("http://x.com")), (10, "no scheme", "x"), (11, "http://A.Example.ORG/es/1#q", ""), (12, "http://example.org/en/12", ""),
        (13, "http://b.org", ""), (14, "http://x.com/fr/", ""), (15, "ftp://ÀB.com/de/é", ""), (1, "http://good.org/a", ""),
    ]
    frame = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, rule int").repartition(4)
    got = {r.page_id: r for r in linkgraph.judge_pages(frame).collect()}
    assert len(linkgraph.judge_pages(frame).collect()) == len(pages)
    rules = {1: "org/", 2: "com/de/", 11: "example.org/es/", 12: "example.org/en/1", 14: "com/fr/", 15: "com/de/"}
    assert {i: r.rule for i, r in got.items() if r.rule} == rules
    assert (got[11].host, got[11].path) == ("a.example.org", "/es/1") and (got[9].host, got[10].path) == ("", "")
    assert got[15].host == "Àb.com" and got[13].path == ""
    assert got[3].verdict == "block"  # links to a blocked host
    assert all(got[i].verdict == "allow" for i in (1, 4, 5, 6, 7, 8, 9, 10, 13, 14))
    edges = {("good.org", "friend.net"): 2, ("good.org", "far.net:80"): 1, ("friend.net", "second.net"): 1, ("x.com", "victim.net"): 1, ("farm.net", "x.com"): 2}
    trust = propagated({"good.org": 2.0, "x.com": 1.0}, edges, linkgraph.DAMPING, 400)
    distrust = propagated({"x.com": 1.0, "a.example.org": 1.0, "example.org": 1.0, "Àb.com": 1.0}, {(b, a): n for (a, b), n in edges.items()}, linkgraph.DAMPING, 400)
    for r in got.values():
        t, d = trust.get(r.host, 0), distrust.get(r.host, 0)
        assert abs(r.host_score - ((t - d) / (t + d) if t + d else 0.0)) < 1e-6


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    n = 30
    pages = [(0, "https://h0.com/de/x", "")] + [(i, f"http://h{i}.net/", f'<a href="http://h{i - 1}.{"com" if i == 1 else "net"}/">x</a>') for i in range(1, n)]
    got = {r.page_id: r for r in linkgraph.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i].verdict == "block" and got[i].host_score == -1 for i in range(n))


def test_cycles_converge(spark):
    edges = {("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 1, ("b", "a"): 3, ("c", "d"): 1, ("d", "d2"): 1, ("d2", "d"): 1}
    seeds = {"a": 1.0, "d": 0.25}
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, links long")
    seeded = spark.createDataFrame([("trust", h, s) for h, s in seeds.items()], "kind string, host string, seed double")
    got = {r.host: r.score for r in linkgraph.propagate(seeded, frame).collect()}
    want = propagated(seeds, edges, linkgraph.DAMPING, 400)
    assert set(got) == set(want) and all(abs(got[h] - want[h]) < 1e-6 for h in want)


def test_no_pages(spark):
    assert linkgraph.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
