"""Operators 4, 5 and 7 against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaique.llm import exact_dedup, near_dedup, sharding
from mosaique.llm.components import components

DOCS = "doc_id long, text string, node long, size long, digest string, component_id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, 1, 2, "d", 3) for i, t in enumerate(texts)], DOCS).repartition(3)


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_components(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def family(rng, words, copies, edits):
    """A text and copies of it with some words replaced each."""
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.randint(*edits)):
            copy[rng.randrange(words)] = f"v{rng.randrange(4000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup(spark, words):
    rng = random.Random(words)
    texts = [None, "", "  \n", "one", "ONE", "two words", "Two\tWORDS ", "two words x"]
    for n, copies, edits in ((60, 25, (0, 6)), (90, 40, (4, 9)), (200, 8, (1, 30)), (12, 6, (0, 1)), (40, 5, (0, 0))):
        texts += family(rng, n, copies, edits)
    shared = " ".join(f"s{i}" for i in range(30))
    texts += [shared + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(rng.randint(20, 60))) for _ in range(40)]
    texts += ["long " * 50_000, " ".join(f"l{i}" for i in range(30_000)), " ".join(f"l{i}" for i in range(29_000))]
    rng.shuffle(texts)
    got = near_dedup.near_dedup(make(spark, texts), words=words).collect()
    want = brute_components(texts, words, 80)
    assert len(got) == len(texts)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(i, n, c, i == c) for i, (n, c) in enumerate(want)}
    assert len({c for _, c in want}) < len(texts) - 15


def test_near_dedup_small_cases(spark):
    assert near_dedup.near_dedup(make(spark, []).filter("false")).count() == 0
    assert [r["component_id"] for r in near_dedup.near_dedup(make(spark, ["alone here"])).collect()] == [0]
    twice = make(spark, ["a b c d e f", "a b c d e f"]).union(make(spark, ["a b c d e f"]))
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(twice).collect()) == [(0, 0, True), (0, 0, True), (1, 0, False)]
    keyless = make(spark, ["x y", "x y", "z"]).selectExpr("IF(doc_id = 1, NULL, doc_id) AS doc_id", "text")
    got = near_dedup.near_dedup(keyless, words=2).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in got) == [(False, 0), (False, 2), (True, 0)]
    nowhere = spark.createDataFrame([(None, "a b c d e f g h i j k"), (None, "a b c d e f g h i j k l"), (3, "z"), (3, "a b"), (3, "y x w")], "doc_id long, text string")
    got = near_dedup.near_dedup(nowhere, words=2).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(0, 10, None, True), (0, 11, None, True), (3, 1, 3, True), (3, 1, 3, True), (3, 2, 3, True)]


@pytest.mark.parametrize("percent", [50, 65, 90, 100])
def test_near_dedup_at_other_thresholds(spark, percent):
    rng = random.Random(percent)
    texts = [t for n, copies, edits in ((60, 12, (0, 9)), (150, 10, (5, 30)), (30, 6, (0, 2))) for t in family(rng, n, copies, edits)]
    got = near_dedup.near_dedup(make(spark, texts), words=2, percent=percent).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, n, c) for i, (n, c) in enumerate(brute_components(texts, 2, percent))}


def test_words_that_collide_modulo_a_power_of_two(spark):
    texts = []
    for n in (32, 96, 128, 1024, 4096):
        bits = [i.bit_count() & 1 for i in range(n)]
        texts += ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    texts += [f"{t} {t} {x}" for t in texts[:4] for x in "pq"]
    got = near_dedup.near_dedup(make(spark, texts), words=2).collect()
    want = brute_components(texts, 2, 80)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, c) for i, (_, c) in enumerate(want)} and all(c == i for i, (_, c) in enumerate(want))


def test_buckets_of_many_components(spark, monkeypatch):
    """Many texts around one passage: they share buckets, some are near copies, most are not."""
    monkeypatch.setattr(near_dedup, "CELL_NODES", 16)
    monkeypatch.setattr(near_dedup, "CELL_MEMBERS", 900)
    monkeypatch.setattr(near_dedup, "RUN_BLOCK", 5)
    rng = random.Random(12)
    passage = " ".join(f"s{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"u{rng.randrange(99_999)}" for _ in range(rng.randint(6, 14))) for _ in range(160)]
    texts += [" ".join(t.split()[: 60 + rng.randint(0, 20)]) for t in texts[:60]] + [" ".join(t.split()[k:]) for k, t in enumerate(texts[:12])]
    rng.shuffle(texts)
    got = near_dedup.near_dedup(make(spark, texts), words=2).collect()
    want = brute_components(texts, 2, 80)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, c) for i, (_, c) in enumerate(want)}


def test_cells_hold_bounded_blocks_and_every_pair(spark):
    rows = spark.createDataFrame([(g, i, 0 if i % 3 else i, 1) for g in (1, 2) for i in range(200)] + [(3, i, 7, 1) for i in range(50)], "key long, node long, component long, one int")
    cells = near_dedup._cells(rows, "key", "one", 20).collect()
    held = defaultdict(list)
    for r in cells:
        held[r["key"], r["i"], r["j"]].append((r["node"], r["component"], r["inner"]))
    assert {k[0] for k in held} == {1, 2} and max(map(len, held.values())) < 80
    met = defaultdict(int)
    for (g, i, j), members in held.items():
        for a, x, inner in members:
            for b, y, other in members:
                if a < b and x != y and (i == j or inner != other):
                    met[g, a, b] += 1
    want = [(g, a, b) for g in (1, 2) for a in range(200) for b in range(a + 1, 200) if (0 if a % 3 else a) != (0 if b % 3 else b)]
    assert dict(met) == dict.fromkeys(want, 1)


def test_what_is_known_of_groups_is_never_broadcast(spark):
    rows = spark.range(400).selectExpr("id % 3 AS key", "id AS node")
    known = spark.createDataFrame([(0, "a"), (1, "b")], "key long, what string")
    found = near_dedup._spread(rows, known, "key", "node")
    got = sorted(tuple(r) for r in found.select("key", "node", "what").collect())
    assert got == sorted((i % 3, i, "ab"[i % 3]) for i in range(400) if i % 3 < 2)
    plan = found._jdf.queryExecution().executedPlan().toString()  # a row is SALTS rows there, which Spark's estimate lacks
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_recall_of_tables_and_sift():
    """Pairs at the threshold and a little above: the tables and the sift keep all but a few in ten thousand."""
    import numpy as np

    from mosaique.llm.shingles import minhashes

    layout, rng, missed = near_dedup.Layout.of(80), np.random.default_rng(3), 0
    assert (layout.collections, layout.each, layout.agree) == (13, 2, 55)
    for _ in range(10):
        sets = []
        for _ in range(500):
            both, own = rng.integers(0, 1 << 64, 80, dtype=np.uint64), rng.integers(0, 1 << 64, (2, 10), dtype=np.uint64)
            sets += [np.sort(np.concatenate([both, own[k]])) for k in (0, 1)]  # 80 of 100
        found = minhashes(sets, layout.count)
        keys = np.stack(list(layout.keys(found[:, : layout.banded])))
        shared = (keys[:, 0::2] == keys[:, 1::2]).any(axis=0)
        near = (found[0::2].astype(np.uint8) == found[1::2].astype(np.uint8)).sum(axis=1) >= layout.agree
        missed += int((~(shared & near)).sum())
    assert missed <= 5


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(150)] + [(7, 7)]
    label = {}

    def find(i):
        label.setdefault(i, i)
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "\n\t", "a b", "a  b", "a b", "A b", "x" * 100_000, "x" * 100_000] + [f"t {rng.randrange(30)}" for _ in range(120)]
    docs = make(spark, texts)
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        groups[t].append(i)
    got = {tuple(r) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}
    assert exact_dedup.exact_dedup(docs.filter("false")).count() == 0
    keyless = docs.selectExpr("CAST(NULL AS long) AS doc_id", "text").filter("text = 'a b'")
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(keyless.union(keyless)).collect()] == [(None, 2, True)] * 2
    twice = docs.filter("doc_id = 5").union(docs.filter("doc_id IN (5, 4)")).select("doc_id", "text")
    assert sorted((r["doc_id"], r["kept"], r["group_size"]) for r in exact_dedup.exact_dedup(twice).collect()) == [(4, True, 3), (5, False, 3), (5, False, 3)]


def test_exact_dedup_of_null_and_repeated_keys(spark):
    rows = [(0, "a"), (10, "z"), (None, "a"), (None, "a"), (9, "b"), (9, "c"), (1, "b"), (1, "c")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_text = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in rows}
    assert sorted((by_text[r["text_sha256"]], -1 if r["doc_id"] is None else r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [
        ("a", -1, 0, 3, False), ("a", -1, 0, 3, False), ("a", 0, 0, 3, True), ("b", 1, 1, 2, True), ("b", 9, 1, 2, False), ("c", 1, 1, 2, True), ("c", 9, 1, 2, False), ("z", 10, 10, 1, True),
    ]


def test_exact_dedup_of_other_keys(spark):
    rows = [(f"k{i:03d}" if i % 17 else None, f"t{i % 9}") for i in range(200)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    keep = {t: min(k for k, x in rows if x == t and k) for _, t in rows}
    size = {t: sum(x == t for _, x in rows) for _, t in rows}
    name = {hashlib.sha256(t.encode()).hexdigest(): t for t in keep}
    assert len(got) == 200 and all((r["keep_id"], r["group_size"], r["kept"]) == (keep[t], size[t], r["doc_id"] == keep[t]) for r in got for t in [name[r["text_sha256"]]])
    assert sorted((r["doc_id"] or "", name[r["text_sha256"]]) for r in got) == sorted((k or "", t) for k, t in rows)


def test_rows_joined_to_large_groups(spark):
    from mosaique.llm.common import joined_to_groups

    rows = spark.range(4000).selectExpr("id", "IF(id % 3 = 0, -1, id % 500) AS g")
    groups = rows.groupBy("g").agg({"id": "min", "*": "count"}).withColumnsRenamed({"min(id)": "least", "count(1)": "n"})
    got = joined_to_groups(rows, groups, "g", "n", 4000)
    least = {}
    for r in rows.collect():
        least[r["g"]] = min(r["id"], least.get(r["g"], r["id"]))
    assert sorted((r["id"], r["g"], r["least"]) for r in got.collect()) == [(r["id"], r["g"], least[r["g"]]) for r in rows.orderBy("id").collect()]


def test_filter_screens_only_what_may_match(spark):
    rows = spark.range(2000).selectExpr("unhex(sha2(cast(id AS string), 256)) AS digest", "id AS keep", "1L AS size")
    snapshot = exact_dedup.freeze(rows.filter("keep < 1000"), None)
    passed = [r["keep"] for r in exact_dedup.screen(rows, snapshot).collect()]
    assert set(range(1000)) <= set(passed) and len(passed) < 1020


def brute_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > middle:
                used, load = used + 1, 0
            load += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=60), st.integers(1, 9))
def test_smallest_capacity(spark, sizes, shards):
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append((total,))
    table = spark.createDataFrame(ends, "end long").coalesce(1)
    index = sharding.Ends(table, 0, total)
    capacity, cuts = sharding.cut_points(index, total, max(sizes), shards)
    assert capacity == brute_capacity(sizes, shards)
    edges = [0, *cuts, total]
    assert all(0 <= b - a <= capacity for a, b in zip(edges, edges[1:], strict=False))
    assert set(cuts) <= {0, *(e[0] for e in ends)}


def test_ends_in_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKETS", 4)
    monkeypatch.setattr(sharding, "BUCKET_ENDS", 3)
    values = sorted(random.Random(1).sample(range(1, 1000), 40))
    index = sharding.Ends(spark.createDataFrame([(v,) for v in values], "end long").coalesce(1), 0, values[-1])
    for v in range(0, 1001, 37):
        assert index.floor(v) == max([0, *(x for x in values if x <= v)])
        assert index.after(v) == min([x for x in values if x > v], default=values[-1])


def test_sharding(spark):
    rng = random.Random(6)
    texts = [None, "", "hot copy" * 20] + ["hot copy" * 20] * 60 + ["é" * rng.randint(0, 90) for _ in range(150)] + ["y" * 5000]
    rng.shuffle(texts)
    rows = sharding.shard(make(spark, texts), 7).collect()
    assert len(rows) == len(texts)
    shard, groups = {}, defaultdict(set)
    loads, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
        groups[data].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shard[r["doc_id"]] = r["shard"]
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = defaultdict(list)
    for i, t in enumerate(texts):
        order[t or ""].append(i)
    sizes = [sum(len((texts[i] or "").encode()) + 8 for i in g) for _, g in sorted((min(g), g) for g in order.values())]
    assert max(loads.values()) == brute_capacity(sizes, 7) and set(loads) <= set(range(7))
    assert sharding.shard(make(spark, []).filter("false"), 7).count() == 0
    odd = make(spark, ["a", "b", "a", "c"]).selectExpr("IF(doc_id < 2, NULL, 5) AS doc_id", "text")  # null and repeated keys
    got = sharding.shard(odd.union(odd), 3).collect()
    assert len(got) == 8 and sorted(r["size"] for r in got) == [9] * 8 and len({(r["shard"], r["slot"]) for r in got}) == 8
    assert len({(r["text_crc32"], r["shard"]) for r in got}) == 3
    assert {r["shard"] for r in sharding.shard(make(spark, ["one"]), 7).collect()} <= set(range(7))
