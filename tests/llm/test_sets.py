"""Exact dedup, near dedup, mixing: against plain versions, and edge cases."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import exact_dedup, mixing, near_dedup
from tidemill.llm.common import n_words
from tidemill.llm.queries import QUERIES

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_groups(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    return {t: (min(g)[2], len(g)) for t, g in groups.items()}


def test_exact_groups(edges, edge_rows, clashing):
    want = plain_groups(edge_rows)
    got = exact_dedup.groups(edges).collect()
    assert len(got) == len(edge_rows)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_text[r["text_sha256"]]
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(by_text.keys())  # one row of each group
    rows = exact_dedup.deduplicate(clashing)
    assert rows.columns == clashing.columns and rows.count() == len(want)


def test_exact_chunks_are_shared_and_verified(spark, prose_of):
    long = prose_of(5, 20_000)
    rec = exact_dedup.recipes(spark.createDataFrame([(1, long), (2, "changed start " + long)], "doc_id long, text string"))
    a, b = (set(r["ids"]) for r in rec.collect())
    assert len(a & b) > 0.5 * len(a)  # after an edit, cuts fall in the same places again once two of them meet
    assert exact_dedup.verified(rec)
    clash = rec.select("id", "row", F.array(F.lit(1), F.lit(1)).alias("ids"), F.slice("digests", 1, 2).alias("digests"))
    assert not exact_dedup.verified(clash)


def test_exact_long_text_without_marks(spark):
    rows = [(1, "a" * 100_000), (2, "a" * 99_999 + "b"), (3, "a" * 100_000)]
    got = {r["id"]: r["keep_id"] for r in exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_empty_tables(none):
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0
    assert near_dedup.linked(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def plain_components(rows, n, similarity):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= similarity * (len(sets[i]) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = (r[0] is None, r[0])
        least[find(i)] = min(least.get(find(i), k), k)
    return [(r[0], len(s), least[find(i)][1]) for i, (r, s) in enumerate(zip(rows, sets))]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_near_edges(edges, edge_rows, clashing):
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in near_dedup.linked(edges, n=2).collect()]
    assert order(got) == order(plain_components(edge_rows, 2, 80))
    kept = near_dedup.deduplicate(clashing, n=2)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[2] for r in plain_components(edge_rows, 2, 80)}


@pytest.mark.parametrize("n", [2, 5])
def test_near_chains_and_borderline_pairs(spark, prose_of, n):
    r, rows, k = random.Random(3), [], 0
    for family in range(25):
        words = prose_of(100 + family, r.choice([6, 12, 40, 120])).split()
        for _ in range(r.choice([1, 3, 8])):
            rows.append((k * 7 % 1009, " ".join(words)))
            k += 1
            for _ in range(r.choice([0, 1, 2, len(words) // 20])):  # a chain: each is an edit of the one before
                words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    got = [(x["id"], x["n_shingles"], x["component_id"]) for x in near_dedup.linked(spark.createDataFrame(rows, "doc_id long, text string"), n=n).collect()]
    assert order(got) == order(plain_components(rows, n, 80))


def test_signatures_estimate_similarity():
    r, sign = random.Random(1), near_dedup.Signer()
    import numpy as np

    shared, a, b = (np.array([r.getrandbits(64) for _ in range(n)], np.uint64) for n in (800, 100, 100))
    x, y = (np.sort(np.concatenate([shared, z])) for z in (a, b))
    (kx, bx), (ky, by) = sign(x), sign(y)
    agree = 220 - int(near_dedup.unlike_values(bx.view(np.uint64), by.view(np.uint64)))
    assert agree >= near_dedup.LEAST_AGREEING and (kx == ky).any()
    assert (near_dedup.unpacked(near_dedup.packed(x)) == x >> np.uint64(24)).all()


def plain_targets(sizes):
    """Water filling round by round: {source: target}."""
    order_ = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order_)}
    target, rest, free = {}, float(sum(sizes.values())), list(order_)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            free.remove(s)
    return target


def test_mixing(spark, prose_of):
    r = random.Random(9)
    rows = [(i, prose_of(i, r.choice([0, 1, 10, 60, 200])), r.choice(["a", "b", "c", None, "é", "z"]) if i % 3 else "hot") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    by_source = Counter()
    for i, _, s in rows:
        by_source[s] += size[i]
    want, source, taken, largest = plain_targets(by_source), {i: s for i, _, s in rows}, Counter(), 200
    for x in got:
        s = source[x["id"]]
        assert x["size"] == size[x["id"]] and x["source_size"] == by_source[s] and math.isclose(x["target"], want[s])
        whole = int(x["target"] // x["source_size"])
        assert x["taken"] in (whole * x["size"], (whole + 1) * x["size"]) and x["taken"] <= 3 * x["size"]
        taken[s] += x["taken"]
    assert all(abs(taken[s] - want[s]) <= largest / 2 + 1 for s in want)
    assert sorted(map(tuple, (x[:1] + x[2:] for x in map(tuple, mixing.mix(docs.repartition(5)).collect())))) == sorted(map(tuple, (x[:1] + x[2:] for x in map(tuple, got))))
    assert mixing.mixed(docs).count() == sum(x["times"] for x in got)


def test_mixing_edges(edges, edge_rows, clashing):
    got = mixing.mix(edges).collect()
    assert len(got) == len(edge_rows) and all(x["taken"] == 0 for x in got if x["size"] == 0)
    assert mixing.mixed(clashing).columns == clashing.columns


def test_mix_writes_rows_as_they_lie(spark, edges, edge_rows):
    got = mixing.mix(edges)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Window" not in plan
    assert sorted(x["size"] for x in got.collect()) == sorted(len(WORD.findall(r[1] or "")) for r in edge_rows)


def test_words_are_counted_without_a_list_of_them(spark):
    texts = [None, "", " ", "\n\t ", "a", " a", "a ", " a b\x0bc\x0c ", "é 中文  \U0001f600\U0001f600 x", "\xa0a\x85b", "$1 \\ $", "w w w", "\x00 \x1c \x00", "x " * 30_000, " " * 30_000]
    words = n_words(F.col("text"))
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).select(words).collect()]
    assert got == [len(WORD.findall(t or "")) for t in texts] and "regexp_extract_all" not in str(words) and "regexp_count" not in str(words)


def test_null_ids_have_keys_of_their_own(spark):
    docs = spark.createDataFrame([(None, f"text {k}") for k in range(300)] + [(None, None)] * 2, "doc_id long, text string")
    keys = [r[0] for r in docs.select(mixing.key_of(F.col("doc_id"), F.col("text"), F.lit(1.0), "mix")).collect()]
    assert len(set(keys)) == 301 and all(k > 0 for k in keys)


def test_weights_favour_heavy_documents(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'w' AS text", "'s' AS source", "IF(id < 1500, 1.0, 0.1) AS weight")
    extra = docs.unionByName(spark.range(1500).selectExpr("id + 10000 AS doc_id", "'w w w' AS text", "'t' AS source", "1.0D AS weight"))
    got = mixing.mix(extra, weight=F.col("weight")).filter("id < 10000").collect()
    times = {r["id"]: r["times"] for r in got}
    assert sum(times[i] for i in range(1500)) >= sum(times[i] for i in range(1500, 3000))


def test_near_copies_go_whatever_their_ids(spark, prose_of):
    a, b = prose_of(70, 300), prose_of(71, 300)
    rows = [(None, a), (None, a + " end"), (None, a), (7, b), (7, b + " end"), (8, b), (None, b + " end"), (None, None), (None, None), (9, prose_of(72, 50)), (9, prose_of(73, 50))]
    got = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = Counter(x["text"] for x in got)
    assert sum(n for t, n in texts.items() if t and t.startswith(a)) == 1
    assert [x["doc_id"] for x in got if x["text"] and x["text"].startswith(b)] == [7]
    assert texts[None] == 2 and sum(x["doc_id"] == 9 for x in got) == 2 and len(got) == 6


def test_mixed_rows_keep_their_own_times(spark):
    rows = [(None, f"{s} text {i} with some more words", s) for s in "abc" for i in range(40)] + [(1, "the same words", "a")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for x in mixing.mix(docs).collect():
        want[x["target"]] += x["taken"]  # each source has a target of its own
    got = {s: 0 for s in "abc"}
    for x in mixing.mixed(docs).collect():
        got[x["source"]] += len(x["text"].split())
    assert len(want) == 3 and sorted(got.values()) == sorted(want.values())


@pytest.mark.parametrize("similarity", [20, 50, 70])
def test_lower_similarities_lose_no_pair(similarity):
    draw = np.random.default_rng(similarity)
    sign, (_, _, least) = near_dedup.Signer(similarity=similarity), near_dedup.shape(similarity)
    for _ in range(100):
        h = draw.integers(0, 1 << 63, 300, np.uint64) * np.uint64(2)
        common, rest = h[: 3 * similarity], h[3 * similarity :]
        (x, p), (y, q) = sign(np.append(common, rest[::2])), sign(np.append(common, rest[1::2]))
        assert (x == y).any() and 220 - near_dedup.unlike_values(p.view(np.uint64), q.view(np.uint64)) >= least


def test_similarity_out_of_reach():
    assert near_dedup.shape(80) == (44, 5, 138)
    with pytest.raises(ValueError):
        near_dedup.shape(5)


def test_joined_labels_are_a_union_find():
    for seed in range(20):
        r, joined, parent = random.Random(seed), near_dedup.Joined(), list(range(400))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        spanning = 0
        for _ in range(3000):
            x, y = r.randrange(400), r.randrange(400)
            spanning += joined.join(x, y)
            a, b = find(x), find(y)
            parent[max(a, b)] = min(a, b)
        assert spanning < 400 and [joined.root(x) for x in range(400)] == [find(x) for x in range(400)]
    chain = near_dedup.Joined()
    for x in (3, 2, 1, 0):
        chain.join(x, x + 1)
    assert chain.root(4) == 0


def half_similar(seed, n, shared=70, own=17):
    """Texts that share most of their words' windows, each pair about 0.67 alike: many candidates, no links."""
    r = random.Random(seed)
    base = [f"b{r.randrange(10**6)}" for _ in range(shared)]
    return [" ".join(base + [f"o{r.randrange(10**9)}" for _ in range(own)]) for _ in range(n)]


def test_edges_of_a_half_similar_family_are_fewer_than_its_rows(spark):
    texts = half_similar(1, 1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = near_dedup.signatures(docs, 2, "doc_id", "text", 0, 80, False)
    rows = sigs.select("node", F.explode("keys").alias("key"), F.col("node").alias("label"), "n", *near_dedup.BIT_COLUMNS)
    found = near_dedup.neighbours(rows, 80)
    assert found.count() < rows.count() / 4
    got = near_dedup.linked(docs, n=2).collect()
    assert all(r["component_id"] == r["id"] for r in got)


def test_deduplicate_keeps_unique_texts_that_share_an_id(spark, prose_of):
    a, u = prose_of(90, 200), prose_of(91, 60)
    rows = [(1, a), (2, a + " end"), (2, u), (None, a), (None, u), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = sorted((x["doc_id"] or 0, x["text"] or "") for x in near_dedup.deduplicate(docs).collect())
    assert near == sorted([(1, a), (2, u), (0, ""), (3, "")])
    exact = sorted((x["doc_id"] or 0, x["text"] or "") for x in exact_dedup.deduplicate(docs).collect())
    assert exact == sorted([(1, a), (2, a + " end"), (2, u), (3, "")])


def test_texts_stay_where_they_are(spark, tmp_path, prose_of):
    path = f"{tmp_path}/docs"
    spark.createDataFrame([(k % 40, prose_of(k % 40, 30), "s") for k in range(80)], "doc_id long, text string, source string").write.parquet(path)
    for stage in (exact_dedup.deduplicate, near_dedup.deduplicate, mixing.mixed):
        out = stage(spark.read.parquet(path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and out.count() >= 40


def test_large_numbers_of_copies_are_joined_by_shuffle(spark, monkeypatch):
    from tidemill.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    docs = spark.createDataFrame([(k, f"text {k % 7}") for k in range(70)], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in exact_dedup.deduplicate(docs).collect()) == list(range(7))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test data")
def test_near_query_finds_what_all_pairs_give(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = [(x["doc_id"], x["n_shingles"], x["component_id"]) for x in QUERIES["op10_near_dedup"](spark, "/root/testdata/sf0.01").collect()]
    assert order(got) == order(plain_components(rows, 2, 80))
