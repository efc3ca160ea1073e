"""Quality rules, PII, language model: against plain versions, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import lm, pii, quality_rules
from tidemill.llm.elias_fano import U64, EliasFano
from tidemill.llm.queries import QUERIES
from tidemill.llm.training import remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, edges, edge_rows, prose_of):
    r = random.Random(4)
    rows = [(100 + i, " ".join(r.choice("abc") for _ in range(r.randrange(40))) + "\n" * r.randrange(3) + r.choice(["", "x # y\nx # y\n", "\n \n"]), "en", "s") for i in range(200)] + edge_rows
    got = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    want = Counter((i, *plain_counts(t)) for i, t, *_ in rows)
    assert Counter((x["id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) for x in got) == want
    for x in got:
        assert x["base_failed"] == (x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"])
        assert not (x["kept"] and x["base_failed"])


def test_divergence_rejects_what_is_unlike_its_language(spark, prose_of):
    good = [(i, prose_of(i, 150), "en") for i in range(60)]
    odd = [(100, prose_of(200, 150).upper() + "!", "en"), (101, " ".join(w + "###" for w in prose_of(201, 150).split()), "en"), (102, " ".join(f"rare{i}" for i in range(150)), "en")]
    got = {x["id"]: x["kept"] for x in quality_rules.verdicts(spark.createDataFrame(good + odd, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i, *_ in good) and not any(got[i] for i, *_ in odd)


def test_flat_and_small_languages_have_references(spark):
    flat = [(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for k in range(60)), "flat") for i in range(40)]
    small = [(100 + i, " ".join(f"{w}{k}" for k in range(6) for w in "good plain words of a small language that says little".split()), "small") for i in range(3)]
    mute = [(200 + i, "\n" * 300, "mute") for i in range(2)]
    junk = [(300, " ".join(f"9{k:04d}#" for k in range(60)), "flat"), (301, " ".join(f"9{k:04d}#" for k in range(60)), "small")]
    got = {x["id"]: x for x in quality_rules.verdicts(spark.createDataFrame(flat + small + mute + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["char_distance"] is not None and (got[i]["word_distance"] is not None) == (lang == "flat") for i, _, lang in flat + small + junk)
    assert not got[300]["kept"] and not got[301]["kept"] and all(got[i]["kept"] for i, *_ in flat + small)
    assert all(got[i]["char_distance"] == 0 and got[i]["word_distance"] is None for i, *_ in mute)
    refs = {r["lang"]: r for r in quality_rules.references(spark.createDataFrame(flat, "doc_id long, text string, lang string")).collect()}
    counts = Counter(w for _, t, _ in flat for w in t.split())
    assert refs["flat"]["words"] == sorted(counts, key=lambda w: (-counts[w], w))[:20]


def test_divergence_is_jensen_shannon(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(quality_rules.distance(F.col("p"), F.col("q"))).first()[0]
    assert math.isclose(got, math.sqrt((kl(p) + kl(q)) / 2))


def test_empty_tables(none):
    assert quality_rules.verdicts(none).count() == 0 and pii.spans(none).count() == 0
    assert lm.score(none, lm.train(none, F.lit(True))).count() == 0


RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, (kind, p) in enumerate(RULES) for m in re.finditer(p, text) if good(kind, m[0])]


def test_seeds():
    r = random.Random(1)
    parts = ["a", "@", "@a.b", ".", "1", "12", "255", "256", "0", "00", "-", " ", "+", "(", ")", "4111111111111111", "a.b@c.de", "1.2.3.4", "+1 (234) 555-6789", "x", "é", "\n"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert pii.seeds(text) == sorted(plain_spans(text)), text


def test_seeds_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" + "(" * 300_000, "a@b" * 100_000):
        pii.candidates(text, pii.seeds(text)[:10])


def test_bootstrapping_finds_what_the_rules_miss(spark):
    rows = [(k, f"filler here, reach me at user{k}@mail.example.com thanks") for k in range(40)]
    rows += [(k, f"please reach me at user{k}@localhost today") for k in range(40, 44)] + [(k, f"order number 12345{k} shipped") for k in range(44, 60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.spans(docs)
    got = {r["id"]: [(s["kind"], rows[r["id"]][1][s["start"] : s["end"]]) for s in r["spans"]] for r in out.collect()}
    assert all(got[k] == [(0, f"user{k}@mail.example.com")] for k in range(40))
    assert all(got[k] == [(0, f"user{k}@localhost")] for k in range(40, 44))
    assert not any(got[k] for k in range(44, 62))
    text = docs.join(out, F.col("doc_id") == F.col("id")).filter("id = 41").select(pii.redacted(F.col("text"), F.col("spans"))).first()[0]
    assert text == "please reach me at [email] today"


def plain_bootstrap(texts):
    """The discovered (text, kind, start, end), by rounds over plain dictionaries."""
    occurrences = [(k, *c) for k, t in enumerate(texts) for c in pii.candidates(t, pii.seeds(t))]
    total, support = Counter(), defaultdict(set)
    for _, kind, _, _, shape, patterns, instance in occurrences:
        for p in patterns:
            total[p] += 1
            support[p].add(instance)
    held = {}
    while True:
        weight = Counter()
        for _, kind, _, _, shape, patterns, instance in occurrences:
            for p in patterns:
                for k in range(4):
                    if kind == k or (kind < 0 and shape >> k & 1 and (instance, k) in held):
                        weight[p, k] += 1
        sure = {x: w / (total[x[0]] + 1) for x, w in weight.items() if len(support[x[0]]) >= 5 and w / (total[x[0]] + 1) >= 0.4}
        miss = defaultdict(lambda: 1.0)
        edges = {(p, instance, k) for _, kind, _, _, shape, patterns, instance in occurrences if kind < 0 for p in patterns for k in range(4) if shape >> k & 1}
        for p, instance, k in edges:
            if (p, k) in sure:
                miss[instance, k] *= 1 - min(0.999, sure[p, k])
        new = {x: 1 - m for x, m in miss.items() if 1 - m >= 0.8}
        if len(new) == len(held):
            break
        held = new
    out = set()
    for t, kind, s, e, shape, patterns, instance in occurrences:
        fit = [(new[instance, k], -k) for k in range(4) if kind < 0 and (instance, k) in new and any(sure.get((p, k), 0) >= 0.8 for p in patterns)]
        if fit:
            out.add((t, -max(fit)[1], s, e))
    return out


def test_bootstrapping_over_planted_contexts(spark, prose_of):
    """Identifiers that the rules miss, before and after words that stand next to those they find; numbers in other contexts stay."""
    r, texts, want = random.Random(8), [], set()
    contexts = {0: ("write to", "for details"), 1: ("server address", "is down"), 3: ("call me at", "after lunch")}
    seen = {0: lambda: f"u{r.randrange(10**6)}@mail{r.randrange(50)}.example", 1: lambda: ".".join(str(r.randrange(256)) for _ in range(4)), 3: lambda: f"+1 {r.randrange(200, 999)} {r.randrange(200, 999)} {r.randrange(1000, 9999)}"}
    hidden = {0: lambda: f"u{r.randrange(10**6)}@localhost", 1: lambda: "300." + ".".join(str(r.randrange(10, 256)) for _ in range(3)), 3: lambda: f"({r.randrange(100, 999)}) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}"}
    for k in range(400):
        kind = r.choice([0, 1, 3])
        new = r.random() < 0.15
        what = (hidden if new else seen)[kind]()
        a, b = contexts[kind]
        side = r.choice([a + " {}", "{} " + b, a + " {} " + b])
        head = prose_of(k, r.randrange(4, 9)).replace(".", "") + " "
        text = head + side.format(what) + " " + prose_of(1000 + k, 5).replace(".", "")
        if new:
            at = text.index(what)
            want.add((k, kind, at, at + len(what)))
        texts.append(text + r.choice(["", f" order {r.randrange(10**6, 10**7)} shipped", f" item {r.randrange(100)} {r.randrange(10**5, 10**6)}"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["id"], s["kind"], s["start"], s["end"]) for x in pii.spans(docs).collect() for s in x["spans"] if s not in x["base"]}
    assert got == plain_bootstrap(texts)
    assert len(want) > 30 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got)


def test_very_long_numbers_and_words(spark):
    zeros = "0." + "0" * 5000 + ".0.0"
    assert pii.seeds(zeros) == [(1, 0, len(zeros))] and pii.seeds("1." + "9" * 5000 + ".0.0") == []
    x, y = "a" * 130 + "b", "c" * 7 + "a" * 123 + "b"  # these differ only far from the span
    one, two = (pii.candidates(f"{w} a@b.cd", [(0, 132, 138)]) for w in (x, y))
    assert one[0][4] != two[0][4]
    rows = [(1, zeros), (2, "a" * 200_000 + " 1.2.3.4"), (3, "12 34 567 89 " * 2000)]
    assert [len(r["base"]) for r in sorted(pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())] == [1, 1, 0]


def test_pii_edges(edges, edge_rows, clashing):
    assert pii.spans(edges).count() == len(edge_rows) == pii.spans(clashing).count()


@pytest.mark.parametrize("top", [50, 1000, 10**9, 2**63])
def test_elias_fano(top):
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 1000, 40_000):
        v = np.sort(r.integers(0, top, n, dtype=np.uint64))
        e = EliasFano(EliasFano.build(v, "x"), "x")
        if n:
            assert (e.get(np.arange(n)) == v).all()
            q = np.concatenate([r.integers(0, top, 500, dtype=np.uint64), v[:200], v[-1:] + U64(1), np.array([0], np.uint64)])
            assert (e.successor(q, 0, n) == np.searchsorted(v, q)).all()
            found = e.find(q)
            assert ((found >= 0) == np.isin(q, v)).all() and (v[found[found >= 0]] == q[found >= 0]).all()


def plain_model(tokens, train):
    c1 = Counter(w for i in train for w in tokens[i])
    n, v = sum(c1.values()), len(c1)
    c2, c3 = Counter(), Counter()
    for i in train:
        s = ["\n", *tokens[i]]
        c2.update(zip(s, s[1:]))
        c3.update(zip(s, s[1:], s[2:]))
    l2, l3 = defaultdict(float), defaultdict(float)
    for (a, _), c in c2.items():
        l2[a] += (c - 0.75) / c1[a]
    for (a, b, _), c in c3.items():
        l3[a, b] += (c - 0.75) / c2[a, b]

    def one(w):
        return (c1[w] + 0.5) / (n + 0.5 * (v + 1))

    def two(a, w):
        return (max(c2.get((a, w), 0) - 0.75, 0) / c1[a] if c1[a] else 0) + (1 - l2[a]) * one(w)

    def three(a, b, w):
        return (max(c3.get((a, b, w), 0) - 0.75, 0) / c2[a, b] if (a, b) in c2 else 0) + (1 - l3[a, b]) * two(b, w)

    return c1, n, one, two, three


@pytest.mark.parametrize("tokens", [4_000_000, 700, 40])  # one shard, some, and so many that words and pairs are cut
def test_language_model(spark, edge_rows, prose_of, monkeypatch, tokens):
    monkeypatch.setattr(lm, "SHARD_TOKENS", tokens)
    rows = [(1000 + k, prose_of(k % 30, 40 + k % 7)) for k in range(120)] + [(2000 + k, f"the hot pair x{k} the hot pair") for k in range(60)] + [r[:2] for r in edge_rows if r[0] is not None and len(r[1] or "") < 10**5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(docs, remainder("doc_id", 5) != 1)
    ends = {i: [*((t or "").encode().lower().decode().split()), "\n"] for i, t in enumerate(x[1] for x in rows)}
    train = [k for k, r in enumerate(rows) if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    c1, n, one, two, three = plain_model(ends, train)
    assert model[1:] == (n, len(c1))
    m = lm.Model(*model)
    the, of = m.word_ids([b"the", b"of"])
    words, nodes = m.levels[1].children(int(the))
    assert dict(zip(words.tolist(), nodes.tolist()))[int(of)] == m.levels[1].find(m.levels[1].pair(np.array([the]), np.array([of])))[0][0] and (np.diff(words) > 0).all()
    want = []
    for k, (doc_id, _) in enumerate(rows):
        s = ["\n", *ends[k]]
        score = math.log10(two(s[0], s[1])) + sum(math.log10(three(*s[i - 2 : i + 1])) for i in range(2, len(s)))
        want.append((doc_id, len(s) - 1, sum(c1[w] > 0 for w in s[1:]), sum(math.log10(one(w)) for w in s[1:]), score))
    got = [tuple(x) for x in lm.score(docs, model).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-9) and abs(a[4] - b[4]) <= 4e-4 * b[1]


def test_clashing_columns_and_null_ids(spark, clashing, edge_rows):
    assert quality_rules.verdicts(clashing).count() == len(edge_rows)
    model = lm.train(clashing, remainder("doc_id", 5) != 1)
    got = lm.score(clashing, model).collect()
    assert len(got) == len(edge_rows) and sum(r["id"] is None for r in got) == 1 and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in got)
    again = lm.grown(*lm.encoded(clashing, remainder("doc_id", 5) != 1))
    assert again[1:] == model[1:]


def test_registered_language_model_keeps_what_is_found_once(spark, tmp_path):
    train, held = (next(i for i in range(100) if (zlib.crc32(str(i).encode()) % 5 == 1) is x) for x in (False, True))
    text = " ".join(f"once{k}" for k in range(10))
    spark.createDataFrame([(train, text), (held, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in QUERIES["op8_language_model"](spark, str(tmp_path)).collect()}
    one = 1.5 / (11 + 0.5 * 12)
    two = 0.25 + 0.75 * one
    want = math.log10(two) + 10 * math.log10(0.25 + 0.75 * two)
    assert got[held]["held_out"] and not got[train]["held_out"] and got[held]["train_tokens"] == 11
    assert abs(got[held]["score"] - want) <= 4e-4 * 11 and abs(got[train]["score"] - want) <= 4e-4 * 11


def test_hash_of_base(spark):
    got = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4")], "doc_id long, text string")
    row = pii.spans(got).select(F.sha2(pii.written("base"), 256)).first()
    assert row[0] == hashlib.sha256(b"email:5:11,ip:15:22").hexdigest()
