import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from quillon.llm import mixing, neardup, neighbours, packing, together, variants


# near-duplicates


def word_sets(texts, width):
    out = set()
    for t in texts:
        w = [x for x in (regex.sub(r"[^\p{L}\p{N}]+", "", p) for p in re.split("[ \t\n]+", t.lower())) if x]
        out |= {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return out


# plain lists, lists in blocks, lists of pairs of tokens (and these in blocks), a sketch so small that most tokens share its cells, no broadcast
@pytest.mark.parametrize(("hot", "paired", "threshold", "width", "cells", "small"), [(10**9, 32, 0.6, 3, 1 << 22, 10**6), (3, 32, 0.6, 3, 1 << 22, 0), (4, 1, 0.6, 3, 1 << 22, 10**6), (1, 2, 0.6, 3, 1 << 22, 0), (2, 1, 0.8, 5, 16, 10**6), (10**9, 32, 0.8, 5, 16, 0)])
def test_pairs_equal_brute_force(spark, hot, paired, threshold, width, cells, small):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [[" ".join(rng.choices(vocabulary, k=rng.randint(25, 260)))] for _ in range(40)]
    for base in list(texts[:25]):
        w = base[0].split()
        for _ in range(3):
            for i in rng.sample(range(len(w)), max(1, len(w) // rng.choice([12, 20, 40]))):
                w[i] = rng.choice(vocabulary)
            texts.append([" ".join(w)])
    texts += [texts[0], texts[0], [None, texts[1][0]], [""], None, ["few words only"], ["Some " * 5, None]]
    rows = [(i % 2 if i < 40 else 0, i, t, "x") for i, t in enumerate(texts)] + [(0, 0, texts[0], "again"), (0, None, texts[0], "none")]
    df = spark.createDataFrame(rows, "kind int, key long, texts array<string>, tokens string")
    sets = {(k, i): word_sets([x for x in (t or []) if x], width) for k, i, t, _ in rows if i is not None}
    sets = {k: s for k, s in sets.items() if len(s) >= 20}
    want = {(a[0], min(a[1], b[1]), max(a[1], b[1])) for a, b in itertools.combinations(sets, 2) if a[0] == b[0] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    got = {tuple(r) for r in neardup.expand(*neardup.near_duplicates(df, threshold, width, 20, hot, cells, small, paired)).collect()}
    assert got == want and len(want) > 10
    empty = neardup.expand(*neardup.near_duplicates(df.limit(0), threshold, width, 20))
    assert empty.count() == 0


def test_a_sketch_never_says_too_few(spark):
    rng = np.random.default_rng(3)
    tokens, n = np.unique(rng.integers(0, 1 << 52, 500)), rng.integers(1, 5000, 500)
    df = spark.createDataFrame(list(zip(tokens.tolist(), n.tolist(), strict=False)), "token long, n long")
    true = np.array([neardup.grade(int(x)) for x in n[: len(tokens)]])
    wide, narrow = (neardup.grades(neardup.sketch_of(df, c), tokens) for c in (1 << 16, 64))
    assert (wide >= true).all() and (wide == true).mean() > 0.99 and (narrow >= true).all()


def test_tokens_follow_the_words():
    a, b = "Hello, World!  the\tquick\nbrown fox", "hello world the quick brown-fox"
    kind = np.zeros(2, np.int64)
    n, tokens, h, _ = neardup.token_sets([a, b], kind, 3)
    assert n.tolist() == [4, 3] and len(set(tokens[:4]) & set(tokens[4:])) == 2 and h[0] != h[1]
    assert neardup.token_sets(["", "..."], kind, 3)[0].tolist() == [0, 0]
    other = neardup.token_sets([a, a], np.array([0, 1]), 3)[1]
    assert not set(other[:4]) & set(other[4:])


def test_tokens_of_one_record_make_no_lists():
    n, tokens = np.array([40, 40]), np.sort(np.random.default_rng(1).integers(0, 1 << 52, 80).reshape(2, 40), axis=1).ravel()
    sketch = np.zeros(2 << 16, np.uint8)
    shared = tokens[[1, 50]]
    sketch[shared & 0xFFFF], sketch[(shared >> 16 & 0xFFFF) + (1 << 16)] = 4, 4
    _, lists, _ = neardup.lists_of(np.arange(2), n, tokens, sketch, 0.02, 1, 100, 32)
    assert set(lists.tolist()) == set(shared.tolist())


def test_repeated_records_are_no_pair_and_large_tables_of_keys_shuffle_no_text(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(30)]
    rows = [(0, 100 * c + i, [t if c < 3 else t.replace("w1", "v1", 1)]) for c in range(4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:10], "kind int, key long, texts array<string>")
    for small in (10**6, 0):
        pairs, members = neardup.near_duplicates(df, 0.6, 3, 20, small=small)
        assert pairs.filter("a >= b").count() == 0 and pairs.count() > 5
        base = df.select(df["kind"].cast("tinyint").alias("kind"), "key", df["texts"][0].alias("text"))
        leaders, _ = neardup._leaders(base, members, small)
        assert leaders.count() == members.filter("key = rep").count() + 10
        assert "hashpartitioning(kind" not in leaders._jdf.queryExecution().executedPlan().toString()
        assert neardup.expand(pairs, members).exceptAll(neardup.expand(pairs, members).distinct()).count() == 0


def test_groups_connect_classes(spark):
    pairs = spark.createDataFrame([(0, 1, 2, 0.9), (0, 2, 3, 0.9), (1, 2, 7, 0.8)], "kind tinyint, a long, b long, similarity double")
    members = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 30, 3), (0, 9, 9), (1, 2, 2), (1, 7, 7)], "kind tinyint, key long, rep long")
    got = {tuple(r) for r in neardup.groups(pairs, members).collect()}
    assert got == {(0, 1, 1, 1, 1), (0, 2, 2, 1, 2), (0, 3, 3, 1, 1), (0, 30, 3, 1, 1), (0, 9, 9, 9, 0), (1, 2, 2, 2, 1), (1, 7, 7, 2, 1)}


# pairs of items


@pytest.mark.parametrize(("heavy", "list_items"), [(0, 1024), (3, 1024), (50, 7), (3, 2)])
def test_counts_equal_brute_force(spark, heavy, list_items):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(40)]
    rows = [(i, [names[min(39, int(rng.expovariate(0.15)))] for _ in range(rng.randint(0, 6))], 1) for i in range(300)]
    rows += [(1000, None, 1), (1001, [None, "", "n1", "n1"], 1), (None, ["n1", "n2"], 1), (5, rows[5][1], 2), (1002, [f"x{i}" for i in range(200)], 1)]
    df = spark.createDataFrame(rows, "k long, l array<string>, n long")
    lists = {k: {x for x in (v or []) if x} for k, v, _ in rows if k is not None}
    single, both = Counter(), Counter()
    for s in lists.values():
        single.update(s)
        both.update(itertools.combinations(sorted(s), 2))
    want = {(a, b): (n, single[a], single[b], len(lists)) for (a, b), n in both.items() if n >= 2}
    got = {(r.name_a, r.name_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in together.pairs_together(df, "k", "l", 2, 0, heavy, list_items=list_items).collect()}
    assert got == want
    rare = {(r.name_a, r.name_b) for r in together.pairs_together(df, "k", "l", 3, 1.5, heavy, list_items=list_items).collect()}
    assert rare == {k for k, (n, a, b, t) in want.items() if n >= 3 and n * t >= 1.5 * a * b}
    assert together.pairs_together(df.limit(0), "k", "l").count() == 0


# nearest vectors


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + 0.05 * rng.standard_normal((n - n // 2, 64)).astype(np.float32)
    return x


def test_recall_and_radius(spark):
    x = vectors(3000)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(5, x[5].tolist(), "again"), (9000, None, ""), (9001, [1.0] * 3, ""), (9002, [0.0] * 64, ""), (9003, [float("nan")] * 64, ""), (9004, [float("inf")] + [0.0] * 63, ""), (None, x[0].tolist(), ""), (9005, [None] + [1.0] * 63, "")]
    df = spark.createDataFrame(rows, "id long, v array<float>, score string")
    got = defaultdict(dict)
    for r in neighbours.nearest(df, "id", "v", 10, ask=df["id"] % 50 == 0).collect():
        got[r.key_a][r.key_b] = r.distance
    hit = 0
    for q in range(0, 3000, 50):
        d = np.sqrt(np.maximum(0, 2 - 2 * unit @ unit[q]))
        d[q] = 9
        true = set(np.argsort(d)[:10].tolist())
        hit += len(true & set(got[q]))
        assert all(abs(d[k] - v) < 1e-4 for k, v in got[q].items())
    assert hit / 600 >= 0.95
    near = {tuple(sorted((r.key_a, r.key_b))) for r in neighbours.nearest(df, "id", "v", 10, radius=0.3, probes=8).collect()}
    d2 = 2 - 2 * unit @ unit.T
    i, j = np.nonzero(np.triu(d2 <= 0.09, 1))
    true = set(zip(i.tolist(), j.tolist(), strict=True))
    assert near <= true and len(near) >= 0.97 * len(true)
    assert neighbours.nearest(df.limit(0), "id", "v").count() == 0


def test_copies_share_neighbours(spark):
    x = vectors(40, 1)
    rows = [(i, x[0].tolist()) for i in range(30)] + [(100 + i, v.tolist()) for i, v in enumerate(x[1:5])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, "id", "v", 3).orderBy("key_a", "rank").collect():
        got[r.key_a].append(r.key_b)
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and len(got) == 34 and all(len(v) == 3 for v in got.values())


# containers and mixtures


def test_boundaries_are_optimal():
    rng = random.Random(5)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 60), 9)))
        counts = np.array([rng.randint(1, 9) for _ in sizes])
        for k in (1, 2, 3, 4):
            bounds = packing.boundaries(sizes, counts, k)
            cost = lambda b: sum(c * (min(x for x in b if x >= s) - s) for s, c in zip(sizes, counts, strict=True))
            least = min(cost([*c, sizes[-1]]) for c in itertools.combinations(sizes[:-1].tolist(), k - 1))
            assert cost(bounds.tolist()) == least and len(bounds) <= k


def test_containers_hold_everything(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([5, 30, 60, 99, 100, 101, 250, 1000])) for i in range(500)] + [(600, None), (601, 0), (None, 5), (3, 40)]
    counts = spark.createDataFrame(rows, "key long, tokens int")
    limits = spark.createDataFrame([("a", 100), ("b", 1000), (None, 5), ("z", 0)], "pack_name string, capacity_tokens int")
    for across in (True, False):
        got = packing.pack(counts, limits, across=across).collect()
        for name, capacity in (("a", 100), ("b", 1000)):
            own = [r for r in got if r.pack_name == name]
            used = Counter()
            for r in own:
                used[r.container] += r.tokens
            assert max(used.values()) <= capacity and set(used) == set(range(len(used)))
            assert sum(used.values()) == sum(t for k, t in rows if k is not None and t)
            for k, t in rows:
                if k is not None and t and k != 3:
                    parts = sorted((r.start_token, r.tokens) for r in own if r.key == k)
                    assert len(parts) == -(-t // capacity) and sum(p[1] for p in parts) == t
    assert {r.pack_name for r in got} == {"a", "b"}
    assert packing.pack(counts.limit(0), limits).count() == 0 and packing.pack(counts, limits.limit(0)).count() == 0


def test_knapsack_is_exact():
    rng = random.Random(9)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 30), 5)))
        counts = np.array([rng.randint(0, 4) for _ in lengths])
        budget = rng.randint(0, 150)
        taken = packing_sum = mixing.knapsack(lengths, counts, budget)
        reach = {0}
        for size, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach = {r + size * k for r in reach for k in range(n + 1)}
        packing_sum = int((taken * lengths).sum())
        assert (taken <= counts).all() and (taken >= 0).all() and packing_sum == max(r for r in reach if r <= budget)


def test_mixture_meets_its_shares(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aab"), rng.randint(1, 400)) for i in range(2000)] + [(5000 + i, "c", 7) for i in range(9)] + [(9000, None, 5), (9001, "a", None), (None, "a", 5), (9002, "q", 9)]
    counts = spark.createDataFrame(rows, "key long, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.499, 2), ("c", 0.001, 4), ("d", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(counts, targets).cache()
    limit = {"a": 1, "b": 2, "c": 4}
    assert all(r.times <= limit[r.source] for r in mixed.collect())
    got = {r.source: r.share for r in mixing.shares(mixed, targets.filter("source IS NOT NULL")).collect()}
    assert got["a"] == pytest.approx(0.5, abs=2e-4) and got["b"] == pytest.approx(0.499, abs=2e-4) and got["d"] == 0
    assert mixing.mix(counts.limit(0), targets).count() == 0 and mixing.mix(counts, targets.limit(0)).count() == 0


# names


def test_distance_is_a_metric_and_vectorised_alike():
    rng = random.Random(6)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(40)]
    left, right = zip(*itertools.product(words, words[:12]), strict=True)
    assert variants.distances(*variants._codes(list(left)), *variants._codes(list(right))).tolist() == [variants.distance(a, b) for a, b in zip(left, right, strict=True)]
    assert all(variants.one_edit(a, b) == (variants.distance(a, b) <= 1) for a, b in zip(left, right, strict=True))
    for a, b, c in itertools.product(words[:14], repeat=3):
        assert variants.distance(a, c) <= variants.distance(a, b) + variants.distance(b, c)
    assert [variants.distance(*x) for x in (("ca", "abc"), ("abcd", "abdc"), ("kitten", "sitting"), ("", "ab"))] == [2, 1, 3, 2]


# cells as they come, divided by pivots again and again, and dealt to blocks at once or after one division
@pytest.mark.parametrize(("cell_keys", "levels", "radius"), [(512, 6, 1), (10, 6, 1), (10, 0, 1), (5, 1, 1), (20, 2, 2)])
def test_radius_join_equals_brute_force(spark, cell_keys, levels, radius):
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcde", k=rng.randint(4, 7))) for _ in range(300)} | {"a", "b", "é田"})
    df = spark.createDataFrame([("x", w) for w in words] + [("x", words[0]), ("x", None), (None, "a"), ("y", words[1]), ("y", "")], "cls string, key string")
    got = {(r.cls, r.a, r.b): r.n for r in variants.radius_join(df, radius, cell_keys, levels).collect()}
    every = {("x", a, b): variants.distance(a, b) for a, b in itertools.combinations(words, 2)}
    assert got == {k: n for k, n in every.items() if n <= radius}


@pytest.mark.parametrize("small", [10**6, 0])
def test_names_of_one_entity(spark, small):
    same = [
        ["William Kadazofow", "Bill Kadazofow", "william.kadazofow", "Kadazofow, William T.", "Dr. William Kadazofow", "Wiliam Kadazofow", "WILLIAM KADAZOFOW", "William (Bill) Kadazofow"],
        ["Nikolai Kadazofow", "Kolya Kadazofow", "N. Kadazofow", "nkadazofow"],
        ["Relirepax International Ltd.", "relirepaxinternational", "Relirepax Intl.", "Relirepax-International", "International, Relirepax Ltd.", "The Relirepax International", "Relirepax Internatinoal"],
        ["Relirepax Laboratories", "Relirepax Labs B.V."],
        ["Zenivodent Research GmbH", "Zenivodent"],
        ["Иван Петров", "ИВАН ПЕТРОВ", "Петров, Иван", "Иван Петорв"],
        ["田中 太郎", "田中　太郎"],
        ["Mary Jane Watson", "MARY JANE WATSON", "Mary Jane Watsno"],
        ["John McCarthy", "Jack McCarthy", "McCarthy, John"],
        ["DataWorks Inc", "DataWorks Incorporated", "Dataworks Inc."],
        ["3M Company", "3M Co."],
        ["Acme Global Trading House Ltd", "Acme Global Trading House", "Acme Global Trading Huose Limited"],
        ["Margaret Li", "Peggy Li", "M. Li"],
    ]
    other = ["Relirepax", "alias-table-n2l6i", "Draft Search Index DIQG1", "Draft Search Index DIQG2", "검색 서비스", "", None, "W. Nobody", "Li Wu", "Wu Laboratories", "田中 次郎", "Mary Wilson", "7M Company", "Acme Global Trading Hall Ltd"]
    df = spark.createDataFrame([(n, "e") for g in same for n in g] + [(n, "e") for n in other] + [("Mary Adams", "e"), ("Mary Bond", "e"), (same[0][0], "again")], "name string, entity string")
    linked = variants.link_names(df, small=small)
    got = defaultdict(set)
    for r in linked.collect():
        got[r.entity].add(r.name)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, same))
    assert variants.link_names(df.limit(0)).count() == 0
    assert variants.pairs(linked).count() == sum(len(g) * (len(g) - 1) // 2 for g in same)


def test_long_lists_of_mostly_rare_items_count(spark):
    rows = [(i, ["a", "b", *(f"r{i}_{j}" for j in range(20))]) for i in range(3)]
    df = spark.createDataFrame(rows, "k long, items array<string>")
    got = together.pairs_together(df, "k", "items", min_count=2, list_items=8).collect()
    assert [(r.name_a, r.name_b, r.n_ab, r.n) for r in got] == [("a", "b", 3, 3)]  # fewer items are frequent enough than a list is long
