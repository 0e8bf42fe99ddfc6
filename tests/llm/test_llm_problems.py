"""Each problem's operator against brute force on small fixtures, with nulls, ties, repeats, empty tables and clashing names."""

import random
import statistics
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ferrule.llm import distinctive_terms, group_top, joint_rank, mixing, near_duplicates, packing, set_overlaps, subject_areas, term_counts, token_sizes

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1

VECTORS = "pmid long, field string, term string, term_frequency double, document_frequency double, loaded_at timestamp, records long, occurrences string"


def test_burst_trie_counts_any_strings():
    rng, want = random.Random(1), defaultdict(lambda: [0, 0])
    trie = term_counts.BurstTrie(burst=3)
    words = ["", "a", "ab", "abc", "é", "x" * 5000] + ["".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(300)]
    for _ in range(3000):
        w = rng.choice(words)
        trie.add(w, 2.0, 1)
        want[w][0] += 2.0
        want[w][1] += 1
    assert {t: [o, r] for t, o, r in trie.items()} == dict(want)
    assert len(list(trie.items())) == len(want)


def test_terms_latest_row_counts(spark):
    data = [
        (1, "ti", " Alpha ", 1.0, None, T0, None, None), (1, "ti", "alpha", 5.0, 9.0, T0 + timedelta(1), 1, "x"), (1, "ti", "alpha", 5.0, 9.0, T0 + timedelta(1), 1, "x"),
        (1, "ab", "ALPHA", 2.0, 9.0, T0, None, None), (2, "ti", "alpha", None, 1.0, T0, None, None), (2, None, "beta", 4.0, 1.0, None, None, None),
        (3, "ti", "alpha", 3.0, None, None, None, None), (3, "ti", "alpha", 4.0, None, None, None, None), (None, "ti", "alpha", 9.0, None, T0, None, None),
        (4, "ti", None, 1.0, None, T0, None, None), (4, "ti", "  ", 1.0, None, T0, None, None),
    ]
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_counts.marked_terms(spark.createDataFrame(data, VECTORS)).collect()}
    assert got == {"alpha": (11.0, 3, "common"), "beta": (4.0, 1, "rare")}
    assert term_counts.marked_terms(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize(("held", "part"), [(10**6, 10**6), (20, 50)])
def test_terms_under_dense_and_thin_prefixes(spark, held, part):
    """Tries that are sent on early, and prefixes that are cut further, count as one pass over all rows does."""
    rng = random.Random(12)
    words = [f"dense{i}" for i in range(300)] + ["d", "dense", "ü", "日本語", "x" * 4000, "x" * 4000 + "y", "-1"] + ["".join(rng.choices("ab", k=30)) for _ in range(40)]
    data = [(pmid, "ti", w, float(rng.randint(1, 3)), None, T0, None, None) for pmid in range(60) for w in rng.sample(words, 40)]
    want = {}
    for _, _, w, tf, *_ in data:
        n, k = want.get(w, (0.0, 0))
        want[w] = (n + tf, k + 1)
    df = spark.createDataFrame(data, VECTORS).repartition(5)
    got = term_counts.term_counts(df, burst=4, held_terms=held, entries_a_part=part).collect()
    assert {r.term: (r.occurrences, r.records) for r in got} == want and len(got) == len(want)
    heavy = term_counts.routing_prefixes(term_counts.term_counts(df), 4)
    assert "dens" in heavy and "ü" not in heavy


# 2


def brute_order(lists, sources, group_items):
    out = {}
    for g, items in group_items.items():
        ranks = {i: [] for i in items}
        for s in sources:
            here = {i: v for (gg, ss, i), v in lists.items() if gg == g and ss == s}
            for i in items:
                ranks[i].append(1 + sum(v > here[i] for v in here.values()) if i in here else len(items) + 1)
        for i in items:
            out[g, i] = (statistics.median(ranks[i]), round(sum(ranks[i]) / len(sources), 6))
    return out


@pytest.mark.parametrize("heavy", [10**6, 5])
def test_joint_order_is_brute_force_order(spark, heavy):
    rng = random.Random(2)
    lists = {(g, s, i): rng.choice([rng.random(), 0.5, -3.0]) * 10 ** "abc".index(s) for g in "xy" for s in "abc" for i in range(25) if rng.random() < 0.8}
    data = [(g, s, i, v, None) for (g, s, i), v in lists.items()] + [("x", "a", 99, None, 1), ("x", "zz", 1, 7.0, 1), (None, "a", 1, 1.0, 1), ("x", None, 1, 1.0, 1), ("x", "a", None, 1.0, 1), ("x", "a", 98, float("nan"), 2)]
    df = spark.createDataFrame(data, "topic string, scorer string, pmid long, score double, n long")
    got = {(r.topic, r.pmid): (r.median_rank, round(r.mean_rank, 6)) for r in joint_rank.joint_order(df, "topic", "pmid", "scorer", ["a", "b", "c"], heavy_rows=heavy).collect()}
    want = brute_order(lists, "abc", {g: {i for gg, _, i in lists if gg == g} for g in "xy"})
    assert got == want
    assert joint_rank.joint_order(df.limit(0), "topic", "pmid", "scorer", ["a", "b", "c"]).count() == 0


def test_weights_move_the_median(spark):
    df = spark.createDataFrame([("t", s, i, v) for s, vs in {"a": [3, 2, 1], "b": [1, 2, 3], "c": [1, 3, 2]}.items() for i, v in enumerate(map(float, vs))], "topic string, s string, item long, score double")
    order = joint_rank.joint_order(df, "topic", "item", "s", ["a", "b", "c"], weights={"a": 5.0})
    assert [r["item"] for r in joint_rank.first_in_order(order, "topic", "item", 3).orderBy("position").collect()] == [0, 1, 2]


def test_missing_measures(spark):
    nan = float("nan")
    df = spark.createDataFrame([("t", 1, [1.0, None, nan]), ("t", 1, [2.0, None, nan]), ("t", 2, []), ("t", 3, None), ("t", 4, [0.5] * 9), (None, 5, [1.0])], "topic string, candidate_id long, scores array<double>")
    assert rows(joint_rank.measure_lists(df)) == sorted([("t", "1", 1, 2.0)] + [("t", str(m), 4, 0.5) for m in range(1, 6)], key=repr)


# 3


@pytest.mark.parametrize("chunk", [32, 3])
def test_overlaps_are_exact(spark, chunk):
    rng = random.Random(3)
    sets = {h: {rng.randrange(60) for _ in range(rng.randint(1, 50))} | {1000} for h in range(12)}
    data = [(h, p, None) for h, s in sets.items() for p in s for _ in range(rng.randint(1, 3))] + [(None, 5, 1), (3, None, 1), (None, None, None)]
    df = spark.createDataFrame(data, "hash long, pmid long, size long")
    want = [(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a, b in combinations(sets, 2) if sets[a] & sets[b]]
    assert rows(set_overlaps.overlaps(df, chunk=chunk)) == sorted(want, key=repr)
    same = set_overlaps.largely_same(set_overlaps.overlaps(df), 20, 0.5)
    assert {(r.a, r.b) for r in same.collect()} == {(a, b) for a, b, n, x, y in want if min(x, y) >= 20 and 2 * n >= min(x, y)}
    assert set_overlaps.overlaps(df.limit(0)).count() == 0


# 4


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize(("threshold", "hot"), [(0.7, 10**6), (0.7, 3), (0.8, 10**6), (0.9, 5)])
def test_no_similar_pair_is_lost(spark, threshold, hot):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)]
    sets = {}
    for i in range(0, 120, 4):
        base = set(rng.sample(words, rng.randint(1, 90)))
        sets[i] = base
        for j in range(1, 4):  # at and around the threshold
            other, target = set(base), threshold + rng.choice([-0.03, 0, 0, 0.01, 0.05])
            pool = [w for w in words if w not in base]
            rng.shuffle(pool)
            while len(other) > 1 and jaccard(base, other) > target and (pool or len(other) > 1):
                if pool and rng.random() < 0.5:
                    other.add(pool.pop())
                else:
                    other.discard(rng.choice(sorted(other & base) or sorted(other)))
            sets[i + j] = other
    want = {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) * 10 >= len(sets[a] | sets[b]) * round(threshold * 10)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, terms array<string>")
    assert {(r.a, r.b) for r in near_duplicates.similar_classes(df, threshold, hot).collect()} == want
    assert want


MEDLINE = "pmid long, ti string, ab string, loaded_at timestamp, id long, terms string, size int"


def test_records_pairs_and_groups(spark, tmp_path):
    text = " ".join(f"term{i}" for i in range(40))
    long = text + " " + " ".join(f"x{i}" for i in range(3000))
    data = [(1, None, text.upper() + " <!>", T0, 1, None, 0), (2, text, None, T0, 2, None, 0), (2, "old", "old", T0 - timedelta(1), 2, None, 0), (3, text + " more", "", T0, None, None, None),
            (3, text + " more", "", T0, None, None, None), (4, None, None, T0, 4, None, 0), (5, "short", "", None, 4, None, 0), (None, text, text, T0, 0, None, 0), (6, long, "", T0, 6, None, 0), (7, long + " end", "", None, 7, None, 0)]
    spark.createDataFrame(data, MEDLINE).write.parquet(f"{tmp_path}/medline.parquet")
    assert rows(near_duplicates.p4_found(spark, str(tmp_path))) == [(1, 2), (1, 3), (2, 3), (6, 7)]
    assert rows(near_duplicates.p4_groups(spark, str(tmp_path))) == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 1, 1), (6, 6, 6, 1), (7, 7, 6, 1)]
    spark.createDataFrame([], MEDLINE).write.parquet(f"{tmp_path}/none/medline.parquet")
    assert near_duplicates.p4_found(spark, f"{tmp_path}/none").count() == 0
    assert near_duplicates.p4_groups(spark, f"{tmp_path}/none").count() == 0


def test_groups_link_the_pairs_found(spark, tmp_path):
    """Records that share 30 of 40 terms (0.75) are a pair, so they are linked and in one group; those that share 27 of 40 are not."""
    words = [f"term{i}" for i in range(60)]
    data = [(1, " ".join(words[:40]), None, T0, 1, None, 0), (2, " ".join(words[:30]), None, T0, 2, None, 0), (3, " ".join(words[13:43]), None, T0, 3, None, 0)]
    spark.createDataFrame(data, MEDLINE).write.parquet(f"{tmp_path}/medline.parquet")
    assert rows(near_duplicates.p4_found(spark, str(tmp_path))) == [(1, 2)]
    assert rows(near_duplicates.p4_groups(spark, str(tmp_path))) == [(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 3, 0)]


def test_long_chains_connect(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (700, 501)]
    got = dict(rows(near_duplicates.connected(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 1 for i in range(1, 201)}, 500: 500, 501: 500, 700: 500}


def test_sketch_uses_every_bit(spark):
    """Sets over a vocabulary large enough to set the sketches' sign bits on one side only."""
    rng = random.Random(6)
    words = [f"term{i}" for i in range(4000)]
    sets = {}
    for i in range(0, 200, 2):
        sets[i] = set(rng.sample(words, 40))
        sets[i + 1] = set(sorted(sets[i])[: 40 - i % 9])
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, terms array<string>")
    want = {(a, b) for a, b in combinations(sets, 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in near_duplicates.similar_classes(df, 0.7).collect()} == want and len(want) >= 100


# 5


def test_top_per_group(spark):
    rng = random.Random(5)
    data = [(rng.choice(["t1", "t1", "t1", "t2", None]), rng.choice(["r", None]), rng.randrange(40), rng.choice([1.0, 2.0, 2.0, 3.5, float("nan"), None]), 7) for _ in range(3000)]
    data += [("one", "r", 1, 0.0, 1), ("none", "r", None, 1.0, 1), ("none", "r", 3, None, 1)]
    df = spark.createDataFrame(data, "topic string, run_name string, doc_id long, score double, position long").repartition(7)
    best = {}
    for t, r, d, s, _ in data:
        if d is not None and s is not None and s == s:
            best[t, r, d] = max(s, best.get((t, r, d), s))
    groups = defaultdict(list)
    for (t, r, d), s in best.items():
        groups[t, r].append((-s, d))
    want = [(t, r, d, -s, i + 1) for (t, r), items in groups.items() for i, (s, d) in enumerate(sorted(items)[:6])]
    assert rows(group_top.top_per_group(df, ["topic", "run_name"], "score", "doc_id", 6)) == sorted(want, key=repr)
    assert group_top.top_per_group(df.limit(0), ["topic"], "score", "doc_id", 6).count() == 0


def test_doc_ids_are_numbers(spark):
    df = spark.createDataFrame([("t", "r", x, 1.0) for x in ["7", "007", " 7 ", "x7", "", None]] + [(None, "r", "8", 1.0)], "topic string, run_name string, doc_id string, score double")
    assert rows(group_top.top_per_group(group_top.usable_results(df), ["topic"], "score", "doc_id", 5)) == [("t", 7, 1.0, 1)]


# 6


def test_log_entropy(spark):
    import math

    bags = {1: ["a", "a", "b"], 2: ["a", "c"], 3: ["a", "a", "a"], 4: []}
    df = spark.createDataFrame([(k, v, 1.0) for k, v in bags.items()] + [(5, None, 1.0)], "pmid long, terms array<string>, weight double")
    tf = {(k, t): n for k, v in bags.items() for t, n in Counter(v).items()}
    gf, df_ = Counter(), Counter()
    for (_, t), n in tf.items():
        gf[t] += n
        df_[t] += 1
    want = [(k, t, n, df_[t], round(math.log2(1 + n) * (1 + sum(m / gf[t] * math.log2(m / gf[t]) for (_, u), m in tf.items() if u == t) / math.log2(5)), 6)) for (k, t), n in tf.items()]
    assert rows(distinctive_terms.log_entropy(df).withColumn("weight", F.round("weight", 6))) == sorted(want, key=repr)
    assert distinctive_terms.log_entropy(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 6, 60])
def test_weights_find_the_distinctive_terms(spark, n):
    """In collections of fewer and of more records than the limit, with terms at both limits: the weight loses none, and counts decide."""
    rng = random.Random(10 + n)
    bags = {k: rng.choices(["a", "b", "c", *(f"r{i}" for i in range(30))], k=rng.randint(0, 40)) + ["edge"] * (4 if k < 8 else 0) + ["nine"] * (4 if k < 9 else 0) + ["few"] * 3 for k in range(n)}
    records = Counter(t for bag in bags.values() for t in set(bag))
    want = {(k, t) for k, bag in bags.items() for t, m in Counter(bag).items() if m >= 4 and records[t] <= 8}
    df = spark.createDataFrame([(k, bag, 0.0) for k, bag in bags.items()], "pmid long, terms array<string>, collection double")
    found = distinctive_terms.distinctive(df)
    assert {(r.pmid, r.term) for r in found.collect()} == want and all(r.weight > 0 for r in found.collect() if n > 8)
    assert distinctive_terms.distinctive(df.limit(0)).count() == 0


# 7


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "n") for i, t in texts], "doc_id long, text string, n_tokens string")


LIMITS = "pack_id int, capacity_tokens int"


@pytest.mark.parametrize("lanes", [10**6, 7])
def test_packing_holds_every_token_once(spark, lanes):
    rng = random.Random(7)
    texts = [(i, " ".join(["word"] * rng.randint(1, 70))) for i in range(300)] + [(300, None), (301, ""), (302, "long " * 500), (None, "alone here"), (303, "same"), (303, "same")]
    limits = spark.createDataFrame([(1, 32), (2, 100), (3, 1), (None, 5), (4, 0), (5, None)], LIMITS)
    df = documents(spark, texts)
    got = packing.packed(df, limits, lane_items=lanes).collect()
    tokenizer = token_sizes.encoding(token_sizes.TOKENIZER)
    sizes = Counter()
    for i, t in texts:
        sizes[i] += len(tokenizer.encode_ordinary(t or ""))
    for pack, capacity in ((1, 32), (2, 100), (3, 1)):
        mine = [r for r in got if r.pack_id == pack]
        held, by_doc = Counter(), Counter()
        for r in mine:
            by_doc[r.doc_id] += r.n_tokens
            if r.container_id is not None:
                held[r.container_id] += r.n_tokens
        assert by_doc == sizes and max(held.values()) <= capacity
        assert sorted(held) == list(range(len(held)))
        pieces = Counter(r.doc_id for r in mine)
        assert all(pieces[i] == max(1, -(-sizes[i] // capacity)) for i in sizes if i != 303)
        assert len(held) <= 11 / 9 * -(-sum(sizes.values()) // capacity) + 2 or capacity == 32
    assert {r.container_id for r in got if r.n_tokens == 0} == {None}
    assert packing.packed(df.limit(0), limits).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    for capacity in (7, 50, 200):
        counts = {s: rng.randint(0, 9) for s in range(1, capacity + 1)}
        plan = packing.best_fit_plan(counts, capacity)
        held, ranks = Counter(), Counter()
        for size, low, high, first, each, _ in plan:
            ranks[size] += high - low
            for r in range(low, high):
                held[first + (r - low) // each] += size
        assert +ranks == +Counter(counts) and max(held.values()) <= capacity
        bins: list[int] = []
        for size in sorted(counts, reverse=True):
            for _ in range(counts[size]):
                fits = [b for b in bins if b >= size]
                if fits:
                    bins.remove(min(fits))
                    bins.append(min(fits) - size)
                else:
                    bins.append(capacity - size)
        assert len(held) == len(bins)


# 8

MIX = "source string, target_share double, max_repeats int"


def test_mix_keeps_shares_and_repeats(spark):
    rng = random.Random(9)
    data = [(i, f"{i} " + "word " * rng.randint(1, 60), rng.choice([" Big", "big", "BIG ", "big", "mid", "tiny" if i % 9 == 0 else "big", None]), 1) for i in range(3000)]
    data += [(4000 + i, data[i][1], "mid", 1) for i in range(50)] + [(5000, None, "big", 1), (5001, "", "mid", 1), (None, "x", "mid", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, block long")
    targets = spark.createDataFrame([("big", 0.5, 1), (" MID", 0.3, 2), ("tiny", 0.2, 3), ("absent", 0.0, 1), (None, 0.1, 1)], MIX)
    picked = mixing.mixed(df, targets)
    per_text = Counter()
    text = {d[0]: d[1] for d in data}
    for r in picked.collect():
        per_text[text[r.doc_id], r.source] += 1
    most = {"big": 1, "mid": 2, "tiny": 3}
    assert all(n <= most[s] for (_, s), n in per_text.items())
    assert len({t for t, _ in per_text}) == len(per_text)
    report = {r.source: r for r in mixing.shares(picked, targets).collect()}
    assert all(abs(report[s].actual_share - w) < 0.03 for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)))
    assert report["absent"].tokens == 0
    assert mixing.mixed(df.limit(0), targets).count() == 0


@pytest.mark.parametrize("words, share, size", [(1000, 0.05, 40_000), (30, 0.5, 120)])
def test_mix_of_a_source_with_one_text(spark, words, share, size):
    """A source counts with its tokens, be its only text longer or shorter than a block: the mix has repeats x tokens / share of them."""
    data = [(0, "word " * words, "one")] + [(i, f"{i} " + "word " * (size // 400), "rest") for i in range(1, 500)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("one", share, 2), ("rest", 1 - share, 1)], MIX)
    picked = mixing.mixed(df, targets).collect()
    one = [r.n_tokens for r in picked if r.source == "one"]
    assert sorted(r.pass_no for r in picked if r.source == "one") == [1, 2]
    assert abs(sum(r.n_tokens for r in picked) - sum(one) / share) <= max(r.n_tokens for r in picked if r.source == "rest") / 2


def test_schedule_is_even_and_turns_count(spark):
    got = mixing.schedule(spark, 1000, [("a", 0.5), ("b", 0.3), ("c", 0.2)], stretch=64).orderBy("slot").collect()
    seen = Counter()
    for i, r in enumerate(got):
        assert r.turn == seen[r.source]
        seen[r.source] += 1
        assert abs(seen["a"] - 0.5 * (i + 1)) < 6
    assert abs(seen["c"] - 200) < 6


# 9


def test_subjects_by_sentences(spark):
    texts = [
        (1, "HEART\xa0failure was seen. Blood  pressure rose.\nThe query <b>parser</b> was quick."), (2, None), (3, ""), (4, "nothing here"), (5, "<p>Post-traumatic stress.</p><p>panic</p>"),
        (6, "Le dépistage colorectal; l'hypertension. " * 3000), (7, "heartfailure"), (None, "asthma"), (1, "HEART failure"),
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, subject string, words int")
    got = {(r.doc_id, r.subject): (r.sentences, r.dealing, r.share_sentences) for r in subject_areas.subject_matches(df.where("doc_id <> 1 OR length(text) > 20")).collect()}
    assert got[1, "cardiovascular"] == (3, 3, 2) and got[1, "software"] == (3, 3, 1)
    assert got[2, None] == got[3, None] == (0, 0, 0) and got[4, None] == (1, 0, 0) and got[7, None] == (1, 0, 0)
    assert got[5, "mental_health"] == (2, 2, 2) and got[6, "oncology"][2] == 3000
    assert subject_areas.subject_matches(df.limit(0)).count() == 0


def test_longest_of_overlapping_terms_counts(spark):
    df = spark.createDataFrame([(1, "inhaled corticosteroid, pulmonary fibrosis; cystic fibrosis quality-adjusted life year")], "doc_id long, text string")
    found = {t.term for r in subject_areas.subject_matches(df).collect() for t in r.terms}
    assert found == {"inhaled corticosteroid", "pulmonary fibrosis", "cystic fibrosis", "quality adjusted life year"}


def test_thresholds_follow_labels(spark):
    docs = spark.createDataFrame([(i, "asthma. hypertension. hypertension." if i % 2 else "asthma.") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, " Respiratory") for i in range(0, 40, 2)] + [(i, "cardiovascular") for i in range(1, 40, 2)] + [(None, "oncology"), (3, None)], "doc_id long, subject string")
    got = {(r.doc_id, r.subject) for r in subject_areas.assigned(docs, labels).collect()}
    assert got == {(i, "cardiovascular" if i % 2 else "respiratory") for i in range(40)}


def test_overlapping_hits_keep_the_longest():
    assert subject_areas.longest([(0, 5, "a b"), (0, 9, "a b c"), (2, 9, "b c"), (4, 12, "c d"), (20, 22, "x"), (20, 22, "x")]) == ["a b c", "c d", "x"]
    assert len(subject_areas.longest([(i, i + 2, "t") for i in range(100_000)])) == 100_000


def test_weight_rarity_and_length_make_the_score(spark, tmp_path):
    """A weight of half halves a term's part, a rarer term says more, and a longer text scores less."""
    import math

    terms = tmp_path / "terms.tsv"
    terms.write_text("# comment\na\ten\t1\tred; deep red\na\ten\t0.5\tblue\nb\tfr\t1\tblue; Green-Tea\n")
    texts = [(1, "red. blue blue."), (2, "deep red green tea"), (3, "green tea " + "word " * 98), (4, "nothing"), (5, None), (None, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    shares = subject_areas.weighted_subjects(subject_areas.document_matches(df, path=terms), path=terms)
    got = {(r.doc_id, r.subject): r.score for r in shares.collect()}
    rare = lambda n: math.log(1 + 6 / n)
    want = {(1, "a"): (rare(1) + 2 * 0.5 * rare(1)) * 100 / 3, (1, "b"): 2 * rare(1) * 100 / 3, (2, "a"): rare(1) * 25, (2, "b"): rare(2) * 25, (3, "b"): rare(2)}
    assert got == pytest.approx(want)


def test_found_subjects_are_a_third_of_the_sentences(spark, tmp_path):
    texts = [(1, "asthma. hypertension. hypertension. hypertension."), (2, "asthma. hypertension. hypertension."), (3, "asthma."), (4, None), (None, "asthma")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, labels in (("some", [(3, "respiratory"), (2, None), (None, "respiratory")]), ("none", [])):
        where = tmp_path / name
        where.mkdir()
        (where / "documents.parquet").symlink_to(tmp_path / "documents.parquet")
        spark.createDataFrame(labels, "doc_id long, subject string").write.parquet(f"{where}/subject_labels.parquet")
        found = [(1, "cardiovascular"), (2, "cardiovascular"), (2, "respiratory"), (3, "respiratory")]
        assert rows(subject_areas.p9_found(spark, str(where))) == found
        assert {(r.subject, r.documents) for r in subject_areas.p9_composition(spark, str(where)).collect()} == {("cardiovascular", 2), ("respiratory", 3), ("(none)", 1)}
