import itertools
import random

from support import rows
from litsieve.operators import dedup_exact as dx
from litsieve.operators import dedup_near as dn
from litsieve.operators.fuzzy import edit_pairs
from litsieve.operators.setsim import jaccard_pairs, lsh_pairs
from litsieve.operators.survivors import greedy_removed


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _greedy(n, edges, order):
    adj = {i: set() for i in order}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    removed = set()
    for i in order:
        if i in removed:
            continue
        later = set(order[order.index(i) + 1:])
        removed |= adj[i] & later
    return removed


# ---- exact

def _exact_df(spark):
    data = [(1, " Same Title ", "x"), (2, "same title", "X"), (3, None, None), (4, None, None), (5, "other", "y"),
            (6, "", "")]
    return spark.createDataFrame(data, "paper_id long, Title string, DOI string")


def test_exact_case_and_blanks(spark):
    cfg = dx.ExactConfig(subset=("Title", "DOI"))
    assert [r[0] for r in rows(dx.exact_dedup(_exact_df(spark), cfg), "paper_id")] == [1, 3, 5]


def test_exact_keep_last_and_none(spark):
    last = dx.ExactConfig(subset=("Title", "DOI"), keep="last")
    assert [r[0] for r in rows(dx.exact_dedup(_exact_df(spark), last), "paper_id")] == [2, 5, 6]
    none = dx.ExactConfig(subset=("Title", "DOI"), keep="none")
    assert [r[0] for r in rows(dx.exact_dedup(_exact_df(spark), none), "paper_id")] == [5]


def test_exact_missing_rules(spark):
    eq = dx.ExactConfig(subset=("Title", "DOI"), missing="equal")
    assert [r[0] for r in rows(dx.exact_dedup(_exact_df(spark), eq), "paper_id")] == [1, 3, 5, 6]
    dist = dx.ExactConfig(subset=("Title", "DOI"), missing="distinct")
    assert [r[0] for r in rows(dx.exact_dedup(_exact_df(spark), dist), "paper_id")] == [1, 3, 4, 5, 6]
    cs = dx.ExactConfig(subset=("Title", "DOI"), case_sensitive=True)
    assert [r[0] for r in rows(dx.exact_dedup(_exact_df(spark), cs), "paper_id")] == [1, 2, 3, 5]


def test_flags_and_listing_agree(spark):
    cfg = dx.ExactConfig(subset=("Title", "DOI"))
    flags = dx.duplicate_flags(_exact_df(spark), cfg)
    dups = {r["paper_id"] for r in flags.collect() if r["is_duplicate"]}
    assert dups == {r[0] for r in rows(dx.duplicate_rows(_exact_df(spark), cfg), "paper_id")} == {2, 4, 6}
    audit = dx.dedup_audit(flags, "exact").first()
    assert (audit["original_count"], audit["remaining_count"], audit["removed_count"], audit["removed_pct"]) == (6, 3, 3, 50.0)


def test_hot_key_keep_first(spark):
    data = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(data, "paper_id long, Title string")
    out = dx.exact_dedup(df, dx.ExactConfig(subset=("Title",)))
    assert out.count() == 2001 and out.filter("Title = 'hot'").first()["paper_id"] == 0


# ---- survivors

def test_survivors_chain_is_not_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r[0] for r in greedy_removed(edges, "first").collect()} == {2}
    assert {r[0] for r in greedy_removed(edges, "last").collect()} == {2}
    assert {r[0] for r in greedy_removed(edges, "none").collect()} == {1, 2, 3}


def test_survivors_match_sequential_scan(spark):
    rnd = random.Random(7)
    for trial in range(4):
        n = 40
        edges = {(a, b) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.08}
        df = spark.createDataFrame(sorted(edges), "a long, b long")
        for keep in ("first", "last"):
            order = list(range(n)) if keep == "first" else list(range(n - 1, -1, -1))
            want = _greedy(n, edges, order)
            got = {r[0] for r in greedy_removed(df, keep).collect()}
            assert got == want, (trial, keep)


# ---- similarity joins

def test_jaccard_boundary_pair_reported(spark):
    base = [f"w{i}" for i in range(18)]
    a, b = base[:17] + ["xa"], base[:17] + ["xb"]  # |A∩B|=17, |A∪B|=19 -> 0.8947
    c = [f"w{i}" for i in range(17)] + ["q1", "q2", "q3"]   # vs a: 17/ (18+20-17)=0.8095
    items = spark.createDataFrame([(1, a), (2, b), (3, c)], "id long, words array<string>")
    got = rows(jaccard_pairs(items, 17 / 19), "id_a", "id_b")
    assert got == [(1, 2)]


def test_jaccard_prefix_join_equals_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(30)] + ["the"] * 10
    sets = {}
    for i in range(120):
        base = rnd.sample(vocab, rnd.randint(1, 12))
        sets[i] = sorted(set(base))
    for i in range(120, 160):  # near copies
        src = sets[i - 120]
        sets[i] = sorted(set(src + ([f"x{i}"] if rnd.random() < 0.5 else [])))
    items = spark.createDataFrame(list(sets.items()), "id long, words array<string>")
    for t in (0.5, 0.7, 0.85):
        want = sorted((a, b) for a, b in itertools.combinations(sorted(sets), 2)
                      if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= t - 1e-9)
        assert rows(jaccard_pairs(items, t), "id_a", "id_b") == want
        lsh = set(rows(lsh_pairs(items, t), "id_a", "id_b"))
        assert lsh <= set(want)


def test_edit_join_equals_brute_force(spark):
    rnd = random.Random(11)
    alpha = "abcde "
    keys = {}
    for i in range(150):
        if i >= 100 and rnd.random() < 0.8:
            s = list(keys[i - 100])
            for _ in range(rnd.randint(0, 3)):
                s[rnd.randrange(len(s))] = rnd.choice(alpha)
            keys[i] = "".join(s)
        else:
            keys[i] = "".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 25)))
    items = spark.createDataFrame(list(keys.items()), "id long, key string")
    for t in (70, 85, 90, 95):
        want = []
        for a, b in itertools.combinations(sorted(keys), 2):
            lm = max(len(keys[a]), len(keys[b]))
            if lm and 100 * (1 - _lev(keys[a], keys[b]) / lm) >= t - 1e-9:
                want.append((a, b))
        assert rows(edit_pairs(items, t), "id_a", "id_b") == sorted(want), t


def test_combined_keeps_near_duplicate_failing_fuzzy(spark):
    df = spark.createDataFrame([
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "10.1/aaaa"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "99.9/zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz"),
        (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "10.1/aaab"),
    ], "paper_id long, Title string, DOI string")
    out = dn.combined_dedup(df, dn.CombinedConfig(columns=("Title", "DOI")))
    assert [r[0] for r in rows(out, "paper_id")] == [1, 2]


def test_near_dedup_keep_options(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "a b c d e f g h i k"),
                                (4, "totally different words here")], "paper_id long, Title string")
    cfg = dn.NearConfig(text_cols=("Title",), threshold=0.8)
    assert [r[0] for r in rows(dn.near_dedup(df, cfg), "paper_id")] == [1, 4]
    last = dn.NearConfig(text_cols=("Title",), threshold=0.8, keep="last")
    assert [r[0] for r in rows(dn.near_dedup(df, last), "paper_id")] == [3, 4]
    none = dn.NearConfig(text_cols=("Title",), threshold=0.8, keep="none")
    assert [r[0] for r in rows(dn.near_dedup(df, none), "paper_id")] == [4]


def test_fuzzy_dedup_partition_independent(spark):
    from litsieve.plans.catalog import papers
    p = papers(spark, "/root/testdata/sf0.001")
    base = None
    for n in (1, 4, 17):
        out = rows(dn.fuzzy_dedup(p.repartition(n), dn.FuzzyConfig(columns=("Title",), threshold=90)), "paper_id")
        base = base or out
        assert out == base


def test_seeded_near_dedup_equals_brute_force(spark):
    rnd = random.Random(21)
    vocab = [f"v{i}" for i in range(25)]
    texts = {}
    base = rnd.sample(vocab, 12)
    for i in range(60):  # a dense near-copy cluster plus noise, in shuffled id order
        if rnd.random() < 0.6:
            words = set(base)
            if rnd.random() < 0.7:
                words.discard(rnd.choice(base))
            if rnd.random() < 0.5:
                words.add(rnd.choice(vocab))
        else:
            words = set(rnd.sample(vocab, rnd.randint(1, 10)))
        texts[i] = " ".join(sorted(words))
    df = spark.createDataFrame(list(texts.items()), "paper_id long, Title string")
    for t in (0.6, 0.8):
        for keep in ("first", "last"):
            sets = {i: set(v.split()) for i, v in texts.items()}
            ids = sorted(sets)
            edges = {(a, b) for a, b in itertools.combinations(ids, 2)
                     if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-9}
            order = ids if keep == "first" else ids[::-1]
            # identical texts collapse to their first (or last) row, which the greedy also does
            want = set(ids) - _greedy(len(ids), edges, order)
            got = {r[0] for r in dn.near_dedup(df, dn.NearConfig(text_cols=("Title",), threshold=t, keep=keep))
                   .select("paper_id").collect()}
            assert got == want, (t, keep)


def test_seeded_path_on_hot_lists_equals_plain(spark):
    from litsieve.operators import survivors as sv
    from litsieve.operators.setsim import jaccard_candidates, jaccard_prefix, jaccard_sets, verify_jaccard
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(20)]
    base = rnd.sample(vocab, 10)
    rows_ = []
    for i in range(80):
        words = set(base) if rnd.random() < 0.7 else set(rnd.sample(vocab, rnd.randint(2, 10)))
        if rnd.random() < 0.5:
            words.discard(rnd.choice(sorted(words)))
        rows_.append((i, sorted(words)))
    items = spark.createDataFrame(rows_, "id long, words array<string>")
    sets = jaccard_sets(items)
    prefix = jaccard_prefix(sets, 0.7)

    def cands(pa, pb):
        return jaccard_candidates(pa, pb, 0.7)

    def verify(c):
        return verify_jaccard(c, sets, 0.7)
    plain = {r[0] for r in sv.seeded_removed(prefix, ["w"], cands, verify, hot_list=10 ** 9).collect()}
    seeded = {r[0] for r in sv.seeded_removed(prefix, ["w"], cands, verify, hot_list=2).collect()}
    assert plain == seeded and plain


def test_seeded_path_through_dedup_entry_points(spark, monkeypatch):
    """Force the seeded path (every posting list counts as hot) for near, fuzzy and combined
    de-dup with keep first and last, and compare with the plain path."""
    from litsieve.operators import survivors as sv
    from litsieve.plans.catalog import papers
    p = papers(spark, "/root/testdata/sf0.001")
    cases = [
        lambda keep: dn.near_dedup(p, dn.NearConfig(text_cols=("Title", "Abstract"), threshold=0.6, keep=keep)),
        lambda keep: dn.fuzzy_dedup(p, dn.FuzzyConfig(columns=("Title",), threshold=85, keep=keep)),
        lambda keep: dn.combined_dedup(p, dn.CombinedConfig(columns=("Title", "DOI"), keep=keep)),
    ]
    for run in cases:
        for keep in ("first", "last"):
            monkeypatch.setattr(sv, "HOT_LIST", 10 ** 9)
            plain = rows(run(keep), "paper_id")
            monkeypatch.setattr(sv, "HOT_LIST", 1)
            seeded = rows(run(keep), "paper_id")
            assert plain == seeded, keep


def test_composite_by_words_equals_the_expression(spark):
    from litsieve.functions.edits import Words, composite_of
    from litsieve.functions.similarity import composite_score
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    pairs = [("a b", "a b"), ("a", "b"), ("ab  cd\te", "e cd ab"), ("x", "x y z"), ("aé", "aè")]
    for _ in range(300):
        a = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(b))
            b[i:i + 1] = rng.choice([[], [b[i] + "x"], [b[i], rng.choice(vocabulary)], [rng.choice(vocabulary)], ["".join(b[i:i + 2])]]) or ["q"]
        if rng.random() < 0.4:
            rng.shuffle(b)
        pairs.append((" ".join(a), rng.choice([" ", "  ", "\n"]).join(b)))
    for t in (70, 90):
        # no score under the threshold is asked for: some part of it may stay above its own bound
        want = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(composite_score("a", "b", t)).collect()]
        assert [composite_of(Words.of(a), Words.of(b), t) for a, b in pairs] == want, t
        assert any(w is None for w in want) and any(w is not None and w < 95 for w in want)


def test_composite_pairs_of_one_title_are_spread(spark):
    rows_ = [(i, "same title of all", f"{'word ' * 5}{i} text", None) for i in range(40)]
    papers = spark.createDataFrame(rows_, "paper_id long, Title string, Abstract string, DOI string")
    _, pairs = dn.combined_pairs(papers, dn.CombinedConfig(scorer="composite"))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "RepartitionByExpression [id_a" in plan
    assert pairs.count() == 40 * 39 // 2


def test_representatives_of_repeated_and_null_ids(spark):
    from litsieve.operators import dedup_near as dn
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b a"), (3, "c"), (4, None), (None, "d"), (5, "e"), (5, "f"), (None, "c")], "paper_id long, Title string")
    reps = dn.near_items(df, dn.NearConfig(text_cols=("Title",)))
    got = sorted((r["id"], r["group_size"], r["matchable"]) for r in reps.collect())
    assert got == [(1, 3, True), (1, 3, True), (3, 2, True), (4, 1, False)] + [(5, 1, True)] * 4


def test_payload_of_rows_alone_is_not_shuffled(spark):
    from litsieve.operators import bins
    rows_ = [(i, f"k{i // 2}" if i < 20 else f"k{i}") for i in range(400)]
    df = spark.createDataFrame(rows_, "id long, key string")
    among = bins.among_bins(bins.repeated_bins(df, "key"))
    shared = [r["id"] for r in df.filter(among("key")).collect()]
    assert {*range(20)} <= {*shared} and len(shared) < 60


def test_token_set_by_words_equals_the_expression(spark):
    from litsieve.functions.edits import Words, composite_may, composite_of, token_set_may, token_set_of
    from litsieve.functions.similarity import token_set_ratio
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    pairs = [("a b", "a b"), ("a", "b"), ("x", "x y z"), ("aé", "aè"), ("", "a"), ("a b c d e f g h i j k", "a b c d e f g h i j")]
    for _ in range(300):
        a = [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        b = [w + rng.choice(["", "", "", "", "x"]) for w in a if rng.random() < 0.95] + rng.sample(vocabulary, rng.choice([0, 0, 1, 2]))
        pairs.append((" ".join(a), rng.choice([" ", "  ", "\n"]).join(b)))
    for t in (70, 90):
        scores = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(token_set_ratio("a", "b", t)).collect()]
        words = [(Words.of(a), Words.of(b)) for a, b in pairs]
        got = [token_set_of(a, b, t) for a, b in words]
        assert [w is None for w in scores] == [g is None for g in got]
        assert all(w is None or abs(w - g) < 1e-9 for w, g in zip(scores, got)), t
        assert all(token_set_may(a, b, t) for (a, b), g in zip(words, got) if g is not None)
        assert all(composite_may(a, b, t) for a, b in words if composite_of(a, b, t) is not None)
        assert not all(token_set_may(a, b, t) for a, b in words)


def test_papers_of_one_title_are_sent_once_a_group(spark):
    """Many papers of one title and different texts: their pairs go by group, none reaches the join that sends a key a pair."""
    rng = random.Random(7)
    rows_ = [(i, "same title of all", " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)), None) for i in range(40)]
    rows_.append((90, "same title of all", rows_[0][2] + " more", None))
    papers = spark.createDataFrame(rows_, "paper_id long, Title string, Abstract string, DOI string")
    for scorer in ("token_set", "composite"):
        _, pairs = dn.combined_pairs(papers, dn.CombinedConfig(scorer=scorer))
        assert [(r["id_a"], r["id_b"]) for r in pairs.collect()] == [(0, 90)]
        assert "levenshtein" not in pairs._jdf.queryExecution().optimizedPlan().toString()
