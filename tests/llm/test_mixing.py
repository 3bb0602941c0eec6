from pyspark.sql import functions as F

from tideline.llm import mixing
from tideline.llm.mixing import budgets, mix, mix_check, order_hash
from tideline.llm.tokens import encoding

D = "doc_id bigint, text string, lang string, source string"
T = "source string, target_share double, max_repeats int"


def shared(spark, leaves, total):
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, weight double, capacity double")
    return {(r.domain, r.lang, r.source): round(r.budget, 6) for r in budgets(df, F.lit(total)).collect()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    tree = lambda cap: [("a", "en", "s1", 1.0, 10.0), ("a", "en", "s2", 1.0, cap), ("b", "en", "s3", 2.0, 1000.0)]
    assert list(shared(spark, tree(1000.0), 200).values()) and shared(spark, tree(1000.0), 200) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 90, ("b", "en", "s3"): 100}
    assert shared(spark, tree(20.0), 200) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 20, ("b", "en", "s3"): 170}
    assert shared(spark, tree(20.0), 10_000) == {("a", "en", "s1"): 10, ("a", "en", "s2"): 20, ("b", "en", "s3"): 1000}
    # in one language of a domain first, then in its others, then in other domains
    deep = [("a", "en", "s1", 1.0, 5.0), ("a", "en", "s2", 1.0, 30.0), ("a", "de", "s1", 2.0, 45.0), ("b", "en", "s3", 4.0, 1e9)]
    assert shared(spark, deep, 160) == {("a", "en", "s1"): 5, ("a", "en", "s2"): 30, ("a", "de", "s1"): 45, ("b", "en", "s3"): 80}
    assert shared(spark, deep, 240) == {("a", "en", "s1"): 5, ("a", "en", "s2"): 30, ("a", "de", "s1"): 45, ("b", "en", "s3"): 160}
    assert shared(spark, [("a", "en", "s", 0.0, 5.0)], 10) == {} and shared(spark, deep, 0) == dict.fromkeys(shared(spark, deep, 1), 0)


def run(spark, docs, targets, **how):
    df = spark.createDataFrame(docs, D).selectExpr("*", "1 AS h", "2 AS tokens", "3 AS epoch", "'z' AS cut", "4 AS n")
    draws, shares = mix(df, spark.createDataFrame(targets, T), **how)
    return [r.asDict() for r in draws.collect()], {r.source: r for r in shares.collect()}


def corpus():
    docs = [(i, f"word{i} " * 50, "en" if i % 3 else "de", " Big " if i % 2 else "BIG") for i in range(400)]
    return docs + [(1000 + i, f"tiny{i} " * 40, None, "small") for i in range(10)]


def test_shares_and_repeats(spark):
    draws, shares = run(spark, corpus(), [("big", 0.5, 1), ("small", 0.5, 3), ("absent", 0.1, 5)], total_tokens=20_000)
    tokens = {d[0]: len(encoding().encode_ordinary(d[1])) for d in corpus()}
    small = sum(n for d, n in tokens.items() if d >= 1000)
    assert shares["small"].drawn_tokens == 3 * small and shares["small"].most_uses == 3
    assert abs(shares["big"].drawn_tokens - (20_000 - 3 * small)) < 2 * max(tokens.values()) and shares["big"].most_uses == 1
    assert shares["absent"].drawn_tokens == 0 and shares["absent"].budget_tokens == 0 and abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-4
    assert len({(r["doc_id"], r["epoch"]) for r in draws}) == len(draws) and all(r["tokens"] == tokens[r["doc_id"]] for r in draws)
    assert sum(r["tokens"] for r in draws if r["source"] == "big") == shares["big"].drawn_tokens


def test_seed(spark):
    t = [("big", 1.0, 2)]
    a, b, c = (run(spark, corpus(), t, total_tokens=5000, seed=s)[0] for s in (1, 1, 2))
    key = lambda rows: sorted((r["doc_id"], r["epoch"]) for r in rows)
    assert key(a) == key(b) != key(c)


def test_the_last_epoch_is_a_prefix(spark, monkeypatch):
    """Against brute force: in the order of the hash, up to the document in which the budget ends, with or without it, whichever is nearer."""
    tokens = {d[0]: len(encoding().encode_ordinary(d[1])) for d in corpus()}
    for bits, total in ((12, 9000), (2, 31_000)):
        monkeypatch.setattr(mixing, "CUT_BITS", bits)
        draws, shares = run(spark, corpus(), [("big", 1.0, 2)], total_tokens=total)
        for lang in ("en", "de"):
            own = [d[0] for d in corpus() if d[2] == lang and d[0] < 1000]
            have = sum(tokens[i] for i in own)
            budget = min(total * have / sum(n for d, n in tokens.items() if d < 1000), 2 * have)
            whole = min(2, int(budget / have + 1e-12))
            rest, want = budget - whole * have, set()
            h = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in own], "doc_id bigint").withColumn("h", order_hash(17, F.lit(whole), F.col("doc_id"))).collect()}
            for i in sorted(own, key=lambda i: (h[i], i)):
                if tokens[i] / 2 >= rest:
                    break
                want.add(i)
                rest -= tokens[i]
            got = [r for r in draws if r["lang"] == lang]
            assert {r["doc_id"] for r in got if r["epoch"] == whole} == want
            assert all({r["doc_id"] for r in got if r["epoch"] == e} == set(own) for e in range(whole))


def test_untargeted_sources_cost_nothing(spark):
    docs = corpus() + [(10_000 + i, "x y z", "en", f"host{i}") for i in range(6000)]
    draws, shares = run(spark, docs, [("big", 0.5, 1), ("small", 0.5, 3)], total_tokens=4000)
    assert len(shares) == 6002 and {r["source"] for r in draws} == {"big", "small"} and all(shares[f"host{i}"].drawn_tokens == 0 for i in range(6000))


def test_many_leaves_and_domains(spark):
    docs = [(i, f"text {i}", f"l{i % 7}", f"s{i % 900}") for i in range(6300)]
    targets = [(f"s{i}", 1 / 900, 1) for i in range(900)]
    df, t = spark.createDataFrame(docs, D), spark.createDataFrame(targets, T)
    domains = spark.createDataFrame([(f"S{i} ", f"d{i % 3}") for i in range(800)] + [(None, "x")], "source string, domain string")
    draws, shares = mix(df, t, total_tokens=10_000, domains=domains)
    got = {r.source: r for r in shares.collect()}
    # one document a leaf: each is drawn or not, so that half of each may be missing or too much
    assert abs(sum(r.drawn_tokens for r in got.values()) - 10_000) <= sum(len(encoding().encode_ordinary(d[1])) for d in docs) / 2 and abs(sum(r.budget_tokens for r in got.values()) - 10_000) < 1
    assert draws.groupBy("doc_id").count().where("count > 1").isEmpty()
    assert mix_check(draws, shares).where("NOT (repeats_kept AND in_order AND budget_met)").isEmpty()


def test_language_weights_and_absent_sources(spark):
    draws, shares = run(spark, corpus(), [("big", 1.0, 1)], total_tokens=4000, language_weights={"de": 3, "en": 1})
    per = {la: sum(r["tokens"] for r in draws if r["lang"] == la) for la in ("de", "en")}
    assert abs(per["de"] - 3000) < 200 and abs(per["en"] - 1000) < 200
    # the share of a source without documents goes to its own domain first
    domains = spark.createDataFrame([("small", "x"), ("absent", "x"), ("big", "y")], "source string, domain string")
    shares = run(spark, corpus(), [("big", 0.5, 2), ("small", 0.25, 9), ("absent", 0.25, 1)], total_tokens=4000, domains=domains)[1]
    assert shares["small"].budget_tokens == 2000 and shares["big"].budget_tokens == 2000 and shares["absent"].budget_tokens == 0


def test_dirty(spark):
    docs = [(1, "a b c", "en", None), (2, "a b c", "en", " "), (3, None, "en", "s"), (4, "", " EN", "S "), (5, "x y z", None, "s"), (5, "x y z", None, "s"), (None, "q", "en", "s"), (6, "w " * 30_000, "en", "t")]
    draws, shares = run(spark, docs, [("s", 0.5, None), ("S", 0.2, 2), ("t", None, 1), (None, 0.3, 1), ("u", -1.0, 1)], total_tokens=1_000_000)
    assert sorted(r["doc_id"] for r in draws) == [5] and shares["s"].most_uses == 1 and shares["t"].drawn_tokens == 0
    draws, shares = run(spark, [], [("s", 1.0, 1)])
    assert draws == [] and shares["s"].drawn_tokens == 0
    draws, shares = run(spark, docs, [])
    assert draws == [] and shares["s"].actual_share == 0
