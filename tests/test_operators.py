"""Operators on small fixtures, with nulls, ties and repeated rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import classify, conflicts, governance, graph, retrieval, scoring, similarity
from tessera.sources import exports, imports
from tessera.streaming import ingest

NODES = "id long, text string, workspace string, category string, simhash long, access_count long, tags array<string>, confidence double, trust_score double, created_at timestamp_ntz, learned_at timestamp_ntz, updated_at timestamp_ntz, last_accessed_at timestamp_ntz, session_id string, source string, para string, status string, confirmed_by string"


def node(spark, *rows):
    """Nodes of (id, text, values)."""
    import datetime as dt

    base = {"workspace": "global", "category": "c", "simhash": 0, "access_count": 0, "tags": [], "confidence": 1.0, "status": "active", "learned_at": dt.datetime(2024, 1, 1)}
    names = [f.split()[0] for f in NODES.split(", ")]
    return spark.createDataFrame([tuple(({"id": i, "text": t} | base | v).get(n) for n in names) for i, t, v in rows], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(s, d, t, w, None) for s, d, t, w in rows], "src long, dst long, type string, weight double, source string")


def test_pagerank(spark):
    n = node(spark, (1, "a", {}), (2, "b", {}), (3, "c", {}))
    got = {r.id: r.pr for r in graph.pagerank(edges(spark, (3, 1, "related", 1.0), (3, 2, "related", 1.0)), n).collect()}
    assert got[3] == pytest.approx(0.48055, abs=1e-5) and got[1] == pytest.approx(0.259725, abs=1e-5) and got[1] == got[2]
    assert graph.pagerank(edges(spark, (1, 1, "related", 1.0)), node(spark, (1, "a", {}))).collect()[0].pr == 1.0


def test_diffusion(spark):
    e = edges(spark, (1, 2, "related", 0.8), (2, 3, "related", 0.5))
    got = {r.id: r.score for r in graph.diffuse(e, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {2: 0.8, 3: 0.28}


def test_edge_statistics(spark):
    n = node(spark, (1, "a", {}), (2, "b", {}), (3, "c", {}))
    e = edges(spark, (1, 2, "related", 1.0), (1, 2, "related", 1.0), (1, 1, None, None), (1, 9, "related", 1.0), (2, 1, "Related", 1.0), (1, None, "cause", 1.0))
    r = graph.statistics(e, n).first()
    assert (r.directed_edges, r.unique_edges, r.nodes_with_edges, r.orphan_nodes, r.invalid_edges, r.duplicate_edges) == (2, 1, 2, 1, 3, 1)
    assert graph.repaired(graph.repaired(e, n).withColumn("source", F.lit(None).cast("string")), n).count() == 2


def test_related_edges(spark):
    n = node(spark, (1, "aa bb cc", {"category": "x"}), (2, "bb cc dd", {"category": "y"}), (3, "aa bb cc", {"category": "y", "status": "merged"}))
    assert [(r.a, r.b, r.score) for r in graph.related_pairs(n).collect()] == [(1, 2, 0.5)]
    n = node(spark, (1, "aa bb cc", {}), (2, "bb cc dd", {}))
    assert graph.related_pairs(n).first().score == pytest.approx(0.68)


def test_best_pairs(spark):
    """Related pairs and each node's best ones against brute force: ties, known edges, short notes, more good pairs than are wanted."""
    import random

    rng = random.Random(1)
    rows = []
    for i in range(260):
        base = rng.choice(rows)[1].split() if rows and rng.random() < 0.6 else []
        words = [w if rng.random() < 0.8 else f"w{rng.randint(10, 99)}" for w in base] or [f"w{int(10 + rng.random() ** 3 * 90)}" for _ in range(rng.choice((1, 3, 8, 12, 14)))]
        rows.append((i, " ".join(words), {"category": rng.choice("xy")}))
    n = node(spark, *rows, (None, rows[0][1], {}))
    known = edges(spark, *[(rng.randrange(260), rng.randrange(260), "related", 1.0) for _ in range(400)], (1, None, None, None))
    linked = {(r.src, r.dst) for r in known.collect()}
    sets = [set(t.split()[:12]) for _, t, _ in rows]

    def score(a, b):
        shared = len(sets[a] & sets[b])
        return round(shared / len(sets[a] | sets[b]) + (0.18 if rows[a][2] == rows[b][2] else 0), 9) if shared else 0

    scores = {(a, b): score(a, b) for a in range(260) for b in range(260) if a != b}
    for least, k in ((0.46, 2), (0.25, 1), (0.1, 3)):
        got = {(r.a, r.b): r.score for r in graph.related_pairs(n, least).collect()}
        assert got == pytest.approx({p: s for p, s in scores.items() if p[0] < p[1] and s >= least})
        want = {}
        for a in range(260):
            best = sorted(((s, b) for (x, b), s in scores.items() if x == a and s >= least and (a, b) not in linked), reverse=True)[:k]
            want |= {(a, b): s for s, b in best}
        assert {(r.src, r.dst): r.score for r in graph.best_pairs(n, least, k, known).collect()} == pytest.approx(want)


def test_rescue_takes_the_best_pair_of_orphans_only(spark):
    n = node(spark, (1, "aa bb cc dd", {}), (2, "aa bb cc ee", {}), (3, "aa bb cc dd", {}), (4, "xx yy", {}))
    got = {(r.src, r.dst): r.weight for r in graph.rescue(n, edges(spark, (1, 4, None, None), (2, 4, None, None))).collect()}
    assert got == {(3, 1): 1.18, (1, 3): 1.18}


def test_best_pairs_are_met_on_one_side_at_a_time(spark, monkeypatch):
    """Pairs within categories and across them are two shuffles of the sets, never on disk together; the better side counts."""
    met, sides = graph.met_pairs, []

    def noted(*args, **named):
        sides.append(named.get("sides", (True, False)))
        return met(*args, **named)

    monkeypatch.setattr(graph, "met_pairs", noted)
    n = node(spark, (1, "aa bb cc dd", {"category": "x"}), (2, "aa bb cc ee", {"category": "x"}), (3, "aa bb cc dd", {"category": "y"}), (4, "aa bb ff gg", {"category": "y"}))
    got = {(r.src, r.dst): r.score for r in graph.best_pairs(n, 0.25, 1).collect()}
    assert got == {(1, 3): 1.0, (2, 1): 0.78, (3, 1): 1.0, (4, 3): pytest.approx(0.513333333)}
    assert {len(x) for x in sides} == {1} and {*sides} == {(True,), (False,)}


def test_weak_pairs_of_settled_nodes_are_not_met(spark):
    """Notes with a good pair each, all of which share half of their words: only the good pairs come out of the join."""
    common = " ".join(f"common{i}" for i in range(6))
    n = node(spark, *[(i, " ".join(f"own{i // 2}x{j}" for j in range(6)) + " " + common, {}) for i in range(300)])
    sets = graph.ranked_sets(n).withColumn("seeking", F.col("id") < 10)
    assert graph.met_pairs(sets, 0.6, 0.18, 12).count() == 10
    assert graph.linked(n, edges(spark), 0.25, 1).count() == 300


def test_causal_chain(spark):
    e = edges(spark, (1, 2, "cause", 1.0), (2, 3, "cause", 1.0), (3, 1, "cause", 1.0), (3, 4, "related", 1.0))
    got = {r.id: r.depth for r in graph.causal_chain(e, spark.createDataFrame([(1,)], "id long")).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_conflicts(spark):
    e = edges(spark, (1, 3, "cause", 1.0), (2, 3, "contradicts", 1.0))
    assert [(r.a, r.b) for r in conflicts.stated(e).collect()] == [(2, 3)]
    assert [(r.a, r.b) for r in conflicts.propagated(e).collect()] == [(1, 2)]
    n = node(spark, (1, "价 涨 x", {"simhash": 16}), (2, "价 跌 x", {"simhash": 17}), (3, "价 跌 x", {"simhash": 0}))
    assert [(r.a, r.b) for r in conflicts.lexical(n).collect()] == [(1, 2)]


def test_scores(spark):
    import datetime as dt

    as_of = "2024-02-01 00:00:00"
    at = dt.datetime(2024, 2, 1)
    n = node(
        spark,
        (1, "x", {"trust_score": 0.8, "access_count": 5, "last_accessed_at": at - dt.timedelta(days=3.5)}),
        (2, "x", {"access_count": 10, "last_accessed_at": at - dt.timedelta(days=30)}),
        (3, "x", {"status": None, "access_count": None, "learned_at": None}),
    )
    scores = {r.id: r.s for r in n.select("id", retrieval.context_score(as_of).alias("s")).collect()}
    assert scores[1] == pytest.approx(1.10) and scores[3] == pytest.approx(1.2)
    assert scoring.confidence_decay(n.filter("id = 2"), as_of).first().new == pytest.approx(0.65)
    t = node(spark, (1, "x", {"trust_score": 0.8, "access_count": 10}), (2, "x", {"trust_score": 0.8, "access_count": 20}))
    assert {r.id: r.new for r in scoring.trust_decay(t, as_of).collect()} == {1: 0.74, 2: 0.76}


def test_full_text(spark):
    n = node(spark, (1, "数据库配置说明", {"category": None}), (2, "hello world foo", {"category": None}), (3, "HELLO there", {"category": None}))
    ids = lambda p: sorted(r.id for r in retrieval.full_text(n, p).collect())
    assert ids("数据库") == [1] and ids("数据") == [] and ids("hello wo") == [2, 3] and ids("hello wor") == [2] and ids("foo hello") == [2]
    assert retrieval.bm25(n, "数据库").first().rank == pytest.approx(-0.6243, abs=1e-4)
    assert retrieval.visible(n, "").count() == 3
    assert retrieval.visible(n.limit(0), "hello").count() == 0


def test_set_join_is_exact(spark):
    import random

    random.seed(4)
    words = [f"w{i}" for i in range(60)]
    sets = [sorted(random.sample(words, random.randint(3, 20))) for _ in range(120)]
    sets += [sorted(set(s) - {s[0]}) for s in sets[:60]] + [sets[0]]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tk array<string>")
    reps, members = similarity.classes(df, "id", "tk")
    assert members.count() == len(sets) and members.filter("key = class_id").count() == reps.count()
    for t in (0.5, 0.8):
        got = {(r.a, r.b) for r in similarity.join(reps, reps, t, same=True).collect()}
        rows = [(r.class_id, set(r.tokens)) for r in reps.collect()]
        want = {(a, b) for a, x in rows for b, y in rows if a < b and len(x & y) / len(x | y) >= t}
        assert got == want and want


def test_learning(spark):
    n = node(spark, (1, "alpha beta gamma delta epsilon zeta", {}), (2, "alpha beta gamma delta epsilon zeta", {}), (3, "one two three", {}))
    new = spark.createDataFrame([("a", "alpha beta gamma delta epsilon zeta"), ("b", "alpha beta gamma delta epsilon eta"), ("c", "nothing alike"), ("d", " "), ("e", None)], "pending_id string, text string")
    got = {r.pending_id: (r.action, r.target_id) for r in governance.learn(n, new).collect()}
    assert got == {"a": ("merge", 1), "b": ("merge", 1), "c": ("insert", None)}
    exact = {r.pending_id: r.l2_id for r in governance.l2_matches(new.filter("trim(text) <> ''"), n, 0.5, exact=True).collect()}
    assert exact == {"a": 1, "b": 1}


def test_writes(spark):
    n = node(spark, (1, "a", {}), (2, "b", {}))
    e = edges(spark, (1, 2, "related", 1.0), (2, 1, "cause", 1.0))
    left, kept = governance.without_nodes(n, e, spark.createDataFrame([(2,)], "id long"))
    assert [r.id for r in left.collect()] == [1] and kept.count() == 0
    with pytest.raises(governance.ValidationError):
        governance.updated(n, F.col("id") == 1, id=3)
    assert governance.updated(n, F.col("id") == 1, category="z").filter("category = 'z'").count() == 1
    new = spark.createDataFrame([(1, 2, "related", 0.5), (1, 2, "refines", 0.5), (1, 9, "cause", 0.5)], "src long, dst long, type string, weight double")
    assert governance.with_edge(e, n, new).count() == 3
    numbered = governance.numbered(spark.range(100, 0, -1), "id", first=7)
    assert [(r.id, r.number) for r in numbered.orderBy("id").collect()] == [(i, i + 6) for i in range(1, 101)]


def test_classification(spark):
    n = node(spark, (1, "python 代码 bug", {"category": ""}), (2, "nothing", {"category": None, "source": "rss:1"}), (3, "see http://x", {"category": "rss_feed"}))
    got = {r.id: (r.category, r.para) for r in classify.reclassified(n).collect()}
    assert got == {1: ("项目与技术", "R"), 2: ("实时热点", "R"), 3: ("资源", "R")}
    rules = spark.createDataFrame([("技术", "api", "seed")], "category string, keyword string, source string")
    assert classify.with_rules(rules, "技术", "api, kafka，spark").count() == 3


def test_vault_round_trip(spark, tmp_path):
    n = node(spark, (1, "数据库配置说明与经验。其余", {"category": "技术"}), (2, "short", {}), (3, "archived but long enough", {"status": "archived"}))
    exports.write_pages(exports.vault_pages(n), str(tmp_path / "vault"))
    (tmp_path / "vault" / "templates").mkdir()
    (tmp_path / "vault" / "templates" / "x.md").write_text("a page that is left alone", encoding="utf-8")
    (tmp_path / "vault" / "04-踩坑库").mkdir()
    (tmp_path / "vault" / "04-踩坑库" / "new.md").write_text("一个新的踩坑记录，足够长", encoding="utf-8")
    pages = imports.vault(spark, str(tmp_path / "vault"))
    assert {(r.node_id, r.category) for r in pages.collect()} == {(1, "通用"), (None, "踩坑")}
    changed, fresh = imports.merged_vault(n.withColumn("text", F.when(F.col("id") == 1, "old").otherwise(F.col("text"))), pages)
    assert [r.id for r in changed.collect()] == [1] and [r.category for r in fresh.collect()] == ["踩坑"]


def test_legacy_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"nodes": [{"id": 1, "text": "x"}, {"id": 1, "text": "y"}, {"text": "no id"}, {"id": 2, "text": "z", "tags": ["q"]}]}', encoding="utf-8")
    rows = {r.id: r for r in imports.legacy_json(spark, str(tmp_path)).collect()}
    assert rows[1].workspace == "global" and rows[1].text == "x" and rows[2].tags == ["q"] and len(rows) == 2


def test_edge_json(spark):
    df = spark.createDataFrame([(1, '[{"target":1},{"target":"x"},"bad",{"target":2,"type":"cause"}]'), (2, "not json"), (3, None)], "id long, raw string")
    rows = imports.parsed_edges(df, "id", "raw").orderBy("pos").collect()
    assert [(r.target, r.type) for r in rows if r.ok] == [(1, "related"), (2, "cause")] and sum(not r.ok for r in rows) == 2


def test_streamed_ingest(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    spark.createDataFrame([("a", "alpha beta gamma delta"), ("b", "alpha beta gamma delta")], "pending_id string, text string").write.parquet(source)
    stream = lambda: spark.readStream.schema("pending_id string, text string").parquet(source)
    ingest.ingest(stream(), store, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("c", "alpha beta gamma delta"), ("d", "one two three four")], "pending_id string, text string").write.mode("append").parquet(source)
    ingest.ingest(stream(), store, str(tmp_path / "cp")).awaitTermination()
    got = [(r.id, r.text) for r in spark.read.parquet(store).orderBy("id").collect()]
    assert got == [(1, "alpha beta gamma delta"), (2, "one two three four")]


def test_rules_as_a_table(spark):
    n = node(spark, (1, "Python 代码 api", {}), (2, "集群 集群", {}), (3, "", {}), (4, None, {}), (5, "http://x", {}), (6, "猫 api", {"tags": ["会议"]}), (7, "教程", {"tags": ["会议"]}))
    rules = classify.with_rules(classify.seeded(spark), "技术", "集群，python, 集群 ")
    assert rules.count() == classify.seeded(spark).count() + 1
    got = {r.id: r.category for r in classify.classified(n, rules).collect()}
    assert got == {1: "技术", 2: "技术", 3: "_待分类_", 4: "_待分类_", 5: "资源", 6: "技术", 7: "会议"}  # three letters count two; ties go to the first name
    assert {r.category for r in classify.classified(n, rules.limit(0)).collect()} == {"_待分类_", "资源"}


def test_queue_edges_and_history(spark):
    e = edges(spark, (1, 2, "related", 1.0), (1, 2, "related", None), (1, None, None, 1.0), (1, 2, "cause", 1.0))
    gone = edges(spark, (1, 2, "related", 0.0), (1, None, None, 0.0), (9, 9, "cause", 0.0))
    assert [(r.src, r.dst, r.type) for r in governance.without_edges(e, gone).collect()] == [(1, 2, "cause")]
    assert governance.without_edges(e, gone.limit(0)).count() == 4
    new = spark.createDataFrame([("a", " text "), ("b", " "), ("c", None), ("d", "text")], "origin string, content string")
    rows = governance.queued(new).collect()
    assert [r.content for r in rows] == ["text", "text"] and len({r.id for r in rows}) == 2 and all(len(r.id) == 8 for r in rows)
    log = spark.createDataFrame([(i, 1, "Update", "o", "n", f"2024-01-{i:02d}") for i in range(1, 30)] + [(29, 1, "Update", "o", "n", "2024-01-29"), (40, None, "x", "", "", None)], "id long, node_id long, action string, old_text string, new_text string, timestamp string")
    assert [(r.nth, r.id) for r in governance.history(log, 3).orderBy("nth").collect()] == [(1, 29), (2, 28), (3, 27)]
    pending = spark.createDataFrame([("p", "x", "c", "", "", ""), ("q", " ", "c", "", "", ""), ("r", "y", "c", "", "", "")], "id string, content string, category string, source string, source_url string, content_hash string")
    done, waiting = governance.confirm_pending(pending, F.col("id") != "r")
    assert [r.id for r in done.collect()] == ["p"] and {r.id for r in waiting.collect()} == {"q", "r"}
    n = node(spark, (1, "abc", {}), (2, "abc", {"simhash": 7}), (3, "", {}), (None, "abc", {}))
    assert {(r.id, r.simhash) for r in governance.with_simhash(n).collect()} >= {(1, 6239244140557729650), (2, 7), (3, 0)} and governance.with_simhash(n).count() == 4


def test_neighbours_and_links(spark):
    e = edges(spark, (1, 2, "related", 0.5), (3, 1, "cause", 0.9), (1, 4, "related", 0.5), (1, 1, "related", 1.0))
    got = graph.neighbours(e, spark.createDataFrame([(1,), (8,)], "id long"), 2).collect()
    assert {(r.id, r.neighbour) for r in got} == {(1, 3), (1, 2)}
    n = node(spark, (1, "a b c d", {}), (2, "a b c x", {}), (3, "a b c d", {"category": "other"}), (4, None, {}), (5, "z", {}))
    new = spark.createDataFrame([("p", "a b c d", "global", "c"), ("q", "", "global", "c"), ("r", "a", None, None)], "pending_id string, text string, workspace string, category string")
    assert [(r.pending_id, r.node_id, r.weight) for r in graph.auto_links(n, new, "pending_id").orderBy("node_id").collect()] == [("p", 1, 1.0), ("p", 2, 0.6)]
    assert graph.auto_links(n.limit(0), new, "pending_id").count() == 0


def test_queries_in_blocks(spark):
    from tessera.runtime import against_all

    rows, queries = spark.range(20), spark.range(100, 113).toDF("q")
    for most in (4, 100):
        got = {(r.id, r.q) for r in against_all(rows, queries, most).collect()}
        assert len(got) == 20 * 13 and against_all(rows, queries, most).count() == 20 * 13
    assert against_all(rows, queries.limit(0), 4).count() == 0


def test_lsh_pairs(spark):
    """Pairs of classes against the exact join, with copies, rows without a key and long sets; no token table stays in the shared folder."""
    import os
    import random

    from tessera.runtime import shared_base

    rng = random.Random(2)
    texts = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.choice((20, 60, 700)))) for _ in range(40)]
    texts += [" ".join(w if rng.random() < 0.96 else "new" for w in [*t.split(), "end"]) for t in texts] + texts[:5]
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (500, None), (501, "")], "id long, text string")
    folder = shared_base(spark).removeprefix("file:").replace("//", "/")
    before = set(os.listdir(folder))
    got = {(r.a, r.b): r.similarity for r in similarity.lsh_pairs(df, "id", "text", 0.8).collect()}
    sets = [set(t.split()) for t in texts[:80]]
    want = {(i, j): len(x & y) / len(x | y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j}
    assert got == pytest.approx({p: s for p, s in want.items() if s >= 0.8}) and len(got) >= 30
    assert not [f for f in set(os.listdir(folder)) - before if "token-sets" in f or "classes" in f]
