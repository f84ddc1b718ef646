"""Problems 1, 4 and 5 against brute force, with the cases that real tables have."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import history, ledger, neardup, segments
from tessera.llm.canonical import canonical_text
from tessera.llm.tokens import token_set, tokenize

WORDS = [f"{a}{b}" for a in ("load", "cache", "index", "query", "batch", "shard", "token", "graph") for b in ("er", "ing", "ed", "s", "map", "set", "key", "log")]


def notes(n: int, seed: int) -> list[str]:
    """Random texts, near copies, copies in another format, and odd ones."""
    rng = random.Random(seed)
    out: list[str] = []
    while len(out) < n:
        base = [rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 40))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(rng.choice([" ", ", ", "\n"]).join(copy))
        if rng.random() < 0.3:
            out.append(" ".join(base).upper() + "!")
        if rng.random() < 0.2:
            rng.shuffle(base)
            out.append(" ".join(base))
    return out[:n]


def similar(a: set, b: set) -> bool:
    return bool(a | b) and 5 * len(a & b) >= 4 * len(a | b)


def keys(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: r.c for r in df.select("id", canonical_text(F.col("text")).alias("c")).collect()}


def test_tokenize():
    assert tokenize("Hello 数据库abc 配置,说明") == ["hello", "数据库abc", "配", "置", "明"]
    assert token_set(None) == token_set("") == set()


RECORD = [("item", "Load Balancer"), ("due", "2024-01-02"), ("note", "a: b"), ("site", "x-1")]
FORMS = [
    "\n".join(f"{k}: {v}" for k, v in RECORD),
    "\n".join(f"| {k} | {v} |" for k, v in reversed(RECORD)),
    "; ".join(f"{k}={v}" for k, v in RECORD).upper(),
    "---\n" + "\n".join(f'{k} : "{v}"' for k, v in RECORD) + "\n---",
    "{" + ", ".join(f'"{k}": "{v}"' for k, v in RECORD) + "}",
]


def test_canonical_forms(spark):
    swapped = "\n".join(f"{k}: {v}" for k, v in zip([k for k, _ in RECORD], [v for _, v in RECORD[1:] + RECORD[:1]]))
    texts = [*FORMS, swapped, "Straße, 5", "STRASSE 5", "strasse 6", "...", "!!!", "", None]
    got = keys(spark, texts)
    assert len({got[i] for i in range(5)}) == 1 and got[5] != got[0]
    assert got[6] == got[7] != got[8]
    assert got[9] != got[10] and got[12] is None


def test_json_is_keyed_whole(spark):
    """Text between, beside or inside the pairs is never left out of the key."""
    body = '"item": "Load Balancer", "due": "2024-01-02", "note": "a: b", "site": "x-1"'
    other = [
        f"{{roughly {body}}}", f"{{{body}, and more}}", f"{{{body} late}}", f"{{{body}}} {{}} tail}}",
        f'{{{body}, "tags": ["p", "q"]}}', f'{{{body}, "tags": ["p", "r"]}}', f'{{{body}, "tags": [["p"], "q"]}}',
        f'{{{body}, "sub": {{"k": 1, "l": 2}}}}', f'{{{body}, "sub": {{"k": 1, "l": 3}}}}', f'{{{body}, "k": 1, "l": 2}}', f'{{{body}, "sub": {{"k": {{"l": 2}}}}}}',
        f'{{{body}, "said": "so \\"one\\" and two"}}', f'{{{body}, "said": "so \\"one\\" and three"}}',
    ]
    same = [
        ("{" + body.replace('", ', '" ') + ",}", FORMS[0]),  # signs alone never tell copies apart
        (f'{{{body}, "tags": ["p", "q"]}}', f'{{"tags": ["p","q"], {body}}}'),
        (f'{{{body}, "said": "so \\"one\\"\\nand two"}}', "said: so 'one' and two\n" + FORMS[0]),
        (f'{{{body}, "said": "{"x" * 50_000} {chr(92)}{chr(34)}"}}', f'{{"said": "{"x" * 50_000}", {body}}}'),
    ]
    got = keys(spark, ["{" + body + "}", FORMS[0], *other, *[t for pair in same for t in pair]])
    assert got[0] == got[1] and len({got[i] for i in range(1, 2 + len(other))}) == 1 + len(other)
    n = 2 + len(other)
    assert all(got[n + 2 * i] == got[n + 2 * i + 1] and got[n + 2 * i].startswith("R") for i in range(len(same)))


def test_ledger(spark):
    texts = [*FORMS, "one two", "One, two!", "three", None, "", "one two"]
    rows = [(i + 1, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, k1 string")  # a clashing extra column
    keyed = ledger.keys(df)
    book = ledger.Ledger(spark, bucket_rows=1)
    for part in (keyed.filter("id > 5"), keyed.filter("id <= 5"), keyed.limit(0)):
        book.update(part)
    found = {(r.node_id, r.copy_id) for r in ledger.copies(keyed, book).collect()}
    assert found == {(1, i) for i in range(2, 6)} | {(6, 7), (6, 11)}
    counts = {r.first_id: r.n for r in book.read().collect()}
    assert counts == {1: 5, 6: 3, 8: 1, 10: 1}
    again = ledger.Ledger(spark, book.path)
    assert {r.first_id: r.n for r in again.read().collect()} == counts
    assert ledger.copies(keyed.limit(0), ledger.Ledger(spark)).count() == 0


def test_ledger_batches(spark, monkeypatch):
    """Many small batches: deltas, merges and splits; a batch delivered twice; a batch lost before its commit."""
    rng = random.Random(4)
    rows = [(i, rng.randint(1, 12), 7) for i in range(60)]
    rng.shuffle(rows)
    keyed = spark.createDataFrame(rows, "id long, k1 long, k2 long")
    book = ledger.Ledger(spark, bucket_rows=5)
    want: dict = {}
    for n in range(3):
        part = rows[n * 20 : n * 20 + 20]
        df = spark.createDataFrame(part, "id long, k1 long, k2 long")
        with monkeypatch.context() as m:
            m.setattr(ledger.Manifest, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                book.update(df, f"b{n}")
        assert {r.k1: (r.n, r.first_id) for r in book.read().collect()} == want
        book.update(df, f"b{n}")
        book.update(df, f"b{n}")
        for i, k, _ in part:
            c, first = want.get(k, (0, i))
            want[k] = (c + 1, min(first, i))
        assert {r.k1: (r.n, r.first_id) for r in ledger.Ledger(spark, book.path).read().collect()} == want
    assert len({r.node_id for r in ledger.copies(keyed, book).collect()}) == sum(c > 1 for c, _ in want.values())
    other = ledger.Ledger(spark, book.path)
    number, state = other.manifest.read()
    other.manifest.commit(number, state)
    with pytest.raises(RuntimeError):
        book.manifest.commit(number, state)  # another writer was first


def test_hot_group(spark):
    df = spark.range(1, 3001).select("id", F.when(F.col("id") % 3 == 0, "The same note.").otherwise(F.concat(F.lit("note "), F.col("id"))).alias("text"))
    keyed = ledger.keys(df)
    book = ledger.Ledger(spark)
    book.update(keyed)
    got = ledger.copies(keyed, book)
    assert got.count() == 999 and got.select("node_id").distinct().collect()[0].node_id == 3
    assert neardup.near_duplicates(df.filter("id % 3 = 0").unionByName(spark.createDataFrame([(9000, "same note")], "id long, text string"))).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = [*notes(220, seed), "", None, "的", "的了", *FORMS[:2]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, s string")
    key, sets = keys(spark, texts), [token_set(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if similar(sets[a], sets[b]) and key[a] != key[b]}
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len({(r.id_a, r.id_b) for r in got}) and {(r.id_a, r.id_b) for r in got} == want and want
    assert neardup.near_duplicates(df.union(df)).count() == len(want)  # repeated rows
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicate_groups(spark):
    texts = notes(150, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    key, sets = keys(spark, texts), [token_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if similar(sets[a], sets[b]) or key[a] == key[b]:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.id: r.group_id for r in neardup.groups(df).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_two_worth_segments_lose_no_pair():
    """With neighbourhoods in every band, similar sets still share a key."""
    import numpy as np

    rng = random.Random(3)
    t = segments.Threshold()
    cut = np.array(segments.edges())
    u = np.array([int(t.differing(2 * (b - 1))) for b in cut[1:]])
    bands = segments.Bands(cut[:-1], cut[1:], u + 1 + (u + 1) % 2 - (u // 2 + 1), u // 2 + 1, np.ones(segments.SLOTS), t, True)
    sets = []
    for _ in range(150):
        base = rng.sample(range(5000), rng.randint(1, 60))
        sets += [base, [x for x in base if rng.random() > 0.08] or base, base[1:] + [9999]]
    flat = np.array([x * 2654435761 % (1 << 32) for s in sets for x in s], dtype=np.uint32)
    n = np.array([len(s) for s in sets])
    rec, key, _, _ = segments.emit(bands, flat, np.cumsum(n), n)
    of = [set() for _ in sets]
    for r, k in zip(rec.tolist(), key.tolist()):
        of[r].add(k)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if similar(set(sets[a]), set(sets[b]))]
    assert len(pairs) > 150 and all(of[a] & of[b] for a, b in pairs)


def test_history(spark):
    old, new = notes(200, 7), notes(80, 8)
    new += old[::9] + [t.upper() for t in old[3::17]] + ["", "  ", None, "fresh one", *FORMS[1:2]]
    old += FORMS[:1]
    nodes = spark.createDataFrame(list(enumerate(old)), "id long, text string")
    batch = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(new)], "batch_id string, text string")
    index = history.History.build(nodes)
    key = keys(spark, old + new)
    sets = [token_set(t) for t in old]

    def best(i, t):
        if not (t or "").strip():
            return None
        s, k = token_set(t), key[len(old) + i]
        return min((j for j in range(len(old)) if similar(s, sets[j]) or k == key[j]), default=None)

    want = {f"p{i}": best(i, t) for i, t in enumerate(new)}
    want = {k: v for k, v in want.items() if v is not None}
    assert {r.batch_id: r.node_id for r in index.match(batch).collect()} == want and want
    # A second batch meets what the first one added; the index is opened anew from its files.
    rows = history.accept(history.History.open(spark, index.path), batch, 1000).collect()
    added = {r.new_id: r.batch_id for r in rows if r.new_id is not None}
    assert sorted(added) == list(range(1000, 1000 + len(added)))
    probe = spark.createDataFrame([("again", "fresh one"), ("other", "wholly unlike")], "batch_id string, text string")
    got = {r.batch_id: r.node_id for r in history.History.open(spark, index.path).match(probe).collect()}
    assert set(got) == {"again"} and added[got["again"]] == f"p{new.index('fresh one')}"
    assert index.match(batch.limit(0)).count() == 0


def test_batches_in_order(spark, tmp_path):
    """The registered query: each day's batch meets the nodes and what earlier days filed, and nothing of its own or a later day."""
    from __spark_entry__ import queries

    old = notes(40, 11)
    days = ["2026-01-02", "2026-01-01", None]  # out of order, and undated rows last
    new = [("a", "alpha beta gamma delta", days[0]), ("b", "alpha beta gamma delta!", days[1]), ("c", old[3].upper(), days[0]), ("d", " ", days[1]), ("e", "one more thing", days[1]), ("f", "One more thing", days[1]), ("g", "one, more thing", None), ("h", "nothing like it", days[0])]
    spark.createDataFrame(list(enumerate(old)), "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/nodes.parquet")
    pending = spark.createDataFrame(new, "id string, content string, day string").withColumn("created_at", F.to_timestamp("day"))
    pending.coalesce(1).write.parquet(f"{tmp_path}/pending.parquet")
    got = {r.pending_id: (r.node_id, r.new_id) for r in queries()["p1_batches"](spark, str(tmp_path)).collect()}
    assert set(got) == set("abcefgh")
    assert sorted(got[x][1] for x in "bef") == [40, 41, 42] and got["h"] == (None, 43)
    assert got["a"] == (got["b"][1], None) and got["g"] == (min(got["e"][1], got["f"][1]), None)
    key = keys(spark, old)
    assert got["c"][0] <= 3 and got["c"][1] is None and (key[got["c"][0]] == key[3] or similar(token_set(old[got["c"][0]]), token_set(old[3])))


def test_backlog_is_what_the_days_give_one_after_another(spark):
    rng = random.Random(5)
    old = notes(40, 21)
    pool = notes(60, 22) + old[::5]
    rows = [(f"{i:03d}", rng.choice(pool), f"2026-01-{rng.randint(1, 6):02d}") for i in range(150)]
    nodes = spark.createDataFrame(list(enumerate(old)), "id long, text string")
    pending = spark.createDataFrame(rows, "batch_id string, text string, day string")
    at_once = history.accept_backlog(history.History.build(nodes), pending, 100)
    got = {r.batch_id: (r.node_id, r.new_id) for r in at_once.collect()}
    index, want, first = history.History.build(nodes), {}, 100
    for day in sorted({d for _, _, d in rows}):
        done = {r.batch_id: (r.node_id, r.new_id) for r in history.accept(history.History.open(spark, index.path), pending.filter(F.col("day") == day), first).collect()}
        first += sum(n is not None for _, n in done.values())
        want |= done
    assert got == want and len(want) == len(rows)
    assert sum(n is not None for _, n in want.values()) > 20 and sum((n or 0) >= 100 for n, _ in want.values()) > 20


def test_a_lost_append_leaves_the_index_as_it_was(spark, monkeypatch):
    nodes = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two three four")], "id long, text string")
    more = spark.createDataFrame([(3, "red green blue white")], "id long, text string")
    probe = spark.createDataFrame([("a", "Red green blue white"), ("b", "alpha beta gamma delta")], "batch_id string, text string")
    index = history.History.build(nodes)

    def lost(*_):
        raise OSError("lost")

    for where, name in ((history.Manifest, "commit"), (history.History, "_file")):
        with monkeypatch.context() as m:
            m.setattr(where, name, lost)
            with pytest.raises(OSError):
                index.append(more)
        assert {(r.batch_id, r.node_id) for r in history.History.open(spark, index.path).match(probe).collect()} == {("b", 1)}
    monkeypatch.setattr(history, "MOST_GENERATIONS", 2)
    for i in range(4):
        index.append(more.withColumn("id", F.col("id") + 10 * i))  # merged on the way
    assert {(r.batch_id, r.node_id) for r in history.History.open(spark, index.path).match(probe).collect()} == {("a", 3), ("b", 1)}


def long_texts(seed: int) -> list[str]:
    """Two texts alike in beginning, middle and end but for a fifth of their words in between, an edited copy of the first, and Chinese ones alike only in their first 1,500 characters."""
    rng = random.Random(seed)
    words = [f"word{rng.randrange(10**6)}" for _ in range(6_000)]
    other, edited = words[:], words[:]
    other[1_000:2_000] = [f"other{i}" for i in range(1_000)]
    other[4_000:5_000] = [f"others{i}" for i in range(1_000)]
    edited[100::600] = ["edit"] * 10
    han = [chr(0x4E00 + i) for i in rng.sample(range(20_000), 6_000)]
    return [*map(" ".join, (words, other, edited)), "".join(han[:4_000]), "".join(han[:1_600] + han[4_000:])]


def test_long_texts_are_compared_whole(spark):
    """Problem 1: a long text matches only where all of it does."""
    texts = long_texts(3)
    index = history.History.build(spark.createDataFrame([(1, texts[1]), (2, texts[0]), (3, texts[3])], "id long, text string"))
    batch = spark.createDataFrame([("edited", texts[2]), ("same start", texts[4])], "batch_id string, text string")
    assert {r.batch_id: r.node_id for r in index.match(batch).collect()} == {"edited": 2}
    # Longer than all that the index was built of.
    history.accept(index, spark.createDataFrame([("longer", " ".join(texts[:3]))], "batch_id string, text string"), 10)
    longer = spark.createDataFrame([("again", " ".join(texts[:3]) + " end")], "batch_id string, text string")
    assert [r.node_id for r in history.History.open(spark, index.path).match(longer).collect()] == [10]


def test_long_texts_are_paired_whole(spark):
    """Problem 5: a long text's pairs are those of all its tokens."""
    texts = long_texts(4)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [token_set(t) for t in texts]
    want = {(a, b) for a in range(5) for b in range(a + 1, 5) if similar(sets[a], sets[b])}
    assert want == {(0, 2)} == {(r.id_a, r.id_b) for r in neardup.near_duplicates(df).collect()}
