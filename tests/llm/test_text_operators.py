"""Problems 2, 3, 6, 7 and 8 on small fixtures, with held-out accuracy where a model is trained."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import leakage, packing, pii, residue, subjects
from tessera.llm.vec import Units, rolling

SF = "/root/testdata/sf0.01"


def kinds(text):
    return [(text[a:b], k) for a, b, k in pii.mentions(text)]


def test_mentions():
    cases = {
        "Write to i.ulmelek+notes (at) example.org.": [("i.ulmelek+notes (at) example.org", "email")],
        "mail anna [at] post [dot] test, or ANNA＠POST.TEST": [("anna [at] post [dot] test", "email"), ("ANNA＠POST.TEST", "email")],
        "anna at post dot test": [("anna at post dot test", "email")],
        "See package kbtool@19.25.247. Order 7150153175 shipped. Build 20180059-227 passed.": [],
        "Invoice no. 8816-0120-201 is closed; node 10.13.105.107; 2024-01-02": [],
        "Call (520) 555-0107 / +1 315 555 0165.": [("(520) 555-0107", "phone"), ("+1 315 555 0165", "phone")],
        "手机 16390802415，上午打。急事请拨 (0999) 5557437。": [("16390802415", "phone"), ("(0999) 5557437", "phone")],
        "证件号 292577 19560609 5227 已核对。": [("292577 19560609 5227", "idno")],
        "Su DNI es 00731876-Q. SSN on file: 907-34-7560. Personalausweis: X63M70218.": [("00731876-Q", "idno"), ("907-34-7560", "idno"), ("X63M70218", "idno")],
        "Lives at 116 Oakmoor St., Flat 3B, Castrel.": [("116 Oakmoor St., Flat 3B, Castrel", "address")],
        "家住沅泽市桥山区坞梧路126号。": [("沅泽市桥山区坞梧路126号", "address")],
        "Wohnt in der Oakmoorstraße 47, 99105 Altmoor.": [("Oakmoorstraße 47, 99105 Altmoor", "address")],
        "Vive en Plaza de Quillgate nº 149.": [("Plaza de Quillgate nº 149", "address")],
        "Thanks to Vera Wenundik for the fix; Torlorsen, Lena signed off.": [("Vera Wenundik", "name"), ("Torlorsen, Lena", "name")],
        "据刘祁霖说，先不改。由Tilda-Emil Quildelard跟进。": [("刘祁霖", "name"), ("Tilda-Emil Quildelard", "name")],
        "Forward it to vera.wenundik@example.com": [("vera.wenundik@example.com", "email")],
        "": [],
    }
    for text, want in cases.items():
        assert kinds(text) == want, text
    assert pii.mentions(None) == []


def test_chinese_names_of_any_characters():
    cases = {
        "接口已上线。\n-- \n王伟": ["王伟"], "接口已上线。\n——\n欧阳娜\n16390802415": ["欧阳娜"], "完成。\n~\n李雪梅\n": ["李雪梅"],
        "作者: 张敏\n编号: R1": ["张敏"], '{"审核人": "司马光", "期限": "2024-01-02"}': ["司马光"], "| 经办人 | 陈杰 |": ["陈杰"], "author: 刘洋": ["刘洋"], "联系人=诸葛静宜; 数量=3": ["诸葛静宜"],
        "王伟已经确认。": ["王伟"], "昨天张建国说，先不改": ["张建国"], "和李丽老师沟通过": ["李丽"], "由上官婉跟进": ["上官婉"], "@赵磊 请看一下": ["赵磊"], "负责人：周芳": ["周芳"],
        # Characters of no list, where the place says that it is a name.
        "作者：王犇": ["王犇"], "记录完毕。\n--\n孙骉": ["孙骉"], "据钱鱻说：照旧": ["钱鱻"],
        # No persons.
        "方案已经确认。高峰已经确认。任课老师说，金额已经确认。": [], "负责人: 金融组\n作者: 方案部": [], "a: 1\n---\n方案\n": [], "姓名: 高中老师": [], "马上说，周日跟进，周末请回复": [],
    }
    for text, want in cases.items():
        assert [t for t, k in kinds(text) if k == "name"] == want, text


def test_names_of_no_list_are_known_by_their_place():
    names = ["Priya Raman", "Kwame Mensah", "Sven Hedlund", "Fatima Haddad", "Ingrid van Dahl", "Oisín O'Byrne-Tan", "Li M. Zhou"]
    for name in names:
        for text in ("Thanks to {} for the fix.", "{} signed off on it.", "Approved by {} yesterday.", "Contact: {}", '{{"author": "{}", "site": "x"}}', "| owner | {} |", "Done.\n-- \n{}\n+1 471 555 0183", "Gracias a {}.", "{} hat zugestimmt.", "{} confirmó."):
            assert name in [t for t, k in kinds(text.format(name)) if k == "name"], text.format(name)
    for text in ("Owner: Oncall Team", "Approved by The Board.", "Contact: Castrel Station", "Torvel Office signed off.", "Berlin Mitte is near.", "owner: billing", "-- \nKnowledge Desk"):
        assert not kinds(text), text
    assert [t for t, _ in kinds("联系 王建国 或 李晓明，作者李伟。")] == ["王建国", "李晓明", "李伟"]


def test_offsets_hold():
    """What is said or mapped to other lengths is replaced whole, and nothing else is."""
    cases = {
        "ﬁnd the ﬁle, ﬁnally at 116 oakmoor street, castrel today": "ﬁnd the ﬁle, ﬁnally at [ADDRESS] today",
        "İSTANBUL: 116 OAKMOOR STREET IS IT": "İSTANBUL: [ADDRESS] IS IT",
        "call 555 double five 12 34 today": "call [PHONE] today",
        "ring me: five five five, one two three four, ok": "ring me: [PHONE], ok",
        "手机 一六三九零八零二四一五 上午": "手机 [PHONE] 上午",
        "a double espresso and one triple jump": "a double espresso and one triple jump",
    }
    for text, want in cases.items():
        assert pii.redact(text) == want


def test_every_kind_of_street_is_found():
    streets = [f"12 Elm {w}" for w in "Road Lane Avenue Street Drive Close Rd Rd. Ave Ave. St St.".split()]
    streets += [f"Linden{w} 12" for w in "straße strasse str. weg allee platz gasse -Allee -Straße -Strasse -Weg -Platz".split()]
    streets += ["Berliner Straße 12", "Berliner Strasse 12", "Berliner Allee 12", "Karl-Marx-Straße 5", "Berliner Straße 12, 10115 Berlin", "45 Elm Ave, Castrel"]
    streets += [f"{w} Luna 12" for w in "Calle C/ Avda. Avenida Plaza Paseo Camino Ronda".split()]
    streets += [f"东山{w}12号" for w in "路 街 大道 巷 胡同".split()]
    for street in streets:
        assert kinds(street) == [(street, "address")], street
        assert kinds(f"x: {street}") == [(street, "address")], street
    assert kinds("BERLINER STRASSE 12, 10115 BERLIN") == [("BERLINER STRASSE 12, 10115 BERLIN", "address")]


def test_every_disguise_of_at_and_dot_is_found():
    for left, right in ("[]", "()", "{}", "<>"):
        for blank in ("", " ", "  "):
            for inner in ("", " "):
                for at in ("at", "AT", "@", "a", "arroba", "ät"):
                    for dot in ("dot", "Dot", "punkt", "punto", ".", "点"):
                        wrap = lambda x: f"{blank}{left}{inner}{x}{inner}{right}{blank}"  # noqa: E731, B023
                        for mail in (f"anna{wrap(at)}post{wrap(dot)}test", f"anna{wrap(at)}post.test", f"anna@post{wrap(dot)}test"):
                            assert kinds(f"to: {mail} now") == [(mail, "email")], mail
    assert kinds("mail anna at\npost\ndot test") == [("anna at\npost\ndot test", "email")]
    assert kinds("see (a) and [b], x[0] < y {c} <d>") == [] and pii.normalise("f(x) [y]") == ("f(x) [y]", None)


def test_phones_of_any_grouping():
    abroad = "+49 30 1234567|+49 89 636-48018|+49 (0)30 123 45 67|+34 91 123 45 67|+44 20 8123 4567|+44 161 496 0000|+33 1 23 45 67 89|+41 44 668 18 00|+81 3-1234-5678|+1 (520) 555-0107|+86 10 1234 5678|+390612345678|0049 30 1234567"
    for number in abroad.split("|"):
        assert kinds(f"We noted {number} there") == [(number, "phone")], number
    national = "030 1234567|0151 23456789|612 345 678|020 8123 4567|0161 496 0000|520 555 0107|010 12345678|91 123 45 67|(030) 123 45 67|030/123 45 67"
    for number in national.split("|"):
        for text in ("Tel. {}, bitte", "Phone: {}.", "Call me on {}!", "Erreichbar unter? Anrufen: {}", "Teléfono {}", "电话：{}。", "手机{}转"):
            assert kinds(text.format(number)) == [(number, "phone")], text.format(number)
    for text in ("Call on 2024-01-02.", "call 02.01.2024", "call node 10.13.105.107", "Phone order 7150153175 shipped", "Recall 123 456 7890 items", "+12 34", "load to reach 9903 / 351; it", "part 030 1234567", "电话订单 7150153175"):
        assert kinds(text) == [], text


def test_redaction_keeps_the_rest():
    text = "Ask Vera Wenundik,​ write to a.b [at] post [dot] test — or call 520-555-0107!"
    assert pii.redact(text) == "Ask [NAME],​ write to [EMAIL] — or call [PHONE]!"
    assert pii.redact(None) is None and pii.redact("") == "" and pii.redact("nothing here") == "nothing here"
    spelled = "the code is one nine zero zero five five five zero one"
    assert pii.normalise(spelled)[0].endswith("190055501")
    long = "x " * 20_000 + "a@b.test"
    assert pii.redact(long).endswith("[EMAIL]") and len(pii.redact(long)) == 40_007


def test_find(spark):
    rows = [("nodes", 1, "a@b.test, c@d.test", 5), ("nodes", 1, "a@b.test, c@d.test", 5), ("pending", 2, None, 5)]
    df = spark.createDataFrame(rows, "tbl string, rec_id long, text string, nth int")
    got = sorted((r.rec_id, r.kind, r.nth) for r in pii.find(df).collect())
    assert got == [("1", "email", 1), ("1", "email", 1), ("1", "email", 2), ("1", "email", 2)]
    assert pii.find(df.limit(0)).count() == 0 and pii.redacted(df).count() == 3


def test_rolling():
    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(7919)
    for n in (1, 2, 3, 12, 20):
        w = rolling(h, n)
        assert len(w) == len(h) - n + 1 and len(set(w.tolist())) == len(w)
        assert (rolling(np.concatenate([h, h]), n)[: len(w)] == w).all()
    assert len(rolling(h[:3], 12)) == 0
    u = Units(["Ab1, 数据x", "", "12.5 𠀀a"])
    assert u.n.tolist() == [4, 0, 4] and u.cjk.tolist() == [False, True, True, False, False, False, True, False]


def brute(doc: str, item: str) -> bool:
    d, q = Units([doc]), Units([item])
    n = 20 if q.cjk.sum() * 2 > len(q.h) else 12
    seen = {tuple(d.h[i : i + n].tolist()) for i in range(len(d.h) - n + 1)}
    covered = set()
    for j in range(len(q.h) - n + 1):
        if tuple(q.h[j : j + n].tolist()) in seen:
            covered.update(range(j, j + n))
    return len(q.h) > 0 and 3 * len(covered) >= len(q.h)


def test_tiles_mark_both_texts():
    assert leakage.tiles([], 5) == [] and leakage.tiles([(15, 3, 0)], 20) == [(15, 3, 0)]
    # The item holds a passage twice, the document once: one of the two is covered.
    assert sum(n for n, _, _ in leakage.tiles([(12, 100, 0), (12, 100, 12)], 60)) == 12
    # The longest comes first; what it covers of another is cut off, in either text.
    assert sorted(leakage.tiles([(20, 0, 0), (15, 50, 12)], 40)) == [(7, 58, 20), (20, 0, 0)]
    assert sorted(leakage.tiles([(20, 0, 0), (15, 15, 20)], 40)) == [(10, 20, 25), (20, 0, 0)]
    assert sorted(leakage.tiles([(14, 0, 0), (30, 3, 20)], 60)) == [(3, 0, 0), (30, 3, 20)]
    passage = " ".join(f"w{i}" for i in range(12))
    item = " ".join([passage, passage, *(f"x{i}" for i in range(36))])
    rows = leakage.scan([f"a b {passage} c", f"{passage} and {passage}"], leakage.Items([(1, item)]))
    assert rows == [(1, 0, 24, 60)]  # the union of the matches would be 24 of 60 in the first document too


def test_leaks(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(10, 60)))) for i in range(30)]
    items += [(90, "数据库配置" + "".join(chr(0x4E00 + rng.randint(0, 900)) for _ in range(50))), (91, ""), (92, None), (93, items[0][1])]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choices(words, k=20))]
        for _ in range(rng.randint(0, 3)):
            q = rng.choice(items[:31])[1]
            units = q.split(" ") if " " in q else list(q)
            a = rng.randrange(len(units))
            piece = units[a : a + rng.randint(5, 40)]
            parts.append((" " if " " in q else "").join(piece).upper().replace(" ", rng.choice([" ", ", ", "\n> "])))
        rng.shuffle(parts)
        docs.append((d, " ".join(parts), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, items[3][1] * 3, "x")]
    want = {(d, i) for d, t, _ in docs for i, q in items if t and q and brute(t, q)}
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id long, text string")
    for block in (leakage.BLOCK_CHARS, 2_000):
        got = {(r.doc_id, r.item_id) for r in leakage.leaks(df, it, block).collect()}
        assert got == want and len(want) > 20
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


@pytest.mark.parametrize("most", [None, 4])
def test_plan_uses_up_the_histogram(most):
    rng = np.random.default_rng(1)
    histogram = np.bincount(np.minimum(rng.geometric(0.02, 3000), 100), minlength=101)
    plan = packing.plan(histogram, 100, most)
    used = np.zeros(101, int)
    for members, times in plan:
        assert sum(x * m for x, m in members.items()) <= 100 and sum(members.values()) <= (most or 100)
        for x, m in members.items():
            used[x] += m * times
    assert (used == histogram).all()
    containers, tokens = sum(t for _, t in plan), int((histogram * np.arange(101)).sum())
    if most is None:
        assert containers <= 1.02 * -(-tokens // 100)


def test_packing(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("tokens"))
    extra = spark.createDataFrame([(9001, None, 1), (9002, "", 1), (9003, "word " * 9000, 1), (9003, "word " * 9000, 1)], "doc_id long, text string, tokens int")
    docs = documents.unionByName(extra)
    specs = spark.createDataFrame([("s", 256, None), ("m", 512, 3)], "spec string, capacity_tokens int, max_items int")
    packed = packing.pack(docs, specs).toPandas()
    count = packing.counter()
    size = {r.doc_id: count(r.text) for r in docs.collect()}
    for spec, capacity, most in (("s", 256, None), ("m", 512, 3)):
        p = packed[packed.spec == spec]
        assert p.groupby("container_id").tokens.sum().max() <= capacity
        assert most is None or p.groupby("container_id").size().max() <= most
        assert set(p.doc_id) == set(size)
        whole = p.groupby("doc_id").tokens.sum()
        assert all(whole[d] == n * (2 if d == 9003 else 1) for d, n in size.items())
        assert (p[p.doc_id.map(size) <= capacity].groupby("doc_id").size() == 1).all()
        split = p[p.doc_id == 9003]
        assert sorted(split.piece) == sorted(2 * list(range(-(-size[9003] // capacity))))
    assert packing.pack(docs.limit(0), specs).count() == 0


def test_residue(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = residue.fit_on(docs)
    assert model.held_out > 10 and model.accuracy > 0.95
    cases = [
        ("404 Not Found\nReference #3351.Nornorrel\nThe page you asked for could not be found.", None, True),
        ("请启用 JavaScript 后继续访问。\n您的浏览器已禁用脚本，本页无法显示。", None, True),
        ("- Title: {{ title }}\n- Owner: {{ owner }}\n- Risks: TBD", "Belmo", True),
        ("The importer answered 'Please enable JavaScript' once, so Vindorhal was fetched again. Lesson from Wilzim: a untrusted security scanner rarely hardens the intrusion alert by hand.", "Wilzim scanner", False),
        ("Config Sarrosquil sets the treasury bill to 38.7% and leaves the liquidity buffer overdue.", "Polvor bond yield", False),
        ("", None, False),
        (None, None, False),
    ]
    df = spark.createDataFrame([(i, t, h, "u") for i, (t, h, _) in enumerate(cases)], "doc_id long, text string, title string, share string")
    got = {r.doc_id for r in residue.residue(df, model).collect()}
    assert got == {i for i, c in enumerate(cases) if c[2]}
    assert residue.residue(df.limit(0), model).count() == 0
    nothing = residue.train([("all is content here", "t", "h")])
    assert nothing.shares(["404 Not Found"], [None])[0] == 0


def test_filler_of_no_list():
    """Filler in made-up words, unlike any stock phrase: most documents that hold it are found, also those that the fit never saw."""
    rng = random.Random(9)
    odd = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) for _ in range(40)]
    things = [f"{a}{b}" for a in ("load", "cache", "index", "query", "batch") for b in ("er", "ing", "s", "map", "set", "log")]

    def talk() -> str:
        return " ".join(f"The {rng.choice(things)} was {rng.choice(('slow', 'fast', 'late'))} and we moved {rng.randint(2, 9)} {rng.choice(things)} to the {rng.choice(things)}." for _ in range(rng.randint(2, 6)))

    def waffle(words: list[str]) -> str:
        return " ".join(" ".join(rng.choices(words, k=rng.randint(6, 12))).capitalize() + "." for _ in range(rng.randint(2, 6)))

    rows = [(talk(), "A title", f"h{i % 20}") for i in range(300)] + [(waffle(odd), "Odd", f"h{i % 20}") for i in range(30)]
    rows += [("404 Not Found\nThe page could not be found.", None, "h1")] * 5
    assert not any(residue.weak_label(s) == 1 for t, _, _ in rows[300:330] for s in residue.segments(t))
    model = residue.train(rows)
    assert (model.shares([waffle(odd) for _ in range(50)], ["Odd"] * 50) > 0.5).mean() >= 0.95
    assert (model.shares([talk() for _ in range(200)], ["A title"] * 200) > 0.5).mean() == 0
    mixed = [talk() + "\n" + talk() + "\n" + waffle(odd)[:60] for _ in range(20)]
    assert (model.shares(mixed, ["A title"] * 20) > 0.5).mean() == 0
    assert (model.shares(["foo foo bar bar foo foo bar bar. Foo foo foo foo."], [None]) > 0.5).all()


def test_subjects(spark):
    nodes = spark.read.parquet(f"{SF}/nodes.parquet")
    labels = spark.read.parquet(f"{SF}/subject_labels.parquet").filter("node_id is not null")
    table = spark.read.parquet(f"{SF}/subjects.parquet")
    held = labels.filter("node_id % 3 = 0")
    chains = subjects.fit_on(nodes, labels.join(held, "node_id", "left_anti"), table)
    found = subjects.assign(nodes, chains)
    got: dict[int, set] = {}
    for r in found.collect():
        got.setdefault(r.node_id, set()).add(r.subject)
    want: dict[int, set] = {}
    for r in held.collect():
        want.setdefault(r.node_id, set()).update([r.subject] if r.subject else [])
    right = sum(got.get(i, set()) == s for i, s in want.items())
    assert right >= 0.75 * len(want)  # the labels themselves are wrong now and then
    odd = spark.createDataFrame([(1, None, None, None, "x"), (2, "", "c", "s", "x"), (3, "!!!", "c", "s", "x")], "id long, text string, category string, source string, mass string")
    assert subjects.assign(odd, chains).count() == 0 and subjects.assign(odd.limit(0), chains).count() == 0
    assert {r.subject for r in subjects.composition(found).collect()} == set(chains.subjects)
