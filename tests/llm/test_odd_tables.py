"""Null ids, very long texts and columns of nothing but nulls go through every operator."""

from pyspark.sql import functions as F

from tessera.llm import history, leakage, ledger, neardup, packing, pii, residue, subjects

LONG = " ".join(f"wort{i}" for i in range(12_000)) + " 数据库配置" * 8_000 + " " + "x" * 20_000 + " " + " ".join(f"ende{i}" for i in range(600))
ROWS = [(1, LONG), (2, LONG + " more"), (None, "a text without an id"), (3, None), (4, ""), (5, " \n\t "), (None, None), (6, "\U0001f600" * 50), (7, "a" * 70_000)]


def table(spark, key="id"):
    return spark.createDataFrame(ROWS, f"{key} long, text string").withColumns({c: F.lit(None).cast("string") for c in ("title", "source_url", "category", "source", "tbl")})


def test_duplicates(spark):
    df = table(spark)
    # The tokenizer keeps head, middle and tail of a long text, so the two long ones are near duplicates.
    assert {(r.id_a, r.id_b) for r in neardup.near_duplicates(df).collect()} == {(1, 2)}
    keyed = ledger.keys(df)
    book = ledger.Ledger(spark)
    book.update(keyed)
    assert ledger.copies(keyed, book).count() == 0
    batch = spark.createDataFrame([("a", LONG), ("b", None), (None, "a text without an id")], "batch_id string, text string")
    assert [r.node_id for r in history.History.build(df).match(batch).filter("batch_id = 'a'").collect()] == [1]


def test_texts(spark):
    df = table(spark)
    nulls = df.select("tbl", F.col("id").alias("rec_id"), "text")
    assert pii.find(nulls).count() == 0 and pii.redacted(nulls).count() == len(ROWS)
    docs = table(spark, "doc_id")
    items = spark.createDataFrame([(1, " ".join(f"wort{i}" for i in range(5_000, 5_040))), (None, "nothing of it"), (2, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == {(1, 1), (2, 1)}
    specs = spark.createDataFrame([("s", 512, 2), ("bad", 0, None), (None, 300, None)], "spec string, capacity_tokens int, max_items int")
    packed = packing.pack(docs, specs)
    assert packed.filter("spec = 's'").select(F.sum("tokens")).first()[0] == packed.filter("spec is null").select(F.sum("tokens")).first()[0]
    assert packed.groupBy("spec", "container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).filter("(spec = 's' and (t > 512 or n > 2)) or t > 512").count() == 0
    assert residue.scored(docs, residue.train([("404 Not Found", None, ""), ("plain content of a page", "t", "h")])).count() == len(ROWS)
    rows = [("python code compiles", "software", "s", ["software"]), ("goal in the match", "sport", "s", ["sport"]), ("nothing", None, None, [])] * 8
    chains = subjects.train(rows, [("software", "软件"), ("sport", None)])
    assert subjects.assign(df, chains).filter("subject not in ('software', 'sport')").count() == 0
