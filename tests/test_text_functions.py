"""Text functions on all of Unicode, long numbers and unusual scripts, against plain Python."""
import unicodedata

from pyspark.sql import functions as F

from domframe.functions import text as tx


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def test_accents_of_all_characters(spark):
    points = [p for p in range(0x30000) if not 0xD800 <= p < 0xE000]
    chunks = ["x".join(map(chr, points[k : k + 64])) for k in range(0, len(points), 64)]
    # the JVM may know other characters than Python, so the ones that either takes for marks are left out
    rows = spark.createDataFrame(list(enumerate(chunks)), "k int, c string").select("k", tx.strip_accents(F.col("c")).alias("x"), F.regexp_replace("c", r"[^\p{Mn}]", "").alias("marks")).collect()
    for r in rows:
        known = {c for c in chunks[r.k] if unicodedata.category(c) == "Mn"} ^ set(r.marks)
        want = plain("".join(c for c in chunks[r.k] if c not in known))
        assert "".join(c for c in r.x if c not in known) == want, hex(ord(chunks[r.k][0]))


def test_accents_of_texts(spark):
    texts = ["が", "한국어 Café", "Å", "ŕ́é", "όύ", "कक़", "x" * 20]
    got = spark.createDataFrame([(t,) for t in texts], "c string").select("c", tx.strip_accents(F.col("c")).alias("x")).collect()
    assert {r.c: r.x for r in got} == {t: plain(t) for t in texts}


def test_natural_order_of_long_numbers(spark):
    numbers = [0, 7, 10, 99, 10**12, 10**12 + 1, 10**17, 2 * 10**17, 10**30, 10**30 + 5]
    rows = spark.createDataFrame([(f"v{n:0{w}}x", i) for i, n in enumerate(numbers) for w in (1, 3)], "c string, i int").orderBy(tx.natural_key(F.col("c"))).collect()
    assert [r.i for r in rows] == sorted(r.i for r in rows)


def test_integers(spark):
    given = {"12": 12, " +7x": 7, "-3": -3, "": -1, "x": -1, str(2**63 - 1): 2**63 - 1, str(2**63): -1, "9" * 40: -1}
    rows = spark.createDataFrame([(g,) for g in given], "c string").select("c", tx.int_or(F.col("c"), -1).alias("n")).collect()
    assert {r.c: r.n for r in rows} == given


def test_camel_case(spark):
    given = {"font_size": "fontSize", "color": "color", "border_top_left_radius": "borderTopLeftRadius", "": "", "_x": "X"}
    rows = spark.createDataFrame([(g,) for g in given], "c string").select("c", tx.camel_case(F.col("c")).alias("x")).collect()
    assert {r.c: r.x for r in rows} == given
