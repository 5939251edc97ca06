"""The bitmap that runs of texts go through before they become rows."""

from pyspark.sql import functions as F

from voxboard.operators import evidence

WORDS = "one two three four five six seven eight nine ten".split()


def test_all_wanted_grams_pass_and_hardly_any_other(spark):
    wanted = spark.range(2000).select(F.xxhash64("id").alias("__gram"))
    test = evidence.gram_test(wanted)
    every = spark.range(200_000).select("id", F.xxhash64("id").alias("g"))
    passed = {r.id for r in every.filter(test(F.col("g"))).collect()}
    assert set(range(2000)) <= passed and len(passed) < 2000 + 0.1 * 198_000


def test_rows_out_of_the_gram_stage(spark):
    corpus = spark.createDataFrame([(i, " ".join(f"{w}{i}" for w in WORDS * 5)) for i in range(300)], "id long, __text string")
    texts = corpus.select("id", evidence._tokens(F.col("__text")).alias("__t"))
    needles = spark.createDataFrame([("two7 three7 four7 five7 six7",)], "n string")
    asked = needles.select(F.explode(evidence._word_grams(evidence._tokens(F.col("n")))).alias("__gram"))
    test = evidence.gram_test(asked)
    all_rows = texts.select(F.explode(evidence._word_grams(F.col("__t")))).count()
    kept = texts.select(F.explode(evidence._word_grams(F.col("__t"), test))).count()
    assert all_rows == 3000 and 3 <= kept < 600


def test_no_test_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(evidence, "MAX_GRAMS", 3)
    grams = spark.range(5).select(F.xxhash64("id").alias("__gram"))
    assert evidence.gram_test(grams) is None and evidence.gram_test(grams.limit(0)) is None
    needles = spark.createDataFrame([("a b c d",), ("x",), ("b c d e f g h",), ("zz yy xx ww vv",)], "needle string")
    corpus = spark.createDataFrame([(1, "_ a b c d e f g h x_"), (2, "other")], "id long, text string")
    got = {r.needle: r.verbatim for r in evidence.verbatim_in_corpus(needles, corpus).collect()}
    assert got == {"a b c d": True, "x": True, "b c d e f g h": True, "zz yy xx ww vv": False}


def test_runs_of_characters_take_no_lambda(spark):
    """Every position of a text once, by a pattern; interpreted lambdas over positions took most of the time."""
    texts = spark.createDataFrame([(1, "ab\n\U0001f600 cdefghij ab"), (2, ""), (3, None)], "__id long, __text string")
    text = texts.first()["__text"]
    made = evidence._char_grams(texts, [evidence.CHAR_GRAM])
    assert {r["__gram"] for r in made.collect()} == {text[i : i + 8] for i in range(len(text))}
    made = evidence._char_grams(texts, [2, 8])
    assert {r["__gram"] for r in made.collect()} == {text[i : i + n] for i in range(len(text)) for n in (2, 8)}
    assert "lambda" not in made._jdf.queryExecution().toString()


def test_needles_of_all_lengths_against_python(spark):
    import random

    rnd = random.Random(3)

    def some(n):
        return "".join(rnd.choices("aab é\U0001f600\n.", k=n)).strip(" \n.") or "a"

    corpus = [(i, some(rnd.randint(1, 60))) for i in range(60)] + [(7, None), (None, "zz aaab\U0001f600")]
    needles = [some(n) for n in range(1, 14) for _ in range(12)] + ["aaab\U0001f600", "", None]
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "k int, needle string")
    texts = spark.createDataFrame(corpus, "id long, text string").repartition(3)
    got = {r.k: r.verbatim for r in evidence.verbatim_in_corpus(asked, texts).collect()}
    want = {i: bool(n) and any(n in (t or "") for _, t in corpus) for i, n in enumerate(needles)}
    assert got == want and 20 < sum(want.values()) < len(want) - 20
