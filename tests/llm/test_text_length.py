"""Training does not choose texts by their length."""

from pyspark.sql import functions as F

from tideline.llm import toxicity

LONG = toxicity.SAMPLE_WORDS + 100


def test_toxicity_is_learned_from_long_texts_only(spark):
    rows = []
    for i in range(120):
        words = [f"{'abcdefgh'[(i + k) % 8]}{'lmnop'[k % 5]}{k % 7}" for k in range(LONG + i)]
        if i % 2:
            words[::10] = ["zorgu"] * len(words[::10])
        rows.append((i, " ".join(words), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    network = toxicity.train(df, df.select("doc_id", "toxic"))
    right = toxicity.score(df, network).select(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.95


def test_drawn_windows_are_parts_of_the_text(spark):
    words = [f"w{k}" for k in range(5000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:50]))], "key long, text string")
    long, short = [r.p for r in df.select("key", toxicity.parts(F.col("text"), F.col("key")).alias("p")).orderBy("key").collect()]
    assert short == [" ".join(words[:50])]
    starts = {int(p.split()[0][1:]) for p in long}
    assert len(starts) == len(long) == toxicity.SAMPLE_WORDS // toxicity.STRIDE
    assert all(p.split() == words[s : s + toxicity.WINDOW] for p in long for s in [int(p.split()[0][1:])])
    assert max(starts) > toxicity.SAMPLE_WORDS
