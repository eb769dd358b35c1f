"""Small frames with the awkward rows that every operator must take."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta the gamma of delta " * 20000

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and the cat sat on the mat with a hat.", "en", "src0", 10),
    (2, None, None, None, None),
    (3, "", "en", "src0", 0),
    (4, " \n\t ", "de", None, 3),
    (5, "The quick brown fox jumps over the lazy dog and the cat sat on the mat with a hat.", "en", "src0", 10),
    (5, "The quick brown fox jumps over the lazy dog and the cat sat on the mat with a hat.", "en", "src0", 10),
    (None, "a row without an id", "en", "src1", 1),
    (None, None, None, "src1", None),
    (6, "x" * 30000, "fr", "src1", 2),
    (7, LONG, "en", "src0", len(LONG)),
    (8, "Été 日本語 \U0001d518 <|endoftext|> ▁mark \x00 nul", "fr", "src0", 3),
    (9, "word", "en", "src0", 4),
    (-3, "negative id\nline\nline\nline", "en", "src0", 4),
]


def awkward(spark):
    """The rows above, with extra columns whose names operators may use themselves."""
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    names = ["tie", "held", "fp", "row_key", "counts", "kept", "spread", "score", "shard", "slot", "block", "part",
             "text_key", "word", "group", "fence_lang", "quality", "label"]
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, n=120, seed=5):
    """Random documents from few words, with exact and near copies."""
    import random

    rng = random.Random(seed)
    words = "the of and to in is that on with sun moon star tree river stone cloud grass bird fish wolf bear".split()
    rows = []
    for i in range(n):
        if i % 5 == 4:
            text = rows[-1][1]
        elif i % 7 == 6:
            text = rows[-2][1] + " " + rng.choice(words)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["src0", "src1"]), len(text)))
    return spark.createDataFrame(rows, SCHEMA), {r[0]: r[1] for r in rows}
