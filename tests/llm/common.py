"""Small awkward documents that every text operator must take."""

LONG = "the long text goes on " * 4000

AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "Hello World! don't 123 <|endoftext|> naïve é x\x1cy"),
    (5, "same text twice over and over again today"),
    (6, "same text twice over and over again today"),
    (5, "same text twice over and over again today"),
    (7, LONG),
    (None, "a row without an id"),
    (9, "日本語 ﬁ İstanbul ΣΑΣ \u0085 end"),
]


def frame(spark, rows=AWKWARD):
    """Awkward rows with extra columns whose names clash with outputs and temporary names."""
    rows = [(i, t, "x", 1, 2, "g") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score int, shard int, component_id string")


def empty(spark):
    return frame(spark, []).where("false")
