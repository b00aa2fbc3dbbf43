"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long, score string, anchor string, rate double, n string"


def documents(spark, seed=1, n=60, unique=False):
    """Random documents over few words; with ``unique`` every doc_id is there once and none is null."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Éa", "über", "x\ty", "a b", "😀", "UPPER"]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5:
            base = (rng.choice(texts) or "").split(" ")
            at = rng.randrange(len(base) + 1)
            texts.append(" ".join(base[:at] + rng.choices(words, k=rng.randint(0, 3)) + base[at + rng.randint(0, 2) :]))
        else:
            texts.append(rng.choice([" ", " ", "\n"]).join(rng.choices(words, k=rng.randint(1, 90))))
    texts[3:6] = ["", "   ", "w1 w2"]
    texts.append(" ".join(rng.choices(words, k=9000)))
    texts.append("same " * 300)
    rows = [(i, t, "en", "s", len(t), True, 5, "x", "y", 0.5, "z") for i, t in enumerate(texts)]
    rows.append((len(rows), None, None, None, None, None, None, None, None, None, None))
    if not unique:
        rows += [rows[2], rows[2], (7, "other text for a known id", None, None, None, None, None, None, None, None, None), ((1 << 60) + 1, texts[8], None, None, None, None, None, None, None, None, None), (None, texts[8], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def key(row):
    return tuple((x is not None, x) for x in row)
