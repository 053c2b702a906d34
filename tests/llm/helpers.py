"""Small inputs shared by the training-data tests."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

SYLLABLES = ["an", "the", "on", "ing", "er", "est", "ou", "ré", "zu", "ció", "日", "x1"]


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(seed=3, n=60):
    """(doc_id, text): random texts, exact and near copies, shared passages,
    nulls, empty and short texts."""
    rng = random.Random(seed)
    passage = sentence(rng, 50)
    texts = [sentence(rng, rng.choice([0, 1, 3, 7, 40, 90, 150])) for _ in range(n)]
    for i in range(0, n, 5):
        texts.append(texts[i])
    for i in range(1, n, 4):
        words = texts[i].split()
        if len(words) > 20:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
    for i in range(2, n, 6):
        texts.append(f"{texts[i]}\n{passage}\t{sentence(rng, 10)}")
    texts += [None, "", " \n\t ", "Lone", passage[: len(passage) // 2] + passage]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(7 * k + 1, texts[i]) for k, i in enumerate(order)]


def frame(spark, rows):
    """documents rows, with a clashing extra column."""
    full = [(d, t, "en", "s", len(t or ""), "clash", 1) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA + ", row_hash string, n bigint").repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
