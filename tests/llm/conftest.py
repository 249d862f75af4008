import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, token string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table, with extra columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, repeated ids, nulls, empty and long texts."""
    import random

    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(70)
    rows = [(k, " ".join(words(rng.randint(1, 150)))) for k in range(40)]
    base = words(120)
    for k in range(40, 52):  # near copies
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((k, "  ".join(own)))
    rows += [(k, " ".join(words(20) + passage + words(20))) for k in range(52, 56)]
    rows += [(k, " ".join(base)) for k in (56, 57)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "one two"), (64, "One  TWO"), (65, " ".join(words(9000))), (None, "no id at all"), (None, None)]
    rows += [(3, rows[3][1]), (4, " ".join(words(60))), (66, "é ü x   y, z's <|endoftext|> Á. Ⅷ ß İ")]
    return rows
