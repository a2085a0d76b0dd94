import random

import pytest

WORDS = ["the", "river", "stone", "Quiet", "garden", "über", "niño", "light", "42", "harbour", "winter", "copper", "of", "and", "cloud"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; they must not disturb them.
CLASHES = "id long, th long, `row` string, keep long, n long, pos int, score double, kept string, `len` int, x long, component long, _gone long"


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source): nulls everywhere, empty, blank, short, very long, repeated and nearly repeated texts, ties."""
    rnd = random.Random(11)
    base = sentence(rnd, 60)
    near = base.replace(base.split(" ")[10], "changed", 1)
    texts = ["", None, " \t\r\n", "one", "one", "Two  words", "two\twords", "12345 !!", base, base, near, base + " tail", sentence(rnd, 20_000), "line of more than twenty\nshort\n" * 3]
    texts += [f"{sentence(rnd, 12)}\n  A Line That Many Share Here \n{sentence(rnd, 5)}" for _ in range(5)]
    texts += ["  A line that MANY share here", "héllo wörld x y \x1c z", "x" * 50_000, sentence(rnd, 30) + "\n" + base]
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 4 == 0 else f"src{i % 2}") for i, t in enumerate(texts)]
    return rows + [rows[8], rows[1], (None, base, None, None), (None, None, None, None), (-5, "negative id", "en", "a")]


@pytest.fixture(scope="session")
def docs_of(spark):
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
        for part in CLASHES.split(", "):
            name, kind = part.replace("`", "").split(" ")
            df = df.withColumn(name, F.lit("7").cast(kind))
        return df.repartition(3)

    return make
