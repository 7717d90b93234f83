import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, `size` string, rank int, _extra array<int>"


def make_rows():
    """Documents with nulls, empty, long, repeated and near texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma,", "Delta", "épée", "straße", "x1", "of", "the", "and", "ünï", "omega."]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base = text(80)
    bodies = [text(rng.randrange(1, 90)) for _ in range(40)]
    bodies += [base] * 12 + [base.replace("alpha", "alphq", 1), base + " tail", base.upper()]
    bodies += [None, None, "", " \n\t", "one", "one two", " ", text(6000), "new\x0bline\x1cparts", "<|endoftext|> it's  I'll\r\n 12345"]
    rows = [(i, b, None if i % 7 == 0 else "en", None if i % 11 == 0 else ["a", "B", "é", "hot", "hot", "hot"][i % 6], i, 1, "s", 0, [i]) for i, b in enumerate(bodies)]
    return rows + [rows[3], rows[3], (None, "no id", None, None, None, None, None, None, None), (None, None, "en", "hot", 0, 0, "", 0, [])]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(3, "text")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
