import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, score double, kept string"
WORDS = {"en": "the of and with that from this have which would there people about other time".split(), "fr": "le la les des dans pour avec cette être très était mais aussi où français".split(), "de": "der die das und nicht über für größe schön später müssen können natürlich straße".split()}


def make(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "s", "er"]) for _ in range(rng.randint(1, 120))]
        text = " ".join(words)
        if i % 10 == 9:
            text = rows[-3][1]  # an exact copy
        if i % 10 == 8:
            text = (rows[-3][1] or "") + " more"  # a near copy
        rows.append((i, text, lang, "s", len(text), 7, 0.5, "x"))
    rows[5] = (5, None, None, None, None, None, None, None)
    rows[6] = (6, "", "en", "s", 0, 1, 1.0, "x")
    rows[7] = (7, " \n\t ", "en", "s", 4, 1, 1.0, "x")
    rows[11] = (None, "a text of no id at all and some more words", "en", "s", 1, 1, 1.0, "x")
    rows.append(rows[3])  # a repeated row
    rows.append((900, "long " + "words and more, " * 20_000, "en", "s", 1, 1, 1.0, "x"))
    return rows


@pytest.fixture(scope="session")
def rows():
    return make()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizers():
    public = pytest.importorskip("public_tokenizers")
    return lambda name: str(public.path(name))


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
