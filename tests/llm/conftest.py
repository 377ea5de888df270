import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: nulls, empty and blank texts, ties, repeats, odd characters, a long text
EDGES = [
    (None, None, None, None, None),
    (1, None, None, "s", 0),
    (2, "", None, None, 0),
    (3, " \n\t\r\n ", "en", "s", 5),
    (4, "12345 67890 --- !!!", "en", "s", 1),
    (5, "one", "en", "s", 3),
    (6, "one two three four", "en", "s", 1),
    (7, "same text here with seven words inside", "en", "s", 1),
    (7, "same text here with seven words inside", "en", "s", 1),
    (8, "same text here with seven words inside", "en", "s", 1),
    (9, "naïve été ÀÉ ſecret Kelvin \x01 mark \x02 ünïcode 😀 end", "fr", "s", 1),
    (10, "x" * 30_000 + " " * 10_000 + "y " * 20_000, "en", "s", 1),
    (11, "a\n" * 3_000, "en", "s", 1),
    (12, "été " * 6_000, "fr", "s", 1),
]

WORDS = {
    "en": "the of and with that there which would other about could these river stone light water under north house paper".split(),
    "de": "der die und nicht auch sich nach einer wurde werden über straße wasser unter haus licht fluss stein nördlich zwischen".split(),
    "fr": "les des que dans pour avec cette était rivière pierre lumière maison papier être après déjà même très forêt chaque".split(),
}


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, edges):
    """The same rows with columns named as the operators' own."""
    from pyspark.sql import functions as F

    names = "spans kind start end score lang_pred held_out fingerprint edited next_text n_words n_hit hits items doc drops key n_tokens ids slot shard n_shingles component_id kept digest node comp id".split()
    return edges.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts in three languages with near copies, common lines and chains."""
    r = random.Random(7)
    rows, i = [], 100
    for _ in range(60):
        lang = r.choice(list(WORDS))
        words = [r.choice(WORDS[lang]) + r.choice(["", "", str(r.randrange(50))]) for _ in range(r.randrange(3, 120))]
        lines, at = [], 0
        while at < len(words):
            n = r.randrange(1, 15)
            lines.append(" ".join(words[at : at + n]))
            at += n
        rows.append((i, "\n".join(lines), lang, "s", 0))
        i += 3
        for _ in range(r.choice([0, 0, 0, 1, 6])):  # near copies, each of the one before
            words = [w if r.random() > 0.03 else w + "x" for w in words]
            rows.append((i, " ".join(words), lang, "s", 0))
            i += r.randrange(1, 4)
    for k in range(12):
        rows.append((i + k, f"{'A common line of some length.  ' if k % 2 else 'a COMMON line of some length.'}\nown {k}\nshort", "en", "t", 0))
    return rows


@pytest.fixture(scope="session")
def corpus_df(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)
