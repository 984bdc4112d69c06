import pytest

#: Rows that every operator on documents must survive: nulls, blanks, ties, repeated rows, long text, clashing columns.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + str((seed + i) % 11) for i in range(n)) + "."


@pytest.fixture(scope="session")
def awkward(spark):
    base = [sentence(s, 60) for s in range(4)]
    rows = [(1, base[0]), (2, base[0]), (3, base[1] + "\n" + base[2]), (None, base[1] + "\n" + base[2]), (4, None), (5, ""), (6, " \n\t "),
            (7, "one"), (7, "one"), (8, base[2] + "\n" + base[3]), (9, "x" * 5000), (10, sentence(9, 3000)), (11, "日本語 é 🙂 \u0000 end"),
            (12, base[0].replace("alpha", "ALPHA"))]
    schema = "doc_id long, text string, n_words string, kept string, score string, start string, n_lines string"
    return spark.createDataFrame([(i, t, "w", "k", "s", "a", "l") for i, t in rows], schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
