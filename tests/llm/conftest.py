import random

import pytest

#: Columns with names that the operators use inside.
MORE = "block int, node long, row long, lost string, kept string, id long"


def prose(seed, n, vocabulary=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, every, seed=0):
    words = text.split()
    return " ".join(f"x{seed}q{i}" if i % every == every - 1 else w for i, w in enumerate(words))


def corpus():
    """Id, text, source: copies, near copies, a hot line, a benchmark passage, a shared passage, nulls, blanks and a long text."""
    out, passage = [], prose("passage", 60)
    base = prose("base", 120)
    for i in range(12):
        out.append((i, "Common  Header line\n" + prose(i, 90) + ".\n" + prose(f"b{i}", 30), "a"))
    out += [(20, base, "a"), (21, base, "b"), (22, base.upper(), "b"), (23, edited(base, 60, 1), "a"), (24, edited(base, 60, 2), None)]
    out += [(30, prose("c", 40) + " " + passage + " " + prose("d", 35), "b"), (31, prose("e", 53) + " " + passage + " " + prose("f", 20), "c")]
    out += [(40, None, "a"), (41, "", None), (42, " \n\t\n", "c"), (43, "one", "b"), (44, prose("long", 20000), "c")]
    out += [(50, "### $$$ %%% " * 40, "a"), (51, "again and again " * 60, "b"), (52, prose("g", 60) + "\n" + prose("item", 30) + "\n" + prose("h", 60), "c")]
    out += [(None, prose("nobody", 70), "a"), (60, prose("twice", 80), "a"), (60, prose("twice", 80), "a")]
    return out


ITEMS = [(0, "prose"), (1, None), (2, "too short")]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, 3, "x", "y", 4) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, " + MORE).repartition(5)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(0, prose("item", 30).upper()), (1, None), (2, "too short"), (3, prose("absent", 30)), (3, prose("absent", 30))], "item_id long, text string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
