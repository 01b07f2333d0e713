import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, _n long, n long"


def awkward_rows(seed=1, n=60):
    """Rows with copies, shared passages, nulls in every column, repeats, ties, one very long text and clashing names."""
    r = random.Random(seed)
    vocab = ["the", "of", "Ünder", "naïve", "x1", "end.", "ALL", "日本", "a", "b", "—", "rights"] + [f"w{i}" for i in range(40)]
    passages = [[r.choice(vocab) for _ in range(k)] for k in (9, 13, 14, 30, 80, 120)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 5)):
            parts += r.choice(passages) if r.random() < 0.5 else [r.choice(vocab) for _ in range(r.randint(1, 25))]
        texts.append(r.choice([" ", "  ", "\n", " \t"]).join(parts))
    texts += [texts[0], texts[0], texts[1].replace(" ", "\n"), "", None, " \n\t ", "one", "one", None]
    texts.append(" ".join(r.choice(vocab) for _ in range(20_000)))
    texts.append(texts[-1][:60_000] + " more")
    texts.append("same " * 300)
    texts.append("same " * 40)
    rows = [(i * 7 % 101, t, "en", f"s{i % 3}", len(t or ""), i, 1, None) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a whole row again
    rows.append((rows[4][0], "same id, other text", None, None, None, 5, 5, 5))
    rows.append((None, texts[2], None, "s1", None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
