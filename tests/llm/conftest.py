import random

import pytest

from sessionlog.llm.queries import find_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, tk string, size double, key int"


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    find_package(spark)


@pytest.fixture(scope="session")
def vocabulary():
    from sessionlog.llm.queries import vocabulary_path

    return vocabulary_path()


def words(rng: random.Random, n: int) -> str:
    pool = ["the", "of", "Tion", "ENTH", "ouen", "é", "naïve", "#x", "|", "日本", "ha,", "end."]
    return " ".join(rng.choice(pool) + str(rng.randrange(400)) * (rng.random() < 0.8) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text, source): nulls, empty, short, odd white space, repeated rows, copies, near copies, one long."""
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 9, 40, 120, 300])) for _ in range(60)]
    passage = words(rng, 70)
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "s1") for i in range(8)]
    for i in range(12):
        w = base[20 + i % 3].split()
        w[rng.randrange(len(w))] = "edited"
        rows.append((200 + i, " ".join(w), "hot"))
    rows += [(300 + i, f"{words(rng, 60)} {passage} {words(rng, 60)}", "hot") for i in range(10)]
    rows += [(400, None, "s1"), (401, "", None), (402, " \n\t ", "s0"), (403, "a", None), (404, "a a a a a a a", "s0"),
             (405, "line one\nline one\n\n x\r\ny z q", None), (None, base[5], "s2"), (None, "only null id", "s9"),
             (406, "x" * 700 + " <|endoftext|> " + "x" * 700, "s3"), (407, base[0], "s3"), (407, base[0], "s3"),
             (408, words(rng, 30_000), "s0"), (409, "THE Same Four", "s0"), (410, "the same four", "s1")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, 7, "tk", 1.5, 3) for i, t, s in texts], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
