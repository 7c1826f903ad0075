import random

import pytest

WORDS = "the of and in to water stone river light garden window paper market silver bridge winter summer music letter forest engine copper field candle harbour mirror wagon orchard".split()


class Prose:
    """Invented text from a fixed seed."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, n: int) -> list[str]:
        return [self.random.choice(WORDS) + str(self.random.randrange(50)) for _ in range(n)]

    def text(self, n: int, line: int = 12) -> str:
        w = self.words(n)
        return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


@pytest.fixture
def prose():
    return Prose(11)


#: Every awkward kind of row; operators must give each a defined result. (doc_id, text)
def awkward_rows() -> list[tuple[int | None, str | None]]:
    p = Prose(5)
    long = p.text(30_000)
    same = p.text(200)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three four"), (5, long), (6, same), (7, same), (7, same), (8, same + " end"),
        (9, "日本語のテキスト " * 40), (10, "\U0001f600 emoji \U0001f600"), (11, "x" * 50_000), (12, "A\n" * 300), (None, same), (None, "lonely words without an id here"),
        (13, None), (14, "one two three four"), (15, "tab\x0bvt\x0cff\r\ncrlf"),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, "en", "src", i, 1.0, "x", 7) for i, t in awkward_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id long, score double, row string, removed_lines int").repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
