import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

ODD = [
    None, "", " ", "\n", "\t \r\n", "a", "a a a a", "<|endoftext|> x <|endoftext|>", "password = hunter2222", "token: abc", 'api_key="AAAABBBB"', "secret:token:abcdefgh", "AKIA" + "Z9" * 9, "AKIA" + "Q" * 15,
    "0123456789abcdef" * 3, "mail a.b+c@d-e.org, x@y", "10.0.0.255 and 10.0.0.256 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (0) 30 1234-5678 +1 2", "é" * 40 + " 🙂 日本語 text",
    "ﬁ ſecret=abcdefgh Key", "x" * 3000, " ".join(["lorem ipsum dolor sit amet"] * 300), "one two three four", "One TWO three four", "line\nline\nline\n\nother",
]


def prose(r, n):
    syllables = "the of tion ing er on re st nd he an ti or ed at".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def corpus():
    """(doc_id, text): odd texts, prose, exact and near copies, repeated passages."""
    r = random.Random(7)
    texts = list(ODD)
    for _ in range(25):
        base = prose(r, r.randint(30, 220))
        texts.append(base)
        for _ in range(r.randint(0, 3)):
            words = base.split(" ")
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(["x", "Y", "zz"])
            texts.append(" ".join(words))
        texts.append(base.replace(" ", "  ", 2))
    passage = prose(r, 60)
    texts += [prose(r, 25) + " " + passage + " " + prose(r, 25) for _ in range(12)]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def docs():
    return corpus()


@pytest.fixture(scope="session")
def table(spark, docs):
    """With extra columns whose names clash with those that operators make."""
    rows = [(d, t, "en", "src0" if d % 3 else None, len(t or ""), 1, "x", 0) for d, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, kind string, _file int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
