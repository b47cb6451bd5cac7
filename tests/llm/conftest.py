import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHING = ("key", "size", "shard", "slot", "score", "predicted", "component", "fp", "start", "length", "ids", "offset", "group", "kept", "_text", "_part", "_row", "_key", "_host", "_body")

ODD = [
    None, "", " ", "\n\n", "a", "a b", "<|endoftext|>", "x <|endoftext|> y", "<|startoftext|> z", "tabs\tand  two  spaces ", " lead", "it's we'll İstanbul",
    "naïve café Ünïcödé ß", "日本語のテキスト と スペース", "emoji 🙂 🙃 zwj 👩‍👩‍👧", "nul \x00 inside", "line sep nbsp　wide", "1234567890 12 3.5e-10", "UPPER lower MiXeD", "a\r\nb\r\nc\x0b\x0cd",
    "x" * 3000, "word " * 400, "#*$%&|<> | | |", "same line\nsame line\nother\n \nsame line", "ends with space ", "\x1c\x1d \x85 .", "ﬁne ligature", "a" + "́" * 5,
]


def prose(rng: random.Random, n: int) -> str:
    vocabulary = ["river", "stone", "of", "the", "and", "a", "quiet", "morning", "walked", "over", "hill's", "bright", "garden", "letter", "found", "no", "one", "there", "winter", "2019", "house", "Garden,", "said.", "light", "under", "tree"]
    return " ".join(rng.choice(vocabulary) + (rng.choice("abcdefghij") if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Documents with nulls in every column, odd and very long texts, copies, repeated rows and ids."""
    rng = random.Random(3)
    out = [(i, t, "en", "odd.example", len(t or "")) for i, t in enumerate(ODD)]
    texts = [prose(rng, rng.randint(20, 400)) for _ in range(60)]
    out += [(100 + i, t, "en", f"host{i % 7}.example", len(t)) for i, t in enumerate(texts)]
    out += [(200 + i, texts[i % 3], None, None, None) for i in range(30)]
    for i in range(20):  # near copies
        words = texts[10 + i % 4].split()
        words[rng.randrange(len(words))] = "changed"
        out.append((300 + i, " ".join(words), "en", "copies.example", 1))
    passage = prose(rng, 300)
    out += [(400 + i, prose(rng, 50) + "\n" + passage + "\n" + prose(rng, 30), "en", "shared.example", 1) for i in range(8)]
    out += [(500, prose(rng, 40_000), "en", "long.example", 1), (501, "ab " * 20_000, "en", "long.example", 1)]
    out += [out[30], out[30], out[40], (None, "without an id at all", "en", "a", 1), (None, None, None, None, None), (120, "an id that occurs twice", "en", "a", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING}).repartition(5)


@pytest.fixture(scope="session")
def plain(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
