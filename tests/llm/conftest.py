import random

import pytest

# names that the operators use inside
CLASHES = ("row", "w", "t", "s", "l", "p", "key", "size", "place", "bucket", "n", "h", "th", "doc", "quality", "take", "head", "words", "block", "spans", "several", "copy", "root")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHES)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "and", "is", "on", "hill", "river", "stone", "green", "walks", "under", "light", "seven", "paper", "window", "open", "slowly"]
    return " ".join(rng.choice(words) + (rng.choice("abcdefgh") * rng.randrange(3)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null, empty, blank and very long texts, repeated rows, ties, clashing columns."""
    long = prose(1, 30_000)
    base = prose(2, 200)
    near = " ".join(base.split()[:100] + ["changed"] + base.split()[101:])
    rows = [(1, base, "en", "a"), (2, near, "en", "a"), (3, base, "en", None), (3, base, "en", None), (4, None, "en", "b"), (5, "", None, "b"), (6, " \n\t ", "en", "b"),
            (7, long, "en", "c"), (None, prose(3, 120), "en", "c"), (None, None, None, None), (8, "a b", "en", "a"), (9, "#*$%& <|>", "en", "a"),
            (10, "line one here\nline one here\n" * 40, "en", "a"), (11, prose(4, 80), "en", "d"), (11, prose(5, 80), "en", "d"), (12, "<|endoftext|>  two  blanks 　 wide\x1c", "en", "d")]
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(CLASHES)) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
