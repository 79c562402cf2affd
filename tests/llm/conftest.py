import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts, or from (doc_id, text, lang, source)."""

    def make(rows):
        full = [r if isinstance(r, tuple) else (i, r, "en", "s", None) for i, r in enumerate(rows)]
        full = [(*r, None) if len(r) == 4 else r for r in full]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def prose():
    """Random prose: words of syllables, the same for the same seed."""

    def make(n, seed=0, syllables=("ba", "do", "ri", "mu", "ke", "lo", "ta", "ni", "se", "vu")):
        r = random.Random(seed)
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make
