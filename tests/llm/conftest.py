import pytest


def long_text(n: int, start: int = 0) -> str:
    """n distinct words."""
    return " ".join(f"w{i}x{i * 7 % 1000}" for i in range(start, start + n))


@pytest.fixture
def make(spark):
    """A documents table with columns that operators use inside, to see that names may clash."""

    def of(texts, ids=None, **more):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", f"h{k}", k, k, "x", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, h string, n_lines long, id long, w string, th long")

    return of
