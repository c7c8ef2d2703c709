import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use for columns of their own.
CLASHING = "row_key gone lines row at key check halves sketches one two shard block tokens order start end found item_id window size score bad host segments prefix a b n".split()


@pytest.fixture()
def make(spark):
    """A table of documents from (doc_id, text[, source]); clash=True adds columns with names of the operators' own."""

    def build(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", *(f"'x' as {c}" for c in CLASHING)) if clash else df

    return build


@pytest.fixture(scope="session")
def prose():
    """Sentences of invented words from a seed."""

    def build(n, seed, vocabulary=400):
        rnd = random.Random(seed)
        words = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru".split() for b in "ban cel dit fon gul lam mer nis pot rud sak tov vil wex zor kip jam hol fer dap quin arg obe ust ilk erm any ope ach eld".split()][:vocabulary]
        return " ".join(rnd.choice(words) for _ in range(n))

    return build
