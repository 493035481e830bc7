"""Small awkward tables for the corpus operators."""

import random

WORDS = "the of and to in that is was for on with as by at from it an be this which or but not are".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS) + r.choice(["", "", "ing", "er", "tion"]) for _ in range(n)]
    return " ".join(w.capitalize() + ("." if i % 9 == 8 else "") if i % 9 == 0 else w + ("." if i % 9 == 8 else "") for i, w in enumerate(out))


LONG = "\n".join(prose(1000 + i, 60) for i in range(300))
#: doc_id, text: nulls, empties, white space only, marks only, repeated rows, a very long text, odd code points.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t\n "), (4, "!!! ... ???"), (5, "one"), (6, prose(6, 40)), (7, prose(6, 40)), (7, prose(6, 40)), (8, LONG), (9, LONG + " end"),
    (10, "Ünï cödé ﬁ 漢字 😀́ \x00 ǅ ΣΑΣ"), (11, prose(11, 4)), (12, prose(12, 500)), (None, prose(13, 30)), (None, None), (14, "a" * 5000), (15, "  lead\n\n\nlines  "),
]
SCHEMA = "doc_id long, text string"
#: Names that operators use inside.
CLASHING = "doc_id long, text string, id long, n long, key string, node long, score double, lines string, ids string, r string, c string, kept boolean"


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def clashing(spark):
    rows = [(d, t, 9, 9, "k", 9, 9.0, "l", "i", "r", "c", None) for d, t in AWKWARD]
    return spark.createDataFrame(rows, CLASHING)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *columns):
    """Rows as a sorted list of tuples, nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, str(type(x)), x if x is not None else 0) for x in r])
