"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing extra columns."""
import random

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, host string, sid long, word string"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split())
                    + str(rng.randrange(40)) for _ in range(n))


def texts():
    rng = random.Random(4)
    base = [sentence(rng, 120) for _ in range(6)]
    words = base[0].split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    chain = " ".join(words[:60] + ["changed"] + words[61:100] + ["other"] + words[101:])
    long = sentence(rng, 30_000)
    rows = [(1, base[0]), (2, base[0]), (3, near), (4, chain), (5, base[1]), (6, base[1].upper()), (7, ""), (8, None), (9, "   \n\t"), (10, "one"), (11, "ONE"), (12, "one two"),
            (13, base[2]), (None, base[2]), (None, None), (14, long), (15, long + " tail"), (16, base[3]), (16, base[3]), (17, base[4] + " " + base[5]), (18, base[5]), (19, "naïve é ß"), (20, "a b c d e")]
    return [(i, t, None, None if i is None else f"src{i % 3}", None, 1.0, "h", 5, "w") for i, t in rows]


def documents(spark, rows=None):
    return spark.createDataFrame(texts() if rows is None else rows, SHAPE)


def rows_of(df, *columns):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
