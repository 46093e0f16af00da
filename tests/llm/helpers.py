"""Small tables with every hard case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string, digest string, bucket string, kept boolean"
SYLLABLES = {"en": "th er an in on re ed nd ou ing ly".split(), "de": "sch ung ver lich ein auf heit zu".split(), "fr": "eau ment que tion ou aire le".split(), "es": "ción mente ado os ar ía ll".split()}


def prose(rng, lang, n):
    def word():
        return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))

    return " ".join(word() for _ in range(n)).capitalize() + "."


def rows(n=160, seed=5):
    """(doc_id, text, lang, quality, toxic)."""
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text, quality, toxic = prose(rng, lang, rng.randint(60, 200)), 1, 0
        if i % 5 == 1:
            text, quality = " ".join(w + rng.choice([" | ", "###", "$$$ "]) for w in text.split()), 0
        elif i % 5 == 2:
            words = text.split()
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(["idiotz", "moronz", "scumz"]))
            text, toxic = " ".join(words), 1
        out.append((i, text, lang, quality, toxic))
    for i in range(0, 20, 4):
        out.append((n + i, out[i][1], out[i][2], out[i][3], out[i][4]))  # copies
        out.append((n + i + 1, out[i][1].replace(" ", "\n ", 3), None, None, None))  # the same but for white space
        out.append((n + i + 2, out[i][1][0].lower() + out[i][1][1:], None, None, None))  # a near copy
    odd = [None, "", "  \t\n", "7 7 7", "one", "one two", "éİ中 \U0001f600 x y", "<|endoftext|> a<|endoftext|>", "a\0b", "z" * 70000, "la " * 30000]
    return out + [(5000 + i, t, None, None, None) for i, t in enumerate(odd)]


def documents(spark, table=None):
    data = [(i, t, lang, None, 1, 7, "w", "d", "b", False) for i, t, lang, *_ in (rows() if table is None else table)]
    return spark.createDataFrame(data, SCHEMA).repartition(3, "doc_id")


def labels(spark, table=None):
    return spark.createDataFrame([(i, q, t) for i, _, _, q, t in (rows() if table is None else table) if q is not None] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
