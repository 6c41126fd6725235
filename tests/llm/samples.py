"""Small tables with every odd row the operators promise to handle."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use themselves.
    "score string, component string, chunk string, size string, key string, spans string, rep string"
)
EXTRA = ("x",) * 7
SYLLABLES = {
    "en": "the th in er on an re he ing tion ed ly sh".split(),
    "de": "ein ich sch und ung keit er en ge be ver zu".split(),
    "es": "que ción de la el os as ar es ía ñ mente".split(),
}


def prose(rng: random.Random, lang: str = "en", words: int = 120) -> str:
    text = []
    for i in range(words):
        word = "".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3)))
        text.append(word + (".\n" if i % 11 == 10 else ""))
    return " ".join(text)


def texts(count: int = 60, seed: int = 1) -> list[str]:
    """Prose with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    shared = prose(rng, "en", 40)
    result = []
    for i in range(count):
        kind = i % 6
        if kind == 3 and result:
            result.append(rng.choice(result))
        elif kind == 4 and result:
            words = rng.choice(result).split(" ")
            words[rng.randrange(len(words))] = "changed"
            result.append(" ".join(words))
        else:
            text = prose(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 200))
            result.append(text + shared if kind == 5 else text)
    return result


def rows(count: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    plain = [
        (i, text, rng.choice(list(SYLLABLES)), f"src{rng.randrange(4)}", len(text), *EXTRA)
        for i, text in enumerate(texts(count, seed))
    ]
    long = prose(random.Random(9), "de", 30_000)
    return [
        *plain,
        (1000, None, "en", "src0", None, *EXTRA),
        (1001, "", None, None, 0, *EXTRA),
        (1002, " \n\t", "en", "src1", 3, *EXTRA),
        (1003, "12 345 !?", None, "src1", 9, *EXTRA),
        (1004, long, "de", "src0", len(long), *EXTRA),
        (1005, long, "de", None, len(long), *EXTRA),
        (1006, "word", "en", "src2", 4, *EXTRA),
        (1006, "word", "en", "src2", 4, *EXTRA),
        (None, "a row without an id", "en", "src2", 19, *EXTRA),
        (1007, "Ünïcödé ß " * 30, "de", "", 300, *EXTRA),
        (1008, "x" * 5000, None, "src3", 5000, *EXTRA),
    ]


def documents(spark, count: int = 60, seed: int = 1, partitions: int = 5):
    return spark.createDataFrame(rows(count, seed), SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
