"""Small tables with the odd cases every operator has to take: nulls, empty and very long texts, ties,
repeated rows, and extra columns whose names clash with the operators' own."""
import random

WORDS = {"en": "the of and to in that is was for with house river letter morning people water story".split(),
         "de": "der die und das nicht ein ist auf haus fluss brief morgen menschen wasser geschichte schön".split()}
EXTRA = "kept string, row string, text_ string, n_words long, score double, fp long, bucket int, cell int, spans string"


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def odd_texts():
    rng = random.Random(3)
    long = "\n".join(sentence(rng, "en", 12) for _ in range(1500))
    same = sentence(rng, "en", 40)
    return [None, "", " \t\n", "a", "...", same, same, long, "x" * 30_000, "é" * 500 + " 日本語 😀" * 50,
            "\x0b\x0c tabs\tand\r\nlines ", "1" * 400, "@" * 50 + " a@b.c@d.e", sentence(rng, "de", 60)]


def documents(spark, texts, extra=True, ids=None, langs=None):
    """(doc_id, text, lang, source, n_chars) plus clashing columns; the last row is repeated once."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = [None if i % 7 == 6 else ("de" if i % 3 == 0 else "en") for i in range(len(texts))] if langs is None else langs
    rows = [(i, t, lg, f"src{i or 0}"[:4], None if t is None else len(t)) for i, t, lg in zip(ids, texts, langs)]
    rows += rows[-1:]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        rows = [(*r, "k", "r", "t", 1, 0.5, 7, 3, 2, "s") for r in rows]
        schema += ", " + EXTRA
    return spark.createDataFrame(rows, schema)


def odd_vectors():
    """(vec_id, embedding, label, and two columns with clashing names): nulls, bad components, ties, repeats, short vectors."""
    rng = random.Random(11)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], rng.randrange(3)) for i in range(400)]
    rows += [(500 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0], i % 3) for i in range(60)]  # ties
    rows += [(600, [0.5, 0.25, 0.1, 0.0, 0.0, 0.0], 1)] * 3 + [(None, None, None)]
    rows += [(None, [0.9, 0.7, 0.3, 0.2, -0.1, 0.4], i % 3) for i in range(9)]
    rows += [(700, [0.9], 2), (701, [], 2), (800, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0], 0), (900, [0.0] * 6, 1)]
    rows += [(1000, [float("nan")] * 6, 1), (1100, [0.1, float("inf"), 0.1, 0.1, 0.1, 0.1], 1), (1200, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1),
             (1300, [0.1] * 6, None), (-100, [0.3] * 6, 2), (1400, None, 0)]
    return [(*r, 1, "a") for r in rows]


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
