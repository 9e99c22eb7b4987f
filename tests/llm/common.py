"""Edge-case documents and brute-force versions that the operators are held against."""

import random
import re

from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def edge_texts(seed=1, n=60):
    """Null, empty, blank, tiny, very long, repeated and near-equal texts, and odd characters."""
    r = random.Random(seed)
    vocab = ["alpha", "beta", "gamma", "the", "of", "naïve", "straße", "Ünder", "日本", "x1", "don't", "e.g.", "42", "Σας", "<|endoftext|>"]

    def prose(k):
        return " ".join(r.choice(vocab) + r.choice(["", "", ",", ".", "!?", ";\n", " \t"]) for _ in range(k))

    passage = prose(60)
    texts = [None, "", " \n\t ", "one", "one", "a b c d", "a b c d", "\n\nline\nline\n", "é" * 120, "ab" * 400, "<|startoftext|>hi<|endoftext|>"]
    texts += [prose(r.randint(1, 80)) for _ in range(n)]
    texts += [prose(30) + " " + passage + " " + prose(10) for _ in range(6)]
    base = [prose(400).split(" ") for _ in range(3)]
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(r.randint(0, 12)):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w))
    texts += [" ".join(base[0])] * 4
    texts.append(prose(30_000))
    return texts


def frame(spark, texts, parts=3):
    """Documents with extra columns whose names clash with what operators return."""
    rows = [(i, t, f"s{i % 5}", ["en", "fr", None][i % 3], i % 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int").repartition(parts)
    clash = ["n_words", "kept", "score", "id", "class", "label", "shingle", "line", "spans", "shard", "size", "length", "start", "n", "a", "b"]
    return df.withColumns({c: F.lit("x") for c in clash})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars int")


def rows_of(df, key="doc_id"):
    out = {r[key]: r.asDict() for r in df.collect()}
    return out
