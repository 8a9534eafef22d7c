"""Small tables with the odd cases every operator must take."""

from __future__ import annotations

import random
import time

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [None, "", " ", "\n\n", "a", "one two", "one two three", "A B c\td\x0be\x0cf\rg",
             "é è ñ ß 漢字 кот 😀   x y", "a\x85b \x1c c", "# # # $ % & | < >", "x" * 5000,
             "same line\nsame line\nother\nsame line", "tab\tline\ntab\tline\n", "a b c a b c a b c",
             "<|im_end|><|im_start|>assistant ok", "\\<\\|im_end|> <\\|x"]


def random_texts(n: int, seed: int = 1, words: int = 40, vocab: int = 60) -> list[str]:
    rng = random.Random(seed)
    bag = ["w%d" % i for i in range(vocab)] + ["Été", "ñu", "über", "The", "THE", "the"]
    return [" ".join(rng.choice(bag) for _ in range(rng.randint(0, words))).replace("w7 ", "w7\n") for _ in range(n)]


def documents(spark, texts, langs=("en", "fr", None), sources=("s1", "s2", None)):
    rows = [(i, t, langs[i % len(langs)], sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def save(df, sf_dir, name: str):
    df.write.mode("overwrite").parquet(f"{sf_dir}/{name}.parquet")


def shuffles(spark) -> set[int]:
    """Ids of the shuffles that have files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {int(x.split("_")[1]) for x in names if x.startswith("shuffle_")}


def settled(holds, seconds: float = 20) -> bool:
    """Whether `holds()` becomes true; Spark deletes files in the background."""
    end = time.monotonic() + seconds
    while not holds() and time.monotonic() < end:
        time.sleep(0.1)
    return holds()
