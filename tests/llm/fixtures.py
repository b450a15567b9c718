"""Small documents with every odd case, and the helpers of the tests of this folder."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

#: names that the operators use for their own columns
CLASHING = ["id", "doc", "score", "n_lines", "n_dropped", "row", "shard", "slot", "fp0", "node", "component", "length", "_own", "drop", "key"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile("[\x20\x09-\x0d]+")
WORDS = "alpha beta gamma delta the of and river stone light Über naïve 日本 zeta".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + str(rng.randrange(200)) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "\n", "\t"]) for w in words)


def rows() -> list[tuple]:
    base = prose(1, 120)
    texts = [
        (1, base), (2, base), (3, base.replace("\t", "  ")), (4, prose(2, 80)), (5, ""), (6, None), (7, " \t\n\x0b\x0c\r "), (8, "one"),
        (9, "A shared line of text\nOwn line number nine\n  a SHARED line of text\t\nshort\nshort"), (10, "a shared line of text\nshort\n\n"),
        (10, "a shared line of text\nshort\n\n"), (11, "a shared line of text"), (11, prose(3, 30)), (12, prose(4, 9000)), (13, "x" * 30_000),
        (None, "a shared line of text"), (None, prose(5, 40)), (None, None), (14, "ÄÖÜ äöü ß line with more"), (15, base[: len(base) // 2]),
        (16, base.replace("alpha", "omega", 1)), (17, "Same Case line here"), (18, "same case line here"), (19, "İstanbul Σίσυφος"), (20, "a\r\nb\r\n"),
        (-3, "a shared line of text\nnegative id"), (21, "日本語のテキスト、十文字以上の行\n別の行"), (22, "日本語のテキスト、十文字以上の行"),
    ]
    return [(i, t, "en" if t else None, None, len(t) if t else None) for i, t in texts]


def odd_documents(spark, clashing: bool = True):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else docs


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, folder, **tables) -> str:
    """Writes tables into ``folder`` and returns it as an input folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def brute_words(text: str | None) -> list[str]:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in SPACES.split(lower) if w]
