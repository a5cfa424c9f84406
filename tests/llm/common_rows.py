"""Documents that every operator must take: nulls, empty and long texts, ties, repeats, and columns with names of its own."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, text_ string, keep string, h1 long, label string, ids string, score string, n_words string, shard string, n_lines string"


def documents(extra=()):
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["Über", "naïve", "中文", "été"]
    line = "This line is shared by many documents, and it is long enough to count."
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "ONE  two\nthree", "x" * 5000, " ".join(r.choice(words) for _ in range(6000)), "café   nbsp sep", "한국어 text \U0001f600"]
    texts += [" ".join(r.choice(words) for _ in range(r.randint(20, 120))) for _ in range(20)]
    texts += [f"intro {i}\n{line}\n  {line.upper()}\t\nend {i}" for i in range(7)]
    texts += ["an exact copy of a text, here"] * 4 + ["an exact  copy of a\ntext, here"] * 2
    texts += list(extra)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, "no id here"), (3, "one"), (3, "one"), (None, None), (5, "another text of document five"), (12, f"{line}\nanother text of document twelve")]
    rows += [(10_000, " ".join(r.choice(words) for _ in range(12_000)))]
    return [(i, t, "en", "s", len(t or ""), "r", "t", "k", 1, "l", "i", "s", "n", "x", "y") for i, t in rows]


def pages(spark):
    """The same texts as pages, with nulls, repeats and columns whose names operators use themselves."""
    rows = [(i, None if i is None or i % 7 == 1 else f"http://h{i % 3}.example/{i}", None if t is None else f"<p>{t}</p>") for i, t, *_ in documents()]
    return spark.createDataFrame([(*r, "r", "h", "p", "t", "m") for r in rows], "page_id long, url string, html string, row string, host string, taken string, items string, own string")


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
