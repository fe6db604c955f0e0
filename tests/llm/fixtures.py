"""Small tables with the awkward rows every corpus operator must take."""

import random


def awkward_docs(spark, n=40, seed=3):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Été", "naïve", "x", "日本語", "word,", "end."]
    base = " ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(120))
    rows = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            text = base
        elif kind == 1:
            parts = base.split()
            for _ in range(rnd.randrange(1, 6)):
                parts[rnd.randrange(len(parts))] = f"edit{i}_{rnd.randrange(99)}"
            text = " ".join(parts)
        elif kind == 2:
            text = None if i % 16 == 2 else ""
        elif kind == 3:
            text = " \n\t "
        elif kind == 4:
            text = "one two three"
        elif kind == 5:
            text = "\n".join(" ".join(rnd.choice(words) + str(rnd.randrange(999)) for _ in range(30)) for _ in range(4))
        elif kind == 6:
            text = f"{base}  double  blanks\n \n{i} 😀 <|endoftext|>"
        else:
            text = " ".join(f"w{i}_{j}" for j in range(3000 if i == 7 else 50))
        rows.append((i * 3, text, "en", "s", 0 if text is None else len(text), 1, "clash"))
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, key_a string").repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
