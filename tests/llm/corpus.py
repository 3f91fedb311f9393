"""Small documents with every awkward case, and words to make more."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 7))) for _ in range(n)]


def texts(seed: int = 1) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, self repeats, blanks, nulls, a long text, repeated rows."""
    rng = random.Random(seed)
    base = [words(rng, rng.choice([5, 40, 120, 300])) for _ in range(24)]
    passage, short = words(rng, 60), words(rng, 34)
    out = [" ".join(x) for x in base]
    out += [out[3]] * 3
    for i in (1, 2, 5, 7):
        near = list(base[i])
        for _ in range(max(1, len(near) // 60)):
            near[rng.randrange(len(near))] = "edit" + str(i)
        out.append(" ".join(near))
        out.append("\n".join(near[: len(near) // 2]) + "  " + " ".join(passage) + "\t" + " ".join(near[len(near) // 2 :]))
    out.append(" ".join(base[9] + passage + passage))
    out.append(" ".join(base[10] + short))
    out.append(" ".join(base[11] + short))
    out.append("über " * 50 + " ".join(base[4]))
    out.append("x" * 900)
    out.append("ab" * 500 + "é" * 300)
    out.append(" ".join(words(rng, 9000) + base[6]))
    out += ["", " \n\t ", None, "one", "A b C", "a B c"]
    rows = [(i, t) for i, t in enumerate(out)]
    rows += [(3, out[3]), (None, out[5]), (None, None), (2, "same id, other text")]
    return rows


def frame(spark, rows, parts: int = 3):
    data = [(i, t, ["en", "de", None][n % 3], f"src{n % 4}", len(t) if t else None) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)
