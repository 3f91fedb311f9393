import re

from lamella.llm.decontaminate import decontaminate
from tests.llm.corpus import frame, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in rows:
        w, own = split(text), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    own |= found
                    hit[i : i + n] = [True] * n
        out.append((doc, len(w), sum(hit), sorted(own), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=repr)


def cases():
    rows = texts(3)
    long = rows[1][1].split()
    items = [(5, " ".join(long[2:40]).upper()), (40, "one"), (7, " ".join(long[10:23])), (7, "ab?cd"), (8, None), (9, "..."), (None, rows[4][1]), (11, "Über über"), (12, " ".join(rows[7][1].split()[:5]))]
    rows += [(100, "pre " + " ".join(long[2:40]) + " post"), (101, "a" * 40 + " " + " ".join(long[3:16])), (102, "ÜBER über-über"), (103, "ab. cd ab cd")]
    return rows, items


def check(spark, **more):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(frame(spark, rows), bench, **more)
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()), key=repr), brute(rows, items)


def test_against_brute_force(spark):
    got, want = check(spark)
    assert got == want


def test_benchmark_in_slices(spark):
    got, want = check(spark, slice_chars=60)
    assert got == want


def test_empty(spark):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate(frame(spark, rows).limit(0), bench).count() == 0
    assert not decontaminate(frame(spark, rows), bench.limit(0)).where("n_hit > 0 or contaminated").count()
