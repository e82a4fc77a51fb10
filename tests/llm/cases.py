"""Small tables for the text operators: nulls, empty texts, repeats, ties, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string"


def texts(n=60, seed=3):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "eps'lon", "it's", "x1", "42", "ΣΑΣ", "a", "the", "of", "!!", "<|endoftext|>", "naïve", "éa", "漢字", " b"]
    long = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(3000))
    out = [None, "", " \t\n\x0b\f\r", "one", "one two", "ONE  two\n", long, long + " tail", "x" * 5000, long.replace(" ", "")[:9000]]
    while len(out) < n:
        k = r.choice([1, 2, 3, 5, 13, 30, 80])
        t = r.choice([" ", "\n", "\t", "  "]).join(r.choice(words) + r.choice(["", ".", ",", str(r.randrange(9))]) for _ in range(k))
        out.append(t)
        if r.random() < 0.3:
            out.append(t)
        if r.random() < 0.3:
            out.append(t + "\n extra")
    return out[:n]


def rows(n=60, seed=3):
    out = []
    for i, t in enumerate(texts(n, seed)):
        source = None if i % 11 == 5 else "hot" if i % 3 == 0 else f"s{i % 5}"
        out.append((i, t, None if i % 7 == 0 else "en", source, None if t is None else len(t), -i, "clash"))
    out.append(out[5])
    out.append((None, "no id", None, None, 5, 0, None))
    return out


#: Every name that an operator uses within, as columns of a user.
INNER = "_id _sha _nth id sha own_sha nth _key _take _text _size key take text_ size_ total same own _same _own _t _s _w _q _keep keep recipe r group_size keep_id kept first n_points norm chunk taken target source_size bucket buckets epochs rest e_bucket b_before b_size b_rest weight w cap level capped turn n_rows d1 d2 tree blocks mine with task side rep n a b node component key_ which held_out score predicted".split()


def clashing(spark, n=60):
    """The table with a column of each of those names, which holds its own name and the row's doc_id."""
    from pyspark.sql import functions as F

    return table(spark, n).select("doc_id", "text", "lang", "source", "n_chars", *[F.concat_ws(" ", F.lit(c), F.col("doc_id")).alias(c) for c in INNER])


def unchanged(got):
    return all(r[c] == c + ("" if r.doc_id is None else f" {r.doc_id}") for r in got.collect() for c in INNER)


def table(spark, n=60, seed=3):
    return spark.createDataFrame(rows(n, seed), SCHEMA).repartition(3)


def alternating(n, swap=False):
    """A word of n bytes, n a power of two, whose two swaps of a and b agree under every polynomial hash modulo 2**64 from 1 kB on."""
    s = "b" if swap else "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def look_alikes():
    """Documents of such words: none shares a window of 13 words, and no pair is nearer than 8 shingles of 14."""
    out = []
    for i, n in enumerate((1024, 2048, 4096)):
        for swap in (False, True):
            words = [alternating(n, swap) if k in (6,) else f"w{i}x{k}" for k in range(13)]
            out.append((10 * i + swap, " ".join(words), "en", "s", 0, 0, ""))
    out.append((103, "unseen " + alternating(2048, True) + " end", "en", "s", 0, 0, ""))
    return out
