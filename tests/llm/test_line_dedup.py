import hashlib
import random
from collections import defaultdict
from itertools import combinations

import pytest

from terralith.llm import line_dedup as ld

from .cases import SCHEMA, rows, table


class Tie(Exception):
    """Several longest runs: the result is not unique."""


def plain_patience(a, b, i=0, j=0):
    """By recursion, with all rising runs of unique common elements spelled out."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(i, j), *plain_patience(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    common = [(a.index(x), k) for k, x in enumerate(b) if a.count(x) == 1 and b.count(x) == 1]
    if not common:
        return []
    runs = [r for n in range(1, len(common) + 1) for r in combinations(common, n) if all(x[0] < y[0] for x, y in zip(r, r[1:]))]
    longest = max(map(len, runs))
    best = [r for r in runs if len(r) == longest]
    if len(best) > 1:
        raise Tie
    out, p, q = [], 0, 0
    for x, y in [*best[0], (len(a), len(b))]:
        out += plain_patience(a[p:x], b[q:y], i + p, j + q)
        if x < len(a):
            out.append((i + x, j + y))
        p, q = x + 1, y + 1
    return out


def brute(data, rare, least):
    space = b" \t\n\x0b\f\r"
    docs = [(r[0], None if r[1] is None else r[1].encode().split(b"\n") if r[1] else []) for r in data]
    df, first = defaultdict(int), {}
    for d, lines in docs:
        if d is not None:
            for x in {x.strip(space) for x in lines or []} - {b""}:
                df[x] += 1
                first[x] = min(first.get(x, d), d)
    out = []
    for d, lines in docs:
        lines = lines or []
        keys = [x.strip(space) for x in lines]
        shared = [x for x in set(keys) - {b""} if df[x] > 1] if d is not None else []
        limit = max(rare, min((df[x] for x in shared), default=0))
        gone = set()
        for p in {first[x] for x in shared if df[x] <= limit}:
            if p < d:
                for e, theirs in docs:
                    if e == p:
                        pairs = ld.patience([x.strip(space) for x in theirs or []], keys)
                        blocks = []
                        for i, j in pairs:
                            if blocks and blocks[-1][-1] == (i - 1, j - 1):
                                blocks[-1].append((i, j))
                            else:
                                blocks.append([(i, j)])
                        for block in blocks:
                            if sum(len(keys[j].split()) for _, j in block) >= least:
                                gone |= {j for _, j in block}
        out.append((d, len(lines), len(gone), b"\n".join(x for j, x in enumerate(lines) if j not in gone).decode()))
    return sorted(out, key=str)


def passages(seed, n=100):
    r = random.Random(seed)
    pool = [f"line {i} of text" for i in range(60)] + ["", " ", "license all rights reserved"]
    out = []
    for i in range(n):
        lines = [r.choice(pool) for _ in range(r.randrange(12))]
        if out and r.random() < 0.6:
            lines = [x for x in (r.choice(out)[1] or "").split("\n") if r.random() < 0.9] + lines[:2]
        if i % 3 == 0:
            lines.append("license all rights reserved")
        out.append((i, "\n".join(lines), "", "", 0, 0, ""))
    return out


@pytest.mark.parametrize(("seed", "rare", "least"), [(1, 16, 1), (2, 3, 1), (3, 1, 4)])
def test_brute_force(spark, seed, rare, least):
    data = passages(seed)
    got = ld.deduplicate(spark.createDataFrame(data, SCHEMA).repartition(3), rare, least)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(data, rare, least)


def test_odd_rows_and_digest(spark):
    want = brute(rows(), ld.RARE, ld.LEAST_WORDS)
    assert sorted((tuple(r) for r in ld.deduplicate(table(spark)).collect()), key=str) == want
    got = ld.deduplicate(table(spark), digest=True).collect()
    assert {(r.doc_id, r.kept) for r in got} == {(d, hashlib.sha256(t.encode()).hexdigest()) for d, _, _, t in want}


def test_patience_is_a_rising_match_and_takes_unique_lines():
    r = random.Random(5)
    for _ in range(300):
        a = [r.randrange(8) for _ in range(r.randrange(12))]
        b = [r.randrange(8) for _ in range(r.randrange(12))]
        got = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p < q and s < t for (p, s), (q, t) in zip(got, got[1:]))
        try:
            want = plain_patience(a, b)
        except Tie:
            continue
        assert got == want
    assert ld.patience([1, 2, 3, 9, 4], [9, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]


def test_copies_of_any_number_are_found(spark):
    data = [(i, f"same first line\nsame second line\n{'' if i else 'own'}", "", "", 0, 0, "") for i in range(60)]
    got = ld.deduplicate(spark.createDataFrame(data, SCHEMA), rare=2).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: 0 if not i else 2 for i in range(60)}


def test_copies_that_share_other_lines_too_are_found(spark):
    n = 40
    data = [(i, f"outside {i} a\nother line {i}", "", "", 0, 0, "") for i in range(n)]
    data += [(100 + i, f"first of group\nsecond of group\nown {i}\nother line {i}", "", "", 0, 0, "") for i in range(n)]
    # A line whose first holder is the document itself, and a passage of many holders beside it.
    data += [(200, "passage a\npassage b\nrare line", "", "", 0, 0, ""), (300, "rare line", "", "", 0, 0, "")]
    data += [(150 + i, f"mine {i}\npassage a\npassage b", "", "", 0, 0, "") for i in range(n)]
    got = {r.doc_id: (r.n_removed, r.kept) for r in ld.deduplicate(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(got[i][0] == 0 for i in range(n))
    assert got[100] == (1, "first of group\nsecond of group\nown 0")
    assert all(got[100 + i] == (3, f"own {i}") for i in range(1, n))
    assert got[150][0] == 0 and all(got[150 + i] == (2, f"mine {i}") for i in range(1, n))
    assert got[200] == (2, "rare line") and got[300] == (1, "")


def test_empty_table(spark):
    assert ld.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_that_many_have_change_nothing(spark, monkeypatch):
    want = sorted(map(str, ld.deduplicate(table(spark)).collect()))
    for hot in (1, 3, 10**9):
        monkeypatch.setattr(ld, "HOT", hot)
        assert sorted(map(str, ld.deduplicate(table(spark)).collect())) == want
