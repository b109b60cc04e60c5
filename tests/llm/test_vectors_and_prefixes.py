"""Nearest neighbours, whitening and the trie of prefixes: odd rows, empty tables, and brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("framelake.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from framelake.llm import nearest, prefix_trie, whiten  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int, query_id long"


def vector_rows(n=600, width=24, seed=3):
    """Clustered and free vectors of unlike lengths, a crowd of equals, and every odd case."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, width))
    x = (centres[rng.integers(0, 5, n)] * (rng.random(n) < 0.5)[:, None] + rng.standard_normal((n, width))) * rng.gamma(4, 0.25, n)[:, None]
    x[100:140] = x[100]
    rows = [(i, [float(np.float32(v)) for v in row], 0, 0.5, 1, 2) for i, row in enumerate(x)]
    odd = [None, [0.0] * width, [None] * width, [float("nan")] * width, [float("inf")] * width, [1.0] * (width - 1), []]
    return rows + [(10000 + 20 * i, v, None, None, None, None) for i, v in enumerate(odd)] + [(None, rows[0][1], 1, 1.0, 1, 1), rows[20], rows[21]]


def usable(rows, key=True, zero=False):
    width = max(len(r[1]) for r in rows if r[1])
    fine = lambda v: v is not None and len(v) == width and None not in v and np.isfinite(v).all() and (zero or np.any(v))
    kept = [r for r in rows if fine(r[1]) and (not key or r[0] is not None)]
    return [r[0] for r in kept], np.array([r[1] for r in kept], float)


@pytest.mark.parametrize("cell_bytes,part", [(nearest.CELL_BYTES, nearest.PART), (24 * 4 * 16, 5)])
def test_nearest_neighbours(spark, monkeypatch, cell_bytes, part):
    """Also with many small cells and many parts of queries."""
    monkeypatch.setattr(nearest, "CELL_BYTES", cell_bytes)
    monkeypatch.setattr(nearest, "PART", part)
    rows = vector_rows()
    got = nearest.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect()
    ids, x = usable(rows)
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    assert set(by) == {i for i in ids if i % 20 == 0}
    hit = 0
    for q, found in by.items():
        copies = ids.count(q)
        found.sort(key=lambda r: (r["rank"], r.vec_id))
        assert [r["rank"] for r in found] == [1 + i // copies for i in range(20 * copies)]
        at = ids.index(q)
        score = (x * x[at]).sum(1)
        own = {i: s for j, (i, s) in enumerate(zip(ids, score, strict=True)) if j != at}
        assert all(abs(own[r.vec_id] - r.score) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found[::copies]] == sorted((-r.score, r.vec_id) for r in found[::copies])
        best = sorted(((-s, i) for j, (i, s) in enumerate(zip(ids, score, strict=True)) if j != at))[:20]
        hit += len({i for _, i in best} & {r.vec_id for r in found})
    assert hit >= 0.9 * 20 * len(by)


def test_nearest_of_few_and_none(spark):
    some = spark.createDataFrame([(0, [1.0, 0.0], 1, None, None, None), (1, [0.5, 2.0], 1, None, None, None), (2, [2.0, 2.0], 1, None, None, None), (40, [0.0, -1.0], 1, None, None, None)], VECTORS)
    got = sorted(map(tuple, nearest.search(some, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 0.5), (0, 3, 40, 0.0), (40, 1, 0, 0.0), (40, 2, 1, -2.0), (40, 3, 2, -2.0)]
    for few in (some.limit(1), some.limit(0), some.where("vec_id = 1")):
        assert nearest.search(few, F.col("vec_id") % 20 == 0).count() == 0


def test_survivors_hold_all_that_a_full_scan_finds():
    rng = np.random.default_rng(5)
    q, x = rng.standard_normal((7, 64)).astype(np.float32), rng.standard_normal((500, 64)).astype(np.float32)
    far = np.square(q[:, None] - x).sum(2)
    limit = np.quantile(far, 0.02, axis=1)[:, None] + np.zeros_like(far)
    blocks = [(slice(None), slice(a, b)) for a, b in nearest.column_blocks(64)]
    got = set(zip(*map(np.ndarray.tolist, nearest.survivors([q[b] for b in blocks], [x[b] for b in blocks], limit)), strict=True))
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(far < limit * 0.9999)), strict=True))
    assert got <= set(zip(*map(np.ndarray.tolist, np.nonzero(far <= limit * 1.0001)), strict=True))
    assert len(got & want) >= 0.95 * len(want)


def test_whitening_against_a_dense_solver(spark):
    rows = vector_rows(width=12)
    got = whiten.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    ids, c = usable(rows, key=False, zero=True)
    x = np.floor(1024 * c).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    far, apart = ((n * x - s) ** 2).sum(1), (n * x - s) / n
    value, vector = np.linalg.eigh(apart.T @ apart / n)
    value, vector = value[::-1][:8], vector[:, ::-1][:, :8]
    white = apart @ vector / np.sqrt(value)
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    want = sorted((str(i), k + 1, int(d), round(abs(float(w)), 7)) for i, d, row in zip(ids, far, white, strict=True) for k, w in enumerate(row))
    assert sorted((str(r.vec_id), r.component, r.deviation, round(abs(r.whitened), 7)) for r in got) == want
    explained = {r.component: r.explained for r in got}
    assert np.allclose([explained[k] for k in range(1, 9)], value / np.trace(apart.T @ apart / n), rtol=1e-9)


def test_whitening_of_few_and_none(spark):
    row = lambda i, v: (i, v, None, None, None, None)
    flat = [row(i, [0.25 * i, 1.0, -0.5 * i]) for i in range(5)]
    got = whiten.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert {(r.component, round(r.explained, 9)) for r in got} == {(1, 1.0)} and len(got) == 5  # rank one
    assert sorted(round(abs(r.whitened), 6) for r in got) == [0.0, 0.707107, 0.707107, 1.414214, 1.414214]
    for none in ([], [row(1, [1.0, 2.0])], [row(1, [1.0, 2.0])] * 3, [row(1, None), row(2, []), row(3, [None])]):
        assert whiten.whiten(spark.createDataFrame(none, VECTORS)).count() == 0
    huge = spark.createDataFrame([row(1, [2.0**40, 0.0]), row(2, [-(2.0**40), 1.0]), row(3, [2.0**43, 0.0])], VECTORS)
    assert {(r.vec_id, r.n, r.deviation) for r in whiten.whiten(huge).where("component = 1").collect()} == {(1, 2, None), (2, 2, None)}


@pytest.mark.parametrize("spectrum", [[9, 9, 9, 9, 1, 1], [5.0] * 6, [1e6, 1e3, 1, 1e-3, 1e-6, 1e-7], [3, 2, 1, 0, 0, 0], [4, 4 - 1e-9, 2, 2, 1, 1]])
def test_components_of_equal_close_and_vanishing_eigenvalues(spark, spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(8).standard_normal((6, 6)))
    v = q * np.array(spectrum, float) @ q.T
    value, x = whiten.leading(spark, v, 4)
    want = [s for s in sorted(spectrum, reverse=True)[:4] if s > 0]
    assert np.allclose(value, want, rtol=1e-9, atol=1e-10 * max(spectrum)) and np.allclose(x.T @ x, np.eye(len(value)), atol=1e-11)
    assert np.abs(v @ x - x * value).max() < 1e-9 * max(spectrum)


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    value = np.sort(np.linalg.eigvalsh(a))[::-1]
    t = whiten.tridiagonal(a)
    assert [whiten.above(*t, p) for p in (-100, 0, 100)] == [20, int((value > 0).sum()), 0]
    assert np.allclose([whiten.eigenvalue(*t, k) for k in range(1, 21)], value, atol=1e-10)
    assert sum(m for *_, m in whiten.intervals(*t, 8)) >= 8


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth long, name string, conv long"


def conversation_rows():
    rows = [(c, t, "user" if t % 2 else "system", f"turn {t} of {'a' if c % 3 else 'b'} {'x ' * (c % 5)}") for c in range(100) for t in range(c % 9)]
    rows += [(c, t, "user", f"same words {t}") for c in (140, 141, 142, 150, 161) for t in range(37)]  # long ones alike, one without its head's
    rows += [(200, None, None, None), (200, None, "user", ""), (200, 3, "", "a\tb\x0bc"), (201, 1, "user", None), (-40, 1, "user", "below zero"), (-41, 0, "x", "y"), (None, 1, "user", "nobody's")]
    rows += [(300, 1, "user", "twice"), (300, 1, "user", "twice"), (300, 1, "assistant", "tie"), (301, 1, "user", "w " * 100000), (302, 1, "user", "1:a"), (302, 2, "user1", ":a")]
    return [(*r, 1, "n", 2) for r in rows]


def trie(rows):
    conv = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append(((t is not None, t or 0, r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]), (r, x)))
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(conv):
        h, donor = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c > 0 else -1)
        turns = [t for _, t in sorted(conv.get(donor, []))[:h] + sorted(conv[c])[h:]]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        children[p[:-1]] += bool(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def test_prefix_trie_against_brute_force(spark):
    rows = conversation_rows()
    got = sorted(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()), key=lambda r: r[:2])
    assert got == sorted(trie(rows), key=lambda r: r[:2])
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([rows[-1]], CONVERSATIONS)).count() == len(trie([rows[-1]]))
    alone = [(22, 1, "user", "no one's head", None, None, None)]  # the whole of it is cut off: a root that it ends at
    assert [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(alone, CONVERSATIONS)).collect()] == trie(alone) and len(trie(alone)) == 1
