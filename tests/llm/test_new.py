"""Operators 11 to 13 against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyweir.llm import embeddings, manifest, periodic, queries
from pyspark.sql import functions as F


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ----------------------------------------------------------------------------------------------------


def brute_runs(w, least=12):
    spans = {}
    for p in range(1, len(w) // 2 + 1):
        x = 0
        while x + p < len(w):
            a = x
            while x + p < len(w) and w[x] == w[x + p]:
                x += 1
            if x - a >= p and x - a + p >= least:
                spans.setdefault((a, x + p), p)
            x += 1
    return sorted(((a, e - a, p) for (a, e), p in spans.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    w, n = [x.decode() for x in w], len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_of_words_against_brute_force():
    random.seed(5)
    for k in range(2500):
        n, letters = random.randint(0, 80), random.choice([1, 2, 3, 6])
        w = [random.randrange(letters) for _ in range(n)]
        if k % 2 and n > 4:
            s = random.randrange(n)
            p = random.randint(1, max(1, (n - s) // 2))
            w[s:] = [w[s + i % p] for i in range(n - s)]
        assert periodic.runs_of(w) == brute_runs(w), w
    thue = [bin(i).count("1") % 2 for i in range(3000)]
    assert periodic.runs_of(thue) == brute_runs(thue)
    assert periodic.runs_of(["x"] * 100_000) == [(0, 100_000, 1)]


def test_colliding_hashes_give_no_wrong_run(monkeypatch):
    monkeypatch.setattr(periodic, "_mixed", lambda ids: (ids % 2).astype(np.uint64))
    random.seed(6)
    for _ in range(300):
        w = [random.randrange(4) for _ in range(40)]
        assert set(periodic.runs_of(w)) <= set(brute_runs(w)) | {(s, n, q) for s, n, q in brute_runs(w)}


def test_periodic_query_against_brute_force(spark, folder, tmp_path):
    odd = [(None, "a " * 30), (7, None), (8, ""), (9, " \n"), (10, "a b " * 3000 + "c"), (10, "a b " * 3000 + "c"), (10, "a"), (11, "é a b é a b " * 9)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    given = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs.unionAll(given).withColumn("row", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    expected = [brute_row(r.doc_id, r.text) for r in docs.collect()] + [brute_row(r.doc_id, r.text) for r in given.collect() if len((r.text or "").split()) < 1200]
    short = {(e[0], e[-1]) for e in expected}
    assert sorted(map(str, (tuple(r) for r in rows if (r.doc_id, r.collapsed_sha256) in short))) == sorted(map(str, expected))
    assert len(rows) == len(odd) + given.count()


def test_periodic_operator_on_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 8, "x", 2)], "runs int, text string, row string, collapsed int")
    found = periodic.periodic_runs(docs).first()
    assert found.row.asDict() == {"runs": 1, "row": "x", "collapsed": 2} and found.collapsed == "a b"
    assert [tuple(r) for r in found.runs] == [(0, 16, 2)] and found.n_words == 16
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


# --- Merkle manifest --------------------------------------------------------------------------------------------------


def brute_manifest(rows, arity=3, tamper=lambda doc_id: False):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def climb(nodes):
        """The root, and per node its path as pairs of texts."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            runs = [level[i : i + arity] for i in range(0, len(level), arity)]
            for k, place in enumerate(at):
                run, slot = runs[place // arity], place % arity
                paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
                at[k] = place // arity
            level = [sha("".join(run)) for run in runs]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], sha("".join(map(field, r))), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        members = sorted(groups[name], key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
        trees[name] = (members, *climb([m[1] for m in members]))
    root, upper = climb([trees[name][1] for name in names])
    out = []
    for name, above in zip(names, upper, strict=True):
        members, subroot, paths = trees[name]
        for (doc_id, leaf, r), path in zip(members, paths, strict=True):
            whole = path + above
            digest = leaf
            if tamper(doc_id):
                digest = sha("".join(map(field, (*r[:4], None if r[4] is None else r[4].replace("\n", "")))))
            for before, after in whole:
                digest = sha(before + digest + after)
            out.append((doc_id, leaf, subroot, root, sha("".join(b + a for b, a in whole)), digest, digest == root))
    return out


def even(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0


def test_manifest_query_against_brute_force(spark, folder, tmp_path):
    odd = [(None, None, None, None, None), (None, "s", "en", 3, "x\ny"), (5, "", "en", 1, ""), (5, "", "en", 1, ""), (5, "", "en", 2, "é\n" * 2000)]
    odd += [(1000 + i, "hot", "de", i, f"line\n{i}") for i in range(500)] + [(3, "Z", None, 1, "a"), (4, "é", None, 1, "\n")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(odd, schema).unionByName(spark.read.parquet(f"{folder}/documents.parquet"))
    docs.withColumn("digest", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_merkle_manifest(spark, str(tmp_path)).collect()
    expected = brute_manifest([tuple(r) for r in docs.collect()], tamper=even)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert {r.verified for r in found} == {True, False}


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_of_any_arity(spark, arity):
    data = [(i, "ab"[i % 7 == 0], None, None, None) for i in range(41)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    fields = [F.col(c) for c in docs.columns]
    rows, root = manifest.manifest(docs, fields, F.col("source"), F.col("doc_id"), [F.col("doc_id")], arity)
    folded = rows.select("row.doc_id", "leaf", "subroot", F.sha2(manifest.siblings(F.col("path")), 256), manifest.fold(F.col("leaf"), F.col("path")).alias("f"))
    expected = brute_manifest(data, arity)
    assert sorted(tuple(r) for r in folded.collect()) == sorted((e[0], e[1], e[2], e[4], root) for e in expected)
    assert {e[3] for e in expected} == {root}


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    args = ([F.col("text")], F.lit(None), F.col("doc_id"), [F.col("doc_id")])
    rows, root = manifest.manifest(docs, *args)
    row = rows.first()
    assert root == row.leaf == row.subroot == sha("1:a") and row.path == []
    rows, root = manifest.manifest(docs.limit(0), *args)
    assert rows.count() == 0 and root is None


# --- near vectors -----------------------------------------------------------------------------------------------------


def brute_near(rows, threshold=0.98):
    def able(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if able(a) and able(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(r[1], np.float64) / np.abs(r[1]).max() for r in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - group:
                group.add(j)
                stack.append(j)
        seen |= group
        least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        for k in group:
            out[k] = (rows[k][0], len(links[k]), least, rows[k][0] == least)
    return out


def vectors(n, size, copies, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, size))
    out = [(i, [float(x) for x in np.float32(v)], int(rng.integers(3))) for i, v in enumerate(base)]
    for k in range(copies):
        source = out[int(rng.integers(len(out)))]
        near = np.float32(np.array(source[1]) + rng.standard_normal(size) * rng.choice([0, 0.03, 0.08, 0.12, 0.2]))
        out.append((n + k, [float(x) for x in near * np.float32(rng.choice([1, 2]))], source[2] if k % 5 else None))
    return out


def as_rows(df):
    return sorted(map(str, map(tuple, df.select("id", "n_links", "component_id", "kept").collect())))


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [4096, 16])
def test_near_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors(150, 24, 250)
    hot = [(1000 + k, [float(x) for x in np.float32(np.ones(24) + np.random.default_rng(k).standard_normal(24) * 0.1)], 1) for k in range(120)]
    same = [(2000 + k, [1.0, 2.0] * 12, 2) for k in range(90)]
    data = rows + hot + same
    assert as_rows(embeddings.near_vectors(spark.createDataFrame(data, VECTORS))) == sorted(map(str, brute_near(data)))


def test_near_vectors_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None),
        (8, [1.0, -0.0], 1), (8, [1.0, 0.0], 1), (8, [0.0, 1.0], 1), (None, [0.0, 2.0], 1), (None, [-1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1),
        (10, [1e-38, 0.0], 1), (11, [3e38, 0.0], 1),
    ]
    docs = spark.createDataFrame(data, VECTORS).withColumn("node", F.lit("x")).withColumn("id", F.lit(3))
    assert as_rows(embeddings.near_vectors(docs)) == sorted(map(str, brute_near(data)))
    assert embeddings.near_vectors(docs.limit(0)).count() == 0
    double = spark.createDataFrame([(1, [1e200, 0.0], "a"), (2, [1e-200, 0.0], "a"), (3, [1e200, 0.0], "b")], "vec_id int, embedding array<double>, label string")
    assert as_rows(embeddings.near_vectors(double)) == ["(1, 1, 1, True)", "(2, 1, 1, False)", "(3, 0, 3, True)"]


def test_tables_follow_the_number_of_rows():
    for rows in (0, 1, 10_000, 10**6, 10**9):
        bits = embeddings.bits_of(rows)
        together = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - together) ** embeddings.tables_of(bits) <= embeddings.MISS
        assert rows / 2**bits <= embeddings.BUCKET
