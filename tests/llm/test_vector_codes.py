"""Vector codes against plain rounds over all entries, and against SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from eventlens.llm import vector_codes as vc

SF = "/root/testdata/sf0.001"


def brute(rows, parts=4, entries=256, rounds=4):
    """{id: (code, error)} and the entries, in whole numbers of Python."""
    x = {i: [math.floor(1024 * v) for v in vector] for i, vector in rows}
    size = len(next(iter(x.values()))) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(x[i], p) for i in sorted(x)[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for v in x.values():
                held.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, found in held.items():
                books[p][k] = [sum(c) // len(found) for c in zip(*found, strict=True)]
    out = {}
    for i, v in x.items():
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(8)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i * 7, [c + rng.gauss(0, 0.2) for c in rng.choice(centers)]) for i in range(700)]
    rows += [(9000, [0.0] * 8), (9001, [0.0] * 8), (9002, [1e6, -1e6] + [0.0] * 6), (9003, rows[0][1])]
    bad = [(1, None), (2, []), (3, [float("nan")] + [0.0] * 7), (4, [float("inf")] + [0.0] * 7), (5, [None] + [0.0] * 7), (9990, [1.0] * 12)]
    label = lambda i: None if i % 3 == 0 else i % 2
    df = spark.createDataFrame([(*r, label(r[0]), "c") for r in rows + bad], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    want, digest = brute([(i, [max(-65536.0, min(65536.0, c)) for c in v]) for i, v in rows], entries=64)
    coded, books = vc.encode_vectors(df, entries=64, groups=8)
    found = vc.with_label_error(coded).collect()
    assert {r.id: (bytes(r.code).hex(), r.error) for r in found} == want and len(found) == len(rows)
    assert books.sha256() == digest
    assert sum(r.compared for r in found) < 0.7 * len(rows) * 4 * 64 * 5  # bounds spare scans
    total = lambda k: sum(e for i, (_, e) in want.items() if label(i) == k)
    assert {(r.id, r.label_error) for r in found} == {(i, total(label(i))) for i, _ in rows}
    decoded = vc.decode_vectors(coded.limit(5), books).collect()
    for r in decoded:
        v = np.concatenate([books.entries[p][k] for p, k in enumerate(bytes(r.code))]) / 1024
        assert np.allclose(r["__el_vector"], v)


def test_bounds_use_the_net_displacement():
    """An entry that comes back to where it was costs nothing, however far it went in between."""
    c = np.array([[0, 0], [100, 0], [0, 100], [100, 100]])
    away = c + 1000
    book = vc.Book([c, away, c], np.array([0, 0, 1, 1]))
    assert book.moved[0].max() < 1e-6 and book.moved[1].min() > 1400
    x = np.array([[1, 1]])
    entry, d, bound, stamp, compared = vc.Book([c], book.group).assign(x, np.zeros(1, int), np.full((1, 2), -1, np.float16), np.zeros((1, 2), int))
    assert compared[0] == 5 and entry[0] == 0 and d[0] == 2
    again = book.assign(x, entry, bound, stamp)
    assert again[4][0] == 1 and again[0][0] == 0


def test_many_labels_meet_by_salt(spark, monkeypatch):
    rows = [(i, [float(i % 5), float(i % 3), 0.5, -0.5], i % 7 if i % 7 else None) for i in range(60)]
    coded, _ = vc.encode_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), entries=4)
    want = sorted(map(tuple, vc.with_label_error(coded).collect()), key=repr)
    monkeypatch.setattr(vc, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, vc.with_label_error(coded).collect()), key=repr) == want and len(want) == 60


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(None, [1.0, 2.0, 3.0, 4.0], 1)]])
def test_nothing_to_code(spark, rows):
    coded, books = vc.encode_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert coded.collect() == [] and books is None


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({vc.ORACLE_SQL})").fetchall()
    got = [tuple(r) for r in vc.op13_vector_codes(spark, SF).select(*columns).collect()]
    assert sorted(got) == sorted(want)
