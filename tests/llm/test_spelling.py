"""Spelling variants against brute force and SQL, with the pivots' own properties."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd

from eventlens.llm import spelling

SF = "/root/testdata/sf0.001"


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    friends = {w: [] for w in counts}
    for x, y in itertools.combinations(counts, 2):
        if near(x, y):
            friends[x].append(y)
            friends[y].append(x)
    form = {}
    for w, found in friends.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(friends[w]), counts[form[w]] if form[w] else None))
    return out


def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randrange(7, 12))) for _ in range(40)]
    base += ["a" * 8, "a" * 9, "ababababab", "abababab", "bananana", "ofofofofof", "x" * 255, "x" * 256, "x" * 257, "y" * 300 + "z", "y" * 300]
    words = list(base)
    for w in base:
        for _ in range(4):
            i, c = rng.randrange(len(w)), rng.choice("abcdeéÀ")
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(40))))
    rows += [(500 + i, " ".join(base[:5]) * 1 + " " + base[0]) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "short words only"), (None, base[0] + "-" + base[1]), rows[0], rows[0]]
    return rows


def test_groups_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, word string").repartition(3)
    want = sorted(brute(rows), key=repr)
    for most in (spelling.LIST, 1):  # lists as they are, and all cut by halves
        got = spelling.spelling_groups(docs, most_in_list=most)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[1] is not None for r in want) > 10 and sum(r[4] for r in want) > 100


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({spelling.ORACLE_SQL})").fetchall()
    got = [tuple(r) for r in spelling.op12_spelling(spark, SF).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_words(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.spelling_groups(spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "doc_id long, text string")).collect() == []


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(9)
    for _ in range(500):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 15)))
        order = ["".join(g) for g in itertools.product("abcd", repeat=2)]
        rng.shuffle(order)
        rank, weight = {g: i for i, g in enumerate(order)}, sorted(rng.randrange(50) for _ in order)
        prefix = spelling.gram_prefix(word, rank)
        ranks = sorted(rank[g] for g in spelling.grams(word))
        assert [i for i, g in enumerate(spelling.grams(word)) if rank[g] <= ranks[min(2, len(ranks) - 1)]] == [i for i, _ in prefix]
        a, b = spelling.pivots(prefix, weight)
        assert b - a >= 2
        place = dict(prefix)
        cost = lambda x, y: weight[place[x]] + weight[place[y]]
        assert cost(a, b) == min(cost(x, y) for x in place for y in place if y - x >= 2)


def test_near_words_share_a_pivot_key():
    rng = random.Random(4)
    order = ["".join(g) for g in itertools.product("abc", repeat=2)]
    rank, weight = {g: i for i, g in enumerate(order)}, list(range(len(order)))
    for _ in range(3000):
        x = "".join(rng.choice("abc") for _ in range(rng.randrange(7, 12)))
        i = rng.randrange(len(x))
        y = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice("abc") + x[i:], x[:i] + rng.choice("abc") + x[i + 1 :]])
        if x == y or len(y) < 7:
            continue
        found = [{k for k, _ in spelling.index_keys(p, rank)} & {k for k, _ in spelling.probe_keys(q, rank, weight)} for p, q in ((x, y), (y, x))]
        assert any(found)


def test_texts_are_put_together_again(spark):
    docs = spark.createDataFrame([(1, "The Colouur, the colouur!"), (2, None), (3, "plain"), (3, "plain"), (4, "")], "doc_id long, text string")
    groups = spark.createDataFrame(pd.DataFrame({"word": ["colouur", "the"], "root": ["colour", "the"]}))
    got = sorted(((r.doc_id, r.normalized) for r in spelling.normalize_spelling(docs, groups).collect()), key=repr)
    assert got == [(1, "The colour, the colour!"), (2, None), (3, "plain"), (3, "plain"), (4, "")]
