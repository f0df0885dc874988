"""Classifiers, archives, embeddings and components."""

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pytest

from eventlens.llm import langid, near_dup, quality, warc
from eventlens.llm import files as table_of_files
from eventlens.llm.components import LocalComponents, connected_components


def files_put(uri, name):
    table_of_files.put(uri, name, b"not a whole file")


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice("the of and river stone house walks over under".split()) for _ in range(40))
    bad = lambda: " ".join(rng.choice("BUY!!! NOW$$$ ### CLICK|| %%%".split()) for _ in range(40))
    rows, labels = [], []
    for i in range(600):
        q = int(rng.random() < 0.8)
        rows.append((i, good() if q else bad(), "x"))
        if i % 2:
            labels.append((i, q, 0))
    rows += [(600, None, None), (601, "", None), (None, good(), None), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    model = quality.train_quality(docs, spark.createDataFrame([*labels, (None, None, None), (1, None, 0)], "doc_id long, quality int, toxic int"))
    assert 0.7 < model.prior < 0.9
    out = quality.score_quality(docs, model, column="my_score").collect()
    assert len(out) == len(rows) and all(0 <= r.my_score <= 1 for r in out)
    truth = dict((a, b) for a, b, _ in labels)
    right = [truth[r.doc_id] == (r.my_score >= 0.7) for r in out if r.doc_id in truth]
    assert np.mean(right) > 0.97
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train_quality(docs, empty) is None
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5}


def naive_shares(text, dims):
    """Hashed byte bigram and trigram shares of one text, gram by gram."""
    half, out = dims // 2, np.zeros(dims)
    bits = 32 - (half.bit_length() - 1)
    for k, (width, factor) in enumerate(((2, 2654435761), (3, 2246822519))):
        for i in range(len(text) - width + 1):
            gram = int.from_bytes(text[i : i + width], "big")
            out[k * half + ((gram * factor & 0xFFFFFFFF) >> bits)] += 1
    return out / max(1, len(text))


def naive_shape(text):
    words, lines = text.split(), text.split(b"\n")
    n, signs = max(1, len(words)), [c for c in range(33, 127) if not chr(c).isalnum()]
    if not text:
        return [0.0] * 6
    near = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    return [near if len(set(words)) / n < 0.95 else 0.0, len(set(words)) / n, sum(65 <= c <= 90 for c in text) / len(text), sum(c in signs for c in text) / len(text), sum(len(w) == 1 and w[0] in signs for w in words) / n, 1 - len(set(lines)) / len(lines)]


MIXED = ["The stone house of the river walks over the hills.", "BUY!!! NOW$$$ ###\nBUY!!! NOW$$$ ###", "a a a a - - + b\n\n", "où été déjà çà " * 50, "", "x", "é", "ab", None, "1 2 3"]


def test_quality_scores_are_brute_force(spark):
    """Scores of the job against a gram-by-gram computation in one process, with the trained model."""
    rng = random.Random(3)
    text = lambda q: " ".join(rng.choice((["the", "of", "river", "stone"] if q else ["BUY!!!", "NOW$$$", "###"])) for _ in range(30))
    rows = [(i, text(i % 5 > 0)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 200, 2)] + [(2, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = quality.train_quality(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), labels)
    assert (again.weights == model.weights).all() and again.prior == model.prior
    docs = spark.createDataFrame([(i, t, 0.25) for i, t in enumerate(MIXED)] + [(0, MIXED[0], 0.25)], "doc_id long, text string, score double").repartition(2)
    out = quality.score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "score", "score_"]
    for r in out.collect():
        t = (r.text or "").encode()
        x = np.r_[naive_shares(t, 2048), naive_shape(t)]
        z = ((x - model.mean) * model.scale * (len(t) / (len(t) + 24))) @ model.weights + model.bias
        assert abs(1 / (1 + np.exp(-z)) - r.score_) < 1e-4 and r.score == 0.25


def test_language_decoding_is_brute_force(spark):
    """Predictions of the job against loss-weighted decoding word by word, bit by bit, in one process."""
    words = {"aa": "kala mala tala vana", "bb": "strich knopf zwerg kopf", "cc": "où été déjà çà"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[c].split()) for _ in range(12)), c) for i in range(120) for c in [rng.choice(list(words))]]
    model = langid.train_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(i, t, "mine", 1, True) for i, t in enumerate(MIXED + ["kala knopf été", "x" * 3_000_000])], "doc_id long, text string, lang_pred string, lang_score int, lang_ambiguous boolean")
    out = langid.identify_language(docs, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "lang_score", "lang_ambiguous", "lang_pred_", "lang_score_", "lang_ambiguous_"]
    for r in out.collect():
        t = (r.text or "").encode()
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred_, r.lang_score_, r.lang_ambiguous_) == ("und", 0.0, False)
            continue
        if len(t) > 1_000_000:
            assert r.lang_pred_ in words
            continue
        margin = ((naive_shares(t, 2048) - model.mean) * model.scale) @ model.weights + model.bias
        losses = [4 * np.mean([np.log1p(np.exp(-m * bit)) for m, bit in zip(margin, word, strict=True)]) for word in model.code]
        shares = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        assert r.lang_pred_ == model.names[int(np.argmin(losses))] and abs(r.lang_score_ - shares.max()) < 1e-4
        assert r.lang_ambiguous_ == (np.sort(shares)[-1] - np.sort(shares)[-2] < 0.1)


def test_samples_stay_bounded_at_any_count(spark):
    from eventlens.llm import features

    for n in (10, 10**6, 10**10, 10**13):
        cut = features.threshold(3000, n)
        assert cut < 1 << 63 and (n <= 3000 or abs((cut + (1 << 63)) / 2**64 * n - 3000) < 1)
    df = spark.createDataFrame([(7, "the same row", "l")] * 300 + [(i, f"row {i}", "l") for i in range(300)], "doc_id long, text string, label string")
    x, labels = features.sampled_features(df, "text", "label", 50, 1)
    assert 20 < len(labels) == len(x) <= 50
    y, _ = features.sampled_features(df.repartition(5), "text", "label", 50, 1)
    assert (x == y).all()


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    shape = lambda n, c: np.c_[rng.random((n, 8)) + c, rng.random((n, quality.N_SHAPE)), np.ones(n)].astype(np.float32)
    model = quality.fit_nnpu(shape(300, 1.0), np.r_[shape(300, 1.0), shape(100, 0.0)], 0.75)
    up, down = model.score(shape(200, 1.0)), model.score(shape(200, 0.0))
    assert (up >= 0.7).mean() > 0.95 and (down < 0.7).mean() > 0.95 and up.min() > np.median(down)


def test_language_codes_and_prediction(spark):
    for k in (2, 4, 7, 9, 20):
        code = langid.codewords(k)
        assert len({tuple(x) for x in code}) == k
    words = {"aa": "kala mala tala vana", "bb": "strich knopf zwerg kopf", "cc": "où été déjà çà", "dd": "ñandú niño año ojo"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[c].split()) for _ in range(20)), c) for i in range(400) for c in [rng.choice(list(words))]]
    rows += [(1000, None, "aa"), (1001, "123 ... \n", "bb"), (1002, "", None), (1003, "kala kala mala", None), (None, "strich strich", "bb"), (0, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify_language(docs, langid.train_language(docs)).collect()
    assert len(out) == len(rows) and all(0 <= r.lang_score <= 1 for r in out)
    by = {r.doc_id: r.lang_pred for r in out}
    assert [by[i] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert np.mean([r.lang == r.lang_pred for r in out if r.doc_id is not None and r.doc_id < 400]) > 0.99
    assert {r.lang_pred for r in langid.identify_language(docs, None).collect()} == {"und"}
    assert langid.train_language(docs.limit(0)) is None


def test_archives_round_trip(spark):
    html = ["<p>é</p>", "", None, "<p>x</p>" * 5000, "<p>é</p>", "same", "same", "same"]
    rows = [(i, f"http://h/{i} a\n", h, 1) for i, h in enumerate(html)] + [(None, None, "same", 1), (3, "http://h/3", html[3], 1), (-5, "http://h/x", "minus", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first int").repartition(3)
    uri, files = warc.write_archives(pages)
    files_put(uri, "0-left-by-a-lost-attempt.warc.gz")
    out = warc.read_archives(uri, files).collect()
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -(1 << 60)), i if i is not None else -(1 << 60))
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        first = last[h or ""] == i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else last[h or ""]))
    assert sorted([tuple(r)[:5] for r in out], key=repr) == sorted(want, key=repr)
    assert sum(r.n for r in files.collect()) == len(rows)
    assert warc.read_archives(*warc.write_archives(pages.limit(0))).count() == 0


def test_pages_of_megabytes_and_many_members(spark):
    rows = [(i, None, f"<p>{i % 1500}</p>") for i in range(6000)] + [(9000, "u", "x" * 6_000_000), (9001, "u", "x" * 6_000_000)]
    out = warc.read_archives(*warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))).select("page_id", "payload_bytes", "record_type", "refers_to")
    want = [(i, len(h), "response", None) if i >= 4500 and i != 9000 else (i, len(h), "revisit", 9001 if i == 9000 else 4500 + i % 1500) for i, _, h in rows]
    assert sorted(map(tuple, out.collect())) == want


def test_arc_versions():
    body = warc.arc_version_block(2) + warc.arc_record(2, "http://a/ b", "20200102030405", "text/plain", b"dns answer") + warc.arc_version_block(1) + warc.arc_record(1, "http://c", "2020", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi")
    records = list(warc.read_arc(io.BytesIO(body)))
    assert [r.fields["url"] for r in records] == ["http://a/%20b", "http://c"] and records[0].fields["status"] == "200"
    kinds = [next(warc.read_warc(io.BytesIO(warc.to_warc(r, i))))[0] for i, r in enumerate(records)]
    assert [k["warc-type"] for k in kinds] == ["resource", "response"] and kinds[1]["warc-date"] == "2020-00-00T00:00:00Z"
    with pytest.raises(ValueError, match="header"):
        list(warc.read_arc(io.BytesIO(b"http://x 1 2\n")))
    for n in (0, 1, 2**40 + 7, 2**63 - 1, -1, -(2**63), None):
        assert warc.source_of(warc.record_id(n)) == n and warc.source_of(warc.record_id(n, (1 << 46) - 1)) == n


def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[50] + rng.normal(size=(40, 16)) * 0.12
    x[100:130] = x[100]
    x[130] = x[100] * 3
    rows = [(i, [float(np.float32(c)) for c in v], i % 2 if i < 200 else 5) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, rows[60][1], None), (1005, [float("inf")] * 16, 0), (1006, [], 0), (1007, rows[60][1][:8], 0)]
    return rows


def vectors_brute(rows, threshold):
    ok = [r for r in rows if r[1] and r[2] is not None and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])]
    n, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    n[a[0]] += 1
                    n[b[0]] += 1
                    p, q = find(a[0]), find(b[0])
                    root[max(p, q)] = min(p, q)
    return sorted((i, n[i], find(i), find(i) == i) for i in n)


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_near_duplicates_are_brute_force(spark, shard_rows):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")
    out = near_dup.near_duplicates(df, shard_rows=shard_rows, growth=1).collect()
    assert sorted(map(tuple, out)) == vectors_brute(vectors(), 0.93)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    kept = {r.vec_id for r in near_dup.keep_one(df).collect()}
    assert kept == {i for i, _, _, k in vectors_brute(vectors(), 0.93) if k}


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = near_dup.unit(rng.normal(size=(1500, 32))).astype(np.float32)
    graph = near_dup.Graph.build(x)
    q = near_dup.unit(x[:300] + rng.normal(size=(300, 32)).astype(np.float32) * 0.05).astype(np.float32)
    found, _ = graph.search(q, graph.entries(q), 0, 64)
    assert np.mean([i in found[i] for i in range(300)]) > 0.95


def planted(seed, ordinary=1200, hot=400):
    """Ordinary vectors, each second one a near copy of the one before it, and a hot group of near copies among them."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(ordinary, 24))
    x[1::2] = x[::2] + rng.normal(size=(ordinary // 2, 24)) * 0.1
    group = rng.normal(size=24) + rng.normal(size=(hot, 24)) * 0.05
    x = near_dup.unit(np.concatenate([x, group]))[rng.permutation(ordinary + hot)].astype(np.float32)
    return x


def links_found(graph, q, own):
    found = {(int(a), int(b)) for p, n in near_dup.links_between(graph, q, own, 0.93) for a, b in zip(p, n, strict=True)}
    return {tuple(sorted(z)) for z in found if z[0] != z[1]} if own else found


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("hot", [0, 400])
def test_links_survive_a_graph_of_bad_recall(own, hot):
    x = planted(5, hot=hot)
    q = x if own else near_dup.unit(x + np.random.default_rng(6).normal(size=x.shape) * 0.01).astype(np.float32)
    a, b = np.nonzero(q @ x.T >= 0.93)
    want = {tuple(sorted(z)) for z in zip(a.tolist(), b.tolist(), strict=True) if z[0] != z[1]} if own else set(zip(a.tolist(), b.tolist(), strict=True))
    bare = near_dup.Graph(x, [np.full((len(x), 24), -1, np.int32)], 0)  # no links: a beam finds its entry alone
    assert want <= links_found(bare, q, own)
    if hot:  # a hot group must not stop the widening for all other vectors
        poor = near_dup.Graph.build(x, m=3, ef=4)
        ordinary = {z for z in want if (q[z[0]] @ x.T >= 0.93).sum() < 32}
        assert len(ordinary & links_found(poor, q, own)) >= 0.98 * len(ordinary) > 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    out = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, out)) == sorted((i, find(i)) for i in root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    local = LocalComponents(5100)
    pairs = [(a, b) for a, b in edges if a is not None]
    local.add(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert all(local.root[i] == find(i) for i in root)


def test_a_dense_shard_stays_small():
    """20,000 vectors that all link: 200 million pairs, counted without a list of them."""
    import resource

    rng = np.random.default_rng(4)
    x = near_dup.unit(np.ones(16) + rng.normal(size=(20_000, 16)) * 0.01)
    graph = near_dup.Graph.build(x.astype(np.float32))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    counts, _ = near_dup.count_links(graph, x, np.ones(len(x), np.int64), x, np.ones(len(x), np.int64), True, 0.93)
    assert (counts.links == len(x) - 1).all() and not counts.parts.root.any()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kilobytes


def test_link_counts_equal_brute_force():
    rng = np.random.default_rng(5)
    x = near_dup.unit(np.concatenate([rng.normal(size=(300, 8)), np.ones(8) + rng.normal(size=(300, 8)) * 0.05]))
    y = near_dup.unit(x[::2] + rng.normal(size=(300, 8)) * 0.02)
    copies, copies2 = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
    graph = near_dup.Graph.build(x.astype(np.float32))
    for own, q, c in ((True, x, copies), (False, y, copies2)):
        counts, _ = near_dup.count_links(graph, x, copies, q, c, own, 0.93)
        near = q @ x.T >= 0.93
        if own:
            np.fill_diagonal(near, False)
            assert (counts.links == near @ copies).all()
        else:
            assert (counts.links == np.concatenate([c @ near, near @ copies])).mean() > 0.99


def test_one_vector_of_each_component_is_kept(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (4, None, 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(r.vec_id for r in near_dup.keep_one(df).collect()) == [1, 3, 3, 4]
    assert near_dup.keep_one(df.limit(0)).collect() == []


def test_version_blocks_are_told_by_place_and_type(spark):
    url = "filedesc://x.arc"
    rows = [(1, url, "<p>a</p>"), (2, url, None), (3, "http://a/", "<p>a</p>"), (3, "http://b/", "<p>b</p>"), (3, "http://c/", "<p>b</p>")]
    uri, files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    found = warc.read_archives(uri, files).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in found) == [(1, 8, "revisit", 3), (2, 0, "response", 0), (3, 8, "response", 0), (3, 8, "response", 0), (3, 8, "response", 0)]
    ids = []
    for f in files.collect():
        with table_of_files.open_file(uri, f.file) as raw:
            ids += [h["warc-record-id"] for h, _ in warc.read_warc(io.BytesIO(gzip.decompress(raw.read())))]
    assert len(ids) == len(set(ids)) == 5
    joined = warc.arc_version_block(2) + warc.arc_record(2, url, "2024", "text/html", b"x") + warc.arc_version_block(1) + warc.arc_record(1, url, "2024", "text/html", b"y")
    assert [r.content for r in warc.read_arc(io.BytesIO(joined))] == [b"x", b"y"]
