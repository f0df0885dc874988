"""Grouping of spelling variants: words that differ by one inserted, deleted or replaced code point.

Pairs are found by pivotal grams. All bigrams of the vocabulary have one order, rare before frequent. A word's gram
prefix is its first three bigrams in that order, and all others equal to the third; three bigrams at different places
always hold two that do not overlap. A word's pivots are the two disjoint bigrams of its prefix that are rarest in sum,
chosen by dynamic programming over places. One edit leaves one pivot whole, so of two near words the one whose prefix
ends earlier in the order has a pivot in the other's prefix.

Position limits: the edit lies behind the first pivot's end or before the second pivot's start. In the first case the
other word has the gram at the same distance from its start, behind the same letters; in the second at the same
distance from its end, before the same letters. A gram is therefore indexed once with all that stands before it and
once with all that follows, and a word looks up its first pivot in the one way and its second in the other. Lists of
many words are cut further: what lies on the other side of the gram has one edit, so one half of it is the same.
Candidates are verified by their edit distance inside the join; only near pairs leave it.

Runs of more than LONG code points could hold a gram in many places; those pairs are found by their equal halves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import ascii_lower, free_name, written

#: Runs of letters: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
LONG = 256
#: Lists that hold more index rows are cut by halves.
LIST = 200


def noisy(run: Column, id_column: Column) -> Column:
    """run without one code point where 31 divides the crc32 h of `<id>:<run>`: the one at h % length. A null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(31)) == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def count_words(docs: DataFrame, least: int = 7, occurrences: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, changed by `noisy`, with at least `least` code points and `occurrences` places.

    Null and empty texts have none; repeated rows count each time.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}+"), F.lit(0))
    each = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    words = each.select(noisy(ascii_lower(F.col("run")), F.col("id")).alias("word")).where(F.char_length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def grams(word: str, q: int = 2) -> list[str]:
    return [word[i : i + q] for i in range(len(word) - q + 1)]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = Counter()
        for word in b.column("word").to_pylist():
            found.update(grams(word))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])


def gram_prefix(word: str, rank: dict[str, int], q: int = 2, edits: int = 1) -> list[tuple[int, int]]:
    """(place, rank) of the first q * edits + 1 grams of a word in the order of ranks, and of all equal to the last of them; by place."""
    found = sorted((rank[g], i) for i, g in enumerate(grams(word, q)))
    last = found[min(q * edits, len(found) - 1)][0]
    return sorted((i, r) for r, i in found if r <= last)


def pivots(prefix: list[tuple[int, int]], weight: list[int], q: int = 2) -> tuple[int, int]:
    """Places of the two disjoint grams of a prefix of least summed weight; of equal sums the earliest.

    By place: the cheapest gram that ends before this one, and the cheapest pair that ends here.
    """
    single = best = None
    j = 0
    for place, r in prefix:
        while prefix[j][0] + q <= place:
            one = (weight[prefix[j][1]], prefix[j][0])
            single = one if single is None or one < single else single
            j += 1
        if single is not None:
            pair = (single[0] + weight[r], single[1], place)
            best = pair if best is None or pair < best else best
    return best[1:]


def _halves(rest: str, length: int) -> list[str]:
    """Two pieces of rest that are those of another text of this length, if rest is that text but for one edit in the other piece."""
    cut = length // 2
    return [f"0{length}:{rest[:cut]}", f"1{length}:{rest[len(rest) - (length - cut):]}"]


def index_keys(word: str, rank: dict[str, int]) -> set[tuple[str, str]]:
    """(letters of a gram and of all before it or behind it, the rest of the word) under which a word is found."""
    return {k for i, _ in gram_prefix(word, rank) for k in ((f"<{word[: i + 2]}", word[i + 2 :]), (f">{word[i:]}", word[:i]))}


def probe_keys(word: str, rank: dict[str, int], weight: list[int]) -> list[tuple[str, str]]:
    """The first pivot with all before it and the second with all behind it: what a near word is looked up by."""
    a, b = pivots(gram_prefix(word, rank), weight)
    return [(f"<{word[: a + 2]}", word[a + 2 :]), (f">{word[b:]}", word[:b])]


def _rows(side: str, rank: dict[str, int], weight: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, rest, at = [], [], []
            for i, word in enumerate(b.column("word").to_pylist()):
                found = []
                if len(word) <= LONG:
                    found += index_keys(word, rank) if side == "index" else probe_keys(word, rank, weight)
                if len(word) >= LONG:  # a pair of lengths LONG and LONG + 1 meets here
                    found.append(("long", word))
                key += [k for k, _ in found]
                rest += [r for _, r in found]
                at += [i] * len(found)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(rest, pa.string()), b.column("word").take(at), b.column("n").take(at)], ["key", "rest", "word", "n"])

    return run


def _cut(side: str):
    """Rows of long lists, each as two rows of halves (index) or as those of three lengths (probe)."""
    spread = (0,) if side == "index" else (-1, 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, at = [], []
            for i, (k, rest) in enumerate(zip(b.column("key").to_pylist(), b.column("rest").to_pylist(), strict=True)):
                for d in spread:
                    if len(rest) + d >= 0:
                        key += [f"{k}|{h}" for h in _halves(rest, len(rest) + d)]
                        at += [i, i]
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), b.column("word").take(at), b.column("n").take(at)], ["key", "word", "n"])

    return run


def near_pairs(words: DataFrame, most_in_list: int = LIST) -> DataFrame:
    """(a, na, b, nb), a < b, each pair of near words once, of a written (word, n) table of distinct words; written.

    Bigrams of LETTERS are at most 116 * 116, so their counts fit the driver whatever the size of the table.
    """
    counted = words.mapInArrow(_gram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    order = sorted((r["n"], r["gram"]) for r in counted)
    rank, weight = {g: i for i, (_, g) in enumerate(order)}, [n for n, _ in order]
    schema = "key string, rest string, word string, n long"
    index = written(words.mapInArrow(_rows("index", rank, weight), schema), "gram-index")
    probe = written(words.mapInArrow(_rows("probe", rank, weight), schema), "pivots")
    lists = index.groupBy("key").agg(F.count("*").alias("size"))
    hot = written(lists.where((F.col("size") > most_in_list) | (F.col("key") == "long")).select("key"), "hot-keys")
    plain = "key string, word string, n long"
    sides = {}
    for name, rows in (("index", index), ("probe", probe)):
        cut = rows.join(hot, "key", "left_semi").mapInArrow(_cut(name), plain)
        sides[name] = rows.join(hot, "key", "left_anti").select("key", "word", "n").unionByName(cut)
    a = sides["probe"].select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    b = sides["index"].select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    near = (F.abs(F.char_length("a") - F.char_length("b")) <= 1) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    met = a.join(b, "key").where(near)
    swap = F.col("a") > F.col("b")
    sorted_pair = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("na", "nb"), ("b", "a"), ("nb", "na"))]
    return written(met.select(*sorted_pair).dropDuplicates(["a", "b"]), "near-words")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of a written (word, form) table: the last form reached. A form has ten times the places of its word, so chains are short; rounds double the steps."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = written(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_groups(docs: DataFrame, least: int = 7, occurrences: int = 2, times: int = 10, id_col: str = "doc_id", text_col: str = "text", most_in_list: int = LIST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of count_words(docs).

    form is the near word of most places (of equal ones the smallest in code-point order) if it has `times` the word's,
    else null; root is the last form reached from the word, which is its own root without a form. Null and empty texts
    and empty tables give no words; extra columns of docs are not read. most_in_list affects the order of work only.
    """
    words = written(count_words(docs, least, occurrences, id_col, text_col), "words")
    pairs = near_pairs(words, most_in_list)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).union(pairs.select("b", "a", "na"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.n") >= times * F.col("n")
    all_words = written(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "forms"
    )
    roots = follow(written(all_words.where("form is not null").select("word", "form"), "form-of"))
    return all_words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def normalize_spelling(docs: DataFrame, groups: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every run of letters whose lower-cased form has a root replaced by it, as column `normalized` (free name).

    Null texts stay null. Runs are looked up one by one and a text is put together again by place; rows of docs need no
    id and may repeat. Upper-case A-Z of a replaced run is lost.
    """
    name = free_name(docs, "normalized")
    known = groups.where("root <> word").select(F.col("word").alias("__el_word"), F.col("root").alias("__el_root"))
    rows = written(docs.withColumn("__el_row", F.monotonically_increasing_id()), "numbered")
    # letters and what lies between them, alternating: the pieces of a text in order
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]++|[^{LETTERS}]++"), F.lit(0))
    each = rows.select("__el_row", F.posexplode(pieces).alias("__el_at", "__el_piece"))
    found = each.withColumn("__el_word", ascii_lower(F.col("__el_piece"))).join(known, "__el_word")
    changes = found.groupBy("__el_row").agg(F.map_from_entries(F.collect_list(F.struct("__el_at", "__el_root"))).alias("__el_new"))
    put = F.array_join(F.transform(pieces, lambda p, i: F.coalesce(F.try_element_at("__el_new", i), p)), "")
    out = rows.join(changes, "__el_row", "left")
    return out.select(*docs.columns, F.when(F.col("__el_new").isNull(), F.col(text_col)).otherwise(put).alias(name))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE bits(b, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, r, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 7 GROUP BY 1, 2),
hexed AS (SELECT r, k, hex(encode(concat(doc_id::VARCHAR, ':', r))) AS x FROM runs),
hashed AS (SELECT r, k, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM hexed, tab),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN concat(r[1 : h % length(r)], r[h % length(r) + 2 :]) ELSE r END AS word, k FROM hashed) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
gaps AS (SELECT word, n, i, concat(word[1 : i], word[i + 2 :]) AS g FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT x.word AS a, y.word AS b, y.n AS nb FROM gaps x JOIN gaps y ON x.i = y.i AND x.g = y.g AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM gaps x JOIN w y ON x.g = y.word UNION SELECT y.word, x.word, x.n FROM gaps x JOIN w y ON x.g = y.word),
best AS (SELECT a, count(*) AS n_near, max(nb) AS nb FROM near GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.nb >= 10 * w.n THEN (SELECT min(b) FROM near WHERE near.a = w.word AND near.nb = best.nb) END AS form, CASE WHEN best.nb >= 10 * w.n THEN best.nb END AS form_n FROM w LEFT JOIN best ON a = word),
r(word, root, d) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT r.word, f.form, d + 1 FROM r JOIN forms f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT forms.word, form, arg_max(r.root, d) AS root, n, n_near, form_n FROM forms JOIN r ON r.word = forms.word GROUP BY ALL
"""
