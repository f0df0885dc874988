"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Every benchmark item gives windows of 13 consecutive words. Words of the benchmark are counted over the whole corpus.
The index holds the postings (term, document, position) of each window's rarest words. A phrase is found by intersecting
the lists of its two rarest words, each less the word's offset; what is left is verified on the text, so a match is
exact. A near match is found at the postings of a block's few rarest words, one of which it must hold, and verified by
the words around. Words travel one a row, never as arrays of whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import ascii_lower, text_key, written

#: What separates words after A-Z are lower-cased: every ASCII character but digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def item_windows(items: DataFrame, size: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: win (words), items (ids as strings), block. An item of fewer words is one window; one without words or id has none.

    block: whether the window starts at a multiple of half a window in some item, or ends it; any copy of one and a half
    windows holds such a block whole. Proximity looks at blocks alone.
    """
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where((F.size("w") > 0) & F.col("item").isNotNull())
    w = w.withColumn("n", F.least(F.size("w"), F.lit(size)))
    w = w.select("item", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("s"))
    block = ((F.col("s") - 1) % ((size + 1) // 2) == 0) | (F.col("s") == F.size("w") - F.col("n") + 1)
    return w.select("item", F.slice("w", F.col("s"), F.col("n")).alias("win"), block.alias("block")).groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("block").alias("block"))


def _sized(small: DataFrame, rows: int, limit: int) -> DataFrame:
    """small with a broadcast hint if its row count is within the limit; otherwise a shuffled join."""
    return F.broadcast(small) if rows <= limit else small


def term_counts(docs: DataFrame, windows: DataFrame, text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """term, n: how often each word of the windows stands in the whole corpus; written."""
    terms = written(windows.select(F.explode("win").alias("term")).distinct(), "terms")
    counts = docs.select(F.explode(words(F.col(text_col))).alias("term")).join(_sized(terms, terms.count(), broadcast_rows), "term").groupBy("term").agg(F.count("*").alias("n"))
    return written(counts, "counts")


def anchored(windows: DataFrame, counts: DataFrame, slack: int = 2, broadcast_rows: int = 200_000) -> DataFrame:
    """windows with exact (all words occur in the corpus), the rarest word and its offset (term, at), the second rarest
    (term2, at2), misses (distinct words that a near match may lack: slack, or a fifth of a short window's), and
    near_terms: the misses + 1 rarest distinct words, of which every near match holds one. Ties go by word; offsets count from 0."""
    at = windows.select("id", F.posexplode("win").alias("at", "term")).join(_sized(counts, counts.count(), broadcast_rows), "term", "left")
    word = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at")
    ranked = at.groupBy("id").agg(F.array_sort(F.collect_list(word)).alias("r"))
    first, second = F.col("r")[0], F.element_at("r", F.least(F.size("r"), F.lit(2)))
    distinct = F.array_distinct(F.transform("r", lambda x: x["term"]))
    misses = F.least(F.lit(slack), F.floor(F.size(distinct) / 5)).cast("int")
    out = windows.join(ranked, "id").withColumns({"distinct": distinct, "misses": misses})
    return out.select("id", "win", "items", "block", (first["n"] > 0).alias("exact"), first["term"].alias("term"), first["at"].alias("at"), second["term"].alias("term2"), second["at"].alias("at2"), "misses", F.slice("distinct", F.lit(1), F.col("misses") + 1).alias("near_terms"))


def postings(docs: DataFrame, anchors: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """The index: term, doc_id, tkey, pos (from 1) of every anchor word in every document; written.

    Each document also has one row of the empty term at position 0, with its number of words in n_words.
    """
    terms = anchors.where("exact").select(F.explode(F.array("term", "term2")).alias("term")).union(anchors.where("block").select(F.explode("near_terms")))
    terms = written(terms.union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct(), "anchor-terms")
    base = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tkey"), words(F.col(text_col)).alias("w"))
    rows = base.select("doc_id", "tkey", F.size("w").alias("size"), F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "term"))
    rows = rows.select("term", "doc_id", "tkey", "pos", F.when(F.col("pos") == 0, F.col("size")).alias("n_words"))
    return written(rows.join(_sized(terms, terms.count(), broadcast_rows), "term", "left_semi"), "postings")


def phrase_candidates(index: DataFrame, anchors: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, tkey, id, at: starts at which a window's two rarest words both stand, by intersecting their lists less their offsets."""
    exact = anchors.where("exact").select("id", "term", "at", "term2", "at2")
    rarest = index.join(_sized(exact, exact.count(), broadcast_rows), "term").select("doc_id", "tkey", "id", (F.col("pos") - F.col("at")).alias("start"), "term2", (F.col("pos") - F.col("at") + F.col("at2")).alias("pos2"))
    second = index.select(F.col("doc_id").alias("d2"), F.col("tkey").alias("k2"), F.col("term").alias("t2"), F.col("pos").alias("p2"))
    both = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tkey") == F.col("k2")) & (F.col("term2") == F.col("t2")) & (F.col("pos2") == F.col("p2"))
    return rarest.where("start >= 1").join(second, both, "left_semi").select("doc_id", "tkey", "id", F.col("start").alias("at"))


def near_candidates(index: DataFrame, anchors: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, tkey, id, at: positions of a block's near_terms."""
    near = anchors.where("block").select("id", F.explode("near_terms").alias("term"))
    return index.join(_sized(near, near.count(), broadcast_rows), "term").select("doc_id", "tkey", "id", F.col("pos").alias("at"))


def verified(docs: DataFrame, candidates: DataFrame, anchors: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """The candidates (doc_id, tkey, near, id, at) that hold by the texts: doc_id, tkey, near, start, len, items.

    An exact one has the window's words from `at` on. A near one has all but `misses` of the window's distinct words
    within size - 1 words of `at`. Texts meet their candidates in one row a document.
    """
    per = written(candidates.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("near", "id", "at")).alias("cs")), "candidates")
    per = per.select(F.col("doc_id").alias("d"), F.col("tkey").alias("k"), "cs")
    base = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tkey"), F.col(text_col).alias("text"))
    rows = base.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")))
    rows = rows.select("doc_id", "tkey", words(F.col("text")).alias("w"), "cs").select("doc_id", "tkey", "w", F.explode("cs").alias("c"))  # words are split once a text
    begin = F.when(F.col("c.near"), F.greatest(F.col("c.at") - (size - 1), F.lit(1))).otherwise(F.col("c.at"))
    length = F.when(F.col("c.near"), F.col("c.at") - begin + size).otherwise(size)
    rows = rows.select("doc_id", "tkey", "c.near", "c.id", "c.at", F.slice("w", begin, length).alias("seen"))
    wanted = anchors.select("id", "win", "items", "misses")
    rows = rows.join(_sized(wanted, wanted.count(), broadcast_rows), "id")
    near = F.size(F.array_intersect("seen", "win")) >= F.size(F.array_distinct("win")) - F.col("misses")
    exact = F.slice("seen", F.lit(1), F.size("win")) == F.col("win")
    return rows.where(F.when(F.col("near"), near).otherwise(exact)).select("doc_id", "tkey", "near", F.col("at").alias("start"), F.size("win").alias("len"), "items")


def covered(spans: Column) -> Column:
    """Words inside any of the spans (struct start, len)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["len"] - 1
        more = F.greatest(F.lit(0), end - F.greatest(acc["upto"], x["start"] - 1))
        return F.struct((acc["n"] + more).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, size: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, slack: int = 2) -> DataFrame:
    """One row per document: doc_id, tkey, n_words, n_hit, item_ids (sorted strings), contaminated (n_hit > 0 and one_in * n_hit >= n_words), near_ids.

    near_ids: items with a block of which a document holds all but `misses` distinct words (see `anchored`) around one
    of the block's rarest words; they don't contaminate. Repeated rows come back as often as they stand; null texts have
    no words; an empty benchmark hits nothing. Texts of any length are taken whole; ties of equally rare words go by
    word. tkey tells rows of one id with different texts apart. broadcast_rows bounds what is broadcast; beyond it the
    joins shuffle.
    """
    windows = written(item_windows(items, size).withColumn("id", F.monotonically_increasing_id()), "windows")
    anchors = written(anchored(windows, term_counts(docs, windows, text_col, broadcast_rows), slack, broadcast_rows), "anchors")
    index = postings(docs, anchors, id_col, text_col, broadcast_rows)
    held = index.where("term <> ''")
    found = phrase_candidates(held, anchors, broadcast_rows).withColumn("near", F.lit(False)).unionByName(near_candidates(held, anchors, broadcast_rows).withColumn("near", F.lit(True)))
    found = verified(docs, found, anchors, size, id_col, text_col, broadcast_rows)
    none = F.lit(None)
    base = index.where("term = ''").select("doc_id", "tkey", "n_words", none.cast("struct<start:int,len:int>").alias("span"), none.cast("array<string>").alias("items"), none.cast("array<string>").alias("near"))
    hits = found.select("doc_id", "tkey", none.cast("int").alias("n_words"), F.when(~F.col("near"), F.struct("start", "len")).alias("span"), F.when(~F.col("near"), F.col("items")).alias("items"), F.when(F.col("near"), F.col("items")).alias("near"))
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    per = base.unionByName(hits).groupBy("doc_id", "tkey").agg(F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"), F.collect_set("span").alias("spans"), ids("items").alias("item_ids"), ids("near").alias("near_ids"))
    per = per.withColumn("n_hit", covered(F.col("spans"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    bad = (F.col("n_hit") > 0) & (one_in * F.col("n_hit").cast("long") >= F.col("n_words"))
    return per.select("doc_id", "tkey", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), "item_ids", bad.alias("contaminated"), "near_ids")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones, all columns kept."""
    bad = contamination(docs, items, size, one_in, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("__el_doc"), F.col("tkey").alias("__el_bad")).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__el_doc")) & (text_key(text_col) == F.col("__el_bad")), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(docs, items)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated", F.size("near_ids").cast("long").alias("n_near"), F.concat_ws(",", "near_ids").alias("near_items"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, w[s : s + least(len(w), 13) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, w[s : s + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id),
c AS (SELECT t, count(*) AS n FROM (SELECT unnest(w) AS t FROM d) GROUP BY t),
k AS (SELECT DISTINCT item_id, w[s : s + n - 1] AS win FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0) WHERE (s - 1) % 7 = 0 OR s = len(w) - n + 1),
a AS (SELECT win, least(2, len(list_distinct(win)) // 5) AS misses, unnest(list_distinct(win)) AS t FROM (SELECT DISTINCT win FROM k)),
r AS (SELECT win, misses, t FROM (SELECT win, misses, a.t, row_number() OVER (PARTITION BY win ORDER BY coalesce(c.n, 0), a.t) AS rank FROM a LEFT JOIN c ON c.t = a.t) WHERE rank <= misses + 1),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS t FROM d),
q AS (SELECT DISTINCT doc_id, win FROM p JOIN r ON p.t = r.t WHERE len(list_intersect(list_distinct(w[greatest(pos - 12, 1) : pos + 12]), win)) >= len(list_distinct(win)) - misses),
v AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM q JOIN k USING (win)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN v USING (doc_id)
"""
