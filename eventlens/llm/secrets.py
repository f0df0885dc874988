"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over the trigrams that any match must hold. The index stores,
for the trigrams that the rules ask for, the documents that hold them; the postings of a query are intersected, and
only the documents left are verified with the rule's expression. A rule without mandatory trigrams scans all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import free_name, text_key, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The contract's rules come first; the lengths are those below which a match is dropped.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # a run of 16 or more is what [0-9a-f]+ finds there, and runs below 16 are dropped anyway
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED


def trigram_query(pattern: str, most: int = 64) -> list[set[str]] | None:
    """Alternatives, each a set of lower-case trigrams that must all be there; None: no mandatory trigrams."""
    from re import _parser

    def joined(a: list, b: list) -> list:
        # runs are lists of strings; the last run of a meets the first of b
        return [x[:-1] + [x[-1] + y[0]] + y[1:] for x in a for y in b]

    def walk(tree) -> list:
        out = [[""]]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                part = [[chr(arg)]]
            elif name == "SUBPATTERN":
                part = walk(arg[-1])
            elif name == "BRANCH":
                part = [x for branch in arg[1] for x in walk(branch)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and tuple(arg[:2]) == (0, 1) and len(walk(arg[2])) * len(out) < most:
                part = [[""], *walk(arg[2])]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                part = joined(walk(arg[2]), [["", ""]])
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) * len(out) < most:
                part = [[chr(c)] for _, c in arg]
            elif name == "AT":
                part = [[""]]
            else:
                part = [["", ""]]
            if len(out) * len(part) > most:
                part = [["", ""]]
            out = joined(out, part)
        return out

    found = [{run[i : i + 3].lower() for run in runs for i in range(len(run) - 2)} for runs in walk(_parser.parse(pattern))]
    if not all(found):
        return None
    distinct = sorted({frozenset(x) for x in found}, key=lambda x: (len(x), sorted(x)))
    return [set(x) for i, x in enumerate(distinct) if not any(y <= x for y in distinct[:i])]


def trigram_postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, doc_id, tkey) for the asked trigrams, over lower-cased texts; null texts hold none."""
    low = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("tkey"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select(F.explode(held).alias("trigram"), "doc_id", "tkey")


def candidates(postings: DataFrame, queries: dict[str, list[set[str]]]) -> DataFrame:
    """(doc_id, tkey, rules): documents that satisfy a rule's trigram query, by intersecting postings per document."""
    held = F.collect_set("trigram").alias("held")
    per = postings.groupBy("doc_id", "tkey").agg(held)

    def holds(alternatives: list[set[str]]) -> Column:
        some = F.lit(False)
        for needed in alternatives:
            need = F.array(*(F.lit(t) for t in sorted(needed)))
            some = some | (F.size(F.array_intersect("held", need)) == len(needed))
        return some

    rules = F.array_compact(F.array(*(F.when(holds(q), F.lit(k)) for k, q in sorted(queries.items()))))
    return per.select("doc_id", "tkey", rules.alias("rules")).where(F.size("rules") > 0)


def _once(value: Column, use) -> Column:
    """use(value), for which value is evaluated once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans_of(text: Column, rule: Rule, order: int, block: int = 512) -> Column:
    """array<struct<start, ord, end, kind>> of a rule's matches in a text, in code points, end exclusive.

    Each expression is run over the text once. Matches are folded in blocks, whose spans are put together afterwards: an
    array that grows by one span at a time would be copied for each of them.
    """
    pattern = F.lit(rule.pattern)
    found, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["piece"])
        end = begin + F.char_length(x["found"])
        span = F.array(F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.char_length(x["value"]) >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def blocks(zipped: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(zipped), F.lit(block))

        def more(acc: Column, at: Column) -> Column:
            inner = F.aggregate(F.slice(zipped, at, F.lit(block)), F.struct(acc["at"].alias("at"), empty.alias("out")), step)
            return _once(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

        return F.aggregate(starts, F.struct(F.lit(0).alias("at"), empty.alias("out")), more, lambda acc: acc["out"])

    # the text behind the last match is the last piece; it has no match beside it and adds no span
    zipped = F.arrays_zip(pieces.alias("piece"), found.alias("found"), value.alias("value"))
    return F.when(F.regexp_like(text, pattern), _once(zipped, blocks)).otherwise(empty)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `secret_spans` added: array<struct<start, ord, end, kind>>, sorted by start, then by rule.

    Null and empty texts hold none; repeated rows come back as often as they stand. A column of docs of that name stays;
    the new one then ends in an underscore. Rules that start at one place come in their order. Texts are scanned whole.
    """
    name = free_name(docs, "secret_spans")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    key = "__el_tkey"
    rows = docs.withColumn(key, text_key(text_col))
    if queries:
        trigrams = sorted(set().union(*(t for q in queries.values() for t in q)))
        found = candidates(written(trigram_postings(docs, trigrams, id_col, text_col), "trigrams"), queries)
        found = found.select(F.col("doc_id").alias("__el_doc"), F.col("tkey").alias("__el_found"), F.col("rules").alias("__el_rules"))
        rows = rows.join(found, F.col(id_col).eqNullSafe(F.col("__el_doc")) & (F.col(key) == F.col("__el_found")), "left")
    else:
        rows = rows.withColumn("__el_rules", F.array().cast("array<string>"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = []
    for i, rule in enumerate(rules):
        spans = spans_of(text, rule, i)
        none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
        parts.append(spans if rule.kind not in queries else F.when(F.array_contains("__el_rules", rule.kind), spans).otherwise(none))
    return rows.withColumn(name, F.array_sort(F.concat(*parts))).select(*docs.columns, name)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs).select("doc_id", F.col("secret_spans").alias("s"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("s", lambda x: x["ord"] < len(BASE))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def _rule_sql(i: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, i, {i} AS ord, '{rule.kind}' AS kind, f, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
      FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, m, p, v, m[unnest(range(1, len(m) + 1))] AS f, v[unnest(range(1, len(m) + 1))] AS val
            FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS v, string_split_regex(t, '{pattern}') AS p FROM d)) WHERE length(val) >= {rule.least}"""


ORACLE_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + "\nUNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(RULES))
    + """), g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || (s::BIGINT + length(f)), ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base, string_agg(kind || ':' || s::BIGINT || ':' || (s::BIGINT + length(f)), ',' ORDER BY s, ord) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
)
