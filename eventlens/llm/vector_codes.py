"""Product codes of vectors, trained with norm-of-sum bounds.

Components become integers, so sums, means and distances are exact and the result does not depend on the order of rows.
Vectors are cut into equal parts; each part has a codebook of entries, which starts as the parts of the first vectors by
id. A round assigns every part to its nearest entry and replaces each entry by the floor of its parts' mean.

A row keeps for each part its entry and, for each group of entries, a lower bound of the distance to the nearest other
entry of that group, with the round in which it was measured. All codebooks so far are retained. A bound measured in
round s still holds in round t when the largest distance between an entry of the group in s and the same entry in t is
taken off: the net displacement, the norm of the sum of its moves, which never exceeds the sum of their norms. Only
groups whose bound does not exceed the exact distance to the row's own entry are scanned again, exactly.

Rounds go over a table in the shared folder; sums per part and entry are added up in tasks before they are shuffled. The
driver holds codebooks, whose size depends on the parameters and the number of components alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import OWN, written

#: Components are held within this size, so that squared distances of up to 512 components a part fit 64 bits.
LIMIT = 1 << 26
#: Label totals of at most so many rows are broadcast; beyond, a label's rows are dealt to SALTS parts.
BROADCAST_ROWS, SALTS = 100_000, 32


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, int64 [rows, entries], of int64 arrays."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if most * most * max(1, x.shape[1]) < 1 << 52:  # every term of the product is a whole double
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for i in range(0, len(x), 64):
        out[i : i + 64] = ((x[i : i + 64, None] - c) ** 2).sum(2)
    return out


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group for each entry: that of the nearest of `groups` far apart entries, each the farthest from those before it."""
    at = [0]
    near = squared(entries, entries[:1])[:, 0]
    while len(at) < min(groups, len(entries)):
        at.append(int(near.argmax()))
        near = np.minimum(near, squared(entries, entries[at[-1] :][:1])[:, 0])
    return squared(entries, entries[at]).argmin(1).astype(np.int64)


def held(x: np.ndarray) -> np.ndarray:
    """float16 values that never exceed x."""
    x = np.minimum(x, 65504.0)
    out = x.astype(np.float16)
    return np.where(out.astype(float) > x, np.nextafter(out, np.float16(-np.inf)), out)


@dataclass
class Book:
    """The codebooks of one part after each round, and the groups of its entries."""

    history: list[np.ndarray]
    group: np.ndarray
    moved: np.ndarray = field(init=False)

    def __post_init__(self):
        self.members = [np.flatnonzero(self.group == g) for g in range(int(self.group.max(initial=0)) + 1)]
        now = self.history[-1]
        # net displacement since each round: the largest in each group, a little rounded up
        self.moved = np.zeros((len(self.history), len(self.members)))
        for s, then in enumerate(self.history[:-1]):
            far = np.sqrt(((now - then) ** 2).sum(1).astype(float)) * (1 + 1e-12) + 1e-9
            self.moved[s] = [far[m].max(initial=0) for m in self.members]

    def assign(self, x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, ...]:
        """(entries, squared distances, bounds, stamps, entries compared) of rows under the last codebook; of equal distances the lower entry."""
        now, t = self.history[-1], len(self.history) - 1
        rows = np.arange(len(x))
        own = ((x - now[code]) ** 2).sum(1)
        reach = np.sqrt(own.astype(float))
        left = bound.astype(float) - self.moved[stamp, np.arange(len(self.members))]
        stale = left <= reach[:, None] * (1 + 1e-9) + 1e-6
        best, entry = own.copy(), code.copy()
        first, second, at = (np.full(stale.shape, np.iinfo(np.int64).max) for _ in range(3))
        compared = np.ones(len(x), np.int64)
        for g, members in enumerate(self.members):
            r = np.flatnonzero(stale[:, g])
            if not len(r) or not len(members):  # equal seeds leave groups without entries
                continue
            d = squared(x[r], now[members])
            i = d.argmin(1)
            low = d[np.arange(len(r)), i]
            d[np.arange(len(r)), i] = np.iinfo(np.int64).max
            first[r, g], second[r, g], at[r, g] = low, d.min(1), members[i]
            better = (low < best[r]) | ((low == best[r]) & (members[i] < entry[r]))
            best[r[better]], entry[r[better]] = low[better], members[i][better]
            compared[r] += len(members)
        bound, stamp = bound.copy(), stamp.copy()
        other = np.where(at == entry[:, None], second, first)
        bound[stale] = held(np.sqrt(other[stale].astype(float)))
        stamp[stale] = t
        # an entry that a row leaves is again one of its group's others
        g = self.group[code]
        gone = (entry != code) & ~stale[rows, g]
        bound[rows[gone], g[gone]] = held(np.minimum(left[rows[gone], g[gone]], reach[gone]))
        stamp[rows[gone], g[gone]] = t
        return entry, best, bound, stamp, compared


def _cuts(size: int, parts: int) -> list[int]:
    return [size * i // parts for i in range(parts + 1)]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(np.int64)


STATE = "id long, label string, x array<int>, code binary, bound binary, stamp binary, compared long"


def _step(books: list[Book], size: int, final: bool):
    """Assign the rows of a state table (or of its start, which has neither codes nor bounds) under the books."""
    cuts = _cuts(size, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            if not n:
                continue
            x = _matrix(b.column("x"), size)
            begun = "code" in b.schema.names
            flat = lambda name, kind: np.frombuffer(b"".join(b.column(name).to_pylist()), kind).reshape(n, -1)
            if begun:
                codes, bounds, stamps, total = flat("code", np.uint8).astype(np.int64), flat("bound", np.float16), flat("stamp", np.uint8), b.column("compared").to_numpy().copy()
            else:
                total = np.zeros(n, np.int64)
            out, errors, at = [[], [], []], np.zeros(n, np.int64), 0
            for p, book in enumerate(books):
                g = len(book.members)
                if begun:
                    had = codes[:, p], bounds[:, at : at + g], stamps[:, at : at + g].astype(np.int64)
                else:
                    had = np.zeros(n, np.int64), np.full((n, g), -1, np.float16), np.zeros((n, g), np.int64)
                entry, distance, bound, stamp, compared = book.assign(x[:, cuts[p] : cuts[p + 1]], *had)
                for o, v, kind in zip(out, (entry[:, None], bound, stamp), (np.uint8, np.float16, np.uint8), strict=True):
                    o.append(v.astype(kind))
                errors += distance
                total += compared
                at += g
            packed = [pa.array([r.tobytes() for r in np.concatenate(o, 1)], pa.binary()) for o in out]
            if final:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), packed[0], pa.array(errors), pa.array(total)], ["id", "label", "code", "error", "compared"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("x"), *packed, pa.array(total)], ["id", "label", "x", "code", "bound", "stamp", "compared"])

    return run


def _sums(size: int, parts: int, entries: int):
    """One row per part and entry of a task: its rows and the sums of their components, filled up to the widest part."""
    cuts = _cuts(size, parts)
    width = max(b - a for a, b in zip(cuts, cuts[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("x"), size)
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(b), parts)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                sorted_codes = codes[order, p]
                starts = np.flatnonzero(np.r_[True, sorted_codes[1:] != sorted_codes[:-1]])
                found = sorted_codes[starts]
                count[p, found] += np.diff(np.r_[starts, len(b)])
                total[p, found, : cuts[p + 1] - cuts[p]] += np.add.reduceat(x[order, cuts[p] : cuts[p + 1]], starts, axis=0)
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run, width


def _moved(books: list[Book], state: DataFrame, size: int) -> list[Book]:
    """Books with one more codebook each: floors of the means of what is assigned; unused entries stay."""
    cuts, entries = _cuts(size, len(books)), len(books[0].history[0])
    run, width = _sums(size, len(books), entries)
    sums = state.select("x", "code").mapInArrow(run, "part long, entry long, n long, total array<long>")
    per = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(width))).alias("total"))
    new = [book.history[-1].copy() for book in books]
    for r in per.collect():  # parts * entries rows at most
        new[r["part"]][r["entry"]] = [v // r["n"] for v in r["total"][: cuts[r["part"] + 1] - cuts[r["part"]]]]
    return [Book([*book.history, c], book.group) for book, c in zip(books, new, strict=True)]


@dataclass
class Codebooks:
    """The final entries, a list per part of int64 [entries, components]."""

    entries: list[np.ndarray]
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for v in part.ravel().tolist()).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, groups: int = 16, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """((id, label as text, code, error, compared), codebooks): a byte of code per part, the squared distance to the coded
    entries, and the number of entries compared in all rounds.

    Dropped are null and empty vectors, those with null or non-finite components, and those of another number of
    components than the vector of the smallest id. Components become floor(scale * x) and are held within 2^26. Rows of
    one id are all coded; rows without an id are coded but start no codebook (without any id, no row is coded). Fewer
    rows than entries give as many entries; an empty table gives no rows and no codebooks. entries is 256 at most.
    """
    v = F.col(vector_col)
    whole = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    number = lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int")
    kept = vectors.where(whole).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(v, number).alias("x"))
    first = kept.where("id is not null").select("id", F.size("x").alias("size")).orderBy("id", "size").limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], "id long, label string, code binary, error long, compared long"), None
    size = first[0]["size"]
    kept = kept.where(F.size("x") == size)
    seeds = np.array([r["x"] for r in kept.where("id is not null").select("id", "x").orderBy("id", "x").limit(entries).collect()], np.int64)
    cuts = _cuts(size, parts)
    books = [Book([seeds[:, a:b]], grouped(seeds[:, a:b], groups)) for a, b in zip(cuts, cuts[1:], strict=False)]
    state = kept
    for _ in range(rounds):
        state = written(state.mapInArrow(_step(books, size, False), STATE), "codes")
        books = _moved(books, state, size)
    last = state.mapInArrow(_step(books, size, True), "id long, label string, code binary, error long, compared long")
    return written(last, "coded"), Codebooks([b.history[-1] for b in books], scale)


def decode_vectors(coded: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """coded with the vector that its code stands for, as array<double> `__el_vector`; a null code gives null."""
    tables = [F.array(*(F.array(*(F.lit(float(v)) for v in e)) for e in (part / books.scale).tolist())) for part in books.entries]
    digits = [F.conv(F.substring(F.hex(code_col), 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(tables))]
    return coded.withColumn(f"{OWN}vector", F.concat(*(F.get(t, d) for t, d in zip(tables, digits, strict=True))))


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error summed over rows of the same label, rows without one together.

    Totals are added up before they are shuffled. Few are broadcast, after they were counted; many meet their rows by
    label and salt, so that a label of any share is dealt to several tasks.
    """
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    key = F.col("label").eqNullSafe(F.col(f"{OWN}label"))
    totals = totals.withColumnRenamed("label", f"{OWN}label")
    if totals.count() <= BROADCAST_ROWS:
        return coded.join(F.broadcast(totals), key).drop(f"{OWN}label")
    salted = coded.withColumn(f"{OWN}salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS).cast("long")))
    totals = totals.withColumn(f"{OWN}part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(totals, key & (F.col(f"{OWN}salt") == F.col(f"{OWN}part"))).drop(f"{OWN}label", f"{OWN}salt", f"{OWN}part")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.lit(books.sha256() if books else None).cast("string")
    return with_label_error(coded).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def _oracle(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """The rounds written out; x, e: components of a part of a row and of an entry."""
    out = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, rank - 1 AS k, x AS e FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS rank FROM x) WHERE rank <= {entries})",
    ]
    for r in range(rounds + 1):
        out.append(f"d{r} AS MATERIALIZED (SELECT vec_id, x.p, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))::BIGINT, 'k': k}}) AS m FROM x JOIN b{r} b ON b.p = x.p GROUP BY 1, 2)")
        if r < rounds:
            out.append(
                f"m{r} AS MATERIALIZED (SELECT p, k, list(q ORDER BY i) AS e FROM (SELECT d.p, d.m.k AS k, i, (sum(x.x[i]) - ((sum(x.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS q FROM d{r} d JOIN x ON x.vec_id = d.vec_id AND x.p = d.p, range(1, (SELECT max(len(x)) FROM x) + 1) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
            )
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.e, b.e)::BIGINT[] AS e FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.k = b.k)")
    out.append(f"coded AS (SELECT vec_id, string_agg(lpad(lower(hex(m.k)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM d{rounds} GROUP BY 1)")
    out.append(f"sha AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS s FROM b{rounds})")
    return (
        "WITH "
        + ",\n".join(out)
        + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), sha"
    )


ORACLE_SQL = _oracle()
