"""Similarity of embeddings, exactly, and embeddings of texts without a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that are compared with all rows at a time.
BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in double; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(rows: DataFrame, key: str, vector: str, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """`key, score` of the k rows most similar to one query; the filter applies before the choice, so k are found if there are."""
    rows = rows if where is None else rows.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).where("score is not null").orderBy(F.desc("score"), key).limit(k)


def neighbours(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, block: int = BLOCK) -> DataFrame:
    """`query, key, score`: the k rows most similar to each query, from all rows.

    The queries are taken in blocks of bounded size; each task multiplies its rows with a block's matrix and keeps k a
    query, so what is shuffled is k rows per query and task.
    """
    found = None
    held: list = []
    for q in [*queries.select(key, vector).where(F.col(vector).isNotNull()).toLocalIterator(), None]:
        if q is not None:
            held.append((q[0], q[1]))
        if held and (q is None or len(held) == block):
            part = _block(rows, key, vector, held, k)
            found, held = part if found is None else found.unionByName(part), []
    if found is None:
        return rows.select(F.col(key).alias("query"), key, F.lit(0.0).alias("score")).limit(0)
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key)))), 1, k).alias("v"))
    return best.select("query", F.explode("v").alias("v")).select("query", f"v.{key}", (-F.col("v.s")).alias("score"))


def _block(rows: DataFrame, key: str, vector: str, held: list, k: int) -> DataFrame:
    names = np.array([n for n, _ in held])
    matrix = np.array([v for _, v in held], float)
    norms = np.linalg.norm(matrix, axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b[vector].notna()]
            if not len(b):
                continue
            m = np.stack(b[vector].to_numpy()).astype(float)
            keys = b[key].to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.round((matrix @ m.T) / np.outer(norms, np.linalg.norm(m, axis=1)), 6)
            s = np.where(np.isfinite(s), s, -2.0)
            for i in range(len(names)):
                order = np.lexsort((keys, -s[i]))[:k]
                order = order[s[i][order] > -2]
                yield pd.DataFrame({"query": names[i], key: keys[order], "score": s[i][order]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, vector).mapInPandas(run, f"query {kind}, {key} {kind}, score double")


def embed(texts: DataFrame, key: str, text: str, dims: int = 64, most: int | None = None) -> DataFrame:
    """`key, embedding`: hashed bags of words of unit length, the same on every run, of whole texts; if `most` is given, texts above so many characters are cut there and end with a mark, as for models with an input limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zlib

        for b in batches:
            out = []
            for t in b[text]:
                t = "" if t is None else t if most is None or len(t) <= most else t[: most - 20] + " [...]"
                v = np.zeros(dims)
                for w in re.findall(r"\w+", t.lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dims] += 1 if h >> 31 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32).tolist())
            yield pd.DataFrame({key: b[key], "embedding": out})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


#: Vectors that an index is fitted on, and its lists, at most.
SAMPLE, LISTS = 20_000, 1024
#: Rows of a list above which they are spread over several keys.
HOT_LIST = 100_000


class Index:
    """Inverted lists of vectors around centroids: every row is in the list of its nearest centroid, and a query looks into the lists of its nearest ones.

    The centroids are fitted on a bounded sample (the rows of least hash, at most SAMPLE); all rows are indexed. With
    `probes` as many as there are lists the answer is exact. Null vectors and those without length are in no list.
    """

    def __init__(self, rows: DataFrame, key: str, vector: str, lists: int | None = None, rounds: int = 8) -> None:
        self.key, self.vector, self.spark = key, vector, rows.sparkSession
        rows = rows.select(key, vector).where(F.col(vector).isNotNull())
        sample = np.array([r[0] for r in rows.orderBy(F.xxhash64(key)).limit(SAMPLE).select(vector).collect()], float)
        unit = sample[np.linalg.norm(sample, axis=1) > 0] if len(sample) else np.zeros((0, 1))
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        n = max(1, min(LISTS, lists or int(len(unit) ** 0.5), len(unit) or 1))
        centers = unit[np.linspace(0, max(0, len(unit) - 1), n).astype(int)] if len(unit) else np.zeros((1, 1))
        for _ in range(rounds if len(unit) else 0):
            own = np.argmax(unit @ centers.T, axis=1)
            for c in np.unique(own):
                mean = unit[own == c].mean(axis=0)
                if (size := np.linalg.norm(mean)) > 0:
                    centers[c] = mean / size
        self.centers, self.lists = centers, n
        self.rows = self._near(rows, 1)

    def _near(self, rows: DataFrame, probes: int) -> DataFrame:
        """rows with a row for each of their nearest lists."""
        centers, key, vector = self.centers, self.key, self.vector
        kind = rows.schema[key].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                m = np.stack(b[vector].to_numpy()).astype(float) if len(b) else np.zeros((0, centers.shape[1]))
                has = np.linalg.norm(m, axis=1) > 0
                b, m = b[has], m[has]
                near = np.argsort(-(m @ centers.T), axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), near.shape[1]), vector: b[vector].repeat(near.shape[1]).to_numpy(), "list": near.ravel()})

        return rows.mapInPandas(run, f"{key} {kind}, {vector} array<float>, list int")

    def search(self, queries: DataFrame, k: int = 10, probes: int | float = 8) -> DataFrame:
        """`query, key, score`: the k rows most similar to each query among those in its nearest lists: so many, or (a float) such a share of all."""
        if isinstance(probes, float):
            probes = max(1, round(probes * self.lists))
        key, vector = self.key, self.vector
        kind = self.rows.schema[key].dataType.simpleString()
        asked = self._near(queries.select(key, vector).where(F.col(vector).isNotNull()), min(probes, self.lists))
        # a list with many rows is spread over salts, and its queries are repeated for these
        salts = self.rows.groupBy("list").agg(F.ceil(F.count("*") / F.lit(HOT_LIST)).cast("int").alias("salts"))
        own = salts.select(F.col("list").alias("of"), "salts")
        held = self.rows.join(own, F.col("list") == F.col("of")).selectExpr(key, vector, "list", f"cast(pmod(xxhash64({key}), salts) as int) salt")
        mine = salts.select(F.col("list").alias("at"), F.col("salts").alias("spread"))
        asked = asked.join(mine, F.col("list") == F.col("at")).selectExpr(key, vector, "list", "explode(sequence(0, spread - 1)) salt")

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query": a[key][:0], key: b[key][:0], "score": np.zeros(0)})]
            if len(a) and len(b):
                m, keys = np.stack(b[vector].to_numpy()).astype(float), b[key].to_numpy()
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                for q, v in zip(a[key], a[vector], strict=True):
                    s = np.round(m @ (np.asarray(v, float) / np.linalg.norm(v)), 6)
                    best = np.lexsort((keys, -s))[:k]
                    out.append(pd.DataFrame({"query": q, key: keys[best], "score": s[best]}))
            return pd.concat(out, ignore_index=True)

        found = asked.groupBy("list", "salt").cogroup(held.groupBy("list", "salt")).applyInPandas(run, f"query {kind}, {key} {kind}, score double")
        best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key)))), 1, k).alias("v"))
        return best.select("query", F.explode("v").alias("v")).select("query", f"v.{key}", (-F.col("v.s")).alias("score"))


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """`n_queries, n_exact, n_found, recall`: which share of the true neighbours was found."""
    hit = exact.select("query", key).join(found.select("query", key).withColumn("hit", F.lit(1)), ["query", key], "left")
    sums = hit.agg(F.count_distinct("query").alias("n_queries"), F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return sums.withColumn("recall", F.round(F.try_divide("n_found", "n_exact"), 4))
