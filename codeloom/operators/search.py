"""Vector search: exact top-k, with the vectors of a query set held against all rows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.scoring import cosine
from codeloom.session import shuffle_partitions


Embedder = Callable[[list[str]], list[list[float]]]
#: Fixed value: in which order providers of embeddings are preferred.
PREFERENCE = ["gemini", "openai", "local"]


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """A deterministic local embedding: signed counts of hashed words, scaled to length 1; empty texts give zeros."""
    out = []
    for t in texts:
        v = np.zeros(size)
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            v[h % size] += 1.0 if h & 0x10000 else -1.0
        n = float(np.sqrt((v * v).sum()))
        out.append((v / n if n else v).tolist())
    return out


def choose_embedder(available: dict[str, Embedder], preference: list[str] = PREFERENCE) -> tuple[str, Embedder]:
    """(provider, function) of the first preferred provider that is there; the local one always is."""
    known = {"local": hashed_words, **available}
    return next((p, known[p]) for p in preference if p in known)


def embed(df: DataFrame, text: str, embedder: Embedder = hashed_words, batch: int = 256) -> DataFrame:
    """Rows with an ``embedding`` column, asked for in batches."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        for b in batches:
            got = [v for lo in range(0, len(b), batch) for v in embedder(b[text].iloc[lo : lo + batch].tolist())]
            yield b.assign(embedding=got)

    return df.mapInPandas(run, schema)


def save_index(documents: DataFrame, path: str) -> None:
    """Keep embedded documents as a table."""
    documents.write.mode("overwrite").parquet(path)


def index_exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def semantic_search(documents: DataFrame, query: str, embedder: Embedder = hashed_words, k: int = 8, id_col: str = "id") -> DataFrame:
    """The k documents nearest to a query text; with no documents the result is empty."""
    return top_k(documents, embedder([query])[0], k, id_col=id_col)


def embed_document(path: str = "path", analysis: str = "analysis", limit: int = 8000) -> F.Column:
    return F.substring(F.concat(F.lit("File: "), F.col(path), F.lit("\n\n"), F.col(analysis)), 1, limit)


def excerpt(document: F.Column, n: int = 400) -> F.Column:
    """Text after the first blank line."""
    at = F.locate("\n\n", document)
    return F.when(at > 0, F.substring(document, at + 2, F.lit(n))).otherwise(F.substring(document, 1, n))


def csv_head(names: F.Column, n: int) -> F.Column:
    return F.array_join(F.slice(names, 1, n), ", ")


def top_k(vectors: DataFrame, query: list[float], k: int = 8, cap: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of one query vector by cosine: partial top-k per partition, then merged."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.size(vec_col) == len(query)).select(id_col, cosine(F.col(vec_col), q).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(min(k, cap))


def top_k_of(queries: DataFrame, vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", blocks: int | None = None) -> DataFrame:
    """The k nearest rows of each row of a query set, held against all rows in blocks.

    Vectors fall into ``blocks`` (by default twice the shuffle partitions); each query meets every block once, keeps k there, and the k lists are merged, so a
    query's candidates never gather in one task before they are cut to k per block.
    """
    blocks = blocks or 2 * shuffle_partitions(vectors.sparkSession)
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("qv")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    v = vectors.select(id_col, vec_col, F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    sim = q.join(v, "block").where(F.col("query_id") != F.col(id_col)).select("query_id", "block", id_col, cosine(F.col("qv"), F.col(vec_col)).alias("similarity"))
    best = F.row_number().over(Window.partitionBy("query_id", "block").orderBy(F.desc("similarity"), id_col))
    short = sim.withColumn("r", best).where(F.col("r") <= k).drop("r", "block")
    return short.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col))).where(F.col("rank") <= k)
