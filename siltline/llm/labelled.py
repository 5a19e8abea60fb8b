"""A bounded sample of labelled texts for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PER_CLASS, MAX_BYTES, MAX_GRADES = 4000, 20 << 20, 64


def fitting(sizes: np.ndarray, max_bytes: int) -> np.ndarray:
    """Which texts to take, in their order: each that fits into what those before it have left; one that does not is passed over."""
    out = np.zeros(len(sizes), bool)
    for i, n in enumerate(sizes.tolist()):
        if n <= max_bytes:
            out[i], max_bytes = True, max_bytes - n
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES):
    """(texts, grades) for training: per value of the label at most per_class ids, those of least hash, and max_bytes of text in all.

    A text that does not fit into the rest of max_bytes is passed over. More than MAX_GRADES values, and texts of which
    none fits, are errors.
    Rows with a null id, null label or null text are left out; of labels that repeat an id the largest
    counts; of documents that repeat an id one counts (they bear the same label). `learn` decides which ids may be used.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where(learn_on(learn) & F.col("id").isNotNull() & F.col("y").isNotNull())
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    grades = [r["y"] for r in rows.groupBy("y").count().orderBy("y").limit(MAX_GRADES + 1).collect()]
    if len(grades) > MAX_GRADES:
        raise ValueError(f"{label} has more than {MAX_GRADES} grades")
    if not grades:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    picked = None
    for g in grades:
        some = rows.where(F.col("y") == g).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    picked = picked.toArrow()  # grades x per_class rows at most
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(picked))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL").join(chosen, "id")
    sizes = texts.groupBy("id").agg(F.max(F.octet_length("t")).alias("n")).orderBy(F.xxhash64("id"), "id").toArrow()
    if not sizes.num_rows:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    fit = fitting(sizes.column("n").to_numpy(), max_bytes)
    if not fit.any():
        raise ValueError(f"no labelled text has {max_bytes} bytes or less")
    kept = F.broadcast(spark.createDataFrame(sizes.filter(pa.array(fit)).select(["id"])))
    found = texts.join(kept, "id").groupBy("id").agg(F.max("t").alias("t"), F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").toArrow()
    return found.column("t").combine_chunks(), found.column("y").to_numpy().astype(np.int64)


def learn_on(learn: Column) -> Column:
    return F.coalesce(learn, F.lit(False))
