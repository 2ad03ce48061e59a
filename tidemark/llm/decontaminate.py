"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size (shingles, in powers of two). With containment t, an item of n shingles may lack at most
n - ceil(t n) of them, so its MinHash signature is its n - ceil(t n) + 1 smallest shingle hashes, at the largest n of the
partition: a document that holds the item must hold a shingle of the signature, whatever its length. Documents
are searched for signature shingles only (an equi-join on hashes that leaves few rows), and every pair found is verified
with all shingles, as text. No document is cut and no pair is lost.

Words are lower-cased runs of letters, marks and digits, a shingle is five of them; an item with fewer words is one
shingle of all it has. Defined results: items and documents without words match nothing; null ids are kept as ids;
repeated documents and items give repeated pairs only where their ids differ (a pair of ids is returned once, at its
best containment); empty tables give no pairs; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def _grams(w: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words of column ``w``."""
    starts = F.sequence(F.lit(1), F.size(w) - (size - 1))
    return F.when(F.size(w) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size)))).otherwise(F.array().cast("array<bigint>"))


def _texts(w: str, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(w) - (size - 1))
    return F.when(F.size(w) >= size, F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))


def signatures(items: DataFrame, containment: float = CONTAINMENT, shingle: int = SHINGLE) -> DataFrame:
    """item_id, size, length of its shingles, shingles as text, partition and signature of every item with words."""
    one = items.select("item_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    one = one.withColumn("length", F.least(F.size("w"), F.lit(shingle)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    one = one.select("item_id", "length", F.array_distinct(F.transform(starts, lambda i: F.slice("w", i, F.col("length")))).alias("grams"))
    one = one.withColumn("size", F.size("grams")).withColumn("partition", F.ceil(F.log2(F.col("size"))).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("partition"))
    k = F.least(F.col("size"), (F.floor(largest * (1 - containment) + 1e-9) + 1).cast("int"))
    hashes = F.sort_array(F.transform("grams", lambda g: F.xxhash64(g)))
    return one.select("item_id", "length", "size", "partition", F.slice(hashes, 1, k).alias("signature"), F.transform("grams", lambda g: F.array_join(g, " ")).alias("grams"))


def _held(docs: DataFrame, items: DataFrame, containment: float, shingle: int) -> DataFrame:
    """doc_id, text_md5, item_id, n_shared, n_shingles, containment: the items that a text holds."""
    sig = signatures(items, containment, shingle)
    short = sorted(r[0] for r in sig.where(F.col("length") < shingle).select("length").distinct().collect())  # at most four numbers
    doc = docs.select(F.col("doc_id"), F.col("text"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    w = doc.select("doc_id", "text_md5", tokens(F.col("text")).alias("w"))
    found = w.select("doc_id", "text_md5", F.explode(F.array_distinct(F.concat(*(_grams("w", n) for n in [shingle, *short])))).alias("hash"))
    probes = sig.select("item_id", F.explode("signature").alias("hash"))
    pairs = found.join(probes, "hash").select("doc_id", "text_md5", "item_id").distinct()
    # Verification: the items found for a document, against the shingles of its whole text.
    per_doc = pairs.join(sig.select(F.col("item_id").alias("_item"), "length", "grams").dropDuplicates(), F.col("item_id").eqNullSafe(F.col("_item"))).groupBy("doc_id", "text_md5")
    per_doc = per_doc.agg(F.collect_set(F.struct("item_id", "length", "grams")).alias("candidates")).select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "candidates")
    both = doc.join(per_doc, (F.col("text_md5") == F.col("_md5")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text_md5", tokens(F.col("text")).alias("w"), "candidates")
    both = both.select("doc_id", "text_md5", F.array_distinct(F.concat(*(_texts("w", n) for n in [shingle, *short]))).alias("shingles"), "candidates")
    checked = both.select("doc_id", "text_md5", F.inline(F.transform("candidates", lambda c: F.struct(
        c["item_id"].alias("item_id"), F.size(F.array_intersect("shingles", c["grams"])).cast("long").alias("n_shared"), F.size(c["grams"]).cast("long").alias("n_shingles")))))
    return checked.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.col("n_shingles") * containment - 1e-9)


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: the items that a document holds."""
    checked = _held(docs, items, containment, shingle)
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_shingles", "b.containment")


def clean(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, shingle: int = SHINGLE) -> DataFrame:
    """The documents that hold no item, with all their columns; a document is its id and its text, as ids may be null or repeated."""
    bad = _held(docs, items, containment, shingle).select(F.col("doc_id").alias("_bad"), F.col("text_md5").alias("_md5")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("_bad")) & (F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == F.col("_md5"))
    return docs.join(bad, same, "left_anti")
