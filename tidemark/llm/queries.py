"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, hardneg, lm, mixing, neardup, periodic, prefixtree, rules, substrings, tokens, toxicity, warc
from tidemark.llm.shared import table, words
from tidemark.llm.sql import SQL  # noqa: F401

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted and read back."""
    odd = "\\### Assistant: </turn> ok"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    turns = chat.canonical(rows.unionByName(more), ("conv_id", "turn"))
    out = chat.format_chats(turns, "conv_id", ["turn"]).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    return decontaminate.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a 150 % mix takes of each document."""
    m = mixing.taken(mixing.mix(table(spark, folder, "documents")))
    return m.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of all documents under the base and the web policy."""
    t = rules.ledger(table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))
    bad = rules.fails(rules.BASE)
    return t.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", bad.alias("base_failed"),
                    (~bad & ~rules.fails(rules.WEB)).alias("kept"), "n_lines", "n_upper", "n_stutters", "failed_bits")


@query
def op8_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    c = neardup.classes(table(spark, folder, "documents"))
    return c.select("doc_id", "class_id")


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    d = substrings.dedup(table(spark, folder, "documents"))
    return d.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_warc_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back."""
    manifest = warc.write_archives(table(spark, folder, "pages"), warc.new_folder(spark), least=0)
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document."""
    return tokens.token_counts(table(spark, folder, "documents"))


@query
def op5_toxicity_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents from the labelled ones that are not held out."""
    docs = table(spark, folder, "documents")
    out = toxicity.held_out(F.col("doc_id"))
    s = toxicity.score(docs, docs.where(~out), table(spark, folder, "labels"))
    return s.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join("terms", " ").alias("terms"))


@query
def op7_recurrent_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log-likelihoods of all documents under the counts and the network of those that learn."""
    docs = table(spark, folder, "documents")
    out = lm.held_out(F.col("doc_id"))
    s = lm.score(docs, docs.where(~out))
    return s.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every fiftieth row, in whole numbers of 1/256."""
    e = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    fine = hardneg.usable(e, F.col("vec_id"), F.col("embedding"), label)
    whole = fine.select("vec_id", "label", F.transform("vector", lambda x: F.floor(256 * x).cast("double")).alias("vector"))
    return hardneg.mine(whole, F.col("vec_id") % 50 == 0)


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every text, after every tenth text by hash was made periodic from some word on."""
    docs = table(spark, folder, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    planted = docs.withColumn("w", words(F.when(F.col("h") % 10 == 0, F.col("text")))).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.col("g") % F.nullif(F.size("w"), F.lit(0)))
    planted = planted.withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence(F.col("a"), F.size("w") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), " "))
    found = periodic.find_runs(planted.select("doc_id", text.alias("text")))
    by = lambda r, s: r["length"] * s["period"] - s["length"] * r["period"]
    order = lambda r, s: F.when(by(r, s) != 0, -F.signum(by(r, s))).when(r["start"] != s["start"], F.signum(r["start"] - s["start"])).otherwise(F.signum(r["period"] - s["period"])).cast("int")
    top = F.get(F.array_sort("runs", order), F.lit(0))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
                        ((1000 * top["length"] - (1000 * top["length"]) % top["period"]) / top["period"]).cast("long").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_prefix_tree_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its number of shingles and the component of its links."""
    return prefixtree.linked(table(spark, folder, "documents"))
