"""Sources mixed to target shares of all tokens.

Each document gets a hash-random key; keys are range-partitioned within their source into buckets, whose token
sums give distributed prefix sums. A source's budget is cut exactly: whole epochs first, then the documents in key
order up to the budget. Only the one bucket of a source in which the cut falls is sorted, so a source of a third
of all rows needs no sort of its own and no task holds more than a bucket of it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralens.io import broadcast_if_small, checkpointed, ship_package

#: Vocabulary file (ranks of a byte-level BPE) as the driver sees it; a parameter everywhere, never part of the repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 4096
#: A list of up to so many sources is broadcast to the whole texts; a longer one is joined by a shuffle.
MAX_SOURCES = 10_000


def with_tokens(docs: DataFrame, keep: tuple[str, ...], text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` plus ``n_tokens``; null and empty texts have none. Special tokens in a text count as ordinary text.

    The vocabulary file is sent to the executors, which need no path to it.
    """
    ship_package(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    fields = docs.select(*keep).schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens bigint"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in batches:
            yield pdf[list(keep)].assign(n_tokens=[len(encode(t)) if isinstance(t, str) else 0 for t in pdf["_t"]])

    return docs.select(*keep, F.col(text).alias("_t")).mapInPandas(run, schema)


def plan_mix(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Budget of each source of ``targets``: ``source, target_share, max_repeats, available, wanted, budget, exact_total``.

    ``counts`` has ``source, n_tokens``. The total is ``total_tokens``, by default all tokens that the targets' sources
    hold. Sources without tokens (or repeats, or share) get 0 and the others share the total in their proportions:
    ``wanted``. A source that can't fill it within its repeats gives all it may, ``budget``, and the shortfall stays
    open, for nobody else's share may grow. ``exact_total`` is the largest total at which no source falls short. Of a
    source listed twice the shares add up and the smaller ``max_repeats`` holds; null repeats mean 1.
    """
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    t = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).join(have, "source", "left")
    t = t.withColumns({"available": F.coalesce("available", F.lit(0)), "target_share": F.coalesce("target_share", F.lit(0.0)), "max_repeats": F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))})
    open_ = (F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    #: The list of targets is small: a window over all of it is one row a source.
    everything = Window.partitionBy(F.lit(1))
    share = F.when(open_, F.col("target_share") / F.sum(F.when(open_, F.col("target_share"))).over(everything)).otherwise(0.0)
    t = t.withColumn("_share", share)
    exact = F.min(F.when(open_, F.col("available") * F.col("max_repeats") / F.col("_share"))).over(everything)
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.sum(F.when(open_, F.col("available"))).over(everything).cast("double")
    t = t.withColumns({"wanted": F.floor(F.coalesce(total, F.lit(0.0)) * F.col("_share") + 1e-6).cast("bigint"), "exact_total": F.floor(F.coalesce(exact, F.lit(0.0)) + 1e-6).cast("bigint")})
    return t.withColumn("budget", F.least(F.col("wanted"), (F.col("available") * F.col("max_repeats")).cast("bigint"))).drop("_share")


def mix_sources(counts: DataFrame, targets: DataFrame, doc: str, seed: int = 0, total_tokens: int | None = None) -> DataFrame:
    """``doc, source, n_tokens, uses``: how often each document of the targets' sources is used (0: not listed).

    ``counts`` has ``doc, source, n_tokens``. The document in which the budget ends is used if more than half of
    it lies within, so a source misses its budget by at most half a document. Equal keys are ordered by ``doc``; a repeated ``doc`` is a document of its own.
    """
    plan = plan_mix(counts, targets, total_tokens)
    cut = plan.where("budget > 0").select("source", F.expr("budget div available").alias("epochs"), F.expr("budget % available").alias("left"))
    key = F.xxhash64(F.lit(seed), F.col(doc))
    docs = counts.select(doc, "source", "n_tokens").join(cut, "source").withColumns({"_k": key, "_b": F.shiftrightunsigned(key, 64 - (BUCKETS.bit_length() - 1))})
    sums = docs.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0)))
    docs = docs.join(sums, ["source", "_b"])
    whole = F.col("_before") + F.col("_sum") <= F.col("left")
    at_cut = ~whole & (F.col("_before") < F.col("left"))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "_b").orderBy("_k", doc).rowsBetween(Window.unboundedPreceding, 0))
    sorted_ = docs.where(at_cut).withColumn("_more", (F.col("_before") + running - F.col("n_tokens") / 2 <= F.col("left")).cast("int"))
    rest = docs.where(~at_cut).withColumn("_more", whole.cast("int"))
    uses = (F.col("epochs") + F.col("_more")).cast("int")
    return rest.unionByName(sorted_).withColumn("uses", uses).where("uses > 0").select(doc, "source", "n_tokens", "uses")


def shares(mixed: DataFrame, counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """What was reached: ``source, target_share, actual_share, available, wanted, budget, shortfall, tokens, documents, most_uses, exact_total``.

    ``shortfall`` is what the source's repeats don't allow of the tokens wanted of it.
    """
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    t = plan_mix(counts, targets, total_tokens).join(used, "source", "left").fillna(0, ["tokens", "documents", "most_uses"])
    actual = F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    return t.withColumns({"actual_share": actual, "shortfall": F.col("wanted") - F.col("budget")}).select("source", "target_share", "actual_share", "available", "wanted", "budget", "shortfall", "tokens", "documents", "most_uses", "exact_total")


def counted(docs: DataFrame, targets: DataFrame, doc: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token counts of the documents of the targets' sources, kept in the shared folder, for they are read more than once."""
    wanted = docs.select(doc, "source", text).join(broadcast_if_small(targets.select("source").distinct(), MAX_SOURCES), "source", "left_semi")
    return checkpointed(with_tokens(wanted, (doc, "source"), text, tokenizer))
