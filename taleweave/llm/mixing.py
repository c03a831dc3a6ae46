"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected to be used ``target tokens / source's tokens`` times. The
expectations are summed up along the source in an order stratified by length; one random offset per
source is added, and a document is emitted once for every whole number its interval crosses. So each
document is used floor or ceil of its expectation, and each source reaches its size to within about
one document of each stratum.

The prefix sum is two-level: sums per bucket (source, length class, hash) are added up over the few
bucket rows, and within a bucket by a window. A source with a third of all rows spreads over all its
buckets. Amounts are integers (2**-20 of a copy), so a lost and repeated task gives the same draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from taleweave.plans.shared import cut

UNIT = 1 << 20
#: Hash buckets per source and length class.
BUCKETS = 256
#: Where the public tokenizers lie; a parameter, as the files are never part of this package.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Splitting pattern of the byte-level vocabularies, a fixed value of theirs.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def _encoder(path: str):
    import base64

    import tiktoken

    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_tokens(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source and n_tokens of the whole text; null and empty texts have 0 tokens."""
    path = f"{tokenizers}/{vocabulary}"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for b in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": n})

    return documents.select("doc_id", "source", "text").mapInPandas(count, "doc_id long, source string, n_tokens long")


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """What each source gives: source, n_docs, source_tokens, target_share, max_repeats, draw_tokens, copies.

    ``sizes``: source, n_docs, source_tokens. ``targets``: source, target_share, max_repeats; repeated
    rows count once, null or non-positive shares and repeats are no targets. ``draw_tokens`` is the
    source's part of ``total``; ``copies`` how often a document of it is to be expected, at most
    max_repeats. Without ``total`` the largest draw is planned in which no source needs more than its
    repeats. Sources without documents keep their target with copies 0, and the others share the
    draw in proportion; sources without a target are not drawn.
    """
    t = targets.where("target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats").distinct()
    both = t.join(sizes.where("source_tokens > 0"), "source", "left")
    w = Window.partitionBy()  # one row per source
    share = F.col("target_share") / F.sum(F.when(F.col("source_tokens").isNotNull(), F.col("target_share"))).over(w)
    both = both.withColumn("share", F.when(F.col("source_tokens").isNotNull(), share))
    size = F.lit(total) if total else F.min(F.col("source_tokens") * F.col("max_repeats") / F.col("share")).over(w)
    both = both.withColumn("draw_tokens", F.coalesce(F.col("share") * size, F.lit(0.0)))
    copies = F.least(F.col("draw_tokens") / F.col("source_tokens"), F.col("max_repeats").cast("double"))
    return both.select(
        "source",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        "target_share",
        "max_repeats",
        "draw_tokens",
        F.coalesce(copies, F.lit(0.0)).alias("copies"),
    )


def draw(tokens: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42) -> DataFrame:
    """The drawn documents: doc_id, source, n_tokens, copies (at least 1).

    ``tokens``: doc_id, source, n_tokens, one row per document (repeated rows count once); null
    sources and documents without tokens are not drawn. Which documents get the odd copy depends on
    ``seed`` and doc_id only.
    """
    tokens = tokens.where("source is not null and n_tokens > 0").select("doc_id", "source", "n_tokens").distinct()
    sizes = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("source_tokens"))
    # One row per source with a target: bounded by the targets given.
    planned = plan(sizes, targets, total).select("source", F.round(F.col("copies") * UNIT).cast("long").alias("step"), "max_repeats")
    mix = F.xxhash64("doc_id", F.lit(seed))
    marked = (
        tokens.join(F.broadcast(planned), "source")
        .withColumn("order", mix)
        .withColumn("stratum", F.floor(F.log2(F.col("n_tokens").cast("double")) * 4).cast("int"))
        .withColumn("bucket", F.pmod(mix, F.lit(BUCKETS)).cast("int"))
    )
    groups = ["source", "stratum", "bucket"]
    sums = marked.groupBy(*groups).agg(F.sum("step").alias("amount"))
    before = Window.partitionBy("source").orderBy("stratum", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *groups,
        (F.coalesce(F.sum("amount").over(before), F.lit(0)) + F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(UNIT))).alias("base"),
    )
    along = Window.partitionBy(*groups).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = marked.withColumn("upto", F.sum("step").over(along)).join(offsets, groups)
    crossed = F.expr(f"(base + upto) div {UNIT} - (base + upto - step) div {UNIT}")  # whole numbers throughout
    copies = F.least(crossed.cast("int"), F.col("max_repeats"))
    return upto.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def reached(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """Shares of the draw's tokens per source, beside the targets; sources that gave nothing have 0."""
    got = drawn.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"),
        F.count(F.lit(1)).alias("drawn_docs"),
        F.max("copies").alias("most_copies"),
    )
    out = planned.join(got, "source", "left").na.fill(0, ["drawn_tokens", "drawn_docs", "most_copies"])
    all_ = F.sum("drawn_tokens").over(Window.partitionBy())
    return out.select(
        "source", "target_share", "max_repeats", "n_docs", "source_tokens", "drawn_docs", "drawn_tokens", "most_copies",
        F.round(F.col("drawn_tokens") / all_, 6).alias("reached_share"),
    )


def canonical_source(source):
    """``Scene Summary``, ``scene-summary `` and ``SCENE_SUMMARY`` are one source."""
    return F.lower(F.regexp_replace(F.trim(source), r"[\s\-]+", "_"))


def draw_and_report(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The draw and its report; texts are tokenised once."""
    tokens = cut(with_tokens(documents.withColumn("source", canonical_source(F.col("source")))), "tokens")
    targets = targets.withColumn("source", canonical_source(F.col("source")))
    drawn = draw(tokens, targets, total, seed)
    sizes = tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("source_tokens"))
    return drawn, reached(drawn, plan(sizes, targets, total))
