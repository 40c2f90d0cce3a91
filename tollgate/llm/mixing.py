"""Operator 4: mixing sources to target weights.

Source weights are the sources' token shares raised to an exponent between 0
(uniform) and 1 (as they come), normalised.  The exponent is found by
bisection, six halvings to a Spark job: the smallest one that keeps the most
repeated source within ``max_repeats``, or the largest that reaches
``min_entropy`` (nats).  Without a budget, the token budget is the smallest
that uses every document at least once.

Each source's quota is dealt out epoch by epoch.  An epoch is a keyed
permutation of the source's blocks (documents by hash, about ``BLOCK`` each)
and of the documents in a block.  Whole epochs and whole blocks need no sort;
only the block where a quota ends is walked document by document, up to the
first document that reaches it.  So a source with a third of all rows is never
in one task; a window runs over the (``BLOCK`` times smaller) table of blocks.

A document counts its words, one at least, as tokens.  Null sources form a
source of their own; null ids are ordered by their text's hash; repeated rows
are documents of their own.  An empty table gives an empty result.  Only
DataFrame functions are used."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

BLOCK = 1000
ROUNDS, CUTS = 4, 64  # 24 halvings


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(key, source, id, mark, tokens): mark orders documents, key groups them."""
    source = F.col(source_col).cast("string")
    mark = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    tokens = F.greatest(F.coalesce(F.regexp_count(text_col, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)), F.lit(1)).cast("long")
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"), source.alias("source"),
        F.col(id_col).alias("id"), mark.alias("mark"), tokens.alias("tokens"),
    )


def exponent(
    shares: DataFrame, max_repeats: float | None, min_entropy: float | None, budget: float | None
) -> float:
    """Bisect the exponent; ``shares`` has one row (tokens, p) for each source."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
        a, p = F.col("a"), F.col("p")
        at = shares.withColumn("a", F.explode(F.array(*map(F.lit, grid)))).groupBy("a").agg(
            F.sum(F.pow(p, a)).alias("z"), F.sum(F.pow(p, a) * F.log(p)).alias("zl"),
            F.max(F.pow(p, a - 1)).alias("scarce"), F.max(F.pow(p, 1 - a)).alias("plenty"), F.sum("tokens").alias("tokens"),
        )
        repeats = F.col("scarce") * (F.col("plenty") if budget is None else F.lit(float(budget)) / (F.col("z") * F.col("tokens")))
        entropy = F.log("z") - a * F.col("zl") / F.col("z")
        good = F.lit(True)
        if max_repeats is not None:
            good = good & (repeats <= max_repeats)
        if min_entropy is not None and max_repeats is None:
            good = entropy < min_entropy  # the first exponent that misses it
        first = at.agg(F.min(F.when(good, a))).first()[0]
        if first is None:
            return high
        if first == low:
            return low
        high = first
        low = grid[grid.index(first) - 1]
    return low if min_entropy is not None and max_repeats is None else high


def schedule(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    max_repeats: float | None = 1.5, min_entropy: float | None = None, budget: float | None = None,
    seed: str = "mix",
) -> DataFrame:
    """One row for each use of a document: id_col, source, tokens, weight (of
    its source), epoch, block, and at, the place of its block in its source's
    quota (0 to 1): ordering by ``at`` interleaves the sources."""
    rows = stored(sized(docs, id_col, text_col, source_col))
    of = rows.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    total = of.agg(F.sum("tokens")).first()[0] or 0
    shares = stored(of.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1)))))
    a = exponent(shares, max_repeats, min_entropy, budget)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weights = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(z))
    if budget is None:
        budget = weights.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    weights = weights.select(
        "key", F.col("tokens").alias("all_tokens"), "weight", (F.col("weight") * F.lit(float(budget))).alias("quota"),
        F.ceil(F.col("docs") / BLOCK).cast("long").alias("blocks"),
    )
    first8 = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.col("mark"))), 1, 8), 16, 10).cast("long")
    placed = rows.join(weights.select("key", "blocks"), "key").withColumn("block", first8 % F.col("blocks")).drop("blocks")
    blocks = placed.groupBy("key", "block").agg(F.sum("tokens").alias("block_tokens"))
    # A quota that ends on a whole epoch, but for rounding, has no further one.
    epochs = F.greatest(F.ceil(F.col("quota") / F.col("all_tokens") - 1e-9), F.lit(1)).cast("int")
    dealt = blocks.join(weights, "key").withColumn("epoch", F.explode(F.sequence(F.lit(1), epochs)))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.col("block").cast("string")))
    walk = Window.partitionBy("key", "epoch").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn(
        "before", F.sum("block_tokens").over(walk) - F.col("block_tokens") + (F.col("epoch") - 1) * F.col("all_tokens")
    )
    left = F.col("quota") * (1 + 1e-12) - F.col("before")
    dealt = dealt.withColumn("left", left).where("left > 0").select(
        "key", "block", "epoch", "weight", "left", (F.col("left") >= F.col("block_tokens")).alias("whole"),
        (F.col("before") / F.col("quota")).alias("at"),
    )
    used = placed.join(stored(dealt), ["key", "block"])
    inner = Window.partitionBy("key", "epoch", "block").orderBy(
        F.md5(F.concat_ws("|", F.lit(seed), F.col("epoch").cast("string"), F.col("mark"))), "mark", "tokens"
    ).rowsBetween(Window.unboundedPreceding, 0)
    ends = used.where("not whole").withColumn("running", F.sum("tokens").over(inner) - F.col("tokens")).where("running < left")
    out = used.where("whole").unionByName(ends.drop("running"))
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", "weight", "epoch", "block", "at", "mark"
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with each row as often as the mix uses it, in all its columns."""
    text = how.get("text_col", "text")
    own, epochs, use = (fresh(docs.columns, n) for n in ("mark", "epochs", "use"))
    uses = schedule(docs, id_col, **how).groupBy(F.col("mark").alias(own)).agg(F.countDistinct("epoch").alias(epochs))
    # Rows that share an id share its mark, and with it the epochs.
    mark = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.withColumn(own, mark).join(uses, own)
    return rows.withColumn(use, F.explode(F.sequence(F.lit(1), F.col(epochs).cast("int")))).select(*docs.columns)
