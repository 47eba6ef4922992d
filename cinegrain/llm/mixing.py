"""Mixing sources to target weights: tempered shares within repetition limits, realised by block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinegrain.session import cut

MOST_SOURCES = 10_000
BLOCK_DOCUMENTS = 2000


def tempered(natural: dict[str, float], target: dict[str, float], power: float) -> dict[str, float]:
    """Shares in proportion to natural**(1 - power) * target**power: 0 is the corpus as it is, 1 the target."""
    logs = {s: (1 - power) * math.log(natural[s]) + power * math.log(target[s]) for s in natural}
    top = max(logs.values())
    raw = {s: math.exp(v - top) for s, v in logs.items()}
    total = sum(raw.values())
    return {s: v / total for s, v in raw.items()}


def cross_entropy(target: dict[str, float], shares: dict[str, float]) -> float:
    """Nats that records drawn by the target shares cost under the mixture's; the target's own entropy at the least."""
    return -sum(t * math.log(shares[s]) for s, t in target.items())


def _largest(ok, low: float = 0.0, high: float = 1.0) -> float:
    """The largest power for which ``ok`` holds, by bisection; ``low`` if it holds for none above."""
    if ok(high):
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if ok(middle) else (low, middle)
    return low


def plan_mixture(tokens: dict[str, int], weights: dict[str, float], repeats: dict[str, int], budget: int | None = None, entropy_loss: float = 0.0) -> dict[str, dict]:
    """For each source: target and planned share, budget in tokens and repeats of the source.

    Sources without tokens or weight take no part; the others' weights are relative. Shares are exponentiated between
    the corpus' own (power 0) and the target ones (power 1). Without ``budget`` the target entropy decides: if the
    target shares can't be met with as many tokens as the sources have, the power is bisected to the least whose
    cross-entropy with the target is at most ``entropy_loss`` nats above the target's own entropy (it falls as the
    power rises), but not below what a mixture of that size needs; the mixture is then as large as the repetition
    limits allow, and of the sources' size at most. With ``budget`` the repetition limits decide: the power is bisected
    to the largest, at most 1, that keeps every source within its limit, and if even the corpus' own shares do not,
    the budget is what the limits allow.
    """
    use = [s for s in sorted(weights) if tokens.get(s, 0) > 0 and weights[s] > 0 and repeats.get(s, 1) > 0]
    positive = sum(w for w in weights.values() if w > 0)
    plan = {s: {"target": max(w, 0.0) / positive if positive else 0.0, "share": 0.0, "budget": 0, "repeats": 0.0, "power": None} for s, w in weights.items()}
    if not use:
        return plan
    own = sum(tokens[s] for s in use)
    natural = {s: tokens[s] / own for s in use}
    wanted = sum(weights[s] for s in use)
    target = {s: weights[s] / wanted for s in use}
    limit = {s: repeats.get(s, 1) * tokens[s] for s in use}
    within = lambda p, size: all(share * size <= limit[s] * (1 + 1e-9) for s, share in tempered(natural, target, p).items())
    if budget is None:
        entropy = cross_entropy(target, target) + entropy_loss
        # 1 less the largest loss of power that the target entropy allows.
        least = 1 - _largest(lambda loss: cross_entropy(target, tempered(natural, target, 1 - loss)) <= entropy + 1e-12) if entropy_loss > 0 else 1.0
        power = max(least, _largest(lambda p: within(p, own)))
        budget = int(min(own, min(limit[s] / share for s, share in tempered(natural, target, power).items())))
    else:
        budget = min(budget, sum(limit.values()))
        power = _largest(lambda p: within(p, budget))
    shares = tempered(natural, target, power)
    for s, share in shares.items():
        size = min(int(round(share * budget)), limit[s])
        plan[s] |= {"share": share, "budget": size, "repeats": size / tokens[s], "power": power}
    return plan


def mixture_plans(spark: SparkSession, counted: DataFrame, targets: DataFrame, budget: int | None = None, entropy_loss: float = 0.0) -> DataFrame:
    """(mix_id, source, target, share, budget, repeats, power, tokens, documents) of every row of ``targets``.

    The tokens of each source are one sum over all documents; the plans are worked out on the driver from one number
    per named source, of which there may be MOST_SOURCES.
    """
    named = targets.filter("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    sizes = counted.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = named.join(sizes, "source", "left").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} named sources")
    out = []
    for mix in sorted({r["mix_id"] for r in rows}):
        own = {r["source"]: r for r in rows if r["mix_id"] == mix}
        tokens = {s: r["tokens"] or 0 for s, r in own.items()}
        for s, p in plan_mixture(tokens, {s: r["weight"] for s, r in own.items()}, {s: r["most"] for s, r in own.items()}, budget, entropy_loss).items():
            out.append((mix, s, p["target"], p["share"], p["budget"], float(p["repeats"]), p["power"], tokens[s], own[s]["documents"] or 0))
    return spark.createDataFrame(out, "mix_id string, source string, target double, share double, budget long, repeats double, power double, tokens long, documents long")


def mix_documents(counted: DataFrame, plans: DataFrame, seed: int = 17) -> DataFrame:
    """(mix_id, source, doc_id, epoch, n_tokens): the documents of each mixture, ``epoch`` counting their uses from 1.

    Whole repeats take every document of the source once. The last, partial one takes documents in a random order up
    to the budget: each source is cut into blocks of some BLOCK_DOCUMENTS by a hash, blocks into ranges, as many as a
    range has blocks; ranges come in random order, so do the blocks of a range and the documents of a block. What is
    before a document is the sum of three running sums, over ranges, blocks and documents, none of which orders more
    than the square root of a source's blocks, or one block, in a task. The document that would pass the budget is the
    first left out, so a source's size falls short by less than a document. The plans, MOST_SOURCES rows at most, are
    the only thing broadcast.

    Defined cases: null sources and documents without tokens take part in no mixture; repeated rows count as often.
    """
    live = plans.filter("budget > 0").select("mix_id", "source", "budget", "tokens", F.ceil(F.col("documents") / BLOCK_DOCUMENTS).alias("blocks"))
    docs = counted.filter("source is not null and n_tokens > 0").select("source", "doc_id", "n_tokens")
    use = docs.join(F.broadcast(live), "source")
    use = use.withColumn("block", F.pmod(F.xxhash64("doc_id", "mix_id", F.lit(seed)), F.col("blocks"))).withColumn("range", F.pmod(F.col("block"), F.ceil(F.sqrt("blocks"))))
    use = use.select("mix_id", "source", "doc_id", "n_tokens", "budget", "tokens", "range", "block")
    full = F.floor(F.col("budget") / F.col("tokens")).cast("int")
    rest = F.col("budget") - F.floor(F.col("budget") / F.col("tokens")) * F.col("tokens")

    def before(by, own):
        order = Window.partitionBy(*by).orderBy(F.xxhash64(own, "mix_id", F.lit(seed + 1)), own).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("sum").over(order), F.lit(0))

    blocks = use.groupBy("mix_id", "source", "range", "block").agg(F.sum("n_tokens").alias("sum"))
    ranges = blocks.groupBy("mix_id", "source", "range").agg(F.sum("sum").alias("sum"))
    ranges = ranges.select("mix_id", "source", "range", before(["mix_id", "source"], "range").alias("before_range"))
    blocks = blocks.select("mix_id", "source", "range", "block", before(["mix_id", "source", "range"], "block").alias("before_block"))
    placed = use.join(blocks.join(ranges, ["mix_id", "source", "range"]).select("mix_id", "source", "block", (F.col("before_range") + F.col("before_block")).alias("before")), ["mix_id", "source", "block"])
    inner = Window.partitionBy("mix_id", "source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    taken = placed.withColumn("up_to", F.col("before") + F.sum("n_tokens").over(inner))
    uses = full + F.when(F.col("up_to") <= rest, 1).otherwise(0)
    return taken.withColumn("uses", uses).filter("uses > 0").select("mix_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("epoch"), "n_tokens")


def actual_shares(mixed: DataFrame, plans: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, planned_share, actual_share, n_tokens, n_documents, repeats) of every named source."""
    got = mixed.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_documents"))
    total = F.sum("n_tokens").over(Window.partitionBy("mix_id"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = plans.join(got, ["mix_id", "source"], "left").withColumn("all", total)
    return joined.select(
        "mix_id", "source", F.col("target").alias("target_share"), F.col("share").alias("planned_share"), F.coalesce(F.col("n_tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"),
        zero("n_tokens").alias("n_tokens"), zero("n_documents").alias("n_documents"), F.when(F.col("tokens") > 0, zero("n_tokens") / F.col("tokens")).otherwise(0.0).alias("repeats"),
    )


def counted_once(counted: DataFrame) -> DataFrame:
    """Token counts computed once for the plans and the mixture."""
    return cut(counted)
