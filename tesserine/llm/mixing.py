"""Problem 9: mixes of sources with target shares.

Method: cube-method balanced sampling.  A mix of budget B (a share of all tokens)
asks source s for T_s = B * share_s tokens (shares are normalised over the
sources that have documents).  A source gives at most max_repeats times its
tokens.  Where a cap binds, ``keep`` decides: "size" gives what is missing to the
sources below their caps, in proportion to their shares, so that the mix keeps its
size while any source has tokens left; "shares" takes the largest mix within the
budget in which every source has its share.
T_s over the source's tokens is a number of whole repeats for every document
plus a fraction, the inclusion probability of one repeat more.

Those fractions are balanced on two totals, tokens and documents.  Flight: while
three documents have fractions, they move along the null space of the two
constraints until one reaches 0 or 1, which leaves both totals as they are, at
most two fractions remain.  Flights run in blocks of bounded size in Spark
(``BLOCK`` documents of a source), then over the fractions the blocks left, until
one block holds them.  Landing: the last two are rounded to the pair of values
nearest to both totals, and one exchange of documents takes up what is left.  Steps are drawn from a generator seeded by mix, source
and block, so each document keeps its inclusion probability and the result is
reproducible.

Defined results: blank and NULL texts are in no mix; a source without documents
gets share 0; shares that are NULL or not positive count as 0; a NULL or negative
max_repeats counts as 1; an empty table gives no rows; a source named twice in a
mix has the sum of its shares.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK = 4096
EPS = 1e-9


def allot(shares: dict[str, float], tokens: dict[str, int], caps: dict[str, int], budget: float) -> dict[str, float]:
    """Tokens to take of each source: water filled up to the caps."""
    want = {s: w for s, w in shares.items() if w > 0 and tokens.get(s, 0) > 0}
    out = dict.fromkeys(want, 0.0)
    rest = budget
    while want and rest > 1e-6:
        unit = rest / sum(want.values())
        full = [s for s, w in want.items() if unit * w >= tokens[s] * caps[s]]
        if not full:
            out.update({s: unit * w for s, w in want.items()})
            break
        for s in full:
            out[s] = float(tokens[s] * caps[s])
            rest -= out[s]
            del want[s]
    return out


def flight(pi: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move fractions within [0, 1], keeping sum(pi) and sum(pi * x), until fewer
    than three are left."""
    pi = pi.astype(float).copy()
    live: list[int] = []
    u = rng.random(2 * len(pi) + 8)
    step = 0
    for k in range(len(pi)):
        if EPS < pi[k] < 1 - EPS:
            live.append(k)
        while len(live) == 3:
            a, b, c = live
            d = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if d[0] == d[1] == d[2] == 0:
                d = (1.0, -1.0, 0.0)
            p = (pi[a], pi[b], pi[c])
            up = min((1 - q) / e if e > 0 else q / -e for q, e in zip(p, d) if e)
            down = min(q / e if e > 0 else (1 - q) / -e for q, e in zip(p, d) if e)
            t = up if u[step % len(u)] * (up + down) < down else -down
            step += 1
            for i, q, e in zip(live, p, d):
                v = q + t * e
                pi[i] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
            live = [i for i in live if 0.0 < pi[i] < 1.0]
    pi[pi <= EPS], pi[pi >= 1 - EPS] = 0.0, 1.0
    return pi


def land(pi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Round the last fractions to the values nearest to the token total, then to
    the document total; then exchange one chosen document for another where that
    comes nearer, which keeps the number of documents."""
    at = np.flatnonzero((pi > 0) & (pi < 1))
    out = pi.copy()
    if len(at):
        tries = [np.array([m >> i & 1 for i in range(len(at))], float) for m in range(1 << len(at))]
        best = min(tries, key=lambda v: (abs(((v - pi[at]) * x[at]).sum()), abs((v - pi[at]).sum()), tuple(v)))
        out[at] = best
        over = float(((out - pi) * x).sum())
        inn, off = np.flatnonzero(out >= 1), np.flatnonzero(out <= 0)
        if len(inn) and len(off) and over:
            off = off[np.argsort(x[off], kind="stable")]
            # The nearest partner, from either side, of each chosen document.
            want = x[inn] - over
            p = np.searchsorted(x[off], want)
            pairs = [(i, off[j]) for q in (p - 1, p) for i, j in zip(inn, q.clip(0, len(off) - 1))]
            i, j = min(pairs, key=lambda t: abs(over - x[t[0]] + x[t[1]]))
            if abs(over - x[i] + x[j]) < abs(over):
                out[i], out[j] = 0.0, 1.0
    return out


def _seed(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))


def _fly(b: pd.DataFrame) -> pd.DataFrame:
    b = b.sort_values(["n", "doc_id"], ascending=[False, True])  # the fractions left over are small documents
    last = bool(b["last"].iloc[0])
    pi = flight(b["pi"].to_numpy(), b["n"].to_numpy(float), np.random.default_rng(_seed(b["mix_id"].iloc[0], b["source"].iloc[0], b["block"].iloc[0], b["level"].iloc[0])))
    if last:
        pi = land(pi, b["n"].to_numpy(float))
    return b[["mix_id", "source", "doc_id", "n"]].assign(pi=pi)


def targets(counts: DataFrame, mixes: DataFrame, keep: str = "size") -> list[tuple]:
    """(mix_id, source, share, cap, tokens of the source, documents, allotment):
    a given small table and a total per source it names."""
    given = mixes.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap"), F.max("budget_share").alias("b")
    )
    rows = given.orderBy("mix_id", "source").collect()
    named = given.select("source").distinct()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    have = {r["source"]: (r["t"], r["d"]) for r in counts.join(F.broadcast(named), "source", "left_semi").groupBy("source").agg(F.sum("n").alias("t"), F.count("*").alias("d")).collect()}
    out = []
    for mix in sorted({r["mix_id"] for r in rows}):
        own = [r for r in rows if r["mix_id"] == mix]
        w = {r["source"]: r["w"] for r in own}
        caps = {r["source"]: int(r["cap"]) if r["cap"] and r["cap"] > 0 else 1 for r in own}
        tokens = {s: have.get(s, (0, 0))[0] for s in w}
        budget = max((r["b"] or 0.0) for r in own) * total
        if keep == "shares":
            live = {s: x for s, x in w.items() if x > 0 and tokens[s]}
            budget = min([budget, *(tokens[s] * caps[s] * sum(live.values()) / x for s, x in live.items())])
        got = allot(w, tokens, caps, budget)
        base = sum(w.values()) or 1.0
        out += [(mix, s, w[s] / base, caps[s], tokens[s], have.get(s, (0, 0))[1], got.get(s, 0.0)) for s in sorted(w)]
    return out


_TARGET = "mix_id string, source string, share double, cap long, src_tokens long, src_docs long, allotted double"


def sample(counts: DataFrame, mixes: DataFrame, keep: str = "size") -> tuple[DataFrame, DataFrame]:
    """((mix_id, source, doc_id, n, repeats) of the chosen documents, targets)."""
    spark = counts.sparkSession
    want = spark.createDataFrame(targets(counts, mixes, keep), _TARGET)
    per = want.where("allotted > 0").withColumn("rate", F.col("allotted") / F.col("src_tokens"))
    per = per.select("mix_id", "source", "src_docs", F.least(F.floor(F.col("rate") + EPS), "cap").cast("long").alias("whole"), F.greatest(F.col("rate") - F.floor(F.col("rate") + EPS), F.lit(0.0)).alias("pi"))
    each = counts.join(F.broadcast(per), "source")
    whole = each.where("whole > 0").select("mix_id", "source", "doc_id", "n", F.col("whole").alias("times"))
    live = each.where(F.col("pi") > EPS).select("mix_id", "source", "doc_id", "n", "pi", F.ceil(F.col("src_docs") / BLOCK).alias("blocks"))
    chosen = []
    schema = "mix_id string, source string, doc_id long, n long, pi double"
    most = max([r["src_docs"] for r in want.select("src_docs").collect()], default=0)
    level = 0
    while True:
        blocks = max(1, -(-most // BLOCK))
        b = live.withColumn("level", F.lit(level)).withColumn("last", F.col("blocks") <= 1).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.col("blocks")))
        flown = cut(b.groupBy("mix_id", "source", "block").applyInPandas(_fly, schema))
        chosen.append(flown.where("pi >= 1").select("mix_id", "source", "doc_id", "n", F.lit(1).cast("long").alias("times")))
        if blocks == 1:
            break
        left = flown.where("pi > 0 and pi < 1")
        # At most two documents of a block are left.
        size = left.groupBy("mix_id", "source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        live = left.join(F.broadcast(size), ["mix_id", "source"])
        most, level = 2 * blocks, level + 1
    every = whole
    for c in chosen:
        every = every.unionByName(c)
    return every.groupBy("mix_id", "source", "doc_id", "n").agg(F.sum("times").alias("repeats")), want


def mix(counts: DataFrame, mixes: DataFrame) -> DataFrame:
    return sample(counts, mixes)[0].withColumnRenamed("n", "tokens")


def shares(counts: DataFrame, mixes: DataFrame, keep: str = "size") -> DataFrame:
    """Per mix and source the target and the actual share of tokens."""
    got, want = sample(counts, mixes, keep)
    by = got.groupBy("mix_id", "source").agg(F.count("*").alias("docs"), F.sum("repeats").alias("records"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n") * F.col("repeats")).alias("tokens"))
    total = by.groupBy("mix_id").agg(F.sum("tokens").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        want.join(by, ["mix_id", "source"], "left")
        .join(total, "mix_id", "left")
        .select(
            "mix_id", "source", F.round("share", 6).alias("target_share"), F.round(F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0)), 6).alias("actual_share"),
            F.round("allotted", 3).alias("allotted_tokens"), zero("tokens"), zero("docs"), zero("records"), zero("most_repeats"), F.col("cap").alias("max_repeats"),
            (F.col("allotted") >= F.col("src_tokens") * F.col("cap") - 0.5).alias("capped"),
        )
    )
