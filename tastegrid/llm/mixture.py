"""Mixing sources to target shares of tokens: entropy balancing, rounded into copies.

Every record gets a rate min(cap, exp(lambda_s * t)), the exponentially tilted weight closest (in relative entropy)
to one use of each record, with lambda_s per source such that the expected tokens of each source meet its share. The
dual is convex; Newton steps (kept inside a bracket by bisection) run over the distributed table of
(source, tokens, records), one aggregate per step for all sources. Rates are rounded by systematic sampling: along
the records of a source in order of their size (then hash), copies follow the running sum of rates, so every range of
sizes gets its expected number of copies within one, and the drawn tokens follow closely. The running sum is taken per
(source, size, hash bucket) and the sums of these are chained, so a task holds at most one row for each size that texts of a source have.

The total is given, or the largest at which every source that has tokens can reach its share under its cap.
Sources without tokens cannot be mixed: their share is reported as 0 and the others are scaled to what they can hold.

Defined results: records without text, without tokens or of an unlisted source are not drawn; null ids are not
drawn; spellings of a source (case, blanks, hyphens) are one; an empty table gives no copies and zero shares.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.plans.scratch import cut, ship_package

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces remembered by a worker; beyond it the memory is started anew.
_MEMO = 200_000
#: Hash buckets per source and size, so that many records of one size do not meet in one task.
BUCKETS = 64

_STATE: dict = {}


def _counter(path: str) -> Callable[[str], int]:
    """Tokens of a text under a byte-level BPE; equal pieces are encoded once."""
    if _STATE.get("path") != path:
        import regex
        import tiktoken

        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _STATE.update(path=path, encode=encoding.encode_ordinary, pieces=regex.compile(public_tokenizers.PATTERN).findall, memo={})
    encode, pieces = _STATE["encode"], _STATE["pieces"]

    def count(text: str) -> int:
        memo, total = _STATE["memo"], 0
        for piece in pieces(text):
            n = memo.get(piece)
            if n is None:
                n = len(encode(piece))
                if len(memo) >= _MEMO:
                    memo.clear()
                if len(piece) < 64:
                    memo[piece] = n
            total += n
        return total

    return count


def _token_mapper(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            n = [0 if t is None else count(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "source", "tokens"])

    return run


def one_spelling(source: Column) -> Column:
    """Lower case, trimmed, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def token_counts(documents: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) of every document with a text."""
    ship_package(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), one_spelling(F.col(source_col)).alias("source"), F.col(text_col).alias("text")).where("id is not null and text is not null and source is not null")
    return rows.mapInArrow(_token_mapper(tokenizer), f"id {kind}, source string, tokens long")


def _solve(histogram: DataFrame, goals: dict[str, float], caps: dict[str, int], scale: dict[str, float]) -> dict[str, float]:
    """lambda per source; every step aggregates the distributed histogram once for all unsolved sources."""
    lam = dict.fromkeys(goals, 0.0)
    low, high = dict.fromkeys(goals, -math.inf), dict.fromkeys(goals, math.inf)
    open_, gaps = set(goals), {}
    for _ in range(60):
        if not open_:
            break
        x, m = F.lit(None).cast("double"), F.lit(None).cast("double")
        for s in open_:
            x = F.when(F.col("source") == s, F.lit(lam[s] / scale[s]) * F.col("tokens")).otherwise(x)
            m = F.when(F.col("source") == s, F.lit(math.log(caps[s]))).otherwise(m)
        t = F.col("tokens").cast("double")
        w = F.exp(F.least("x", "m")) * F.col("n")
        rows = histogram.where(F.col("source").isin(list(open_))).withColumn("x", x).withColumn("m", m).groupBy("source").agg(F.sum(w * t).alias("f"), F.sum(F.when(F.col("x") < F.col("m"), w * t * t)).alias("d")).collect()
        for r in rows:
            s, gap = r["source"], r["f"] - goals[r["source"]]
            gaps[s] = abs(gap) / goals[s]
            if abs(gap) <= 1e-9 * goals[s]:
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - gap * scale[s] / r["d"] if r["d"] else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else lam[s] + (2.0 if gap < 0 else -2.0) * max(1.0, abs(lam[s]))
            if step == lam[s] or abs(step) > 1e6:
                open_.discard(s)
            lam[s] = step
    missed = {s: g for s, g in gaps.items() if g > 1e-4}
    if missed:
        raise RuntimeError(f"no tilt found that meets the targets of {missed}")
    return lam


def mixture(documents: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, source, tokens, rate, copies) of the drawn records, and per target source
    (source, target_share, max_repeats, n_records, tokens_available, tokens_drawn, share)."""
    spark = documents.sparkSession
    goals_table = targets.select(one_spelling(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in goals_table.collect()}
    counted = cut(token_counts(documents, id_col, text_col, source_col, tokenizer).where(F.col("tokens") > 0).join(F.broadcast(goals_table.select("source")), "source", "left_semi"))
    histogram = cut(counted.groupBy("source", "tokens").agg(F.count("*").alias("n")))
    have = {r["source"]: (r["t"], r["n"]) for r in histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    usable = {s: v for s, v in wanted.items() if s in have and v[0] > 0 and v[1] > 0}
    share_sum = sum(v[0] for v in usable.values())
    most = min((have[s][0] * v[1] / (v[0] / share_sum) for s, v in usable.items()), default=0.0)
    total = min(total_tokens, most) if total_tokens is not None else most
    goals = {s: total * v[0] / share_sum for s, v in usable.items()}
    caps = {s: v[1] for s, v in usable.items()}
    # at the cap itself the tilt is unbounded: every record takes its cap
    full = {s for s in goals if goals[s] >= have[s][0] * caps[s] * (1 - 1e-9)}
    lam = _solve(histogram, {s: g for s, g in goals.items() if s not in full}, caps, {s: have[s][0] / have[s][1] for s in goals})
    rate = F.lit(0.0)
    for s in goals:
        tilt = F.lit(float(caps[s])) if s in full else F.least(F.lit(float(caps[s])), F.exp(F.lit(lam[s] * have[s][1] / have[s][0]) * F.col("tokens")))
        rate = F.when(F.col("source") == s, tilt).otherwise(rate)
    h = F.xxhash64(F.col("id").cast("string"))
    placed = counted.withColumn("rate", rate).withColumn("h", h).withColumn("bucket", F.pmod(h, F.lit(BUCKETS)).cast("int"))
    keys = ["source", "tokens", "bucket"]
    mass = placed.groupBy(*keys).agg(F.sum("rate").alias("mass"))
    # offsets are chained in two steps: over a source's sizes, then over the buckets of one size
    before = Window.partitionBy("source").orderBy("tokens").rowsBetween(Window.unboundedPreceding, -1)
    sizes = mass.groupBy("source", "tokens").agg(F.sum("mass").alias("all")).withColumn("lower", F.coalesce(F.sum("all").over(before), F.lit(0.0))).select("source", "tokens", "lower")
    inside = Window.partitionBy("source", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = mass.join(sizes, ["source", "tokens"]).withColumn("offset", F.col("lower") + F.coalesce(F.sum("mass").over(inside), F.lit(0.0))).drop("mass", "lower")
    within = Window.partitionBy(*keys).orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.join(offset, keys).withColumn("upto", F.col("offset") + F.sum("rate").over(within))
    cap = F.lit(0)
    for s, c in caps.items():
        cap = F.when(F.col("source") == s, F.lit(c)).otherwise(cap)
    copies = F.floor(F.col("upto") + 0.5 + 1e-9) - F.floor(F.col("upto") - F.col("rate") + 0.5 + 1e-9)
    drawn = cut(run.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), cap).cast("int")).select("id", "source", "tokens", "rate", "copies"))
    sums = drawn.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("tokens").alias("tokens_available"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_drawn"))
    all_drawn = F.sum("tokens_drawn").over(Window.partitionBy())
    report = goals_table.join(sums, "source", "left").na.fill(0, ["n_records", "tokens_available", "tokens_drawn"])
    report = report.withColumn("share", F.coalesce(F.col("tokens_drawn") / F.nullif(all_drawn, F.lit(0)), F.lit(0.0)))
    return drawn.where("copies > 0"), report
