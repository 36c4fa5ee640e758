"""Packets to flows.

Input: decoded packets (packet_id, ts, src, dst, sport, dport, proto, bytes, flags, win).
A flow is the traffic of one pair of endpoints, in both directions, without a pause longer
than the gap. Its forward direction is that of its first packet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.fixed import TCP_FLAGS
from flowlake.functions.times import micros
from flowlake.plans.ordered import ordered_slices, running_totals, with_previous

PAIR = ["proto", "a_ip", "a_port", "b_ip", "b_port"]
FLOW = [*PAIR, "flow_seq"]


def with_endpoints(packets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Endpoints in a fixed order (a, b) for both directions; ``from_a`` tells the sender."""
    here, there = F.struct("src", "sport"), F.struct("dst", "dport")
    forward = here <= there

    def pick(yes: str, no: str) -> Column:
        return F.when(forward, F.col(yes)).otherwise(F.col(no))

    return packets.select(
        *keep, "packet_id", micros(F.col("ts")).alias("us"), "proto",
        pick("src", "dst").alias("a_ip"), pick("sport", "dport").alias("a_port"),
        pick("dst", "src").alias("b_ip"), pick("dport", "sport").alias("b_port"),
        forward.alias("from_a"), "bytes", "flags", "win")


def sessionize_packets(packets: DataFrame, gap_seconds: float) -> DataFrame:
    """``flow_seq`` numbers a pair's flows from 1; a new one starts after a longer gap."""
    order = ["us", "packet_id"]
    sliced = ordered_slices(with_endpoints(packets), PAIR, order, "packets")
    paused = with_previous(sliced, PAIR, order, "us", "_before")
    starts = F.col("_before").isNull() | (F.col("us") - F.col("_before") > int(gap_seconds * 1e6))
    flagged = paused.withColumn("_starts", starts.cast("bigint"))
    return running_totals(flagged, PAIR, order, {"flow_seq": "_starts"}) \
        .drop("_before", "_starts", "_slice")


def flow_aggregates() -> list[Column]:
    """Per-direction partial aggregates of one flow.

    Mean gaps need no ordering: the gaps of a run add up to last minus first.
    """
    side = {"a": F.col("from_a"), "b": ~F.col("from_a")}
    place = F.struct("us", "packet_id")
    out = [F.min("us").alias("first_us"), F.max("us").alias("last_us"),
           F.min_by("from_a", place).alias("a_opened")]
    for s, mine in side.items():
        at = F.when(mine, F.col("us"))
        out += [F.count_if(mine).alias(f"{s}_pkts"),
                F.sum(F.when(mine, F.col("bytes"))).alias(f"{s}_bytes"),
                F.min(at).alias(f"{s}_first"), F.max(at).alias(f"{s}_last"),
                F.min_by("win", F.when(mine, place)).alias(f"{s}_win")]
    return out + [F.count_if(F.col("flags").bitwiseAND(bit) != 0).alias(f"{name}_flag_cnt")
                  for name, bit in TCP_FLAGS.items()]


def meter_flows(sessionized: DataFrame) -> DataFrame:
    """One row per flow."""
    return flow_features(sessionized.groupBy(*FLOW).agg(*flow_aggregates()), FLOW)


def flow_features(both: DataFrame, keys: list[str]) -> DataFrame:
    """Forward and backward figures from those of endpoints a and b."""
    def fwd(name: str) -> Column:
        return F.when(F.col("a_opened"), F.col(f"a_{name}")).otherwise(F.col(f"b_{name}"))

    def bwd(name: str) -> Column:
        return F.when(F.col("a_opened"), F.col(f"b_{name}")).otherwise(F.col(f"a_{name}"))

    return _named_features(both.select(
        "*", fwd("pkts").alias("tot_fwd_pkts"), bwd("pkts").alias("tot_bwd_pkts"),
        F.coalesce(fwd("bytes"), F.lit(0)).alias("fwd_bytes"),
        F.coalesce(bwd("bytes"), F.lit(0)).alias("bwd_bytes"),
        (fwd("last") - fwd("first")).alias("fwd_span"), (bwd("last") - bwd("first")).alias("bwd_span"),
        fwd("win").alias("init_fwd_win_byts"), bwd("win").alias("init_bwd_win_byts")), keys)


def _named_features(f: DataFrame, keys: list[str]) -> DataFrame:
    duration = F.col("last_us") - F.col("first_us")
    packets = F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")
    size = F.col("fwd_bytes") + F.col("bwd_bytes")

    def per_second(x: Column) -> Column:
        return F.try_divide(x * F.lit(1e6), duration.cast("double"))

    def mean(total: str, n: str) -> Column:
        return F.try_divide(F.col(total).cast("double"), F.col(n).cast("double"))

    def mean_gap(span: str, n: str) -> Column:
        return F.try_divide(F.col(span).cast("double"), (F.col(n) - 1).cast("double"))

    return f.select(
        *keys,
        F.when(F.col("a_opened"), F.col("a_ip")).otherwise(F.col("b_ip")).alias("src_ip"),
        F.when(F.col("a_opened"), F.col("b_ip")).otherwise(F.col("a_ip")).alias("dst_ip"),
        "first_us", duration.alias("flow_duration"), "tot_fwd_pkts", "tot_bwd_pkts",
        per_second(size).alias("flow_byts_s"), per_second(packets).alias("flow_pkts_s"),
        per_second(F.col("tot_fwd_pkts")).alias("fwd_pkts_s"),
        per_second(F.col("tot_bwd_pkts")).alias("bwd_pkts_s"),
        mean("fwd_bytes", "tot_fwd_pkts").alias("fwd_pkt_len_mean"),
        mean("bwd_bytes", "tot_bwd_pkts").alias("bwd_pkt_len_mean"),
        mean_gap("fwd_span", "tot_fwd_pkts").alias("fwd_iat_mean"),
        mean_gap("bwd_span", "tot_bwd_pkts").alias("bwd_iat_mean"),
        *[f"{name}_flag_cnt" for name in TCP_FLAGS],
        "init_fwd_win_byts", "init_bwd_win_byts",
        F.try_divide(F.col("bwd_bytes").cast("double"), F.col("fwd_bytes").cast("double"))
        .alias("down_up_ratio"))


def packets_to_flows(packets: DataFrame, gap_seconds: float) -> DataFrame:
    """F1-F7 together."""
    return meter_flows(sessionize_packets(packets, gap_seconds))
