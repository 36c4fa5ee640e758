"""Traffic signatures (K1-K6). Thresholds are parameters."""

from __future__ import annotations

from collections.abc import Sequence
from math import log, pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.functions.fixed import TCP_FLAGS
from flowlake.functions.numeric import safe_ratio
from flowlake.functions.times import micros
from flowlake.plans.ordered import ordered_slices, running_totals, with_previous


SKETCH_LOG = 12               # two to this many registers a sketch
GAP_STEP = 1.05               # from bin to bin of a gap's histogram
JITTER = 0.3                  # share of the period by which a beacon's gaps differ from it


def port_fan_out(packets: DataFrame, bucket: str, min_ports: int = 1,
                 approximate: bool = False) -> DataFrame:
    """K1: distinct destination ports and SYN-only packets per source and window.

    The exact count groups by port first, with partial sums, so a busy source leaves at
    most 65,536 rows per window.
    """
    flags = F.col("flags")
    probe = ((flags.bitwiseAND(TCP_FLAGS["syn"]) != 0)
             & (flags.bitwiseAND(TCP_FLAGS["ack"]) == 0))
    at = F.window("ts", bucket)
    if approximate:
        out = packets.groupBy(at.alias("w"), "src").agg(
            F.approx_count_distinct("dport").alias("ports"), F.count_if(probe).alias("syn_only"))
    else:
        by_port = packets.groupBy(at.alias("w"), "src", "dport").agg(
            F.count_if(probe).alias("syn_only"))
        out = by_port.groupBy("w", "src").agg(
            F.count("dport").alias("ports"), F.sum("syn_only").alias("syn_only"))
    return (out.filter(F.col("ports") >= min_ports)
            .select(F.col("w.start").alias("bucket"), "src", "ports", "syn_only"))


def port_sketches(packets: DataFrame, bucket: str = "1 minute", log_registers: int = SKETCH_LOG) -> DataFrame:
    """K1: (bucket, src, ports_sketch, syn_only) per source and small window, to be stored.

    A sketch has a bounded size (4 KB at 2^12 registers, far less for few ports), whatever the traffic.
    """
    flags = F.col("flags")
    probe = (flags.bitwiseAND(TCP_FLAGS["syn"]) != 0) & (flags.bitwiseAND(TCP_FLAGS["ack"]) == 0)
    return (packets.groupBy(F.window("ts", bucket).alias("w"), "src")
            .agg(F.hll_sketch_agg(F.col("dport").cast("int"), log_registers).alias("ports_sketch"), F.count_if(probe).alias("syn_only"))
            .select(F.col("w.start").alias("bucket"), "src", "ports_sketch", "syn_only"))


def fan_out_from_sketches(sketches: DataFrame, bucket: str, min_ports: int = 1) -> DataFrame:
    """K1 for any window that whole sketch windows fill, without reading a packet again.

    ``ports`` is an estimate: off by more than ``sketch_error`` of the count in one of 20 windows.
    """
    return (sketches.groupBy(F.window("bucket", bucket).alias("w"), "src")
            .agg(F.hll_sketch_estimate(F.hll_union_agg("ports_sketch")).alias("ports"), F.sum("syn_only").alias("syn_only"))
            .filter(F.col("ports") >= min_ports)
            .select(F.col("w.start").alias("bucket"), "src", "ports", "syn_only"))


def sketch_error(log_registers: int = SKETCH_LOG) -> float:
    """Two standard errors of a sketch's estimate, as a share of the count."""
    return 2 * 1.04 / 2 ** (log_registers / 2)


def connection_bursts(flows: DataFrame, bucket: str, min_connections: int,
                      max_duration_us: int | None = None) -> DataFrame:
    """K2: short connections to one service per source and window."""
    short = flows if max_duration_us is None else flows.filter(
        F.col("flow_duration") <= max_duration_us)
    return (short.groupBy(F.window("ts", bucket).alias("w"), "src", "dst", "dport")
            .agg(F.count("*").alias("connections"))
            .filter(F.col("connections") >= min_connections)
            .select(F.col("w.start").alias("bucket"), "src", "dst", "dport", "connections"))


def repeated_requests(requests: DataFrame, min_repeats: int) -> DataFrame:
    """K3: requests of one size to one URI per source, wherever they stand; ``request_runs`` finds runs."""
    return (requests.groupBy("src", "uri", "bytes").agg(F.count("*").alias("repeats"))
            .filter(F.col("repeats") >= min_repeats))


def request_runs(requests: DataFrame, keys: Sequence[str] = ("src",), same: Sequence[str] = ("uri", "bytes"),
                 time: str = "ts", tiebreak: str = "packet_id", min_length: int = 2,
                 max_pause_seconds: float | None = None) -> DataFrame:
    """K3: runs of equal requests: (keys..., same..., first_us, last_us, requests), a row per run.

    A run is a stretch of a key's requests, in time order, that agree in ``same`` (missing values are
    equal), without another request between them and, if given, without a longer pause. Requests are
    scanned in even slices, so a run may cross their borders and a busy source covers many.
    """
    keys, same, order = list(keys), list(same), ["us", "tie"]
    narrow = requests.select(*keys, F.struct(*same).alias("what"), micros(F.col(time)).alias("us"), F.col(tiebreak).alias("tie"))
    sliced = ordered_slices(narrow, keys, order, "requests")
    lagged = with_previous(with_previous(sliced, keys, order, "us", "_before"), keys, order, "what", "_last")
    starts = F.col("_before").isNull() | ~F.col("what").eqNullSafe(F.col("_last"))
    if max_pause_seconds is not None:
        starts = starts | (F.col("us") - F.col("_before") > int(max_pause_seconds * 1e6))
    runs = running_totals(lagged.withColumn("_starts", starts.cast("bigint")), keys, order, {"run": "_starts"})
    return (runs.groupBy(*keys, "run", "what")
            .agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("requests"))
            .filter(F.col("requests") >= min_length)
            .select(*keys, "what.*", "first_us", "last_us", "requests"))


def slow_connections(flows: DataFrame, keys: Sequence[str], min_duration_us: int,
                     max_bytes_per_second: float) -> DataFrame:
    """K4: per service, long low-rate connections and how many were open at once.

    A connection adds one at its start and takes one away just after its end; the running
    sum over instants is the number open.
    """
    slow = flows.filter((F.col("flow_duration") >= min_duration_us)
                        & (F.col("flow_byts_s") <= max_bytes_per_second))
    steps = (slow.select(*keys, F.explode(F.array(
        F.struct(F.col("first_us").alias("at"), F.lit(1).cast("bigint").alias("step"),
                 F.lit(1).cast("bigint").alias("opened")),
        F.struct((F.col("first_us") + F.col("flow_duration") + 1).alias("at"),
                 F.lit(-1).cast("bigint").alias("step"), F.lit(0).cast("bigint").alias("opened"))))
        .alias("s"))
        .groupBy(*keys, F.col("s.at").alias("at"))
        .agg(F.sum("s.step").alias("step"), F.sum("s.opened").alias("opened")))
    running = running_totals(ordered_slices(steps, keys, ["at"], "open"), keys, ["at"],
                             {"open": "step"})
    return running.groupBy(*keys).agg(F.sum("opened").alias("connections"),
                                      F.max("open").alias("most_at_once"))


def beacon_regularity(packets: DataFrame, keys: Sequence[str] = ("src", "dst"),
                      time: str = "ts", tiebreak: str = "packet_id",
                      min_gaps: int = 2) -> DataFrame:
    """K5: mean gap in seconds and coefficient of variation of gaps per pair.

    Near 0 is clockwork; jitter around a base interval stays well below 1.
    """
    keys = list(keys)
    narrow = packets.select(*keys, micros(F.col(time)).alias("us"), F.col(tiebreak).alias("tie"))
    order = ["us", "tie"]
    gaps = (with_previous(ordered_slices(narrow, keys, order, "beacons"), keys, order, "us", "_b")
            .filter(F.col("_b").isNotNull())
            .withColumn("gap", (F.col("us") - F.col("_b")) / F.lit(1e6)))
    return (gaps.groupBy(*keys)
            .agg(F.count("*").alias("gaps"), F.avg("gap").alias("mean_gap_s"),
                 F.stddev_pop("gap").alias("_std"))
            .filter(F.col("gaps") >= min_gaps)
            .select(*keys, "gaps", "mean_gap_s",
                    F.try_divide(F.col("_std"), F.col("mean_gap_s")).alias("gap_cv")))


def beacon_period(packets: DataFrame, keys: Sequence[str] = ("src", "dst"), time: str = "ts",
                  tiebreak: str = "packet_id", jitter: float = JITTER, min_gaps: int = 8) -> DataFrame:
    """K5 under jitter: (keys..., gaps, period_s, share, coherence) per pair.

    Gaps are counted in bins that grow by a twentieth, some hundred a pair at most, however many
    packets it has. The period is the mean gap of the window from ``1 - jitter`` to ``1 + jitter`` that
    holds most gaps (the shortest such), ``share`` what it holds. ``coherence`` is the length of the
    mean of exp(2 pi i gap / period): 1 for clockwork, 0.5 for gaps spread evenly over 30 per cent on
    both sides, 0.16 for calls that come at random. Repeated instants have no gap.
    """
    keys, order = list(keys), ["us", "tie"]
    narrow = packets.select(*keys, micros(F.col(time)).alias("us"), F.col(tiebreak).alias("tie"))
    gap = F.col("us") - F.col("_before")
    gaps = with_previous(ordered_slices(narrow, keys, order, "beacons"), keys, order, "us", "_before").withColumn("gap", gap).filter("gap > 0")
    bins = (gaps.groupBy(*keys, F.floor(F.log(F.col("gap").cast("double")) / F.log(F.lit(GAP_STEP))).alias("bin"))
            .agg(F.count("*").alias("n"), F.sum("gap").alias("total")))
    width = int(log((1 + jitter) / (1 - jitter)) / log(GAP_STEP))
    pair = Window.partitionBy(*keys)
    near = pair.orderBy("bin").rangeBetween(0, width)
    held = bins.select(*keys, "bin", "n", "total", F.sum("n").over(near).alias("inside"), F.sum("total").over(near).alias("inside_us"),
                       F.sum("n").over(pair).alias("gaps"))
    best = held.withColumn("best", F.max(F.struct("inside", (-F.col("bin")).alias("first"), "inside_us")).over(pair)).filter(F.col("gaps") >= min_gaps)
    period = F.col("best.inside_us") / F.col("best.inside")
    turn = 2 * pi * (F.col("total") / F.col("n")) / period
    part = lambda f: F.sum(F.col("n") * f(turn)) / F.first("gaps")
    return (best.groupBy(*keys).agg(
        F.first("gaps").alias("gaps"), (F.first(period) / F.lit(1e6)).alias("period_s"),
        F.first(F.col("best.inside") / F.col("gaps")).alias("share"),
        F.sqrt(part(F.cos) * part(F.cos) + part(F.sin) * part(F.sin)).alias("coherence")))


def outbound_asymmetry(traffic: DataFrame, client: str, peer: str, outbound: str, size: str,
                       min_ratio: float = 0.0) -> DataFrame:
    """K6: bytes sent and received per pair, their ratio, and the mean sent payload."""
    sent, received = F.when(F.col(outbound), F.col(size)), F.when(~F.col(outbound), F.col(size))
    out = traffic.groupBy(client, peer).agg(
        F.coalesce(F.sum(sent), F.lit(0)).alias("sent"),
        F.coalesce(F.sum(received), F.lit(0)).alias("received"),
        F.avg(sent).alias("mean_sent"))
    ratio = safe_ratio(F.col("sent"), F.col("received"))
    return out.withColumn("out_in_ratio", ratio).filter(
        F.col("sent") > 0).filter(ratio.isNull() | (ratio >= min_ratio))
