"""Secrets: named patterns, and strings that pass for random (operator 5). SQL functions only.

A candidate is a run of 20 or more letters, digits and base-64 signs. Its encoding is inferred, the
smallest that holds it: hexadecimal, letters, base 32 or base 36 of either case, letters and digits
of both cases, or base 64. Three tests ask whether it may be random
in that encoding: a chi-squared test of uniform symbols, a runs test about the middle of the
alphabet, and the correlation of neighbours. Their p-values are combined (Bonferroni), and within
each band of lengths the Benjamini-Hochberg step throws out what is not random: of the strings
thrown out, at most a share of ``LOST`` is expected to be random. Ordinary long words fall there.
Short strings pass too easily, so two more tests ask whether the string is unlike ordinary text:
fewer repeated symbols than text of that length has, and more changes between small letters,
capitals and digits. Their p-values are combined (Fisher), and the same step by band of lengths
keeps the share of false discoveries below ``FALSE``. A secret is what both steps leave.

Candidates of more than ``LONG`` symbols are tested in overlapping blocks that cover all of them,
and only the parts that random blocks cover are reported: a header or padding does not hide what
follows it, nor is it reported with it. The battery's p-values are shared between the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.spans import Kind, find, report
from flowlake.scratch import materialize

# Patterns. Those with a least length take the whole run, as the shorter ones fail.
KINDS = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
         r"(?i)password|passwd|secret|token|api_?key"),
    Kind("access", "AKIA[A-Z0-9]{14,}+", "AKIA"),
    Kind("hex", "[0-9a-f]{16,}+", "[0-9a-f]{16}"),
    Kind("random", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?", r"[A-Za-z0-9+/_-]{20}", base=False),
)
NAMES = [k.name for k in KINDS]
BASE = [k.name for k in KINDS if k.base]
# Alphabets by encoding, each in the order of its symbols' worth. Smaller ones come
# first, as the first one that holds a string counts.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": DIGITS + LOWER[:6],
    "hex_upper": DIGITS + UPPER[:6],
    "lower": LOWER,
    "upper": UPPER,
    "base32_lower": LOWER + "234567",
    "base32": UPPER + "234567",
    "base36_lower": DIGITS + LOWER,
    "base36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "alnum": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
}
TEXT_COINCIDENCE = 0.065      # that two letters of a text are the same
TEXT_CHANGE = 0.05            # that neighbours in a text are of different classes
LOST = 0.01                   # share of random strings among those that the battery throws out
FALSE = 0.01                  # share of false discoveries
BANDS = (24, 32, 48)          # symbols at which the next band of lengths starts
LONG = 512                    # longer candidates are tested in blocks of so many symbols
STEP = LONG // 2              # from block to block
BINS = 400                    # of a p-value's logarithm, 20 a decade


def _normal(z: Column) -> Column:
    """Normal distribution function (logistic form, off by 0.0002 at most)."""
    return 1 / (1 + F.exp(-(z * 1.5976 + z * z * z * 0.07056)))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _normal(-F.abs(z)))


def _blocks(found: DataFrame) -> DataFrame:
    """Rows (row, doc_id, kind, whole, blocks, body, start, stop): the blocks that cover each candidate.

    One of at most ``LONG`` symbols is one block. Others have a block every ``STEP`` symbols and one
    that ends where they end; ``whole`` is the candidate's start. Each row takes time for its own
    symbols only, as they are cut from bytes.
    """
    body = F.translate(F.regexp_replace("match", "=+$", ""), "-_", "+/")
    # All that depends on the whole candidate is worked out once, in one element of one array: what
    # stands above the explode refers to the exploded structs alone.
    held = F.struct(body.cast("binary").alias("bytes"), F.col("start").alias("whole"), F.col("stop").alias("end"))
    held = F.transform(F.array(held), lambda h: F.struct(h.alias("of"), F.greatest(F.octet_length(h["bytes"]) - LONG, F.lit(0)).alias("last")))
    held = F.transform(held, lambda h: F.struct(h["of"].alias("of"), h["last"].alias("last"), F.ceil(h["last"] / STEP).cast("int").alias("steps")))

    def cut(h: Column) -> Column:
        def block(i: Column) -> Column:
            at = F.least(i * STEP, h["last"])
            start = h["of"]["whole"] + at
            return F.struct(h["of"]["whole"].alias("whole"), (h["steps"] + 1).alias("blocks"),
                            F.substring(h["of"]["bytes"], at + 1, F.lit(LONG)).cast("string").alias("body"), start.alias("start"),
                            F.when(at == h["last"], h["of"]["end"]).otherwise(start + LONG).alias("stop"))
        return F.transform(F.sequence(F.lit(0), h["steps"]), block)

    return found.select("row", "doc_id", "kind", F.explode(F.flatten(F.transform(held, cut))).alias("b")).select("row", "doc_id", "kind", "b.*")


def _tested(found: DataFrame) -> DataFrame:
    """Blocks of candidates with ``p_random``, their p-value as random strings, and ``p_text``, as text.

    ``p_random`` combines the battery's ``p_chi``, ``p_runs`` and ``p_serial``, over all blocks of the candidate.
    """
    alphabet = F.coalesce(*[F.when(F.col("body").rlike(f"^[{signs}]+$"), signs) for signs in ALPHABETS.values()])
    df = _blocks(found).withColumn("alphabet", alphabet).withColumn("chars", F.split("body", ""))
    df = df.withColumn("x", F.transform("chars", lambda c: (F.position(c, F.col("alphabet")) - 1).cast("double")))
    kind_of = lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    df = df.withColumn("classes", F.transform(F.split("body", ""), kind_of))
    df = (df.withColumn("n", F.size("x").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
          .withColumn("mean", total(F.col("x")) / F.col("n"))
          .withColumn("squares", total(F.transform(F.array_distinct("chars"), lambda c: F.pow(F.length("body") - F.length(F.replace("body", c, F.lit(""))), F.lit(2.0)))))
          .withColumn("high", F.transform("x", lambda v: F.when(v >= F.col("k") / 2, 1.0).otherwise(0.0)))
          .withColumn("n1", total(F.col("high")))
          .withColumn("changes", total(F.transform("high", lambda v, i: F.when((i > 0) & (F.get("high", i - 1) != v), 1.0).otherwise(0.0))))
          .withColumn("spread", total(F.transform("x", lambda v: (v - F.col("mean")) * (v - F.col("mean")))))
          .withColumn("lagged", total(F.transform("x", lambda v, i: F.when(i > 0, (v - F.col("mean")) * (F.get("x", i - 1) - F.col("mean"))).otherwise(0.0))))
          .withColumn("turns", total(F.transform("classes", lambda v, i: F.when((i > 0) & (F.get("classes", i - 1) != v), 1.0).otherwise(0.0)))))
    n, k, free = F.col("n"), F.col("k"), F.col("k") - 1
    # Chi-squared, by the cube root of its ratio to its degrees of freedom.
    chi = F.greatest(k / n * F.col("squares") - n, F.lit(0.0))
    p_chi = 1 - _normal((F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    runs_mean = 2 * F.col("n1") * (n - F.col("n1")) / n
    runs_sd = F.sqrt(F.greatest(runs_mean * (runs_mean - 1) / (n - 1), F.lit(0.0)))
    p_runs = F.when(runs_sd > 0, _two_sided(F.try_divide(F.col("changes") - runs_mean, runs_sd))).otherwise(0.0)
    p_serial = F.when(F.col("spread") > 0, _two_sided(F.try_divide(F.col("lagged"), F.col("spread")) * F.sqrt(n))).otherwise(0.0)
    pairs = n * (n - 1)
    p_repeat = _normal((F.col("squares") - n - pairs * TEXT_COINCIDENCE) / F.sqrt(pairs * 2 * TEXT_COINCIDENCE * (1 - TEXT_COINCIDENCE)))
    expected, turns = (n - 1) * TEXT_CHANGE, F.col("turns")
    ln_turns = F.when(turns > expected, turns - expected - turns * F.ln(F.try_divide(turns, expected))).otherwise(0.0)
    evidence = F.least(-F.ln(F.greatest(p_repeat, F.lit(1e-9))) - ln_turns, F.lit(60.0))
    return (df.withColumn("p_chi", p_chi).withColumn("p_runs", p_runs).withColumn("p_serial", p_serial)
            .withColumn("p_random", F.least(F.lit(1.0), 3 * F.col("blocks") * F.least("p_chi", "p_runs", "p_serial")))
            .withColumn("p_text", F.exp(-evidence) * (1 + evidence)))


def _bin(p: str) -> Column:
    """A p-value's place in the histogram; the least ones share the last bin."""
    return F.least(F.floor(-F.log10(F.greatest(F.col(p), F.lit(1e-30))) * 20), F.lit(BINS)).cast("int")


def _cuts(tested: DataFrame, bin: str, share: float, cut: str) -> DataFrame:
    """(band, cut): the bin from which the Benjamini-Hochberg step rejects; bands without one are left out.

    By a histogram of at most 4 bands of BINS + 1 bins, whatever the input; a bin counts as its largest p-value.
    """
    above = Window.partitionBy("band").orderBy(F.desc(bin))
    counts = tested.groupBy("band", bin).agg(F.count("*").alias("n"))
    return (counts.withColumn("at_least", F.sum("n").over(above)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
            .filter(F.pow(F.lit(10.0), -F.col(bin) / 20) * F.col("all") <= F.lit(share) * F.col("at_least"))
            .groupBy("band").agg(F.min(bin).alias(cut)))


def random_strings(found: DataFrame) -> DataFrame:
    """(row, doc_id, kind, whole, start, stop, p_random, p_text, random) of the blocks of candidates among ``found``."""
    band = F.lit(0)
    for i, least in enumerate(BANDS):
        band = F.when(F.col("n") >= least, i + 1).otherwise(band)
    tested = (_tested(found.filter(F.col("kind") == NAMES.index("random"))).withColumn("band", band)
              .withColumn("random_bin", _bin("p_random")).withColumn("text_bin", _bin("p_text"))
              .select("row", "doc_id", "kind", "whole", "start", "stop", "p_random", "p_text", "band", "random_bin", "text_bin"))
    # Tested once: the histograms and the verdicts read the same rows.
    tested = materialize(tested, "secret-tests")
    judged = (tested.join(F.broadcast(_cuts(tested, "random_bin", LOST, "random_cut")), "band", "left")
              .join(F.broadcast(_cuts(tested, "text_bin", FALSE, "text_cut")), "band", "left"))
    ordered = F.coalesce(F.col("random_bin") >= F.col("random_cut"), F.lit(False))
    unlike_text = F.coalesce(F.col("text_bin") >= F.col("text_cut"), F.lit(False))
    return judged.select("row", "doc_id", "kind", "whole", "start", "stop", "p_random", "p_text", (unlike_text & ~ordered).alias("random"))


def random_spans(found: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, stop) of random blocks; those of a candidate that meet are one span."""
    order = Window.partitionBy("row", "whole").orderBy("start", "stop")
    blocks = (random_strings(found).filter("random")
              .withColumn("before", F.lag("stop").over(order)))
    part = F.count_if(F.col("before").isNull() | (F.col("before") < F.col("start"))).over(order)
    return (blocks.withColumn("part", part).groupBy("row", "whole", "part")
            .agg(F.first("doc_id").alias("doc_id"), F.first("kind").alias("kind"), F.min("start").alias("start"), F.max("stop").alias("stop"))
            .select("row", "doc_id", "kind", "start", "stop"))


def secrets(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Base kinds: named assignments of 12 or more signs, access keys of 18 or more, hexadecimal runs
    of 16 or more. Added, kind ``random``: candidates, or parts of long ones, that both
    false-discovery steps leave. Spans are kind:start:stop in code points, by start, then kind. A null or empty text has
    no span. Repeated rows are reported each. Other columns are ignored.
    """
    found = materialize(find(docs, KINDS), "secret-candidates")
    value = F.regexp_extract("match", r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 1)
    base = found.withColumn("kind", F.when((F.col("kind") == 0) & (F.length(value) < 12), None)
                            .when(F.col("kind") < len(BASE), F.col("kind")))
    return report(base.unionByName(random_spans(found), allowMissingColumns=True), NAMES, BASE, ("start", "kind"),
                  [F.count_if(F.col("kind") == NAMES.index("random")).alias("random")]).withColumnRenamed("random", "found_random")
