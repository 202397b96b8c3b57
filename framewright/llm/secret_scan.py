"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens with false-discovery control.

Base spans come from three patterns: assignments to secret-like names, access keys and long hexadecimal runs.

The method adds tokens of 20 characters or more that look drawn at random. For each the encoding is inferred (decimal, hex,
base 32, base 36 or base 64), its characters become codes 0 to k - 1, and three statistics are taken: chi-squared uniformity
over the alphabet, runs, and lag-1 serial correlation. Each has a p value against "drawn at random" and one against "written
text":

* uniformity: the chi-squared figure by its own distribution; against text, how far it falls below what text's index of
  coincidence makes it at this length;
* runs: those of upper and lower codes (Wald and Wolfowitz); against text, the runs of one character class (digit, capital,
  small letter, sign), of which text has fewer (a Poisson tail bound);
* serial correlation at lag 1; against text, the mean squared step from one code to the next, which text keeps small.

The figures of text (its rate of class changes, its steps) are measured for each encoding over all tokens of the corpus that
are not random. The three p values are combined as Simes does (the least of 3 p, 3/2 of the second and the third).
A token must not be rejected as random (at ``alpha``), and its combined p value against text goes into a Benjamini-Hochberg
procedure over all documents' tokens of a length class, so that the share of text among the spans added is at most ``rate``
at any length. The procedure needs only a histogram of p values, one row for each length class and quarter of a decade.

DataFrame functions only. Defined results: a null text is an empty one; positions count code points; a method's span that
lies within a base span is left out; repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import durable, small

ALPHA, RATE, POWER_STEPS = 1e-3, 0.01, 4
#: Class changes a character of text, which count as this many characters beside those measured.
TEXT_TURNS, TEXT_CHARS = 0.05, 10_000
#: Tokens of text from which the steps of an encoding are known; with fewer, steps are no evidence.
TEXT_TOKENS = 30
#: The three patterns, the least length of a match (of group 2 for the first), and their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 8
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Fixed value: the index of coincidence of written text (European languages lie at 0.065 to 0.078).
COINCIDENCE = 0.065
#: Encodings, from the narrowest, by pattern and alphabet.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Lengths from which a class starts; each class has its own procedure.
LENGTHS = (20, 24, 32, 48, 64, 128)


def pieces(text: Column, pattern: str) -> Column:
    """The matches of a pattern in a text, left to right, as (gap, found): the characters since the match before, and the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found")), lambda x: x["found"].isNotNull())
    return F.when(text.rlike(pattern), zipped).otherwise(F.array().cast("array<struct<gap:int,found:string>>"))


def scanned(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, found): for each row of ``docs`` the matches of each pattern, kept in the checkpoint folder."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return durable(texts.select("row", "doc_id", F.array(*[pieces(F.col("text"), p) for p in (ASSIGN, ACCESS, HEX, TOKEN)]).alias("found")))


def located(scan: DataFrame) -> DataFrame:
    """Rows (row, kind, start, stop, found): the base spans and, as kind 3, the tokens outside them."""
    of_kind = scan.where(F.exists("found", lambda x: F.size(x) > 0)).select("row", F.posexplode("found").alias("kind", "_of")).select("row", "kind", F.posexplode("_of").alias("_at", "_x")).select("row", "kind", "_at", "_x.*")
    stop = F.sum(F.col("gap") + F.char_length("found")).over(W.partitionBy("row", "kind").orderBy("_at"))
    spans = of_kind.withColumn("stop", stop.cast("int")).withColumn("start", F.col("stop") - F.char_length("found"))
    spans = spans.where((F.col("kind") != 0) | (F.length(F.regexp_extract("found", ASSIGN, 2)) >= ASSIGN_LEAST))
    # A token lies within a base span if the furthest end of those that start no later reaches its own.
    base = F.max(F.when(F.col("kind") < 3, F.col("stop"))).over(W.partitionBy("row").orderBy("start").rangeBetween(W.unboundedPreceding, 0))
    outside = spans.withColumn("_base", base).where((F.col("kind") < 3) | F.col("_base").isNull() | (F.col("_base") < F.col("stop")))
    return outside.select("row", "kind", "start", "stop", "found")


def upper_tail(z: Column) -> Column:
    """log10 of the upper tail of the normal distribution, for z > 0 within 0.1; log10(0.5) for others."""
    x = F.greatest(z, F.lit(1e-6))
    tail = F.log10((1 - F.exp(-1.4 * x)) / (1.135 * math.sqrt(2 * math.pi) * x)) - x * x / (2 * math.log(10))
    return F.when(z > 0, tail).otherwise(F.lit(math.log10(0.5)))


def simes(*log_p: Column) -> Column:
    """log10 of the combined p value of some (given by log10), by Simes: the least of k p / i over the i-th smallest p."""
    ranked = F.array_sort(F.array(*log_p))
    return F.least(F.lit(0.0), *[F.get(ranked, F.lit(i)) + math.log10(len(log_p) / (i + 1)) for i in range(len(log_p))])


def tested(tokens: DataFrame) -> DataFrame:
    """Add to rows with a token ``found``: encoding, n, z_uniform, z_runs, z_serial, random, and for the tests against text
    text_uniform (log10 of p), turns (class changes) and step (the mean squared step)."""
    bare = F.regexp_replace("found", "[=]+$", "")
    encoding = F.coalesce(*[F.when(F.col("found").rlike(p), F.lit(name)) for name, p, _ in ENCODINGS[:-1]], F.lit("base64"))
    alphabet = F.element_at(F.create_map(*[F.lit(x) for name, _, a in ENCODINGS for x in (name, a)]), F.col("encoding"))
    folded = F.when(F.col("encoding") == "base64", F.translate(bare, "-_", "+/")).otherwise(F.lower(bare))
    df = tokens.withColumn("encoding", encoding).withColumn("_alphabet", alphabet).withColumn("_k", F.char_length("_alphabet").cast("double"))
    df = df.withColumn("codes", F.transform(F.split(folded, ""), lambda c: F.instr(F.col("_alphabet"), c) - 1))
    df = df.withColumn("codes", F.filter("codes", lambda x: x >= 0)).withColumn("n", F.size("codes").cast("double")).where("n > 3")
    zero = lambda *names: F.struct(*[F.lit(0.0).alias(x) for x in names])

    def count(acc: Column, x: Column) -> Column:
        same = acc["last"] == x + 1
        times = F.when(same, acc["times"] + 1).otherwise(F.lit(1.0))
        return F.struct((x + 1.0).alias("last"), times.alias("times"), (acc["squares"] + 2 * times - 1).alias("squares"))

    def follow(acc: Column, x: Column) -> Column:
        high = F.when(2 * x >= F.col("_k"), 1.0).otherwise(0.0)
        first = acc["seen"] == 0
        pair = F.when(first, 0.0).otherwise(acc["last"] * x)
        turn = F.when(first | (acc["high"] != high), 1.0).otherwise(0.0)
        step = F.when(first, 0.0).otherwise((x - acc["last"]) * (x - acc["last"]))
        sums = {"steps": acc["steps"] + step, "seen": acc["seen"] + 1, "last": x.cast("double"), "high": high, "highs": acc["highs"] + high, "runs": acc["runs"] + turn, "sum": acc["sum"] + x, "square": acc["square"] + x * x, "pairs": acc["pairs"] + pair, "first": F.when(first, x.cast("double")).otherwise(acc["first"])}
        return F.struct(*[v.alias(k) for k, v in sums.items()])

    df = df.withColumn("_squares", F.aggregate(F.array_sort("codes"), zero("last", "times", "squares"), count)["squares"])
    df = df.withColumn("_s", F.aggregate("codes", zero("steps", "seen", "last", "high", "highs", "runs", "sum", "square", "pairs", "first"), follow))
    n, k, s = F.col("n"), F.col("_k"), lambda c: F.col(f"_s.{c}")
    chi = F.col("_squares") * k / n - n
    highs, lows = s("highs"), n - s("highs")
    both = 2 * highs * lows
    spread = both * (both - n) / (n * n * (n - 1))
    runs = F.when((highs > 0) & (lows > 0) & (spread > 0), (s("runs") - both / n - 1) / F.sqrt(spread)).otherwise(F.sqrt(n))
    mean, variance = s("sum") / n, s("square") / n - F.pow(s("sum") / n, 2)
    lagged = (s("pairs") - mean * (2 * s("sum") - s("first") - s("last")) + (n - 1) * mean * mean) / n
    serial = F.when(variance > 0, (lagged / variance + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    # Written text: by its index of coincidence, and by its changes of character class.
    expected = k * (1 + (n - 1) * COINCIDENCE) - n
    deviation = F.sqrt(2 * (k - 1) + 4 * n * (k * COINCIDENCE - 1))
    # Ten digits are few enough that text has no excess of coincidences among them.
    text_chi = F.when(k * COINCIDENCE > 1, upper_tail((expected - chi) / deviation)).otherwise(F.lit(0.0))
    kind = F.translate("found", "".join(a for _, _, a in ENCODINGS[-1:]) + "-_=", "A" * 26 + "a" * 26 + "0" * 10 + "+" * 5)
    turns = F.char_length(F.regexp_replace(kind, r"(.)\1*", "$1")) - 1
    df = df.withColumn("z_uniform", (chi - (k - 1)) / F.sqrt(2 * (k - 1))).withColumn("z_runs", runs).withColumn("z_serial", serial)
    df = df.withColumn("text_uniform", F.least(F.lit(0.0), text_chi)).withColumn("turns", turns).withColumn("step", s("steps") / (n - 1))
    two_sided = lambda c: F.least(F.lit(0.0), upper_tail(F.abs(c)) + math.log10(2))
    random = simes(F.least(F.lit(0.0), upper_tail(F.col("z_uniform"))), two_sided("z_runs"), two_sided("z_serial")) >= math.log10(ALPHA)
    return df.withColumn("random", random).drop("codes", "_alphabet", "_k", "_squares", "_s")


def text_figures(found: DataFrame) -> dict[str, tuple[float, float | None, float | None]]:
    """For each encoding, over the tokens that are not random: the class changes a character, the mean step, and the variance
    of a step (None for both if too few tokens tell)."""
    text = F.when(~F.col("random"), 1)
    n, step = F.col("n") - 1, F.col("step")
    sums = found.groupBy("encoding").agg(*[F.coalesce(F.sum(text * x), F.lit(0.0)).alias(name) for name, x in {"tokens": F.lit(1), "chars": F.col("n"), "turns": F.col("turns"), "n": n, "steps": n * step, "squares": n * step * step}.items()])
    out = {}
    for r in sums.collect():
        rate = (r["turns"] + TEXT_TURNS * TEXT_CHARS) / (r["chars"] + TEXT_CHARS)
        mean = r["steps"] / r["n"] if r["tokens"] >= TEXT_TOKENS else None
        # A token's mean step over n steps spreads by variance / n.
        spread = max(r["squares"] - mean * r["steps"], 0.0) / r["tokens"] if mean is not None else 0.0
        out[r["encoding"]] = (rate, mean, spread) if spread > 0 else (rate, None, None)
    return out


def against_text(found: DataFrame, figures: dict[str, tuple[float, float | None, float | None]]) -> DataFrame:
    """Add ``log_p``: log10 of the combined p value of uniformity, runs and steps against written text."""
    runs = steps = F.lit(0.0)
    for name, (rate, mean, spread) in figures.items():
        turns, usual = F.col("turns"), rate * F.col("n")
        tail = F.when(turns > usual, (turns - usual - turns * F.log(turns / usual)) / math.log(10)).otherwise(F.lit(0.0))
        runs = F.when(F.col("encoding") == name, tail).otherwise(runs)
        if mean is not None:
            steps = F.when(F.col("encoding") == name, F.least(F.lit(0.0), upper_tail((F.col("step") - mean) / F.sqrt(spread / (F.col("n") - 1))))).otherwise(steps)
    return found.withColumn("log_p", simes(F.col("text_uniform"), runs, steps))


def length_class() -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTHS):
        out = F.when(F.col("n") >= least, k + 1).otherwise(out)
    return out


def thresholds(candidates: DataFrame, rate: float) -> dict[int, int]:
    """For each length class the least step (a quarter of a decade of p) that the Benjamini-Hochberg procedure admits."""
    steps = F.least(F.floor(-F.col("log_p") * POWER_STEPS), F.lit(400)).cast("int")
    counts: dict[int, dict[int, int]] = {}
    for r in candidates.groupBy("length", steps.alias("step")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["length"], {})[r["step"]] = r["n"]
    out = {}
    for length, by_step in counts.items():
        total, above = sum(by_step.values()), 0
        for step in sorted(by_step, reverse=True):
            above += by_step[step]
            if 10 ** (-step / POWER_STEPS) <= rate * above / total:
                out[length] = step
    return out


def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    scan = scanned(docs)
    spans = durable(located(scan))
    found = durable(tested(spans.where("kind = 3").select("row", "start", "stop", "found")).drop("found"))
    found = against_text(found, text_figures(found)).withColumn("length", length_class())
    passed = F.lit(False)
    for length, step in thresholds(found, rate).items():
        passed = passed | ((F.col("length") == length) & (F.floor(-F.col("log_p") * POWER_STEPS) >= step))
    added = found.where(passed & F.col("random")).select("row", "start", F.lit(3).alias("kind"), "stop")
    kept = spans.where("kind < 3").select("row", "start", "kind", "stop").union(added)
    grouped = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))
    out = scan.select("row", "doc_id").join(small(durable(grouped)), "row", "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,stop:int>>")))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["stop"])), ",")
    number = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return out.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), number(3).alias("n_random"))
