"""Column functions: bits, colours, rounding, text forms, small tables; all evaluated by the engine's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def level(v: Column, levels: int = 8) -> Column:
    """The nearest of ``levels`` equal steps of 0 to 255."""
    return F.floor((v * (levels - 1) + 127) / 255).cast("long")


def stretch(black: int, white: int) -> list[int]:
    """A table of 256 levels that maps black to 0 and white to 255, halves to even."""
    return [min(255, max(0, round((v - black) * 255 / max(1, white - black)))) for v in range(256)]


def flatten_low_detail(values: Column, threshold: float) -> Column:
    """An array whose values are their mean if their population deviation is under the threshold."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    n = F.size(values)
    mean = total / n
    return F.when(F.sqrt(F.greatest(square / n - mean * mean, F.lit(0.0))) < threshold, F.transform(values, lambda _: mean)).otherwise(values)


def priority_aging(pressure: Column) -> Column:
    return (1 + 0.6 * F.least(pressure, F.lit(10))).cast("double")


def distance_step(difference: Column, reference: float = 24.0, cap: float = 2.0) -> Column:
    return F.least(difference / 192.0 / reference, F.lit(cap)).cast("double")


def distinct_nibbles(v: Column, n: int) -> Column:
    return F.size(F.array_distinct(F.array(*[F.shiftright(v, 4 * k).bitwiseAND(15) for k in range(n)])))


def colour_key(r: Column, g: Column, b: Column) -> Column:
    """A 9-bit key of three 3-bit channels."""
    return r * 64 + g * 8 + b


def colour_word(r: Column, g: Column, b: Column) -> Column:
    """A hardware word: blue in bits 9 to 11, green in 5 to 7, red in 1 to 3."""
    return F.shiftleft(b, 9).bitwiseOR(F.shiftleft(g, 5)).bitwiseOR(F.shiftleft(r, 1))


def is_deep_black(r: Column, g: Column, b: Column) -> Column:
    return r + g + b <= 2


def border_weight(column: Column, row: Column, columns: int, rows: int, border: int = 2, weight: float = 0.4) -> Column:
    outer = (column < border) | (row < border) | (column >= columns - border) | (row >= rows - border)
    return F.when(outer, weight).otherwise(1.0)


def is_edge(frame: Column, n: Column, k: int) -> Column:
    return (frame < k) | (frame >= n - k)


def sample_bounds(frame: Column, fps: float, rate: int, total: int, window: int = 1) -> tuple[Column, Column]:
    """The half-open range of samples of ``window`` frames from a frame on, rounded half to even and cut to what there is."""
    at = lambda f: F.rint(f * rate / fps).cast("long")
    return F.greatest(at(frame), F.lit(0)), F.least(at(frame + window), F.lit(total))


def resampled(frame: Column, content_fps: float, output_fps: float) -> Column:
    return F.rint(frame * output_fps / content_fps).cast("long")


def entry_bits(slot: Column, source: Column) -> Column:
    """A name entry: slot, source in bits 11 and 12, the cold flag in bit 15."""
    return slot.bitwiseAND(0x7FF).bitwiseOR(F.shiftleft(source, 11)).bitwiseOR(0x8000)


def route(entry: Column) -> tuple[Column, Column, Column]:
    """(payload, control, total) sectors of a routing byte: payload in the low nibble, control in the high one."""
    payload, control = entry.bitwiseAND(15), F.shiftright(entry, 4).bitwiseAND(15)
    return payload, control, payload + control


def relaxed(reserve: Column, priority: Column, relief: Column) -> Column:
    return F.when(priority, F.greatest(F.lit(0), reserve - relief)).otherwise(reserve)


def spend_limit(budget: Column, supply: Column, reserve: Column, spent: Column) -> Column:
    return F.greatest(spent, F.greatest(F.lit(0), budget + supply - reserve))


def block_length(updates: Column, runs: Column, kind: Column, *, bitmap_bytes: int, audio_bytes: int, item_bytes: int, entry_bytes: int, colour_bytes: int, scroll_bytes: int, fades: tuple[int, ...], scroll: int, run_bytes: int = 4) -> Column:
    """The bytes of a control block: length word, padded body, run count and runs."""
    body = F.when(kind.isin(*fades), F.lit(colour_bytes)).when(kind == scroll, updates * item_bytes + scroll_bytes).otherwise(updates * entry_bytes + bitmap_bytes)
    before = 4 + body + audio_bytes
    return 2 + before + before % 2 + 2 + runs * run_bytes


def transfer_words(patterns: Column, runs: Column, switch: Column, names: Column, per_pattern: int, per_run: int, per_switch: int) -> Column:
    return patterns * per_pattern + runs * per_run + F.when(switch, per_switch).otherwise(0) + names


def plane_cell(cell: Column, scroll: Column, size: int) -> Column:
    return F.pmod(cell + scroll, F.lit(size)).cast("long")


def carries(frame: Column, start: int, step: int, modulus: int) -> Column:
    """Whether an accumulator overflows as it steps from a frame to the next."""
    return F.floor((start + frame * step + step) / modulus) != F.floor((start + frame * step) / modulus)


def spaced(k: Column, total: Column, count: int, half_step: bool = False) -> Column:
    """The k-th of ``count`` evenly spread places of ``total``, in the middle of its part if ``half_step``."""
    if half_step:
        return F.floor((2 * k + 1) * total / (2 * count)).cast("long")
    return F.floor(k * total / count).cast("long")


def cyclic_cap(frame: Column, pattern: list[int], spec: str) -> Column:
    """A cap by the interval of a frame in a cyclic pattern: ``2:170,3:250``. Frame 0 takes the greatest; an interval that
    has no cap, or a cap of no interval, is an error."""
    caps = {int(a): int(b) for a, b in (x.split(":") for x in spec.split(","))}
    if set(caps) != set(pattern):
        raise ValueError(f"caps for {sorted(caps)}, intervals {sorted(set(pattern))}")
    by_place = F.array(*[F.lit(caps[p]) for p in pattern])
    return F.when(frame == 0, max(caps.values())).otherwise(F.get(by_place, F.pmod(frame - 1, F.lit(len(pattern))).cast("int")))


def number(text: Column, hexadecimal: bool = False) -> Column:
    """A number from text; null for a blank or what is none."""
    bare = F.trim(text)
    if hexadecimal:
        digits = F.regexp_replace(F.lower(bare), "^0x", "")
        return F.when(digits.rlike("^[0-9a-f]+$"), F.conv(digits, 16, 10).cast("double"))
    return F.when(bare != "", bare.try_cast("double"))


def decimal_text(v: Column) -> Column:
    """Plain decimal text without needless zeros."""
    text = v.cast("decimal(38,10)").cast("string")
    bare = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(bare == "-0", "0").otherwise(bare)


def clock(seconds: Column) -> Column:
    part = lambda v: F.when(v < 10, F.concat(F.lit("0"), v.cast("string"))).otherwise(v.cast("string"))
    return F.concat(part(F.floor(seconds / 60)), F.lit(":"), part(F.floor(seconds) % 60))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ratio(text: Column) -> Column:
    """``a:b`` or ``a/b`` or a plain number."""
    parts = F.split(text, "[:/]")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("double") / F.get(parts, F.lit(1)).try_cast("double")).otherwise(text.try_cast("double"))


def wrap_difference(a: Column, b: Column, modulus: int = 16) -> Column:
    return F.pmod(a - b, F.lit(modulus))


def fields(df: DataFrame, text: str, pattern: str, groups: dict[str, int]) -> DataFrame:
    for name, k in groups.items():
        df = df.withColumn(name, F.regexp_extract(text, pattern, k))
    return df


def tokens(df: DataFrame, text: str, key: str, pattern: str) -> DataFrame:
    """(key, name, value) of ``name=value`` tokens; the second of a name in a row is ``name[2]``, and so on."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))
    rows = df.select(key, F.posexplode(found).alias("i", "t")).select(key, "i", F.col("t.name").alias("name"), F.col("t.value").alias("value"))
    k = F.row_number().over(W.partitionBy(key, "name").orderBy("i"))
    return rows.withColumn("_k", k).select(key, F.when(F.col("_k") > 1, F.concat("name", F.lit("["), F.col("_k"), F.lit("]"))).otherwise(F.col("name")).alias("name"), "value")


def last_by_prefix(df: DataFrame, text: str, order: str, prefixes: list[str]) -> DataFrame:
    """(prefix, line): the last line (by row, then place) that starts with each prefix."""
    lines = df.select(order, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    prefix = F.coalesce(*[F.when(F.startswith("line", F.lit(p)), p) for p in prefixes])
    found = lines.withColumn("prefix", prefix).where("prefix is not null")
    return found.groupBy("prefix").agg(F.max_by("line", F.struct(order, "i")).alias("line"))


def flattened(df: DataFrame, column: str, keys: list[str], depth: int = 8) -> DataFrame:
    """(keys, path, value): the leaves of a JSON column by dotted path; lists stay JSON text. One pass for each level."""
    level_rows = df.select(*keys, F.lit("").alias("path"), F.col(column).alias("value"))
    out = None
    for _ in range(depth):
        is_object = F.col("value").rlike(r"^\s*\{")
        leaf = level_rows.where(~F.coalesce(is_object, F.lit(False)))
        out = leaf if out is None else out.unionByName(leaf)
        inner = level_rows.where(is_object).select(*keys, "path", F.explode(F.json_object_keys("value")).alias("_k"), "value")
        child = F.call_function("get_json_object", F.col("value"), F.concat(F.lit("$['"), F.col("_k"), F.lit("']")))
        level_rows = inner.select(*keys, F.when(F.col("path") == "", F.col("_k")).otherwise(F.concat("path", F.lit("."), "_k")).alias("path"), child.alias("value"))
    return out.where("path <> ''")


def expanded(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Add ``place`` and ``kind``: each row repeated by its counts, in the order they are given."""
    kinds = F.concat(*[F.array_repeat(F.lit(k), n.cast("int")) for k, n in counts.items()])
    return df.select("*", F.posexplode(kinds).alias("place", "kind"))


def class_split(deliveries: DataFrame, flags: DataFrame, frame: str, count: str, stop: str) -> DataFrame:
    """(frame, raw, other): how many of a delivery's places are flagged. ``flags`` has running counts by place; places past
    its end count as its last."""
    last = flags.agg(F.max("n").alias("_last"))
    at = flags.select(F.col(frame).alias("_at"), F.col("n").alias("_n"))
    b = deliveries.join(at, F.col("_at") == F.col(stop) - 1, "left").withColumnRenamed("_n", "_to").drop("_at")
    a = b.join(at, F.col("_at") == F.col(stop) - F.col(count) - 1, "left").withColumnRenamed("_n", "_from").drop("_at").crossJoin(F.broadcast(last))
    start = F.coalesce("_from", F.when(F.col(stop) == F.col(count), 0).otherwise(F.col("_last")))
    raw = F.coalesce("_to", "_last") - start
    return a.select(frame, raw.alias("raw"), (F.col(count) - raw).alias("other"))
