"""Secrets in texts, by DataFrame functions alone.

Base rules are patterns of known forms. Besides them, every run of 20 and more characters of an encoding (hexadecimal, base 32,
alphanumeric, base 64) that mixes letters and digits goes through a battery:

* chi-squared of its symbols against the uniform alphabet. Structured names repeat symbols as text does, so at length n their
  statistic lies around ``n * (A * repeat - 1) + A - 1``, and the share of them that looks as uniform as the run is its p-value;
* runs above and below the middle of the alphabet, and the serial correlation of neighbours. Both are two-sided tests of
  randomness, joined by Fisher's method; a run that fails them at 0.001 is no secret (p-value 1).

Which p-values are discoveries is decided over the whole corpus, by Benjamini and Hochberg's rule apart for each band of
lengths, so that many short runs do not hide few long ones. The rule needs only how many p-values fall in each
1/20 of a decade: at most 4 * 1,001 rows whatever the corpus, and conservative by that width.

Null or empty text: no spans. Offsets are code points, ends exclusive. Repeated rows: each has its spans. Null doc_id: kept.
An added run that overlaps a base span is left out, as that span says it already. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.shared import unused

# The base patterns, which must find the same spans as elsewhere.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 and more; a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
#: Encoding: pattern, its symbols in order, how often two symbols of a structured name agree.
ENCODINGS = [
    (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.125),
    (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.066),
    (r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.066),
    (r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 0.066),
]
OTHER = (ALPHABET, 0.066)

BANDS = [20, 32, 64, 128]  # first length of each
BINS = 1_000  # of 1/20 decade; the last holds all smaller p-values
FALSE_SHARE = 0.01
RANDOM_AT = 0.001


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


# ---- spans -------------------------------------------------------------------------------------------------


def located(text: Column, pattern: str, last: Column, last_type: str) -> Column:
    """Array of (start, end, last) of a pattern's matches (there is one), leftmost first. ``last``: an array with a value for each match.

    Matches and what stands between them take turns, so starts are sums of lengths.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    # The last piece has no match behind it; arrays_zip fills its match with null.
    rows = F.filter(F.arrays_zip(between.alias("0"), lengths.alias("1"), last.alias("2")), lambda x: x["1"].isNotNull())
    return let(rows, lambda r: _placed(r, f"array<struct<start:int,end:int,last:{last_type}>>"))


def _placed(rows: Column, kind: str) -> Column:
    """Rows (length before, length, last) as spans. An array is copied when it grows, so it grows in blocks of the root of their number."""
    size = F.ceil(F.sqrt(F.size(rows))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int")), lambda j: F.slice(rows, j * size + 1, size))

    def span(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["0"]
        found = F.struct(begin.alias("start"), (begin + x["1"]).alias("end"), x["2"].alias("last"))
        return F.struct((begin + x["1"]).alias("at"), F.concat(acc["spans"], F.array(found)).alias("spans"))

    def block(acc: Column, rows: Column) -> Column:
        inner = F.aggregate(rows, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("spans")), span)
        return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["blocks"], F.array(i["spans"])).alias("blocks")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("blocks"))
    return F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["blocks"]))


def spans_if(condition: Column, text: Column, pattern: str, last: Column, last_type: str = "int") -> Column:
    none = F.array().cast(f"array<struct<start:int,end:int,last:{last_type}>>")
    return F.when(condition & text.rlike(pattern), located(text, pattern, last, last_type)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, array of (start, end, last); a match of ``assign`` counts if its value (``last`` is its length) is long enough, and takes its place in any case."""
    value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.length)
    plain = {k: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.length) for k, p in (("access", ACCESS), ("hex", HEX))}
    return {
        "assign": F.filter(spans_if(text.rlike("[:=]"), text, ASSIGN, value), lambda s: s["last"] >= 6),
        "access": spans_if(text.contains("AKIA"), text, ACCESS, plain["access"]),
        "hex": spans_if(F.lit(True), text, HEX, plain["hex"]),
    }


def run_spans(text: Column) -> Column:
    """Array of (start, end, last: the run)."""
    return spans_if(F.lit(True), text, RUN, F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), "string")


# ---- tests --------------------------------------------------------------------------------------------------


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * upper_tail(F.abs(z)))


def uniformity(counts_squared: Column, n: Column, size: Column, repeat: Column) -> Column:
    """Share of structured names of that length whose chi-squared is as small."""
    chi = counts_squared * size / n - n
    excess = F.greatest(n * (size * repeat - 1), F.lit(0.0))
    return upper_tail((excess + size - 1 - chi) / F.sqrt(2 * (size - 1) + 4 * excess))


def runs_test(high: Column, n: Column) -> Column:
    """high: array of booleans."""
    ones = total(F.transform(high, lambda b: b.cast("double")))
    changes = F.zip_with(F.slice(high, F.lit(1), F.size(high) - 1), F.slice(high, F.lit(2), F.size(high) - 1), lambda a, b: (a != b).cast("double"))
    return let(F.struct(ones.alias("ones"), (total(changes) + 1).alias("runs")), lambda s: _runs_p(s["ones"], n - s["ones"], s["runs"], n))


def _runs_p(ones: Column, zeros: Column, runs: Column, n: Column) -> Column:
    mean = 2 * ones * zeros / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return F.when(variance > 0, two_sided((runs - mean) / F.sqrt(F.greatest(variance, F.lit(1e-9))))).otherwise(F.lit(0.0))


def serial_test(values: Column, n: Column) -> Column:
    """Correlation of each symbol's number with the next one's."""

    def p(s: Column) -> Column:
        mean = s["sum"] / n
        variance = s["squares"] / n - mean * mean
        shared = s["products"] / (n - 1) - mean * mean
        return F.when(variance > 0, two_sided((shared / F.greatest(variance, F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))

    products = F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), lambda a, b: a * b)
    sums = F.struct(total(values).alias("sum"), total(F.transform(values, lambda v: v * v)).alias("squares"), total(products).alias("products"))
    return let(sums, p)


def battery(run: Column) -> Column:
    """p-value of a run."""

    def pick(values: list) -> Column:
        out = None
        for (pattern, *_), value in zip(ENCODINGS, values):
            out = (F.when if out is None else out.when)(run.rlike(pattern), F.lit(value))
        return out.otherwise(F.lit(values[-1]))

    def on(encoding: Column) -> Column:
        symbols = encoding["symbols"]
        body = F.regexp_replace(run, "=+$", "")
        body = F.when(F.length(symbols) == 16, F.lower(body)).otherwise(body)
        numbers = F.transform(F.split(body, ""), lambda c: (F.position(c, symbols) - 1).cast("double"))
        return let(F.struct(numbers.alias("values"), F.length(symbols).cast("double").alias("size"), encoding["repeat"].alias("repeat")), _tests)

    symbols, repeat = pick([e[1] for e in ENCODINGS] + [OTHER[0]]), pick([e[2] for e in ENCODINGS] + [OTHER[1]])
    return let(F.struct(symbols.alias("symbols"), repeat.alias("repeat")), on)


def _tests(given: Column) -> Column:
    values, size = given["values"], given["size"]
    n = F.size(values).cast("double")
    squares = total(F.transform(F.array_distinct(values), lambda v: F.pow(total(F.transform(values, lambda w: (w == v).cast("double"))), F.lit(2.0))))
    random = F.greatest(runs_test(F.transform(values, lambda v: v >= size / 2), n), F.lit(1e-300)) * F.greatest(serial_test(values, n), F.lit(1e-300))
    fisher = random * (1 - F.log(random))  # chi-squared with four degrees of freedom, closed form
    return F.when(fisher >= RANDOM_AT, uniformity(squares, n, size, given["repeat"])).otherwise(F.lit(1.0))


def band(length: Column) -> Column:
    out = F.lit(0)
    for k, first in enumerate(BANDS):
        out = F.when(length >= first, F.lit(k)).otherwise(out)
    return out


def scored_runs(text: Column) -> Column:
    """Array of (start, end, band, bin)."""

    def row(s: Column) -> Column:
        decades = F.floor(-20 * F.log10(F.greatest(battery(s["last"]), F.lit(1e-300))))
        bin_ = F.least(F.greatest(decades, F.lit(0)), F.lit(BINS)).cast("int")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), band(s["end"] - s["start"]).alias("band"), bin_.alias("bin"))

    return F.transform(run_spans(text), row)


# ---- over the corpus ----------------------------------------------------------------------------------------


def thresholds(docs: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """By band, the least bin whose p-values are discoveries; a band without discoveries has none."""
    runs = docs.select(F.explode(scored_runs(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("r"))
    counts = runs.groupBy("r.band", "r.bin").agg(F.count("*").alias("n")).collect()  # at most 4 * 1,001 rows
    out = {}
    for b in {r["band"] for r in counts}:
        bins = sorted(((r["bin"], r["n"]) for r in counts if r["band"] == b), reverse=True)
        m, rank = sum(n for _, n in bins), 0
        for k, n in bins:
            rank += n
            if 10 ** (-k / 20) <= false_share * rank / m:
                out[b] = k
    return out


def spans(docs: DataFrame, false_share: float = FALSE_SHARE, into: str = "secret_spans") -> DataFrame:
    """All columns of ``docs`` and ``into``: array of (start, kind number, end) in that order, base spans and added ones."""
    limits = thresholds(docs, false_share)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    least = F.lit(BINS + 1)
    by_kind = {k: unused(docs, f"spans_{k}") for k in KINDS}
    both = unused(docs, "spans_base")
    rows = docs.withColumns({by_kind[k]: c for k, c in base_spans(text).items()} | {by_kind["random"]: scored_runs(text)})

    def found(run: Column) -> Column:
        at_least = least
        for b, k in limits.items():
            at_least = F.when(run["band"] == b, F.lit(k)).otherwise(at_least)
        return run["bin"] >= at_least

    rows = rows.withColumn(both, F.concat(*(_as_spans(F.col(by_kind[k]), n) for n, k in enumerate(KINDS[:3]))))
    added = F.filter(by_kind["random"], lambda r: found(r) & ~F.exists(both, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))
    rows = rows.withColumn(into, F.array_sort(F.concat(both, _as_spans(added, 3))))
    return rows.drop(both, *by_kind.values())


def _as_spans(array: Column, kind: int) -> Column:
    return F.transform(array, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    found = F.col("secret_spans")
    # A span's kind, not a lambda with a second parameter: that would be its place in the array.
    kinds = F.transform(found, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, n)).cast("long") for n in range(3)]
    counts = [(F.size(kinds) - c).cast("long").alias(f"n_{k}") for c, k in zip(counts, KINDS)]
    base = F.sha2(joined(F.filter(found, lambda s: s["kind"] < 3)).cast("binary"), 256)
    return scanned.select(F.col("doc_id").cast("long"), *counts, base.alias("base_sha256"), joined(found).alias("spans"))


def masked(scanned: DataFrame, by: str = "[SECRET]", spans: str = "secret_spans") -> DataFrame:
    """The rows with each span, overlapping ones as one, replaced in the text; ``n_chars`` follows where there is one. Column ``spans`` goes."""
    text = F.col("text")
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        # Overlaps: a span that begins before ``at`` only moves ``at``.
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        done = F.when(s["start"] >= acc["at"], F.concat(acc["done"], between, F.lit(by))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = scanned.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(text))
    if "n_chars" in scanned.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop(spans)
