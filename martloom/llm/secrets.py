"""Secrets in texts: patterns, and strings that a battery of randomness tests can't tell from random keys.

Everything is DataFrame functions. Long strings of encoded letters and digits are candidates; from its characters each has an
encoding with an alphabet. Under the hypothesis that its symbols are drawn evenly and independently, three tests give p-values:
chi-squared of symbol classes (as many classes as the length carries), Wald-Wolfowitz runs about the alphabet's middle, and
serial correlation of neighbours. Short strings are tested with less power, so candidates are compared within their encoding
and length class: a Benjamini-Hochberg step in each class rejects the hypothesis at a false-discovery rate of RATE, and
what isn't rejected is reported as random. p-values are rounded up to a grid of LEVELS_PER_BIT levels for each bit, which keeps
the rate and lets the step work on counts by class and level, a table of bounded size.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from martloom.llm.common import stored, texts

# The base patterns, and the alphabets by encoding.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("random16", r"[0-9a-f]+", DIGITS + "abcdef"),
    ("random16u", r"[0-9A-F]+", DIGITS + "ABCDEF"),
    ("random32", r"[A-Z2-7]+", UPPER + "234567"),
    ("random36", r"[0-9a-z]+", DIGITS + LOWER),
    ("random36u", r"[0-9A-Z]+", DIGITS + UPPER),
    ("random62", r"[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    ("random64", r"[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/"),
    ("random64u", r"[A-Za-z0-9_-]+", UPPER + LOWER + DIGITS + "-_"),
)
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *(name for name, _, _ in ENCODINGS))

ACCESS_LENGTH = 20
ASSIGN_LENGTH = 6
RATE = 0.01
LEVELS_PER_BIT = 8
EXPECTED = 5


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of a pattern's matches; code points, end exclusive. value: the group's text.

    Between the matches lies what split() leaves, so lengths give places. Texts without a match are passed over by one search.
    """
    whole, value, gaps = (F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1))
    parts = F.arrays_zip(whole.alias("whole"), value.alias("value"), gaps.alias("gap"))
    kind = "array<struct<start: bigint, end: bigint, value: string>>"
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("found"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["whole"])
        one = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.struct(F.coalesce(end, start).cast("bigint").alias("at"),
                        F.when(part["whole"].isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(one)).cast(kind)).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(parts, first, step, lambda s: s["found"])).otherwise(F.array().cast(kind))


def _normal_tail(z: Column) -> Column:
    """P(Z > z): a rational form near the middle, the asymptotic series in the tail."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / 2.5066282746310002
    t = 1 / (1 + 0.2316419 * x)
    middle = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = density / x * (1 - 1 / (x * x) + 3 / F.pow(x, F.lit(4.0)))
    upper = F.when(x < 4, middle).otherwise(far)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _with_encoding(c: Column) -> Column:
    """Candidate with its encoding's number; strings of letters alone are words and have none."""
    mixed = c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]")
    which = F.lit(None).cast("int")
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        which = F.when(c["value"].rlike(f"^{pattern}$"), F.lit(i)).otherwise(which)
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), F.when(mixed, which).alias("encoding"))


def _with_symbols(c: Column) -> Column:
    alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a in ENCODINGS]), c["encoding"] + 1)
    n = F.length(c["value"])
    symbols = F.transform(F.split(c["value"], ""), lambda x: F.position(x, alphabet) - 1)
    size = F.length(alphabet)
    bins = F.greatest(F.lit(2), F.least(size, F.floor(n / EXPECTED).cast("int")))
    return F.struct(*[c[x].alias(x) for x in ("start", "end", "encoding")], symbols.alias("v"), n.alias("n"), size.alias("a"), bins.alias("bins"))


def _with_sums(c: Column) -> Column:
    """Sums of the symbols, their squares and the products of neighbours: one step each, so the work grows with the length."""
    v, zero = c["v"], F.lit(0.0)
    total = F.aggregate(v, zero, lambda acc, x: acc + x)
    squares = F.aggregate(v, zero, lambda acc, x: acc + x * x)
    products = F.aggregate(F.sequence(F.lit(1), c["n"] - 1), zero, lambda acc, i: acc + F.get(v, i) * F.get(v, i - 1))
    return F.struct(*[c[x].alias(x) for x in ("start", "end", "encoding", "v", "n", "a", "bins")], total.alias("total"), squares.alias("squares"),
                    products.alias("products"))


def _with_statistics(c: Column) -> Column:
    n, a, bins, v = c["n"], c["a"], c["bins"], c["v"]
    zero = F.lit(0.0)

    def squared(acc: Column, b: Column) -> Column:
        seen = F.size(F.filter(v, lambda x: F.floor(x * bins / a) == b))
        share = (F.ceil((b + 1) * a / bins) - F.ceil(b * a / bins)) / a
        return acc + F.pow(seen - n * share, F.lit(2.0)) / (n * share)

    chi = F.aggregate(F.sequence(F.lit(0), bins - 1), zero, squared)
    high = F.size(F.filter(v, lambda x: x * 2 >= a)).cast("double")
    steps = F.sequence(F.lit(1), n - 1)
    changes = F.aggregate(steps, zero, lambda acc, i: acc + F.when((F.get(v, i) * 2 >= a) != (F.get(v, i - 1) * 2 >= a), 1.0).otherwise(0.0))
    mean = c["total"] / n
    spread = c["squares"] - c["total"] * mean
    product = c["products"] - mean * (2 * c["total"] - F.get(v, F.lit(0)) - F.get(v, n - 1)) + (n - 1) * mean * mean
    return F.struct(*[c[x].alias(x) for x in ("start", "end", "encoding", "n", "bins")], chi.alias("chi"), high.alias("high"),
                    (changes + 1).alias("runs"), F.when(spread > 0, product / spread).otherwise(F.lit(1.0)).alias("serial"))


def _with_level(c: Column) -> Column:
    """The combined p-value as a level: p <= 2 ** (-level / LEVELS_PER_BIT)."""
    n, df = c["n"].cast("double"), (c["bins"] - 1).cast("double")
    cube = F.pow(c["chi"] / df, F.lit(1.0 / 3))
    uniform = _normal_tail((cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    low = n - c["high"]
    expected = 2 * c["high"] * low / n
    variance = F.greatest(expected * (expected - 1) / (n - 1), F.lit(1e-9))
    runs = 2 * _normal_tail(F.abs(c["runs"] - 1 - expected) / F.sqrt(variance))
    serial = 2 * _normal_tail(F.abs(c["serial"] + 1 / n) * F.sqrt(n))
    p = F.least(F.lit(1.0), 3 * F.greatest(F.least(uniform, runs, serial), F.lit(1e-300)))
    level = F.floor(-F.log2(p) * LEVELS_PER_BIT + 1e-9).cast("int")
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"),
                    F.floor(F.log2(n) * 2).cast("int").alias("size"), level.alias("level"))


def rejection_levels(tested: DataFrame) -> DataFrame:
    """(encoding, size, least): the level from which the step rejects, for each class of (encoding, size, level)."""
    counts = tested.groupBy("encoding", "size", "level").agg(F.count("*").alias("n"))
    per_class = Window.partitionBy("encoding", "size")
    from_top = per_class.orderBy(F.col("level").desc())
    ranked = counts.withColumn("k", F.sum("n").over(from_top)).withColumn("m", F.sum("n").over(per_class))
    passing = F.pow(F.lit(2.0), -F.col("level") / LEVELS_PER_BIT) <= RATE * F.col("k") / F.col("m")
    return ranked.where(passing).groupBy("encoding", "size").agg(F.min("level").alias("least"))


def _spans(found: Column, kind: Column | str, rank: Column | int) -> Column:
    kind, rank = (F.lit(x) if isinstance(x, (str, int)) else x for x in (kind, rank))
    return F.transform(found, lambda c: F.struct(c["start"].alias("start"), rank.alias("rank"), kind.alias("kind"), c["end"].alias("end")))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, rank, kind, end>>) for every row, by start, then kind.

    Null and empty texts have no spans. Spans of different kinds may overlap. Repeated rows are searched each, and each
    counts as a candidate of its own in the false-discovery step.
    """
    data = texts(df, id_col, text_col)
    text = F.col("text")
    assign = F.filter(_matches(text, ASSIGN, 2), lambda c: F.length(c["value"]) >= ASSIGN_LENGTH)
    access = F.filter(_matches(text, ACCESS), lambda c: F.length(c["value"]) >= ACCESS_LENGTH)
    base = F.concat(*[_spans(x, k, i) for i, (k, x) in enumerate(zip(BASE_KINDS, (assign, access, _matches(text, HEX))))])
    tested = F.transform(_matches(text, CANDIDATE), _with_encoding)
    tested = F.filter(tested, lambda c: c["encoding"].isNotNull())
    for step in (_with_symbols, _with_sums, _with_statistics, _with_level):
        tested = F.transform(tested, step)
    rows = stored(data.select("doc_id", base.alias("base"), tested.alias("tested")), "secrets")
    levels = rejection_levels(rows.select(F.explode("tested").alias("c")).select("c.*")).collect()
    limits = F.lit(None).cast("int")
    if levels:
        table = F.create_map(*[F.lit(x) for r in levels for x in (r["encoding"] * 1000 + r["size"], r["least"])])
        limit_of = lambda c: F.element_at(table, c["encoding"] * 1000 + c["size"])
    else:
        limit_of = lambda c: limits
    random = F.filter("tested", lambda c: c["level"] < F.coalesce(limit_of(c), F.lit(1 << 30)))
    names = F.array(*[F.lit(name) for name, _, _ in ENCODINGS])
    added = F.transform(random, lambda c: F.struct(
        c["start"].alias("start"), (c["encoding"] + len(BASE_KINDS)).alias("rank"),
        F.element_at(names, c["encoding"] + 1).alias("kind"), c["end"].alias("end")))
    return rows.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def span_text(base_only: bool) -> Column:
    chosen = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS)) if base_only else F.col("spans")
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
