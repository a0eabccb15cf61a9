"""Secrets in whole texts: three patterns, and a battery of randomness tests.

The patterns find assignments of credentials, access keys and hex strings. The
battery looks at every other run of ``MIN_TOKEN`` or more letters, digits and
``+/_-``: the encoding is the smallest alphabet that has all its symbols; a
chi-squared test of uniformity over that alphabet, a runs test about its
middle and a lag-one serial correlation of symbol values give three p values
of "this is random", combined by Sidak's rule. Random strings have uniform p
values, words pile up near 0.

False discoveries (words taken for secrets) are controlled by length: tokens
shorter than what a test over that alphabet needs to tell language from noise
are left alone, and the others are gathered by encoding and length band over
the whole corpus. In each such stratum the share of truly random tokens is
estimated from the p values above one half, and the lowest cut is taken at
which the estimated share of false discoveries among the tokens above it is at
most ``rate``. The corpus is reduced to counts per stratum and p bin, a table
of fixed size.

All of it is column expressions: two scans, no Python, no shuffle of texts.
Offsets are code points, ends exclusive. Defined results: a null text is empty
and has no span; repeated rows get the same answer; a text of any length is
scanned whole; columns of the documents pass through, and columns that clash
with those of the scan are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.text import let, running_sum

#: The patterns of the base kinds, in order. A run is matched whole and judged by length.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the same matches as of all runs with those under 32 dropped
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGNED, MIN_ACCESS = 8, 16

MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
#: Alphabets by name, the smallest first.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "upper_hex": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": LOWER.upper(),
    "base32": LOWER.upper() + "234567",
    "lower_alnum": DIGITS + LOWER,
    "upper_alnum": DIGITS + LOWER.upper(),
    "letters": LOWER.upper() + LOWER,
    "alnum": DIGITS + LOWER.upper() + LOWER,
    "base64": LOWER.upper() + LOWER + DIGITS + "+/",
    "base64url": LOWER.upper() + LOWER + DIGITS + "-_",
}
#: Chance that two letters of a natural text are equal.
COINCIDENCE = 0.065
BANDS = (28, 40, 64)
BINS = 50
#: Estimated share of false discoveries allowed in a stratum.
RATE = 0.1
MASK = "[SECRET]"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _ends(text: Column, pattern: str, found: Column) -> Column:
    """Ends of all matches: the pieces between them and their own lengths, summed up."""
    steps = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m)
    )
    return F.when(F.size(found) > 0, running_sum(steps)).otherwise(F.array().cast("array<int>"))


def _spans(found: Column, ends: Column, kind: int, keep) -> Column:
    every = F.zip_with(
        found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("token"))
    )
    return F.filter(every, lambda s: keep(s["token"]))


def _normal_tail(z: Column) -> Column:
    """Two-sided p value of a standard normal (a polynomial of error under 2e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def least_length(alphabet: str) -> int:
    """Length from which uniformity over the alphabet tells language from noise by three deviations."""
    k = len(alphabet)
    shift = max(COINCIDENCE * k, 2.0) - 1.0
    return max(MIN_TOKEN, math.ceil(3.0 * math.sqrt(2.0 * (k - 1)) / shift) + 1)


def _encoding(token: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for name, alphabet in reversed(ALPHABETS.items()):
        has_all = F.translate(token, alphabet, "") == ""
        chosen = F.when(has_all, F.lit(name)).otherwise(chosen)
    return chosen


def battery(token: Column, encoding: Column) -> Column:
    """p value of "the token is random over its alphabet"; null without an encoding."""
    of = lambda f: F.coalesce(*[F.when(encoding == name, f(a)) for name, a in ALPHABETS.items()])
    n = F.length(token).cast("double")
    k = of(lambda a: F.lit(float(len(a))))
    squares = of(
        lambda a: F.aggregate(
            F.array(*[(F.length(token) - F.length(F.replace(token, F.lit(c), F.lit("")))).cast("double") for c in a]),
            F.lit(0.0), lambda s, c: s + c * c,
        )
    )
    alphabet = of(F.lit)
    values = F.transform(F.split(token, ""), lambda c: F.position(c, alphabet).cast("double"))
    return F.struct(n.alias("n"), k.alias("k"), squares.alias("squares"), values.alias("values"))


def p_value(b: Column) -> Column:
    """Combine the three tests over the sums that ``battery`` gathers."""
    n, k, values = b["n"], b["k"], b["values"]
    df = k - 1.0
    chi = k / n * b["squares"] - n
    spread = 2.0 / (9.0 * df)
    uniform = _normal_tail((F.cbrt(chi / df) - (1.0 - spread)) / F.sqrt(spread))

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    after = F.slice(values, F.lit(2), F.size(values))
    before = F.slice(values, F.lit(1), F.size(values) - 1)
    is_high = lambda v: (v > (k + 0.0) / 2.0).cast("double")
    high = total(F.transform(values, is_high))
    runs = 1.0 + total(F.zip_with(before, after, lambda x, y: F.abs(is_high(x) - is_high(y))))
    mean_runs = 2.0 * high * (n - high) / n + 1.0
    variance_runs = (mean_runs - 1.0) * (mean_runs - 2.0) / (n - 1.0)
    run = F.when(variance_runs > 0, _normal_tail((runs - mean_runs) / F.sqrt(variance_runs))).otherwise(F.lit(0.0))

    # the mean is bound, as it is used for every symbol
    centred = lambda mean: F.transform(values, lambda v: v - mean)
    gaps = lambda c: F.struct(
        total(F.transform(c, lambda v: v * v)).alias("variance"),
        total(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda x, y: x * y)).alias("lagged"),
    )
    serial = let(
        let(let(total(values) / n, centred), gaps),
        lambda g: F.when(
            g["variance"] > 0, _normal_tail((g["lagged"] / g["variance"] + 1.0 / n) * F.sqrt(n))
        ).otherwise(F.lit(0.0)),
    )
    least = F.least(uniform, run, serial)
    return 1.0 - F.pow(1.0 - least, F.lit(3.0))


def _stratum(encoding: Column, length: Column) -> Column:
    band = F.lit(0)
    for i, start in enumerate(BANDS):
        band = F.when(length >= start, F.lit(i + 1)).otherwise(band)
    return F.concat_ws(":", encoding, band.cast("string"))


def judged_tokens(found: Column) -> Column:
    """(stratum, bin) of each token; null where the battery cannot judge."""
    as_encoded = F.transform(found, lambda t: F.struct(t.alias("t"), _encoding(t).alias("e")))
    least = F.create_map(*[F.lit(x) for name, a in ALPHABETS.items() for x in (name, least_length(a))])
    gathered = F.transform(
        as_encoded,
        lambda x: F.when(
            x["e"].isNotNull() & (F.length(x["t"]) >= least[x["e"]]),
            F.struct(_stratum(x["e"], F.length(x["t"])).alias("stratum"), battery(x["t"], x["e"]).alias("b")),
        ),
    )
    return F.transform(
        gathered,
        lambda g: F.when(
            g.isNotNull(),
            F.struct(
                g["stratum"].alias("stratum"),
                F.least(F.floor(p_value(g["b"]) * BINS), F.lit(BINS - 1)).cast("int").alias("bin"),
            ),
        ),
    )


def cuts(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> dict[str, int]:
    """Lowest p bin taken per stratum, from the counts of all tokens of all texts."""
    found = _found(F.coalesce(F.col(text_col), F.lit("")), TOKEN)
    tokens = docs.select(found.alias("found")).where("size(found) > 0").select(F.explode(judged_tokens(F.col("found"))).alias("j"))
    rows = tokens.where("j is not null").groupBy("j.stratum", "j.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[str, list[int]] = {}
    for r in rows:
        counts.setdefault(r["stratum"], [0] * BINS)[r["bin"]] += r["n"]
    return {s: cut for s, by_bin in counts.items() if (cut := lowest_cut(by_bin, rate)) is not None}


def lowest_cut(by_bin: list[int], rate: float) -> int | None:
    """The first bin from which on the estimated false discoveries stay within ``rate``."""
    half = len(by_bin) // 2
    random = sum(by_bin[half:]) / 0.5
    for cut in range(1, len(by_bin)):
        taken = sum(by_bin[cut:])
        if taken and 1.0 - random * (1.0 - cut / len(by_bin)) / taken <= rate:
            return cut
    return None


def with_spans(docs: DataFrame, text_col: str = "text", rate: float = RATE, out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: array of (start, kind number, end), sorted."""
    taken = cuts(docs, text_col, rate)
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, TOKEN)
    scanned = docs.withColumn("_found", F.struct(*[_found(text, p).alias(k) for k, p in zip(KINDS, patterns)]))
    scanned = scanned.withColumn(
        "_ends", F.struct(*[_ends(text, p, F.col("_found")[k]).alias(k) for k, p in zip(KINDS, patterns)])
    )
    keep = {
        "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGNED,
        "access": lambda m: F.length(m) >= MIN_ACCESS,
        "hex": lambda m: F.lit(True),
    }
    parts = [_spans(F.col("_found")[k], F.col("_ends")[k], i, keep[k]) for i, k in enumerate(KINDS[:3])]
    if taken:
        limit = F.create_map(*[F.lit(x) for s, cut in sorted(taken.items()) for x in (s, cut)])
        found, ends = F.col("_found")["random"], F.col("_ends")["random"]
        judged = F.zip_with(
            _spans(found, ends, 3, lambda m: F.lit(True)), judged_tokens(found),
            lambda s, j: F.struct(s.alias("s"), F.coalesce(j["bin"] >= limit[j["stratum"]], F.lit(False)).alias("ok")),
        )
        parts.append(F.transform(F.filter(judged, lambda x: x["ok"]), lambda x: x["s"]))
    narrow = F.transform(F.concat(*parts), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return scanned.withColumn(out, F.array_sort(narrow)).drop("_found", "_ends")


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each stretch of overlapping spans replaced by one mask."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        grown = F.concat(
            acc["parts"],
            F.when(
                (s["start"] >= acc["pos"]) & ((s["start"] > acc["pos"]) | (F.size(acc["parts"]) == 0)),
                F.array(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mask)),
            ).otherwise(F.array().cast("array<string>")),
        )
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), grown.alias("parts"))

    done = F.aggregate(
        spans, start, step,
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["pos"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    return with_spans(docs).select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(span_text(F.filter(spans, lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with secrets masked and ``n_chars`` counted anew."""
    text = F.col("text")
    cleaned = with_spans(docs, out="_spans").withColumn("text", masked(text, F.col("_spans")))
    counted = F.when(text.isNotNull(), F.length("text").cast("bigint"))
    return cleaned.withColumn("n_chars", F.coalesce(counted, F.col("n_chars"))).select(*docs.columns)
