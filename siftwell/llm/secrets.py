"""Secret scans with a battery of randomness tests, in DataFrame functions alone.

Base spans are matches of three fixed patterns. Further spans are runs of at least
20 key characters that look random: an encoding is inferred for each, and
chi-squared uniformity over its alphabet, a runs test about the alphabet's
middle and a serial-correlation test must all fail to find structure.

To find no structure is little proof in a short run. Each test therefore also gives
the chance that an ordinary string of this length comes as near to randomness: one
whose characters are as uneven as in prose (chi-squared), one whose runs, or whose
neighbours' correlation, are off by ``effect`` of the most possible. A string is
ordinary if any one of these holds, so the largest of the three chances is the
run's p-value. Longer runs have smaller ones; a Benjamini-Hochberg step over each
text's runs controls the share of ordinary strings among those found.

Everything is worked out within a row: nothing is shuffled.

Defined results: a null text counts as empty and has no spans; rows are scanned
one by one, so repeated rows and ids are no matter; very long texts are scanned
whole, their spans added up in blocks; random spans may overlap base spans, which
all stay; spans that begin together go by kind in the order listed; other columns are
ignored, whatever their names, and a kept one named as a result gives way; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, the group whose length counts, and the least length.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
#: The same matches, less the ones that are too short, where a run's length decides alone.
LONG_ENOUGH = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
RANDOM = "random"
RUN = r"[A-Za-z0-9+/_-]{20,}"
#: Matches whose lengths are added up at a time.
BLOCK = 256

_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by the pattern of a whole run, the first that fits: name, pattern, alphabet, and the chance that two characters of an ordinary string are equal.
ENCODINGS = [
    ("decimal", "^[0-9]+$", _DIG, 0.16),
    ("hex", "^[0-9a-f]+$", _DIG + "abcdef", 0.125),
    ("HEX", "^[0-9A-F]+$", _DIG + "ABCDEF", 0.125),
    ("lower", "^[a-z]+$", _LOW, 0.066),
    ("upper", "^[A-Z]+$", _UP, 0.066),
    ("base32", "^[A-Z2-7]+$", _UP + "234567", 0.066),
    ("lower36", "^[a-z0-9]+$", _LOW + _DIG, 0.06),
    ("upper36", "^[A-Z0-9]+$", _UP + _DIG, 0.06),
    ("base62", "^[A-Za-z0-9]+$", _UP + _LOW + _DIG, 0.05),
    ("base64", "", _UP + _LOW + _DIG + "+/", 0.05),
]
#: How much three characters of an ordinary string are equal beyond what equal pairs imply, in squares of the pairs' chance: that of English letters.
UNEVEN = 0.28


def spans_of(text: Column, pattern: str) -> Column:
    """Arrays of struct(start, end, found) of a pattern's matches, in code points: lengths of gaps and matches added up.

    Sums are taken over blocks of matches and within each block, as a sum that
    appends to one array copies it at every match.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    pairs = F.filter(F.zip_with(found, gaps, lambda f, g: F.struct(f.alias("f"), F.length(g).alias("g"))), lambda p: p["f"].isNotNull())
    size = lambda p: p["g"] + F.length(p["f"])

    def within(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), none.alias("out")),
            lambda acc, p: F.struct(
                (acc["at"] + size(p)).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + p["g"]).alias("start"), (acc["at"] + size(p)).alias("end"), p["f"].alias("found")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def blocks(p: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, BLOCK))
        ends = lambda b: F.aggregate(
            F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda n, q: n + size(q))), F.array(F.lit(0)), lambda e, n: F.concat(e, F.array(F.element_at(e, -1) + n))
        )
        return _let(parts, lambda b: F.flatten(_let(ends(b), lambda e: F.transform(b, lambda x, i: within(x, e[i])))))

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(pairs, lambda p: F.when(F.size(p) <= BLOCK, within(p, F.lit(0))).otherwise(blocks(p)))).otherwise(none)


def upper_tail(z: Column) -> Column:
    """The standard normal's upper tail, by a rational approximation whose error is below 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    p = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, p).otherwise(1 - p)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def randomness(run: Column, effect: float = 0.75) -> Column:
    """struct(p, chance) of a run: how well it agrees with randomness, and how likely an ordinary string of its length comes as near to it."""
    plain = F.translate(run, "-_", "+/")
    which = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        which = F.when(F.regexp_like(plain, F.lit(ENCODINGS[i][1])), i).otherwise(which)
    alphabets, equal = F.array(*[F.lit(x[2]) for x in ENCODINGS]), F.array(*[F.lit(x[3]) for x in ENCODINGS])

    def tested(e: Column) -> Column:
        text, alphabet, q = e["text"], e["alphabet"], e["equal"]
        k, n = F.length(alphabet).cast("double"), F.length(text).cast("double")
        letters = F.split(text, "")
        far = effect * F.sqrt(n)  # how far z is off for a string with as much structure as effect says
        squares = F.aggregate(F.transform(F.array_distinct(letters), lambda c: n - F.length(F.replace(text, c))), F.lit(0.0), lambda a, x: a + x * x)
        chi = k / n * squares - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        # equal pairs of characters: how many there are, and their mean and variance in an ordinary string
        pairs, equal_pairs = n * (n - 1) / 2, (squares - n) / 2
        z_uneven = (equal_pairs - pairs * q) / F.sqrt(pairs * q * (1 - q) + UNEVEN * q * q * n * n * n)

        def ordered(x: Column) -> Column:
            above = F.transform(x, lambda v: (v * 2 > k).cast("double"))
            total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
            m = F.size(x)
            n1 = total(above)
            n2 = n - n1
            mean = 2 * n1 * n2 / n + 1
            spread = (mean - 1) * (mean - 2) / (n - 1)
            runs = 1 + _let(above, lambda b: total(F.zip_with(F.slice(b, 1, m - 1), F.slice(b, 2, m - 1), lambda u, v: F.abs(u - v))))
            z_runs = F.when(spread > 0, F.abs(runs - mean) / F.sqrt(spread)).otherwise(float("inf"))

            def serial(y: Column) -> Column:
                var = total(F.transform(y, lambda v: v * v))
                lag = total(F.zip_with(F.slice(y, 1, m - 1), F.slice(y, 2, m - 1), lambda u, v: u * v))
                return F.when(var > 0, F.abs(lag / var * F.sqrt(n))).otherwise(float("inf"))

            z_serial = _let(total(x) / n, lambda mean_x: _let(F.transform(x, lambda v: v - mean_x), serial))
            both = F.struct(z_runs.alias("runs"), z_serial.alias("serial"))
            return _let(both, lambda z: F.struct(
                F.least(F.lit(1.0), 3 * F.least(upper_tail(z_chi), 2 * upper_tail(z["runs"]), 2 * upper_tail(z["serial"]))).alias("p"),
                F.greatest(upper_tail(-z_uneven), upper_tail(far - z["runs"]), upper_tail(far - z["serial"])).alias("chance"),
            ))

        return _let(F.transform(letters, lambda c: F.position(c, alphabet).cast("double")), ordered)

    return _let(which, lambda w: _let(F.struct(F.when(w == len(ENCODINGS) - 1, plain).otherwise(run).alias("text"), alphabets[w].alias("alphabet"), equal[w].alias("equal")), tested))


def random_spans(text: Column, alpha: float, fdr: float) -> Column:
    """Spans of random-looking runs."""
    runs = F.transform(spans_of(text, RUN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), randomness(s["found"]).alias("t")))

    def chosen(r: Column) -> Column:
        m = F.size(r)
        passed = F.array_sort(F.transform(F.filter(r, lambda s: s["t"]["p"] >= alpha), lambda s: F.struct(s["t"]["chance"].alias("chance"), s["start"].alias("start"), s["end"].alias("end"))))
        # Benjamini-Hochberg: the largest rank i whose chance is at most fdr * i / m, and all before it
        return _let(passed, lambda a: F.slice(a, 1, F.aggregate(F.transform(a, lambda s, i: F.when(s["chance"] <= fdr * (i + 1) / m, i + 1).otherwise(0)), F.lit(0), lambda x, y: F.greatest(x, y))))

    return _let(runs, chosen)


def scan(docs: DataFrame, keep: list[str], alpha: float = 0.01, fdr: float = 0.05) -> DataFrame:
    """``keep`` columns of ``docs`` with n_assign, n_access, n_hex, n_random, base_spans and all_spans.

    Spans are struct(start, order, end, kind), sorted. ``alpha`` is the level at
    which the battery finds structure; ``fdr`` the accepted share of ordinary
    strings among the further spans.
    """
    # the kept columns as one, so that no name clashes
    ours = ("n_assign", "n_access", "n_hex", "n_random", "base_spans", "all_spans")
    out = docs.select(F.struct(*[k for k in keep if k.lower() not in ours]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    text = F.col("__text")
    for order, (kind, pattern, group, least) in enumerate(BASE):
        long_enough = (lambda p, g, n: lambda s: F.length(F.regexp_extract(s["found"], p, g)) >= n)(pattern, group, least)
        spans = F.filter(spans_of(text, pattern), long_enough) if group else spans_of(text, LONG_ENOUGH[kind])
        out = out.withColumn(f"__{kind}", F.transform(spans, (lambda o, k: lambda s: F.struct(s["start"].alias("start"), F.lit(o).alias("order"), s["end"].alias("end"), F.lit(k).alias("kind")))(order, kind)))
    out = out.withColumn("base_spans", F.array_sort(F.concat(*[f"__{k}" for k, *_ in BASE])))
    extra = F.transform(random_spans(text, alpha, fdr), lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE)).alias("order"), s["end"].alias("end"), F.lit(RANDOM).alias("kind")))
    out = out.withColumn("__random", extra).withColumn("all_spans", F.array_sort(F.concat("base_spans", "__random")))
    counts = [F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "random")]
    return out.select("row.*", *counts, "base_spans", "all_spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
