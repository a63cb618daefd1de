"""Quality rules on whole texts, and robust outlier rejection by minimum-covariance-determinant estimates.

Every document gets a few counts and from them a vector of transformed shares. For each language
and source, the centre and covariance of the three quarters of documents with the smallest
determinant of the covariance are sought: from several starts (medians and quartile ranges, mean
and covariance, medians alone) two concentration steps re-estimate from the rows with the smallest
Mahalanobis distances; the start with the smallest determinant then goes on, each group until its
determinant stays. Documents far from their group's centre are rejected.

Every estimate counts ``PRIOR`` rows with the medians and quartile ranges of the group's language
besides its own, and the language's as many with those of all rows. So a group's own rows weigh
n / (n + PRIOR), whatever their number, and no size switches between estimates.

A step is one aggregation: moments are summed by group and bin of distance, and the bins up to the
quantile added, the last one in part, so that the subsets of all starts are of equal size. So no
group, however large, meets in one task, and a repeated run gives the same verdicts. A floor under
every variance keeps shares that are almost always zero from making small deviations count.
Everything is DataFrame functions.

Defined cases: a null, empty or blank text has no words and fails the base rules; fewer than 8
words have no windows; a null language or source is a group of its own; repeated rows count and
are judged alike; an empty table gives an empty table; other columns are passed through, columns
named like the counts are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import NOT_WHITE, WHITE, dropped, stored

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SYMBOLS = "[#*$%&|<>]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
PRIOR = 60
CLOSEST, FIRST_STEPS, MOST_STEPS, SETTLED = 0.75, 2, 20, 1e-6
#: Mean of the shares' prior, its weight in words or characters, and the floor of the deviation, for each transformed share.
SHARES = ["word_length", "symbols", "capitals", "repeats", "dup_lines"]
FLOOR = {"word_length": 0.05, "symbols": 0.045, "capitals": 0.07, "repeats": 0.12, "dup_lines": 0.12}
#: Median and 0.99999 quantile of the chi-squared distribution with five degrees of freedom.
CHI_MEDIAN, CHI_CUT = 4.3515, 30.8562
BINS = 40


def _without(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def _doubled(hashes: str, by: int) -> Column:
    """From hashes of runs of ``by`` words those of twice as many; the last ones lack words."""
    return F.zip_with(hashes, F.slice(hashes, by + 1, F.size(hashes)), lambda x, y: F.xxhash64(x, y))


def counted(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the five counts, n_lines and capitals."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = documents.drop(*COUNTS, "n_lines", "n_capitals").withColumns(
        {
            "_words": F.filter(F.split(body, WHITE + "+"), lambda w: w != ""),
            "_full": F.filter(F.split(body, "\n", -1), lambda line: line.rlike(NOT_WHITE)),
            "n_symbols": (F.length(body) - F.length(_without(body, SYMBOLS))).cast("long"),
            "n_capitals": (F.length(body) - F.length(_without(body, "[A-Z]+"))).cast("long"),
        }
    )
    rows = rows.withColumns(
        {
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_words": F.size("_words").cast("long"),
            "n_lines": F.size("_full").cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        }
    ).drop("_words", "_full")
    for by in (1, 2, 4):  # WINDOW is 8
        rows = rows.withColumn("_hashes", _doubled("_hashes", by))
    rows = rows.withColumn("_windows", F.slice("_hashes", 1, F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0))))
    # Sorting windows with their places is left to the few texts in which a window repeats at all.
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_placed", F.when(repeats, placed))
    twice = F.zip_with(
        F.slice("_placed", 1, F.size("_placed") - 1), F.slice("_placed", 2, F.size("_placed") - 1), lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i))
    )
    found = F.array_sort(F.array_distinct(F.flatten(F.array_compact(twice))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(found, zero, lambda acc, i: F.struct((acc.n + F.least(F.lit(WINDOW), i - acc.last)).alias("n"), i.alias("last")), lambda acc: acc.n)
    return rows.withColumn("n_repeat_words", F.when(F.col("_placed").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("_hashes", "_windows", "_placed")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def shares() -> list[Column]:
    """The transformed statistics; each share has a prior, as short texts say little about theirs."""

    def root(part: str, of: str, prior: float) -> Column:
        return F.sqrt(F.col(part) / (F.col(of) + F.lit(prior)))

    return [
        F.log((F.col("word_chars") + 300.0) / (F.col("n_words") + 50.0)).alias("word_length"),
        root("n_symbols", "word_chars", 100.0).alias("symbols"),
        root("n_capitals", "word_chars", 100.0).alias("capitals"),
        root("n_repeat_words", "n_words", 20.0).alias("repeats"),
        root("n_dup_lines", "n_lines", 4.0).alias("dup_lines"),
    ]


def grouped(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """``rows`` with the columns g1, g2 of their group, a language and source."""
    return rows.withColumns({g: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for g, c in (("g1", lang), ("g2", source))})


def histogram(rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """g1, g2, name, bin (of 1 / BINS) and n of each of the values."""
    bins = [f"named_struct('name', '{name}', 'bin', cast(floor(({v}) * {BINS}) as bigint))" for name, v in values.items()]
    return rows.selectExpr("g1", "g2", f"explode(array({', '.join(bins)})) as b").groupBy("g1", "g2", "b.name", "b.bin").agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, names: list[str], at: list[float], key: list[str]) -> DataFrame:
    """From a histogram, for each ``key`` and value its quantiles, as upper edges of bins; columns name_i, and rows (how many)."""
    summed = counts.groupBy(*key, "name", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*key, "name")
    run = summed.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})
    out = [F.expr(f"min(case when name = '{name}' and upto >= {q} * all then (bin + 1) / {BINS}D end) as {name}_{i}") for name in names for i, q in enumerate(at)]
    return run.groupBy(*key).agg(F.max("all").alias("rows"), *out)


QUARTILES = [0.25, 0.5, 0.75]


def priors(counts: DataFrame) -> DataFrame:
    """g1, pc_i, pv_i: what the PRIOR rows of a language's groups have as centre and variance."""
    spread = [f"pow(({s}_2 - {s}_0) / 1.349D, 2)" for s in SHARES]
    every = quantiles(counts, SHARES, QUARTILES, []).selectExpr(*(f"{s}_1 as ac_{i}" for i, s in enumerate(SHARES)), *(f"{v} as av_{i}" for i, v in enumerate(spread))).first()  # ten numbers
    own = quantiles(counts, SHARES, QUARTILES, ["g1"])
    mixed = [f"(rows * {x} + {PRIOR} * {every[f'{a}_{i}'] or 0.0!r}D) / (rows + {PRIOR}) as {p}_{i}" for i, s in enumerate(SHARES) for x, a, p in ((f"{s}_1", "ac", "pc"), (spread[i], "av", "pv"))]
    return own.selectExpr("g1", *mixed)


P = range(len(SHARES))
LOWER = [(i, j) for i in P for j in range(i + 1)]


def _solved(sums: DataFrame, *key: str) -> DataFrame:
    """From n and sums s_i, s_i_j: the centre c_i, the inverse m_i_j of the floored covariance's Cholesky factor, and log_det.

    Written as SQL text: so many small terms take seconds to build as columns, one by one.
    """
    centre = [f"s_{i} / n as c_{i}" for i in P]
    floored = [f"s_{i}_{j} / n - (s_{i} / n) * (s_{j} / n) + {FLOOR[SHARES[i]] ** 2 if i == j else 0.0}D as s_{i}_{j}" for i, j in LOWER]
    out = sums.selectExpr(*key, *centre, *floored)

    def less(i: int, j: int) -> str:
        return " - ".join([f"s_{i}_{j}", *(f"l_{i}_{k} * l_{j}_{k}" for k in range(j))])

    for j in P:  # a column of the factor in each step
        root = f"sqrt(greatest({less(j, j)}, 1e-9D))"
        out = out.selectExpr("*", *(f"{root if i == j else f'({less(i, j)}) / {root}'} as l_{i}_{j}" for i in P if i >= j))
    for i in P:  # a row of its inverse in each step
        rows = [f"-({' + '.join(f'l_{i}_{k} * m_{k}_{j}' for k in range(j, i))}) / l_{i}_{i} as m_{i}_{j}" for j in range(i)]
        out = out.selectExpr("*", *rows, f"1 / l_{i}_{i} as m_{i}_{i}")
    det = " + ".join(f"2 * ln(l_{i}_{i})" for i in P)
    return out.selectExpr(*key, *(f"c_{i}" for i in P), *(f"m_{i}_{j}" for i, j in LOWER), f"{det} as log_det")


def _moments() -> list[Column]:
    sums = [f"sum({s}) as s_{i}" for i, s in enumerate(SHARES)] + [f"sum({SHARES[i]} * {SHARES[j]}) as s_{i}_{j}" for i, j in LOWER]
    return [F.expr(x) for x in ["count(*) as n", *sums]]


SUMS = ["n", *(f"s_{i}" for i in P), *(f"s_{i}_{j}" for i, j in LOWER)]


def blended(sums: DataFrame, prior: DataFrame) -> DataFrame:
    """Sums of groups with those of their PRIOR rows added."""
    kept = [c for c in sums.columns if c not in SUMS]
    own = [f"n + {PRIOR} as n", *(f"s_{i} + {PRIOR} * pc_{i} as s_{i}" for i in P)]
    both = [f"s_{i}_{j} + {PRIOR} * (pc_{i} * pc_{j} + {f'pv_{i}' if i == j else '0D'}) as s_{i}_{j}" for i, j in LOWER]
    return sums.join(prior, "g1").selectExpr(*kept, *own, *both)


def starts(rows: DataFrame, counts: DataFrame, prior: DataFrame) -> DataFrame:
    """g1, g2, start (a number), c_i, m_i_j, log_det of each group's starts."""
    found = quantiles(counts, SHARES, QUARTILES, ["g1", "g2"])
    centre = [f"{s}_1 as c_{i}" for i, s in enumerate(SHARES)]

    def diagonal(number: int, spread: list[str]) -> DataFrame:
        inverse = [f"{f'1 / sqrt(pow({spread[i]}, 2) + {FLOOR[SHARES[i]] ** 2}D)' if i == j else '0D'} as m_{i}_{j}" for i, j in LOWER]
        return found.selectExpr("g1", "g2", f"{number} as start", *centre, *inverse, "0D as log_det")

    quartiles = diagonal(0, [f"({s}_2 - {s}_0) / 1.349D" for s in SHARES])
    mean = _solved(blended(rows.groupBy("g1", "g2").agg(*_moments()).withColumn("start", F.lit(1)), prior), "g1", "g2", "start")
    return quartiles.unionByName(mean).unionByName(diagonal(2, ["0D"] * len(SHARES)))


def concentrated(rows: DataFrame, found: DataFrame, prior: DataFrame) -> DataFrame:
    """One concentration step: the estimates from the rows closest to ``found``, by g1, g2 and start; other groups are left out."""
    key = ["g1", "g2", "start"]
    bins = F.floor(F.log(F.col("d2") + 1e-6) * BINS).cast("long")
    sums = distances(rows, found, "inner").groupBy(*key, bins.alias("bin")).agg(*_moments())
    group = Window.partitionBy(*key)
    nearer = F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sums.withColumns({"nearer": nearer, "all": F.sum("n").over(group)}).where(f"nearer < {CLOSEST} * all")
    part = kept.withColumn("part", F.expr(f"least(1D, ({CLOSEST} * all - nearer) / n)"))
    return _solved(blended(part.groupBy(*key).agg(*(F.expr(f"sum({c} * part) as {c}") for c in SUMS)), prior), *key)


def distances(rows: DataFrame, estimates: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with d2, the squared Mahalanobis distance to their group's centre (for each start, if estimates have several)."""
    scaled = [" + ".join(f"m_{i}_{j} * ({SHARES[j]} - c_{j})" for j in range(i + 1)) for i in P]
    kept = [f"`{c}`" for c in rows.columns] + [c for c in estimates.columns if c == "start"]
    values = ["g1", "g2", *(c for c in ("start",) if c in estimates.columns), *(f"c_{i}" for i in P), *(f"m_{i}_{j}" for i, j in LOWER)]
    joined = rows.join(estimates.select(*values), ["g1", "g2"], how)
    return joined.selectExpr(*kept, " + ".join(f"pow({y}, 2)" for y in scaled) + " as d2")


def fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Estimates of each group, and the factor by which its distances are wider than normal ones."""
    counts = stored(histogram(rows, {s: s for s in SHARES}), "histogram")
    prior = stored(priors(counts), "priors")
    found = stored(starts(rows, counts, prior), "starts")

    def stepped(before: DataFrame) -> DataFrame:
        after = stored(concentrated(rows, before, prior), "estimates")
        dropped(before)
        return after

    for _ in range(FIRST_STEPS):
        found = stepped(found)
    values = [c for c in found.columns if c not in ("g1", "g2", "log_det", "start")]
    least = found.groupBy("g1", "g2").agg(F.min(F.struct("log_det", "start", *values)).alias("e"))
    active = stored(least.select("g1", "g2", "e.start", *(f"e.{c}" for c in values), "e.log_det"), "best")
    dropped(found)
    settled: list[DataFrame] = []
    for _ in range(MOST_STEPS):
        after = concentrated(rows, active, prior).join(active.select("g1", "g2", F.col("log_det").alias("was")), ["g1", "g2"])
        after = stored(after.withColumn("stays", F.abs(F.col("log_det") - F.col("was")) < SETTLED).drop("was"), "estimates")
        dropped(active)
        settled.append(after.where("stays").drop("stays"))
        active = after.where("not stays").drop("stays")
        active.scratch_path = None  # the settled ones are in the same files
        if active.isEmpty():
            break
    best = stored(reduce(DataFrame.unionByName, [*settled, active]), "best")
    middle = quantiles(histogram(distances(rows, best.drop("start")), {"d": "ln(d2 + 1e-6D)"}), ["d"], [0.5], ["g1", "g2"])
    wider = F.greatest(F.lit(1.0), F.exp("d_0") / CHI_MEDIAN)
    return best.drop("start"), stored(middle.select("g1", "g2", wider.alias("wider")), "wider")


def judged(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``documents`` with the counts, base_failed, distance (null if it failed) and kept."""
    passed = [c for c in documents.columns if c.lower() not in {*COUNTS, "base_failed", "distance", "kept", text.lower()}]
    inner = documents.select(F.struct(*(f"`{c}`" for c in passed)).alias("_row") if passed else F.lit(None).alias("_row"), F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").alias("_lang"), F.col(f"`{source}`").alias("_source"))
    rows = counted(inner, "_text").drop("_text").withColumn("base_failed", base_failed())
    rows = stored(grouped(rows.select("*", *shares()), "_lang", "_source"), "counts")  # texts are counted once; all steps read this
    found, wider = fit(rows.where("not base_failed").select("g1", "g2", *SHARES))
    out = distances(rows, found).join(wider, ["g1", "g2"], "left")
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.col("wider"))
    out = out.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CHI_CUT, F.lit(True)))
    return out.select(*([F.col("_row.*")] if passed else []), *COUNTS, "base_failed", "distance", "kept", *SHARES)
