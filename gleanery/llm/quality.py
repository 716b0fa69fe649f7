"""Quality rules: fixed base rules, and robust multivariate outliers.

Counts of each text are turned into a vector of ``N_DIMS`` statistics. For
every language and source a minimum covariance determinant (MCD) estimate of
centre and scatter is found by concentration steps over all rows: take the
share ``SUPPORT`` of rows nearest to the present estimate, estimate anew,
repeat, ``STEPS`` times. Two deterministic starts run side by side (about the
medians, with the median deviations as scatter, and with the floors as scatter);
the one that ends with the smaller determinant counts. Rows whose Mahalanobis
distance is over the cutoff fail.

Quantiles come from histograms of fixed bins, which merge exactly, so the
result does not depend on how rows are dealt out. Groups under ``MIN_ROWS``
use their language's estimate, and languages under it that of all rows.
Estimates are broadcast where there are ``MANY`` groups at most; with more, rows
meet theirs by a join that leaves the rows of large groups where they are.

DataFrame operations only.

Edge cases: null or empty text has no words and fails the base rules; null
language or source is a value of its own; an empty table gives an empty
result; groups without spread keep their rows, as scatter has a floor in each
direction; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm._shared import SPACE_CHARS, cut, cut_with, drop, join_hot, row_keys, scratch, without, words

WINDOW_WORDS, SYMBOLS = 8, "#*$%&|<>"
SUPPORT, STEPS, MIN_ROWS, MANY = 0.75, 5, 50, 10_000
#: Least standard deviation of each statistic, and the squared distance beyond
#: which a row fails (for 5 normal statistics one row in some 10**12 does). Eight
#: floors are less than each statistic can be off: x2 is under 0.548 after the
#: base rules, x3 under 1, and x4 near 0.58 in 20 words of capitals.
FLOORS, CUTOFF = (0.08, 0.10, 0.05, 0.09, 0.045), 64.0
N_DIMS = len(FLOORS)
#: The median of a chi-square variable with N_DIMS degrees of freedom.
CHI2_MEDIAN = 4.351
X = [f"x{i}" for i in range(N_DIMS)]


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words.

    Arrays are shifted against themselves rather than indexed, and each step
    uses the one before twice, which keeps the optimizer from inlining it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({"__w": words(text), "__lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE_CHARS))) > 0)})
    out = out.withColumns({"__n": F.size("__w"), "__all": F.array_join("__w", ""), "__h": F.transform("__w", lambda x: F.xxhash64(x)), "n_lines": F.size("__lines").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")}).drop("__w", "__lines")
    chars = F.length("__all").cast("long")
    out = out.withColumns(
        {
            "n_words": F.col("__n").cast("long"), "word_chars": chars, "n_symbols": chars - F.length(F.translate("__all", SYMBOLS, "")),
            "n_upper": chars - F.length(F.regexp_replace("__all", "[A-Z]+", "")),
        }
    ).drop("__all")
    for step in (1, 2, 4):  # hashes of 2, 4, then 8 words
        out = out.withColumn("__h", F.zip_with("__h", F.slice("__h", F.lit(step + 1), F.greatest(F.size("__h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("__h", F.slice("__h", F.lit(1), F.greatest(F.col("__n") - (WINDOW_WORDS - 1), F.lit(0))))
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.withColumn("__s", F.when(again, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__h")
    out = out.withColumn("__same", F.zip_with("__s", F.slice("__s", F.lit(2), F.size("__s")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    either = F.zip_with("__same", F.concat(F.array(F.lit(False)), "__same"), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    starts = F.filter(F.zip_with("__s", either, lambda s, e: F.when(e, s["i"])), lambda i: i.isNotNull())
    out = out.withColumn("__starts", F.sort_array(starts)).drop("__s", "__same", "__n")
    covered = F.zip_with("__starts", F.slice("__starts", F.lit(2), F.greatest(F.size("__starts"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS)).cast("long"))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))).drop("__starts")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """The vector, from ``counts``; constants added to counts steady short texts."""
    return {
        "x0": F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50)),
        "x1": F.log1p(100 * F.col("n_symbols") / (F.col("word_chars") + 200)),
        "x2": F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 50)),
        "x3": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
        "x4": F.sqrt(F.col("n_upper") / (F.col("word_chars") + 200)),
    }


def _quantile(rows: DataFrame, by: list[str], bin_: Column, share: float) -> DataFrame:
    """by, bin: the first bin at which ``share`` of a group's rows are reached."""
    hist = rows.groupBy(*by, bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by)
    hist = hist.withColumns({"cum": F.sum("c").over(w.orderBy("bin")), "all": F.sum("c").over(w)})
    return hist.where(F.col("cum") >= F.col("all") * share).groupBy(*by).agg(F.min("bin").alias("bin"))


def _distance2() -> Column:
    """Squared Mahalanobis distance, from x, m (centre) and l (Cholesky factor, by rows)."""
    z: list[Column] = []
    for i in range(N_DIMS):
        v = F.col(X[i]) - F.col("m")[i]
        for j in range(i):
            v = v - F.col("l")[_at(i, j)] * z[j]
        z.append(v / F.col("l")[_at(i, i)])
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


def _at(i: int, j: int) -> int:
    return i * (i + 1) // 2 + j


def _cholesky(frame: DataFrame, s: str = "s") -> DataFrame:
    """Replaces column s (lower triangle of a scatter matrix, by rows) with l, its factor."""
    done: list[str] = []
    for i in range(N_DIMS):
        for j in range(i + 1):
            v = F.col(s)[_at(i, j)]
            for k in range(j):
                v = v - F.col(f"__l{_at(i, k)}") * F.col(f"__l{_at(j, k)}")
            v = F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2))) if i == j else v / F.col(f"__l{_at(j, j)}")
            frame = frame.withColumn(f"__l{_at(i, j)}", v)
            done.append(f"__l{_at(i, j)}")
    return frame.withColumn("l", F.array(*done)).drop(s, *done)


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    agg = [F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"a{i}") for i, x in enumerate(X)]]
    agg += [F.covar_pop(X[i], X[j]).alias(f"c{_at(i, j)}") for i in range(N_DIMS) for j in range(i + 1)]
    got = rows.groupBy(*by).agg(*agg)
    s = [F.col(f"c{_at(i, j)}") + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(N_DIMS) for j in range(i + 1)]
    return _cholesky(got.select(*by, F.array(*[F.col(f"a{i}") for i in range(N_DIMS)]).alias("m"), F.array(*s).alias("s")))


def _bin(d2: Column) -> Column:
    return F.floor(16 * F.log2(d2 + 1e-9))


def group_names(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """lang, source, n, g: the group whose estimate these n rows use."""
    per = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    wide = F.sum("n").over(Window.partitionBy("lang"))
    return per.select("lang", "source", "n", F.when(F.col("n") >= min_rows, F.concat(F.lit("s|"), "lang", F.lit("|"), "source")).when(wide >= min_rows, F.concat(F.lit("l|"), "lang")).otherwise(F.lit("all")).alias("g"))


def _meet(rows: DataFrame, few: DataFrame, keys: list[str], sizes: DataFrame, groups: int, total: int) -> DataFrame:
    """``rows`` join ``few``, which has some rows for each g, of which there are ``groups`` with ``sizes`` (g, rows)."""
    if groups <= MANY:
        return rows.join(F.broadcast(few), keys)
    return join_hot(rows, few.join(sizes, "g"), keys, total, "rows").drop("rows")


def mcd(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """g, m, l, scale: the estimate of each group in ``rows`` (g and the statistics)."""
    sizes, seen = cut_with(rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows")), "sizes", groups=F.count(F.lit(1)), total=F.coalesce(F.sum("rows"), F.lit(0)))
    meet = lambda own, few, keys: _meet(own, few, keys, sizes, seen["groups"], N_DIMS * seen["total"])
    # start 0: median deviations as scatter about the medians; start 1: the floors
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(x).alias("x")) for i, x in enumerate(X)])).alias("v")).select("g", "v.*")
    mid = cut(_quantile(long, ["g", "d"], F.floor(F.col("x") * 256), 0.5).select("g", "d", ((F.col("bin") + 0.5) / 256).alias("mid")), "middles")
    off = meet(long, mid, ["g", "d"]).withColumn("off", F.abs(F.col("x") - F.col("mid")))
    mad = _quantile(off, ["g", "d"], F.floor(F.col("off") * 256), 0.5).select("g", "d", ((F.col("bin") + 1) / 256 * 1.4826).alias("mad"))
    both = mid.join(mad, ["g", "d"]).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("d", "mid", "mad"))).alias("v"))
    zero = F.lit(0.0)
    now = cut(both, "median")
    m = F.transform("v", lambda v: v["mid"])
    diag = lambda of: F.array(*[of(i) if i == j else zero for i in range(N_DIMS) for j in range(i + 1)])
    floor = F.array(*[F.lit(v) for v in FLOORS])
    now = now.select("g", F.explode(F.array(F.struct(F.lit(0).alias("start"), m.alias("m"), diag(lambda i: F.greatest(F.col("v")[i]["mad"], floor[i])).alias("l")), F.struct(F.lit(1).alias("start"), m.alias("m"), diag(lambda i: floor[i]).alias("l")))).alias("e")).select("g", "e.*")
    for _ in range(steps):
        seen_rows = meet(rows, now, ["g"]).withColumn("bin", _bin(_distance2()))
        near = _quantile(seen_rows, ["g", "start"], F.col("bin"), support).withColumnRenamed("bin", "most")
        seen_rows = meet(seen_rows.select("g", "start", "bin", *X), near, ["g", "start"]).where(F.col("bin") <= F.col("most"))
        old, now = now, cut(_moments(seen_rows, ["g", "start"]), "mcd")
        drop(old)
    size = F.lit(0.0)
    for i in range(N_DIMS):
        size = size + F.log(F.col("l")[_at(i, i)])
    best = now.groupBy("g").agg(F.min(F.struct(size.alias("det"), F.col("start"), "m", "l")).alias("b")).select("g", "b.m", "b.l")
    middle = _quantile(meet(rows, best, ["g"]), ["g"], _bin(_distance2()), 0.5)
    return cut(best.join(middle, "g").select("g", "m", "l", F.greatest(F.pow(F.lit(2.0), (F.col("bin") + 1) / 16.0) / CHI2_MEDIAN, F.lit(1.0)).alias("scale")).join(sizes, "g"), "estimate")


def _vectors(named: DataFrame) -> DataFrame:
    """g and the statistics of the rows that each estimate in use is made from: a source's own, a language's, or all."""
    own = named.where(F.col("g").startswith("s|")).select("g", *X)
    wide = named.where(F.col("g").startswith("l|")).select("lang", "g").distinct()
    every = named.where("g = 'all'").select("g").distinct()
    return own.unionByName(named.drop("g").join(wide, "lang").select("g", *X)).unionByName(named.drop("g").crossJoin(F.broadcast(every)).select("g", *X))  # one row at most


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, min_rows: int = MIN_ROWS) -> DataFrame:
    """Of every row: row keys, doc_id, the counts, base_failed, distance2, kept."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    keys = row_keys(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *[c.alias(k) for k, c in keys.items()], name(lang_col).alias("lang"), name(source_col).alias("source"))
    rows = counts(rows, "__text").drop("__text").withColumns(statistics()).withColumn("base_failed", base_failed())
    rows, seen = cut_with(rows, "counts", total=F.count(F.lit(1)))
    names, found = cut_with(group_names(rows, min_rows), "groups", n=F.count(F.lit(1)))
    named = rows.join(F.broadcast(names), ["lang", "source"]) if found["n"] <= MANY else join_hot(rows, names, ["lang", "source"], seen["total"], "n")
    named = named.drop("n")
    estimates, made = cut_with(mcd(cut(_vectors(named.where(~F.col("base_failed"))), "vectors")), "estimates", groups=F.count(F.lit(1)))
    out = named.join(F.broadcast(estimates.drop("rows")) if made["groups"] <= MANY else estimates.drop("rows"), "g", "left").withColumn("distance2", _distance2() / F.col("scale"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff)).drop(*X, "m", "l", "scale", "g", "lang", "source")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps."""
    with scratch() as keep:
        rejected = keep(cut(judge(docs, id_col, text_col, lang_col, source_col).where(~F.col("kept")).select("__gl_id", "__gl_row"), "rejected"))
    return without(docs, rejected, id_col, text_col)
