"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Per language and source the minimum-covariance-determinant estimate of location and scatter is searched from three starts
(deviations from medians, spatial signs, squashed values). From each start concentration steps take mean and covariance of
the three quarters of rows with the least Mahalanobis distances, until no determinant changes, and the start with the least
determinant wins. Rows far from that estimate are outliers.

Every group, however small, is estimated alike: ``pool`` rows' worth of its language's moments are added to its own, so that
estimates go over smoothly from the language to the group. A language is estimated from its own rows, however few.

A step is one pass: moments are summed by group and step of a fixed grid of distances, before the shuffle, so that a hot source
costs a few hundred rows per task; the grid makes quantiles the same on any partitioning. What rows are joined to, a row per
group and start, is broadcast up to a checked number of groups and beyond it dealt over salts.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import release, written

#: Transformed statistics and the least standard deviation each is given: log words, log mean word length, then roots of
#: the shares of symbols, repeated lines and repeated words. The last two are small against what a share can reach (1, and
#: the root of 0.3 that the base rule leaves), so that each alone can exceed the limit where a group has next to no repeats.
FEATURES = {"f0": 0.30, "f1": 0.06, "f2": 0.05, "f3": 0.10, "f4": 0.06}
_STEPS, _SHARE, _GRID = 20, 0.75, 256  # steps are a bound: a dozen or less reach the fixed point
_STILL = 1e-3  # a change of a determinant's log that counts as none
_GROUPS, _SALTS = 50_000, 32  # groups that are broadcast at most: 30 MB
_SPACE = r"[\\x20\\x09-\\x0D]"


def chi2_quantile(p: float, k: int) -> float:
    """The Wilson-Hilferty approximation."""
    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """id, group keys and the counts of each text. Null texts count as empty, null keys are keys of their own."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit("-")).alias("lang"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-")).alias("source"))
    words = base.select(
        "id",
        "lang",
        "source",
        F.expr(f"filter(split(text, '{_SPACE}+'), w -> w <> '')").alias("words"),
        F.expr("regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.expr(r"filter(split(text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    counted = words.select(
        "id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(words, w -> xxhash64(w))").alias("h"),
    )
    # A hash of each window. Texts where all differ, nearly all, are done; in the others windows are sorted by hash, then
    # place, so that equal ones are neighbours.
    windows = counted.withColumn("w", F.expr("CASE WHEN n_words >= 8 THEN transform(sequence(1, cast(n_words AS int) - 7), i -> xxhash64(slice(h, i, 8))) END")).drop("h")
    sorted_ = windows.withColumn("s", F.expr("CASE WHEN size(array_distinct(w)) < size(w) THEN sort_array(transform(w, (x, i) -> struct(x AS h, i + 1 AS p))) END")).drop("w")
    places = sorted_.withColumn("p", F.expr("sort_array(transform(filter(s, (x, i) -> coalesce(get(s, i - 1).h = x.h, false) OR coalesce(get(s, i + 1).h = x.h, false)), x -> x.p))")).drop("s")
    covered = F.expr("coalesce(aggregate(p, struct(0L AS n, 0 AS upto), (a, x) -> struct(a.n + x + 8 - greatest(a.upto, x) AS n, x + 8 AS upto), a -> a.n), 0L)")
    return places.withColumn("n_repeat_words", covered).drop("p")


def _share(a: str, b: str) -> Column:
    return F.sqrt(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)))


_N = len(FEATURES)
_PAIRS = [(i, j) for i in range(_N) for j in range(i + 1)]


def _quantile(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The least grid step with at least that share of a group's rows at or below it, from (keys, step, n). Grids are bounded,
    so groups are."""
    w = Window.partitionBy(*keys)
    sums = counts.groupBy(*keys, "step").agg(F.sum("n").alias("n"))
    upto = sums.select(*keys, "step", F.sum("n").over(w.orderBy("step")).alias("upto"), F.sum("n").over(w).alias("all"))
    return upto.where(F.col("upto") >= F.col("all") * share).groupBy(*keys).agg(F.min("step").cast("double").alias("step"), F.max("all").alias("n"))


def _pooled_quantile(counts: DataFrame, keys: list[str], share: float, pool: int) -> DataFrame:
    """(lang, grp, keys, step): each group's own quantile, drawn towards its language's as ``pool`` rows would; from (lang, grp,
    keys, step, n)."""
    by_lang = _quantile(counts, ["lang", *keys], share).select("lang", *keys, F.col("step").alias("_l"))
    own = _quantile(counts, ["lang", "grp", *keys], share).join(by_lang, ["lang", *keys])
    return own.select("lang", "grp", *keys, ((F.col("n") * F.col("step") + pool * F.col("_l")) / (F.col("n") + pool)).alias("step"))


def _met(df: DataFrame, g: DataFrame, small: bool) -> DataFrame:
    """Rows with what is known of their group: broadcast, if a check of the number of groups allows it, else dealt by salts."""
    if small:
        return df.join(F.broadcast(g), "grp")
    salted = g.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return df.withColumn("_s", F.pmod(F.xxhash64(*FEATURES), F.lit(_SALTS)).cast("int")).join(salted, ["grp", "_s"]).drop("_s")


def _distance() -> Column:
    """The squared Mahalanobis distance, by forward substitution with the group's Cholesky factor l and centre m."""
    y: list[Column] = []
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def _step(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * 32)


def _sums(x: list[Column]) -> list[Column]:
    return [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in _PAIRS]]


_MOMENTS = ["n", *[f"s{i}" for i in range(_N)], *[f"q{i}{j}" for i, j in _PAIRS]]


def _pooled(moments: DataFrame, pool: int) -> DataFrame:
    """Moments (lang, grp, start, …) of groups, with those of ``pool`` rows of their language added."""
    w = Window.partitionBy("lang", "start")
    whole = moments.withColumn("_n", F.sum("n").over(w))
    return whole.select(*[c for c in moments.columns if c not in _MOMENTS], *[(F.col(c) + F.sum(c).over(w) * pool / F.col("_n")).alias(c) for c in _MOMENTS])


def _factor(g: DataFrame, floors: list[Column]) -> DataFrame:
    """Means m, the Cholesky factor l of the covariance with the least variances added to its diagonal, and ``det``, the log of
    its determinant."""
    g = g.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(_N)})
    for i in range(_N):
        for j in range(i + 1):
            rest = F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (floors[i] if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            g = g.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return g.withColumn("det", sum((2 * F.log(f"l{i}{i}") for i in range(_N)), F.lit(0.0))).drop(*_MOMENTS)


_MODEL = [*[f"m{i}" for i in range(_N)], *[f"l{i}{j}" for i, j in _PAIRS]]


def minimum_determinant(train: DataFrame, pool: int = 30, most_steps: int = _STEPS) -> tuple[DataFrame, bool]:
    """(lang, grp, start, det, m…, l…), the estimate of each group of rows (lang, grp, f0…), and whether groups may be broadcast."""
    small = train.select("grp").distinct().count() <= _GROUPS
    names = [*FEATURES]
    value = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("x")) for i, f in enumerate(names)])).alias("v")

    def wide(t: DataFrame, prefix: str) -> DataFrame:
        return t.groupBy("lang", "grp").agg(*[F.max(F.when(F.col("i") == i, F.col("step"))).alias(f"{prefix}{i}") for i in range(_N)])

    def quantiles(rows: DataFrame, x) -> DataFrame:
        long = rows.select("*", value).select("lang", "grp", F.col("v.i").alias("i"), F.floor(x * _GRID).alias("step"))
        return _pooled_quantile(long.groupBy("lang", "grp", "i", "step").agg(F.count(F.lit(1)).alias("n")), ["i"], 0.5, pool)

    medians = written(wide(quantiles(train, F.col("v.x")), "c").select("lang", "grp", *[((F.col(f"c{i}") + 0.5) / _GRID).alias(f"c{i}") for i in range(_N)]), "quality-medians")
    at = F.element_at(F.array(*[F.col(f"c{i}") for i in range(_N)]), F.col("v.i") + 1)
    spreads = wide(quantiles(_met(train, medians.drop("lang"), small), F.abs(F.col("v.x") - at)), "d")
    floors = [F.lit(v * v) for v in FEATURES.values()]
    spread = [F.greatest((F.col(f"d{i}") + 0.5) / _GRID * 1.4826, F.lit(v)).alias(f"d{i}") for i, v in enumerate(FEATURES.values())]
    centres = written(medians.join(spreads, ["lang", "grp"]).select("lang", "grp", *[f"c{i}" for i in range(_N)], *spread), "quality-centres")
    # Start 0: deviations alone. 1: directions from the centre. 2: values squashed one by one. Shapes are found in units of deviations.
    z = [(F.col(f) - F.col(f"c{i}")) / F.col(f"d{i}") for i, f in enumerate(names)]
    length = F.sqrt(sum((v * v for v in z), F.lit(1e-12)))
    kinds = F.explode(F.array(F.struct(F.lit(1).alias("start"), *[(v / length).alias(f"z{i}") for i, v in enumerate(z)]), F.struct(F.lit(2).alias("start"), *[F.tanh(v).alias(f"z{i}") for i, v in enumerate(z)]))).alias("k")
    shaped = _met(train, centres.drop("lang"), small).select("lang", "grp", kinds).select("lang", "grp", "k.*").groupBy("lang", "grp", "start").agg(*_sums([F.col(f"z{i}") for i in range(_N)]))
    shapes = _factor(_pooled(shaped, pool), [F.lit(0.01)] * _N).join(centres, ["lang", "grp"])
    turned = shapes.select("lang", "grp", "start", *[F.col(f"c{i}").alias(f"m{i}") for i in range(_N)], *[(F.col(f"l{i}{j}") * F.col(f"d{i}")).alias(f"l{i}{j}") for i, j in _PAIRS])
    plain = centres.select("lang", "grp", F.lit(0).alias("start"), *[F.col(f"c{i}").alias(f"m{i}") for i in range(_N)], *[(F.col(f"d{i}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _PAIRS])
    now = written(plain.unionByName(turned).withColumn("det", F.lit(float("inf"))), "quality-step")
    release(medians)
    x = [F.col(f) for f in names]
    w = Window.partitionBy("lang", "grp", "start")
    for turn in range(most_steps):
        keys = ["lang", "grp", "start", F.col("det").alias("was")]
        stepped = _met(train, now.drop("lang", "was"), small).groupBy(*keys, _step(_distance()).alias("step")).agg(*_sums(x))
        ranked = stepped.select("*", (F.sum("n").over(w.orderBy("step")) - F.col("n")).alias("_before"), F.sum("n").over(w).alias("_all"))
        near = ranked.where(F.col("_before") < F.col("_all") * _SHARE).groupBy("lang", "grp", "start", "was").agg(*[F.sum(c).alias(c) for c in _MOMENTS])
        new = written(_factor(_pooled(near, pool), floors), "quality-step")
        release(now)
        now = new
        if turn % 2 and not (now.agg(F.max(F.abs(F.col("det") - F.col("was")))).first()[0] or 0) > _STILL:  # one number
            break
    best = now.groupBy("lang", "grp").agg(F.min_by(F.struct("start", "det", *_MODEL), F.struct(F.round("det", 9), "start")).alias("b"))
    out = written(best.select("lang", "grp", "b.*"), "quality-estimates")
    release(now)
    release(centres)
    return out, small


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = 0.99999, pool: int = 30) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2) for every row of ``docs``.

    ``base_failed``: below 20 words, or over 30 % of the words in 8-word windows that the text repeats. ``kept``: not
    that, and a squared distance within the chi-squared quantile ``cutoff``, scaled so that the median distance of the
    group (drawn towards its language's as ``pool`` rows would) is the expected one. Null texts are empty (and fail), null
    languages and sources are groups of their own, ids may be null or repeat: rows are judged one by one, and rows that fail
    the base rule do not count in estimates. Equal windows are told by 64-bit hashes within one text. Only the columns named
    are read. An empty table gives no rows.
    """
    base = statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = written(
        base.withColumns(
            {
                "base_failed": failed,
                "f0": F.log1p(F.col("n_words").cast("double")),
                "f1": F.log1p(F.coalesce(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double")), F.lit(0.0))),
                "f2": _share("n_symbols", "word_chars"),
                "f3": _share("n_dup_lines", "n_lines"),
                "f4": _share("n_repeat_words", "n_words"),
                "grp": F.concat(F.length("lang").cast("string"), "lang", "source"),
            }
        ).drop("source"),
        "quality",
    )
    train = rows.where("NOT base_failed").select("lang", "grp", *FEATURES)
    model, small = minimum_determinant(train, pool)
    at = _met(train, model.drop("lang"), small).groupBy("lang", "grp", _step(_distance()).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("step") + 0.5) / 32) / chi2_quantile(0.5, _N), F.lit(1.0))
    final = written(model.join(_pooled_quantile(at, [], 0.5, pool).select("grp", scale.alias("scale")), "grp").select("grp", "scale", *_MODEL), "quality-final")
    release(model)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    good = _met(rows.where("NOT base_failed"), final, small).select(F.col("id").alias(id_col), *counts, "base_failed", (_distance() / F.col("scale")).alias("d2"))
    bad = rows.where("base_failed").select(F.col("id").alias(id_col), *counts, "base_failed", F.lit(None).cast("double").alias("d2"))
    kept = F.coalesce(F.col("d2") <= chi2_quantile(cutoff, _N), F.lit(False)).alias("kept")
    return good.unionByName(bad).select(id_col, *counts, "base_failed", kept, "d2")
