"""Quality rules: fixed base rules, then robust multivariate outliers, with DataFrame functions only.

Per language and source the centre and the scatter of transformed statistics are estimated by the minimum covariance
determinant: of all subsets with the share ``CORE`` of the documents, the one whose covariance has the least
determinant. It is approached by concentration steps from several starts (after Rousseeuw and Van Driessen): estimate
from the current subset, compute all distances, take the closest documents as the next subset; no step raises the
determinant. One start is the coordinatewise medians, the others are five documents drawn by a hash. After
``FIRST_STEPS`` steps the start with the least determinant goes on. The result is reweighted: mean and covariance of all
documents within the chi-square quantile of ``REWEIGHT_TAIL``. Documents whose squared Mahalanobis distance from these
exceeds the quantile of ``TAIL`` are rejected.

The same is estimated for whole languages and for all documents, and each estimate is shrunk towards that of the wider
group: its centre and covariance weigh as much as the documents beyond the first ``PRIOR``, those of the wider group as
much as ``PRIOR`` documents. So every document is judged by the same rule whatever the size of its source, and one of a
source too small for an estimate of its own is judged by its language.

Each step is one aggregation of counts and sums by bins of distance, combined before the shuffle, so that a source with a
third of all rows costs no more than the others. Quantiles are taken from these counts: exact in the bins, the same in
any order of rows. Texts are read once; the steps read a small written table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.shared import written

WORD_BREAK = r"[\x20\x09-\x0D]+"
NOT_BREAK = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

CORE = 0.75
RANDOM_STARTS = 2
FIRST_STEPS = 2
LAST_STEPS = 2
REWEIGHT_TAIL = 0.025
TAIL = 1e-3
#: The weight of the wider group in an estimate, in documents: two more than twice the axes.
PRIOR = 10
BINS = 64
SENT_ESTIMATES = 20_000
#: Transformed statistics (for texts that pass the base rules) and how far from the centre of its group a document may
#: lie on each alone, whatever the group: a quarter in word length, two symbols in a hundred characters, eight repeated
#: lines, a quarter of the words in repeated windows. The square of that, as a share of the quantile of TAIL, is added to
#: the variance, so that a statistic that is constant in a group does not turn trifles into outliers.
VECTOR = {
    "x0": ("ln(cast(word_chars as double) / n_words)", math.log(1.25)),
    "x1": ("ln(1 + 100 * cast(n_symbols as double) / word_chars)", math.log(1 + 2)),
    "x2": ("ln(1 + cast(n_dup_lines as double))", math.log(1 + 8)),
    "x3": ("cast(n_repeat_words as double) / n_words", 0.25),
}
AXES = list(VECTOR)
_PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[: i + 1]]  # lower triangle


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more."""

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(F.sort_array(windows), lambda s: _let(F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))), lambda d: _covered(places(windows, d)))))

    def places(windows: Column, repeated: Column) -> Column:
        few = F.filter(F.transform(windows, lambda x, i: F.when(F.array_contains(repeated, x), i)), lambda x: x.isNotNull())
        return F.when(F.size(repeated) <= 24, few).otherwise(_let(F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), many))

    def many(sorted_: Column) -> Column:
        same = lambda e, other: e["h"] == other["h"]
        found = F.transform(sorted_, lambda e, j: F.when(F.coalesce(same(e, F.get(sorted_, j + 1)), F.lit(False)) | F.coalesce(same(e, F.get(sorted_, j - 1)), F.lit(False)), e["i"]))
        return F.sort_array(F.filter(found, lambda x: x.isNotNull()))

    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, counted))


def _covered(places: Column) -> Column:
    """How many positions the windows of three from these ascending places cover together."""
    return _let(places, lambda q: F.aggregate(F.transform(q, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(q, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))


def text_statistics(text: Column) -> Column:
    """A struct of ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, all LONG, of the whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_BREAK))
    of_words = _let(
        F.array_remove(F.split(text, WORD_BREAK, -1), ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    return F.struct(
        of_words.alias("words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def chi_square_quantile(tail: float) -> float:
    """The value that a chi-square variable with four degrees of freedom (one for each axis) exceeds with probability ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if math.exp(-x / 2) * (1 + x / 2) > tail else (low, x)
    return low


def ridge(axis: str) -> float:
    return VECTOR[axis][1] ** 2 / chi_square_quantile(TAIL)


def reweighting_factor() -> float:
    """By how much the covariance of a normal sample cut at the quantile of REWEIGHT_TAIL is too small, for four axes."""
    x = chi_square_quantile(REWEIGHT_TAIL)
    return (1 - REWEIGHT_TAIL) / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


def precision_steps(factor: float = 1.0) -> list[tuple[str, str]]:
    """Names and SQL expressions, each using earlier ones, from covariances (c_) to the inverse of the scatter (p_) and its determinant."""
    n, steps = len(AXES), []
    for a, b in _PAIRS:
        extra = f" + {ridge(a)!r}" if a == b else ""
        steps.append((f"v_{a}_{b}", f"{factor!r} * c_{a}_{b}{extra}"))
    for i, a in enumerate(AXES):  # Cholesky factor
        for j, b in enumerate(AXES[: i + 1]):
            rest = "".join(f" - l_{a}_{AXES[k]} * l_{b}_{AXES[k]}" for k in range(j))
            steps.append((f"l_{a}_{b}", f"sqrt(v_{a}_{b}{rest})" if i == j else f"(v_{a}_{b}{rest}) / l_{b}_{b}"))
    for i, a in enumerate(AXES):  # its inverse
        for j, b in enumerate(AXES[: i + 1]):
            inner = " + ".join(f"l_{a}_{AXES[k]} * k_{AXES[k]}_{b}" for k in range(j, i))
            steps.append((f"k_{a}_{b}", f"1.0 / l_{a}_{a}" if i == j else f"-({inner}) / l_{a}_{a}"))
    for i, a in enumerate(AXES):
        for j, b in enumerate(AXES[: i + 1]):
            steps.append((f"p_{a}_{b}", " + ".join(f"k_{AXES[k]}_{a} * k_{AXES[k]}_{b}" for k in range(i, n))))
    return [*steps, ("det", " * ".join(f"l_{a}_{a}" for a in AXES))]


def distance_sql() -> str:
    """The squared Mahalanobis distance of x from m under p."""
    return " + ".join(f"{'' if a == b else '2 * '}p_{a}_{b} * ({a} - m_{a}) * ({b} - m_{b})" for a, b in _PAIRS)


BIN_SQL = f"cast(floor({BINS} * ln(1 + greatest(d2, 0))) as bigint)"
CENTRE_BIN_SQL = f"cast(floor({BINS} * {{x}}) as bigint)"
_KEY = ["lang_key", "source_key"]
_RUN = [*_KEY, "start"]
_M, _P = [f"m_{a}" for a in AXES], [f"p_{a}_{b}" for a, b in _PAIRS]
_SUMS = {f"t_{a}": a for a in AXES} | {f"t_{a}_{b}": f"{a} * {b}" for a, b in _PAIRS}
_MOMENTS = {f"m_{a}": f"t_{a} / n" for a in AXES} | {f"c_{a}_{b}": f"t_{a}_{b} / n - t_{a} / n * t_{b} / n" for a, b in _PAIRS}
_HASHED = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"


def _upto(share: float, keys: list[str]) -> str:
    """Whether a bin is among the first that hold the given share of ``n``."""
    return f"sum(n) over (partition by {', '.join(keys)} order by bin) - n < {share!r} * sum(n) over (partition by {', '.join(keys)})"


def _moments(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Means and covariances from sums."""
    total = groups.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(t).alias(t) for t in _SUMS))
    return total.select(*keys, "n", *(F.expr(sql).alias(c) for c, sql in _MOMENTS.items()))


def _inverted(moments: DataFrame, factor: float = 1.0) -> DataFrame:
    for name, sql in precision_steps(factor):
        moments = moments.withColumn(name, F.expr(sql))
    return moments


def _starts(fit: DataFrame) -> DataFrame:
    """First estimates of each group: its medians with the tolerated spreads, and those of a few documents drawn by hash."""
    coordinates = fit.select(*_KEY, F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.expr(CENTRE_BIN_SQL.format(x=a)).alias("bin")) for a in AXES))).alias("c")).groupBy(*_KEY, "c.axis", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    keys = [*_KEY, "axis"]
    medians = coordinates.withColumn("in", F.expr(_upto(0.5, keys))).where("in").groupBy(*keys).agg(F.max("bin").alias("bin"))
    middle = medians.groupBy(*_KEY).agg(*(F.max(F.when(F.col("axis") == a, (F.col("bin") + 0.5) / BINS)).alias(f"m_{a}") for a in AXES))
    middle = middle.select(*_KEY, F.lit(0).alias("start"), *_M, *(F.lit(1 / ridge(a) if a == b else 0.0).alias(f"p_{a}_{b}") for a, b in _PAIRS))
    drawn = fit.select(*_KEY, *AXES, F.explode(F.array(*(F.struct(F.lit(k).alias("start"), F.md5(F.concat_ws(",", F.lit(str(k)), *_HASHED.split(", "))).alias("h")) for k in range(1, RANDOM_STARTS + 1)))).alias("d"))
    drawn = drawn.groupBy(*_KEY, "d.start", F.expr(_CLASS_SQL.format(h="d.h")).alias("class")).agg(F.min_by(F.struct(*AXES), "d.h").alias("x"))
    drawn = drawn.select(*_RUN, F.lit(1).alias("n"), "x.*").select(*_RUN, "n", *(F.expr(sql).alias(t) for t, sql in _SUMS.items()))
    return middle.unionByName(_inverted(_moments(drawn, _RUN)).select(*_RUN, *_M, *_P))


_CLASS_SQL = "instr('0123456789abcdef', substr({h}, 1, 1)) % 5"


def _concentrated(fit: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates from the documents closest under the present ones."""
    bins = _distances(fit, estimates).groupBy(*_RUN, F.expr(BIN_SQL).alias("bin")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(sql)).alias(t) for t, sql in _SUMS.items()))
    core = bins.withColumn("in", F.expr(_upto(CORE, _RUN))).where("in")
    return written(_inverted(_moments(core, _RUN)).select(*_RUN, *_M, *_P, "det"), "estimates")


def _distances(fit: DataFrame, estimates: DataFrame) -> DataFrame:
    return with_estimates(fit, estimates).withColumn("d2", F.expr(distance_sql()))


def with_estimates(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the estimates of their group. Rows of one group never meet in one task, however many they are.

    Estimates of up to ``SENT_ESTIMATES`` rows, a few megabytes, are sent to every task; more are joined on the group and a
    salt, with each estimate repeated for all salts.
    """
    if estimates.count() <= SENT_ESTIMATES:
        return rows.join(F.broadcast(estimates), _KEY, how)
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*_KEY, "_salt"], how).drop("_salt")


def robust_estimates(fit: DataFrame) -> DataFrame:
    """Estimates ``m_*, p_*`` for each ``lang_key, source_key`` of ``fit`` with the columns of VECTOR and the counts; those of
    whole languages and of all rows (``*``) among them."""
    wider = F.array(*(F.struct(lang.alias("lang_key"), source.alias("source_key")) for lang, source in ((F.col("lang_key"), F.col("source_key")), (F.col("lang_key"), F.lit("*")), (F.lit("*"), F.lit("*")))))
    fit = fit.withColumn("of", F.explode(wider)).drop(*_KEY).select("*", "of.*").drop("of")
    now = written(_starts(fit), "starts")
    for _ in range(FIRST_STEPS):
        now = _concentrated(fit, now)
    now = written(now.groupBy(*_KEY).agg(F.min_by(F.struct("start", *_M, *_P), F.struct("det", "start")).alias("best")).select(*_KEY, "best.*"), "best")
    for _ in range(LAST_STEPS):
        now = _concentrated(fit, now)
    # the core's own spread is too small for a whole sample: where its edge lies beyond that of a normal sample, distances are shrunk
    bins = _distances(fit, now).groupBy(*_RUN, F.expr(BIN_SQL).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = bins.withColumn("in", F.expr(_upto(CORE, _RUN))).where("in").groupBy(*_KEY).agg(F.expr(_SHRINK_SQL).alias("shrink"))
    now = written(now.join(edges, _KEY), "edges")
    within = _distances(fit, now).where(F.expr(f"d2 * shrink <= {chi_square_quantile(REWEIGHT_TAIL)!r}"))
    own = written(_moments(within.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.expr(sql)).alias(t) for t, sql in _SUMS.items())), _KEY), "moments")
    named = lambda df, key: df.select(*key, *(F.col(c).alias(f"w_{c}") for c in _MOMENTS))
    shrunk = lambda df: df.select(*_KEY, *(F.expr(_SHRUNK_SQL.format(own=c, wider=f"w_{c}", n="n")).alias(c) for c in _MOMENTS))
    everything = own.where("lang_key = '*'")
    # one row
    languages = shrunk(own.where("lang_key <> '*' and source_key = '*'").crossJoin(F.broadcast(named(everything, []))))
    sources = shrunk(own.where("source_key <> '*'").join(named(languages, ["lang_key"]), "lang_key"))
    return written(_inverted(sources, reweighting_factor()).select(*_KEY, *_M, *_P), "estimates")


_SHRUNK_SQL = f"(greatest({{n}} - {PRIOR}, 0) * {{own}} + {PRIOR} * {{wider}}) / greatest({{n}}, {PRIOR})"
_SHRINK_SQL = f"least(1.0, {{q}} / (exp((max(bin) + 1) / {float(BINS)}) - 1))".format(q=repr(chi_square_quantile(1 - CORE)))

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, source)`` with their statistics and the verdict.

    Returns the columns ``carry`` (doc_id alone by default) and ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words`` (LONG), ``base_failed`` and ``kept`` (BOOLEAN). A text fails the base rules with fewer than 50 words
    or more than half of its words in repeated three-word windows. Among the others an outlier of its language and source
    is not kept. Null texts count as empty and fail; a null language or source is a value of its own. Repeated rows count
    as often as they occur; documents of equal language, source and statistics share a verdict; further columns are
    ignored, or carried unless they have the name of a result; no rows give no rows.
    """
    carry = [c for c in carry or ["doc_id"] if c not in (*STATISTICS, "base_failed", "kept")]
    return _judged(docs, carry).select("row.*", *STATISTICS, "base_failed", "kept")


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with the same columns."""
    return _judged(docs, docs.columns).where("kept").select("row.*")


def _judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    named = lambda c: F.when(F.col(c).isNull(), F.lit("?")).otherwise(F.concat(F.lit("="), F.col(c)))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), named("lang").alias("lang_key"), named("source").alias("source_key"), text_statistics(F.col("text")).alias("s"))
    rows = written(rows, "statistics").select("row", *_KEY, "s.words.n_words", "s.words.word_chars", "s.n_symbols", "s.n_dup_lines", "s.words.n_repeat_words")
    rows = rows.withColumn("base_failed", F.expr(_BASE_SQL))
    vector = [F.when(~F.col("base_failed"), F.expr(f"case when n_words > 0 then {sql} end")).alias(a) for a, (sql, _) in VECTOR.items()]
    estimates = robust_estimates(rows.where("not base_failed").select(*_KEY, *STATISTICS, *vector))
    judged = with_estimates(rows.select("*", *vector), estimates, "left")
    return judged.withColumn("kept", F.expr(_KEPT_SQL))


_BASE_SQL = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
_KEPT_SQL = f"not base_failed and not coalesce({distance_sql()} > {chi_square_quantile(TAIL)!r}, false)"


def oracle_sql() -> str:
    """The query in DuckDB's SQL, with plain strings for windows instead of hashes."""
    keys, run = ", ".join(_KEY), ", ".join(_RUN)
    m, p = ", ".join(_M), ", ".join(_P)
    sums = ", ".join(f"sum({sql}) as {t}" for t, sql in _SUMS.items())
    x = ", ".join(f"case when not base_failed and n_words > 0 then {sql} end as {a}" for a, (sql, _) in VECTOR.items())

    def inverted(source: str, factor: float = 1.0) -> str:
        for name, sql in precision_steps(factor):
            source = f"select *, {sql} as {name} from ({source})"
        return source

    def averaged(source: str, by: str) -> str:
        return f"select {by}, n, " + ", ".join(f"{sql} as {c}" for c, sql in _MOMENTS.items()) + f" from (select {by}, sum(n) as n, " + ", ".join(f"sum({t}) as {t}" for t in _SUMS) + f" from ({source}) group by {by})"

    def among_first(source: str, share: float, by: list[str]) -> str:
        return f"select * from (select *, {_upto(share, by)} as among from ({source})) where among"

    ctes = [
        f"d as (select row_number() over () as rid, doc_id, case when lang is null then '?' else '=' || lang end as lang_key, case when source is null then '?' else '=' || source end as source_key, coalesce(text, '') as text from documents)",
        rf"w as (select *, list_filter(regexp_split_to_array(text, '{WORD_BREAK}'), lambda x: x <> '') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NOT_BREAK}')) as lines from d)",
        "g as (select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g from (select rid, words, unnest(range(1, len(words) - 1)) as i from w))",
        "r as (select rid, count(distinct i + k) as n from (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from g) where c > 1), (select unnest([0, 1, 2]) as k) group by rid)",
        f"s as (select rid, doc_id, {keys}, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars, cast(len(regexp_extract_all(text, '{SYMBOLS}')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words from w left join r using (rid))",
        f"b as (select *, {_BASE_SQL} as base_failed from s)",
        f"v as (select *, {x} from b)",
        f"f0 as (select {keys}, {_HASHED}, {', '.join(AXES)} from v where not base_failed)",
        f"f as (select * from f0 union all select * replace ('*' as source_key) from f0 union all select * replace ('*' as source_key, '*' as lang_key) from f0)",
        "c0 as (" + " union all ".join(f"select {keys}, '{a}' as axis, {CENTRE_BIN_SQL.format(x=a)} as bin, count(*) as n from f group by all" for a in AXES) + ")",
        f"c1 as (select {keys}, axis, max(bin) as bin from ({among_first('select * from c0', 0.5, [*_KEY, 'axis'])}) group by {keys}, axis)",
        f"h as (select *, md5(concat_ws(',', start, {_HASHED})) as h from f, (select unnest(range(1, {RANDOM_STARTS} + 1)) as start))",
        f"u as (select {run}, unnest(x) from (select {run}, arg_min({{{', '.join(f'{a!r}: {a}' for a in AXES)}}}, h) as x from h group by {run}, {_CLASS_SQL.format(h='h')}))",
        f"e0 as (select {keys}, 0 as start, " + ", ".join(f"max(case when axis = '{a}' then (bin + 0.5) / {BINS} end) as m_{a}" for a in AXES) + ", " + ", ".join(f"{1 / ridge(a) if a == b else 0.0!r}::double as p_{a}_{b}" for a, b in _PAIRS) + f" from c1 group by {keys} union all select {run}, {m}, {p} from ({inverted(averaged(f'select {run}, count(*) as n, {sums} from u group by {run}', run))}))",
    ]

    def distances(at: str) -> str:
        return f"select *, {distance_sql()} as d2 from f join {at} using ({keys})"

    last = "e0"
    for t in range(1, FIRST_STEPS + LAST_STEPS + 1):
        bins = f"select {run}, {BIN_SQL} as bin, count(*) as n, {sums} from ({distances(last)}) group by {run}, bin"
        ctes.append(f"e{t} as (select {run}, {m}, {p}, det from ({inverted(averaged(among_first(bins, CORE, _RUN), run))}))")
        last = f"e{t}"
        if t == FIRST_STEPS:
            ctes.append(f"best as (select {run}, {m}, {p} from (select *, row_number() over (partition by {keys} order by det, start) as k from {last}) where k = 1)")
            last = "best"
    bins = f"select {run}, {BIN_SQL} as bin, count(*) as n from ({distances(last)}) group by {run}, bin"
    ctes += [
        f"edges as (select {keys}, {_SHRINK_SQL} as shrink from ({among_first(bins, CORE, _RUN)}) group by {keys})",
        f"own as ({averaged(f'select {keys}, count(*) as n, {sums} from ({distances(last)}) join edges using ({keys}) where d2 * shrink <= {chi_square_quantile(REWEIGHT_TAIL)!r} group by {keys}', keys)})",
    ]
    shrunk = ", ".join(_SHRUNK_SQL.format(own=f"o.{c}", wider=f"w.{c}", n="o.n") + f" as {c}" for c in _MOMENTS)
    ctes += [
        f"langs as (select o.lang_key, o.source_key, o.n, {shrunk} from own o, own w where o.source_key = '*' and o.lang_key <> '*' and w.lang_key = '*')",
        f"sources as (select o.lang_key, o.source_key, o.n, {shrunk} from own o join langs w on w.lang_key = o.lang_key where o.source_key <> '*')",
        f"e as ({inverted('select * from sources', reweighting_factor())})",
    ]
    ctes = [c.replace(" as (", " as materialized (", 1) for c in ctes]
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {_KEPT_SQL} as kept from v left join (select {keys}, {m}, {p} from e) using ({keys})"
