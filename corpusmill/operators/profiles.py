"""Profiles of texts and groups, alignment of pieces to words, and resampling by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cumulative probabilities of 0, 1, .. events of a Poisson variable of mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)

#: Bits in a nat.
LOG2E = 1.4426950408889634

#: Families of model names, by the first pattern that a name matches. Fixed values.
FAMILIES = (("^gpt2|distilgpt", "GPT-2"), ("pythia", "Pythia"), ("olmo", "OLMo"), ("llama", "Llama"), ("modernbert", "ModernBERT"), ("roberta", "RoBERTa"), ("bert", "BERT"))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def conditional_rates(tokens: DataFrame, key: str, high: Column, err: Column, post: Column) -> DataFrame:
    """Per text: share of high tokens, of errors, of errors among high ones and of those after an error, and the high ones' share of errors."""
    n = F.count("*")
    return tokens.groupBy(key).agg(
        n.alias("n"), ratio(F.count_if(high), n).alias("high"), ratio(F.count_if(err), n).alias("err"), ratio(F.count_if(high & err), F.count_if(high)).alias("err_of_high"),
        ratio(F.count_if(high & post), F.count_if(high)).alias("post_of_high"), ratio(F.count_if(high & err), F.count_if(err)).alias("high_of_err"),
    )


def threshold_table(tokens: DataFrame, level: str, high: Column, err: Column) -> DataFrame:
    """Per level: how often a token over the threshold is an error, one under it is, and the reverse."""
    p = lambda a, given: F.avg(F.when(given, a.cast("int")))
    return tokens.groupBy(level).agg(F.count("*").alias("n"), p(err, high).alias("p_err_high"), p(err, ~high).alias("p_err_low"), p(high, err).alias("p_high_err"), p(high, ~err).alias("p_high_ok"))


def standard_error(value: str) -> Column:
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def ordered_mean(value: Column | str, places: int = 6) -> Column:
    """A mean to rank by: values are summed as whole numbers of the last of so many places, so that it doesn't hang on the order of the rows and equal
    groups tie. Groups with values of 1e12 or more, or not finite, have the plain mean.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    fits = F.abs(x) < 1e12
    whole = F.rint(F.when(fits, x) * 10.0**places).cast("long").cast("decimal(20,0)")
    return F.when(F.count_if(~fits) > 0, F.avg(x)).otherwise(F.try_divide(F.sum(whole).cast("double"), F.count(x) * 10.0**places))


def unit_change(rows: DataFrame, mean: str, variance: str) -> DataFrame:
    """Nats to bits: means by a factor, variances by its square."""
    return rows.withColumns({mean: F.col(mean) * LOG2E, variance: F.col(variance) * LOG2E * LOG2E})


def window_rows(df: DataFrame, **wanted) -> DataFrame:
    """Rows of one model and window; it is an error if there are none, which is found as the rows are read."""
    found = df.where(F.expr(" and ".join(f"`{k}` = '{v}'" for k, v in wanted.items())))
    n = found.agg(F.count("*").alias("__n"))
    told = F.lit("no rows for " + ", ".join(f"{k} {v}" for k, v in wanted.items()))
    return found.crossJoin(F.broadcast(n.select(F.assert_true(F.col("__n") > 0, told).alias("__ok")))).where("__ok is null").drop("__ok")


def model_family(name: Column) -> Column:
    out = None
    for pattern, family in FAMILIES:
        out = F.when(F.lower(name).rlike(pattern), family) if out is None else out.when(F.lower(name).rlike(pattern), family)
    return out.otherwise("other")


def signature_groups(df: DataFrame, key: str, signature: str) -> DataFrame:
    """Keys of one signature share the least key's name."""
    return df.withColumn("group", F.min(key).over(Window.partitionBy(signature)))


def relabel_policies(df: DataFrame, key: list[str], names: dict[str, str]) -> DataFrame:
    """A row a policy from a column a policy, under the policies' common names."""
    pairs = ", ".join(f"'{label}', `{column}`" for column, label in names.items())
    return df.select(*key, F.expr(f"stack({len(names)}, {pairs}) as (policy, value)"))


def place_in_topk(ids: Column, wanted: Column) -> Column:
    """Place from 0 of an id in a list of the best; -1 if it is not there."""
    return (F.array_position(ids, wanted) - 1).cast("int")


def topk_mass(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def delta_vectors(best: DataFrame, key: str, observed: str, vectors: DataFrame) -> DataFrame:
    """``key, delta``: the mean vector of the predicted ids, by their probabilities made to sum to one, less the observed id's vector.

    ``best`` holds arrays ``ids`` and ``p`` of at most k entries, ``vectors`` an ``id`` and a ``vector``; ids without a vector, and a null or
    missing observed id, count as zero vectors. A group holds at most k + 1 vectors.
    """
    mass = topk_mass(F.col("p"))
    term = lambda i, p: F.struct(i.cast("long").alias("id"), p.alias("p"))
    terms = F.concat(F.transform(F.arrays_zip("ids", "p"), lambda x: term(x["ids"], F.try_divide(x["p"], mass))), F.array(term(F.col(observed), F.lit(-1.0))))
    long = best.select(key, F.inline(terms)).where("id is not null")
    sides = long.join(vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("v")), "id")
    held = sides.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "p", "v"))).alias("t"))
    zero = F.transform(F.col("t")[0]["v"], lambda x: F.lit(0.0))
    delta = F.aggregate("t", zero, lambda a, x: F.zip_with(a, x["v"], lambda m, n: m + x["p"] * n))
    return held.select(key, delta.alias("delta"))


def component_summary(rows: DataFrame, component: str, key: str, weight: str, value: str, band: str, word: str, bands: list[str], top: int) -> DataFrame:
    """Per component: share of all weight, rows with weight, weighted mean of the value, each band's share of the weight and that less its share of
    the rows, and over the ``top`` rows of most weight (ties by key) the most frequent word, its share and how many words cover half of them.

    A weight that is null counts as 0; a component without weight has null shares.
    """
    x = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    r = rows.select(component, key, x.alias("__w"), F.col(value).alias("__v"), F.col(band).alias("__b"), F.col(word).alias("__t"))
    of = lambda b: F.sum(F.when(F.col("__b") == b, F.col("__w")).otherwise(0.0))
    n = lambda b: F.count_if(F.col("__b") == b)
    sums = r.groupBy(component).agg(
        F.sum("__w").alias("__s"), F.count_if(F.col("__w") > 0).alias("n_nonzero"), F.try_divide(F.sum(F.col("__w") * F.col("__v")), F.sum("__w")).alias("mean_value"),
        *[F.try_divide(of(b), F.sum("__w")).alias(f"mix_{b}") for b in bands],
        *[(F.try_divide(of(b), F.sum("__w")) - ratio(n(b), F.count("__b"))).alias(f"mix_{b}_minus_base") for b in bands],
    )
    total = sums.agg(F.sum("__s").alias("__all"))
    ordered = Window.partitionBy(component).orderBy(F.desc("__w"), key)
    best = r.withColumn("__place", F.row_number().over(ordered)).where(F.col("__place") <= top)
    words = best.groupBy(component, "__t").agg(F.count("*").alias("__n"))
    by_count = Window.partitionBy(component).orderBy(F.desc("__n"), "__t")
    words = words.withColumns({"__at": F.row_number().over(by_count), "__sum": F.sum("__n").over(by_count.rowsBetween(Window.unboundedPreceding, 0)), "__of": F.sum("__n").over(Window.partitionBy(component))})
    heads = words.groupBy(component).agg(
        F.max_by("__t", -F.col("__at")).alias("top_word"), (F.max("__n") / F.max("__of")).alias("top_word_share"), F.min(F.when(F.col("__sum") * 2 >= F.col("__of"), F.col("__at"))).alias("words_to_half")
    )
    out = sums.crossJoin(F.broadcast(total)).withColumn("loading_share", F.try_divide("__s", "__all"))  # the total is one row
    return out.drop("__s", "__all").join(heads, component, "left")


def align_pieces(words: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """Give each piece to the word that holds its first character, and tell whether its last one is another's.

    ``words(key, word_i, start, stop)``, ``pieces(key, piece_i, first, last)`` with inclusive first and last
    characters. Both sides are put in one order of characters within a text, and the word that began
    last is carried on; so a text costs a sort, and no join makes pairs.
    """
    w = words.select(key, F.col("start").alias("at"), F.lit(0).alias("kind"), "word_i", "stop", F.lit(None).cast("long").alias("piece_i"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    kinds = dict(words.dtypes)
    p = pieces.select(key, F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("kind")), F.struct(F.col("last").alias("at"), F.lit(2).alias("kind")))).alias("x"), "piece_i")
    p = p.select(key, "x.at", "x.kind", none("word_i", kinds["word_i"]), none("stop", kinds["stop"]), "piece_i")
    order = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("kind") == 0, F.struct("word_i", "stop")), ignorenulls=True).over(order)
    owner = w.unionByName(p).withColumn("held", held).where("kind > 0").withColumn("owner", F.when(F.col("at") < F.col("held.stop"), F.col("held.word_i")))
    both = owner.groupBy(key, "piece_i").agg(F.max(F.when(F.col("kind") == 1, F.col("owner"))).alias("word_i"), F.max(F.when(F.col("kind") == 2, F.col("owner"))).alias("last_word"))
    return both.select(key, "piece_i", "word_i", (~F.col("word_i").eqNullSafe(F.col("last_word"))).alias("straddles"))


def contiguous(pieces: DataFrame, key: str) -> DataFrame:
    """Words whose pieces stand side by side: ``key, word_i, n_pieces, whole``."""
    runs = pieces.where(F.col("word_i").isNotNull()).groupBy(key, "word_i").agg(F.count("*").alias("n_pieces"), (F.max("piece_i") - F.min("piece_i") + 1 == F.count("*")).alias("whole"))
    return runs


def net_gain(candidates: DataFrame, key: list[str], gain: str, distance: str, label: str, price: float = 1.0) -> DataFrame:
    """The candidate of the best gain less its distance; NONE if that is not above 0."""
    net = F.col(gain) - price * F.col(distance)
    best = F.max(F.struct(net.alias("net"), F.col(label).alias("label"))).alias("b")
    return candidates.groupBy(*key).agg(best).select(*key, F.col("b.net").alias("net"), F.when(F.col("b.net") > 0, F.col("b.label")).otherwise("NONE").alias("label"))


def gain_matrix(candidates: DataFrame, key: str, kind: str, gain: str, kinds: list[str], most: float = 40.0) -> DataFrame:
    """Best gain of each kind, 0 where there is none or it is below, at most ``most``; a column a kind."""
    wide = candidates.groupBy(key).pivot(kind, kinds).agg(F.max(gain))
    return wide.select(key, *[F.least(F.greatest(F.coalesce(F.col(f"`{k}`"), F.lit(0.0)), F.lit(0.0)), F.lit(most)).alias(k) for k in kinds])


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts; the same in every engine."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / float(1 << 32)


def poisson_weight(u: Column) -> Column:
    """How often a row is drawn in a bootstrap sample, from a uniform number."""
    out = F.lit(0)
    for p in POISSON:
        out = out + (u >= p).cast("int")
    return out


def bootstrap(df: DataFrame, key: str, strata: list[str], draws: int, statistics: dict[str, Column], seed: str) -> DataFrame:
    """Statistics of each of ``draws`` resamples of the rows, by strata: weights are Poisson by a hash of row and draw.

    ``statistics`` are aggregates over a column ``w``, the weight. Rows meet every draw, and are summed in each
    task before the shuffle, so one row a task, stratum and draw crosses.
    """
    many = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    weighed = many.withColumn("w", poisson_weight(hash_unit(F.col(key), F.col("draw"), F.lit(seed))))
    return weighed.groupBy(*strata, "draw").agg(*[c.alias(k) for k, c in statistics.items()])


def percentile_interval(df: DataFrame, value: str, *group: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return df.groupBy(*group).agg(F.percentile(value, tail).alias("low"), F.percentile(value, 1 - tail).alias("high"))


def weighted_correlation(x: str, y: str, w: str = "w") -> Column:
    """Pearson correlation with integer weights, from sums alone."""
    s = lambda e: F.sum(F.col(w) * e)
    n, sx, sy = F.sum(w), s(F.col(x)), s(F.col(y))
    cov = n * s(F.col(x) * F.col(y)) - sx * sy
    return F.try_divide(cov, F.sqrt((n * s(F.col(x) * F.col(x)) - sx * sx) * (n * s(F.col(y) * F.col(y)) - sy * sy)))


def permutation_test(df: DataFrame, key: str, group: str, value: str, draws: int, seed: str) -> DataFrame:
    """Difference of two groups' means, and how often one of relabelled rows is as great: ``(hits + 1) / (draws + 1)``.

    ``group`` is boolean. In a draw, the rows of the least hashes, as many as the first group has, are the
    first group: a rank within the draw, so draws are spread over tasks.
    """
    sizes = df.agg(F.count_if(group).alias("size"), (F.avg(F.when(F.col(group), F.col(value))) - F.avg(F.when(~F.col(group), F.col(value)))).alias("difference"))
    many = df.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    order = Window.partitionBy("draw").orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("draw").cast("string"), F.lit(seed))), key)
    ranked = many.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(sizes))
    first = F.col("place") <= F.col("size")
    each = ranked.groupBy("draw").agg((F.avg(F.when(first, F.col(value))) - F.avg(F.when(~first, F.col(value)))).alias("d"), F.first("difference").alias("difference"))
    return each.agg(F.first("difference").alias("difference"), ((F.count_if(F.abs("d") >= F.abs("difference") - 1e-12) + 1) / F.lit(draws + 1)).alias("p"))
