"""Mixing to target weights: token weights raked to marginals, then calibrated sampling.

Documents fall into cells, one per combination of dimension values (source, language,
topic). Iterative proportional fitting multiplies the cells' tokens by one factor per
dimension value, in turn, until every marginal has its target share. A document's weight is
the factor of its cell and it is drawn with the probability min(1, c * factor). c is solved over all
cells so that the sample is expected to hold SHARE of the tokens, or more where no cell needs
to be drawn for less. A cell that is whole before its share is reached is drawn whole, and its
documents carry how often they are to be repeated (mix_repeats, 1 for all others): tokens times
repeats have the target shares. So a tiny cell never shrinks the sample of the others.

Only DataFrame functions; the fitting sees cells, never documents. Draws follow from a
hash of the identifier: repeated tasks repeat them.

Defined cases: a null or empty dimension value is the one value ""; a text without words
counts no tokens and gets the weight of its cell; values without a target get weight 0; a
marginal that holds no tokens keeps its factor, so a table without any word is drawn whole; a null identifier is drawn like the text
"null"; rows that repeat an identifier are drawn alike; an empty table gives an empty result.
"""

import warnings

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.session import store

#: Rounds of the fit at least, at most, and of a job; the largest relative error of a marginal that ends it, and that is not reported.
ROUNDS, MOST_ROUNDS, STEP, TOLERANCE, REPORTED = 8, 100, 2, 1e-12, 1e-6
#: Share of the tokens that a sample is expected to hold at least.
SHARE = 0.5
WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[%$#&*!]"


def words(text):
    """Number of words of a whole text; the measure of tokens in native form."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORDS)).cast("long")


def register(text, count):
    """A topic from the whole text where a table has none: noisy, brief, long or plain."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return (F.when(F.regexp_count(text, F.lit(SYMBOLS)) * 2 > count, "noisy")
            .when(count < 100, "brief").when(count >= 1000, "long").otherwise("plain"))


def measure(docs, id_col="doc_id", text_col="text", source_col="source", lang_col="lang"):
    """Dimension values and tokens of each document, with all of its columns."""
    named = docs.withColumns({
        "mix_tokens": words(F.col(text_col)),
        "mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "mix_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
        "mix_id": F.coalesce(F.col(id_col).cast("string"), F.lit("null"))})
    return named.withColumn("mix_topic", register(F.col(text_col), F.col("mix_tokens")))


def _targets(spark, cells, dim, wanted):
    """Target share per value: given as {value: share}, or an exponent that tempers today's shares."""
    if isinstance(wanted, dict):
        shares = spark.createDataFrame([(str(k), float(v)) for k, v in wanted.items()], f"{dim} string, goal double")
    else:
        now = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("m"))
        shares = now.select(dim, F.when(F.col("m") > 0, F.pow("m", F.lit(float(wanted)))).otherwise(0.0).alias("goal"))
    total = shares.agg(F.sum("goal")).first()[0] or 1.0
    return store(shares.select(dim, (F.col("goal") / F.lit(total)).alias("goal")), "goals")


def _scale(cells, share):
    """(largest factor, c): tokens * min(1, c * ratio) add up to `share` of the tokens, to more if 1 / largest does.

    Cells that c would draw more than whole are taken whole and c is solved for the others, until no more are.
    """
    mass = F.col("tokens") * F.col("ratio")
    most, c, rest, total = cells.where("tokens > 0").agg(
        F.max("ratio"), F.lit(0.0), F.sum(mass), F.sum("tokens").cast("double")).first()
    wanted = share * total if total else 0.0
    while most and rest:
        whole = F.col("ratio") * F.lit(c) >= 1
        full, rest = cells.agg(F.sum(F.when(whole, F.col("tokens").cast("double")).otherwise(0.0)),
                               F.sum(F.when(whole, 0.0).otherwise(mass))).first()
        if not rest or wanted <= full or (wanted - full) / rest <= c * (1 + 1e-12):
            break
        c = (wanted - full) / rest
    return most, max(c, 1 / most) if most else None


def _margin(dim):
    return F.sum(F.col("tokens") * F.col("ratio")).over(Window.partitionBy(dim))


def rake(measured, targets, rounds=None, share=SHARE):
    """Stored cells: dimension values, tokens, ratio, probability, repeats.

    targets: dimension column to {value: share} or to an exponent. A round fits every
    dimension once; rounds go on until every marginal is within TOLERANCE, or for `rounds` if that is
    given. Targets that are not met after the last are reported as a warning. After the last the factors are scaled to draw `share` of the tokens, or, if that
    is None, so that the largest draws surely and no other does.

    Goals are joined to the cells once. A round then is one window per dimension over the few cells, and the
    marginals' errors come with the factors of the same job, so plans stay small for any number of rounds.
    """
    spark, dims = measured.sparkSession, list(targets)
    cells = store(measured.groupBy(*dims).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    total = F.lit(cells.agg(F.sum("tokens").cast("double")).first()[0])
    fitted = cells.withColumn("ratio", F.lit(1.0))
    for dim, wanted in targets.items():
        goals = _targets(spark, cells, dim, wanted).withColumnRenamed("goal", f"goal_{dim}")
        fitted = fitted.join(goals, dim, "left").withColumn(f"goal_{dim}", F.coalesce(f"goal_{dim}", F.lit(0.0)))
    fitted = store(fitted, "goals")
    done, off = 0, None
    while done < (rounds or ROUNDS) or (rounds is None and off > TOLERANCE and done < MOST_ROUNDS):
        for _ in range(min(STEP, rounds - done) if rounds else STEP):
            for dim in dims:
                margin = fitted.withColumn("margin", _margin(dim))
                factor = F.when(F.col("margin") > 0, F.col(f"goal_{dim}") * total / F.col("margin")).otherwise(1.0)
                fitted = margin.withColumn("ratio", F.col("ratio") * factor).drop("margin")
            done += 1
        errors = [F.when((_margin(dim) > 0) & (F.col(f"goal_{dim}") > 0), F.abs(_margin(dim) / (F.col(f"goal_{dim}") * total) - 1))
                  for dim in dims[:-1]]
        worst = F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(e, F.lit(0.0)) for e in errors])
        raked = store(fitted.withColumn("off", worst), "raked")
        fitted, off = raked.drop("off"), raked.agg(F.max("off")).first()[0] or 0.0
    if off > REPORTED:
        warnings.warn(f"after {done} rounds a marginal is off its target share by {off:.2g} of it")
    most, scale = _scale(fitted, share or 0.0)
    # Divided by the largest where that is the scale, so that the largest is 1 to the last bit.
    scaled = F.lit(1.0) if not most else F.col("ratio") / F.lit(most) if scale * most <= 1 else F.col("ratio") * F.lit(scale)
    # A cell without tokens has a factor that no token stands for.
    repeats = F.when(F.col("tokens") > 0, F.greatest(F.lit(1.0), scaled)).otherwise(1.0)
    return fitted.select(*dims, "tokens", "ratio", F.least(F.lit(1.0), scaled).alias("probability"), repeats.alias("repeats"))


def uniform(key):
    """A number in [0, 1) from 52 bits of the hash of a text."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def draw(measured, cells, dims):
    """measured with mix_weight, mix_probability, mix_repeats, mix_kept. A hot cell is split by adaptive joins."""
    named = cells.select(*dims, F.col("ratio").alias("mix_weight"), F.col("probability").alias("mix_probability"),
                         F.col("repeats").alias("mix_repeats"))
    drawn = measured.join(named, dims)
    return drawn.withColumn("mix_kept", uniform(F.col("mix_id")) < F.col("mix_probability"))


DIMS = ["mix_source", "mix_lang", "mix_topic"]


def sample(docs, targets, rounds=None, share=SHARE):
    """The drawn rows of docs with their own columns, each once: what a whole cell lacks is in draw()'s mix_repeats."""
    measured = measure(docs.select(F.struct(*docs.columns).alias("whole"), "doc_id", "text", "source", "lang"))
    cells = rake(measured, dict(zip(DIMS, targets)), rounds, share)
    return draw(measured, cells, DIMS).where("mix_kept").select("whole.*")


def oracle(table, targets, share=SHARE, rounds=100):
    """The same fit as SQL, with rounds enough to settle and the scale from its definition; the last table expression is `drawn`.

    The scale c draws `share` of the tokens: of all sets of largest cells taken whole, the one that asks the largest c for the rest decides.
    """
    text, number = "coalesce(text, '')", "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
    goals, picked = [], []
    for dim, power in zip(DIMS, targets):
        goals.append(f"""goal_{dim} AS (SELECT {dim}, g / sum(g) OVER () AS g_{dim} FROM (
  SELECT {dim}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {float(power)}) ELSE 0 END AS g FROM mix_cells GROUP BY 1))""")
    for kind in ("{}", "g_{}"):
        picked.append("CASE step % 3 " + " ".join(f"WHEN {i} THEN {kind.format(d)}" for i, d in enumerate(DIMS)) + " END")
    margin = f"sum(tokens * ratio) OVER (PARTITION BY {picked[0]})"
    names = ", ".join(DIMS)
    return f"""WITH RECURSIVE mix_measured AS MATERIALIZED (SELECT *, coalesce(source, '') AS mix_source, coalesce(lang, '') AS mix_lang,
  CASE WHEN len(regexp_extract_all({text}, '[%$#&*!]')) * 2 > mix_tokens THEN 'noisy' WHEN mix_tokens < 100 THEN 'brief'
       WHEN mix_tokens >= 1000 THEN 'long' ELSE 'plain' END AS mix_topic
  FROM (SELECT *, {number} AS mix_tokens FROM {table})),
mix_cells AS MATERIALIZED (SELECT {names}, sum(mix_tokens)::DOUBLE AS tokens FROM mix_measured GROUP BY ALL),
{", ".join(goals)},
fit AS (
  SELECT 0 AS step, {names}, tokens, g_mix_source, g_mix_lang, g_mix_topic, 1.0::DOUBLE AS ratio, sum(tokens) OVER () AS total
  FROM mix_cells JOIN goal_mix_source USING (mix_source) JOIN goal_mix_lang USING (mix_lang) JOIN goal_mix_topic USING (mix_topic)
  UNION ALL
  SELECT step + 1, {names}, tokens, g_mix_source, g_mix_lang, g_mix_topic,
         ratio * CASE WHEN {margin} > 0 THEN {picked[1]} * total / {margin} ELSE 1 END, total
  FROM fit WHERE step < {3 * rounds}),
mix_ratios AS (SELECT * FROM fit WHERE step = {3 * rounds}),
whole AS (
  SELECT ratio, total, sum(tokens) OVER larger - tokens AS held, sum(tokens * ratio) OVER () - (sum(tokens * ratio) OVER larger - tokens * ratio) AS rest
  FROM mix_ratios WHERE tokens > 0 WINDOW larger AS (ORDER BY ratio DESC, {names})),
scale AS (SELECT greatest(1 / max(ratio), max(({share} * total - held) / rest)) AS c FROM whole WHERE rest > 0),
drawn AS (SELECT m.*, r.ratio AS mix_weight, least(1.0, coalesce(r.ratio * c, 1.0)) AS mix_probability,
  CASE WHEN r.tokens > 0 THEN greatest(1.0, coalesce(r.ratio * c, 1.0)) ELSE 1.0 END AS mix_repeats,
  ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < least(1.0, coalesce(r.ratio * c, 1.0)) AS mix_kept
  FROM mix_measured m JOIN mix_ratios r USING ({names}), scale)"""
