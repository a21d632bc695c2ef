"""Secrets: fixed patterns, and a battery of randomness tests on long tokens.

The patterns give the base spans. Besides, every token of at least LEAST characters of an
encoding alphabet is tested for randomness in the encoding it seems to be in (hex, base32,
base64): chi-squared of the alphabet's uniformity, number of runs above and below the
alphabet's middle, and correlation of neighbours. The least of the three p-values, times
three, is the token's p; ordinary text has a p near zero.

How many ordinary tokens pass by chance depends on the length. Tokens of letters only, words run
together in any case, are taken as ordinary: for each length class (powers of the square root of two)
the lowest bar on p is chosen at which their share that passes, applied to all tokens, stays
below RATE of the tokens that pass. That share leans on the share of all classes as if on PRIOR tokens more, and one
ordinary token is always assumed to pass: a class with few ordinary tokens, or none, has no laxer bar for it.

Only DataFrame functions. Positions are code points; they follow from the pieces between
matches, which Spark's split gives. What reaches the driver is one row per length class.

Defined cases: a null text is empty; a match at the start or end of a text counts; tokens of
one repeated letter have no runs and p zero; repeated rows have the same spans; identifiers
are carried as they are, null too; an empty table gives an empty result.
"""

from pyspark.sql import functions as F

from aerolith.session import store

#: Fixed patterns and least lengths, in the order in which spans of one start are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
RATE = 0.05
#: Ordinary tokens that the share of all classes counts for in each class.
PRIOR = 20
BARS = [0.001, 0.003, 0.01, 0.03, 0.1, 0.3]
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _matches(text, pattern, kind, passes=None):
    """Spans of the matches of a pattern that pass, as structs (start, kind, stop)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    good = F.transform(found, lambda m: F.lit(True)) if passes is None else passes
    pieces = F.split(text, pattern, -1)
    items = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("hit"), good.alias("good"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(state, item):
        start = state["at"] + F.length(item["gap"])
        stop = start + F.length(item["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))).cast(SPAN)
        return F.struct(stop.alias("at"), F.when(item["good"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    walked = F.aggregate(items, empty, add, lambda s: s["spans"])
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(SPAN))


def base_spans(text):
    """Spans of the fixed patterns, by start and then kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    assign = _matches(text, ASSIGN, 0, F.transform(values, lambda v: F.length(v) >= 6))
    return F.array_sort(F.concat(assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2)))


# The battery

def _normal_tail(z):
    """P(N > z) for z >= 0, to about 1e-7 (a rational approximation in closed form)."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / F.lit(2.5066282746310002) * series


def _upper(z):
    tail = _normal_tail(F.abs(z))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(r):
    """p from sums over the characters of a token, named as in scored()."""
    k, n = r["k"], r["n"]
    # Uniformity: Wilson and Hilferty's normal form of chi-squared.
    chi = k / n * r["squares"] - n
    v = 2 / (9 * (k - 1))
    uniform = _upper((F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - v)) / F.sqrt(v))
    # Runs above and below the middle.
    high, low = r["high"], n - r["high"]
    mean = 2 * high * low / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = F.when(spread > 0, 2 * _normal_tail(F.abs((r["runs"] - mean) / F.sqrt(spread)))).otherwise(0.0)
    # Correlation of neighbours.
    centre = r["total"] / n
    variance = r["powers"] / n - centre * centre
    serial = F.when(variance > 0, 2 * _normal_tail(F.abs((r["products"] / (n - 1) - centre * centre) / variance * F.sqrt(n)))).otherwise(0.0)
    return F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))


def scored(candidates):
    """candidates (with columns token, start, stop) with p and the length class; one row per token."""
    plain = F.regexp_replace("token", "[=_-]", "")
    rows = candidates.withColumn("plain", plain).where(F.length("plain") >= LEAST)
    hexes, base32 = F.col("plain").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.col("plain").rlike("^[A-Z2-7]+$")
    rows = rows.withColumn("alphabet", F.when(hexes, ALPHABETS["hex"]).when(base32, ALPHABETS["base32"]).otherwise(ALPHABETS["base64"]))
    rows = rows.withColumn("letters", F.split(F.when(hexes, F.lower("plain")).otherwise(F.col("plain")), ""))
    rows = rows.withColumn("letters", F.filter("letters", lambda c: F.length(c) > 0))
    rows = rows.withColumns({
        "k": F.length("alphabet").cast("double"), "n": F.size("letters").cast("double"),
        "codes": F.transform("letters", lambda c: (F.position(c, F.col("alphabet")) - 1).cast("double"))})
    sums = lambda column: F.aggregate(column, F.lit(0.0), lambda s, x: s + x)
    sides = F.transform("codes", lambda c: (c * 2 >= F.col("k")).cast("int"))
    rows = rows.withColumn("sides", sides)
    pairs = F.sequence(F.lit(1), F.size("codes") - 1)
    rows = rows.withColumns({
        "squares": sums(F.transform(F.array_distinct("letters"), lambda c: F.pow(
            F.size(F.filter("letters", lambda d: d == c)).cast("double"), F.lit(2.0)))),
        "high": sums(F.transform("sides", lambda s: s.cast("double"))),
        "runs": 1 + sums(F.transform(pairs, lambda i: (F.element_at("sides", i) != F.element_at("sides", i + 1)).cast("double"))),
        "total": sums(F.col("codes")), "powers": sums(F.transform("codes", lambda c: c * c)),
        "products": sums(F.transform(pairs, lambda i: F.element_at("codes", i) * F.element_at("codes", i + 1)))})
    p = _battery({name: F.col(name) for name in ("k", "n", "squares", "high", "runs", "total", "powers", "products")})
    return rows.withColumns({
        "p": F.coalesce(F.nanvl(p, F.lit(0.0)), F.lit(0.0)), "length_class": F.floor(2 * F.log2("n")).cast("int"),
        "ordinary": F.col("plain").rlike("^[A-Za-z]+$")})


def bars(tested):
    """{length class: bar on p}: the lowest that keeps the expected share of ordinary tokens below RATE."""
    counts = [F.sum((F.col("p") >= bar).cast("long")).alias(f"all{i}") for i, bar in enumerate(BARS)]
    plain = [F.sum((F.col("ordinary") & (F.col("p") >= bar)).cast("long")).alias(f"plain{i}") for i, bar in enumerate(BARS)]
    rows = tested.groupBy("length_class").agg(
        F.count("*").alias("n"), F.sum(F.col("ordinary").cast("long")).alias("m"), *counts, *plain).collect()
    every = sum(row["m"] for row in rows)
    pooled = [(1 + sum(row[f"plain{i}"] for row in rows)) / (1 + every) for i in range(len(BARS))]
    found = {}
    for row in rows:
        for i, bar in enumerate(BARS):
            share = (row[f"plain{i}"] + PRIOR * pooled[i]) / (row["m"] + PRIOR)
            if row[f"all{i}"] and row["n"] * share <= RATE * row[f"all{i}"]:
                found[row["length_class"]] = bar
                break
    return found


def _text_spans(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs, id_col="doc_id", text_col="text"):
    """Rows (id, base, spans): arrays of (start, kind, stop), the base spans and those with the random tokens added.

    A random token that overlaps a base span is that span's and not listed again.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = store(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).select(
        F.monotonically_increasing_id().alias("row"), "id", base_spans(F.col("t")).alias("base"),
        _matches(F.col("t"), TOKEN, 3).alias("tokens"),
        F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("texts")), "secrets")
    some = rows.where(F.size("tokens") > 0).select("row", "base", F.explode(F.arrays_zip("tokens", "texts")).alias("z")).select(
        "row", "base", F.col("z.tokens").alias("span"), F.col("z.texts").alias("token"))
    free = some.where(~F.exists("base", lambda b: (b["start"] < F.col("span.stop")) & (F.col("span.start") < b["stop"])))
    tested = store(scored(free).select("row", "span", "p", "length_class", "ordinary"), "tested")
    chosen = bars(tested)
    if not chosen:
        return rows.select("id", "base", F.col("base").alias("spans"))
    bar = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
    passed = tested.where(F.col("p") >= bar[F.col("length_class")]).groupBy("row").agg(F.collect_list("span").alias("more"))
    return rows.select("row", "id", "base").join(passed, "row", "left").select(
        "id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))


def digest(found):
    """Counts, digest and listing of the spans of scan()."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_text_spans(F.col("base")), 256).alias("base_sha256"), _text_spans(F.col("spans")).alias("spans"))
