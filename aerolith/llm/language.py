"""Language of web pages by Bayesian fusion of four kinds of evidence.

Text: likelihood of the page's character trigrams in each language, from documents of
known language (all languages, at most FIT_ROWS documents of each; every page is scored on its whole text). Markup: the
language a page declares. Address: the last label of its host. Host: how often each
language is seen on the host, smoothed towards its domain, which is smoothed towards all pages.

What a declaration, a suffix or a host says about the language is counted over all pages by
grouped aggregation, with the language of the text alone standing for the unknown truth; a
page's own count is left out of its host's and domain's prior. Long texts weigh less per
trigram, as their trigrams repeat each other's evidence.

Defined cases: a language is the two or three letters that open a tag ("en-US" is "en"), other values are none; a null page is empty; without text, declaration or address a page has what the
rest says, at last the share of languages over all pages; an address without a host has
the host ""; repeated rows are pages of their own; null identifiers are carried; without a
document of known language the result has null languages; an empty table gives an empty result.
"""

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aerolith.session import store

#: Documents of a language that its trigram table is fitted on, about; a language with fewer gives all.
FIT_ROWS = 20_000
BUCKETS = 1 << 15
#: Trigrams after which a text's evidence no longer grows in proportion.
ENOUGH = 200
#: Pseudo-counts: of a declaration that agrees, of any other value, of a parent level of the host prior.
AGREES, OTHER, PARENT = 5.0, 0.5, 4.0

_TAGS = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})\b|<meta\b[^>]*?content-language[^>]*?content\s*=\s*["']?\s*([a-z]{2,3})\b""")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def visible(html):
    """The text of a page."""
    return entities.unescape(_TAGS.sub(" ", html))


def trigrams(text):
    """Bucket of each trigram of the folded text, runs of anything but letters being one space."""
    folded = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    codes = np.frombuffer(f" {folded} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(codes) < 3:
        return np.empty(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x1F123BB5) + codes[1:-1] * np.uint64(0x5851F42D)) ^ (codes[2:] * np.uint64(0x9E3779B1))
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def address(url):
    """(host, domain, suffix) of an address."""
    found = _HOST.match(url or "")
    host = found[1].lower().strip(".") if found else ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def declared(html):
    found = _DECLARED.search(html)
    return (found[1] or found[2]).lower() if found else None


class Trigrams:
    """log P(trigram | language) for the languages of the sample, by name."""

    def __init__(self, names, counts):
        self.names = names
        smooth = counts + 0.1
        self.log = np.log(smooth / smooth.sum(axis=0))

    def evidence(self, text):
        """Log-likelihood per language, weighed down for long texts."""
        grams = trigrams(text)
        if not len(grams):
            return np.zeros(len(self.names))
        return self.log[grams].sum(axis=0) / (1 + len(grams) / ENOUGH)


def _count(names):
    def run(batches):
        totals = np.zeros((BUCKETS, len(names)), np.int64)
        at = {n: i for i, n in enumerate(names)}
        for batch in batches:
            texts, langs = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("text", "lang"))
            for text, lang in zip(texts, langs):
                totals[:, at[lang]] += np.bincount(trigrams(text), minlength=BUCKETS)
        bucket, lang = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(lang), pa.array(totals[bucket, lang])], names=["bucket", "lang", "n"])

    return run


def learn(docs, text_col="text", lang_col="lang", id_col="doc_id", rows=FIT_ROWS):
    """Trigram tables of every language, each from about `rows` of its documents at most, drawn by a hash of identifier and text."""
    # The primary subtag of a language tag; what has no such shape is no language.
    code = F.regexp_extract(F.lower(F.trim(F.col(lang_col).cast("string"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    known = docs.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                        code.alias("lang")).where("lang IS NOT NULL AND lang <> ''")
    # One row per language; names come from all documents, never from the sample.
    of_lang = known.groupBy("lang").count().select(
        "lang", F.ceil(F.lit(float(rows)) / F.col("count") * (1 << 31)).cast("long").alias("bound"))
    bounds = {r["lang"]: r["bound"] for r in of_lang.collect()}
    names = sorted(bounds)
    # Drawn where the texts lie, before anything is moved; rows that share an identifier are drawn apart by their texts.
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")] if names else F.lit(0)
    drawn = known.where(F.pmod(F.xxhash64("i", "text"), F.lit(1 << 31)) < bound).select("text", "lang")
    counts = np.zeros((BUCKETS, len(names)))
    if names:
        drawn = store(drawn, "known")
        parts = drawn.mapInArrow(_count(names), "bucket long, lang long, n long").groupBy("bucket", "lang").agg(F.sum("n").alias("n"))
        for r in parts.collect():  # at most BUCKETS rows per language
            counts[r["bucket"], r["lang"]] = r["n"]
    return Trigrams(names, counts)


READ = "row long, id long, host string, domain string, suffix string, declared string, text_lang string, evidence array<double>"


def _read(model):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                urls, pages = (part.column(part.schema.get_field_index(n)).to_pylist() for n in ("url", "html"))
                out = []
                for url, page in zip(urls, pages):
                    evidence = model.evidence(visible(page))
                    best = model.names[int(evidence.argmax())] if evidence.any() else None
                    out.append((*address(url), declared(page), best, evidence.tolist()))
                kinds = [pa.string()] * 5 + [pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(n)) for n in ("row", "id")), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                    names=[f.split()[0] for f in READ.split(", ")])

    return run


def _seen(read, by):
    """{language: pages} per value of a column, as a map column n_<by>."""
    counts = read.where(F.col("text_lang").isNotNull() & F.col(by).isNotNull()).groupBy(by, "text_lang").count()
    return counts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", "count"))).alias(f"n_{by}"))


def identify(pages, model, id_col="page_id", url_col="url", html_col="html"):
    """Rows (id, lang, probability, text_lang, declared, suffix, host, posterior), one per page."""
    given = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                         F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    names = model.names
    if not names:
        none = F.lit(None)
        return given.select("id", none.cast("string").alias("lang"), none.cast("double").alias("probability"))
    read = store(given.mapInArrow(_read(model), READ), "read")
    # The languages are few, so totals per language and per value fit in a few rows.
    shares = {r["text_lang"]: r["count"] for r in read.where("text_lang IS NOT NULL").groupBy("text_lang").count().collect()}
    total = sum(shares.values())
    kinds = {c: read.agg(F.countDistinct(c)).first()[0] for c in ("declared", "suffix")}
    rows = read
    for by in ("declared", "suffix", "host", "domain"):
        rows = rows.join(_seen(read, by).withColumnRenamed(by, f"k_{by}"), F.col(by) == F.col(f"k_{by}"), "left")

    # Sums of a value's pages once a row; languages as an array, so that the plan is as long for a hundred as for four.
    whole = {by: F.aggregate(F.coalesce(F.map_values(f"n_{by}"), F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, n: a + n)
             for by in ("host", "domain")}
    rows = rows.withColumns({f"t_{by}": F.greatest(F.lit(0.0), total_of - F.col("text_lang").isNotNull().cast("double"))
                             for by, total_of in whole.items()})
    listed, pages_in = F.array(*map(F.lit, names)), F.array(*[F.lit(float(shares.get(n, 0))) for n in names])

    def score(evidence, i):
        lang, of_lang = F.get(listed, i), F.get(pages_in, i)
        seen = lambda by: F.coalesce(F.element_at(f"n_{by}", lang), F.lit(0)).cast("double")
        own = F.when(F.col("text_lang") == lang, 1.0).otherwise(0.0)
        base = (of_lang + 1.0) / (total + len(names))
        domain = (F.greatest(F.lit(0.0), seen("domain") - own) + PARENT * base) / (F.col("t_domain") + PARENT)
        host = (F.greatest(F.lit(0.0), seen("host") - own) + PARENT * domain) / (F.col("t_host") + PARENT)
        says = (seen("declared") + OTHER + F.when(F.col("declared") == lang, AGREES).otherwise(0.0)) / (
            of_lang + OTHER * kinds["declared"] + AGREES)
        ends = (seen("suffix") + OTHER) / (of_lang + OTHER * max(1, kinds["suffix"]))
        value = evidence + F.log(host) + F.when(F.col("declared").isNotNull(), F.log(says)).otherwise(0.0) + F.when(
            F.col("suffix") != "", F.log(ends)).otherwise(0.0)
        return F.struct(value.alias("score"), lang.alias("lang"))

    rows = rows.withColumn("scores", F.transform("evidence", score))
    rows = rows.withColumn("best", F.array_max("scores"))
    odds = F.transform("scores", lambda s: F.exp(s["score"] - F.col("best.score")))
    norm = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    return rows.select(
        "id", F.col("best.lang").alias("lang"), (1 / norm).alias("probability"), "text_lang", "declared", "suffix", "host",
        F.map_from_arrays(F.array(*map(F.lit, names)), F.transform(odds, lambda x: x / norm)).alias("posterior"))
