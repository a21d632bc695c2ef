"""Importance resampling towards a target's words, over a head-tail vocabulary.

Features are all runs of one and two consecutive words. A feature's bucket is the CRC-32 of its bytes
modulo BUCKETS. The vocabulary has a head and a tail. Words and pairs that are frequent over all texts
are the head: a bounded table of each word's CRC states (of the word, and of the word
and the space after it, from which a pair goes on) and of each pair's bucket, broadcast to
every task. Features outside take their CRC from their own bytes. Both give the same
buckets, so the head decides the speed and never a count.

Every text is read into buckets once and these are stored. From them come the exact totals of corpus and target,
each bucket's gain, a document's weight (the floored mean gain of its features) and, with Gumbel noise
from a hash of the identifier, its score. The share SHARE of the documents with at least LEAST_WORDS words
is drawn without replacement by the highest scores, in order and without a group in one task.

Defined cases: a null text, or one without words, has no features and the weight 0; a null identifier
has the noise of an empty one; of equal scores the smaller identifier comes first (null last); rows that repeat an
identifier are drawn each for itself; an empty target leaves gains that only even out the buckets;
an empty table gives an empty result; other columns are not read.
"""

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aerolith.llm.ordering import positions
from aerolith.session import store

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, (25, 100), 20, 7
#: Words and pairs of the head; bytes of the longest of them. So the head stays below 10 MB.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 20_000, 80_000, 40
#: Entries that a task counts at once; beyond it hands on what it has.
COUNTED = 400_000

#: A-Z to lower case; every ASCII character that is no letter or digit separates words.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text):
    """Words of a text in UTF-8."""
    return text.translate(_PLAIN).split()


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _frequent(batches):
    """Counts of words, and of pairs as "word word": per task the largest, twice the head at most."""
    def largest(seen, most):
        return Counter(dict(heapq.nlargest(2 * most, seen.items(), key=lambda e: e[1])))

    singles, pairs = Counter(), Counter()
    for batch in batches:
        for text in _column(batch, "text"):
            found = words(text.as_py())
            singles.update(found)
            pairs.update(zip(found, found[1:]))
            if len(singles) > COUNTED:
                singles = largest(singles, HEAD_WORDS)
            if len(pairs) > COUNTED:
                pairs = largest(pairs, HEAD_PAIRS)
    for pair, seen in ((False, largest(singles, HEAD_WORDS)), (True, largest(pairs, HEAD_PAIRS))):
        names = [b" ".join(e) for e in seen] if pair else list(seen)
        few = [(n, c) for n, c in zip(names, seen.values()) if len(n) <= HEAD_BYTES]
        if few:
            yield pa.RecordBatch.from_arrays([pa.array([pair] * len(few)), pa.array([n for n, _ in few], pa.binary()),
                                              pa.array([c for _, c in few], pa.int64())], names=["pair", "feature", "times"])


def head(texts):
    """The most frequent words and pairs of texts (binary column `text`), at most HEAD_WORDS and HEAD_PAIRS."""
    counts = store(texts.mapInArrow(_frequent, "pair boolean, feature binary, times long").groupBy("pair", "feature").agg(
        F.sum("times").alias("times")), "frequent")
    return tuple([row.feature for row in counts.where(F.col("pair") == pair).orderBy(F.desc("times"), "feature").limit(most).collect()]
                 for pair, most in ((False, HEAD_WORDS), (True, HEAD_PAIRS)))


class _States(dict):
    """CRC of a word with the space after it, from which a pair goes on."""

    def __missing__(self, word):
        return zlib.crc32(word + b" ")


class _Singles(dict):
    def __init__(self, known, buckets):
        super().__init__((w, zlib.crc32(w) % buckets) for w in known)
        self.buckets = buckets

    def __missing__(self, word):
        return zlib.crc32(word) % self.buckets


class _Pairs(dict):
    def __init__(self, known, states, buckets):
        self.states, self.buckets = states, buckets
        super().__init__((tuple(p.split(b" ")), zlib.crc32(p) % buckets) for p in known)

    def __missing__(self, pair):
        return zlib.crc32(pair[1], self.states[pair[0]]) % self.buckets


_OPEN = {}


def _tables(name, frequent, buckets):
    """The head's tables, built once in a worker."""
    if name not in _OPEN:
        _OPEN.clear()
        singles, pairs = frequent.value
        states = _States((w, zlib.crc32(w + b" ")) for w in singles)
        _OPEN[name] = _Singles(singles, buckets), _Pairs(pairs, states, buckets)
    return _OPEN[name]


def _bucketed(frequent, name, buckets):
    """(id, n_words, buckets of its features as 16-bit numbers) per text."""
    def run(batches):
        singles, pairs = _tables(name, frequent, buckets)
        for batch in batches:
            sizes, found = [], []
            for text in _column(batch, "text"):
                w = words(text.as_py())
                at = list(map(singles.__getitem__, w))
                at += map(pairs.__getitem__, zip(w, w[1:]))
                sizes.append(len(w))
                found.append(np.array(at, "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([_column(batch, "id"), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())],
                                             names=["id", "n_words", "buckets"])

    return run


def _totals(buckets):
    def run(batches):
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for each in _column(batch, "buckets"):
                seen += np.bincount(np.frombuffer(each.as_py(), "<u2"), minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bucket", "times"])

    return run


def totals(bucketed, buckets=BUCKETS):
    """Exact features per bucket, as an array of `buckets` numbers."""
    found = bucketed.select("buckets").mapInArrow(_totals(buckets), "bucket long, times long").groupBy("bucket").agg(F.sum("times")).collect()
    sums = np.zeros(buckets, np.int64)
    for bucket, times in found:
        sums[bucket] = times
    return sums


def gains(corpus, target):
    """floor(1000 ln) of how much likelier a bucket is in the target, one count added to each."""
    ratio = (target + 1.0) * (float(corpus.sum()) + len(corpus)) / ((corpus + 1.0) * (float(target.sum()) + len(corpus)))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def _weighed(gain):
    def run(batches):
        for batch in batches:
            features, weights = [], []
            for each in _column(batch, "buckets"):
                at = np.frombuffer(each.as_py(), "<u2")
                features.append(len(at))
                weights.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            yield pa.RecordBatch.from_arrays([_column(batch, "id"), _column(batch, "n_words"), pa.array(features, pa.int64()),
                                              pa.array(weights, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return run


def gumbel(key, seed):
    """floor(-1000 ln(-ln u)), u from 32 bits of the hash of "seed:key"."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def _bytes(table, text_col, *kept):
    return table.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def weigh(docs, target, id_col="doc_id", text_col="text", target_col="text", buckets=BUCKETS):
    """Stored rows (id, n_words, n_features, weight): how much likelier a document's features are in the target."""
    if buckets > 1 << 16:
        raise ValueError("buckets are kept as 16-bit numbers")
    spark = docs.sparkSession
    corpus = _bytes(docs, text_col, F.col(id_col).alias("id"))
    wanted = _bytes(target, target_col, F.lit(None).cast("long").alias("id"))
    frequent = spark.sparkContext.broadcast(head(corpus.select("text")))
    name = f"{spark.sparkContext.applicationId}-{frequent._jbroadcast.id()}-{buckets}"
    shape = f"id {corpus.schema['id'].dataType.simpleString()}, n_words long, buckets binary"
    own = store(corpus.mapInArrow(_bucketed(frequent, name, buckets), shape), "buckets")
    theirs = wanted.mapInArrow(_bucketed(frequent, name, buckets), "id long, n_words long, buckets binary")
    gain = gains(totals(own, buckets), totals(theirs, buckets))
    shape = f"id {corpus.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long"
    return store(own.mapInArrow(_weighed(gain), shape), "weighed")


def resample(docs, target, id_col="doc_id", text_col="text", target_col="text", share=SHARE, least_words=LEAST_WORDS, seed=SEED):
    """Rows (id, n_features, weight, score, rank): rank of the drawn rows from 1 by score, null for the others."""
    weighed = weigh(docs, target, id_col, text_col, target_col)
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    scored = store(weighed.withColumn("score", F.col("weight") + gumbel(key, seed)), "scored")
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = long_enough.count() * share[0] // share[1]
    ranked = positions(long_enough, [], [F.desc("score"), F.asc_nulls_last("id")], "place")
    rank = F.col("place") + 1
    columns = ["id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(rank <= drawn, rank).alias("rank")).unionByName(
        scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
