"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, accents and look-alike letters to plain ones, digits and
signs inside words to the letters they stand for, everything else to a space. Lexicon entries
are words, or stems that open a word; exceptions are two-word phrases around an entry that
are innocent and cancel it. Both are learned, with their weights, from a bounded sample of
labelled rows (FIT_ROWS), which bounds their number too. Innocent phrases are found first: those that are rare in
toxic texts and make up much of what clean texts have of a word. An entry is then weighed on
what no innocent phrase covers, so a word of one common phrase still enters. Every whole text is then scored: the weights of its matches, in
sum and by length, go through a logistic curve fitted on the same sample.

Defined cases: a null text is an empty one and has the score of a text without a match;
without labelled rows of both kinds nothing is known and every score is the share of
toxic labels (0 without labels); conflicting labels of a row count as toxic; a null
identifier is never labelled; repeated rows are scored alike; other columns are not read.
"""

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aerolith.session import store

#: Labelled rows the lexicon and the curve are fitted on, about.
FIT_ROWS = 20_000
LEAST_DOCS, LEAST_WEIGHT = 5, 2.0
#: Share of the clean texts with an entry that hold it in a phrase, from which the phrase may excuse it.
PHRASE_SHARE = 0.2
STEMS = (4, 5, 6)
#: Look-alikes that Unicode does not decompose, by the letter they pass for.
LOOKALIKES = {
    "a": "аαɑ", "b": "вьβ", "c": "сϲ¢", "d": "ԁđ", "e": "еєεɛ€", "g": "ɡ", "h": "һн", "i": "іιıí¡", "j": "јʝ", "k": "кκ",
    "l": "ӏłℓ", "m": "мμ", "n": "пηո", "o": "оοσøօ", "p": "рρ", "r": "гɾ", "s": "ѕʂ", "t": "тτ", "u": "υцս", "v": "νѵ",
    "w": "ωшѡ", "x": "хχ", "y": "уγү", "z": "ʐ",
}
#: What digits and signs inside a word stand for.
SIGNS = str.maketrans("013457@$!|", "oieastasil")
SUBSTITUTED = re.compile(r"(?<=[a-z])[013457@$!|]+(?=[a-z])|(?<![a-z0-9@$!|])[013457@$](?=[a-z])")


def _folding():
    """Code points to plain letters or a space, by decomposition; other letters stay."""
    table = {}
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2150), *range(0xFF00, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(c)).lower()
        if plain != chr(code):
            table[code] = plain
        elif not chr(code).isalpha():
            table[code] = " "
    for code in range(0x300, 0x370):
        table[code] = None
    for code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):  # invisible
        table[code] = None
    for letter, alike in LOOKALIKES.items():
        for c in alike + alike.upper():
            if len(c) == 1 and not c.isascii():
                table[ord(c)] = letter
    return table


FOLDING = _folding()
SPACES = {code: " " for code in range(128) if not chr(code).isalpha()}


def fold(text):
    """Folded words with one space before and after each."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(FOLDING)
    text = SUBSTITUTED.sub(lambda m: m[0].translate(SIGNS), text)
    return f" {' '.join(text.translate(SPACES).split())} "


def _entries(words):
    for word in words:
        if len(word) >= 3:
            yield f" {word} "
        for n in STEMS:
            if len(word) > n:
                yield f" {word[:n]}"


def _texts(batch):
    return (t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist())


def _count_entries(batches):
    """Documents per entry, added up within a partition."""
    seen = Counter()
    for batch in batches:
        for text in _texts(batch):
            seen.update(set(_entries(set(fold(text).split()))))
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["entry", "docs"])


def _uncovered(words, innocent):
    """The distinct words of a text that stand somewhere outside innocent phrases."""
    if not innocent:
        return set(words)
    free = [True] * len(words)
    for i, pair in enumerate(zip(words, words[1:])):
        if pair in innocent:
            free[i] = free[i + 1] = False
    return {w for w, f in zip(words, free) if f}


def _tally(known, innocent=frozenset(), phrases=False):
    """Texts per known entry, outside innocent phrases, or per two-word phrase around one; by label."""
    def run(batches):
        wanted, seen = set(known), {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(_texts(batch), batch.column(batch.schema.get_field_index("toxic")).to_pylist()):
                words = fold(text).split()
                if phrases:
                    near = {w for w in set(words) if not wanted.isdisjoint(_entries((w,)))}
                    seen[toxic].update({f"{a} {b}" for a, b in zip(words, words[1:]) if a in near or b in near})
                else:
                    seen[toxic].update(wanted.intersection(_entries(_uncovered(words, innocent))))
        for toxic, counts in seen.items():
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts)), pa.array([toxic] * len(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
                    names=["entry", "toxic", "docs"])

    return run


def _counted(sample, tally):
    return sample.mapInArrow(tally, "entry string, toxic long, docs long").groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("docs")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("docs")).otherwise(0)).alias("good"))


class Lexicon:
    """Entries with weights, exception phrases, and the curve. Its size is bounded by that of the sample."""

    def __init__(self, weights, exceptions=(), curve=(0.0, 0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.curve = weights, sorted(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), -phrase.index(" ", 1)))
            if len(self._automaton):
                self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded):
        """Matches as {start: weight}: the heaviest entry of a word, if no exception covers it."""
        found, excused = {}, set()
        automaton = self.automaton()
        if not len(automaton):
            return found
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight < 0:  # of a phrase: where its second word starts
                excused.update((start, start - weight))
            elif weight > found.get(start, 0):
                found[start] = weight
        for start in excused:
            found.pop(start, None)
        return found

    def features(self, folded):
        hits = self.hits(folded)
        weight = sum(hits.values())
        words = folded.count(" ") - 1
        return max(hits.values(), default=0.0), math.log1p(weight), math.log1p(100 * weight / (words + 20))

    def score(self, text):
        bias, *slopes = self.curve
        x = bias + sum(a * b for a, b in zip(slopes, self.features(fold(text))))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _described(lexicon):
    """Label and features of each text."""
    def run(batches):
        for batch in batches:
            rows = [(toxic, *lexicon.features(fold(text))) for text, toxic in zip(
                _texts(batch), batch.column(batch.schema.get_field_index("toxic")).to_pylist())]
            if rows:
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["toxic", "f1", "f2", "f3"])

    return run


def _curve(features, labels):
    """Logistic regression by Newton steps with a little ridge."""
    x = np.hstack([np.ones((len(labels), 1)), features])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (labels - p) - ridge @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def labelled(docs, labels, id_col="doc_id", text_col="text", rows=FIT_ROWS):
    """Stored sample of about `rows` labelled texts that are not held out, drawn by a hash of the identifier."""
    key = F.col(id_col).cast("string")
    known = labels.where(F.col("toxic").isNotNull() & (F.crc32(key) % 5 != 0)).groupBy(
        F.col(id_col).cast("long").alias("__id")).agg(F.max((F.col("toxic") > 0).cast("long")).alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return store(texts.join(drawn, "__id").select("text", "toxic"), "labelled")


def learn(docs, labels, id_col="doc_id", text_col="text", rows=FIT_ROWS):
    """A Lexicon from labelled rows. What reaches the driver is bounded by the sample of FIT_ROWS."""
    sample = labelled(docs, labels, id_col, text_col, rows)
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        edge = 40.0 if share else -40.0
        return Lexicon({}, (), (edge, 0.0, 0.0, 0.0))
    tried = sample.where("toxic = 1").mapInArrow(_count_entries, "entry string, docs long").groupBy("entry").agg(
        F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    known = sorted(r["entry"] for r in tried.collect())
    clean_docs = {r["entry"]: r["good"] for r in _counted(sample, _tally(known)).collect()}
    rare = (F.col("good") >= LEAST_DOCS) & (F.col("bad") * clean * 2 < F.col("good") * toxic)
    innocent = set()
    for r in _counted(sample, _tally(known, phrases=True)).where(rare).collect():
        pair = tuple(r["entry"].split(" "))
        if any(r["good"] >= PHRASE_SHARE * clean_docs[e] for e in _entries(pair) if e in clean_docs):
            innocent.add(pair)
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    best = _counted(sample, _tally(known, frozenset(innocent))).where(F.col("bad") >= LEAST_DOCS).select("entry", odds.alias("weight"))
    weights = {r["entry"]: r["weight"] for r in best.where(F.col("weight") >= LEAST_WEIGHT).orderBy("entry").collect()}
    excuses = [f" {a} {b} " for a, b in innocent if any(e in weights for e in _entries((a, b)))]
    lexicon = Lexicon(weights, excuses)
    seen = sample.mapInArrow(_described(lexicon), "toxic long, f1 double, f2 double, f3 double").collect()
    values = np.array(sorted(tuple(r) for r in seen), float)
    return Lexicon(lexicon.weights, lexicon.exceptions, _curve(values[:, 1:], values[:, 0]))


def score(texts, lexicon, text_col="text", to="tox_score"):
    """texts with the score in a column named by `to`; scored batch by batch, nothing is shuffled."""
    @F.pandas_udf("double")
    def scored(column):
        return column.map(lambda t: lexicon.score(t or ""))

    return texts.withColumn(to, scored(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def reject(docs, lexicon, text_col="text", bar=0.5):
    """The rows of docs that score below the bar, with their own columns."""
    rows = docs.select(F.struct(*docs.columns).alias("whole"), F.col(text_col).alias("scored_text"))
    return score(rows, lexicon, "scored_text").where(F.col("tox_score") < bar).select("whole.*")
