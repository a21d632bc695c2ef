"""Repeated passages by sharded phrase automata.

A window is WINDOW consecutive words; a word goes if a window that covers it stands anywhere
else as well. Windows are not compared one by one:

0. All windows of a text that is given more than once are repeated, so it goes whole; it is kept once, with its number,
   for what it has in common with others.
1. Every window names one of its PHRASE-word phrases, the one with the least hash, so equal
   windows name equal phrases (winnowing). Phrases named by two texts, or twice by one, recur.
2. Recurring phrases are dealt to shards by their home, the text with the least key that
   names them, so that copies of one text meet in one shard. Each shard compiles its
   phrases into an Aho-Corasick automaton over words (LETTERS letters of few kinds a word, as a node's
   children are searched one by one) and streams the texts that were dealt to it; a large shard is streamed by several tasks.
3. A located phrase gives its block: the windows that name it there. Blocks are counted by
   content. Where a block is the only one of its content, its windows are counted against
   those of the other blocks of the phrase.
4. Words of repeated windows are cut from the texts.

Phrases, blocks and windows are compared by 64-bit hashes, a window within its phrase (so by
128 bits). A text is known by its XXH64 and its length.

Defined cases: a null text has no words; a text shorter than a window keeps all; repeated
rows count as copies of each other, so all their windows are repeated; null identifiers
are kept; an empty table gives an empty result; other columns are not read.
"""

import gc

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from aerolith.session import store

WINDOW, PHRASE = 35, 10
#: Phrases of an automaton and words streamed through one automaton by one task, about.
PHRASES, WORDS = 100_000, 4_000_000
#: Letters of a word in the automata, and kinds of letters.
LETTERS, KINDS = 3, 64
#: Bytes of a word that are hashed by columns, eight at a time; longer words are hashed one by one.
SHORT = 64
#: Bytes of texts that are hashed together, about.
TOGETHER = 1 << 19
#: End of the span of a text that goes whole, if it has a window.
WHOLE = -1
BASE = 0x9E3779B97F4A7C15
SALTS = {"phrase": 0x5851F42D4C957F2D, "block": 0x2545F4914F6CDD1D, "window": 0xD6E8FEB86659FD93}
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: What stays of eight loaded bytes, by the number of them that belong to the word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data):
    """64-bit hashes of the words and where they start."""
    data = b" " + data + b" " * 8
    gap = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    hashes = _mixed(_mixed(eights[starts] & _MASKS[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) * np.uint64(BASE)))
    more = np.flatnonzero(lengths > 8)
    for done in range(8, SHORT, 8):
        if not len(more):
            break
        loaded = eights[starts[more] + done] & _MASKS[np.minimum(lengths[more] - done, 8)]
        hashes[more] = _mixed(_mixed(loaded) ^ (hashes[more] * np.uint64(BASE)))
        more = more[lengths[more] > done + 8]
    for i in more.tolist():
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + lengths[i]])
    return hashes, starts - 1


class _Powers:
    """Powers of BASE and of its inverse, kept for the next text."""

    def __init__(self):
        self._up = self._down = np.ones(1, np.uint64)

    def __call__(self, n):
        if n > len(self._up):
            up, down = (np.full(max(n, 4096), x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up), np.cumprod(down)
        return self._up[:n], self._down[:n]


_POWERS = _Powers()


class Text:
    """Hashes of the words, and of any range of words, of texts laid end to end; text k has the words from edges[k] on."""

    def __init__(self, *texts):
        self.words, starts = _word_hashes(b" ".join(texts))
        self.n = len(self.words)
        self.edges = np.append(0, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])))
        rise, self._down = _POWERS(self.n)
        self._sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.words * rise, out=self._sums[1:])

    def ranges(self, starts, length, kind):
        """64-bit hashes of the words [start, start + length)."""
        h = (self._sums[starts + length] - self._sums[starts]) * self._down[starts]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(SALTS[kind]) + np.asarray(length).astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def blocks(self):
        """(phrase hash, position, first window, windows) of each run of windows of a text that name one phrase."""
        count = self.n - WINDOW + 1
        if count <= 0:
            none = np.empty(0, np.int64)
            return none.astype(np.uint64), none, none, none
        hashes = self.ranges(np.arange(self.n - PHRASE + 1), PHRASE, "phrase")
        width = WINDOW - PHRASE + 1
        least, seen = hashes, 1
        while seen < width:
            step = min(seen, width - seen)
            least, seen = np.minimum(least[:-step], least[step:]), seen + step
        # The first place of the least hash is named: a run ends when that place is left behind or a lesser hash comes in.
        text_of = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        inside = text_of[:count] == text_of[WINDOW - 1:]
        edge = ~inside
        edge[0] = True
        edge[1:] |= ~inside[:-1] | (least[1:] != least[:-1]) | (hashes[:count - 1] == least[:-1])
        edges = np.flatnonzero(edge)
        runs = inside[edges]
        first, windows = edges[runs], np.diff(np.append(edges, count))[runs]
        near, named = np.lib.stride_tricks.sliding_window_view(hashes, width), first.copy()
        for a in range(0, len(first), 1 << 15):
            some = first[a:a + (1 << 15)]
            named[a:a + (1 << 15)] += (near[some] == least[some][:, None]).argmax(axis=1)
        return hashes[named], named, first, windows

    def letters(self):
        """LETTERS characters a word."""
        codes = self.words[:, None] // np.array([KINDS ** k for k in range(LETTERS)], np.uint64) % np.uint64(KINDS)
        return (codes + np.uint64(48)).astype(np.uint8).tobytes().decode()


def _laid_out(column):
    """Stretches [a, b) of a column of texts, each with its texts laid end to end: about TOGETHER bytes, a text at least."""
    a, taken, size = 0, [], 0
    for i in range(len(column)):
        taken.append(column[i].as_py())
        size += len(taken[-1])
        if i + 1 == len(column) or size >= TOGETHER:
            yield a, i + 1, Text(*taken)
            a, taken, size = i + 1, [], 0


def _signed(hashes):
    return pa.array(hashes.view(np.int64))


def _named_phrases(batches):
    """Distinct phrases of each text with the number of blocks that name them."""
    for batch in batches:
        texts, tid = (batch.column(batch.schema.get_field_index(n)) for n in ("text", "tid"))
        for a, b, laid in _laid_out(texts):
            named, _, first, _ = laid.blocks()
            if not len(named):
                continue
            which = np.searchsorted(laid.edges, first, side="right") - 1
            order = np.lexsort((named, which))
            named, which = named[order], which[order]
            new = np.flatnonzero(np.append(True, (named[1:] != named[:-1]) | (which[1:] != which[:-1])))
            yield pa.RecordBatch.from_arrays(
                [_signed(named[new]), pa.array(tid.to_numpy()[a:b][which[new]]), pa.array(np.diff(np.append(new, len(named))))],
                names=["phrase", "tid", "times"])


def _lists(column, *fields):
    """Offsets of the rows' lists of structs, and the fields' values."""
    structs = column.values
    return column.offsets.to_numpy(), *(structs.field(f).to_numpy(zero_copy_only=False) for f in fields)


PREPARED = ("kind int, shard long, letters string, copy long, tid long, chars long, copies long, phrases binary, at binary, "
            "first binary, windows binary, blocks binary")
_NAMES = [f.split()[0] for f in PREPARED.split(", ")]
#: Arrays travel as bytes: as lists they are written value by value, and measured anew for each row.
_ARRAYS = {"phrases": np.int64, "at": np.int32, "first": np.int32, "windows": np.int32, "blocks": np.int64}
_KINDS = [pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4, *[pa.binary()] * 5]


def _prepared(batches):
    """Texts as their shards need them: letters, and those blocks whose phrases lie in the shard. Of a home text, its phrases too."""
    for batch in batches:
        column = {n: batch.column(batch.schema.get_field_index(n)) for n in ("text", "copy", "tid", "chars", "copies", "held")}
        known = {n: column[n].to_numpy() for n in ("copy", "tid", "chars", "copies")}
        ends, all_wanted, all_shards, all_own = _lists(column["held"], "phrase", "shard", "own")
        for a, b, laid in _laid_out(column["text"]):
            out = []
            named, at, first, windows = laid.blocks()
            content = laid.ranges(first, windows + WINDOW - 1, "block").view(np.int64)
            named, letters = named.view(np.int64), laid.letters()
            parts = np.searchsorted(first, laid.edges)
            for i in range(a, b):
                start, end = laid.edges[i - a:i - a + 2]
                mine = slice(*parts[i - a:i - a + 2])
                wanted = all_wanted[ends[i]:ends[i + 1]]
                order = np.argsort(wanted)
                wanted = wanted[order]
                place = np.minimum(np.searchsorted(wanted, named[mine]), len(wanted) - 1)
                keep = wanted[place] == named[mine]
                place = order[place[keep]] + ends[i]
                arrays = [x[mine][keep] for x in (named, at - start, first - start, windows, content)]
                shards, own = all_shards[place], all_own[place]
                text = letters[LETTERS * start:LETTERS * end]
                # A text's own phrases lie in one shard.
                if own.any():
                    phrases = "".join(text[LETTERS * p:LETTERS * (p + PHRASE)] for p in arrays[1][own].tolist())
                    out.append((0, shards[own][0], phrases, *[None] * 9))
                for shard in np.unique(shards):
                    here = shards == shard
                    out.append((1, shard, text, *(known[n][i] for n in ("copy", "tid", "chars", "copies")),
                                *(x[here].astype(k).tobytes() for x, k in zip(arrays, _ARRAYS.values()))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=_NAMES)


FOUND = "phrase long, block long, tid long, chars long, copy long, copies long, first long, windows long"


def _locate(batches):
    """Stream (shard, part) groups: first the phrases, then the texts. One row per block of the shard whose phrase is located."""
    automaton, group, compiled = None, None, False
    for batch in batches:
        column = {n: batch.column(batch.schema.get_field_index(n)) for n in [*_NAMES, "part"]}
        keys = list(zip(column["shard"].to_pylist(), column["part"].to_pylist(), column["kind"].to_pylist()))
        out = []
        for i, (shard, part, kind) in enumerate(keys):
            if (shard, part) != group:
                automaton, group, compiled = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), (shard, part), False
            if kind == 0:
                letters = column["letters"][i].as_py()
                for a in range(0, len(letters), LETTERS * PHRASE):
                    automaton.add_word(letters[a:a + LETTERS * PHRASE])
                continue
            if not len(automaton):
                continue
            if not compiled:
                automaton.make_automaton()
                compiled = True
            letters = column["letters"][i].as_py()
            ends = np.fromiter((end for end, _ in automaton.iter(letters)), np.int64) + 1
            ends = ends[ends % LETTERS == 0] // LETTERS
            if not len(ends):
                continue
            # Letters of different phrases may be equal: a block counts if it stands where a phrase was located and names one of the shard's.
            there = np.zeros(len(letters) // LETTERS, bool)
            there[ends - PHRASE] = True
            phrases, at, first, windows, blocks = (np.frombuffer(column[n][i].as_buffer(), k) for n, k in _ARRAYS.items())
            here = there[at]
            count = int(here.sum())
            out.append((phrases[here], blocks[here], *(np.full(count, column[n][i].as_py()) for n in ("tid", "chars", "copy", "copies")),
                        first[here].astype(np.int64), windows[here].astype(np.int64)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=[f.split()[0] for f in FOUND.split(", ")])


WINDOWS = "phrase long, block long, n long, at long, hash long"


def _windows(batches):
    """Hashes of the windows of the blocks a text stands for."""
    for batch in batches:
        texts, asked = (batch.column(batch.schema.get_field_index(n)) for n in ("text", "asked"))
        ends, *fields = _lists(asked, "phrase", "block", "n", "first", "windows")
        for a, b, laid in _laid_out(texts):
            phrases, blocks, n, first, windows = (f[ends[a]:ends[b]] for f in fields)
            first = first + np.repeat(laid.edges[:-1], np.diff(ends[a:b + 1]))
            block = np.repeat(np.arange(len(windows)), windows)
            at = np.arange(len(block)) - np.repeat(np.cumsum(windows) - windows, windows)
            hashes = laid.ranges(first[block] + at, WINDOW, "window").view(np.int64)
            out = phrases[block], blocks[block], n[block], at, hashes
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[f.split()[0] for f in WINDOWS.split(", ")])


def _release(spark):
    """Ask the driver to drop the shuffle files of steps that are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _keyed(docs, text_col):
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return {"tid": F.xxhash64(text), "chars": F.length(text).cast("long"), "text": text.cast("binary")}


def repeated(docs, text_col="text"):
    """Stored rows (tid, chars, spans): first and last word of the stretches to cut, per distinct text that has any; WHOLE for copies."""
    spark = docs.sparkSession
    texts = docs.select(*(c.alias(n) for n, c in _keyed(docs, text_col).items()))
    # 1. Phrases that are named more than once.
    named = store(texts.select("tid", "text").mapInArrow(_named_phrases, "phrase long, tid long, times long"), "named")
    recurring = store(named.groupBy("phrase").agg(
        F.max("times").alias("times"), F.min("tid").alias("home"), F.max("tid").alias("other")).where("times > 1 OR home <> other").select(
        "phrase", "home"), "recurring")
    shards = max(1, -(-recurring.count() // PHRASES))
    dealt = F.pmod(F.xxhash64("home"), F.lit(shards)).cast("long")
    held = named.select("phrase", "tid").distinct().join(recurring.withColumn("shard", dealt), "phrase")
    tasks = store(held.groupBy("tid").agg(F.collect_set(
        F.struct("phrase", "shard", (F.col("home") == F.col("tid")).alias("own"))).alias("held")), "tasks")
    _release(spark)
    # 2. Texts that name any, each once, numbered as they are stored; each is hashed once for all of its shards.
    once = texts.join(tasks.select("tid"), "tid", "left_semi").groupBy("tid", "chars").agg(
        F.first("text").alias("text"), F.count("*").alias("copies"))
    involved = store(once.join(tasks, "tid").withColumn("copy", F.monotonically_increasing_id()), "involved")
    _release(spark)
    prepared = store(involved.mapInArrow(_prepared, PREPARED), "prepared")
    phrases = prepared.where("kind = 0").select("shard", "letters")
    routes = prepared.where("kind = 1")
    loads = routes.groupBy("shard").agg(F.ceil(F.sum(F.length("letters")) / (LETTERS * WORDS)).cast("long").alias("parts"))
    loads = store(loads.select("shard", F.greatest("parts", F.lit(1)).cast("long").alias("parts")), "loads")
    first = phrases.join(loads, "shard").select(
        F.lit(0).alias("kind"), "shard", "letters", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    then = routes.join(loads, "shard").withColumn("part", F.pmod(F.xxhash64("copy"), F.col("parts"))).drop("parts")
    stream = then.unionByName(first, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    found = store(stream.mapInArrow(_locate, FOUND), "blocks")
    _release(spark)
    # 3. Blocks by content, then the windows of blocks that are alone, from one text that stands for each content.
    blocks = store(found.groupBy("phrase", "block").agg(
        F.sum("copies").alias("n"), F.min(F.struct("copy", "first", "windows")).alias("one")), "contents")
    ragged = blocks.groupBy("phrase").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where(
        "kinds > 1 AND least = 1").select("phrase")
    asked = blocks.join(ragged, "phrase", "left_semi").groupBy("one.copy").agg(
        F.collect_list(F.struct("phrase", "block", "n", "one.first", "one.windows")).alias("asked"))
    windows = store(involved.select("copy", "text").join(asked, "copy").mapInArrow(_windows, WINDOWS), "windows")
    twice = windows.groupBy("phrase", "hash").agg(F.sum("n").alias("m")).where("m > 1").select("phrase", "hash")
    some = windows.where("n = 1").join(twice, ["phrase", "hash"], "left_semi").groupBy("phrase", "block").agg(
        F.collect_list(F.col("at").cast("long")).alias("some"))
    whole = blocks.where("n > 1").select("phrase", "block", F.lit(None).cast("array<long>").alias("some"))
    verdict = store(whole.unionByName(some), "verdict")
    spans = found.where("copies = 1").select("phrase", "block", "tid", "chars", "first", "windows").join(verdict, ["phrase", "block"])
    first, last = F.col("first"), WINDOW - 1
    whole_span = F.array(F.struct(first.alias("a"), (first + F.col("windows") - 1 + last).alias("b")))
    some_spans = F.transform("some", lambda at: F.struct((first + at).alias("a"), (first + at + last).alias("b")))
    each = spans.select("tid", "chars", F.inline(F.when(F.col("some").isNull(), whole_span).otherwise(some_spans)))
    given = texts.groupBy("tid", "chars").agg(F.count("*").alias("n")).where("n > 1").select(
        "tid", "chars", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(WHOLE).cast("long").alias("b"))).alias("spans"))
    return store(each.groupBy("tid", "chars").agg(F.collect_list(F.struct("a", "b")).alias("spans")).unionByName(given), "spans")


def _cut(batches):
    for batch in batches:
        ids, texts, spans = (batch.column(batch.schema.get_field_index(n)) for n in ("id", "text", "spans"))
        words_of, gone, kept = [], [], []
        for i in range(batch.num_rows):
            words = texts[i].as_py().split()
            marks = spans[i].as_py()
            words_of.append(len(words))
            if marks and marks[0]["b"] == WHOLE:
                if len(words) >= WINDOW:
                    gone.append(len(words))
                    words = []
                else:
                    gone.append(0)
            elif marks:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [m["a"] for m in marks], 1)
                np.add.at(edge, [m["b"] + 1 for m in marks], -1)
                stays = np.cumsum(edge[:-1]) == 0
                gone.append(len(words) - int(stays.sum()))
                words = [w for w, s in zip(words, stays.tolist()) if s]
            else:
                gone.append(0)
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([ids, pa.array(words_of, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                         names=["id", "n_words", "n_removed", "kept"])


def cut(docs, id_col="doc_id", text_col="text"):
    """Rows (id, n_words, n_removed, kept): the kept words of each text, joined by one space."""
    spans = repeated(docs, text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), *(c.alias(n) for n, c in _keyed(docs, text_col).items()))
    return texts.join(spans, ["tid", "chars"], "left").select("id", "text", "spans").mapInArrow(
        _cut, "id long, n_words long, n_removed long, kept string")
