"""Packing of token sequences by lexical retrieval.

A document's token ids and one end id are cut into whole windows, which are sequences of their
own, and a remainder. Remainders are packed with lexical neighbours: they are dealt to shards
in the order of a min-hash of their ids, so that alike ones meet, and each shard holds a BM25
inverted index of its remainders (document frequencies and lengths are those of all). A
seed opens a window; its best unused neighbours fill it; the last one is cut to fit and
what is left of it opens the next window. So every window is full but the last of a task.

Ids are those of a public byte-level BPE vocabulary, read from `vocabulary`: a
tokenizers file (.json) or the same vocabulary as ranks (.tiktoken), which is read several
times faster. Strings that name special tokens are ordinary text.

Defined cases: a null text is empty and gives the end id alone; rows that repeat an identifier
are packed each; null identifiers are carried; an empty table gives no piece; other columns
are not read.
"""

import base64
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import functions as F

from aerolith.session import store

WINDOW = 1024
END = 0
#: Remainders of a shard, and of a task; a task's shards follow each other.
SHARD, TASK = 512, 4096
K1, B = 1.2, 0.75
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Runs of one kind of character that the ranks' reader is not given.
LONG_RUN = re.compile(r"\s{1000}")

_ENCODERS = {}


def encoder(vocabulary):
    """A function from a list of texts to their lists of ids."""
    if vocabulary not in _ENCODERS:
        if vocabulary.endswith(".json"):
            from tokenizers import Tokenizer

            tokens = Tokenizer.from_file(vocabulary)
            tokens.encode_special_tokens = True
            _ENCODERS[vocabulary] = lambda texts: [e.ids for e in tokens.encode_batch(texts, add_special_tokens=False)]
        else:
            import tiktoken

            with open(vocabulary, "rb") as lines:
                ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines)}
            tokens = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            patient = f"{vocabulary.removesuffix('.tiktoken')}.json"
            # The ranks' reader recurs once a character in long runs of white space; the tokenizers file gives the same ids without.
            _ENCODERS[vocabulary] = lambda texts: [
                encoder(patient)([t])[0] if LONG_RUN.search(t) else tokens.encode_ordinary(t) for t in texts]
    return _ENCODERS[vocabulary]


def _tokenised(vocabulary, window):
    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                counts, whole, rest, signs = [], [], [], []
                for ids in encode(texts):
                    ids = np.array([*ids, END], "<u4")
                    cut = len(ids) // window * window
                    tail = ids[cut:]
                    counts.append(len(ids))
                    whole.append([ids[i:i + window].tobytes() for i in range(0, cut, window)])
                    rest.append(tail.tobytes())
                    mixed = (tail.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                    signs.append(int((mixed ^ (mixed >> np.uint64(29))).min() >> np.uint64(1)) if len(tail) else 0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(n)) for n in ("row", "id")), pa.array(counts, pa.int64()),
                     pa.array(whole, pa.list_(pa.binary())), pa.array(rest, pa.binary()), pa.array(signs, pa.int64())],
                    names=["row", "id", "doc_tokens", "whole", "rest", "sign"])

    return run


def _frequencies(batches):
    """Remainders that hold each id, added up within a partition."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for rest in batch.column(0):
            ids = np.unique(np.frombuffer(rest.as_buffer(), "<u4"))
            if len(ids) and ids[-1] >= len(total):
                total = np.append(total, np.zeros(int(ids[-1]) + 1 - len(total), np.int64))
            total[ids] += 1
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])


class Index:
    """BM25 inverted index over the remainders of a shard."""

    def __init__(self, pieces, idf, mean):
        self.terms, owners, weights = [], [], []
        for i, ids in enumerate(pieces):
            terms, times = np.unique(ids, return_counts=True)
            norm = K1 * (1 - B + B * len(ids) / mean)
            self.terms.append(terms)
            owners.append(np.full(len(terms), i))
            weights.append(idf[terms] * times * (K1 + 1) / (times + norm))
        every = np.concatenate(self.terms)
        order = np.argsort(every, kind="stable")
        self.owners, self.weights = np.concatenate(owners)[order], np.concatenate(weights)[order]
        self.known, self.starts = np.unique(every[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(every))
        self.size = len(pieces)

    def scores(self, i):
        """BM25 score of every remainder for the terms of remainder i."""
        at = np.searchsorted(self.known, self.terms[i])
        starts, sizes = self.starts[at], self.ends[at] - self.starts[at]
        flat = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        return np.bincount(self.owners[flat], self.weights[flat], self.size)


def fill(pieces, window, idf, mean):
    """Windows as lists of (piece, from, to), each full but the last."""
    index = Index(pieces, idf, mean)
    begin, unused = np.zeros(len(pieces), np.int64), np.ones(len(pieces), bool)
    sizes = np.array([len(p) for p in pieces])
    windows, opened, at = [], None, 0
    while True:
        if opened is None:
            while at < len(pieces) and not unused[at]:
                at += 1
            if at == len(pieces):
                return windows
            opened = at
        # The seed, then its neighbours from the best on.
        unused[opened] = False
        parts, room = [(opened, int(begin[opened]), int(sizes[opened]))], window - int(sizes[opened] - begin[opened])
        seed, opened = opened, None
        if room and unused.any():
            scores = np.where(unused, index.scores(seed), -1.0)
            for i in np.argsort(-scores, kind="stable"):
                if not room or not unused[i]:
                    break
                unused[i] = False
                taken = min(room, int(sizes[i]))
                parts.append((int(i), 0, taken))
                room -= taken
                if taken < sizes[i]:
                    begin[i], opened = taken, int(i)
        windows.append(parts)


SHAPE = "row long, id long, doc_tokens long, start long, ids binary, sequence_id long, offset long"


def _packed(window, idf, mean):
    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        names = [f.split()[0] for f in SHAPE.split(", ")]
        held = []

        def close(rows, last):
            """Pack a shard; what its last window holds goes on to the next shard unless it is the last."""
            nonlocal made
            windows = fill([np.frombuffer(r[3], "<u4") for r in rows], window, idf, mean)
            carried = []
            short = sum(b - a for _, a, b in windows[-1]) < window
            if short and not last:
                for i, a, b in windows.pop():
                    row, key, count, ids, skipped = rows[i]
                    carried.append((row, key, count, ids[4 * a:4 * b], skipped + a))
            out = []
            for parts in windows:
                offset = 0
                for i, a, b in parts:
                    row, key, count, ids, skipped = rows[i]
                    out.append((row, key, count, skipped + a, ids[4 * a:4 * b], (task << 33 | made) * 2 + 1, offset))
                    offset += b - a
                made += 1
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names), carried

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("row", "id", "doc_tokens", "rest")]
            for row, key, count, ids in zip(*columns):
                held.append((row, key, count, ids, count - len(ids) // 4))
                if len(held) >= SHARD:
                    out, held = close(held, False)
                    yield out
        if held:
            yield close(held, True)[0]

    return run


def pack(docs, id_col="doc_id", text_col="text", vocabulary=None, window=WINDOW):
    """Stored pieces (row, id, doc_tokens, start, ids, sequence_id, offset); ids are little-endian 32-bit.

    start counts the document's ids before the piece, offset the sequence's.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    tokens = store(rows.mapInArrow(_tokenised(vocabulary, window),
                                   "row long, id long, doc_tokens long, whole array<binary>, rest binary, sign long"), "tokens")
    whole = tokens.select("row", "id", "doc_tokens", F.posexplode("whole").alias("at", "ids")).select(
        "row", "id", "doc_tokens", (F.col("at").cast("long") * window).alias("start"), "ids",
        (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = tokens.where(F.length("rest") > 0)
    count, mean = rest.agg(F.count("*"), F.avg(F.length("rest") / 4)).first()
    if not count:
        return whole
    # At most one row for each id of the vocabulary.
    held = rest.select("rest").mapInArrow(_frequencies, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    idf = np.zeros(max(r["token"] for r in held) + 1)
    for r in held:
        idf[r["token"]] = np.log1p((count - r["n"] + 0.5) / (r["n"] + 0.5))
    dealt = rest.select("row", "id", "doc_tokens", "rest", "sign").repartitionByRange(-(-count // TASK), "sign", "row")
    packed = store(dealt.sortWithinPartitions("sign", "row").mapInArrow(_packed(window, idf, float(mean)), SHAPE), "packed")
    return whole.unionByName(packed)


def pieces(docs, **options):
    """One row per piece with a digest of its ids."""
    found = pack(docs, **options)
    return found.select(
        F.col("id").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
