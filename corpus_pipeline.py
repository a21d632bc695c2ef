"""From raw documents to packed sequences: each stage works on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the
next one's docs. All but the last return documents with their columns, further columns included.

Defined cases, for every stage: a null text counts as empty, a null identifier is carried and sorts behind all others,
an empty table gives an empty one, texts are whole whatever their length.
"""

from aerolith.llm import exact, mixing, packing, simhash, toxicity
from aerolith.llm.queries import TEMPER, table
from aerolith.session import prepare, store


def reject_toxic(spark, docs, sf_dir):
    """Documents that score 0.5 or more go; the lexicon is learned from the labels. Without labels of both kinds none goes but where all are toxic;
    repeated rows are scored alike and stay or go together."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the largest identifier stays; of rows that repeat it too, one."""
    return exact.deduplicate(docs, keep="largest")


def drop_near_copies(spark, docs, sf_dir):
    """Of texts with a five-word shingle similarity of 0.8 or more, and those they reach, the smallest identifier stays. Texts of fewer
    words are one shingle; texts without words are alike."""
    return simhash.deduplicate(docs)


def mix(spark, docs, sf_dir):
    """Draw documents so that sources, languages and topics have tempered token shares. A null source or language is the value "";
    rows that repeat an identifier are drawn alike; a cell below its share is drawn whole, once."""
    return mixing.sample(docs, TEMPER)


def pack(spark, docs, sf_dir):
    """Pieces of documents in sequences of 1024 tokens; an empty text gives its end id alone; repeated rows are packed each."""
    return packing.pieces(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot express the learned, tokenised and linked stages.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the documents of sf_dir."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
