"""Queries of the problems 1, 4, 6, 7 and 8, over their whole tables, and their SQL."""

from __future__ import annotations

from framespark.llm.bpe import count_tokens, encode
from framespark.llm.packing import container_use, pack_documents
from framespark.llm.pieces import found_pauses, piece_samples, pieces
from framespark.llm.sentences import sentences, train
from framespark.llm.splits import grouped_splits, membership, shared_pairs
from framespark.sources.tables import table
from framespark.sources.views import UTT


def p1_method(spark, d):
    """The splits themselves: components, bundles, flow, rounding, members by hash."""
    return grouped_splits(table(spark, d, "utterances"))


def p1_found(spark, d):
    return shared_pairs(membership(table(spark, d, "utterances")))


def p1_members(spark, d):
    return membership(table(spark, d, "utterances"))


def p4_found(spark, d):
    return found_pauses(table(spark, d, "signals")).distinct()


def p4_pieces(spark, d):
    return pieces(table(spark, d, "signals"), keep=("audio_file",)).distinct()


def p4_samples(spark, d):
    return piece_samples(table(spark, d, "signals"))


def p6_ids(spark, d):
    return encode(table(spark, d, "documents"))


def p6_counts(spark, d):
    return count_tokens(table(spark, d, "documents"))


def p7_packs(spark, d):
    return pack_documents(table(spark, d, "documents"))


def p7_use(spark, d):
    return container_use(pack_documents(table(spark, d, "documents")))


def _prose(spark, d):
    return table(spark, d, "documents").where("prose").select("doc_id", "text")


def p8_method(spark, d):
    """All documents, by the model of those in running text, which also searches blocks without marks between all words."""
    return sentences(table(spark, d, "documents"), train(_prose(spark, d)), unmarked=True)


def p8_found(spark, d):
    prose = _prose(spark, d)
    return sentences(prose, train(prose)).distinct()


def p8_sentences(spark, d):
    """All documents, by the model of those in running text."""
    return sentences(table(spark, d, "documents"), train(_prose(spark, d)))


QUERIES = {
    "p1_method": p1_method,
    "p1_found": p1_found,
    "p1_members": p1_members,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_samples": p4_samples,
    "p6_ids": p6_ids,
    "p6_counts": p6_counts,
    "p7_packs": p7_packs,
    "p7_use": p7_use,
    "p8_method": p8_method,
    "p8_found": p8_found,
    "p8_sentences": p8_sentences,
}

#: Speakers by their least utterance, and who reaches whom over shared files.
_REACHED = f"""
WITH RECURSIVE {UTT},
s AS (SELECT speaker, min(utt_id) AS sid FROM utt WHERE speaker IS NOT NULL GROUP BY speaker),
p AS (SELECT DISTINCT sid, audio_file FROM utt JOIN s USING (speaker) WHERE audio_file IS NOT NULL),
e AS (SELECT DISTINCT x.sid AS a, y.sid AS b FROM p x JOIN p y USING (audio_file)),
r AS (SELECT sid AS a, sid AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
"""

ORACLE: dict[str, str] = {
    "p1_found": _REACHED + "SELECT a AS utt_a, b AS utt_b FROM r WHERE a < b",
    "p1_members": _REACHED + "SELECT a AS sid, min(b) AS component FROM r GROUP BY a",
}
