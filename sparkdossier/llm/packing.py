"""Lexical retrieval packing.

Documents are dealt into shards of bounded size by topic: the term that weighs most in a document among those that many
documents have. A topic too large for a shard is split by a hash of its documents, small ones share a shard, so what lies in
a shard depends on the documents alone and not on how the table is split. Each shard gets a BM25 inverted index over token
ids, whose document frequencies and mean length are those of all documents. A window of ``WINDOW`` tokens is filled by a seed
document, then by the unused documents that BM25 ranks nearest to the seed, then, if none is left, by the next unused ones in
order; a document that does not fit is cut, and what is left of it seeds the next window. So all windows but a shard's last
are full; the last is cut into pieces whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdossier.llm import _bytes as B
from sparkdossier.session import cut

WINDOW = 1024
#: Fixed value: the id after each document.
END = np.zeros(1, "<u4")
#: Documents and tokens that a shard is planned for, and those beyond which one is closed whatever the plan (hashing deals
#: unevenly). A longer document is packed with what stands before it.
PLAN_DOCS, PLAN_TOKENS = 1500, 1_200_000
SHARD_DOCS, SHARD_TOKENS = 2048, 2_000_000
#: A topic is a term that at least this share of all documents have.
TOPIC_SHARE = 0.1
#: Shards planned for one task.
TASK_SHARDS = 16
#: BM25 constants.
K1, B_LENGTH = 1.2, 0.75
#: Terms in at least this share of a shard's documents are kept as dense rows, of so many values in all.
DENSE_SHARE, DENSE_VALUES = 1 / 16, 8_000_000
#: Seeds whose scores by frequent terms are computed together.
SEED_BLOCK = 128
#: Distinct pieces of text whose ids a worker remembers.
MEMORY = 300_000
#: Bytes of text split at once.
SPLIT_BYTES = 2 << 20


class Encoder:
    """Token ids of many texts at once, by looking up the pieces that the tokenizer's own split gives.

    A byte-level BPE splits a text into runs of letters, digits, marks and blanks and merges within them. Texts in ASCII
    and Latin letters without an apostrophe are split on their bytes for many texts at once; each distinct piece (matched
    by a hash, then compared byte for byte) is merged once and remembered. All other texts go to the tokenizer whole. Pieces are merged from the
    same file's vocabulary, whose ids are in the order of its merges.
    """

    #: Byte classes: 0 space, 1 other blank, 2 letter, 3 digit, 4 mark.
    CLASS = np.full(256, 4, np.uint8)
    CLASS[32], CLASS[9:14], CLASS[48:58] = 0, 1, 3
    CLASS[65:91] = CLASS[97:123] = CLASS[128:] = 2

    def __init__(self, path: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        # Bytes that are no visible character stand for themselves shifted by 256, in order.
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
        ranks = {bytes(byte[c] for c in token): n for token, n in vocabulary.items() if token not in special}
        coding = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.merge = coding._core_bpe.encode_single_piece
        self.odd = re.compile("[^\0-\x7f\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]|'|<\\|").search
        self.known: dict[bytes, bytes] = {}
        probe = "A  caf\u00e9 (n 12),\n\n \tthey see!! "
        if self.many([probe])[0].tolist() != self.whole(probe).tolist():
            raise ValueError(f"{path} is not the byte-level BPE that this split is for")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def many(self, texts: list[str]) -> list[np.ndarray]:
        plain = [i for i, t in enumerate(texts) if not self.odd(t)]
        out: list = [None] * len(texts)
        raw = [texts[i].encode() for i in plain]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = 0
        for a, z, part, bounds in B.pieces(data, offsets, SPLIT_BYTES):
            ids, ends = self._split(part, bounds)
            for i, x, y in zip(plain[a:z], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[i] = ids[x:y]
            at = z
        assert at == len(plain)
        return [self.whole(t) if x is None else x for t, x in zip(texts, out, strict=True)]

    def _split(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if n == 0:
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        kind = self.CLASS[data]
        blank = kind < 2
        first = np.zeros(n + 1, bool)  # the first byte of a text, or the end
        first[bounds] = True
        last = first[1:]
        # A piece begins where the class changes, at a blank before a word, and behind a space that a word has taken.
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(np.where(blank[1:], 0, kind[1:]), np.where(blank[:-1], 0, kind[:-1]), out=start[1:])
        start |= first[:-1]
        word_next = np.zeros(n, bool)
        word_next[:-1] = blank[:-1] & ~blank[1:] & ~last[:-1]
        start |= word_next  # the last blank of a run before a word stands alone
        taken = word_next & (data == 32)
        start[1:] &= ~taken[:-1]  # unless it is a space: then the word goes on with it
        heads = np.flatnonzero(start)
        tails = np.append(heads[1:], n)
        spans = B.Spans(data)
        _, where, inverse = np.unique(spans.hash(heads, tails), return_index=True, return_inverse=True)
        # A hash is only a guess: pieces that do not hold the bytes of the piece they were matched with stand for themselves.
        odd = np.flatnonzero(~spans.same(heads, tails, heads[where][inverse], tails[where][inverse]))
        inverse[odd] = len(where) + np.arange(len(odd))
        where = np.concatenate((where, odd))
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        raw, merge, pool = data.tobytes(), self.merge, []
        for a, z in zip(heads[where].tolist(), tails[where].tolist(), strict=True):
            x = raw[a:z]
            got = known.get(x)
            if got is None:
                ids = merge(x)
                got = struct.pack(f"<{len(ids)}I", *ids)
                if len(x) <= B.LONG_SPAN:
                    known[x] = got
            pool.append(got)
        size = np.fromiter(map(len, pool), np.int64, len(pool)) >> 2
        flat = np.frombuffer(b"".join(pool), "<u4")
        begin = np.cumsum(size) - size
        each = size[inverse]
        ends = np.cumsum(each)
        ids = flat[np.repeat(begin[inverse] - (ends - each), each) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(heads, bounds)]


class Statistics(NamedTuple):
    """Of all documents: their number, their mean length, and by token id how many have it."""

    n: int
    mean: float
    df: np.ndarray


class Shard:
    """A BM25 index over documents given as arrays of token ids; statistics are of these unless given."""

    def __init__(self, tokens: list[np.ndarray], stats: Statistics | None = None):
        self.n = n = len(tokens)
        size = np.array([len(t) for t in tokens], np.float64)
        all_ids = np.concatenate(tokens)
        kind = np.int32 if (int(all_ids.max()) + 1) * n < 1 << 31 else np.int64
        key = all_ids.astype(kind) * kind(n) + np.repeat(np.arange(n, dtype=kind), [len(t) for t in tokens])
        key, tf = np.unique(key, return_counts=True)
        term, self.doc = np.divmod(key, kind(n))
        heads = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        self.bounds = np.append(heads, len(term))
        df = np.diff(self.bounds)
        n_all, mean, df_all = stats._replace(df=stats.df[term[heads]]) if stats else (n, size.mean(), df)
        idf = np.log(1 + (n_all - df_all + 0.5) / (df_all + 0.5))
        number = np.repeat(np.arange(len(df)), df)
        norm = K1 * (1 - B_LENGTH + B_LENGTH * size / max(mean, 1))
        self.weight = idf[number] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.weight[df[number] == 1] = 0  # found in no other document
        order = np.argsort(self.doc, kind="stable")
        self.by_doc, self.at = number[order], np.searchsorted(self.doc[order], np.arange(n + 1))
        # Frequent terms as rows over all documents, the most frequent first; the others as postings.
        often = np.flatnonzero(df >= max(2, n * DENSE_SHARE))
        often = often[np.argsort(-df[often], kind="stable")][: DENSE_VALUES // n]
        self.row = np.full(len(df), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        at = self.row[number]
        self.dense[at[at >= 0], self.doc[at >= 0]] = self.weight[at >= 0]
        self.has = (self.dense > 0).T.astype(np.float32)
        self.blocks: dict[int, np.ndarray] = {}

    def _frequent(self, seed: int) -> np.ndarray:
        """Scores by the frequent terms, for a block of seeds at once; a shard's blocks hold four bytes per pair of its documents."""
        block = seed // SEED_BLOCK
        if block not in self.blocks:
            self.blocks[block] = self.has[block * SEED_BLOCK : (block + 1) * SEED_BLOCK] @ self.dense
        return self.blocks[block][seed % SEED_BLOCK]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for the seed's distinct terms."""
        terms = self.by_doc[self.at[seed] : self.at[seed + 1]]
        some = terms[self.row[terms] < 0]
        begin, each = self.bounds[some], self.bounds[some + 1] - self.bounds[some]
        begin, each = begin[each > 1], each[each > 1]
        ends = np.cumsum(each)
        at = np.repeat(begin - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.doc[at], self.weight[at], self.n) + self._frequent(seed)

    def nearest(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents with a positive score, best first, ties by place."""
        score = np.where(unused, self.scores(seed), 0.0)
        while True:
            d = int(score.argmax())
            if score[d] <= 0:
                return
            score[d] = 0.0
            yield d


def pack(tokens: list[np.ndarray], stats: Statistics | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of each piece, in the order of sequences."""
    n = len(tokens)
    size = [len(t) for t in tokens]
    index = Shard(tokens, stats) if n > 1 else None
    unused = np.ones(n, bool)
    next_up, sequence, offset, total = 0, 0, 0, sum(size)
    full = total // WINDOW
    # Lengths of the sequences: whole windows, then the binary digits of what is left.
    left = total % WINDOW
    lengths = [1 << b for b in range(WINDOW.bit_length(), -1, -1) if left >> b & 1]
    room = WINDOW if full else (lengths[0] if lengths else 0)

    def put(d: int, start: int) -> Iterator[tuple[int, int, int, int, int]]:
        """Lays out document ``d`` from ``start``, over as many sequences as it takes."""
        nonlocal sequence, offset, room
        while start < size[d]:
            length = min(room, size[d] - start)
            yield d, start, length, sequence, offset
            start, offset, room = start + length, offset + length, room - length
            if room == 0:
                sequence, offset = sequence + 1, 0
                room = WINDOW if sequence < full else (lengths[sequence - full] if sequence - full < len(lengths) else 0)

    seed, near, window = -1, iter(()), -1
    while True:
        if window != sequence:  # a new window: what was cut seeds it, else the next unused document
            window, seed = sequence, (seed if offset else -1)
            near = index.nearest(seed, unused) if seed >= 0 and index else iter(())
        d = next((x for x in near if unused[x]), None)
        if d is None:
            while next_up < n and not unused[next_up]:
                next_up += 1
            if next_up == n:
                return
            d = next_up
        unused[d] = False
        before = sequence
        yield from put(d, 0)
        if offset == 0:
            seed = -1
        elif seed < 0 or sequence != before:
            seed = d
            if sequence == before:  # the first of its window
                near = index.nearest(seed, unused) if index else iter(())


def id_type(path: str) -> str:
    """The narrowest little-endian type that holds all ids of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    top = max([*held["model"]["vocab"].values(), *(t["id"] for t in held.get("added_tokens") or ())], default=0)
    return "<u2" if top < 1 << 16 else "<u4"


def _tokenize(path: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch in batches:
            for a, z, _, _ in B.pieces(*B.text_buffer(batch.column(1)), SPLIT_BYTES):
                texts = [x or "" for x in batch.column(1).slice(a, z - a).to_pylist()]
                ids = [np.append(t, END).astype(kind).tobytes() for t in encode.many(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _count(kind: str):
    """Per token id the documents that have it; under -1 the number of documents, under -2 that of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, at, n, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, kind)
                if (top := int(ids.max())) >= len(df):
                    df = np.concatenate((df, np.zeros(top + 1 - len(df), np.int64)))
                    at = np.zeros(len(df), np.int64)
                place = np.arange(len(ids))
                at[ids] = place  # of an id's places the last one stays
                df[ids[at[ids] == place]] += 1
                n, total = n + 1, total + len(ids)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, (-1, -2))), pa.array(np.append(df[some], (n, total)))], ["term", "n"])

    return run


def statistics(tokens: DataFrame, kind: str = "<u4") -> Statistics:
    """Of a table with the ids of each document; at most a row for each token id comes to the driver."""
    rows = tokens.select("ids").mapInArrow(_count(kind), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by = {r.term: r.n for r in rows}
    n, total = by.pop(-1, 0), by.pop(-2, 0)
    df = np.zeros(max(by, default=-1) + 1, np.int64)
    df[list(by)] = list(by.values())
    return Statistics(n, total / max(n, 1), df)


class Topics:
    """The topic of a document: 1 + its heaviest term among those of many documents, 0 without one."""

    def __init__(self, stats: Statistics):
        self.mean = max(stats.mean, 1)
        self.terms = np.flatnonzero(stats.df >= max(2, TOPIC_SHARE * stats.n))
        df = stats.df[self.terms]
        self.idf = np.log(1 + (stats.n - df + 0.5) / (df + 0.5))
        self.number = np.full(len(stats.df), len(self.terms), np.int64)
        self.number[self.terms] = np.arange(len(self.terms))

    def of(self, ids: np.ndarray) -> int:
        tf = np.bincount(self.number[ids], minlength=len(self.terms) + 1)[:-1]
        if not tf.any():
            return 0
        weight = self.idf * (tf / (tf + K1 * (1 - B_LENGTH + B_LENGTH * len(ids) / self.mean)))
        return int(self.terms[weight.argmax()]) + 1


def _count_topics(stats: Statistics, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics, size = Topics(stats), len(stats.df) + 1
        n, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, kind)
                t = topics.of(ids)
                n[t] += 1
                total[t] += len(ids)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(total[some])], ["topic", "docs", "tokens"])

    return run


class Deal(NamedTuple):
    """By topic its first shard and how many it has, and the number of shards."""

    first: np.ndarray
    count: np.ndarray
    shards: int


def deal_topics(tokens: DataFrame, stats: Statistics, kind: str) -> Deal:
    """Small topics share a shard in order, large ones get as many as they need; a row per topic comes to the driver."""
    rows = tokens.select("ids").mapInArrow(_count_topics(stats, kind), "topic long, docs long, tokens long")
    rows = sorted(rows.groupBy("topic").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).collect())
    first, count = np.zeros(len(stats.df) + 1, np.int64), np.ones(len(stats.df) + 1, np.int64)
    shard, docs, total = 0, 0, 0
    for r in rows:
        need = max(-(-r.docs // PLAN_DOCS), -(-r.tokens // PLAN_TOKENS))
        if docs and (need > 1 or docs + r.docs > PLAN_DOCS or total + r.tokens > PLAN_TOKENS):
            shard, docs, total = shard + 1, 0, 0
        first[r.topic], count[r.topic] = shard, need
        if need > 1:
            shard += need
        else:
            docs, total = docs + r.docs, total + r.tokens
    return Deal(first, count, shard + (docs > 0))


def _shards(stats: Statistics, deal: Deal, kind: str):
    """Adds each document's shard and a checksum by which equal ids are ordered.

    Rows that repeat a document within a batch go to different shards of their topic, so that no number of them fills one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = Topics(stats)
        for batch in batches:
            shard, sums, seen = [], [], Counter()
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t, crc = topics.of(np.frombuffer(raw, kind)), zlib.crc32(raw)
                salt = zlib.crc32(b"%d" % (-1 if doc_id is None else doc_id), crc) + seen[doc_id, crc]
                seen[doc_id, crc] += 1
                shard.append(int(deal.first[t] + salt % deal.count[t]))
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(sums, pa.int64()), batch.column(0), batch.column(1)], ["shard", "crc", "doc_id", "ids"])

    return run


def _pack(stats: Statistics, kind: str):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, held = -1, 0, 0
        ids: list = []
        tokens: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal first, held
            rows: list[list[int]] = [[] for _ in range(7)]
            last = -1
            for d, start, length, sequence, offset in pack(tokens, stats):
                crc = zlib.crc32(tokens[d][start : start + length].astype("<u4").tobytes())
                for x, v in zip(rows, (ids[d], start, length, crc, len(tokens[d]), (shard << 32) + first + sequence, offset), strict=True):
                    x.append(v)
                last = sequence
            first += last + 1
            ids.clear()
            tokens.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names)

        for batch in batches:
            for number, doc_id, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                t = np.frombuffer(raw, kind)
                if tokens and (number != shard or len(tokens) >= SHARD_DOCS or held + len(t) > SHARD_TOKENS):
                    yield close()
                if number != shard:
                    shard, first = number, 0
                ids.append(doc_id)
                tokens.append(t)
                held += len(t)
        if tokens:
            yield close()

    return run


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of the byte-level BPE file, the same on all executors. Each document's ids end with id 0, so
    a null or empty text has that id alone. Repeated rows are packed each; a null doc_id is kept. An empty table gives no rows.
    ``sequence_id`` holds the shard in its upper bits and counts within it below. The result does not depend on how the table
    is split, but for which shard of a split topic takes which of the rows that repeat a doc_id and a text.
    """
    spark, kind = docs.sparkSession, id_type(tokenizer)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = cut(d.mapInArrow(_tokenize(tokenizer, kind), "doc_id long, ids binary"))
    stats = statistics(tokens, kind)
    deal = deal_topics(tokens, stats, kind)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-deal.shards // TASK_SHARDS))
    dealt = tokens.mapInArrow(_shards(stats, deal, kind), "shard long, crc long, doc_id long, ids binary")
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "crc").select("shard", "doc_id", "ids")
    return dealt.mapInArrow(_pack(stats, kind), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
