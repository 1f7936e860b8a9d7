"""Language-model scores from a sharded Elias-Fano n-gram trie."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispersa.llm.common import materialise, pieces, remainder, text_buffer

#: Weight of the unigram level against a context's count.
KAPPA = 1000.0
#: Documents are worked on in blocks of about this many bytes, and shards hold about this many tokens' nodes.
BLOCK_BYTES, SHARD_TOKENS = 8 << 20, 700_000
#: Words whose contexts are spread over shards: the SPREAD_WORDS most frequent, as far as they have SHARD_TOKENS / SPREAD_SHARE tokens.
SPREAD_WORDS, SPREAD_SHARE = 65_536, 16
#: Codes a decade of probability, in 16 bits.
STEPS = 4000
_TAG_BITS = 32
_TAG = np.uint64((1 << _TAG_BITS) - 1)
#: Context of the unigram entries, and of a text's first word; tags of words begin after these two.
ROOT, START = 0, 1
END = xxhash.xxh64_intdigest(b" end ", 11)


def quantise(log10p: np.ndarray) -> np.ndarray:
    """16-bit codes of log10 probabilities; 0 is left for what isn't there."""
    return np.clip(1 + np.rint(-log10p * STEPS), 1, 65535).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return (1.0 - code.astype(np.float64)) / STEPS


class EliasFano:
    """A monotone sequence as packed low bits and a unary upper part, kept in memory-mapped files.

    Samples of every CHUNK-th value tell which chunk a successor search has to decode.
    """

    CHUNK = 1 << 14

    def __init__(self, values: np.ndarray, folder: str, name: str):
        self.n = n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        self.width = width = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1) if n * width <= 1 << 22 else None
        if bits is not None:
            low = np.packbits(bits.astype(np.uint8).ravel())
        else:  # by parts, lest the bits of all values stand in memory at once
            step = 8 * max(1, (1 << 19) // max(1, width))
            low = np.concatenate([np.packbits(((values[i : i + step, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()) for i in range(0, n, step)])
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        upper = np.zeros((int(places[-1]) + 8) // 8 if n else 0, np.uint8)
        np.bitwise_or.at(upper, places >> 3, (128 >> (places & 7)).astype(np.uint8))
        self.low, self.upper = self._map(low, folder, name + ".low"), self._map(upper, folder, name + ".up")
        self.samples = values[:: self.CHUNK]
        self.begins = places[:: self.CHUNK]

    @staticmethod
    def _map(data: np.ndarray, folder: str, name: str) -> np.ndarray:
        if not len(data):
            return data
        path = os.path.join(folder, name)
        data.tofile(path)
        return np.memmap(path, data.dtype, "r")

    def decode(self, first: int, last: int) -> np.ndarray:
        """Values first..last - 1, where first is a multiple of CHUNK."""
        if first >= last:
            return np.zeros(0, np.uint64)
        begin = int(self.begins[first // self.CHUNK])
        at = last // self.CHUNK
        stop = int(self.begins[at]) + 1 if at < len(self.begins) and last % self.CHUNK == 0 else (int(self.begins[at + 1]) + 1 if at + 1 < len(self.begins) else 8 * len(self.upper))
        ones = np.flatnonzero(np.unpackbits(self.upper[begin >> 3 : (stop + 7) >> 3])) + (begin >> 3 << 3)
        ones = ones[ones >= begin][: last - first]
        out = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bit = first * self.width
            packed = np.unpackbits(self.low[bit >> 3 : (last * self.width + 7) >> 3])[bit & 7 :][: (last - first) * self.width].reshape(-1, self.width)
            low = np.zeros(last - first, np.uint64)
            for k in range(self.width):
                low |= packed[:, k].astype(np.uint64) << np.uint64(k)
            out |= low
        return out

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted queries: place and value of the first element that isn't less (place n: there is none)."""
        place = np.full(len(wanted), self.n, np.int64)
        value = np.zeros(len(wanted), np.uint64)
        chunk = np.maximum(np.searchsorted(self.samples, wanted, side="left") - 1, 0)
        edge = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1)) if len(wanted) else np.zeros(0, int)
        for a, b in zip(edge, edge[1:], strict=False):
            first = int(chunk[a]) * self.CHUNK
            part = self.decode(first, min(self.n, first + self.CHUNK))
            at = np.searchsorted(part, wanted[a:b])
            place[a:b] = first + at
            inside = at < len(part)
            value[a:b][inside] = part[at[inside]]
            over = np.flatnonzero(~inside) + a
            after = int(chunk[a]) + 1
            if after < len(self.samples):
                value[over] = self.samples[after]
        return place, value


class Trie:
    """Words (level 1) and the words before them (level 2), with quantised probabilities.

    Level 1 is the sorted word hashes with pointers to their children; children are 32-bit tags of the context word,
    made monotone over the level by adding each parent's base, so one sequence serves all parents and a
    search for a tag plus its parent's base is relative to that context.
    """

    def __init__(self, words: np.ndarray, of: np.ndarray, tags: np.ndarray, log10p: np.ndarray, folder: str):
        """words: sorted; of: each child's word place; (of, tags) sorted and distinct."""
        self.words = EliasFano(words, folder, "words")
        fan = np.bincount(of, minlength=len(words))
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(fan)]), folder, "pointers")
        self.span = 1 << _TAG_BITS
        if len(words) >= 1 << 23:
            raise ValueError("a shard holds too many words for its bases; lower SHARD_TOKENS")
        self.children = EliasFano((of.astype(np.uint64) << np.uint64(_TAG_BITS)) | tags, folder, "children")
        self.codes = EliasFano._map(quantise(log10p), folder, "codes")

    def lookup(self, words: np.ndarray, of: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Codes for sorted queries: distinct words, and (place among them, tag) of each; 0 where there is no such node."""
        if not self.children.n or not len(of):
            return np.zeros(len(of), np.uint16)
        place, value = self.words.successor(words)
        known = ((place < self.words.n) & (value == words))[of]
        key = (place[of[known]].astype(np.uint64) << np.uint64(_TAG_BITS)) | tags[known]
        spot, found = self.children.successor(key)
        hit = (spot < self.children.n) & (found == key)
        out = np.zeros(len(of), np.uint16)
        out[np.flatnonzero(known)[hit]] = self.codes[spot[hit]]
        return out


def _hashes(words: list[bytes], table: dict[bytes, int], vocabulary: list[int]) -> list[int]:
    """Local ids of words; new words go to the table and their hashes to the vocabulary."""
    out = []
    for w in words:
        i = table.get(w)
        if i is None:
            i = table[w] = len(vocabulary)
            h = xxhash.xxh64_intdigest(w, 11)
            vocabulary.append(h)
        out.append(i)
    return out


BLOCK = "block long, ids array<{id}>, held array<boolean>, sizes array<int>, tokens binary, words binary, counts binary"


def token_blocks(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """Blocks of documents: ids, held-out marks and token counts of the texts, tokens as numbers in the block's word list, and
    the words' hashes and training counts. Whole texts, ASCII letters lower-cased; a text ends with an end token (number 0)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, offsets = text_buffer(batch.column(1))
            data = raw.tobytes()
            out_marks = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for low, high in pieces(offsets, BLOCK_BYTES):
                table, vocabulary = {}, [END]
                sizes, tokens = [], []
                for i in range(low, high):
                    own = _hashes(data[offsets[i] : offsets[i + 1]].lower().split(), table, vocabulary)
                    own.append(0)
                    sizes.append(len(own))
                    tokens.append(np.array(own, np.int32))
                tokens = np.concatenate(tokens)
                train = np.repeat(~out_marks[low:high], sizes)
                counts = np.bincount(tokens[train], minlength=len(vocabulary)).astype(np.int32)
                squeeze = lambda x: zlib.compress(x.tobytes(), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().int >> 65]), pa.array([batch.column(0)[low:high].to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([out_marks[low:high].tolist()], pa.list_(pa.bool_())),
                     pa.array([sizes], pa.list_(pa.int32())), pa.array([squeeze(tokens.view(np.uint8).reshape(-1, 4).T)]), pa.array([np.array(vocabulary, np.uint64).tobytes()], pa.binary()), pa.array([squeeze(counts)])],
                    ["block", "ids", "held", "sizes", "tokens", "words", "counts"],
                )

    marked = docs.select("doc_id", "text", (remainder("doc_id", modulus) == held).alias("held"))
    return marked.mapInArrow(batches, BLOCK.format(id=kind))


class _Block:
    """A block's distinct queries (word, context), in an order that its blobs and its answers share."""

    def __init__(self, tokens: bytes, words: bytes, counts: bytes, sizes: np.ndarray, held: np.ndarray, shards: int, hot: np.ndarray):
        flat = np.frombuffer(zlib.decompress(tokens), np.uint8)
        self.tokens = np.ascontiguousarray(flat.reshape(4, -1).T).view(np.int32).ravel()
        self.words = np.frombuffer(words, np.uint64)
        self.counts = np.frombuffer(zlib.decompress(counts), np.int32)
        v = len(self.words)
        self.starts = np.cumsum(sizes) - sizes
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = v
        code = self.tokens.astype(np.int64) * (v + 1) + before
        train = np.repeat(~held, sizes)
        pairs, inverse = np.unique(code, return_inverse=True)
        n = np.bincount(inverse[train], minlength=len(pairs))
        # unigram entries first: one of each word, under the root context
        w = np.concatenate([np.arange(v), pairs // (v + 1)])
        c = np.concatenate([np.full(v, -1), pairs % (v + 1)])
        tag = np.concatenate([np.maximum(self.words & _TAG, np.uint64(2)), [np.uint64(START), np.uint64(ROOT)]])[np.where(c < 0, v + 1, c)]
        n = np.concatenate([self.counts, n])
        wide = np.isin(self.words, hot)
        aside = np.where(wide[w], tag % np.uint64(max(1, shards // 8)) * np.uint64(7), np.uint64(0))
        shard = ((self.words[w] >> np.uint64(7)) + aside) % np.uint64(shards)
        self.order = np.lexsort((tag, self.words[w], shard))
        self.shard, self.w, self.tag, self.n = shard[self.order], w[self.order], tag[self.order], n[self.order]
        place = np.empty(len(w), np.int64)
        place[self.order] = np.arange(len(w))
        self.root, self.pair = place[:v], place[v:][inverse]


def _blobs(blocks: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """(shard, block, body): each shard's queries of each block, sorted by word and context, with training counts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                b = _Block(r["tokens"], r["words"], r["counts"], np.array(r["sizes"]), np.array(r["held"], bool), shards, hot)
                edge = np.flatnonzero(np.diff(b.shard.astype(np.int64), prepend=-1, append=-1))
                for low, high in zip(edge, edge[1:], strict=False):
                    new = np.flatnonzero(np.diff(b.w[low:high], prepend=-1))
                    tag = b.tag[low:high]
                    fans = zlib.compress(np.diff(new, append=high - low).astype(np.int32).tobytes(), 1)
                    head = np.array([len(new), high - low, len(fans)], np.int64).tobytes()
                    body = head + b.words[b.w[low:high][new]].tobytes() + b.tag[low:high].astype(np.uint32).tobytes() + fans + zlib.compress(b.n[low:high].astype(np.int32).tobytes(), 1)
                    yield pa.RecordBatch.from_arrays([pa.array([int(b.shard[low])], pa.int32()), pa.array([r["block"]]), pa.array([body])], ["shard", "block", "body"])

    wanted = blocks.select("block", "sizes", "held", "tokens", "words", "counts")
    return wanted.mapInArrow(batches, "shard int, block long, body binary")


def _open_blob(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k, n, f = np.frombuffer(body, np.int64, 3).tolist()
    words = np.frombuffer(body, np.uint64, k, 24)
    tags = np.frombuffer(body, np.uint32, n, 24 + 8 * k).astype(np.uint64)
    rest = 24 + 8 * k + 4 * n
    fan = np.frombuffer(zlib.decompress(body[rest : rest + f]), np.int32)
    return words, fan, tags, np.frombuffer(zlib.decompress(body[rest + f :]), np.int32)


def _answer(bodies: list[bytes], total: int, distinct: int) -> list[bytes]:
    """Build one shard's trie from its blobs' training counts and answer all their queries.

    An answer has the exact counts of the unigram entries and the codes of all entries, in the blob's order.
    """
    parts = [_open_blob(b) for b in bodies]
    words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    of = np.repeat(inverse, np.concatenate([p[1] for p in parts]))
    key = (of.astype(np.uint64) << np.uint64(_TAG_BITS)) | np.concatenate([p[2] for p in parts])
    nodes, back = np.unique(key, return_inverse=True)
    counts = np.bincount(back, weights=np.concatenate([p[3] for p in parts])).astype(np.int64)
    parent, tag = (nodes >> np.uint64(_TAG_BITS)).astype(np.int64), nodes & _TAG
    seen = counts > 0
    held = np.unique(parent[seen])
    root = tag == ROOT
    p = np.where(root, (counts + 0.5) / (total + 0.5 * (distinct + 1)), counts / max(1, total))
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(words[held], np.searchsorted(held, parent[seen]), tag[seen], np.log10(p[seen]), folder)
        code = trie.lookup(words, parent, tag)
        del trie
    out, low = [], 0
    for b in parts:
        at = back[low : low + len(b[2])]
        low += len(b[2])
        mine = root[at]
        out.append(zlib.compress(code[at].tobytes(), 1) + counts[at[mine]].astype(np.int64).tobytes() + np.array([mine.sum()], np.int64).tobytes())
    return out


def _answers(blobs: DataFrame, total: int, distinct: int) -> DataFrame:
    """(block, shard, answer) for all blobs; a task holds the blobs of one shard at a time."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blocks, bodies = None, [], []

        def made() -> pa.RecordBatch:
            got = _answer(bodies, total, distinct) if bodies else []
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([shard] * len(blocks), pa.int32()), pa.array(got, pa.binary())], ["block", "shard", "answer"])

        for batch in it:
            for s, block, body in zip(*batch.columns, strict=True):
                s, block, body = s.as_py(), block.as_py(), body.as_py()
                if s != shard and bodies:
                    yield made()
                    blocks, bodies = [], []
                shard = s
                blocks.append(block)
                bodies.append(body)
        yield made()

    return blobs.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(batches, "block long, shard int, answer binary")


SCORE = "doc_id {id}, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scores(blocks: DataFrame, answers: DataFrame, shards: int, hot: np.ndarray, total: int, distinct: int, texts: int, kind: str) -> DataFrame:
    lists = answers.groupBy(F.col("block").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("shard", "answer"))).alias("a"))
    joined = blocks.join(lists, blocks.block == lists._b).drop("_b")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen = np.log10(0.5 / (total + 0.5 * (distinct + 1)))
        for batch in it:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                sizes, held = np.array(r["sizes"]), np.array(r["held"], bool)
                b = _Block(r["tokens"], r["words"], r["counts"], sizes, held, shards, hot)
                codes, exact = [], []
                for a in r["a"]:
                    body = a["answer"]
                    n = int(np.frombuffer(body[-8:], np.int64)[0])
                    exact.append(np.frombuffer(body[len(body) - 8 - 8 * n : -8], np.int64))
                    codes.append(np.frombuffer(zlib.decompress(body[: len(body) - 8 - 8 * n]), np.uint16))
                codes = np.concatenate(codes)
                order = np.sort(b.root)
                counts = np.zeros(len(b.words), np.int64)
                counts[np.argsort(b.root)] = np.concatenate(exact)
                assert len(order) == len(counts) and len(codes) == len(b.n)
                one = np.where(codes[b.root] > 0, dequantise(codes[b.root]), unseen)  # quantised unigram level
                pair = codes[b.pair]
                joint = np.where(pair > 0, 10 ** dequantise(pair) * total, 0.0)
                context = np.empty(len(b.tokens))
                context[1:] = counts[b.tokens[:-1]]
                context[b.starts] = texts
                p = np.log10(joint + KAPPA * 10 ** one[b.tokens]) - np.log10(context + KAPPA)
                base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))[b.tokens]
                sums = lambda x: np.add.reduceat(x, b.starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], batch.schema.field("ids").type.value_type), pa.array(held), pa.array(sizes, pa.int64()), pa.array(sums((counts[b.tokens] > 0).astype(np.int64))), pa.array(sums(base)), pa.array(sums(p))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return joined.mapInArrow(batches, SCORE.format(id=kind))


def language_scores(docs: DataFrame, modulus: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model is a bigram model with Dirichlet smoothing: p(w | v) = (c(v w) + KAPPA p(w)) / (c(v) + KAPPA), where the
    joint probability of a pair and the smoothed unigram are stored in a trie with 16-bit codes.

    Documents become blocks of numbered tokens, written once to the shared folder. A block's distinct (word, context)
    pairs with their training counts go to shards by their hash; the number of shards follows the tokens, and the
    contexts of the most frequent words are spread over shards. Each shard adds up its counts, builds its trie and answers the
    blocks' queries; answers go back to the blocks. No model, vocabulary or count table is ever in one place.
    Null and empty texts have the end token only. Repeated rows each count and are each returned.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = materialise(token_blocks(docs, modulus, held))
    tokens = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    trained = F.aggregate(F.arrays_zip("sizes", "held"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["held"], F.lit(0).cast("long")).otherwise(x["sizes"].cast("long")))
    texts = F.size(F.filter("held", lambda x: ~x))
    all_tokens, total, trained_texts = blocks.agg(F.sum(tokens), F.sum(trained), F.sum(texts)).first()
    shards = max(1, -(-int(all_tokens or 0) // SHARD_TOKENS))

    def seen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for words, counts in zip(batch.column(0), batch.column(1), strict=True):
                c = np.frombuffer(zlib.decompress(counts.as_py()), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words.as_py(), np.int64)[c > 0]), pa.array(c[c > 0])], ["h", "c"])

    vocabulary = materialise(blocks.select("words", "counts").mapInArrow(seen, "h long, c int").groupBy("h").agg(F.sum("c").alias("c")))
    distinct = vocabulary.count()
    frequent = vocabulary.where(F.col("c") * SPREAD_SHARE > SHARD_TOKENS).orderBy(F.desc("c"), "h").limit(SPREAD_WORDS).select("h")
    hot = np.array([r[0] for r in frequent.collect()], np.int64).view(np.uint64)  # at most SPREAD_WORDS
    total = int(total or 0)
    answers = materialise(_answers(_blobs(blocks, shards, hot), total, distinct))
    out = _scores(blocks, answers, shards, hot, total, distinct, int(trained_texts or 0), kind)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
