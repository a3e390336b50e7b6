"""BPE encoding and decoding through a minimal acyclic transducer.

Spark counts the pre-tokens of all documents; the most frequent (a bounded number) are compiled into a minimal acyclic
automaton with shared suffixes. An edge carries the number of words that its earlier siblings lead to, so that the sum along a
path is the word's rank among the sorted words; the rank points into one array of token ids, the outputs. The arrays are one
flat file that each Python worker maps into memory. Words outside the lexicon are merged exactly, pair by pair in rank order.

Results equal those of the tokenizers library for a file of this kind (NFC, white space runs, lower case, word split, byte
level, end-of-word suffix) with add_special_tokens=False. Nulls count as the empty text: no ids. A text with a character
outside a safe set of Latin and punctuation is split by the library's own normalizer and pre-tokenizer, since Unicode tables
differ between libraries; one with a special token's string is cut at it first. Null ids are passed on, repeated rows are encoded each, a very long text is one
row of ids, an empty table gives no rows. Columns other than those named are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import mmap
import re
import struct
import tempfile
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, most_frequent, tokenizer_path, written

VOCABULARY = "word_bpe_49k.json"
#: Words in the lexicon, and their longest; together they bound what is broadcast.
LEXICON_WORDS, LONGEST = 60_000, 48
#: Words that a worker keeps with their ids.
MEMO = 250_000
#: Fixed by the vocabulary file: its split pattern, for characters of the safe set (where NFC changes nothing).
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:_|[^\w\s])+")
UNSAFE = re.compile("[^\t\n\r -~¡-ɏ‐-‧€]")
NEVER = 1 << 60


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = itertools.count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The vocabulary file: splitting into words, exact merging, the pieces' strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, end = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        self.library, self.chars = Tokenizer.from_file(path), byte_chars()
        self.to_chars = {b: c for b, c in enumerate(self.chars)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.first, self.last = [vocab[c] for c in self.chars], [vocab[c + end] for c in self.chars]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.pieces = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.size = max(self.pieces) + 1

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens' strings, as ordinary (not byte-level) strings where the text is safe."""
        if not UNSAFE.search(text):
            return SPLIT.findall(text.lower())
        lib = self.library
        back = {c: b for b, c in enumerate(self.chars)}
        return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    def chunks(self, text: str) -> list[str] | None:
        """Runs without white space, lower-cased, if the text is safe and has no special token's string; else None. No word crosses
        white space, so the words of a text are those of its chunks, which repeat and are split once."""
        return None if "<|" in text or UNSAFE.search(text) else text.lower().split()

    def words(self, text: str) -> list[str | int]:
        """Words, and ids of special tokens where their strings stand."""
        if "<|" not in text:
            return self.split(text)
        return [y for x in self.at_special.split(text) if x for y in ([self.special[x]] if x in self.special else self.split(x))]

    def merge(self, word: bytes) -> list[int]:
        ids = [self.first[b] for b in word]
        ids[-1] = self.last[word[-1]]
        return self._merge_long(ids) if len(ids) > 200 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.rank.get
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks and (r := min(ranks)) != NEVER:
            k = ranks.index(r)
            ids[k] = self.merged[r]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), NEVER)
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a queue of (rank, position) over linked symbols: n log n, for words of any length."""
        n, get = len(ids), self.rank.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        queue = [(r, k) for k in range(n - 1) if (r := get((ids[k], ids[k + 1]), NEVER)) != NEVER]
        heapq.heapify(queue)
        while queue:
            r, k = heapq.heappop(queue)
            m = after[k] if alive[k] else -1
            if m < 0 or get((ids[k], ids[m]), NEVER) != r:
                continue
            ids[k], alive[m], after[k] = self.merged[r], False, after[m]
            if after[m] >= 0:
                before[after[m]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (x := get((ids[a], ids[b]), NEVER)) != NEVER:
                    heapq.heappush(queue, (x, a))
        return [x for x, live in zip(ids, alive) if live]


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """Minimal acyclic automaton of the words, with the ids as outputs, as one flat block: int32 arrays, then the edges' bytes."""
    entries = sorted(dict(entries).items())
    nodes: list[list] = [[False, {}]]  # final, edges
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # parent, byte, child not yet known to be minimal
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            final, edges = nodes[child]
            same = known.setdefault((final, tuple(edges.items())), child)
            nodes[parent][1][byte] = same

    for word, _ in entries:
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        settle(common)
        at = path[-1][2] if path else 0
        for byte in word[common:]:
            nodes.append([False, {}])
            nodes[at][1][byte] = len(nodes) - 1
            path.append((at, byte, len(nodes) - 1))
            at = len(nodes) - 1
        nodes[at][0], last = True, word
    settle(0)
    order = {0: 0}
    for node in (stack := [0]):  # grows while it is read
        for child in nodes[node][1].values():
            if child not in order:
                order[child] = len(order)
                stack.append(child)
    below: dict[int, int] = {}
    todo = [(0, False)]
    while todo:
        node, done = todo.pop()
        if done:
            below[node] = nodes[node][0] + sum(below[c] for c in nodes[node][1].values())
        elif node not in below:
            todo += [(node, True), *((c, False) for c in nodes[node][1].values())]
    starts, finals, edges = [], [], []
    for node in stack:
        starts.append(len(edges))
        finals.append(int(nodes[node][0]))
        passed = int(nodes[node][0])
        for byte, child in sorted(nodes[node][1].items()):
            edges.append((byte, order[child], passed))
            passed += below[child]
    starts.append(len(edges))
    e = np.array(edges, np.int32).reshape(-1, 3)
    outputs = [i for _, ids in entries for i in ids]
    ends = np.cumsum([0, *(len(ids) for _, ids in entries)])
    parts = [np.array(x, np.int32) for x in (starts, finals, e[:, 1], e[:, 2], ends, outputs)]
    return b"".join([np.array([len(p) for p in parts], np.int32).tobytes(), *(np.ascontiguousarray(p).tobytes() for p in parts), e[:, 0].astype(np.uint8).tobytes()])


class Lexicon:
    """The compiled block, mapped from a file that has no name any more; nothing is left behind."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self.map, np.int32, 6)
        view = np.frombuffer(self.map, np.int32, int(sizes.sum()), 24)
        parts = np.split(view, np.cumsum(sizes)[:-1])
        self.starts, self.finals, self.next, self.passed, self.ends = (memoryview(p) for p in parts[:5])
        self.labels = 24 + 4 * int(sizes.sum())
        self.outputs = self.labels - 4 * int(sizes[5])

    def get(self, word: bytes) -> list[int] | None:
        raw = self.raw(word)
        return None if raw is None else np.frombuffer(raw, "<u4").tolist()

    def raw(self, word: bytes) -> bytes | None:
        """The word's ids, as little-endian uint32."""
        node = rank = 0
        starts, after, passed, find, first = self.starts, self.next, self.passed, self.map.find, self.labels
        for k in range(len(word)):
            edge = find(word[k : k + 1], first + starts[node], first + starts[node + 1]) - first
            if edge < 0:
                return None
            rank += passed[edge]
            node = after[edge]
        return self.map[self.outputs + 4 * self.ends[rank] : self.outputs + 4 * self.ends[rank + 1]] if self.finals[node] else None


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


class Memo(dict):
    """Chunk or word -> ids as little-endian uint32 bytes, as found. When full it becomes the older half, from which what is used again comes
    back, so a worker's memory is bounded and frequent words stay."""

    def __init__(self, find, limit: int = MEMO):
        super().__init__()
        self.find, self.limit, self.older = find, limit, {}

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        out = self[word] = self.older.get(word) or self.find(word)
        return out


def as_bytes(word: str) -> bytes:
    return word.encode("utf-8", "surrogateescape")


def as_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(1)
def coder(path: str, block: bytes) -> tuple[WordBpe, Memo, Memo, list[str]]:
    bpe, lexicon = word_bpe(path), Lexicon(block)

    def find(word: str | int) -> bytes:
        if isinstance(word, int):
            return as_ids([word])
        raw = as_bytes(word)
        return lexicon.raw(raw) or as_ids(bpe.merge(raw))

    by_word = Memo(find)
    by_chunk = Memo(lambda chunk: b"".join(map(by_word.__getitem__, SPLIT.findall(chunk))))
    return bpe, by_chunk, by_word, [bpe.pieces.get(i, "") for i in range(bpe.size)]


def frequent_words(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all documents, at most so many; none longer than LONGEST bytes."""

    def count(batches):
        bpe, chunks, seen = word_bpe(path), Counter(), Counter()

        def rows():
            for chunk, n in chunks.items():
                for word in SPLIT.findall(chunk):
                    seen[word] += n
            chunks.clear()
            out = pa.RecordBatch.from_pydict({"word": pa.array([as_bytes(w) for w in seen], pa.binary()), "n": pa.array(seen.values(), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                plain = bpe.chunks(text)
                chunks.update(plain) if plain is not None else seen.update(w for w in bpe.words(text) if not isinstance(w, int))
            if len(seen) + len(chunks) > MEMO:
                yield rows()
        yield rows()

    counts = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "word binary, n long")
    counts = written(counts.where(F.octet_length("word").between(1, LONGEST)).groupBy("word").agg(F.sum("n").alias("n")), "words")
    return [bytes(r.word).decode("utf-8", "surrogateescape") for r in most_frequent(counts, "n", words).select("word").collect()]


def lexicon_for(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    bpe = word_bpe(path)
    return compile_lexicon([(as_bytes(w), bpe.merge(as_bytes(w))) for w in frequent_words(docs, path, words)])


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with_ids adds ids (array of int) and decoded (string)."""
    path = path or tokenizer_path(VOCABULARY)
    arrow_rows(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    block = docs.sparkSession.sparkContext.broadcast(lexicon_for(docs, path, words))

    def run(batches):
        bpe, by_chunk, by_word, pieces = coder(path, block.value)
        piece = np.array(pieces, object)
        for batch in batches:
            n, sha, decoded_sha, all_ids, decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                plain = bpe.chunks(text or "")
                raw = b"".join(map(by_chunk.__getitem__, plain) if plain is not None else map(by_word.__getitem__, bpe.words(text)))
                ids = np.frombuffer(raw, "<u4")
                back = " ".join(piece[ids].tolist())
                n.append(len(ids))
                sha.append(hashlib.sha256(raw).hexdigest())
                decoded_sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append(ids.tolist())
                    decoded.append(back)
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(all_ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())} if with_ids else {}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids)
