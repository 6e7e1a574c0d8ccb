"""Token counts: a byte-level BPE vocabulary compiled into two deterministic transducers.

The first splits a text into words as the library's pattern does. It has eight states; a symbol is a character's class
together with what its look-ahead needs. Texts are laid into chunks of equal length that advance together: each chunk
first runs from every state at once, which gives its state map; the maps compose through a parallel prefix scan, which
gives each chunk's start state; a second run marks the word starts.

The second counts the tokens of a word. A state holds, for each suffix of the bytes read that some vocabulary entry
begins with, the entry's trie node, the last token before the suffix and the token count there, relative to now. A
transition reads one byte and emits the change of the count, which may be negative where a merge swallows tokens. States
and transitions are compiled when first met. A token is last exactly if it is a suffix of the bytes read and the pair of
it and the last token before it encodes to itself, which holds for merge vocabularies in which every entry encodes to
itself; compiling checks the entries it meets.

At a word's start the second transducer is in its start state, so chunks of whole words have a map of one entry, and their
counts compose by addition, over the prefix that the splitter's scan marks. A word longer than a chunk is cut into chunks
whose maps compose from left to right; a map holds the states that occur as entries, since of all states (157,404 met in
25 MB of text) a chunk would have to be run from each. Maps are kept, so a chunk that repeats is run once an entry.

Whole texts are counted in one pass without a shuffle. Memory follows a block of about 1 MB or the longest document, and
caches of bounded size that are emptied when full. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows get one
result row each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import table
from ._text import blocks

SEP, LETTER, NUMBER, OTHER, SPACES, LEAD, LAST, SHORT, LONG = range(9)
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACES, LED, ONE_MORE, TWO_MORE = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a word starts at the symbol, by symbol * 8 + state."""
    step, start = np.zeros((9, 8), np.uint8), np.zeros((9, 8), np.uint8)
    for state in range(8):
        for symbol, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER)):
            step[symbol, state], start[symbol, state] = own, state not in (own, LED)
        step[SPACES, state], start[SPACES, state] = IN_SPACES, state != IN_SPACES
        step[LEAD, state], start[LEAD, state] = LED, 1
        step[LAST, state], start[LAST, state] = START, 1
        for symbol, rest in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            inside = state in (IN_OTHER, LED)
            step[symbol, state], start[symbol, state] = (IN_OTHER, 0) if inside else (rest, 1)
    step[1:, TWO_MORE], start[1:, TWO_MORE] = ONE_MORE, 0
    step[1:, ONE_MORE], start[1:, ONE_MORE] = START, 0
    return step.ravel(), start.ravel()


_STEP, _STARTS = _splitter()


def character_classes(pre_tokenizer) -> np.ndarray:
    """The class of every code point as the library's own splitter treats it: probed in ranges, halved where mixed."""
    out = np.full(0x110000, OTHER, np.uint8)
    one = lambda s: len(pre_tokenizer.pre_tokenize_str(s)) == 1

    def probe(a: int, b: int) -> None:
        s = "".join(map(chr, range(a, b)))
        for first, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if one(first + s):
                out[a:b] = kind
                return
        if b - a == 1:
            out[a] = SPACES
            return
        if one(s):
            out[a:b] = SPACES
            return
        for x, y in ((a, (a + b) // 2), ((a + b) // 2, b)):
            probe(x, y)

    for low, high in ((0x21, 0xD800), (0xE000, 0x110000)):
        for a in range(low, high, 512):
            probe(a, min(high, a + 512))
    for a in range(0x21):
        probe(a, a + 1)
    return out


def symbols(codes: np.ndarray, breaks: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The splitter's symbols for code points; ``breaks``: positions of separators between texts."""
    kind = classes[codes]
    kind[breaks] = SEP
    follows = np.zeros(len(kind), bool)  # by a character that is no white space
    follows[:-1] = (kind[1:] != SPACES) & (kind[1:] != SEP)
    out = kind.copy()
    out[(kind == SPACES) & follows] = LAST
    out[(kind == SPACES) & follows & (codes == 32)] = LEAD
    quote = np.flatnonzero((codes == 39) & (kind == OTHER))
    if len(quote):
        padded = np.append(codes, [0, 0])
        padded[:-2][breaks] = 0
        a, b = padded[quote + 1], padded[quote + 2]
        out[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        both = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[quote[both]] = LONG
    return out


def word_starts(symbol: np.ndarray, length: int = 512) -> np.ndarray:
    """Marks the characters at which a word starts."""
    n = len(symbol)
    chunks = -(-n // length)
    laid = np.zeros(chunks * length, np.intp)
    laid[:n] = symbol
    laid = np.ascontiguousarray((laid * 8).reshape(chunks, length).T)
    lanes = np.repeat(np.arange(8, dtype=np.uint8)[:, None], chunks, 1)
    for k in range(length):
        lanes = _STEP[laid[k] + lanes]
        if k % 8 == 7 and len(lanes) > 1 and (lanes == lanes[0]).all():
            lanes = lanes[:1]  # every start leads to one state
    maps = np.ascontiguousarray(np.broadcast_to(lanes, (8, chunks)).T)
    width = 1
    while width < chunks:  # maps[i] becomes the composition of all maps up to i
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width].astype(np.intp), 1)
        width *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = maps[:-1, START]
    marks = np.empty((length, chunks), np.uint8)
    for k in range(length):
        at = laid[k] + state
        marks[k] = _STARTS[at]
        state = _STEP[at]
    return marks.T.ravel()[:n] != 0


def _byte_of_symbol() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Byte strings and merge ranks of a byte-level BPE file of the tokenizers library."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["model"].get("ignore_merges") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a normaliser or prefix space can be compiled")
        own = _byte_of_symbol()
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings can't be compiled")
        raw = lambda s: bytes(own[c] for c in s)
        self.bytes_of = {i: raw(s) for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(self.id_of[raw(a)], self.id_of[raw(b)]): (r, self.id_of[raw(a + b)]) for r, (a, b) in enumerate(pairs)}

    def encode(self, word: bytes) -> list[int]:
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            pair = (ids[best[1]], ids[best[1] + 1])
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and (ids[k], ids[k + 1]) == pair:
                    out.append(self.rank[pair][1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids


class Transducer:
    """Token counts of words, by transitions that are compiled when first met."""

    MOST_STATES, MOST_MAPS = 250_000, 100_000
    #: Bytes of a long word's chunks.
    CHUNK = 64
    #: Where counts are packed: 10 bits, so no entry may be longer than ``ZERO`` bytes.
    ZERO = 512

    def __init__(self, vocabulary: Vocabulary):
        if max(map(len, vocabulary.id_of)) >= self.ZERO or len(vocabulary.id_of) >= 1 << 17:
            raise ValueError("the vocabulary is too large to pack")
        self.v = vocabulary
        self.child: dict[int, int] = {}
        self.token = [-1]
        for word, i in vocabulary.id_of.items():
            node = 0
            for b in word:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = i
        self.grows = [False] * len(self.token)
        for key in self.child:
            self.grows[key >> 8] = True
        self.fits: dict[tuple[int, int], bool] = {}
        # the merge that makes each entry, as rank, left and right part; bytes have none
        self.made = {i: (-1, i, i) for i in vocabulary.bytes_of}
        for (left, right), (rank, out) in vocabulary.rank.items():
            if self.made[out][0] >= 0:
                raise ValueError("an entry that two merges make can't be compiled")
            self.made[out] = (rank, left, right)
        self.clear()

    def clear(self) -> None:
        start = (self.ZERO,)  # the root, before any token, at count 0
        self.number = {start: 0}
        self.states: list[tuple[int, ...]] = [start]
        self.moves: dict[int, int] = {}
        self.maps: dict[tuple[int, bytes], tuple[int, int]] = {}

    def _fits(self, before: int, token: int) -> bool:
        """Whether a token encodes to itself, alone or after another."""
        key = (before, token)
        if (known := self.fits.get(key)) is None:
            known = self.fits[key] = self.v.encode(self.v.bytes_of[token]) == [token] if before < 0 else self._apart(before, token)
            if len(self.fits) > 2_000_000:
                self.fits.clear()
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge joins two entries, by undoing the merges that made them, the last one first.

        Just before a merge is undone its parts stood beside the other entry; a pair across the border of a lower rank
        would have merged then. Of equal ranks the left one goes first.
        """
        below = len(self.v.rank)
        while True:
            across = self.v.rank.get((a, b))
            if across is not None and across[0] < below:
                return False
            x, y = self.made[a], self.made[b]
            if x[0] > y[0]:
                below, a = x[0], x[2]
            elif y[0] >= 0:
                below, b = y[0] + 1, y[1]
            else:
                return True

    def _compile(self, state: int, byte: int) -> int:
        """The transition as next state and change of the count; suffixes are packed as node, last token + 1 and count."""
        live, last, count = [], None, 0
        for packed in self.states[state]:
            to = self.child.get(packed >> 28 << 8 | byte)
            if to is None:
                continue
            if self.grows[to]:  # else no longer entry begins so
                live.append(to << 28 | packed & 0xFFFFFFF)
            if last is None and self.token[to] >= 0 and self._fits((packed >> 10 & 0x3FFFF) - 1, self.token[to]):
                last, count = self.token[to], (packed & 0x3FF) - self.ZERO + 1
        if last is None:
            raise ValueError("the vocabulary has no unique last token here")
        key = (*(x - count for x in live), last + 1 << 10 | self.ZERO)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        out = self.moves[state << 8 | byte] = self.number[key] << 10 | count + self.ZERO
        return out

    def run(self, state: int, chunk: bytes) -> tuple[int, int]:
        """One entry of a chunk's state map: the state after it, and the tokens that its transitions emit."""
        total, get = 0, self.moves.get
        for byte in chunk:
            move = get(state << 8 | byte)
            if move is None:
                move = self._compile(state, byte)
            state = move >> 10
            total += move & 0x3FF
        return state, total - self.ZERO * len(chunk)

    def count(self, word: bytes) -> int:
        """The tokens of a word; one longer than ``CHUNK`` bytes is the composition of its chunks' maps."""
        if len(self.states) > self.MOST_STATES or len(self.maps) > self.MOST_MAPS:
            self.clear()
        if len(word) <= self.CHUNK:
            return self.run(0, word)[1]
        state = total = 0
        for at in range(0, len(word), self.CHUNK):
            key = (state, word[at : at + self.CHUNK])
            if (entry := self.maps.get(key)) is None:
                entry = self.maps[key] = self.run(*key)
            state, n = entry
            total += n
        return total


class _Counts(dict):
    """Counts of words met; a bounded cache over the transducer."""

    MOST = 300_000

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) > self.MOST:
            self.clear()
        n = self.transducer.count(word.encode())
        if len(word) <= 64:
            self[word] = n
        return n


class Counter:
    """Token counts of texts."""

    def __init__(self, content: bytes, classes: np.ndarray):
        vocabulary = Vocabulary(content)
        self.special, self.classes = vocabulary.special, classes
        self.counts = _Counts(Transducer(vocabulary))

    def __call__(self, texts: list[str]) -> list[int]:
        parts, owner, found = [], [], [0] * len(texts)
        for d, text in enumerate(texts):
            own = [text]
            for s in self.special:
                if s in text:
                    own = [x for y in own for x in y.split(s)]
                    found[d] += text.count(s)
            parts += own
            owner += [d] * len(own)
        joined = "\0".join(parts)
        if not joined:
            return found
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        breaks = np.cumsum([len(p) + 1 for p in parts[:-1]], dtype=np.int64) - 1 if len(parts) > 1 else np.zeros(0, np.int64)
        marks = word_starts(symbols(codes, breaks, self.classes))
        marks[breaks] = True  # a separator closes the word before it; its own slot is left out below
        cut = np.flatnonzero(marks)
        ends = np.append(cut[1:], len(codes))
        own = np.ones(len(cut), bool)
        own[np.searchsorted(cut, breaks)] = False
        cut, ends = cut[own], ends[own]
        sizes = list(map(self.counts.__getitem__, [joined[a:b] for a, b in zip(cut.tolist(), ends.tolist())]))
        part = np.searchsorted(breaks, cut)
        by = np.bincount(np.asarray(owner)[part], weights=sizes, minlength=len(texts)).astype(np.int64)
        return (by + found).tolist()


_READY: dict[int, Counter] = {}


def _counter(content: bytes, classes: bytes) -> Counter:
    """One counter a worker and vocabulary."""
    key = zlib.crc32(content)
    if key not in _READY:
        _READY[key] = Counter(content, np.frombuffer(zlib.decompress(classes), np.uint8))
    return _READY[key]


def count_tokens(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, for the tokenizers file at ``path``.

    Special strings inside texts are one token each, the library's default. The file is read on the driver and sent to
    the executors.
    """
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        content = f.read()
    classes = zlib.compress(character_classes(Tokenizer.from_str(content.decode()).pre_tokenizer).tobytes(), 1)
    sent = documents.sparkSession.sparkContext.broadcast((content, classes))

    def rows(batches):
        counter = _counter(*sent.value)
        for batch in batches:
            text = batch.column("text").fill_null("")
            for b in blocks(text):
                n = pa.array(counter(text.slice(b.first, b.n).to_pylist()), pa.int64())
                size = pa.array(np.diff(b.at))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.first, b.n), size, n, pa.compute.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's count under the 50k byte-level vocabulary."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
